"""The engine's registered queries. Their DuckDB oracles are in ``oracles``.

Documents stand in for chunks where a query is about retrieval: one chunk a
document, ``chunk_id = doc_id#0``, and the benchmark items are the questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import routing, text, tools
from ..functions.fixed import THESAURUS
from ..operators import blockmax, chunking, dense, evaluate, expansion, fusion, grounding, ivf, loop, memory, reader, rerank, sparse, sweep, thesaurus
from ..sources.corpus import not_blank, replace_revisions, spread
from .engine import probe_rows, validate
from .oracles import EXPANSION_QUESTIONS, MIXED_TEXTS, ORACLES, RAW_OUTPUTS, REMEMBERED, ROUTED, SETTINGS, TOOL_CALLS
from .steps import Steps

K = 6
_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _found[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("chunk_id"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def inline(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


class Found:
    """What the lists of one search share: the questions' terms, what each chunk has of them, and the counts of the corpus, each made once."""

    def __init__(self, spark: SparkSession, sf: str):
        cut = Steps(spark).cut
        self.terms = cut(sparse.query_terms(questions(spark, sf)))
        self.rows = cut(sparse.counted(chunks(spark, sf), self.terms))
        self.stats = cut(sparse.corpus_stats(self.rows))


def bm25(spark: SparkSession, sf: str, k: int = K, found: Found | None = None) -> DataFrame:
    """Scores rounded to 6 digits before ranking, so that both engines rank alike."""
    found = found or Found(spark, sf)
    return Steps(spark).cut(sparse.best_of(found.rows, found.stats, found.terms, k, digits=6))


def overlaps(spark: SparkSession, sf: str, k: int = K, found: Found | None = None) -> DataFrame:
    """A second ranked list: by the share of the question's distinct tokens that a chunk holds."""
    found = found or Found(spark, sf)
    return sparse.best_of(found.rows, found.stats, found.terms, k, digits=6, share=True)


# -- text ------------------------------------------------------------------------------


@query
def tokenize_stats(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", text.tokenize("text").alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"))


@query
def token_df(spark, sf):
    rows = sparse.postings(chunks(spark, sf))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query
def tokenize_inline(spark, sf):
    return inline(spark, MIXED_TEXTS).select("id", F.concat_ws("|", text.tokenize("text")).alias("tokens"))


@query
def sentence_split_counts(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", text.sentences("text").alias("s"))
    size = F.aggregate("s", F.lit(0), lambda n, x: n + F.length(x))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(size, F.lit(0)).alias("n_chars"))


@query
def jaccard_pairs(spark, sf):
    """Each document beside those of the next id: texts meet by blocks of ids, each with the first of the next block, and are tokenised once."""
    near = lambda c: F.shiftright(c, 6)
    docs = read(spark, sf, "documents").select(F.col("doc_id"), "text", F.col("doc_id").cast("long").alias("at")).where("at IS NOT NULL")
    docs = docs.withColumn("b", F.explode(F.array_distinct(F.array(near(F.col("at")), near(F.col("at") - 1))))).repartition("b")
    sets = docs.select("doc_id", "at", "b", text.token_set("text").alias("a"))
    beside = F.collect_list("a").over(Window.partitionBy("b").orderBy("at").rangeBetween(1, 1))
    rows = sets.withColumn("next", beside).where(F.col("b") == near(F.col("at"))).select("doc_id", "a", F.explode("next").alias("b"))
    rows = rows.select("doc_id", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("both"))
    return rows.select(
        "doc_id",
        F.round(text.jaccard_of(F.col("both"), F.col("n") + F.col("m") - F.col("both")), 6).alias("jaccard"),
        F.round(F.coalesce(F.col("both") / F.nullif("n", F.lit(0)), F.lit(0.0)), 6).alias("overlap"),
    )


@query
def normalised_text(spark, sf):
    flat = text.normalise_ws("text")
    return read(spark, sf, "documents").select("doc_id", F.length(flat).alias("n"), F.md5(flat).alias("digest"))


@query
def content_token_counts(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", text.content_tokens(text.strip_citations("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_content"))


@query
def best_excerpts(spark, sf):
    hits = bm25(spark, sf).where("rank = 1").join(chunks(spark, sf), "chunk_id")
    asked = questions(spark, sf).select("query_id", F.col("text").alias("question"))
    return hits.join(asked, "query_id").select("query_id", "chunk_id", text.best_excerpt("question", "text", 160).alias("excerpt"))


@query
def approx_token_counts(spark, sf):
    rows = read(spark, sf, "conversations").groupBy("conv_id")
    return rows.agg(F.sum(text.approx_tokens("text")).alias("tokens"))


@query
def stream_slices(spark, sf):
    return questions(spark, sf).select("query_id", F.posexplode(text.slices("text", 24)).alias("at", "piece"))


@query
def pictograph_scan(spark, sf):
    rows = inline(spark, MIXED_TEXTS).select(F.concat(F.lit("inline-"), F.col("id").cast("string")).alias("key"), "text")
    docs = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")
    pages = read(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("text"))
    lines = rows.unionByName(docs).unionByName(pages).select("key", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    places = lines.select("key", (F.col("line") + 1).alias("line"), F.explode(text.pictograph_places("text")).alias("p"))
    return places.select("key", "line", "p.column", "p.code")


@query
def number_formats(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 8).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", text.format_number("v").alias("shown"))


@query
def tokenize_mixed(spark, sf):
    """All documents with their vowels turned into CJK characters: pairs of these, then the runs of the rest."""
    mixed = read(spark, sf, "documents").select("doc_id", text.tokenize(_mixed(F.col("text"))).alias("t"))
    return mixed.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.concat_ws("|", "t")).alias("digest"))


def _mixed(column):
    return F.translate(column, "aeiou", "猫检索融合")


# -- sparse index ------------------------------------------------------------------------


@query
def bm25_topk(spark, sf):
    return bm25(spark, sf).select("query_id", "chunk_id", "score", "rank")


@query
def bm25_stats(spark, sf):
    return sparse.corpus_stats(chunks(spark, sf)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_idf(spark, sf):
    df = sparse.term_stats(sparse.tokens(chunks(spark, sf)).select(F.explode(F.array_distinct("tokens")).alias("term")))
    rows = df.join(F.broadcast(sparse.corpus_stats(chunks(spark, sf))))
    return rows.select("term", F.round(sparse.robertson_idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query
def posting_lists(spark, sf):
    rows = sparse.counted(chunks(spark, sf)).where(F.size("terms") > 0)
    total = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, n: s + n)
    return rows.select("chunk_id", F.size("terms").cast("long").alias("n_terms"), total.alias("n_tokens"), F.array_max("tfs").alias("max_tf"))


@query
def bm25_blockmax(spark, sf):
    """The rows of ``bm25_topk``, from blocks of postings of which the hopeless ones stay shut."""
    cut = Steps(spark).cut
    index = cut(blockmax.index(chunks(spark, sf)))
    stats = cut(sparse.corpus_stats(chunks(spark, sf)))
    return blockmax.search(index, stats, sparse.query_terms(questions(spark, sf)), K, digits=6, cut=cut)


@query
def upsert_bm25(spark, sf):
    """BM25 after an upsert of every tenth document: a second segment, merged with the first as it is read."""
    from .engine import Engine

    engine = Engine(spark, chunk_with=_one_chunk)
    docs = read(spark, sf, "documents").select("doc_id", "text")
    engine.ingest(spread(docs))
    engine.ingest(docs.where("doc_id % 10 = 3").select("doc_id", F.concat(F.lit("revised "), F.left("text", F.lit(200))).alias("text")))
    return engine.keyword(questions(spark, sf), K, 6).select("query_id", "chunk_id", "score", "rank")


def _one_chunk(docs: DataFrame) -> DataFrame:
    """A chunk for each document."""
    none = F.lit(None).cast("map<string,string>").alias("meta")
    return docs.select(F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "doc_id", "text", F.lit(0).alias("ordinal"), F.lit("").alias("heading"), none)


# -- dense index -------------------------------------------------------------------------


def _centroids(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"])
    return means.groupBy("label").agg(ordered.alias("vec")).select(F.col("label").cast("string").alias("query_id"), "vec")


def _near(spark: SparkSession, sf: str, k: int) -> DataFrame:
    vectors = read(spark, sf, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return dense.knn(rows, _centroids(vectors), k, 6)


@query
def dense_topk(spark, sf):
    return _near(spark, sf, K).select("query_id", "chunk_id", "score", "rank")


def _filed(spark: SparkSession, sf: str, k: int, *exact: bool) -> list[DataFrame]:
    """The k nearest, by an inverted file on disk, of the vectors whose id 50 divides: a search of one index for each of ``exact``."""
    steps = Steps(spark)
    vectors = ivf.from_arrays(read(spark, sf, "embeddings"), "vec_id", "embedding", "chunk_id")
    quantiser = ivf.InvertedFile().train(vectors)
    ivf.write(ivf.assigned(vectors, quantiser), f"{steps.root}/cells")
    filed = spark.read.parquet(f"{steps.root}/cells")
    held = ivf.radii(filed)
    asked = ivf.from_arrays(read(spark, sf, "embeddings").where("vec_id % 50 = 0"), "vec_id", "embedding", "query_id")
    return [ivf.search(filed, quantiser, held, asked, k, e, 6, steps.cut) for e in exact]


@query
def ivf_exact_topk(spark, sf):
    """Through the cells of an inverted file, and on to those that may hold something nearer."""
    return _filed(spark, sf, K, True)[0].select("query_id", "chunk_id", "score", "rank")


@query
def ivf_recall(spark, sf):
    """Of what all cells hold, how much the probed ones find: at least nine tenths."""
    cut = Steps(spark).cut
    found, near = (cut(df.select("query_id", "chunk_id")) for df in _filed(spark, sf, K, False, True))
    both = found.join(near.hint("merge"), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")).join(both.hint("merge"), "query_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_queries"), (F.sum("n") >= 0.9 * F.sum("m")).alias("enough"))


@query
def vector_memory_recall(spark, sf):
    return _near(spark, sf, 3).select("query_id", "chunk_id", "rank")


@query
def cosine_to_label(spark, sf):
    vectors = read(spark, sf, "embeddings")
    rows = vectors.join(F.broadcast(_centroids(vectors)), F.col("label").cast("string") == F.col("query_id"))
    return rows.select("vec_id", F.round(dense.cosine(F.col("embedding").cast("array<double>"), F.col("vec")), 6).alias("cosine"))


@query
def vector_upsert(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", "label")
    newer = rows.where("label = 3").withColumn("label", F.lit(30))
    return dense.upsert(rows, newer, "vec_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def hash_embed_norm(spark, sf):
    squares = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w)
    return dense.hashed(read(spark, sf, "documents"), "doc_id").select("doc_id", F.round(squares, 6).alias("norm"))


@query
def hash_embed_slots(spark, sf):
    rows = inline(spark, REMEMBERED + MIXED_TEXTS)
    return dense.hashed_vectors(rows, "id").select("id", "slot", F.round("weight", 9).alias("weight"))


@query
def memory_recall(spark, sf):
    """Remembered texts nearest to each other one, by the hashed counts of conversational memory."""
    rows = inline(spark, REMEMBERED)
    asked = rows.select(F.col("id").cast("string").alias("query_id"), "text")
    found = memory.recall(rows.select(F.col("id").cast("string").alias("key"), "text"), asked, 3)
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query
def hash_embed_search(spark, sf):
    return dense.search(dense.hashed(chunks(spark, sf), "chunk_id"), dense.hashed(questions(spark, sf), "query_id"), K)


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """(key, text) of all parts: their names and types, twice where the size is even."""
    rows = read(spark, sf, "part")
    text = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_name")))
    return rows.select(F.col("p_partkey").cast("string").alias("key"), text.alias("text"))


def _every_hundredth(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("key").cast("int") % 100 == 0).withColumnRenamed("key", "query_id")


@query
def hash_embed_parts(spark, sf):
    return dense.hashed_vectors(_parts(spark, sf), "key").select("key", "slot", F.round("weight", 9).alias("weight"))


@query
def hash_search_parts(spark, sf):
    """Nearest parts of every hundredth one, by hashed vectors."""
    parts = _parts(spark, sf)
    found = dense.search(dense.hashed(parts, "key").withColumnRenamed("key", "chunk_id"), dense.hashed(_every_hundredth(parts), "query_id"), K)
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query
def memory_recall_parts(spark, sf):
    """Nearest parts of every hundredth one, by the hashed counts of conversational memory."""
    parts = _parts(spark, sf)
    found = memory.recall(parts, _every_hundredth(parts), 3)
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


# -- fusion and reranking ------------------------------------------------------------------


def _fused(spark: SparkSession, sf: str, weights: dict[str, float] | None = None) -> DataFrame:
    found = Found(spark, sf)
    lists = [("dense", overlaps(spark, sf, found=found)), ("sparse", bm25(spark, sf, found=found))]
    return Steps(spark).cut(fusion.reciprocal_rank_fusion(lists, weights=weights, top_k=2 * K))


def _named(fused: DataFrame, *more: str) -> DataFrame:
    listed = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("ranks")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return fused.select("query_id", "chunk_id", F.round("score", 6).alias("score"), listed.alias("ranks"), F.concat_ws(",", "sources").alias("sources"), *more)


@query
def rrf_fuse(spark, sf):
    return _named(_fused(spark, sf), "pos")


@query
def rrf_weighted(spark, sf):
    return _named(_fused(spark, sf, {"dense": 5.0, "sparse": 0.1}), "pos")


@query
def minmax_norm(spark, sf):
    return bm25(spark, sf).select("query_id", "chunk_id", F.round(fusion.minmax("score"), 6).alias("norm"))


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    fused = _fused(spark, sf)
    rows = Steps(spark).cut(fused.select("query_id", "chunk_id", "pos").join(chunks(spark, sf), "chunk_id"))
    scores = rerank.lexical_rerank(questions(spark, sf), rows.select("query_id", "pos", "text"))
    return fused, Steps(spark).cut(scores.select("query_id", "pos", F.round("rerank_score", 6).alias("rerank_score")))


@query
def lexical_rerank(spark, sf):
    return _candidates(spark, sf)[1]


@query
def spearman_guard(spark, sf):
    fused, scores = _candidates(spark, sf)
    rows = fused.join(scores, ["query_id", "pos"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    return fusion.spearman(rows, "score", "rerank_score").select("query_id", "n", F.round("spearman", 6).alias("spearman"))


@query
def guarded_rerank(spark, sf):
    fused, scores = _candidates(spark, sf)
    rows = rerank.guarded_rerank(fused, scores)
    return rows.select("query_id", "chunk_id", "pos", "final_pos", "alpha_eff", "applied", F.round("score", 6).alias("score"))


@query
def naive_rerank(spark, sf):
    fused, scores = _candidates(spark, sf)
    return rerank.naive_rerank(fused, scores).select("query_id", "chunk_id", "pos", "final_pos")


@query
def guard_on_reversed(spark, sf):
    """Every item's six hits under a reranker that turns them round: the guard keeps their order."""
    hits = bm25(spark, sf)
    fused = hits.select("query_id", "chunk_id", "score", F.create_map(F.lit("sparse"), "rank").alias("ranks"), F.array(F.lit("sparse")).alias("sources"), F.col("rank").alias("pos"))
    scores = hits.select("query_id", F.col("rank").alias("pos"), F.col("rank").cast("double").alias("rerank_score"))
    guarded = rerank.guarded_rerank(fused, scores).select("query_id", "pos", F.col("final_pos").alias("guarded_pos"), "alpha_eff", F.round("spearman", 6).alias("spearman"))
    return guarded.join(rerank.naive_rerank(fused, scores).select("query_id", "pos", F.col("final_pos").alias("naive_pos")), ["query_id", "pos"])


@query
def expand_documents(spark, sf):
    """All documents, each with up to five keys of the thesaurus after its text."""
    keys = F.array(*(F.lit(k) for k in THESAURUS))
    at = lambda i: F.get(keys, F.pmod(F.col("doc_id") * i + i, F.lit(len(THESAURUS))).cast("int"))
    asked = F.concat_ws(" ", "text", *(F.when(F.col("doc_id") % 6 > i, at(i + 1)) for i in range(5)))
    rows = read(spark, sf, "documents").select("doc_id", expansion.expand(asked).alias("e"))
    return rows.select("doc_id", F.concat_ws("|", "e.terms").alias("terms"), F.concat_ws("|", "e.matched").alias("matched"), F.md5("e.query").alias("digest"))


@query
def expand_thesaurus(spark, sf):
    """All documents by a thesaurus table: the longer words of the benchmark's items, with those that stand beside them."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " +"), lambda w: F.length(w) >= 5)
    pairs = read(spark, sf, "benchmark").select(F.explode(F.arrays_zip(words.alias("key"), F.slice(words, 2, 1 << 30).alias("next"))).alias("p"))
    table = pairs.where("p.key IS NOT NULL").groupBy("p.key").agg(F.slice(F.array_sort(F.collect_set("p.next")), 1, 3).alias("terms"))
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    out = thesaurus.expand_by_table(rows, Steps(spark).cut(table), cut=Steps(spark).cut)
    return out.select("query_id", F.concat_ws("|", "terms").alias("terms"), F.md5(F.concat_ws("|", "matched")).alias("matched"), F.md5("query").alias("digest"))


@query
def expand_queries(spark, sf):
    rows = inline(spark, EXPANSION_QUESTIONS).select("id", expansion.expand(F.col("text")).alias("e"))
    return rows.select("id", F.concat_ws("|", "e.terms").alias("terms"), F.concat_ws("|", "e.matched").alias("matched"), "e.query")


# -- chunking --------------------------------------------------------------------------------


@query
def chunk_coverage(spark, sf):
    """Chunks that are not blank cover all but white space: characters, first start and last end by document."""
    rows = chunking.chunk_documents(spread(read(spark, sf, "documents").select("doc_id", "text")))
    out = rows.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n_chars"), F.min("start").alias("first"), F.max("end").alias("last"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_chars", "first", "last")


@query
def chunk_table(spark, sf):
    rows = chunking.chunk_documents(spread(read(spark, sf, "documents").select("doc_id", "text")))
    return rows.select("chunk_id", "ordinal", "start", "end", "heading", F.length("text").alias("n"))


@query
def chunk_customers(spark, sf):
    """A document for each customer, cut into chunks: a heading, a line of 100 characters for each order, and one of 1,500."""
    line = F.rpad(F.concat(F.lit("order "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(" of "), F.col("o_orderpriority")), 100, ".")
    lines = F.concat_ws("\n", F.array_sort(F.collect_list(line)), F.lit("x" * 1500))
    docs = read(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc_id")).agg(lines.alias("lines"))
    docs = docs.select("doc_id", F.concat(F.lit("# Customer "), "doc_id", F.lit("\n\n"), "lines").alias("text"))
    rows = chunking.chunk_documents(docs)
    return rows.select("chunk_id", "ordinal", "start", "end", "heading", F.md5("text").alias("digest"))


@query
def hard_windows(spark, sf):
    return chunking.hard_windows(read(spark, sf, "documents").select("doc_id", "text"))


@query
def reingest_anti(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    newer = docs.where("length(text) < 500").select("doc_id", F.concat(F.lit("new: "), "text").alias("text"))
    merged = replace_revisions(docs, newer)
    return merged.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query
def blank_documents(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.when(F.length("text") < 200, F.lit(" \n\t ")).otherwise(F.col("text")).alias("text"))
    return not_blank(docs).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


# -- routing and tools -------------------------------------------------------------------------


@query
def route_kinds(spark, sf):
    line = read(spark, sf, "lineitem").select(
        F.concat(F.lit("calculate "), F.col("l_quantity").cast("int").cast("string"), F.lit(" * ("), F.col("l_linenumber").cast("string"), F.lit(" + 2)")).alias("text")
    )
    part = read(spark, sf, "part").select(F.concat(F.col("p_size").cast("string"), F.lit(" ft to cm")).alias("text"))
    orders = read(spark, sf, "orders").select(
        F.concat(F.lit("days between "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" and "), F.date_format(F.date_add("o_orderdate", 40), "yyyy/MM/dd")).alias("text")
    )
    items = read(spark, sf, "benchmark").select(F.regexp_replace("text", r"[0-9=]|to", "").alias("text"))
    rows = line.unionByName(part).unionByName(orders).unionByName(items)
    return rows.select(routing.route(F.col("text"))["kind"].alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def route_texts(spark, sf):
    """Every document's and item's text as it is, and every order line's as sums, lengths and dates, to its route."""
    n, k, d = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd")
    made = (
        F.when(k == 1, F.concat(F.lit("What is "), n, F.lit(" * (2 + 3)? ")))
        .when(k == 2, F.concat(n, F.lit(" ft to cm")))
        .when(k == 3, F.concat(F.lit("how many days between "), d, F.lit(" and 2000/01/02")))
        .when(k == 4, F.concat(n, F.lit(" kg to KG")))
        .when(k == 5, F.concat(F.lit("("), n, F.lit(" + 1)) - 2")))
        .otherwise(F.concat(d, F.lit(" / "), n))
    )
    rows = read(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    rows = rows.unionByName(read(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("key"), "text"))
    rows = rows.unionByName(read(spark, sf, "lineitem").select(F.concat(F.lit("l"), "l_orderkey", F.lit("-"), k).alias("key"), made.alias("text")))
    return rows.select("key", routing.route(F.col("text")).alias("r")).select("key", "r.kind", "r.payload")


@query
def routes_inline(spark, sf):
    rows = inline(spark, [q for q, _, _ in ROUTED]).select("id", routing.route(F.col("text")).alias("r"))
    return rows.select("id", "r.kind", "r.payload")


@query
def calc_lineitem(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        tools.calculator(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("*("), F.col("l_linenumber").cast("string"), F.lit("+7)-2^3"))).alias("r"),
    )
    return rows.select("l_orderkey", "l_linenumber", "r.ok", "r.value")


@query
def unit_part(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", tools.unit_tool(F.concat(F.col("p_size").cast("string"), F.lit(" km m"))).alias("r"))
    return rows.select("p_partkey", "r.ok", "r.value")


@query
def date_diff_orders(spark, sf):
    rows = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    payload = F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("l_shipdate", "yyyy/MM/dd"))
    rows = rows.select("l_orderkey", "l_linenumber", tools.date_tool(payload).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "r.ok", "r.value")


@query
def tool_dispatch(spark, sf):
    rows = spark.createDataFrame([(i, t, p) for i, (t, p, *_) in enumerate(TOOL_CALLS)], "id int, tool string, payload string")
    return rows.select("id", tools.invoke(F.col("tool"), F.col("payload")).alias("r")).select("id", "r.ok", "r.value", "r.error")


@query
def tool_lines(spark, sf):
    """Every order line as a call of a tool, wrong calls too."""
    n, k, d = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd")
    tool = F.when(k <= 2, "calculator").when(k <= 4, "unit_convert").when(k <= 6, "date_diff").otherwise("no_such")
    payload = F.when(k == 1, F.concat(n, F.lit("*2-1"))).when(k == 2, F.concat(n, F.lit("/0"))).when(k == 3, F.concat(n, F.lit(" km m"))).when(k == 4, F.concat(n, F.lit(" kg m")))
    payload = payload.when(k == 5, F.concat(d, F.lit(" 2000-01-01"))).otherwise(d)
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tools.invoke(tool, payload).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "r.ok", "r.value", "r.error")


@query
def guard_probe(spark, sf):
    rows, scores = probe_rows(spark)
    guarded = rerank.guarded_rerank(rows, scores).select("chunk_id", "pos", F.col("final_pos").alias("guarded_pos"), "alpha_eff", "spearman")
    return guarded.join(rerank.naive_rerank(rows, scores).select("chunk_id", F.col("final_pos").alias("naive_pos")), "chunk_id")


@query
def query_validation(spark, sf):
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return validate(rows).select("query_id", "valid")


# -- reading and grounding ------------------------------------------------------------------------


@query
def grounding_support(spark, sf):
    hits = bm25(spark, sf).where("rank <= 2").join(chunks(spark, sf), "chunk_id").select("query_id", "text")
    rows = grounding.verify(questions(spark, sf), hits, 0.6)
    return rows.select("query_id", "checked", "supported", F.round("support_rate", 6).alias("support_rate"))


@query
def extract_best_sentence(spark, sf):
    pool = bm25(spark, sf).join(chunks(spark, sf), "chunk_id").select("query_id", F.col("rank").alias("place"), "chunk_id", "text")
    best = reader.best_sentences(questions(spark, sf), pool)
    return best.select("query_id", "chunk_id", "sentence", F.round("score", 6).alias("score"), reader.answer_text(F.col("sentence"), F.col("chunk_id")).alias("answer"))


@query
def evidence_blocks(spark, sf):
    hits = bm25(spark, sf).join(chunks(spark, sf), "chunk_id").select("query_id", "rank", "chunk_id", "text")
    return reader.render_evidence(hits).select("query_id", F.length("block").alias("n"), F.md5("block").alias("digest"))


@query
def parsed_outputs(spark, sf):
    rows = inline(spark, [t for t, *_ in RAW_OUTPUTS])
    action = reader.parse_action(F.col("text"))
    return rows.select("id", action["tool"].alias("tool"), action["payload"].alias("payload"), reader.parse_final(F.col("text")).alias("final"))


@query
def parsed_turns(spark, sf):
    """Every turn of the conversations as a model's output, in five forms, read for its action and its answer."""
    t, k = F.coalesce("text", F.lit("")), F.col("turn") % 5
    first = F.get(F.split(t, "\n"), 0)
    said = (
        F.when(k == 0, F.concat(F.lit("Thought: so\nACTION: search["), F.replace(first, F.lit("]"), F.lit(")")), F.lit("]")))
        .when(k == 1, F.concat(F.lit("hm\nfinal answer: "), t))
        .when(k == 2, F.concat(F.lit("  "), first))
        .when(k == 3, F.concat(F.lit("a\n"), first))
        .otherwise(F.concat(F.lit("Observation: "), first))
    )
    rows = read(spark, sf, "conversations").select("conv_id", "turn", said.alias("text"))
    action = reader.parse_action(F.col("text"))
    return rows.select("conv_id", "turn", action["tool"].alias("tool"), F.md5(action["payload"]).alias("payload"), F.md5(reader.parse_final(F.col("text"))).alias("final"))


@query
def loop_traces(spark, sf):
    """The reading loop with a reader of stated habits: one to four rounds of the calculator, some questions lost on the way."""
    n, step = F.length("text"), F.col("step")

    def complete(frontier: DataFrame) -> DataFrame:
        lost, over = (n % 7 == 6) & (step == 2), step >= n % 6 + 1
        call = F.format_string("Thought: more\nAction: calculator[%d*%d]", n, step)
        output = F.when(lost, F.lit("hm\nhm")).when(over, F.format_string("Final Answer: after %d\n\n  rounds", step)).otherwise(call)
        return frontier.select("query_id", output.alias("output"))

    def invoke(calls: DataFrame) -> DataFrame:
        return calls.select("query_id", tools.invoke(F.col("tool"), F.col("payload")).alias("r")).select("query_id", "r.*")

    rows = loop.run_loop(questions(spark, sf), complete, invoke, 4, Steps(spark).cut)
    return rows.select("query_id", "final", "steps", F.concat_ws("|", "trace").alias("trace"), F.md5("scratchpad").alias("digest"))


@query
def ask_benchmark(spark, sf):
    """The whole path over all documents: ingest, route, retrieve, read, ground."""
    from .engine import Engine

    engine = Engine(spark)
    engine.ingest(spread(read(spark, sf, "documents").select("doc_id", "text")))
    rows = engine.ask(questions(spark, sf))
    return rows.select("query_id", "route", "steps", "answer", F.size("citations").alias("n_citations"), F.round("support_rate", 6).alias("support_rate"))


# -- memory ---------------------------------------------------------------------------------------


@query
def conversation_compaction(spark, sf):
    rows = memory.compact(read(spark, sf, "conversations"), 256)
    return rows.select("conv_id", "n_turns", "kept", "evicted", "tokens", F.md5("summary").alias("summary_digest"))


@query
def conversation_context(spark, sf):
    turns = read(spark, sf, "conversations")
    rows = memory.context(memory.compact(turns, 256), turns)
    return rows.select("conv_id", "at", "role", F.md5("text").alias("digest"))


@query
def conversation_stream(spark, sf):
    """``conversation_compaction`` as a stream with state of its own for each conversation: the last row of each."""
    from ..streaming import STATE_STORE, conversation_state

    steps, before = Steps(spark), {name: spark.conf.get(name, None) for name in STATE_STORE}
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{sf}/conversations.parque[t]")  # as a pattern it may be one file
    try:
        for name, value in STATE_STORE.items():
            spark.conf.set(name, value)
        out = conversation_state(source, 256)
        run = out.writeStream.foreachBatch(lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{steps.root}/out/at={n}"))
        run.outputMode("update").option("checkpointLocation", f"{steps.root}/stream").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    rows = spark.read.parquet(f"{steps.root}/out").drop("at").groupBy("conv_id").agg(F.max_by(F.struct("n_turns", "kept", "evicted", "tokens", "summary"), "batch").alias("r"))
    return rows.select("conv_id", "r.n_turns", "r.kept", "r.evicted", "r.tokens", F.md5("r.summary").alias("summary_digest"))


# -- metrics ---------------------------------------------------------------------------------------


def _truth(spark: SparkSession, sf: str, own: Found) -> DataFrame:
    """Chunks that hold an item's text as it is.

    A chunk that does holds every token that stands inside the item as a token of its
    own, so it is looked for among the postings of the rarest of these; items of no such
    token (under three words) go to all chunks, a block at a time.
    """
    rows = chunks(spark, sf)
    asked = questions(spark, sf).select("query_id", F.col("text").alias("item"))
    runs = text.latin_runs("item")
    inner = asked.select("query_id", F.explode(F.array_distinct(F.slice(runs, 2, F.greatest(F.lit(0), F.size(runs) - 2)))).alias("term"))
    found = sparse.flat(own.rows).select("chunk_id", "term").join(inner.select("term").distinct(), "term", "left_semi")  # latin runs are among an item's terms
    rarest = inner.join(sparse.term_stats(found), "term", "left").groupBy("query_id").agg(F.min_by("term", F.coalesce("df", F.lit(0))).alias("term"))
    rarest = Steps(spark).cut(rarest)
    near = rarest.join(found, "term").join(asked, "query_id").join(rows, "chunk_id")
    hits = near.where(F.contains(F.col("text"), F.col("item"))).select("query_id", F.col("chunk_id").alias("id"))
    short = Steps(spark).cut(asked.join(rarest, "query_id", "left_anti"))
    parts = -(-short.count() // 2000)
    for i in range(parts):
        block = short.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        hits = hits.unionByName(rows.join(F.broadcast(block), F.contains(F.col("text"), F.col("item"))).select("query_id", F.col("chunk_id").alias("id")))
    return Steps(spark).cut(hits)


@query
def eval_ranking(spark, sf):
    found = Found(spark, sf)
    hits = bm25(spark, sf, found=found).select("query_id", F.col("chunk_id").alias("id"), "rank")
    rows = evaluate.ranking_metrics(hits, _truth(spark, sf, found), questions(spark, sf), K)
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank", "ndcg")))


@query
def sweep_settings(spark, sf):
    """Four settings of BM25 and of the fusion, with their means: one reading of the postings."""
    found, cut = Found(spark, sf), Steps(spark).cut
    asked = questions(spark, sf)
    settings = spark.createDataFrame([(n, *v) for n, v in SETTINGS.items()], sweep.SETTING)
    others = [("dense", cut(overlaps(spark, sf, found=found)))]
    return sweep.metrics(found.rows, found.stats, asked, _truth(spark, sf, found), settings, others, K, 6, cut)


@query
def eval_documents(spark, sf):
    found = Found(spark, sf)
    hits = bm25(spark, sf, found=found).select("query_id", F.element_at(F.split("chunk_id", "#"), 1).alias("doc_id"), "rank")
    docs = _truth(spark, sf, found).select("query_id", F.element_at(F.split("id", "#"), 1).alias("doc_id"))
    rows = evaluate.document_metrics(hits, docs, questions(spark, sf), K)
    return rows.select("query_id", "doc_hit", F.round("doc_rr", 6).alias("doc_rr"))


@query
def latency_percentiles(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("ms"))
    out = evaluate.latency_summary(rows)
    return out.select("key", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "max")))


@query
def counters(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_type").alias("key"), F.lit(1).cast("double").alias("value"))
    return evaluate.counters(rows)


@query
def corpus_counts(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("lang").alias("n_langs"), F.sum(F.length("text")).alias("n_chars"))
