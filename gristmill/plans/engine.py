"""The engine: ingest, retrieve, ask and evaluate over tables of questions.

A question is a row. Every step is a transform over all questions at once; the
corpus side is never collected.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import NO_MATCH, NO_RESULT, PROBES, ROUTE_FAILED_NOTE, ROUTE_NOTE, SEARCH_THOUGHT
from ..functions.routing import route
from ..functions.text import best_excerpt, slices, strip
from ..functions.tools import invoke
from ..operators import chunking, dense, evaluate, fusion, grounding, ivf, loop, reader, rerank, sparse
from ..operators.expansion import expand
from ..schemas import Settings
from ..sources.corpus import from_mapping, last_of_each, not_blank, read_texts
from .segments import Segments
from .steps import Steps

#: (texts (key, text), name of the key) to sparse unit vectors (key, slot, weight).
Encoder = Callable[[DataFrame, str], DataFrame]
#: Questions (query_id, text) and a pool (query_id, place, chunk_id, text) to (query_id, sentence, chunk_id, score).
Reader = Callable[[DataFrame, DataFrame], DataFrame]
#: Questions (query_id, text) to (query_id, citations, route, support_rate), and latency_ms, if it knows.
Runner = Callable[[DataFrame], DataFrame]


class Engine:
    """A corpus and its indexes, made once at ingest and kept in step with changed documents.

    ``rerank_with`` takes the place of the lexical reranker, ``embed_with`` of the
    hashed vectors, ``read_with`` of the sentence reader, ``complete_with`` of the reader's
    whole part in the loop (it gets a ``prompt``); ``index`` is an inverted file for the
    vectors, which are compared block by block without one; ``tools`` (name to a function
    from payload to a column ok, value, error) are found before the built-in ones.
    """

    def __init__(
        self,
        spark: SparkSession,
        settings: Settings | None = None,
        rerank_with: rerank.Reranker | None = None,
        embed_with: Encoder | None = None,
        read_with: Reader | None = None,
        tools: Mapping[str, Callable[[Column], Column]] | None = None,
        index: ivf.InvertedFile | None = None,
        complete_with: loop.Completer | None = None,
        chunk_with: Callable[[DataFrame], DataFrame] | None = None,
        most_segments: int = 8,
    ):
        self.spark, self.settings = spark, settings or Settings.from_conf(spark)
        self.rerank_with, self.tools = rerank_with, dict(tools or {})
        self.embed_with = embed_with or (lambda texts, key: dense.hashed(texts, key, self.settings.dim))
        self.own_vectors = embed_with is None
        self.read_with = read_with or reader.best_sentences
        self.index, self.complete_with, self.most_segments = index, complete_with, most_segments
        self.chunk_with = chunk_with or (lambda docs: chunking.chunk_documents(docs, self.settings.chunk_size, self.settings.overlap))
        self._store, self._steps = None, Steps(spark)
        self.reset()

    # -- corpus ---------------------------------------------------------------
    documents = property(lambda self: self._store.table("documents"))
    chunks = property(lambda self: self._store.table("chunks"))
    lengths = property(lambda self: self._store.table("lengths"))
    postings = property(lambda self: self._store.table("postings"))
    vectors = property(lambda self: self._store.table("vectors"))

    @property
    def corpus_stats(self) -> DataFrame:
        """One row: n_docs (chunks), avgdl (1 of an empty corpus)."""
        mean = F.coalesce(F.try_divide("dl", "n_chunks"), F.lit(1.0))
        return self._store.counts().select(F.col("n_chunks").alias("n_docs"), mean.alias("avgdl"))

    def reset(self) -> None:
        before, self._store = self._store, Segments(self.spark)
        if before:
            before.drop()

    def ingest(self, docs: DataFrame | Mapping[str, str] | Iterable[tuple[str, str]], replace: bool = False) -> dict:
        """Adds documents, or puts them in the place of those with their ids; ``replace`` drops all others first.

        Of documents with one id the last counts: of the greatest ``revision``, where
        there is such a column. What changes goes to a segment of its own, and nothing else
        is written; from ``most_segments`` segments on they are merged into one.
        """
        if not isinstance(docs, DataFrame):
            docs = from_mapping(self.spark, docs)
        more = ["revision"] if "revision" in docs.columns else []
        docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *more)
        docs = last_of_each(not_blank(docs), "doc_id").select("doc_id", "text")
        if replace or self._store.last < 0:
            self._build(docs)
        else:
            self._add(self._store, docs, True)
            if self._store.last + 1 >= self.most_segments:
                self.compact()
        return self.stats()

    def ingest_paths(self, *paths: str) -> dict:
        return self.ingest(read_texts(self.spark, *paths))

    def ingest_chunks(self, chunks: DataFrame) -> dict:
        """Takes over a saved chunk table; the documents are then what the chunks of each say, in order."""
        texts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda c: c["text"])
        store = Segments(self.spark)
        chunks = store.write("chunks", chunks)
        docs = store.write("documents", chunks.groupBy("doc_id").agg(F.concat_ws("\n", texts).alias("text")))
        store.commit({"documents": docs, "chunks": chunks, **self._indexed(store, chunks, True)})
        self._swap(store)
        return self.stats()

    def rebuild(self) -> dict:
        self._build(self.documents)
        return self.stats()

    def compact(self) -> None:
        """All segments as one. The quantiser of an index is trained anew."""
        self._swap(self._store.compact(lambda store, chunks: self._indexed(store, chunks, True)))

    def _indexed(self, store: Segments, chunks: DataFrame, anew: bool) -> dict[str, DataFrame]:
        """The indexes of some chunks, written: lengths, postings, vectors."""
        own = Steps(self.spark)
        tokens = own.cut(sparse.tokens(chunks))
        made = {"lengths": store.write("lengths", sparse.lengths(tokens)), "postings": store.write("postings", sparse.postings(tokens))}
        vectors = self.embed_with(tokens, "chunk_id").where(F.size("slots") > 0) if self.own_vectors else self.embed_with(chunks, "chunk_id")
        vectors = dense.as_arrays(vectors)
        if self.index:
            vectors = own.cut(vectors)
            if anew or store.quantiser is None:
                store.quantiser = self.index.train(vectors)
            vectors = ivf.assigned(vectors, store.quantiser)
        else:
            vectors = vectors.withColumns({"cell": F.lit(0), "apart": F.lit(0.0)})
        made["vectors"] = store.write("vectors", vectors)
        if self.index:
            for cell, radius in ivf.radii(made["vectors"]).items():
                store.radii[cell] = max(radius, store.radii.get(cell, 0.0))
        own.drop()
        return made

    def _build(self, docs: DataFrame) -> None:
        store = Segments(self.spark)
        self._add(store, docs, False)
        self._swap(store)

    def _add(self, store: Segments, docs: DataFrame, replacing: bool) -> None:
        """A segment of new documents, in the place of older ones of their ids."""
        own = Steps(self.spark)
        docs = store.write("documents", docs)
        made = store.write("chunks", self.chunk_with(docs))
        gone = None
        if replacing:
            ids = docs.select("doc_id")
            old = store.table("chunks").select("doc_id", "chunk_id").join(ids, "doc_id", "left_semi")
            old = store.table("documents").select("doc_id").join(ids, "doc_id", "left_semi").join(own.cut(old), "doc_id", "left")
            gone = own.cut(old.join(store.table("lengths"), "chunk_id", "left"))
            gone = gone if gone.limit(1).count() else None
        store.commit({"documents": docs, "chunks": made, **self._indexed(store, made, False)}, gone)
        own.drop()

    def _swap(self, store: Segments) -> None:
        before, self._store = self._store, store
        if before:
            before.drop()

    def release(self) -> None:
        """Drops the tables that answers so far were made from; results not yet read go with them."""
        self._steps.drop()

    def stats(self) -> dict:
        row = self._store.counts().first()
        return {"documents": row.n_docs, "documents_with_chunks": row.n_with_chunks, "chunks": row.n_chunks, "dim": self.settings.dim}

    def nearest(self, vectors: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank) of query vectors (query_id, slot, weight): through the index, where there is one."""
        if not self.index or not self._store.quantiser:
            return dense.search(self.vectors, vectors, k)
        queries = dense.as_arrays(vectors, "query_id")
        return ivf.search(self.vectors, self._store.quantiser, self._store.radii, queries, k, self.index.exact, cut=self._steps.cut)

    # -- retrieval --------------------------------------------------------------
    def retrieve(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, score, ranks, sources, spearman, alpha_eff, applied, reason, text, doc_id)."""
        s = self.settings
        k = max(1, k or s.top_k)
        queries = self._steps.cut(queries.select("query_id", "text"))
        near = self.nearest(self.embed_with(queries, "query_id"), k)
        widened = queries.select("query_id", expand(F.col("text"), s.max_expansions)["query"].alias("text"))
        found = self.keyword(widened, k)
        fused = self._steps.cut(fusion.reciprocal_rank_fusion([("dense", near), ("sparse", found)], s.rrf_k, top_k=2 * k))
        texts = self.chunks.select("chunk_id", "doc_id", "text")
        candidates = fused.join(texts, "chunk_id", "left").select("query_id", "pos", F.coalesce("text", F.lit("")).alias("text"))
        scores = None
        if s.rerank:
            scores = self.rerank_with(queries, candidates) if self.rerank_with else rerank.lexical_rerank(queries, candidates, s.rerank_cut)
            scores = self._steps.cut(scores)
        ranked = rerank.guarded_rerank(fused, scores, s.guard_alpha, s.spearman_floor, s.rerank)
        top = ranked.where(F.col("final_pos") <= k).withColumnRenamed("final_pos", "rank").drop("pos")
        return top.join(texts, "chunk_id")

    def keyword(self, queries: DataFrame, k: int, digits: int = 12) -> DataFrame:
        """(query_id, chunk_id, score, rank): BM25 over the postings of the queries' terms."""
        terms = self._steps.cut(sparse.query_terms(queries))
        rows = self._steps.cut(self.postings.join(terms.select("term").distinct(), "term", "left_semi"))
        return sparse.best_of(rows, self.corpus_stats, terms, k, self.settings.k1, self.settings.b, digits)

    # -- answers ------------------------------------------------------------------
    def ask(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, question, answer, citations, route, steps, trace, support_rate, checked, supported, unsupported)."""
        s = self.settings
        routed = self._steps.cut(queries.select("query_id", "text", route(F.col("text"), s.deterministic).alias("r"))).select("query_id", "text", "r.*")
        tools = self._steps.cut(routed.where("kind <> 'retrieve'").withColumn("result", self.invoke(F.col("tool"), F.col("payload"))))
        ok, value, error = (F.col(f"result.{c}") for c in ("ok", "value", "error"))
        asked = F.regexp_replace(strip("text"), "[？?]+$", "")
        note = F.when(ok, F.concat(F.lit(ROUTE_NOTE), "tool", F.lit("["), "payload", F.lit("] -> "), value))
        note = note.otherwise(F.concat(F.lit(ROUTE_FAILED_NOTE), "tool", F.lit(" -> "), error))
        one = F.when(ok, F.lit(1)).otherwise(0)
        computed = tools.select(
            "query_id",
            F.col("text").alias("question"),
            F.when(ok, F.concat(asked, F.lit(" = "), value)).otherwise(F.concat(F.lit(NO_RESULT), error)).alias("answer"),
            F.array().cast("array<string>").alias("citations"),
            F.col("kind").alias("route"),
            F.lit(0).alias("steps"),
            F.array(note, F.col("reason")).alias("trace"),
            one.cast("double").alias("support_rate"),
            one.alias("checked"),
            one.alias("supported"),
            F.array().cast("array<string>").alias("unsupported"),
        )
        return computed.unionByName(self._read(routed.where("kind = 'retrieve'").select("query_id", "text"), k))

    def invoke(self, tool: Column, payload: Column) -> Column:
        """(ok, value, error) of the engine's own tools, then of the built-in ones."""
        found = invoke(tool, payload)
        for name, fn in self.tools.items():
            found = F.when(tool == name, fn(payload)).otherwise(found)
        return found

    def _called(self, calls: DataFrame) -> DataFrame:
        """(query_id, ok, value, error) of calls (query_id, tool, payload); ``search`` looks for three chunks."""
        calls = self._steps.cut(calls)
        kinds = calls.agg(F.count_if(F.col("tool") == "search").alias("n"), F.count(F.lit(1)).alias("all")).first()
        out = calls.where("tool <> 'search'").select("query_id", self.invoke(F.col("tool"), F.col("payload")).alias("r")).select("query_id", "r.*")
        if not kinds.n:
            return out
        asked = calls.where("tool = 'search'").select("query_id", F.col("payload").alias("text"))
        hits = self.retrieve(asked, 3).join(asked.select("query_id", F.col("text").alias("question")), "query_id")
        line = F.concat(F.lit("["), F.col("chunk_id"), F.lit("] "), best_excerpt("question", "text", 160))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"])
        seen = asked.select("query_id").join(hits.groupBy("query_id").agg(F.concat_ws(" | ", lines).alias("value")), "query_id", "left")
        seen = seen.select("query_id", F.col("value").isNotNull().alias("ok"), F.coalesce("value", F.lit("")).alias("value"), F.lit(NO_MATCH).alias("error"))
        return seen if kinds.n == kinds["all"] else out.unionByName(seen)

    def _extractive(self, frontier: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
        """What the sentence reader says: its best sentence, or, where that is poor and nothing was searched yet, a search."""
        lines = F.filter(F.split("scratchpad", "\n"), lambda x: x.startswith("Observation:"))
        notes = F.flatten(F.transform(lines, lambda x: reader.observations(F.substring(x, 13, 1 << 30))))
        frontier = frontier.withColumn("notes", notes)
        excerpts = frontier.select("query_id", F.posexplode("notes").alias("at", "o"))
        # Behind the evidence, whose places end with k.
        excerpts = excerpts.select("query_id", (F.col("at") + k + 1).alias("place"), "o.chunk_id", F.col("o.excerpt").alias("text"))
        pool = evidence.join(frontier.select("query_id"), "query_id", "left_semi").unionByName(excerpts)
        best = self.read_with(frontier.select("query_id", "text"), pool)
        rows = frontier.join(best.select("query_id", "sentence", "chunk_id", "score"), "query_id", "left")
        enough = (F.coalesce("score", F.lit(0.0)) >= self.settings.min_overlap) | (F.size("notes") > 0)
        answer = F.concat(F.lit("Final Answer: "), reader.answer_text(F.col("sentence"), F.col("chunk_id")))
        search = F.concat(F.lit(SEARCH_THOUGHT + "\nAction: search["), "text", F.lit("]"))
        return rows.select("query_id", F.when(enough, answer).otherwise(search).alias("output"))

    def _read(self, queries: DataFrame, k: int | None) -> DataFrame:
        s = self.settings
        k = max(1, k or s.top_k)
        hits = self._steps.cut(self.retrieve(queries, k))
        evidence = hits.select("query_id", F.col("rank").alias("place"), "chunk_id", "text")

        def complete(frontier: DataFrame) -> DataFrame:
            if not self.complete_with:
                return self._extractive(frontier, evidence, k)
            blocks = reader.render_evidence(hits.select("query_id", "rank", "chunk_id", "text"))
            rows = frontier.join(blocks, "query_id", "left")
            return self.complete_with(rows.withColumn("prompt", reader.build_prompt(F.col("text"), F.col("block"), F.col("scratchpad"))))

        read = loop.run_loop(queries, complete, self._called, s.max_steps, self._steps.cut)
        top = hits.where("rank = 1").select("query_id", F.col("chunk_id").alias("head"), F.col("text").alias("head_text"))
        cited = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"]).alias("citations"))
        found = queries.join(read, "query_id").join(top, "query_id", "left").join(cited, "query_id", "left")
        answer = F.coalesce(F.when(F.col("final") != "", F.col("final")), reader.fallback(F.col("head"), F.col("head_text")))
        answers = self._steps.cut(found.select(
            "query_id",
            F.col("text").alias("question"),
            answer.alias("answer"),
            F.coalesce("citations", F.array().cast("array<string>")).alias("citations"),
            F.lit("retrieve").alias("route"),
            "steps",
            "trace",
        ))
        report = grounding.verify(answers.select("query_id", F.col("answer").alias("text")), hits.select("query_id", "text"), s.grounding_floor)
        return answers.join(report, "query_id")

    def stream(self, queries: DataFrame, width: int = 24) -> DataFrame:
        """(query_id, at, piece): answers in pieces of fixed width."""
        return self.ask(queries).select("query_id", F.posexplode(slices("answer", width)).alias("at", "piece"))

    # -- evaluation -----------------------------------------------------------------
    def evaluate_cases(self, cases: DataFrame, k: int | None = None, runner: Runner | None = None) -> DataFrame:
        """One row per case (query_id, question, relevant_docs, expected_route) with its metrics.

        ``runner`` answers the questions (query_id, text) in the place of ``ask``. Cases are
        answered together; ``latency_ms`` is what the runner gives, or each one's share of
        the time that took.
        """
        s = self.settings
        k = k or s.top_k
        queries = cases.select("query_id", F.col("question").alias("text"))
        docs = cases.select("query_id", F.explode("relevant_docs").alias("doc_id"))
        relevant = docs.join(self.chunks.select("doc_id", F.col("chunk_id").alias("id")), "doc_id").select("query_id", "id")
        began = time.monotonic()
        answers = self._steps.cut((runner or self.ask)(queries))
        spent = F.lit((time.monotonic() - began) * 1000 / max(1, answers.count()))
        spent = F.col("latency_ms") if "latency_ms" in answers.columns else spent
        hits = answers.select("query_id", F.posexplode("citations").alias("at", "id"))
        hits = hits.select("query_id", "id", (F.col("at") + 1).alias("rank")).join(self.chunks.select("doc_id", F.col("chunk_id").alias("id")), "id")
        return (
            cases.select("query_id", "expected_route", (F.coalesce(F.size("relevant_docs"), F.lit(0)) > 0).alias("has_docs"))
            .join(evaluate.ranking_metrics(hits, relevant, queries, k), "query_id")
            .join(evaluate.document_metrics(hits, docs, queries, k), "query_id")
            .join(answers.select("query_id", "route", F.col("support_rate").alias("grounded"), spent.alias("latency_ms")), "query_id")
        )

    def evaluate(self, cases: DataFrame, k: int | None = None, runner: Runner | None = None) -> dict:
        return evaluate.report(self.evaluate_cases(cases, k, runner)).first().asDict()

    # -- probes ------------------------------------------------------------------------
    def guard_probe(self) -> dict:
        """Five hits under a reranker that turns them round: the guard keeps the first, the naive order doesn't."""
        rows, scores = probe_rows(self.spark)
        guarded = rerank.guarded_rerank(rows, scores, self.settings.guard_alpha, self.settings.spearman_floor).where("final_pos = 1").first()
        naive = rerank.naive_rerank(rows, scores).where("final_pos = 1").first()
        return {
            "guarded_top1": guarded.chunk_id,
            "naive_top1": naive.chunk_id,
            "guard_applied": guarded.applied,
            "spearman": guarded.spearman,
            "guarded_preserves_top1": guarded.chunk_id == "probe#0",
            "naive_breaks_top1": naive.chunk_id != "probe#0",
        }

    def deterministic_probe(self) -> dict:
        samples = PROBES
        rows = self.spark.createDataFrame([(str(i), q) for i, q in enumerate(samples)], "query_id string, text string")
        found = rows.select(route(F.col("text")).alias("r")).select("r.*", invoke(F.col("r.tool"), F.col("r.payload"))["ok"].alias("ok"))
        right = found.where("kind = 'arithmetic' AND ok").count()
        return {"samples": len(samples), "right": right, "passed": right == len(samples)}

    def selfcheck(self) -> dict:
        """Whether both indexes hold what the corpus says, and both probes pass."""
        chunks = self.chunks.count()
        indexed = self.vectors.select("chunk_id").distinct().count()
        wordy = sparse.tokens(self.chunks).where(F.size("tokens") > 0).count()
        held = self.postings.agg(F.count_distinct("chunk_id")).first()[0]
        checks = {
            "dense_index": indexed == wordy,
            "sparse_index": self.lengths.count() == chunks and held == wordy,
            "guard": self.guard_probe()["guarded_preserves_top1"],
            "deterministic": self.deterministic_probe()["passed"],
        }
        return checks | {"passed": all(checks.values())}


def probe_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Five hits in order, and the scores of a reranker that turns them round."""
    rows = spark.range(5).select(
        F.lit("probe").alias("query_id"),
        F.format_string("probe#%d", "id").alias("chunk_id"),
        (10.0 - F.col("id")).alias("score"),
        F.create_map(F.lit("dense"), (F.col("id") + 1).cast("int")).alias("ranks"),
        F.array(F.lit("dense")).alias("sources"),
        (F.col("id") + 1).cast("int").alias("pos"),
    )
    return rows, rows.select("query_id", "pos", F.col("pos").cast("double").alias("rerank_score"))


def validate(queries: DataFrame, longest: int = 4000) -> DataFrame:
    """``queries`` with ``valid``: a text of 1 to ``longest`` characters."""
    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    return queries.withColumn("valid", (n >= 1) & (n <= longest))


