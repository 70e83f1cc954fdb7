import math

import pytest
from pyspark.sql import functions as F

from gristmill.operators import dense, evaluate, expansion, fusion, grounding, memory, rerank, sparse
from gristmill.plans.oracles import EXPANSION_QUESTIONS

DOCS = [("d1", "线程数固定在多少才合适 threads"), ("d2", "the cat sat on the mat"), ("d3", "cat and dog"), ("d4", "")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_against_plain_python(spark):
    from gristmill.functions.text import tokenize

    chunks = frame(spark, DOCS, "chunk_id string, text string")
    queries = frame(spark, [("q1", "the the cat"), ("q2", "线程数"), ("q3", "zebra")], "query_id string, text string")
    tokens = lambda df, k: {r[k]: r.t for r in df.select(k, tokenize("text").alias("t")).collect()}
    docs, asked = tokens(chunks, "chunk_id"), tokens(queries, "query_id")
    n, avg = len(docs), sum(max(1, len(t)) for t in docs.values()) / len(docs)
    expected = {}
    for q, terms in asked.items():
        for d, t in docs.items():
            score = 0.0
            for term in terms:
                df = sum(term in x for x in docs.values())
                tf = t.count(term)
                if tf:
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(1, len(t)) / avg))
            if score:
                expected[q, d] = score
    got = {(r.query_id, r.chunk_id): r.score for r in sparse.search(chunks, queries, 10).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items())
    stats = sparse.corpus_stats(chunks.limit(0)).first()
    assert (stats.n_docs, stats.avgdl) == (0, 1.0)


def test_hashed_vectors_are_unit(spark):
    chunks = frame(spark, DOCS, "chunk_id string, text string")
    rows = dense.hashed_vectors(chunks, "chunk_id").groupBy("chunk_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r.chunk_id for r in rows} == {"d1", "d2", "d3"} and all(abs(r.n - 1) < 1e-9 for r in rows)
    with pytest.raises(ValueError):
        dense.hashed_vectors(chunks, "chunk_id", 4)
    found = dense.search(dense.hashed_vectors(chunks, "chunk_id"), dense.hashed_vectors(chunks.withColumnRenamed("chunk_id", "query_id"), "query_id"), 1)
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == {(d, d) for d in ("d1", "d2", "d3")}


def test_cosine_edges(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    row = spark.range(1).select(dense.cosine(a(1, 0), a(1, 0, 0)).alias("x"), dense.cosine(a(0, 0), a(1, 0)).alias("y"), dense.cosine(a(2, 0), a(3, 0)).alias("z")).first()
    assert tuple(row) == (0.0, 0.0, 1.0)


def ranked(spark, ids):
    return frame(spark, [("q", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int")


def test_fusion(spark):
    lists = [("dense", ranked(spark, "abc")), ("sparse", ranked(spark, "bca"))]
    top = fusion.reciprocal_rank_fusion(lists).where("pos = 1").first()
    assert top.chunk_id == "b" and top.ranks == {"dense": 2, "sparse": 1} and top.sources == ["dense", "sparse"]
    assert fusion.reciprocal_rank_fusion(lists, weights={"dense": 5.0, "sparse": 0.1}).where("pos = 1").first().chunk_id == "a"
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(lists, k=0)


def guard(spark, scores, **how):
    n = len(scores) if scores else 6
    rows = frame(spark, [("q", f"c{i}", 10.0 - i, {"dense": i + 1}, ["dense"], i + 1) for i in range(n)], "query_id string, chunk_id string, score double, ranks map<string,int>, sources array<string>, pos int")
    given = frame(spark, [("q", i + 1, float(s)) for i, s in enumerate(scores)], "query_id string, pos int, rerank_score double") if scores else None
    return rerank.guarded_rerank(rows, given, **how).orderBy("final_pos").collect()


def test_guard(spark):
    back = guard(spark, [1, 2, 3, 4, 5])
    assert [r.chunk_id for r in back] == ["c0", "c1", "c2", "c3", "c4"] and not back[0].applied and back[0].spearman == -1
    assert guard(spark, [9, 8, 7, 6])[0].alpha_eff == 0.5
    weak = guard(spark, [5, 4, 1, 2, 6, 3])
    assert round(weak[0].spearman, 4) == 0.0857 and weak[0].alpha_eff == 0.25
    flat = guard(spark, [1, 1, 1, 1])
    assert flat[0].spearman == 0 and flat[0].alpha_eff == 0.25 and [r.pos for r in flat] == [1, 2, 3, 4]
    assert [r.pos for r in guard(spark, None)] == [1, 2, 3, 4, 5, 6]
    assert not guard(spark, [1, 2, 3], enabled=False)[0].applied


def test_lexical_rerank_scores_ten_of_twelve(spark):
    candidates = frame(spark, [("q", i, "cat " * (i % 3) + "dog") for i in range(1, 13)], "query_id string, pos int, text string")
    queries = frame(spark, [("q", "cat cat")], "query_id string, text string")
    rows = rerank.lexical_rerank(queries, candidates).collect()
    assert len(rows) == 10 and {1, 2, 4, 5, 7, 8, 10, 11} <= {r.pos for r in rows}


def test_expansion(spark):
    df = frame(spark, [(q,) for q in EXPANSION_QUESTIONS] + [("",)], "q string")
    rows = df.select(expansion.expand(F.col("q")).alias("e"), expansion.expand(F.col("q"), 3)["terms"].alias("three")).collect()
    assert "线程数" in rows[0].e.matched and "thread" not in rows[1].e.terms and rows[2].e.query == "nothing here"
    assert len(rows[3].three) == 3 and rows[4].e.query == ""


def test_grounding(spark):
    evidence = frame(spark, [("a", "The engine fixes four threads. Small models gain nothing from more."), ("b", "The engine fixes four threads")], "query_id string, text string")
    answers = frame(spark, [("a", "The engine fixes four threads。(依据：cpu#3)"), ("b", "The engine fixes four threads！Bananas grow purple wings nightly！"), ("c", "证据不足，无法回答该问题。"), ("d", ""), ("e", "Something quite unsupported here")], "query_id string, text string")
    got = {r.query_id: (r.support_rate, r.checked) for r in grounding.verify(answers, evidence, 0.2).collect()}
    assert got == {"a": (1.0, 1), "b": (0.5, 2), "c": (1.0, 0), "d": (1.0, 0), "e": (0.0, 1)}


def test_memory(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"message number {i} with some words in it") for i in range(16)]
    df = frame(spark, turns, "conv_id long, turn long, role string, text string")
    small, large = memory.compact(df, 60).first(), memory.compact(df, 10_000).first()
    assert small.evicted > 0 and small.summary and small.tokens <= 100 and small.kept + small.evicted == 16
    assert large.evicted == 0 and large.summary == ""
    assert memory.compact(df, 60, lambda texts: "SUMMARY").first().summary == "SUMMARY"
    assert memory.context(memory.compact(df, 60), df).count() == small.kept + 1
    items = frame(spark, [("x", "blue whale song"), ("y", "red fish")], "key string, text string")
    got = memory.recall(items, frame(spark, [("q", "whale")], "query_id string, text string")).collect()
    assert [r.chunk_id for r in got] == ["x"]


def test_metrics(spark):
    queries = frame(spark, [("q1",), ("q2",), ("q3",)], "query_id string")
    relevant = frame(spark, [("q1", "d1#0"), ("q1", "d1#1"), ("q2", "d2#5")], "query_id string, id string")
    hits = frame(spark, [("q1", "d1#0", 1), ("q1", "z#0", 2), ("q2", "z#0", 1), ("q2", "d2#5", 2)], "query_id string, id string, rank int")
    got = {r.query_id: r for r in evaluate.ranking_metrics(hits, relevant, queries).collect()}
    assert (got["q1"].recall, got["q1"].precision, got["q1"].reciprocal_rank) == (0.5, 0.5, 1.0)
    assert (got["q2"].recall, got["q2"].reciprocal_rank) == (1.0, 0.5)
    assert abs(got["q2"].ndcg - 1 / math.log2(3)) < 1e-12 and got["q3"].recall == 1.0 and got["q3"].ndcg == 0
    samples = frame(spark, [("k", i, float(i)) for i in range(600)], "key string, seq long, ms double")
    row = evaluate.latency_summary(samples).first()
    assert (row.n, row.max, row.p50) == (512, 599.0, 343.5)


def test_recall_sends_no_pairs_of_words_and_copies_count_once(spark):
    """Many copies of few texts, more queries than one block: nothing but a query's best of each task is shuffled."""
    items = spark.range(3_000).select(F.col("id").cast("string").alias("key"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 5), F.lit("common")).alias("text"))
    asked = items.where("key % 2 = 0").withColumnRenamed("key", "query_id").unionByName(frame(spark, [("none", ""), ("far", "unheard")], "query_id string, text string"))
    out = memory.recall(items, asked, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
    assert len(got) == 1_500
    for q in ("0", "34", "2998"):
        same = sorted(str(i) for i in range(3_000) if i % 35 == int(q) % 35)[:3]
        assert [c for _, c, _ in sorted(got[q])] == same and all(s == 1.0 for *_, s in got[q])
    grid = dense.search(dense.memory_units(items, "key").withColumnRenamed("key", "chunk_id"), dense.memory_units(asked, "query_id"), 3, most_sent=0)
    assert {tuple(r) for r in grid.collect()} == {(q, c, s, n) for q, rows in got.items() for n, c, s in rows}


def test_tokens_that_cancel_have_a_unit_vector_too(spark):
    seen, pair = {}, None
    for i in range(5_000):
        h = dense.stable_hash(f"w{i}")
        other = seen.setdefault((h % 512, h >> 20 & 1), f"w{i}") and seen.get((h % 512, 1 - (h >> 20 & 1)))
        pair = pair or other and (other, f"w{i}")
    rows = frame(spark, [("a", " ".join(pair)), ("b", "one two"), ("c", ""), ("d", None)], "id string, text string")
    got = {r.id: sum(w * w for w in r.weights) for r in dense.hashed(rows, "id").collect()}
    assert abs(got["a"] - 1) < 1e-9 and abs(got["b"] - 1) < 1e-9 and got["c"] == got["d"] == 0
