"""Segments, the inverted file, block-max search, the grid and the reading loop against plain ways."""

import os

import numpy as np
from pyspark.sql import functions as F

from gristmill.operators import blockmax, dense, ivf, loop, sparse
from gristmill.operators.grid import best
from gristmill.plans.engine import Engine
from gristmill.plans.steps import Steps


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def found(engine, spark, text):
    q = spark.createDataFrame([("q", text)], "query_id string, text string")
    return [(r.chunk_id, r.score) for r in engine.retrieve(q).orderBy("rank").collect()]


def test_an_upsert_writes_its_own_segment_only(spark):
    e = Engine(spark)
    e.ingest({f"d{i}": f"text {i} about threads, cats and engines number {i * 7}. " + "More words follow here. " * 40 for i in range(60)})
    root = e._store.steps.root
    before = {t: sorted(os.listdir(f"{root}/{t}/segment=0")) for t in ("postings", "vectors", "chunks")}
    whole = size_of(root)
    stats = e.ingest({"d1": "fresh words of one", "d2": "fresh words of two", "new": "brand new words"})
    assert stats["documents"] == 61 and size_of(root) - whole < 20_000
    assert before == {t: sorted(os.listdir(f"{root}/{t}/segment=0")) for t in before}
    texts = {r.doc_id: r.text for r in e.documents.collect()}
    other = Engine(spark)
    other.ingest(texts)
    assert e.stats() == other.stats() and e.corpus_stats.collect() == other.corpus_stats.collect()
    assert found(e, spark, "fresh words about cats") == found(other, spark, "fresh words about cats")
    e.ingest({"d1": "third text of one"})
    e.compact()
    assert e._store.last == 0 and e.stats()["documents"] == 61 and e.selfcheck()["passed"]
    assert [c for c, _ in found(e, spark, "third text")][:1] == ["d1#0"]


def test_many_segments_are_merged(spark):
    e = Engine(spark, most_segments=3)
    for i in range(4):
        e.ingest({"a": f"version {i}", f"b{i}": "other"})
    assert e._store.last < 3 and {r.doc_id: r.text for r in e.documents.collect()}["a"] == "version 3" and e.stats()["documents"] == 5


def test_a_half_written_segment_counts_for_nothing(spark):
    e = Engine(spark)
    e.ingest({"a": "one text"})
    e._store.write("chunks", e.chunks.withColumn("text", F.lit("lost")))
    assert [r.text for r in e.chunks.collect()] == ["one text"]
    e.ingest({"b": "another"})
    assert sorted(r.text for r in e.chunks.collect()) == ["another", "one text"]


def plain_nearest(x, asked, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u[asked] @ u.T, 9)
    ids = np.array([str(i) for i in range(len(x))])
    out = set()
    for i, row in zip(asked, s, strict=True):
        order = sorted(range(len(x)), key=lambda j: (-row[j], ids[j]))[:k]
        out |= {(str(i), str(j)) for j in order if row[j] > 0}
    return out


def test_inverted_file(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 6))
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)] + [("none", None), ("empty", [])], "id string, v array<double>")
    vectors = ivf.from_arrays(rows, "id", "v", "chunk_id")
    asked = list(range(0, 900, 30))
    queries = ivf.from_arrays(rows.where(F.col("id").isin([str(i) for i in asked])), "id", "v", "query_id")
    index = ivf.InvertedFile(cells=12, sample=500)
    q = index.train(vectors)
    path = str(tmp_path / "cells")
    ivf.write(ivf.assigned(vectors, q), path)
    filed = spark.read.parquet(path)
    held = ivf.radii(filed)
    want = plain_nearest(x, asked, 5)
    ids = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact = ids(ivf.search(filed, q, held, queries, 5, True, 9))
    assert exact == want
    assert len(ids(ivf.search(filed, q, held, queries, 5, False, 9)) & want) >= 0.9 * len(want) and q.probes < 12
    few = queries.where("query_id = '0'")
    visits = ivf._visits(few, q, held, False)
    plan = filed.where(F.col("cell").isin([r.cell for r in visits.collect()]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    # A query that finds fewer than k in the probed cells goes on to all.
    assert len(ids(ivf.search(filed, q, held, few, 400, False, 9))) == len(plain_nearest(x, [0], 400))


def test_engine_with_an_inverted_file(spark):
    texts = {f"d{i}": f"{w} {w} text number {i}" for i, w in enumerate(["cats", "dogs", "threads", "engines", "clouds"] * 8)}
    a, b = Engine(spark, index=ivf.InvertedFile(cells=4, exact=True)), Engine(spark)
    for e in (a, b):
        e.ingest(texts)
        e.ingest({"d3": "cats and engines", "more": "threads of clouds"})
    assert found(a, spark, "cats on clouds") == found(b, spark, "cats on clouds")
    assert len(a._store.radii) > 1


def test_block_max_opens_fewer_postings(spark):
    rng = np.random.default_rng(5)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 40_000) % 3000]
    rows = spark.createDataFrame([(f"c{i:04}", " ".join(words[i * 20 : i * 20 + 20])) for i in range(2000)], "chunk_id string, text string")
    queries = spark.createDataFrame([(str(i), f"w1 w2 w{i + 40} w{i * 13 + 200}") for i in range(12)], "query_id string, text string")
    cut = Steps(spark).cut
    kept = cut(sparse.tokens(rows))
    stats = sparse.corpus_stats(kept)
    index = cut(blockmax.blocks(sparse.postings(kept), 2000, 8))
    q = sparse.query_terms(queries)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    assert key(blockmax.search(index, stats, q, 5, cut=cut)) == key(sparse.search(rows, queries, 5))
    terms, buckets = blockmax.needed(index, stats, q, 5, cut=cut)
    opened = terms.join(buckets, "query_id").join(index, ["term", "bucket"]).agg(F.sum("n")).first()[0]
    every = terms.join(index, "term").agg(F.sum("n")).first()[0]
    assert opened < 0.6 * every


def test_best_takes_the_first_of_ties():
    s = np.array([[1.0, 3, 3, 3], [0, 0, 0, 0], [5, 4, 3, 2]])
    i, j = best(s, 2, s > 0)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (0, 2), (2, 0), (2, 1)]
    assert len(best(np.empty((0, 3)), 2)[0]) == 0 and best(s, 9)[0].tolist() == [0] * 4 + [1] * 4 + [2] * 4


def test_many_queries_are_one_plan(spark):
    v = spark.range(300).select(F.col("id").cast("string").alias("chunk_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vec"))
    q = spark.range(100_000).select(F.col("id").cast("string").alias("query_id"), F.array(F.lit(1.0), (F.col("id") % 300).cast("double")).alias("vec"))
    out = dense.knn(v, q, 1)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_reader_that_needs_four_rounds(spark):
    asked = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three"), ("d", "four")], "query_id string, text string")

    def complete(frontier):
        say = F.when(F.col("query_id") == "c", "Action: broken").when(F.col("query_id") == "d", "Action: nothing[x]")
        say = say.when(F.col("step") == 4, F.concat(F.lit("Final Answer: "), F.size(F.split("scratchpad", "Observation:")).cast("string")))
        return frontier.select("query_id", say.otherwise(F.lit("Thought: t\nAction: echo[hi [there]]")).alias("output")).where("query_id <> 'b' OR step < 3")

    def invoke(calls):
        return calls.where("tool = 'echo'").select("query_id", F.lit(True).alias("ok"), F.col("payload").alias("value"), F.lit("").alias("error"))

    got = {r.query_id: r for r in loop.run_loop(asked, complete, invoke, 5, Steps(spark).cut).collect()}
    assert (got["a"].final, got["a"].steps) == ("4", 4) and got["a"].trace == [f"step {i}: echo[hi [there]] -> hi [there]" for i in (1, 2, 3)]
    assert (got["b"].final, got["b"].steps, got["b"].trace[-1]) == (None, 3, "step 3: unparsable model output, stopping")
    assert (got["c"].final, got["c"].steps) == (None, 1)
    assert got["d"].steps == 5 and got["d"].trace[-1] == "step budget of 5 exhausted" and got["d"].trace[0] == "step 1: nothing[x] -> ERROR: unknown tool: nothing"


def test_engine_with_a_completer(spark):
    def complete(frontier):
        said = F.when(F.col("scratchpad") == "", F.lit("Thought: look\nAction: search[cats]")).otherwise(F.concat(F.lit("Final Answer: "), F.size(F.split("prompt", "\n")).cast("string")))
        return frontier.select("query_id", said.alias("output"))

    e = Engine(spark, complete_with=complete)
    e.ingest({"cats": "Cats sleep most of the day.", "dogs": "Dogs bark."})
    row = e.ask(spark.createDataFrame([("1", "what do they do")], "query_id string, text string")).first()
    assert row.steps == 2 and row.answer.isdigit() and row.trace[0].startswith("step 1: search[cats] -> [cats#0] Cats sleep")


def test_the_driver_holds_centroids_only(spark):
    import tracemalloc

    v = spark.range(6_000).select(F.col("id").cast("string").alias("chunk_id"), F.sequence(F.lit(0), F.lit(31)).alias("slots"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.rand(5) + i).alias("weights"))
    tracemalloc.start()
    q = ivf.InvertedFile(cells=8, sample=5_000).train(v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert q.centroids.shape == (8, 32) and q.probes >= 1 and np.allclose(np.linalg.norm(q.centroids, axis=1), 1)
    assert peak < 3 << 20  # the sample alone has 1.3 MB as plain numbers, several times that as rows
    none = ivf.InvertedFile().train(v.limit(0))
    assert none.centroids.shape == (1, 1) and none.probes == 1


def test_blocks_are_made_where_chunks_lie(spark):
    rows = spark.range(900).select(F.col("id").cast("string").alias("chunk_id"), F.concat_ws(" ", F.lit("common common"), F.concat(F.lit("w"), F.col("id") % 11), F.concat(F.lit("r"), F.floor(F.col("id") / 7))).alias("text"))
    queries = spark.createDataFrame([(str(i), f"common w{i} r{i * 3} none") for i in range(12)], "query_id string, text string")
    made = blockmax.index(rows, 8)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    cut = Steps(spark).cut
    stats, q = sparse.corpus_stats(rows), sparse.query_terms(queries)
    key = lambda df: {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in df.collect()}
    assert key(blockmax.search(cut(made), stats, q, 5, cut=cut)) == key(sparse.search(rows, queries, 5))


def built_sides(df):
    """Names of the columns of each side that a plan sends out through the driver."""
    found, open_ = [], [df._jdf.queryExecution().sparkPlan()]
    while open_:
        node = open_.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        open_ += below
        if node.nodeName().startswith("Broadcast"):
            side = below["BuildRight" in node.buildSide().toString()].output()
            found.append({side.apply(i).name() for i in range(side.size())})
    return found


def test_no_vectors_are_sent_out_through_the_driver(spark, tmp_path):
    x = np.random.default_rng(11).normal(size=(1_500, 16))
    x[300:600] = x[7]  # equal rows make small files
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, v array<double>")
    vectors = ivf.from_arrays(rows, "id", "v", "chunk_id")
    asked = list(range(0, 1_500, 10))
    queries = ivf.from_arrays(rows.where(F.col("id").cast("int") % 10 == 0), "id", "v", "query_id")
    index = ivf.InvertedFile(cells=30, sample=400)
    q = index.train(vectors)
    ivf.write(ivf.assigned(vectors, q), str(tmp_path / "cells"))
    filed, steps, plans = spark.read.parquet(str(tmp_path / "cells")), Steps(spark), []

    def cut(df):
        plans.append(df)
        return steps.cut(df)

    for exact in (True, False):
        out = ivf.search(filed, q, ivf.radii(filed), queries, 5, exact, 9, cut)
        plans.append(out)
        got = [(r.query_id, r.chunk_id) for r in out.collect()]
        want = plain_nearest(x, asked, 5)
        assert len(got) == len(set(got)) == len(want) and len(set(got) & want) >= (1 if exact else 0.8) * len(want)
    sent = [side for df in plans for side in built_sides(df)]
    assert sent and not [s for s in sent if s & {"slots", "weights", "point_rows", "query_rows"}]
    # A query's vector stands in one row, however many cells it visits.
    assert ivf._visited(queries, q, ivf.radii(filed), False).count() == len(asked)


def test_one_task_sorts_the_sample_only(spark):
    v = spark.range(4_000).select(F.col("id").cast("string").alias("chunk_id"), F.sequence(F.lit(0), F.lit(7)).alias("slots"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("weights"))
    index = ivf.InvertedFile(cells=5, sample=300)
    least = v.orderBy(F.xxhash64(F.lit(index.seed), "chunk_id"), "chunk_id").limit(300).collect()
    assert np.allclose(index.train(v).centroids, ivf._means(dense.unit(np.array([r.weights for r in least])), 5, index.rounds, index.seed))


def test_recall_makes_one_index(spark, tmp_path, monkeypatch):
    from gristmill.plans import catalog

    x = np.random.default_rng(13).normal(size=(1_000, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    trained, train = [], ivf.InvertedFile.train
    monkeypatch.setattr(ivf.InvertedFile, "train", lambda self, *a, **b: trained.append(train(self, *a, **b)) or trained[-1])
    out = catalog.queries()["ivf_recall"](spark, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [(20, True)] and len(trained) == 1
    assert not built_sides(out)
