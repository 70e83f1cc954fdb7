import pytest

from gristmill.plans.engine import Engine, validate


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.ingest(
        {
            "cpu": "The engine fixes four threads on every machine! Small models gain nothing from more threads.",
            "cats": "# Cats\nCats sleep most of the day; dogs bark at night.\n\nKittens drink milk!",
            "blank": "  \n ",
        }
    )
    return e


def ask(spark, engine, *questions):
    rows = spark.createDataFrame([(str(i), q) for i, q in enumerate(questions)], "query_id string, text string")
    return {int(r.query_id): r for r in engine.ask(rows).collect()}


def test_answers(spark, engine):
    got = ask(spark, engine, "how many threads does the engine fix", "12*(3+4)", "1/0", "1500 m to km", "zzz qqq")
    assert got[0].answer.endswith("(依据：cpu#0)") and got[0].steps == 1 and got[0].citations[0] == "cpu#0" and got[0].support_rate == 1.0
    assert got[1].answer == "12*(3+4) = 84" and got[1].route == "arithmetic" and got[1].steps == 0
    assert got[2].answer == "无法计算结果：division by zero" and got[2].support_rate == 0.0
    assert got[3].answer == "1500 m to km = 1.5 km"
    assert got[4].route == "retrieve" and got[4].steps in (2, 6)


def test_stats_and_probes(engine):
    assert engine.stats()["documents"] == 2
    assert engine.selfcheck()["passed"]
    probe = engine.guard_probe()
    assert probe["guarded_top1"] == "probe#0" and probe["naive_top1"] == "probe#4" and probe["spearman"] == -1.0


def test_empty_corpus_and_reingest(spark):
    e = Engine(spark)
    got = ask(spark, e, "anything at all")
    assert got[0].answer == "证据不足，无法回答该问题。" and got[0].steps == 6 and got[0].trace[-1] == "step budget of 6 exhausted"
    e.ingest({"a": "old words here", "b": "other"})
    e.ingest({"a": "new words here"})
    assert {r.doc_id: r.text for r in e.documents.collect()} == {"a": "new words here", "b": "other"}
    e.ingest({"c": "alone"}, replace=True)
    assert [r.doc_id for r in e.documents.collect()] == ["c"]


def test_validate(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None), ("d", "y" * 4001)], "query_id string, text string")
    assert [r.valid for r in validate(rows).orderBy("query_id").collect()] == [True, False, False, False]


def test_streams(spark, tmp_path):
    from gristmill.streaming import continuous_ingest, conversation_memory

    e = Engine(spark)
    spark.createDataFrame([("a", "first text"), ("b", "second text")], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in"))
    continuous_ingest(stream, e, str(tmp_path / "ck")).awaitTermination(120)
    assert e.documents.count() == 2
    turns = spark.createDataFrame([(1, i, "user", f"turn {i} " + "word " * 20) for i in range(10)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "turns"))
    memory = conversation_memory(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")), 60)
    q = memory.writeStream.format("memory").queryName("mem").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    row = spark.sql("SELECT * FROM mem").first()
    assert row.evicted > 0 and row.kept + row.evicted == 10


def test_only_changes_are_indexed_and_the_last_revision_counts(spark):
    e, whole = Engine(spark), Engine(spark)
    e.ingest({f"d{i}": f"text number {i} about threads and cats" for i in range(8)})
    rows = [("d1", "old", 1), ("d1", "newest words", 3), ("d1", "older", 2), ("d9", "nine", 1), ("d2", " ", 9)]
    e.ingest(spark.createDataFrame(rows, "doc_id string, text string, revision int"))
    e.ingest(spark.createDataFrame([("d3", "first"), ("d3", "second")], "doc_id string, text string").coalesce(1))
    texts = {r.doc_id: r.text for r in e.documents.collect()}
    assert texts["d1"] == "newest words" and texts["d3"] == "second" and len(texts) == 9 and e.selfcheck()["passed"]
    whole.ingest(texts)
    for name in ("chunks", "lengths", "postings"):
        a, b = (sorted(map(str, getattr(x, name).collect())) for x in (e, whole))
        assert a == b
    vectors = lambda x: {r.chunk_id: sorted(zip(r.slots, r.weights, strict=True)) for r in x.vectors.collect()}
    assert vectors(e).keys() == vectors(whole).keys()
    q = spark.createDataFrame([("q", "newest words about cats")], "query_id string, text string")
    assert [r.chunk_id for r in e.retrieve(q).orderBy("rank").collect()] == [r.chunk_id for r in whole.retrieve(q).orderBy("rank").collect()]


def test_slots_and_tools(spark, tmp_path):
    from pyspark.sql import functions as F

    from gristmill.sources.corpus import read_chunks, write_chunks

    def by_length(texts, key):
        return texts.select(key, F.pmod(F.length("text"), F.lit(7)).cast("int").alias("slot"), F.lit(1.0).alias("weight"))

    def first_of_pool(queries, pool):
        best = pool.groupBy("query_id").agg(F.min_by(F.struct("chunk_id", "text"), "place").alias("b"))
        return best.select("query_id", F.col("b.text").alias("sentence"), F.col("b.chunk_id").alias("chunk_id"), F.lit(1.0).alias("score"))

    def shout(payload):
        return F.struct(F.lit(True).alias("ok"), F.upper(payload).alias("value"), F.lit("").alias("error"))

    e = Engine(spark, embed_with=by_length, read_with=first_of_pool, tools={"calculator": shout})
    e.ingest({"a": "alpha beta gamma", "b": "delta epsilon"})
    got = ask(spark, e, "delta", "1+1")
    assert "delta epsilon" in got[0].answer and got[1].answer == "1+1 = 1+1"
    write_chunks(e.chunks.drop("start", "end"), str(tmp_path / "chunks"))
    other = Engine(spark)
    assert other.ingest_chunks(read_chunks(spark, str(tmp_path / "chunks")))["documents"] == 2
    assert "delta" in ask(spark, other, "what is delta epsilon")[0].answer


def test_latency_is_measured(spark, engine):
    cases = spark.createDataFrame([("q1", "how many threads", ["cpu"], "retrieve")], "query_id string, question string, relevant_docs array<string>, expected_route string")
    assert engine.evaluate(cases)["latency_p50"] > 0


def test_memory_over_many_frames(spark, tmp_path):
    from gristmill.operators.memory import compact
    from gristmill.streaming import conversation_memory

    turns = spark.createDataFrame([(1, (i * 7919) % 500, "user", f"turn {(i * 7919) % 500} of many") for i in range(500)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "turns"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        memory = conversation_memory(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")), 60)
        q = memory.writeStream.format("memory").queryName("frames").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    row, want = spark.sql("SELECT * FROM frames").first(), compact(turns, 60).first()
    assert (row.kept, row.evicted, row.tokens, row.summary) == (want.kept, want.evicted, want.tokens, want.summary)
