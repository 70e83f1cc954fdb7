"""Thesaurus tables, settings in one plan, telemetry, runners and the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gristmill import __main__ as cli
from gristmill.operators import evaluate, expansion, sparse, sweep, thesaurus
from gristmill.functions.fixed import THESAURUS
from gristmill.plans.engine import Engine
from gristmill.telemetry import Timings, log_event


def test_automaton_finds_what_contains_finds():
    rng = random.Random(1)
    for _ in range(60):
        keys = sorted({"".join(rng.choice("ab猫") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 30))})
        a = thesaurus.Automaton(keys)
        for _ in range(20):
            text = "".join(rng.choice("abc猫") for _ in range(rng.randint(0, 30)))
            assert a.found(text) == {i for i, k in enumerate(keys) if k in text}


@pytest.mark.parametrize("most_sent", [1 << 20, 0])
def test_table_and_expression_agree(spark, most_sent):
    table = spark.createDataFrame([(k, v) for k, v in THESAURUS.items()] + [("", ["none"]), (None, ["none"])], "key string, terms array<string>")
    keys = sorted(THESAURUS, key=lambda k: (-len(k), k))
    rng = random.Random(2)
    rows = [(str(i), "".join(rng.sample(keys, rng.randint(0, 9))) + " threads Index") for i in range(80)] + [("null", None), ("empty", "")]
    df = spark.createDataFrame(rows, "query_id string, text string")
    got = {r.query_id: (r.query, r.terms, r.matched) for r in thesaurus.expand_by_table(df, table, most_sent=most_sent).collect()}
    ordered = {k: THESAURUS[k] for k in keys}
    want = {r.query_id: tuple(r.e) for r in df.select("query_id", expansion.expand(F.col("text"), 12, ordered).alias("e")).collect()}
    assert got == want and max(len(t) for _, t, _ in got.values()) == 12


@pytest.mark.parametrize("most_sent", [1 << 20, 0])
def test_table_of_odd_keys(spark, most_sent):
    """Keys with white space, terms of null, none or twice, and lower-casing as Spark has it."""
    table = [("new york", ["NYC", None, "nyc"]), ("york", None), ("ab", []), ("b\u3000c", ["wide"]), ("ork", ["İx", "NYC"])]
    table = spark.createDataFrame(table, "key string, terms array<string>")
    df = spark.createDataFrame([("1", "in new york ab"), ("2", "new\nyork İX"), ("3", "b\u3000c b c"), ("4", "zab NYC york")], "query_id string, text string")
    got = {r.query_id: (r.terms, r.matched) for r in thesaurus.expand_by_table(df, table, most_sent=most_sent).collect()}
    assert got == {"1": (["NYC", "nyc", "İx"], ["new york", "york", "ork", "ab"]), "2": (["NYC"], ["york", "ork"]), "3": (["wide"], ["b\u3000c"]), "4": (["İx"], ["york", "ork", "ab"])}


def test_terms_are_taken_in_the_row(spark, capsys):
    """A text is not copied to its terms' rows, nor shuffled."""
    table = spark.createDataFrame([(f"k{i}", [f"t{i}", f"u{i}"]) for i in range(9)], "key string, terms array<string>")
    df = spark.createDataFrame([(str(i), f"k1 k2 k{i} " * 9) for i in range(9)], "query_id string, text string")
    thesaurus.expand_by_table(df, table).explain()
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Exchange", "Window", "Join", "Generate"))


def test_keys_word_by_word():
    rng = random.Random(3)
    for _ in range(40):
        keys = sorted({"".join(rng.choice("ab \u3000") for _ in range(rng.randint(1, 4))) for _ in range(12)})
        finder = thesaurus.Keys(keys, most=3, longest=3)
        for _ in range(20):
            text = "".join(rng.choice("abc \n\u3000") for _ in range(rng.randint(0, 30)))
            assert finder.found(text) == {i for i, k in enumerate(keys) if k in text}


def test_settings_in_one_plan(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"w{i % 7} w{i % 5} " * (1 + i % 4) + f"w{i % 3}") for i in range(80)], "chunk_id string, text string")
    queries = spark.createDataFrame([("1", "w1 w2 w4"), ("2", "w6 w3"), ("3", "none")], "query_id string, text string")
    relevant = spark.createDataFrame([("1", "c1"), ("1", "c4"), ("2", "c6")], "query_id string, id string")
    settings = {"a": (1.5, 0.75, 60), "b": (0.5, 0.1, 5)}
    df = spark.createDataFrame([(n, *v) for n, v in settings.items()], sweep.SETTING)
    got = {r.setting: r for r in sweep.metrics(sparse.postings(chunks), sparse.corpus_stats(chunks), queries, relevant, df, k=5).collect()}
    for name, (k1, b, _) in settings.items():
        hits = sparse.search(chunks, queries, 5, k1, b).select("query_id", F.col("chunk_id").alias("id"), "rank")
        want = evaluate.ranking_metrics(hits, relevant, queries, 5).agg(*(F.round(F.avg(c), 6) for c in ("recall", "precision", "reciprocal_rank", "ndcg"))).first()
        assert tuple(got[name])[1:] == tuple(want)


def test_log_lines_and_timings(spark, caplog):
    caplog.set_level("INFO", logger="gristmill")
    assert json.loads(log_event("ingest", n=3, a="é")) == {"event": "ingest", "a": "é", "n": 3}
    assert caplog.records[-1].getMessage() == '{"event": "ingest", "a": "é", "n": 3}'
    t = Timings(kept=2)
    for _ in range(3):
        with pytest.raises(KeyError), t.timed("x"):
            raise KeyError
    (row,) = evaluate.latency_summary(t.rows(spark)).collect()
    assert (row.key, row.n) == ("x", 2) and row.max >= row.p50 > 0


def test_runner_and_deterministic_view(spark):
    e = Engine(spark)
    e.ingest({"cats": "Cats sleep most of the day."})
    cases = spark.createDataFrame([("q1", "cats", ["cats"], "retrieve"), ("q2", "1+1", [], "arithmetic")], "query_id string, question string, relevant_docs array<string>, expected_route string")

    def runner(queries):
        return queries.select("query_id", F.array(F.lit("cats#0")).alias("citations"), F.lit("retrieve").alias("route"), F.lit(0.5).alias("support_rate"), F.col("query_id").substr(2, 1).cast("double").alias("latency_ms"))

    out = e.evaluate(cases, runner=runner)
    assert (out["recall"], out["route_accuracy"], out["grounding_rate"], out["latency_p50"]) == (1.0, 0.5, 0.5, 1.5)
    view = evaluate.deterministic_view(evaluate.report(e.evaluate_cases(cases, runner=runner)))
    assert "latency_p50" not in view.columns and view.first().recall == 1.0


def test_doctor_and_verify(spark, tmp_path, capsys):
    assert cli.main(["doctor"]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["passed"]
    (tmp_path / "cats.md").write_text("Cats sleep most of the day, and dogs bark at night.")
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps([{"question": "what do cats do most of the day", "relevant_docs": ["cats"], "expected_route": "retrieve"}]))
    assert cli.main(["--corpus", str(tmp_path / "*.md"), "verify", str(cases)]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["determinism"]
    assert cli.main(["--corpus", str(tmp_path / "*.md"), "verify", str(cases), "--min-recall", "1.1"]) == 1


def test_a_sweep_shuffles_no_pairs(spark):
    """Each chunk's counts and each setting's scores are made where the chunk lies; only a question's best go on."""
    chunks = spark.createDataFrame([(f"c{i}", f"w{i % 7} w{i % 5} w{i % 7} common " * (1 + i % 4)) for i in range(300)] + [("none", None)], "chunk_id string, text string")
    queries = spark.createDataFrame([(str(i), f"common w{i % 6} w{i % 4} absent") for i in range(20)], "query_id string, text string")
    settings = {"a": (1.5, 0.75, 60), "b": (0.5, 0.1, 5), "c": (2.0, 1.0, 5)}
    df = spark.createDataFrame([(n, *v) for n, v in settings.items()], sweep.SETTING)
    terms = sparse.query_terms(queries)
    out = sweep.search(sparse.counted(chunks, terms), sparse.corpus_stats(chunks), terms, df, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r.query_id, r.chunk_id, r.score, r.rank) for r in out.collect()}
    want = set()
    for name, (k1, b, _) in settings.items():
        want |= {(f"{name}\u0001{r.query_id}", r.chunk_id, r.score, r.rank) for r in sparse.search(chunks, queries, 5, k1, b).collect()}
    assert got == want
