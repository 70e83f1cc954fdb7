"""Very long and very repetitive texts through the operators that read whole texts."""

from pyspark.sql import functions as F

from gristmill.llm import decontaminate, jaccard_join, line_dedup, quality, substring_dedup

DOCS = "doc_id long, text string"
LONG = " ".join(f"w{i * 7919 % 200_003}" for i in range(200_000))
ONE = "x" * 3_000_000
SAME = "again " * 300_000


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def test_passages(spark):
    part = " ".join(LONG.split()[5_000:5_080])
    got = sorted(tuple(r) for r in substring_dedup.repeated_passages(frame(spark, [(1, LONG), (2, ONE), (3, SAME), (4, "some words before " + part + " and after")])).collect())
    assert [(d, p) for d, _, _, p in got] == [(1, 4), (4, 1)]
    assert got[0][1] <= 5_000 and got[0][2] >= 5_080 and got[0][2] - got[0][1] < 100


def test_benchmark_items(spark):
    item = " ".join(LONG.split()[100_000:100_012])
    df = frame(spark, [(1, LONG), (2, ONE), (3, SAME), (4, LONG + " " + item)])
    found = decontaminate.find_hits(df, frame(spark, [(7, item), (8, "again again"), (9, ONE)], "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n, list(r.hit_items)) for r in found.select("doc_id", "n_words", decontaminate.n_hit().alias("n"), "hit_items").collect()}
    assert got == {1: (200_000, 12, ["7"]), 2: (1, 1, ["9"]), 3: (300_000, 300_000, ["8"]), 4: (200_012, 24, ["7"])}


def test_lines(spark):
    many = "\n".join(f"line number {i} of a long text" for i in range(100_000))
    df = frame(spark, [(1, many), (2, many), (3, many), (4, ONE), (5, ONE), (6, ONE), (7, "\n" * 500_000)])
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.text)) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (100_000, 100_000, 0), 2: (100_000, 100_000, 0), 3: (100_000, 0, len(many)), 4: (1, 1, 0), 5: (1, 1, 0), 6: (1, 0, len(ONE)), 7: (500_001, 0, 500_000)}


def test_near_copies(spark):
    changed = LONG.split()
    changed[1000:1100] = ["other"] * 100
    rows = [(1, LONG), (2, " ".join(changed)), (3, ONE), (4, ONE.upper()), (5, SAME), (6, SAME + "and more"), (7, " ".join(LONG.split()[:100_000]))]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert {d: c for d, (c, _) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7} and got[5][1] == 1 and got[1][1] == 200_000 - 3


def test_quality_weights(spark):
    texts = [LONG, ONE, SAME, "good clean text", "bad text", None, ""]
    labels = frame(spark, [(3, 1), (4, 0), (0, 1)], "doc_id long, quality int")
    out = quality.resample(frame(spark, list(enumerate(texts))), labels, fraction=0.5).collect()
    assert sorted(r.doc_id for r in out) == list(range(7)) and 0 < sum(r.selected for r in out) <= 4, out
