"""The pipeline's stages against plain versions, each on its own input; odd tables."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from test_contracts import edited, plain_components, plain_hits, plain_lines, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows, items):
    spark.createDataFrame([(d, t, k, "s", len(t or "")) for d, t, k in rows], SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return spark.read.parquet(str(path / "documents.parquet"))


def test_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(51)
    item = " ".join("item" + str(i) for i in range(25))
    shared = ["Licence line that many documents share", "Another line of the licence, word by word"]
    rows = []
    for i in range(40):
        text = prose(rng, rng.randrange(20, 90)) + "\n" + rng.choice(shared) + "\n" + prose(rng, 10)
        rows.append((len(rows), text, "en"))
        if i % 4 == 0:
            rows.append((len(rows), edited(rng, text, rng.randrange(1, 5)), None))
        if i % 9 == 0:
            rows.append((len(rows), prose(rng, 30) + " " + item + " " + prose(rng, 30), "en"))
    rows += [(900, item, "en"), (901, None, None), (902, "", "en"), (903, "12 !!", None), (None, prose(rng, 30), "en"), rows[0], rows[0]]
    df = tables(spark, tmp_path, rows, [(1, item), (2, "no such words"), (3, None)])
    texts = lambda frame: [(r.doc_id, r.text) for r in frame.collect()]
    stages = [fn for _, fn in corpus_pipeline.STAGES]

    one = spark.createDataFrame(stages[0](spark, df, str(tmp_path)).collect(), SCHEMA)
    assert sorted(texts(one), key=repr) == sorted(((d, t) for d, t, _ in rows if d not in (901, 902, 903)), key=repr)

    two = spark.createDataFrame(stages[1](spark, one, str(tmp_path)).collect(), SCHEMA)
    assert sorted(texts(two), key=repr) == sorted(((d, t) for d, _, _, t in plain_lines(texts(one))), key=repr)

    before = texts(two)
    groups = defaultdict(set)
    for d, _, c in plain_components(before, 5, 80):
        groups[c].add(d)
    three = spark.createDataFrame(stages[2](spark, two, str(tmp_path)).collect(), SCHEMA)
    low = lambda d: -(2**63) if d is None else d
    assert sorted((d for d, _ in texts(three)), key=low) == sorted((min(g, key=low) for g in groups.values()), key=low)

    four = spark.createDataFrame(stages[3](spark, three, str(tmp_path)).collect(), SCHEMA)
    hits = {d: (n, hit) for d, n, hit, _ in plain_hits(texts(three), [(1, item), (2, "no such words")])}
    kept = {r.doc_id: r for r in four.collect()}
    assert set(kept) == {d for d, (n, hit) in hits.items() if hit <= 0.5 * n} and 900 not in kept
    assert all(hit == 0 for _, _, hit, _ in plain_hits([(d, r.text) for d, r in kept.items()], [(1, item)]))
    assert all(r.n_chars == len(r.text) for r in kept.values())

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(kept)


def test_empty_tables_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    (tmp_path / "empty").mkdir()
    tables(spark, tmp_path / "empty", [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    rng = random.Random(52)
    df = tables(spark, tmp_path, [(i, prose(rng, 40), "en") for i in range(6)], [])
    for name in ("node", "h", "doc", "row", "component", "entry", "gone", "__score", "__n_words", "n_lines", "sketch"):
        df = df.withColumn(name, F.lit("kept"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.count() == 6, name
        assert {tuple(r[5:]) for r in out.collect()} <= {("kept",) * (len(df.columns) - 5)}, name
