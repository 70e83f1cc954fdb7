"""Every dimension is searched, and buckets that all queries visit are cut up, with the same result."""

import numpy as np

from gristmill.llm import neighbours

VECTORS = "vec_id long, embedding array<double>"


def plain(rows, asked, k=5):
    out = []
    for q, v in rows:
        if q not in asked:
            continue
        near = []
        for i, w in rows:
            if i != q and len(w) == len(v):
                near.append((-np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)), i))
        out += [(q, r + 1, i) for r, (_, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def found(spark, rows, asked, **how):
    df = spark.createDataFrame(rows, VECTORS)
    got = neighbours.nearest(df, df.where(df.vec_id.isin(asked)), **how).collect()
    return sorted((r.query_id, r["rank"], r.vec_id) for r in got)


def test_two_dimensions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=2).tolist()) for i in range(40, 50)] + [(50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 2.0]), (100, [1.0] * 7), (150, [2.0, 1.0])]
    want = plain(rows, {50, 100, 150})
    assert (50, 1, 51) in want and found(spark, rows, [50, 100, 150]) == want
    assert found(spark, rows, [50, 100, 150], hashed_dims=1) == want  # the others by the exact way


def test_one_bucket_that_all_visit(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=8)
    rows = [(i, (middle + 0.01 * rng.normal(size=8)).tolist()) for i in range(1500)]
    asked = list(range(0, 1500, 5))
    small = found(spark, rows, asked, block=100)
    assert small == found(spark, rows, asked)
    want = plain(rows, set(asked))
    assert len(set(small) & set(want)) >= 0.9 * len(want)
