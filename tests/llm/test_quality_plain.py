"""Importance resampling against a plain version."""

import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import quality

BUCKETS = 1 << 10


def grams(text):
    """Buckets of words and pairs, word by word in Python integers."""
    mask = (1 << 64) - 1
    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in text.lower().split()]
    out = [x % BUCKETS for x in h]
    for a, b in zip(h, h[1:], strict=False):
        x = (((a * 0x9E3779B97F4A7C15) & mask) + b) & mask
        x = (x * 0xBF58476D1CE4E5B9) & mask
        out.append((x ^ (x >> 29)) % BUCKETS)
    return out


@pytest.mark.parametrize("per_gram", [None, 40.0])
def test_weights_and_top_k(spark, per_gram):
    rng = random.Random(31)
    texts = {i: " ".join(rng.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(rng.randrange(1, 40))) for i in range(200)}
    rows = list(texts.items()) + [(300, None), (301, ""), (5, texts[5]), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 200, 2)], "doc_id long, quality int")
    out = quality.resample(df, labels, fraction=0.25, buckets=BUCKETS, per_gram=per_gram).collect()
    good, raw = Counter(), Counter()
    for d, t in rows:
        g = grams(t or "")
        raw.update(g)
        if d % 2 == 0 and d < 200 and d % 3 == 0:
            good.update(g)
    p = lambda c, b: math.log((c[b] + 1) / (c.total() + BUCKETS))
    for r in out:
        g = grams(texts.get(r.doc_id) or "")
        assert r.n_grams == len(g)
        if not g:
            assert r.log_weight is None and r.sampling_key is None and not r.selected
            continue
        want = sum(p(good, b) - p(raw, b) for b in g)
        assert math.isclose(r.log_weight, want if per_gram is None else per_gram * want / len(g), rel_tol=1e-9, abs_tol=1e-9)
    noise = [r.sampling_key - r.log_weight for r in out if r.n_grams]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.3 and len(set(noise)) == 200
    keys = sorted(((-r.sampling_key, r.doc_id) for r in out if r.n_grams))
    k = round(0.25 * 202)
    chosen = Counter(r.doc_id for r in out if r.selected)
    assert chosen == Counter(d for _, d in keys[:k]) or chosen == Counter(d for _, d in keys[:k] if d != 5)


def test_kth_against_sorting(spark):
    rng = random.Random(32)
    for values in ([rng.gauss(0, 1) for _ in range(500)], [1.0] * 50 + [2.0] * 3, [1e300, -1e300, 0.0, 5e-324], [7.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for k in {1, 2, len(values) // 2 + 1, len(values)}:
            if k <= len(values):
                edge, left, tied = quality._kth(df, F.col("v"), k, bins=8)
                want = sorted(values, reverse=True)[k - 1]
                assert (edge, left, tied) == (want, k - sum(v > want for v in values), values.count(want))
    ids = [-(2**63), 2**63 - 1, 2**63 - 2, 5, 5, 6]
    df = spark.createDataFrame([(v,) for v in ids], "v long")
    for k in range(1, 7):
        assert int(quality._kth(df, F.col("v").cast("decimal(20,0)"), k, bins=4)[0]) == sorted(ids, reverse=True)[k - 1]


def test_ties_at_the_cut_go_to_the_least_ids(spark):
    df = spark.createDataFrame([(i, None) for i in range(4)], "doc_id long, text string").withColumn("text", F.lit("same"))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    scored = quality.resample(df, labels, fraction=0.5).collect()
    assert sum(r.selected for r in scored) == 2
    assert quality.resample(df, labels, fraction=0.0).where("selected").count() == 0
    assert quality.resample(df, labels, fraction=1.0).where("selected").count() == 4
