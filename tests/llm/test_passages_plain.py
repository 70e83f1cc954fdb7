"""Repeated passages against a plain search of all pairs of texts, on every diagonal, and against what was planted."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gristmill.llm import substring_dedup

WORDS, PART, SHARE = 50, 20, 0.8


def alike(a, b):
    """Places of ``a`` in a stretch of PART words or more that stands in ``b``, side by side, with SHARE of the words equal."""
    out = set()
    for d in range(-len(b) + PART, len(a) - PART + 1):
        lo, hi = max(0, d), min(len(a), len(b) + d)
        equal = [a[i] == b[i - d] for i in range(lo, hi)]
        sums = [0]
        for e in equal:
            sums.append(sums[-1] + e)
        if sums[-1] < PART * SHARE:
            continue
        for s in range(len(equal)):
            for e in range(s + PART, len(equal) + 1):
                if sums[e] - sums[s] >= SHARE * (e - s):
                    out.update(range(lo + s, lo + e))
    return out


def plain(texts):
    """For each text the stretches of WORDS places or more that parts cover, parts of all other texts together."""
    out = {}
    for x, a in enumerate(texts):
        places = set().union(*(alike(a, b) for y, b in enumerate(texts) if y != x))
        runs, start = [], None
        for i in range(len(a) + 1):
            if i in places and start is None:
                start = i
            elif i not in places and start is not None:
                runs.append((start, i))
                start = None
        out[x] = [r for r in runs if r[1] - r[0] >= WORDS]
    return out


@pytest.mark.parametrize("group", [2, 5, 12])
def test_all_pairs(spark, group):
    rng = random.Random(group)
    common = [f"c{i}" for i in range(60)]
    fresh = lambda n: [rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, share, planted = [], {}, {}
    for similarity in (1.0, 0.95, 0.9, 0.86):
        passage = fresh(70)
        for _ in range(group):
            # Each member differs from the passage in half of what two members may differ in.
            gone = {*rng.sample(range(70), round((1 - similarity) / 2 * 70))}
            share[len(texts)] = similarity
            before = fresh(rng.randint(5, 60))
            kept = [i for i in range(70) if i not in gone]
            planted[len(texts)] = {*range(len(before) + kept[0], len(before) + kept[-1] + 1)}
            texts.append(before + [f"x{rng.randrange(10**9)}" if i in gone else w for i, w in enumerate(passage)] + fresh(rng.randint(5, 60)))
    clean = range(len(texts), len(texts) + 20)
    texts += [fresh(150) for _ in clean]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {i: [] for i in range(len(texts))}
    for r in substring_dedup.repeated_passages(df).collect():
        found[r.doc_id].append((r.start, r.end))
    want = plain(texts)
    assert all(not found[i] for i in clean if not want[i])
    # At least what was planted, at most what the plain search lets pass (its ends reach further, into what is no part).
    covered, total, found_in_all, beyond = 0, 0, 0, 0
    for i in range(len(texts)):
        own = {p for s, e in found[i] for p in range(s, e)}
        most = {p for s, e in want[i] for p in range(s, e)}
        covered, total = covered + len(own & planted.get(i, set())), total + len(planted.get(i, ()))
        found_in_all, beyond = found_in_all + len(own), beyond + len(own - most)
    print("group", group, "covered", round(covered / total, 4), "beyond", round(beyond / found_in_all, 4), "texts missed", [share[i] for i in share if not found[i]])
    assert covered >= 0.95 * total and beyond <= 0.01 * found_in_all
    assert sum(not found[i] for i in share) <= 0.03 * len(share)


def test_words_as_one_by_one():
    rng = random.Random(3)
    texts = [None, "", " ", "\t a\x0bB\x0c", "x\x1cy \x85 z\xa0q", " ".join("W" * n for n in range(40)), "Äé 漢字 " * 9, "\x00 a\x00b"]
    texts += [" ".join("".join(rng.choice("abAZé09 ") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    words = [(t or "").encode().translate(lower).split() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        data, at, size, number = substring_dedup._split(pa.array(["before", *texts], kind).slice(1))
        assert number.tolist() == [len(w) for w in words]
        assert substring_dedup._word_hashes(data, at, size).tolist() == [xxhash.xxh3_64_intdigest(w) for ws in words for w in ws]


def test_seeds_of_texts_side_by_side():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 9 if n % 3 else 2**62, n).astype(np.uint64) for n in (0, 3, 4, 5, 12, 13, 14, 0, 200, 1, 500)]
    together = substring_dedup.seeds(np.concatenate(texts), np.array([len(t) for t in texts]))
    alone = [(s, np.full(len(s), i), *rest) for i, t in enumerate(texts) for s, _, *rest in [substring_dedup.seeds(t, np.array([len(t)]))]]
    assert all((a == np.concatenate(b)).all() for a, b in zip(together, zip(*alone, strict=True), strict=True))
    for s, text, at, _ in alone:
        n = len(texts[text[0]]) - substring_dedup.K + 1 if len(s) else 0
        assert n <= 0 or at.min() >= 0 and at.max() < n and np.diff(at, prepend=-1, append=n).max() <= substring_dedup.WINDOW


def test_same_rows_in_any_batches(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for period in (1, 2, 3, 5):
        own = fresh(period)
        texts += [fresh(rng.randint(5, 40)) + own * (rng.randint(100, 300) // period) + fresh(30) for _ in range(4)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(name), []
    try:
        for rows in ("7", "64", "5000"):
            spark.conf.set(name, rows)
            shared = substring_dedup._shared(substring_dedup._seeded(df.selectExpr("doc_id AS text_key", "text").repartition(3)))
            found.append(sorted(map(tuple, shared.collect())))
    finally:
        spark.conf.set(name, before)
    assert found[0] and found[0] == found[1] == found[2]
