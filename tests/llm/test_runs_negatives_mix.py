"""Periodic runs, hard negatives and mixing against plain versions, on odd rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import hard_negatives, mixing, periodic_runs
from gristmill.llm.common import Scratch

DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 12 -----------------------------------------------------------------------------------


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            smaller = any(all(w[k] == w[k + p] for k in range(s, s + size - p)) for p in range(1, q))
            if size >= max(6, 4 * q) and not smaller:
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        a = (h // 10) % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_text(rng):
    words = [chr(97 + i) * rng.randint(1, 3) for i in range(rng.choice([1, 2, 3, 9]))] + ["é", " "][: rng.randint(0, 2)]
    out = []
    for _ in range(rng.randint(0, 9)):
        piece = [rng.choice(words) for _ in range(rng.randint(1, 7))]
        out += piece * rng.choice([1, 1, 2, 4, 5, 9])
    return rng.choice([" ", "\n", " \t\x0b"]).join(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("tables")


def test_runs_against_plain(spark, folder):
    rng = random.Random(3)
    rows = [(i, periodic_text(rng)) for i in range(400)] + [(None, "a b a b a b a b"), (1000, None), (1001, ""), (1002, " \n "), (5, "x " * 9), (5, "x " * 9)]
    spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(str(folder / "documents.parquet"))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in periodic_runs.op12_periodic_runs(spark, str(folder)).select(*columns).collect()]
    want = [plain_row(*r) for r in rows]
    assert Counter(got) == Counter(want) and sum(r[1] for r in want) > 100


def test_runs_of_long_texts_and_other_columns(spark):
    words = [str(i * i % 1009 % 13) for i in range(20_000)]
    rows = [(1, "a " * 300_000, 5), (2, " ".join(words * 4), 6), (3, "x" * 2_000_000, 7), (4, " ".join(map(str, range(50_000))), 8)]
    df = spark.createDataFrame(rows, DOCS + ", n_runs long").withColumn("other", F.lit("kept"))
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(df).collect()}
    assert got[1].collapsed == "a" and (got[1].start, got[1].length, got[1].period) == (0, 300_000, 1)
    assert any(r.start == 0 and r.length == 80_000 for r in got[2].runs) and got[2].other == "kept"
    assert got[3].n_runs == 0 and got[3].start is None and len(got[3].collapsed) == 2_000_000
    assert got[4].n_runs == 0 and got[4].collapsed == rows[3][1]
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_next_smaller_and_common_prefixes():
    rng = np.random.default_rng(2)
    s = np.append(rng.integers(0, 2, 300), 9)
    order, rank, lcp = periodic_runs.suffix_ranks(s)
    assert [tuple(s[i:]) for i in order] == sorted(tuple(s[i:]) for i in range(301))
    common = periodic_runs.CommonPrefixes(rank, lcp)
    i, j = rng.integers(0, 301, (2, 500))
    i, j = i[i != j], j[i != j]
    plain = [next(k for k in range(301) if a + k > 300 or b + k > 300 or s[a + k] != s[b + k]) for a, b in zip(i, j, strict=True)]
    assert common(i, j).tolist() == plain
    values = rank.tolist()
    assert periodic_runs.next_smaller(values) == [next((k for k in range(i + 1, 301) if values[k] < v), 301) for i, v in enumerate(values)]


# -- 11 -----------------------------------------------------------------------------------


def plain_negatives(rows, n_pos=5, n_neg=10):
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [math.floor(256 * x) for x in v])
        held[i] = min(held.get(i, own), own)
    out = []
    for a, (la, va) in held.items():
        if a % 100:
            continue
        near = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, (lab, v) in held.items() if i != a and len(v) == len(va)]
        for p, i, _ in sorted(x for x in near if x[2] == la)[:n_pos]:
            inside = sorted(x for x in near if x[2] != la and -30 * p <= -100 * x[0] <= -90 * p)
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(inside[:n_neg])]
    return sorted(out)


def vectors(rng, n, dim=5, labels=3):
    return [(i, int(rng.integers(labels)), [float(x) for x in rng.normal(size=dim).round(2)]) for i in range(n)]


VECTORS = "vec_id long, label int, embedding array<double>"


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit(1)).withColumn("anchor_id", F.lit("x"))
    return sorted(tuple(r) for r in hard_negatives.mine(df, lambda i: i % 100 == 0, **how).collect())


def test_negatives_against_plain(spark):
    rng = np.random.default_rng(4)
    rows = vectors(rng, 700) + [(800, None, [1.0] * 5), (900, 1, None), (1000, 1, [1.0, None, 1.0, 1.0, 1.0]), (1100, 1, [float("inf")] * 5)]
    rows += [(1200 + 50 * i, i % 3, [1.0, 2.0]) for i in range(8)] + [(None, 1, [1.0] * 5), (1700, 1, []), (1701, 2, [])]
    rows += [(100, 0, rows[100][2]), rows[200], (2000, 1, [0.0] * 5), (2100, 1, [-x for x in rows[100][2]])]
    want = plain_negatives(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    assert mined(spark, rows, anchor_block=2, negatives=3) == plain_negatives(rows, n_neg=3)


def test_negatives_of_one_hot_vector(spark):
    rng = np.random.default_rng(5)
    rows = vectors(rng, 300) + [(1000 + i, i % 2, [1.0, 0.5, 0.25, 0.0, 1.0]) for i in range(600)] + [(2000 + i, 2, [0.7, 0.4, 0.1, 0.0, 0.5]) for i in range(600)]
    want = plain_negatives(rows)
    assert len(want) > 300 and mined(spark, rows) == want


def test_negatives_of_large_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, lab, [x * 2.0**17 for x in v]) for i, lab, v in vectors(rng, 250)]  # past the exact range of doubles
    want = plain_negatives(rows)
    assert len(want) > 10 and mined(spark, rows) == want
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1e30]), (1, 1, [1e30])])
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == []


# -- 13 -----------------------------------------------------------------------------------

MIXED = "doc_id long, text string, source string"


def plain_targets(sizes):
    """Sizes in order of sources: shares by weight, what is above three times a size reshared until none is."""
    w, full, out = [i % 3 + 1 for i in range(len(sizes))], set(), [0.0] * len(sizes)
    while True:
        left = sum(sizes) - sum(3 * sizes[i] for i in full)
        rest = sum(w[i] for i in range(len(sizes)) if i not in full)
        out = [3.0 * s if i in full else left * w[i] / rest for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if i not in full and out[i] > 3 * s}
        if not above:
            return out
        full |= above


def plain_seats(votes, seats, limits):
    won = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i, v in enumerate(votes) if won[i] < limits[i] and v > 0]
        if not open_:
            break
        won[max(open_, key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return won


def test_apportion_against_one_seat_at_a_time(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for g in range(40):
        n = rng.randint(1, 12)
        votes = [rng.choice([0, 1, 2, 3, 10, 50, 50, 1000]) for _ in range(n)]
        limits = [3 * v + 5 for v in votes]
        seats = rng.choice([0, 1, n, sum(votes) // 3, sum(votes)])
        want[g] = plain_seats(votes, seats, limits)
        rows += [(g, i, v, seats, m) for i, (v, m) in enumerate(zip(votes, limits, strict=True))]
    df = spark.createDataFrame(rows, "g long, i long, votes long, seats long, top long")
    got = {(r.g, r.i): r.won for r in mixing.apportion(df, ["g"], "i", "votes", "seats", "top").collect()}
    assert got == {(g, i): x for g, won in want.items() for i, x in enumerate(won)}


def mixed_rows():
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "b", "b", "b", "c", "dé", None])) for i in range(900)]
    rows += [(2000 + i, "\tone two\nthree ", "tiny") for i in range(2)] + [(None, "x y", "a"), (7, None, None), (7, "p q r", "a"), (7, "p q r", "a"), (3000, "big " * 200_000, "z"), (3001, "", "")]
    return rows


def test_mix_near_targets(spark):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, MIXED).withColumn("size", F.lit("clash")).withColumn("won", F.lit(1))
    for how in ({}, {"shard_words": 200, "shard_docs": 5, "fan_out": 3, "block": 4}):
        out = mixing.mix(df, **how).collect()
        assert Counter((r.doc_id, r["size"]) for r in out) == Counter((d, len((t or "").split())) for d, t, _ in rows)
        assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(7), **how).collect()))
        by = defaultdict(list)
        for r in out:
            by[r.source].append(r)
            assert 0 <= r.taken <= 3 * r["size"]
            assert r.taken == r.rounds * r["size"] + sum(a.end - a.start for a in r.arcs) and all(0 <= a.start < a.end <= r["size"] for a in r.arcs)
        order = sorted(by, key=lambda s: (s is None, s or ""))
        sizes = [sum(r["size"] for r in by[s]) for s in order]
        for s, size, target in zip(order, sizes, plain_targets(sizes), strict=True):
            assert {r.source_size for r in by[s]} == {size} and abs(by[s][0].target - target) < 1e-6 * max(1, target)
            taken = sum(r.taken for r in by[s])
            n = 1 + size // how.get("shard_words", 65_536) + len(by[s]) // how.get("shard_docs", 256)
            assert abs(taken - target) <= 3 * how.get("block", 16) * n, (s, taken, target)


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], MIXED)
    assert mixing.mix(none).count() == 0
    (r,) = mixing.mix(spark.createDataFrame([(1, None, None)], MIXED)).collect()
    assert (r["size"], r.taken, r.target) == (0, 0, 0.0)
    out = mixing.mix(spark.createDataFrame([(1, "a b c", "s")] * 500 + [(2, "", "t")], MIXED)).collect()  # repeated rows, and a source without words
    assert len(out) == 501 and abs(sum(r.taken for r in out) - 1500) <= 32 and max(r.target for r in out) == 1500


def test_mixed_texts(spark):
    rows = [(i, f"{i}a\n{i}b  {i}c", ("x", "y")[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, MIXED)
    mixed = Scratch(spark).write(mixing.mix(df, block=2))
    parts = mixing.mixed_texts(df.select("doc_id", "text"), mixed).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"))
    assert {r.doc_id: r.n for r in parts.collect()} == {r.doc_id: r.taken for r in mixed.where("taken > 0").collect()}


def test_mix_against_sql(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(d, t, s) for d, t, s in mixed_rows() if d is not None]
    spark.createDataFrame(rows, MIXED).write.parquet(path)
    got = sorted(tuple(r) for r in mixing.op13_mixing(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}/*.parquet'")
    cursor = con.execute(mixing.OP13_SQL)
    at = [[d[0] for d in cursor.description].index(n) for n in ("doc_id", "size", "source_size", "target", "taken")]
    assert got == sorted(tuple(r[i] for i in at) for r in cursor.fetchall())
