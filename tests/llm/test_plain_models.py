"""Kernel ridge, randomness tests and the pipeline against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from gristmill.llm import language_id, secrets


def test_kernel_and_ridge_against_plain_sums():
    rng = random.Random(41)
    grams = language_id.Grams()
    words = {"xx": "alpha beta gamma delta".split(), "yy": "eins zwei drei vier".split(), "zz": "un deux trois quatre".split()}
    sample = [(grams(" ".join(rng.choice(words[k]) for _ in range(rng.randrange(2, 9)))), k) for k in rng.choices(list(words), k=40)]
    sample = [([np.sort(g) for g in own], k) for own, k in sample]
    model = language_id.train(sample, landmarks=12, ridge=0.1)

    def kernel(x, y):
        parts = [len(set(a.tolist()) & set(b.tolist())) / math.sqrt(max(1, len(a)) * max(1, len(b))) for a, b in zip(x, y, strict=True)]
        return sum(parts) / len(parts)

    by = defaultdict(list)
    for g, k in sample:
        by[k].append(g)
    marks = [by[k][i] for i in range(40) for k in sorted(by) if i < len(by[k])][:12]
    got = language_id._kernel([g for g, _ in sample], model.vocabulary, model.landmarks)
    want = np.array([[kernel(g, m) for m in marks] for g, _ in sample])
    assert np.allclose(got, want, atol=1e-5)

    # Ridge by least squares on rows weighted so that each language counts the same, in the whitened landmark space.
    between = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(between)
    good = values > 1e-6 * values.max()
    features = want @ vectors[:, good] / np.sqrt(values[good])
    labels = [k for _, k in sample]
    counts = Counter(labels)
    weight = np.array([len(sample) / len(counts) / counts[k] for k in labels])
    for j, k in enumerate(model.languages):
        y = np.array([float(own == k) for own in labels])
        rows = np.vstack([features * np.sqrt(weight)[:, None], math.sqrt(0.1) * np.eye(features.shape[1])])
        theta = np.linalg.lstsq(rows, np.concatenate([y * np.sqrt(weight), np.zeros(features.shape[1])]), rcond=None)[0]
        assert np.allclose(features @ theta, (got @ model.weights)[:, j], atol=1e-3)


def test_language_ties_and_repeated_rows(spark):
    rows = [(1, "abab cdcd", "aa"), (2, "abab cdcd", "bb"), (2, "abab cdcd", "bb"), (None, "abab cdcd", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.predict(df, language_id.fit(df)).collect()
    assert len(out) == 4 and len({r.lang_pred for r in out}) == 1  # equal texts, equal predictions
    again = language_id.predict(df.repartition(3), language_id.fit(df.repartition(3))).collect()
    assert {r.lang_pred for r in again} == {r.lang_pred for r in out}
    clash = df.withColumns({"__lang_pred": F.lit("x"), "__score": F.lit("y")})
    kept = language_id.keep_known(clash)
    assert kept.columns == clash.columns and {(r["__lang_pred"], r["__score"]) for r in kept.collect()} <= {("x", "y")}


def plain_test(token):
    """(stratum, bin) by sums in Python."""
    body = token.rstrip("=")
    name = next(k for k, a in secrets.ENCODINGS.items() if set(body) <= set(a))
    symbols, n = secrets.ENCODINGS[name][: secrets.SYMBOLS[name]], len(body)
    body = body.translate(str.maketrans("-_", "+/"))
    size = len(symbols)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum((body.count(c) - n / size) ** 2 / (n / size) for c in symbols)
    spread = 2 / (9 * (size - 1))
    p1 = tail(((max(chi, 1e-9) / (size - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    bits = [symbols.index(c) >= size // 2 for c in body]
    ones = sum(bits)
    runs = 1 + sum(x != y for x, y in zip(bits, bits[1:], strict=False))
    mean = 1 + 2 * ones * (n - ones) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p2 = 1e-12 if var <= 0 else 2 * tail(abs(runs - mean) / math.sqrt(var))
    x = [symbols.index(c) + 1 - (size + 1) / 2 for c in body]
    p3 = 2 * tail(abs(sum(a * b for a, b in zip(x, x[1:], strict=False)) / ((size * size - 1) / 12) / math.sqrt(n - 1)))
    h = sum(-math.log(max(p, 1e-30)) for p in (p1, p2, p3))
    p = math.exp(-h) * (1 + h + h * h / 2)
    band = sum(n >= b for b in secrets.LENGTHS)
    return f"{name}:{band}", -10 * math.log10(max(p, 1e-40))


def test_p_values_against_plain_sums(spark):
    rng = random.Random(42)
    tokens = ["".join(rng.choice(a) for _ in range(n)) for a in ("0123456789abcdef", "ABCDEFGH234567", "abcdefghijklmnopqrstuvwxyz0123456789", secrets.ENCODINGS["base64"]) for n in (20, 31, 64, 200)]
    tokens += ["a1" * 20, "abcabcabc123" * 4, "A" * 30 + "b1", "Zm9vYmFyYmF6cXV4MDEyMzQ1==", "aaaaaaaaaaaaaaaaaaaaaaaa1"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets._tested(F.col("t")).alias("r")).collect()
    for r in rows:
        stratum, level = plain_test(r.t)
        assert r.r.stratum == stratum
        assert abs(r.r.bin - min(secrets.TOP_BIN, max(0, math.floor(level)))) <= 1 + level * 0.01, (r.t, r.r.bin, level)


def test_step_up_against_plain_ranks(spark):
    rng = random.Random(43)
    rows = [(f"s{i % 3}", min(400, int(rng.expovariate(1 / (5 if i % 4 else 60))))) for i in range(600)] + [("t", 0)] * 5
    got = {r.stratum: r.least for r in secrets._not_random(spark.createDataFrame(rows, "stratum string, bin int"), 0.05).collect()}
    by = defaultdict(list)
    for s, b in rows:
        by[s].append(10 ** (-b / 10))
    want = {}
    for s, p in by.items():
        p.sort()
        passed = [x for k, x in enumerate(p, 1) if x <= 0.05 * k / len(p)]
        if passed:
            want[s] = min(b for t, b in rows if t == s and 10 ** (-b / 10) <= max(passed))
    assert got == want and len(want) == 3
