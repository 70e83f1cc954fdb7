"""Secret scans: fixed patterns, and a battery of randomness tests over encoded tokens. Column functions only.

Runs of base64 characters that mix digits and letters are candidates. Each one's
encoding is inferred from the characters it has (hex, base32, base36, base64);
against random symbols of that alphabet are held: their frequencies (chi-squared,
by Wilson and Hilferty's cube root), the runs above and below the middle, and the
correlation of neighbours. Fisher's method combines the three. In each stratum of
encoding and length Benjamini and Hochberg's step-up procedure then picks out the
tokens that are not random; the others, where long enough for the tests to tell,
are reported. The procedure works on counts by rounded p-value, a table of bounded
size, so nothing is ranked over the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # whole runs: no shorter one inside a run can pass where the run fails
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Alphabets in order of preference; a token has the first that holds all its characters.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": LOWER.upper() + "234567",
    "base36": "0123456789" + LOWER,
    "BASE36": "0123456789" + LOWER.upper(),
    "base64": LOWER.upper() + LOWER + "0123456789+/-_",
}
#: Of base64 the two last symbols are the first two's other names.
SYMBOLS = {name: min(64, len(a)) for name, a in ENCODINGS.items()}
LENGTHS = (20, 24, 32, 48, 64, 128)
TOP_BIN = 400


BLOCK = 64


def located(text: Column, pattern: str, fits=None) -> Column:
    """Leftmost matches of ``pattern`` that do not overlap, as (start, end, match) in code points; ``fits`` filters.

    Where a match stands is the sum of all gaps and matches before it: of whole blocks
    of these, and of the rest of its own block, so that many matches cost little each.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    add = lambda a, b: a + b
    total = lambda lengths, first, n: F.aggregate(F.slice(lengths, first, n), F.lit(0), add)

    def spans(p: Column) -> Column:
        lengths = F.transform(p, lambda x: x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0)))
        return _let(lengths, lambda own: _let(blocks(own), lambda before: F.transform(p, lambda x, i: span(x, i, own, before))))

    def blocks(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(own) - 1), F.lit(BLOCK))
        return _let(F.transform(starts, lambda s: total(own, s + 1, F.lit(BLOCK))), lambda sums: F.transform(sums, lambda _, b: total(sums, F.lit(1), b)))

    def span(x: Column, i: Column, own: Column, before: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = F.get(before, block) + total(own, block * BLOCK + 1, i - block * BLOCK) + x["gap"]
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("match"))

    real = F.filter(pairs, lambda x: x["m"].isNotNull())  # the last gap has no match
    return F.filter(_let(real, spans), lambda s: fits(s["match"]) if fits else F.lit(True))


def _gated(gate: Column, value: Column) -> Column:
    return F.when(gate, value).otherwise(F.array().cast("array<struct<start: int, end: int, match: string>>"))


def _tail(z: Column) -> Column:
    """P(N > z) by Abramowitz and Stegun 26.2.17; fixed coefficients."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _translate(text: Column, old: Column, new: Column) -> Column:
    return F.call_function("translate", text, old, new)


def _encoding(body: Column) -> Column:
    """(name, symbols, size, halves): the first encoding whose alphabet holds all characters."""
    out = None
    for name, alphabet in ENCODINGS.items():
        size = SYMBOLS[name]
        halves = "0" * (size // 2) + "1" * (size - size // 2)
        made = F.struct(F.lit(name).alias("name"), F.lit(alphabet[:size]).alias("symbols"), F.lit(size).alias("size"), F.lit(halves).alias("halves"))
        fits = F.translate(body, alphabet, "") == ""
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def _p_values(text: Column, n: Column, enc: Column) -> list[Column]:
    """Of the three tests of a token of ``n`` symbols."""
    count = lambda s, part: (F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)
    symbols, size = enc["symbols"], enc["size"].cast("double")
    squares = F.aggregate(
        F.split(symbols, ""), F.lit(0.0), lambda total, c: total + F.pow(n - F.length(F.replace(text, c, F.lit(""))), F.lit(2))
    )
    spread = 2 / (9 * (size - 1))
    chi = _let(squares * size / n - n, lambda x: (F.pow(F.greatest(x, F.lit(1e-9)) / (size - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))

    def runs(bits: Column) -> Column:
        ones = count(bits, "1")
        mean = 1 + 2 * ones * (n - ones) / n
        found = 1 + count(bits, "01") + count(bits, "10")
        return _let(
            F.struct(mean.alias("mean"), found.alias("found")),
            lambda r: _let(
                (r["mean"] - 1) * (r["mean"] - 2) / (n - 1),
                lambda var: F.when(var <= 0, F.lit(1e-12)).otherwise(2 * _tail(F.abs((r["found"] - r["mean"]) / F.sqrt(F.greatest(var, F.lit(1e-9)))))),
            ),
        )

    def serial(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / ((size * size - 1) / 12) / F.sqrt(n - 1)

    x = F.transform(F.split(text, ""), lambda c: F.instr(symbols, c) - (size + 1) / 2)
    return [
        _let(chi, _tail),
        _let(_translate(text, symbols, enc["halves"]), runs),
        _let(_let(x, serial), lambda z: 2 * _tail(F.abs(z))),
    ]


def _tested(token: Column) -> Column:
    """(stratum, bin): encoding and length band, and -10 log10 of the combined p-value, rounded down."""

    def combined(body: Column, enc: Column) -> Column:
        n = F.length(body).cast("double")
        band = reduce(lambda a, b: a + b, ((n >= x).cast("int") for x in LENGTHS))
        logs = F.transform(F.array(*_p_values(F.translate(body, "-_", "+/"), n, enc)), lambda p: -F.log(F.greatest(p, F.lit(1e-30))))
        half = F.aggregate(logs, F.lit(0.0), lambda s, v: s + v)
        p = _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))
        level = F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-40)))).cast("int")
        return F.struct(
            F.concat(enc["name"], F.lit(":"), band.cast("string")).alias("stratum"), F.least(F.lit(TOP_BIN), F.greatest(F.lit(0), level)).alias("bin")
        )

    return _let(F.regexp_replace(token, "=+$", ""), lambda body: _let(_encoding(body), lambda enc: combined(body, enc)))


def _not_random(tested: DataFrame, level: float) -> DataFrame:
    """(stratum, least): bins from ``least`` up are rejected as not random in that stratum."""
    counts = tested.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    all_ = Window.partitionBy("stratum")
    # A bin's p-values are at most 10 ** (-bin / 10).
    ranked = counts.select("stratum", "bin", F.sum("n").over(below).alias("rank"), F.sum("n").over(all_).alias("m"))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= level * F.col("rank") / F.col("m"))
    return passed.groupBy("stratum").agg(F.min("bin").alias("least"))


def scan_secrets(docs: DataFrame, level: float = 0.05) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and ``found``, an array of (start, kind_no, end, kind).

    Spans are code points, end exclusive, sorted by start, then kind as in
    ``KINDS``. A null text is empty. Assignments have a value of 8 characters or
    more, access keys 16, hex runs 32. A ``random`` span is a token of 20
    characters or more, with a digit and a letter, that the tests at false
    discovery rate ``level`` do not find to be other than random, and that no other
    span covers. Rows that repeat are scanned each; other columns are dropped.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    named = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")))
    assign = located(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)
    token = located(text, TOKEN, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    rows = docs.select(
        "doc_id",
        _gated(named, assign).alias("assign"),
        _gated(F.contains(text, F.lit("AKIA")), located(text, ACCESS)).alias("access"),
        _gated(text.rlike(HEX), located(text, HEX)).alias("hex"),
        _gated(text.rlike("[0-9]") & text.rlike(TOKEN), token).alias("token"),
    )
    rows = scratch.write(rows)
    fields = lambda kind: F.transform(
        kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )
    base = F.concat(*map(fields, KINDS[:3])).alias("base")
    free = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"])))
    tokens = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _tested(t["match"]).alias("t")))
    rows = rows.select("doc_id", base, "token").select("doc_id", "base", tokens.alias("tokens"))
    rows = scratch.write(rows)
    limits = _not_random(rows.select(F.explode("tokens.t").alias("t")).select("t.*"), level)
    # One row: at most as many entries as there are strata.
    limits = limits.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least"))).alias("limits"))
    random = F.filter("tokens", lambda t: t["t"]["bin"] < F.coalesce(F.try_element_at("limits", t["t"]["stratum"]), F.lit(TOP_BIN + 1)))
    random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind_no"), t["end"].alias("end"), F.lit("random").alias("kind")))
    return rows.join(F.broadcast(limits), how="left", on=F.lit(True)).select("doc_id", F.array_sort(F.concat("base", random)).alias("found"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: how many spans of each kind, and the spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda i: F.size(F.filter("found", lambda s: s["kind_no"] == i)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)),
        F.sha2(line(F.filter("found", lambda s: s["kind_no"] < 3)), 256).alias("base_sha256"),
        line("found").alias("spans"),
    )
