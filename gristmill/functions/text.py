"""Text functions: ``Column`` to ``Column``, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CITATION, CITATION_ID, CJK, HEDGES, PICTOGRAPHS, SPACE, STOP_CHARACTERS, STOP_WORDS, TERMINATORS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(text), rf"^{SPACE}+|{SPACE}+$", "")


def is_cjk(ch: Column | str) -> Column:
    return _col(ch).rlike(rf"^[{CJK}]$")


def _ascii(text: Column) -> Column:
    """Cheap to see, and most text needs no look for CJK then."""
    return F.octet_length(text) == F.length(text)


def latin_runs(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and ``_ - + # .`` outside CJK."""
    text = _col(text)
    plain = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_\-+#.]+"), F.lit(0))
    other = F.regexp_extract_all(F.lower(text), F.lit(rf"(?:[a-z0-9_\-+#.]++|[\p{{L}}\p{{N}}&&[^{CJK}]])++"), F.lit(0))
    return F.when(_ascii(text), plain).otherwise(other)


def cjk_bigrams(text: Column | str) -> Column:
    """Neighbouring pairs of each CJK run; a run of one stands alone."""

    def pairs(run: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1))
        return F.transform(starts, lambda i: F.substr(run, i, F.lit(2)))

    text = _col(text)
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(rf"[\x{{3040}}-\x{{FAFF}}&&[{CJK}]]++"), F.lit(0)), pairs))  # most text is below all of CJK
    return F.when(_ascii(text), F.array().cast("array<string>")).otherwise(found)


def tokenize(text: Column | str) -> Column:
    """CJK bigrams, then latin runs; repeats stay. Null is empty."""
    text = F.coalesce(_col(text), F.lit(""))
    return F.concat(cjk_bigrams(text), latin_runs(text))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokenize(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; two empty ones are alike."""
    return jaccard_of(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard_of(both: Column, union: Column) -> Column:
    """From the sizes of the sets' intersection and union."""
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.nullif(union, F.lit(0)))


def overlap_coefficient(query: Column, text: Column) -> Column:
    """The share of the query's distinct tokens that the text has; 0 for an empty query."""
    return F.coalesce(F.size(F.array_intersect(query, text)) / F.nullif(F.size(F.array_distinct(query)), F.lit(0)), F.lit(0.0))


_ENDS = TERMINATORS.replace("\n", "")
_GAP = rf"[{SPACE[1:-1]}&&[^\n]]"
#: What neither ends a sentence nor is white space; runs of ASCII first, as large classes are slow.
_WORD = rf"""(?:["-:<->@-~]++|[^\x00-~{_ENDS}\s\x85\p{{Z}}]|[\x00-\x08\x0e-\x1b])++"""
#: A piece as it stands without white space around it: words up to what ends it, or what ends it alone.
_PIECE = rf"{_WORD}(?:(?: ++|{_GAP}++){_WORD})*+(?:{_GAP}*+[{_ENDS}])?+|[{_ENDS}]"


def sentences(text: Column | str) -> Column:
    """Sentences with their terminators; pieces under four characters join the one before."""

    def joined(pieces: Column) -> Column:
        # Pieces hold no line feed, which ends one and is white space; so it can part the sentences of a string, made in one go.
        parted = F.transform(pieces, lambda p, i: F.when((i > 0) & (F.length(p) >= 4), F.concat(F.lit("\n"), p)).otherwise(p))
        return F.when(F.size(pieces) == 0, F.array().cast("array<string>")).otherwise(F.split(F.array_join(parted, ""), "\n"))

    return bound(F.regexp_extract_all(_col(text), F.lit(_PIECE), F.lit(0)), joined)


def normalise_ws(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(_col(text), rf"{SPACE}+", " "), F.lit(" "))


def best_excerpt(query: Column | str, text: Column | str, limit: int = 200) -> Column:
    """The sentence that holds most of the query's tokens, the first of equals, cut to ``limit``."""
    flat, tokens = normalise_ws(text), token_set(query)
    scored = F.transform(
        sentences(flat), lambda s, i: F.struct(overlap_coefficient(tokens, tokenize(s)).alias("score"), (-i).alias("at"), s.alias("s"))
    )
    best = F.array_max(scored)["s"]
    return F.left(F.when(F.size(tokens) == 0, flat).otherwise(F.coalesce(best, flat)), F.lit(limit))


def approx_tokens(text: Column | str) -> Column:
    """CJK characters (U+3400 to U+9FFF) one by one, others by four, and one."""
    text = _col(text)
    cjk = F.length(text) - F.length(F.regexp_replace(text, r"[\x{3400}-\x{9FFF}]", ""))
    return cjk + F.floor((F.length(text) - cjk) / 4).cast("int") + 1


def strip_citations(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(text), F.lit("")), CITATION, " "), CITATION_ID, " ")


def without_stop_words(tokens: Column) -> Column:
    stop = F.array(*(F.lit(w) for w in [*STOP_WORDS, *STOP_CHARACTERS]))
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def content_tokens(text: Column | str) -> Column:
    """Tokens that are no stop words; repeats stay."""
    return without_stop_words(tokenize(text))


def is_claim(sentence: Column | str) -> Column:
    """Long enough, no question, no hedge."""
    s = strip(sentence)
    hedge = F.lit(False)
    for h in HEDGES:
        hedge = hedge | s.startswith(h)
    return (F.length(s) >= 6) & ~s.endswith("?") & ~s.endswith("？") & ~hedge


def format_number(value: Column | str) -> Column:
    """Whole numbers (within 1e-9) without a point, others with ten significant digits and no idle zeros.

    Whole numbers are exact to seventeen digits.
    """
    v = _col(value)
    whole = F.abs(v - F.rint(v)) < 1e-9
    exponent = F.floor(F.log10(F.abs(F.when(whole, F.lit(1.0)).otherwise(v))))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10g", v), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    # Java's %g never drops zeros before an exponent.
    science = F.regexp_replace(F.regexp_replace(F.format_string("%.9e", v), r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
    large = F.format_string("%.0f", F.rint(v))
    return F.when(whole, F.regexp_replace(large, "^-0$", "0")).when((exponent < -4) | (exponent >= 10), science).otherwise(plain)


def slices(text: Column | str, width: int = 24) -> Column:
    """Fixed-width pieces of a text, in order; none of an empty one."""
    text = _col(text)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(width)))
    return F.coalesce(F.transform(starts, lambda i: F.substr(text, i, F.lit(width))), F.array().cast("array<string>"))


def pictographs(text: Column | str) -> Column:
    """How many pictograph code points a text holds."""
    return F.regexp_count(_col(text), F.lit(rf"[{PICTOGRAPHS}]"))


def pictograph_places(text: Column | str) -> Column:
    """(column, code) of each pictograph of a line: the column counts code points from 1, the code reads U+XXXX."""
    text = _col(text)
    one = F.lit(rf"[{PICTOGRAPHS}]")
    points = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c, i: F.struct((i + 1).alias("column"), c.alias("c")))
    found = F.transform(F.filter(points, lambda p: F.rlike(p["c"], one)), lambda p: F.struct(p["column"].alias("column"), F.format_string("U+%04X", F.ascii(p["c"])).alias("code")))
    return F.when(F.rlike(text, one), found).otherwise(F.array().cast("array<struct<column: int, code: string>>"))
