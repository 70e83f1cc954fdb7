"""Routing: which questions a deterministic tool can answer. Expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DATE_QUESTION, DATE_WORDS, MATH_TRIM, MATH_WORDS, UNIT_QUESTION, UNIT_WORDS
from .text import strip


def fold_glyphs(text: Column) -> Column:
    """Temperature signs as ``deg``, ``degC``, ``degF``."""
    for old, new in (("℃", "deg"), ("℉", "deg"), ("°C", "degC"), ("°F", "degF"), ("°c", "degC"), ("°f", "degF"), ("°", "deg")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip_math_words(text: Column) -> Column:
    text = F.lower(text)
    for word in MATH_WORDS:
        text = F.replace(text, F.lit(word), F.lit(" "))
    return strip(F.btrim(strip(text), F.lit(MATH_TRIM)))


def looks_arithmetic(expression: Column) -> Column:
    opened = F.length(F.replace(expression, F.lit("("), F.lit("")))
    closed = F.length(F.replace(expression, F.lit(")"), F.lit("")))
    return (
        (F.length(expression) <= 200)
        & expression.rlike(r"^[0-9+\-*/%^(). \t]+$")
        & expression.rlike("[0-9]")
        & expression.rlike(r"[-+*/%^]")
        & (opened == closed)
    )


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def route(question: Column, deterministic: bool = True) -> Column:
    """(kind, tool, payload, reason): arithmetic before units before dates before retrieval."""

    def made(kind: str, tool: str, payload: Column, reason: Column | str) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(kind).alias("kind"), F.lit(tool).alias("tool"), payload.alias("payload"), reason.alias("reason"))

    if not deterministic:
        return made("retrieve", "", F.lit(""), "deterministic routing disabled")
    text = fold_glyphs(F.coalesce(question, F.lit("")))
    low, expression = F.lower(text), strip_math_words(text)
    value, src, dst = (F.regexp_extract(text, UNIT_QUESTION, i) for i in (1, 2, 3))
    unit = (value != "") & _has(low, UNIT_WORDS) & (F.lower(src) != F.lower(dst))
    dates = F.transform(F.regexp_extract_all(text, F.lit(DATE_QUESTION), F.lit(0)), lambda d: F.replace(d, F.lit("/"), F.lit("-")))
    date = (F.size(dates) >= 2) & _has(low, DATE_WORDS)
    return (
        F.when(looks_arithmetic(expression), made("arithmetic", "calculator", expression, "expression parses as pure arithmetic"))
        .when(unit, made("unit", "unit_convert", F.concat_ws(" ", value, src, dst), F.concat(F.lit("unit conversion "), src, F.lit(" -> "), dst)))
        .when(date, made("date", "date_diff", F.concat_ws(" ", F.get(dates, 0), F.get(dates, 1)), "two ISO dates plus an interval keyword"))
        .otherwise(made("retrieve", "", F.lit(""), "no deterministic tool matched"))
    )
