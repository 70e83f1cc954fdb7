"""Deterministic tools: arithmetic, units, dates. Units and dates are expressions; arithmetic is an Arrow UDF."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import KILOGRAMS, METRES, SCALES
from .text import bound, format_number

MAX_EXPONENT = 64


class ToolError(ValueError):
    """The tool can't do what is asked."""


_TOKEN = re.compile(r"\s*(?:(\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+)([eE][+-]?\d+)?|(\*\*|//|[-+*/%()]))")
_LEADING_ZERO = re.compile(r"0[0-9_]*[1-9][0-9_]*")


class _Expression:
    """Precedence climbing over numbers, + - * / // % ** and parentheses, in doubles."""

    def __init__(self, text: str):
        self.tokens: list = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ToolError("cannot parse expression: invalid syntax")
            if m[3]:
                self.tokens.append(m[3])
            else:
                if _LEADING_ZERO.fullmatch(m[1]) and not m[2]:
                    raise ToolError("cannot parse expression: leading zeros in decimal integer literals are not permitted")
                self.tokens.append(float((m[1] + (m[2] or "")).replace("_", "")))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self):
        token = self.peek()
        self.at += 1
        return token

    def sum(self) -> float:
        value = self.product()
        while self.peek() in ("+", "-"):
            value = value + self.product() if self.take() == "+" else value - self.product()
        return value

    def product(self) -> float:
        value = self.sign()
        while self.peek() in ("*", "/", "//", "%"):
            op, right = self.take(), self.sign()
            if op == "*":
                value *= right
            elif right == 0:
                raise ToolError("division by zero")
            else:
                value = value / right if op == "/" else value // right if op == "//" else value % right
        return value

    def sign(self) -> float:
        if self.peek() in ("+", "-"):
            return self.sign() if self.take() == "+" else -self.sign()
        return self.power()

    def power(self) -> float:
        base = self.atom()
        if self.peek() != "**":
            return base
        self.take()
        exponent = self.sign()
        if abs(exponent) > MAX_EXPONENT:
            raise ToolError("exponent too large")
        if base == 0 and exponent < 0:
            raise ToolError("division by zero")
        value = base**exponent
        if isinstance(value, complex):
            raise ToolError("result is not a real number")
        return value

    def atom(self) -> float:
        token = self.take()
        if isinstance(token, float):
            return token
        if token == "(":
            value = self.sum()
            if self.take() == ")":
                return value
        raise ToolError("cannot parse expression: invalid syntax")


def safe_eval(expression: str) -> float:
    text = (expression or "").replace("^", "**").strip()
    if not text:
        raise ToolError("empty expression")
    parsed = _Expression(text)
    try:
        value = parsed.sum()
    except OverflowError as e:
        raise ToolError("numeric overflow") from e
    if parsed.peek() is not None:
        raise ToolError("cannot parse expression: invalid syntax")
    if not math.isfinite(value):
        raise ToolError("result is not finite")
    return value


_EVALUATED = T.StructType(
    [T.StructField("ok", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]
)


def shown(value: float) -> str:
    """As ``format_number``, for whole numbers of any size."""
    return str(round(value)) if abs(value - round(value)) < 1e-9 else f"{value:.10g}"


@lru_cache(1 << 14)
def _called(expression: str | None) -> tuple[bool, str, str]:
    try:
        return True, shown(safe_eval(expression)), ""
    except (ToolError, RecursionError) as error:
        return False, "", str(error)


@F.arrow_udf(_EVALUATED)
def evaluated(expressions: pa.Array) -> pa.Array:
    """Each distinct expression of a batch is evaluated once."""
    told = expressions.dictionary_encode()
    rows = [_called(e) for e in (*told.dictionary.to_pylist(), None)]
    kinds = [pa.bool_(), pa.string(), pa.string()]
    found = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["ok", "value", "error"])
    return found.take(told.indices.fill_null(len(rows) - 1))


def _result(ok: Column, value: Column, error: Column) -> Column:
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(
        ok.alias("ok"), F.when(ok, value).otherwise("").alias("value"), F.when(ok, F.lit("")).otherwise(error).alias("error")
    )


def calculator(payload: Column) -> Column:
    return evaluated(payload)


def _lookup(table: dict, key: Column) -> Column:
    entries = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*entries), key)


def convert_unit(value: Column, src: Column, dst: Column) -> Column:
    """Lengths, masses and temperatures; null where there is no conversion."""
    named = F.struct(value.cast("double").alias("v"), F.lower(F.trim(src)).alias("s"), F.lower(F.trim(dst)).alias("d"))

    def converted(x: Column) -> Column:
        value, s, d = x["v"], x["s"], x["d"]
        a, b = _lookup(SCALES, s), _lookup(SCALES, d)
        celsius = F.when(a == "F", (value - 32.0) * 5.0 / 9.0).when(a == "K", value - 273.15).otherwise(value)
        heat = F.when(b == "F", celsius * 9.0 / 5.0 + 32.0).when(b == "K", celsius + 273.15).otherwise(celsius)
        length = value * _lookup(METRES, s) / _lookup(METRES, d)
        mass = value * _lookup(KILOGRAMS, s) / _lookup(KILOGRAMS, d)
        return F.when(a.isNotNull() & b.isNotNull(), heat).otherwise(F.coalesce(length, mass))

    return bound(named, converted)


def _parts(payload: Column) -> Column:
    return F.regexp_extract_all(payload, F.lit(r"\S+"), F.lit(0))


def unit_tool(payload: Column) -> Column:
    def parsed(p: Column) -> Column:
        number = F.get(p, 0).try_cast("double")
        return F.struct(p.alias("p"), number.alias("number"), convert_unit(number, F.get(p, 1), F.get(p, 2)).alias("value"))

    def told(x: Column) -> Column:
        p, number, value = x["p"], x["number"], x["value"]
        error = (
            F.when(F.size(p) != 3, F.lit("expected '<value> <from> <to>'"))
            .when(number.isNull(), F.concat(F.lit("could not convert string to float: '"), F.get(p, 0), F.lit("'")))
            .otherwise(F.concat(F.lit("no conversion from "), F.get(p, 1), F.lit(" to "), F.get(p, 2)))
        )
        return _result((F.size(p) == 3) & value.isNotNull(), F.concat(format_number(value), F.lit(" "), F.lower(F.get(p, 2))), error)

    return bound(bound(_parts(payload), parsed), told)


def parse_date(token: Column) -> Column:
    """Year, month, day with ``-``, ``/``, ``.`` or nothing between; null if it is no date."""
    t = F.trim(token)
    return F.coalesce(*(F.try_to_date(t, f) for f in ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd", "yyyy.M.d")))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(parse_date(b), parse_date(a))


def date_tool(payload: Column) -> Column:
    def parsed(p: Column) -> Column:
        return F.struct(p.alias("p"), parse_date(F.get(p, 0)).alias("a"), parse_date(F.get(p, 1)).alias("b"))

    def told(x: Column) -> Column:
        p, days = x["p"], F.datediff(x["b"], x["a"])
        bad = F.when(x["b"].isNull(), F.get(p, 1)).otherwise(F.get(p, 0))
        error = F.when(F.size(p) != 2, F.lit("expected '<date-a> <date-b>'")).otherwise(F.concat(F.lit("unsupported date format: "), bad))
        return _result((F.size(p) == 2) & days.isNotNull(), F.concat(F.abs(days).cast("string"), F.lit(" 天")), error)

    return bound(bound(_parts(payload), parsed), told)


def invoke(tool: Column, payload: Column) -> Column:
    """(ok, value, error) of the tool by that name."""
    unknown = _result(F.lit(False), F.lit(""), F.concat(F.lit("unknown tool: "), tool))
    return (
        F.when(tool == "calculator", calculator(F.when(tool == "calculator", payload)))  # a UDF gets every row, so others come as null
        .when(tool == "unit_convert", unit_tool(payload))
        .when(tool == "date_diff", date_tool(payload))
        .otherwise(unknown)
    )
