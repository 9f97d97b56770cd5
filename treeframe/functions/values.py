"""XPath 1.0 conversions and scalar functions as Column expressions. Numbers are doubles with IEEE rules, not ANSI ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[ \t\n\r]+"


def nan() -> Column:
    return F.lit(float("nan"))


def number_of_string(s: Column) -> Column:
    t = F.btrim(s, F.lit(" \t\n\r"))
    return F.when(t.rlike(r"^-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"), t.try_cast("double")).otherwise(nan())


def number_of_boolean(b: Column) -> Column:
    return F.when(b, 1.0).otherwise(0.0)


def string_of_number(x: Column) -> Column:
    """Integers without a point; NaN, Infinity; no exponents."""
    plain = F.regexp_replace(x.cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    text = x.cast("string")
    short = F.when(text.contains("E"), plain).otherwise(text)
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(whole, x.cast("long").cast("string")).otherwise(short)


def string_of_boolean(b: Column) -> Column:
    return F.when(b, "true").otherwise("false")


def boolean_of_number(x: Column) -> Column:
    return (x != 0) & ~F.isnan(x)


def boolean_of_string(s: Column) -> Column:
    return F.length(s) > 0


def divide(a: Column, b: Column) -> Column:
    inf = F.lit(float("inf"))
    zero = F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, inf).otherwise(-inf)
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def modulo(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(b) | F.isnan(a) | (F.abs(a) == float("inf")), nan()).when(F.abs(b) == float("inf"), a).otherwise(a % F.when(b != 0, b))


def compare(op: str, a: Column, b: Column) -> Column:
    """Numbers: NaN compares false, and unequal."""
    fine = ~F.isnan(a) & ~F.isnan(b)
    if op == "!=":
        return ~fine | (a != b)
    return fine & {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _whole(x: Column, kept: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 1e15), x).otherwise(kept.cast("double"))


def floor(x: Column) -> Column:
    return _whole(x, F.floor(x))


def ceiling(x: Column) -> Column:
    return _whole(x, F.ceil(x))


def round_half_up(x: Column) -> Column:
    return _whole(x, F.floor(x + 0.5))


def substring(s: Column, start: Column, length: Column | None) -> Column:
    """Characters at positions p with round(start) <= p < round(start) + round(length)."""
    size = F.length(s).cast("double")
    first = round_half_up(start)
    end = first + round_half_up(length) if length is not None else F.lit(float("inf"))
    a, b = F.greatest(first, F.lit(1.0)), F.least(end, size + 1)
    bad = F.isnan(first) | F.isnan(end) | (a >= b)
    return F.when(bad, "").otherwise(F.substring(s, F.when(bad, 1).otherwise(F.least(a, size + 1)).cast("int"), F.when(bad, 0).otherwise(F.greatest(F.least(b - a, size), F.lit(0.0))).cast("int")))


def substring_before(s: Column, t: Column) -> Column:
    at = F.position(t, s)
    return F.when((F.length(t) > 0) & (at > 0), F.substring(s, F.lit(1), at - 1)).otherwise("")


def substring_after(s: Column, t: Column) -> Column:
    at = F.position(t, s)
    return F.when(F.length(t) == 0, s).when(at > 0, F.substring(s, (at + F.length(t)).cast("int"), F.length(s))).otherwise("")


def normalize_space(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, _SPACE, " "), F.lit(" "))


def lang_matches(lang: Column, wanted: Column) -> Column:
    a, b = F.lower(lang), F.lower(wanted)
    return F.coalesce((a == b) | F.startswith(a, F.concat(b, F.lit("-"))), F.lit(False))
