"""Arithmetic with IEEE results where Spark raises or gives null, and durations and byte sizes."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "y": 365 * 86400 * 10**9}
#: What every text that can be read as a double matches.
_DOUBLE = r"\A[\x00-\x20]*+[+-]?(?:[0-9.][0-9a-fA-FxXpP.+-]*+|[iInN][a-zA-Z]++)[\x00-\x20]*+\z"
_BYTES = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50}


def nan() -> Column:
    """A function, since a column can't be made before there is a session."""
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def double_column(text: Column) -> Column:
    """The double of a text; null if it isn't one. Spark tells by an exception, which is slow, so clear cases don't get that far."""
    return F.when(text.rlike(_DOUBLE), text.try_cast("double"))


def duration_ns(text: str) -> int:
    """Nanoseconds of 1h2m3s4ms and the like."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d|w|y)", text)
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("-"):
        raise ValueError(f"not a duration: {text}")
    n = sum(float(a) * _UNITS[b] for a, b in parts)
    return int(-n if text.startswith("-") else n)


def byte_size(text: str) -> float:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([A-Za-z]+)", text)
    if not m or m[2].lower() not in _BYTES:
        raise ValueError(f"not a size: {text}")
    return float(m[1]) * _BYTES[m[2].lower()]


def duration_column(text: Column) -> Column:
    """Seconds of a duration string, summed in whole nanoseconds; null if it isn't one."""
    unit = r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)"
    amounts, units = F.regexp_extract_all(text, F.lit(unit), F.lit(1)), F.regexp_extract_all(text, F.lit(unit), F.lit(2))
    scale = F.create_map(*(x for k in ("ns", "us", "µs", "ms", "s", "m", "h") for x in (F.lit(k), F.lit(float(_UNITS[k])))))
    total = F.aggregate(F.zip_with(amounts, units, lambda a, u: a.try_cast("double") * scale[u]), F.lit(0.0), lambda x, y: x + y)
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return F.when(text.rlike(rf"^[+-]?({unit})+$"), sign * F.round(total) / 1e9).when(text.rlike(r"^[+-]?0$"), 0.0)


def bytes_column(text: Column) -> Column:
    """Bytes of a size string; null if it isn't one."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$"
    scale = F.create_map(*(x for k, v in {**_BYTES, "": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.regexp_extract(text, pattern, 1).try_cast("double") * scale[F.lower(F.regexp_extract(text, pattern, 2))]


def floor_div(a: Column, m: int) -> Column:
    """The integer at or below a / m, of longs; a double would round times in nanoseconds."""
    return F.call_function("div", a - F.pmod(a, F.lit(m)), F.lit(m))


def ceil_div(a: Column, m: int) -> Column:
    return floor_div(a + (m - 1), m)


def constant(op: str, a: float, b: float) -> float:
    """The operator over two numbers, by IEEE; comparisons give 1 or 0."""
    if op in ("==", "!=", ">", "<", ">=", "<="):
        return float({"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op])
    with np.errstate(all="ignore"):
        x, y = np.float64(a), np.float64(b)
        return float({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: np.fmod(x, y), "^": lambda: x**y, "atan2": lambda: np.arctan2(x, y)}[op]())


def div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).when(F.isnan(a) | F.isnan(b) | (a == 0), nan()).otherwise(F.when(a > 0, inf()).otherwise(-inf()))


def mod(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(a) | F.isnan(b), nan()).otherwise(a % F.when(b != 0, b))


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparisons by IEEE: with NaN only != holds."""
    some = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return some | (a != b)
    made = {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return ~some & made


def arithmetic(op: str, a: Column, b: Column, zero_is_nan: bool = False) -> Column:
    if op == "/":
        return F.when(b == 0, nan()).otherwise(div(a, b)) if zero_is_nan else div(a, b)
    if op == "%":
        return mod(a, b)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b), "atan2": lambda: F.atan2(a, b)}[op]()


def least_number(value: Column) -> Column:
    """min in which NaN loses to any number."""
    return F.coalesce(F.min(F.when(~F.isnan(value), value)), nan())


def most_number(value: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), nan())


def log(name: str, v: Column) -> Column:
    safe = {"ln": F.log, "log2": F.log2, "log10": F.log10}[name](F.when(v > 0, v))
    return F.when(v == 0, -inf()).when(v < 0, nan()).otherwise(safe)


def quantile(q: float, values: Column) -> Column:
    """Of the values of a group, interpolated; outside 0 .. 1 it is infinite."""
    if math.isnan(q):
        return F.max(nan())
    if q < 0 or q > 1:
        return F.max(-inf() if q < 0 else inf())
    return F.percentile(values, F.lit(float(q)))


def text(v: Column) -> Column:
    """A number as a label value."""
    whole = v.try_cast("long")
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when(whole.cast("double") == v, whole.cast("string")).otherwise(v.cast("string"))
