"""Arithmetic, comparison and mathematics on columns, after IEEE rules.

All functions build plain Spark expressions, so they stay in generated code, and work on
columns and on constant columns alike. NULL is a missing value and stays NULL; division by
zero, logarithms of zero and results out of a domain are infinities and NaN, never errors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def inf() -> Column:
    return F.lit(float("inf"))


def nan() -> Column:
    return F.lit(float("nan"))


def number(c: Column) -> Column:
    return c.cast("double")


def whole(c: Column) -> Column:
    """A logical or narrow integer as a long, so that sums and products have room."""
    return c.cast("long")


def truth(c: Column, kind: str) -> Column:
    """A value as a logical; kind is its Spark type name."""
    return c if kind == "boolean" else c != F.lit(0)


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    a, b = number(a), number(b)
    by_zero = F.when(F.isnan(a) | (a == 0), nan()).otherwise(F.signum(a) * F.when(b.cast("string") == "-0.0", -inf()).otherwise(inf()))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _rounded(c: Column, down) -> Column:
    """floor or ceil as a double, also where the result does not fit a long."""
    return F.when(F.isnan(c) | (F.abs(c) >= 2.0**53), c).otherwise(down(F.when(F.abs(c) < 2.0**53, c)).cast("double"))


def floor(c: Column) -> Column:
    return _rounded(number(c), F.floor)


def ceiling(c: Column) -> Column:
    return _rounded(number(c), F.ceil)


def trunc(c: Column) -> Column:
    c = number(c)
    return F.when(c < 0, ceiling(c)).otherwise(floor(c))


def floor_divide(a: Column, b: Column) -> Column:
    return floor(divide(a, b))


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of b; NaN for b = 0."""
    a, b = number(a), number(b)
    rest = a % F.when(b == 0, F.lit(1.0)).otherwise(b)
    same = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
    far = F.when(F.isnan(a) | F.isnan(b) | (F.abs(a) == inf()), nan()).when(F.abs(b) == inf(), F.when((a == 0) | ((a < 0) == (b < 0)), a).otherwise(b))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, nan()).otherwise(F.coalesce(far, same))


def power(a: Column, b: Column) -> Column:
    a, b = number(a), number(b)
    return F.when((a.isNotNull() & b.isNotNull()) & ((a == 1) | (b == 0) | ((a == -1) & (F.abs(b) == inf()))), 1.0).otherwise(F.pow(a, b))


def _ordered(a: Column, b: Column, result: Column, floats: bool) -> Column:
    """A comparison that is NULL where a side is NaN."""
    return F.when(F.isnan(number(a)) | F.isnan(number(b)), None).otherwise(result) if floats else result


COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


def compare(name: str, a: Column, b: Column, floats: bool) -> Column:
    return _ordered(a, b, COMPARE[name](a, b), floats)


def _log(fn, at: float = 0.0):
    def run(c: Column) -> Column:
        c = number(c)
        return F.when(c.isNull(), None).when(F.isnan(c) | (c < at), nan()).when(c == at, -inf()).otherwise(fn(c))

    return run


log, log10, log2, log1p = _log(F.ln), _log(F.log10), _log(F.log2), _log(F.log1p, -1.0)

#: Lanczos' coefficients for g = 7 and nine terms (fixed values).
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def _lanczos(x: Column) -> tuple[Column, Column]:
    """The series and t of Lanczos' formula for gamma(x + 1)."""
    series = F.lit(_LANCZOS[0])
    for i, k in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(k) / (x + float(i))
    return series, x + 7.5


def lgamma(c: Column) -> Column:
    """The logarithm of the absolute value of gamma."""
    c = number(c)

    def upper(x: Column) -> Column:
        series, t = _lanczos(x - 1)
        return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.ln(t) - t + F.ln(series)

    pole = (c <= 0) & (c == F.floor(F.when(F.abs(c) < 2.0**53, c)).cast("double"))
    # For large values the series' rounding would show: there it is Stirling's formula.
    big = (c - 0.5) * F.ln(c) - c + 0.5 * math.log(2 * math.pi) + F.lit(1.0) / (c * 12)
    low = F.ln(F.lit(math.pi) / F.abs(F.sin(c * math.pi))) - upper(1 - c)
    return F.when(c.isNull(), None).when(F.isnan(c), c).when(F.abs(c) == inf(), inf()).when(pole, inf()).when(c.isin(1.0, 2.0), 0.0).when(c < 0.5, low).when(c > 1e8, big).otherwise(upper(c))


def gamma(c: Column) -> Column:
    """The gamma function; NaN at zero and the negative integers."""
    c = number(c)

    def upper(x: Column) -> Column:
        series, t = _lanczos(x - 1)
        root = F.pow(t, (x - 0.5) / 2)
        return F.lit(math.sqrt(2 * math.pi)) * root * F.exp(-t) * root * series

    entire = F.abs(c) < 2.0**53
    is_whole = c == F.floor(F.when(entire, c)).cast("double")
    exact = F.factorial(F.when(is_whole & (c >= 1) & (c <= 18), c - 1).cast("int")).cast("double")
    low = F.lit(math.pi) / (F.sin(c * math.pi) * upper(1 - c))
    return (
        F.when(c.isNull(), None)
        .when(F.isnan(c), c)
        .when(c == inf(), inf())
        .when((c <= 0) & F.coalesce(is_whole, F.lit(True)), nan())
        .when(is_whole & (c <= 18), exact)
        .when(c > 171.7, inf())
        .when(c < -180, 0.0)
        .when(c < 0.5, low)
        .otherwise(upper(c))
    )


def _real(fn):
    return lambda c: fn(number(c))


def _within(fn, low: float, high: float):
    """fn, and NaN outside [low, high]."""

    def run(c: Column) -> Column:
        c = number(c)
        return F.when(c.isNull(), None).when(F.isnan(c) | (c < low) | (c > high), nan()).otherwise(fn(c))

    return run


def asinh(c: Column) -> Column:
    """By magnitude, so that large negative values keep their digits."""
    c = number(c)
    x = F.abs(c)
    return F.when(F.isnan(c) | (x == inf()) | (c == 0), c).otherwise(F.signum(c) * F.when(x > 1e8, F.ln(x) + math.log(2)).otherwise(F.log1p(x + x * x / (1 + F.sqrt(x * x + 1)))))


MATH = {
    "abs": F.abs,
    "sign": lambda c: F.signum(number(c)),
    "sqrt": _real(F.sqrt),
    "ceiling": ceiling,
    "floor": floor,
    "trunc": trunc,
    "log": log,
    "log10": log10,
    "log2": log2,
    "log1p": log1p,
    "exp": _real(F.exp),
    "expm1": _real(F.expm1),
    "acos": _within(F.acos, -1.0, 1.0),
    "acosh": _within(F.acosh, 1.0, float("inf")),
    "asin": _within(F.asin, -1.0, 1.0),
    "asinh": asinh,
    "atan": _real(F.atan),
    "atanh": _within(F.atanh, -1.0, 1.0),
    "cos": _real(F.cos),
    "cosh": _real(F.cosh),
    "sin": _real(F.sin),
    "sinh": _real(F.sinh),
    "tan": _real(F.tan),
    "tanh": _real(F.tanh),
    "gamma": gamma,
    "lgamma": lgamma,
}
#: Order or domain makes these meaningless on unordered sparse cells.
UNSUPPORTED = ("cummax", "cummin", "cumprod", "cumsum", "cospi", "sinpi", "tanpi", "digamma", "trigamma")


def is_nan(c: Column) -> Column:
    return F.coalesce(F.isnan(number(c)), F.lit(False))


def is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(number(c)) == inf(), F.lit(False))


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(number(c)) & (F.abs(number(c)) < inf()), F.lit(False))
