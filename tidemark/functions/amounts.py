"""Exact integer arithmetic on raw amounts, as column functions.

Amounts are whole numbers up to DECIMAL(38,0).  Ratios are in basis points and are
NULL where the denominator is zero or an input is missing: missing is never zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import wideint

BPS = 10_000
WIDE = T.DecimalType(38, 0)


def wide(x: Column) -> Column:
    return x.cast(WIDE)


def at_most(x: Column, bound: Column) -> Column:
    """The smaller of both; NULL if x is missing (``least`` alone would give the bound)."""
    return F.when(x.isNotNull(), F.least(x, bound))


def at_least(x: Column, bound: Column) -> Column:
    """The larger of both; NULL if x is missing."""
    return F.when(x.isNotNull(), F.greatest(x, bound))


def floor_div(a: Column, b: Column) -> Column:
    """Exact floor of a / b for a >= 0, b > 0; NULL on zero.

    Decimal division rounds, so the remainder is taken off first.  A quotient of more
    than 32 digits is NULL.
    """
    a, b = wide(a), wide(b)
    safe = F.when(b != 0, b)
    return F.try_divide(a - a % safe, safe).cast(WIDE)


def trunc_div(a: Column, b: Column) -> Column:
    """Exact quotient truncated toward zero, for signed a and b; NULL on zero."""
    a, b = wide(a), wide(b)
    q = floor_div(F.abs(a), F.abs(b))
    return F.when((a < 0) != (b < 0), -q).otherwise(q)


def muldiv(a: Column, b: Column, c: Column) -> Column:
    """floor(a * b / c) for non-negative integers; NULL where a * b passes 38 digits.

    The quotient is split as (a div c) * b + (a mod c) * b div c, so only the second
    product has to fit.
    """
    a, b, c = wide(a), wide(b), wide(c)
    whole = floor_div(a, c)
    first = F.try_multiply(whole, b).cast(WIDE)
    rest = F.try_multiply(a - whole * c, b).cast(WIDE)
    return F.try_add(first, floor_div(rest, c)).cast(WIDE)


def muldiv_text(a: Column | str, b: Column | str, c: Column | str) -> Column:
    """floor(a * b / c) over decimal strings below 2**256, for rows beyond 38 digits; text."""
    return wideint.muldiv(a, b, c)


def bps(a: Column, b: Column) -> Column:
    """floor(10000 a / b), uncapped."""
    return floor_div(wide(a) * F.lit(BPS), b).cast("bigint")


def bps_capped(a: Column, b: Column) -> Column:
    return at_most(bps(a, b), F.lit(BPS).cast("bigint"))


def return_bps(now: Column, then: Column) -> Column:
    """10000 (now - then) / then, truncated toward zero."""
    return trunc_div((wide(now) - wide(then)) * F.lit(BPS), then).cast("bigint")


def return_bps_even(now: Column, then: Column) -> Column:
    """10000 (now / then - 1) of float prices, rounded half to even."""
    return F.when(then > 0, F.bround((now / then - 1) * F.lit(float(BPS)), 0)).cast("bigint")


def sat_sub(a: Column, b: Column) -> Column:
    """max(a - b, 0); NULL if either is missing."""
    return at_least(a - b, F.lit(0).cast("bigint"))


def adverse(amount: Column, haircut_bps: Column | int) -> Column:
    """Amount less a haircut, floored."""
    cut = F.lit(haircut_bps) if isinstance(haircut_bps, int) else haircut_bps
    return floor_div(wide(amount) * (F.lit(BPS) - cut), F.lit(BPS))


def seeded_hit(seed: str, key: Column, chance_bps: int) -> Column:
    """Whether a key falls in a stable share of all keys."""
    digits = F.substring(F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % BPS < chance_bps


def median_floor(values: Column) -> Column:
    """Median of an array of whole numbers; an even count gives a + (b - a) div 2."""
    s = F.array_sort(values)
    n = F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, low + F.floor((high - low) / 2)).cast("bigint")


def nearest_rank(values: Column, percent: int) -> Column:
    """Element at index floor((n - 1) q / 100) of the sorted values."""
    at = F.floor((F.size(values) - 1) * percent / 100).cast("int")
    return F.when(F.size(values) > 0, F.get(F.array_sort(values), at))
