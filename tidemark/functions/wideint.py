"""Whole numbers beyond 38 digits as columns: arrays of base 10**9 limbs, the lowest first.

A function is told how many limbs its arguments have; products of limbs and their sums
stay within 64 bits for up to nine limbs.  Everything is a column expression of the JVM.
Text in and out is decimal; a number has to be below 2**256, as amounts on chains are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 1_000_000_000
#: Limbs of a number below 2**256.
LIMBS = 9
_MOST = str((1 << 256) - 1).zfill(9 * LIMBS)
_ARRAY = "array<bigint>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _longs(*values: Column | int) -> Column:
    return F.array(*(F.lit(v) if isinstance(v, int) else v for v in values)).cast(_ARRAY)


def limbs(n: int, size: int = LIMBS) -> Column:
    """A fixed number."""
    return _longs(*(n // BASE**k % BASE for k in range(size)))


def parse(text: Column | str) -> Column:
    """Limbs of decimal text or of a whole number; NULL if it is none or is 2**256 or more."""
    digits = F.regexp_replace(F.trim(_col(text).cast("string")), "^0+(?=.)", "")
    padded = F.lpad(digits, 9 * LIMBS, "0")
    fits = digits.rlike("^[0-9]+$") & (F.length(digits) <= 9 * LIMBS) & (padded <= F.lit(_MOST))
    return F.when(fits, F.transform(F.sequence(F.lit(LIMBS - 1), F.lit(0), F.lit(-1)), lambda i: F.substr(padded, i * 9 + 1, F.lit(9)).cast("bigint")))


def from_hex(word: Column | str) -> Column:
    """Limbs of a 64-digit hexadecimal word."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(_col(word), i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
    shift = lambda acc, x: carried(F.transform(acc, lambda v, i: v * (1 << 32) + F.when(i == 0, x).otherwise(F.lit(0).cast("bigint"))))
    return F.when(F.lower(_col(word)).rlike("^[0-9a-f]{64}$"), F.aggregate(parts, _longs(*[0] * LIMBS), shift))


def text(limbs: Column) -> Column:
    """Decimal text."""
    digits = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.regexp_replace(digits, "^0+(?=.)", "")


def number(limbs: Column) -> Column:
    """DECIMAL(38,0); NULL if it has more digits."""
    return let(text(limbs), lambda t: F.when(F.length(t) <= 38, t.cast("decimal(38,0)")))


def carried(raw: Column) -> Column:
    """The same number with every limb in [0, BASE); what is beyond the last limb is lost."""
    begin = F.struct(F.lit(0).cast("bigint").alias("c"), F.array().cast(_ARRAY).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        low = F.pmod(acc["c"] + x, F.lit(BASE).cast("bigint"))
        return F.struct(F.call_function("div", acc["c"] + x - low, F.lit(BASE).cast("bigint")).alias("c"), F.concat(acc["out"], F.array(low)).alias("out"))

    return F.aggregate(raw, begin, step, lambda acc: acc["out"])


def resized(a: Column, size: int, to: int) -> Column:
    return a if size == to else F.slice(a, 1, to) if to < size else F.concat(a, _longs(*[0] * (to - size)))


def less(a: Column, b: Column) -> Column:
    """a < b, of as many limbs each."""
    return F.reverse(a) < F.reverse(b)


def add(a: Column, b: Column, size: int) -> Column:
    """a + b with a limb more."""
    return carried(resized(F.zip_with(a, b, lambda x, y: x + y), size, size + 1))


def subtract(a: Column, b: Column) -> Column:
    """a - b for a >= b."""
    return carried(F.zip_with(a, b, lambda x, y: x - y))


def multiply(a: Column, m: int, b: Column, n: int) -> Column:
    """a b with m + n limbs; one of both has nine limbs at most.

    The sums of a place then have nine products at most and stay within 64 bits.
    """
    if min(m, n) > 9:
        raise ValueError("one factor must have nine limbs at most")

    def at(s: Column, k: Column) -> Column:
        low, high = F.greatest(F.lit(0), k - (n - 1)), F.least(k, F.lit(m - 1))
        return F.aggregate(F.sequence(low, high), F.lit(0).cast("bigint"), lambda acc, i: acc + F.get(s["a"], i) * F.get(s["b"], k - i))

    places = F.sequence(F.lit(0), F.lit(m + n - 2))
    known = lambda s: s["a"].isNotNull() & s["b"].isNotNull()
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when(known(s), carried(F.concat(F.transform(places, lambda k: at(s, k)), _longs(0)))))


def divide(a: Column, m: int, b: Column, n: int) -> Column:
    """floor(a / b) with m limbs; NULL on zero.

    Long division, a limb of the quotient at a time: doubles give it to within two, and
    whole numbers put it right.
    """
    value = lambda x: F.aggregate(F.reverse(x), F.lit(0.0), lambda acc, v: acc * float(BASE) + v)
    zero = _longs(*[0] * n)

    def corrected(s: Column, divisor: Column) -> Column:
        again = F.struct(subtract(s["r"], divisor).alias("r"), (s["q"] + 1).alias("q"))
        return F.when(less(s["r"], divisor), s).otherwise(again)

    def long_division(d: Column) -> Column:
        def step(acc: Column, limb: Column) -> Column:
            def digit(rest: Column) -> Column:
                guess = F.greatest(F.floor(value(rest) / d["size"]) - 1, F.lit(0)).cast("bigint")
                first = let(guess, lambda q: F.struct(carried(F.zip_with(rest, d["wide"], lambda x, y: x - q * y)).alias("r"), q.alias("q")))
                right = F.aggregate(F.array(F.lit(0), F.lit(1)), first, lambda s, _: corrected(s, d["wide"]))
                return let(right, lambda s: F.struct(F.slice(s["r"], 1, n).alias("r"), F.concat(acc["out"], F.array(s["q"])).alias("out")))

            nothing = F.struct(acc["r"].alias("r"), F.concat(acc["out"], _longs(0)).alias("out"))
            return F.when((limb == 0) & (acc["r"] == zero), nothing).otherwise(let(F.concat(F.array(limb), acc["r"]), digit))

        begin = F.struct(zero.alias("r"), F.array().cast(_ARRAY).alias("out"))
        return F.aggregate(F.reverse(d["a"]), begin, step, lambda acc: F.reverse(acc["out"]))

    operands = F.struct(a.alias("a"), resized(b, n, n + 1).alias("wide"), value(b).alias("size"))
    return F.when(b != zero, let(operands, long_division))


def muldiv(a: Column | str, b: Column | str, c: Column | str) -> Column:
    """floor(a b / c) as text, over decimal text or whole numbers below 2**256; NULL on zero or a missing or malformed input."""
    s = F.struct(parse(a).alias("a"), parse(b).alias("b"), parse(c).alias("c"))
    found = let(s, lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull() & x["c"].isNotNull(), text(divide(multiply(x["a"], LIMBS, x["b"], LIMBS), 2 * LIMBS, x["c"], LIMBS))))
    return found
