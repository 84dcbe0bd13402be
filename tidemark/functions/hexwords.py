"""Hex text and 32-byte words of event logs, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import wideint


def normal_hex(x: Column) -> Column:
    """Trimmed, lower case, one 0x in front."""
    return F.concat(F.lit("0x"), F.lower(F.regexp_replace(F.trim(x), "^0[xX]", "")))


def word(data: Column, index: int) -> Column:
    """The index-th 64-digit word after 0x; NULL if the data is shorter."""
    return F.when(F.length(data) >= 2 + 64 * (index + 1), F.substring(data, 3 + 64 * index, 64))


def unsigned(w: Column) -> Column:
    """Value of a word below 2**120 as DECIMAL(38,0); NULL for a wider one (keep its text)."""
    low, high = F.substring(w, 50, 15), F.substring(w, 35, 15)
    value = F.conv(high, 16, 10).cast("decimal(38,0)") * F.lit(1 << 60).cast("decimal(20,0)") + F.conv(low, 16, 10).cast("decimal(38,0)")
    return F.when(F.substring(w, 1, 34) == "0" * 34, value.cast("decimal(38,0)"))


def signed(w: Column) -> Column:
    """Two's-complement value of a word within 120 bits."""
    flip = F.translate(w, "0123456789abcdef", "fedcba9876543210")
    return F.when(F.substring(w, 1, 1).isin(*"89abcdef"), -(unsigned(flip) + 1)).otherwise(unsigned(w)).cast("decimal(38,0)")


def _short(w: Column) -> Column:
    """Whether a lower-case word is a number below 2**60, which needs no limbs."""
    return w.rlike("^0{49}[0-9a-f]{15}$")


def unsigned_text(w: Column) -> Column:
    """Value of any word as decimal text."""
    return F.when(_short(w), F.conv(F.substring(w, 50, 15), 16, 10)).when(w.isNotNull(), wideint.text(wideint.from_hex(w)))


def signed_text(w: Column, absolute: bool = False) -> Column:
    """Two's-complement value of any word as decimal text, or its absolute value."""
    flip = F.translate(w, "0123456789abcdef", "fedcba9876543210")
    negative = F.substring(w, 1, 1).isin(*"89abcdef")
    by_limbs = wideint.text(wideint.add(wideint.from_hex(flip), wideint.limbs(1), wideint.LIMBS))
    size = F.when(_short(flip), (F.conv(F.substring(flip, 50, 15), 16, 10).cast("bigint") + 1).cast("string")).otherwise(by_limbs)
    return F.when(negative, size if absolute else F.concat(F.lit("-"), size)).otherwise(unsigned_text(w))


def address(w: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.substring(w, 25, 40)))


def flag(w: Column) -> Column:
    return unsigned(w) != 0
