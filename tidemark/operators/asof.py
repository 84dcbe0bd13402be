"""As-of joins and latest-row look-ups on windows: no range join, no lookahead.

Both sides are united and the last right row is carried along each key's time order,
so a key's rows are sorted once and nothing is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: Column, order: list[str], name: str) -> DataFrame:
    """``left`` with ``name``: a struct of the latest right row at or before ``left_time``, or NULL.

    Ties in time go to the largest ``order``.  A right row at exactly the left time counts.
    """
    r = right.select(*keys, right_time.alias("__t"), F.lit(0).alias("__side"), F.struct(*order).alias("__o"), F.struct(*[c for c in right.columns if c not in keys]).alias("__r"), F.lit(None).cast(left.schema).alias("__l"))
    le = left.select(*keys, left_time.alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__o"].dataType).alias("__o"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(le).withColumn(name, F.last("__r", ignorenulls=True).over(w))
    return both.where("__side = 1").select("__l.*", name)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("__x"))
    return last.select(*keys, "__x.*").select(*rows.columns)


def coalesced(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: each column's newest value that is not null."""
    return rows.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in rows.columns if c not in keys))
