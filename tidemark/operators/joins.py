"""Matching of fills, positions and deliveries: semi, anti and full joins on equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmatched(fills: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Fills by key that no position has."""
    return fills.join(positions.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.count("*").alias("fills"))


def unopened(exits: DataFrame, entries: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Exits by key without an entry at or before them, with the smallest id."""
    first = entries.groupBy(*keys).agg(F.min(time).alias("__first"))
    j = exits.join(first, keys, "left").where(F.col("__first").isNull() | (F.col("__first") > F.col(time)))
    return j.groupBy(*keys).agg(F.min("id").alias("first_id"))


def launched_before(rows: DataFrame, launches: DataFrame, ms: int) -> DataFrame:
    """Rows of tokens launched before a moment."""
    return rows.join(launches.where(F.col("launch_ms") < ms).select("token"), "token", "left_semi")


def compare_deliveries(live: DataFrame, backfill: DataFrame, event: str, key: str) -> DataFrame:
    """Per event type: keys seen live, by backfill, by both and by one only, and the share of both."""
    one = lambda rows, name: rows.select(event, key).distinct().withColumn(name, F.lit(True))
    x = one(live, "__l").join(one(backfill, "__b"), [event, key], "full")
    li, ba = F.col("__l").isNotNull(), F.col("__b").isNotNull()
    return x.groupBy(event).agg(
        F.count_if(li).alias("live"), F.count_if(ba).alias("backfill"), F.count_if(li & ba).alias("both_sets"), F.count_if(li & ~ba).alias("live_only"), F.count_if(ba & ~li).alias("backfill_only"),
        F.round(100 * F.count_if(li & ba) / F.count("*"), 3).alias("match_pct"),
    )


def distinct_union(*parts: DataFrame) -> DataFrame:
    """Rows of any part, once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def shared_and_first_only(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` with part = both or first_only."""
    return a.intersect(b).select(F.lit("both").alias("part"), "*").union(a.subtract(b).select(F.lit("first_only").alias("part"), "*"))


def arm_matrix(entries: DataFrame, exits: DataFrame) -> DataFrame:
    """Every entry policy with every exit policy (entry, exit): the list of arms, as long as the product of both lists."""
    pair = entries.crossJoin(F.broadcast(exits))
    return pair.select(F.concat(F.lit("P"), F.col("entry").cast("string"), F.lit(":X"), F.col("exit").cast("string")).alias("arm_id"), "entry", "exit")
