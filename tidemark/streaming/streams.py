"""Streams: deduplication, late routing and rebuilds, rolling flow, metrics as they run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators.quality import sequence_gaps
from tidemark.operators.state import rebuilt
from tidemark.sources.sinks import append_events, committed, exists, read_current, read_store, upsert, write_batch
from tidemark.streaming.milestones import milestones

__all__ = ["Counters", "current_version", "deduplicated", "health", "milestones", "observed", "observed_milestones", "rebuild_into", "rebuild_snapshots", "rolling_flow", "route_late", "shard_statistics", "store_events"]

#: Fixed value: a lag or a milestone beyond this is late (ms).
LATE_MS = 2_000


def deduplicated(events: DataFrame, time: str = "ts", key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Each event once, however often a resumed collector delivers it within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def rolling_flow(events: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "60 seconds", slide: str = "5 seconds") -> DataFrame:
    """Sliding counts and volumes per token; traders are counted approximately."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window, slide), "token").agg(
        F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"), F.sum("quote").alias("volume"), F.approx_count_distinct("trader").alias("traders")
    )


def store_events(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", time: str = "ts") -> StreamingQuery:
    """Append each event once to a Parquet store, also when a batch is repeated."""
    return events.writeStream.foreachBatch(lambda df, _: append_events(df, path, key, time)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route_late(events: DataFrame, store: str, late: str, checkpoint: str, keep_ms: int, rebuild: Callable[[SparkSession, DataFrame], None] | None = None, versions: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Rows older than their token's newest stored event by more than ``keep_ms`` go to ``late`` and their tokens to ``rebuild`` and to ``versions`` (of ``rebuild_into``).

    The newest time of each token is a current table beside the store, of which a batch reads its own buckets.  What is late is
    decided once: a repeated batch finds its own folder of late rows, and all that follows may be done again.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark, newest = df.sparkSession, f"{store}.newest"
        times = df.select("token", "ts")
        if not exists(spark, f"{late}/batch={number}/_SUCCESS"):
            known = read_current(spark, newest, ["token"], times, times.schema)
            found = df.limit(0)
            if known is not None:
                marked = df.join(known.withColumnRenamed("ts", "__n"), "token", "left")
                found = marked.where(F.unix_millis("__n") - F.unix_millis("ts") > keep_ms).select(*df.columns)
            write_batch(found, late, number)
        append_events(df, store)
        upsert(times, newest, ["token"], "ts")
        touched = spark.read.schema(df.schema).parquet(f"{late}/batch={number}").select("token").distinct()
        if rebuild:
            rebuild(spark, touched)
        if versions:
            versions(touched, number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild_snapshots(old: DataFrame, tokens: DataFrame, snapshots: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Snapshots of the touched tokens computed anew, as the next version."""
    return rebuilt(old, snapshots(tokens), ["token", "age"])


def rebuild_into(out: str, store: str, schema: StructType, snapshots: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("token", "age")) -> Callable[[DataFrame, int], None]:
    """For ``versions`` of ``route_late``: snapshots of the touched tokens from the stored events, as the next version, into ``out``.

    A batch writes its own folder and counts its versions from the batches before it, so doing it again gives the same rows.
    """

    def rebuild(tokens: DataFrame, number: int) -> None:
        spark = tokens.sparkSession
        fresh = snapshots(read_store(spark, store, schema).join(tokens, "token", "left_semi"))
        before = committed(spark, out, fresh.withColumn("version", F.lit(1)).withColumn("batch", F.lit(0)).schema)
        top = before.where(F.col("batch") < number).join(tokens, "token", "left_semi").groupBy(*keys).agg(F.max("version").alias("__v"))
        write_batch(fresh.join(top, list(keys), "left").withColumn("version", (F.coalesce("__v", F.lit(0)) + 1).cast("int")).drop("__v"), out, number)

    return rebuild


def current_version(spark: SparkSession, out: str, schema: StructType, keys: tuple[str, ...] = ("token", "age")) -> DataFrame:
    """The latest version of each key in ``out``; ``schema`` is that of its rows with ``version``."""
    rows = committed(spark, out, StructType([*schema, StructField("batch", IntegerType())]))
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), "version").alias("x")).select("x.*").drop("batch")


def health(events: DataFrame, stream: str, seq: str) -> dict[str, DataFrame]:
    """Lag, counts and gaps of a batch, for foreachBatch."""
    lag = F.unix_millis("seen") - F.unix_millis("ts")
    counts = events.groupBy(stream).agg(F.count("*").alias("events"), F.max(lag).alias("max_lag_ms"), F.percentile_approx(lag, 0.5).alias("median_lag_ms"), F.count_if(lag > LATE_MS).alias("late"))
    return {"counts": counts, "gaps": sequence_gaps(events, stream, seq)}


def observed(events: DataFrame, name: str = "events", time: str = "ts", seen: str | None = None) -> DataFrame:
    """``events`` as they are; each batch's progress carries their number and lag under ``name``.

    The lag is taken against ``seen`` or, without it, the time of the batch.
    """
    lag = F.unix_millis(F.col(seen) if seen else F.current_timestamp()) - F.unix_millis(time)
    return events.observe(name, F.count(F.lit(1)).alias("events"), F.max(lag).alias("max_lag_ms"), F.sum(lag).alias("sum_lag_ms"), F.count_if(lag > LATE_MS).alias("late"))


def observed_milestones(rows: DataFrame, name: str = "milestones") -> DataFrame:
    """``rows`` of ``milestones(..., due=True)`` as they are; progress carries how many were emitted over ``LATE_MS`` after their time."""
    behind = F.unix_millis(F.current_timestamp()) - F.col("due")
    return rows.observe(name, F.count(F.lit(1)).alias("milestones"), F.max(behind).alias("max_late_ms"), F.count_if(behind > LATE_MS).alias("missed"))


class Counters(StreamingQueryListener):
    """Sums of what streams report under each name of ``observe``; names with ``max`` keep the largest value."""

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in (event.progress.observedMetrics or {}).items():
            known = self.totals.setdefault(name, {})
            for k, v in row.asDict().items():
                if v is not None:
                    known[k] = max(known.get(k, v), v) if k.startswith("max") else known.get(k, 0) + v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def shard_statistics(trades: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Statistics per shard file, resumable: shards already done are not read again; pool with ``committed(spark, out, ...)``.

    A batch's statistics have a folder of their own, which a repeated batch replaces.
    """
    per = lambda df: df.groupBy("shard").agg(F.count("*").alias("n_rows"), F.count_distinct("token").alias("tokens"), F.sum("quote").alias("volume"))
    return trades.writeStream.foreachBatch(lambda df, number: write_batch(per(df), out, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
