"""Event store, current tables, batch folders, claims and exports.

Every sink may be called again with the same batch, also after a failure at any point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Hash buckets of a day of the event store and of a current table.
BUCKETS = 16


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _day(time: str) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit("none"))


def _parts(spark: SparkSession, path: str, names: list[str], schema) -> DataFrame | None:
    """Rows of those folders of a partitioned table that exist; no other folder is listed."""
    found = [f"{path}/{n}" for n in names if exists(spark, f"{path}/{n}")]
    return spark.read.schema(schema).option("basePath", path).parquet(*found) if found else None


def stored_like(events: DataFrame, path: str, key: str = "event_id", time: str = "ts", buckets: int = BUCKETS) -> DataFrame | None:
    """The stored events that ``events`` may repeat: those of their days and buckets.

    An event's id is made from its content, so that a repeated one has its day.  The driver gets the
    days and buckets of the batch, never more than its days times ``buckets``.
    """
    touched = events.select(_day(time), _bucket([key], buckets)).distinct().collect()
    schema = events.withColumn("day", F.lit("")).withColumn("bucket", F.lit(0)).schema
    return _parts(events.sparkSession, path, sorted(f"day={d}/bucket={b}" for d, b in touched), schema)


def append_events(events: DataFrame, path: str, key: str = "event_id", time: str = "ts", buckets: int = BUCKETS) -> None:
    """Append the events that the Parquet store at ``path`` does not hold; of a batch's repeated ids one is written.

    The store is partitioned by day and hash bucket of the key: a batch is compared only with what it can repeat.
    """
    new = events.dropDuplicates([key])
    old = stored_like(events, path, key, time, buckets)
    if old is not None:
        new = new.join(old.select(key), key, "left_anti").select(*events.columns)
    new = new.withColumn("day", _day(time)).withColumn("bucket", _bucket([key], buckets))
    # few files a folder, and large folders in several tasks
    new.hint("rebalance", "day", "bucket").write.mode("append").partitionBy("day", "bucket").parquet(path)


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """All events of a store."""
    return spark.read.schema(schema).parquet(path)


def read_current(spark: SparkSession, path: str, keys: list[str], wanted: DataFrame, schema, buckets: int = BUCKETS) -> DataFrame | None:
    """Rows of a current table in the buckets of the ``wanted`` keys; None if there are none."""
    _publish(spark, path)
    touched = [b for (b,) in wanted.select(_bucket(keys, buckets)).distinct().collect()]
    found = _parts(spark, path, sorted(f"bucket={b}" for b in touched), StructType([*schema, StructField("bucket", IntegerType())]))
    return None if found is None else found.drop("bucket")


def _publish(spark: SparkSession, path: str) -> None:
    """Put staged buckets in place of the table's own, if a stage was completed; doing so again changes nothing."""
    staged = f"{path}.staged"
    if exists(spark, f"{staged}/_SUCCESS"):
        rows = spark.read.parquet(staged)
        if "bucket" in rows.columns:
            rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        _remove(spark, staged)


def upsert(rows: DataFrame, path: str, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> None:
    """One row per key in the table at ``path``: new values replace old ones, missing ones keep them.

    Of a batch's rows of a key the last value by ``order`` counts, column by column.  With ``order`` a column's stored value gives
    way only if the row it comes with isn't older.  Touched buckets are written beside the table first and then
    put in place by dynamic partition overwrite; a run that fails in between is completed by the next one.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c not in keys]
    last = [(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order and c != order else F.max(c) if c == order else F.last(c, True)).alias(c) for c in others]
    new = rows.groupBy(*keys).agg(*last)
    old = read_current(spark, path, keys, rows, rows.schema, buckets)
    if old is not None:
        a, b = new.alias("a"), old.alias("b")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        there = F.col(f"a.{order}").isNotNull() & (F.col(f"a.{order}") < F.col(f"b.{order}")) if order else F.lit(False)
        value = lambda c: F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) if c == order else F.when(F.coalesce(there, F.lit(False)), F.coalesce(f"b.{c}", f"a.{c}")).otherwise(F.coalesce(f"a.{c}", f"b.{c}"))
        on = same[0]
        for x in same[1:]:
            on &= x
        new = a.join(b, on, "full_outer").select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), *(value(c).alias(c) for c in others))
    new.select(*rows.columns, _bucket(keys, buckets).alias("bucket")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}.staged")
    _publish(spark, path)


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Write a batch into a folder of its own; a repeated batch replaces itself, and Spark's _SUCCESS file is its commit record."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of all batches that were written to their end, with ``batch``."""
    fs, at = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = sorted(n for n in names if n.startswith("batch=") and exists(spark, f"{path}/{n}/_SUCCESS"))
    reader = spark.read.schema(schema).option("basePath", path)
    found = reader.parquet(*(f"{path}/{n}" for n in done)) if done else spark.createDataFrame([], schema)
    return found if "batch" in found.columns else found.withColumn("batch", F.lit(None).cast("int"))


def unclaimed(claims: DataFrame, known: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Earliest claim of each key that is not yet known."""
    return claims.join(known.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.min(time).alias(time))


def export_json(rows: DataFrame, path: str, order: list[str], limit: int | None = None, chain: str | None = None) -> None:
    """JSON lines in order; with a limit only the first ones."""
    if chain is not None:
        rows = rows.where(F.col("chain") == chain)
    rows = rows.orderBy(*order)
    (rows.limit(limit) if limit is not None else rows).write.mode("overwrite").json(path)
