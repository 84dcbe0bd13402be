"""Identity, order, cleaning and resolution of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hexwords import normal_hex

CORPUS_RANK = {"launch": 0, "trade": 1, "graduation": 2}


def event_id(kind: Column, *, chain_id=None, tx=None, log=None, sig=None, ix=None, inner=None, corpus: list[Column] | None = None) -> Column:
    """Content-addressed id by kind: evm, solana or corpus."""
    none = F.lit(None).cast("string")
    evm = F.concat_ws("|", F.lit("evm"), chain_id.cast("string"), normal_hex(tx), log.cast("string")) if tx is not None else none
    sol = F.concat_ws("|", F.lit("solana"), sig, ix.cast("string"), F.coalesce(inner.cast("string"), F.lit("-"))) if sig is not None else none
    rows = F.concat_ws("|", F.lit("corpus"), *(F.coalesce(c.cast("string"), F.lit("")) for c in corpus)) if corpus else none
    return F.sha2(F.when(kind == "evm", evm).when(kind == "solana", sol).otherwise(rows), 256)


def order_key(block: Column, tx: Column, log: Column, inner: Column, seq: Column, event: Column) -> Column:
    """Total order, never by time alone; a missing part is 0, an inner index counts from 1."""
    zero = F.lit(0).cast("bigint")
    parts = [F.coalesce(c.cast("bigint"), zero) for c in (block, tx, log)]
    return F.struct(*(p.alias(f"o{k}") for k, p in enumerate(parts)), F.coalesce(inner.cast("bigint") + 1, zero).alias("o3"), F.coalesce(seq.cast("bigint"), zero).alias("o4"), event.alias("o5"))


def order_text(key: Column) -> Column:
    """The order key as text that sorts alike."""
    return F.concat_ws(":", *(F.lpad(key[f"o{k}"].cast("string"), 20, "0") for k in range(5)), key["o5"])


def corpus_order(rows: DataFrame) -> Column:
    """(ms, type rank, mint, file, row, seq) of decoded corpus rows."""
    rank = F.when(F.col("event_type") == "launch", 0).when(F.col("event_type") == "trade", 1).otherwise(2)
    return F.struct(F.unix_millis("timestamp").alias("ms"), rank.alias("rank"), "mint", "source_file", "source_row", "order_seq")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by order; a deterministic drop of duplicates."""
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("__x"))
    return one.select(*keys, "__x.*").select(*rows.columns)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("deliveries")).where("deliveries > 1")


def without_heartbeats(trades: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Trades without those that repeat their predecessor of the same token in all of ``same``."""
    w = Window.partitionBy("token").orderBy(*order)
    now = F.struct(*same)
    return trades.withColumn("__p", F.lag(now).over(w)).where(F.col("__p").isNull() | ~F.col("__p").eqNullSafe(now)).drop("__p")


def classify_amount(x: Column) -> tuple[Column, Column]:
    """(class, cleaned value) of an amount given as text."""
    t = F.trim(x)
    number = t.try_cast("double")
    whole = t.rlike("^[0-9]+$")
    kind = F.when(x.isNull() | (t == ""), "MISSING").when(whole, "ONCHAIN_INTEGER").when(number.isNotNull() & ~F.isnan(number) & (number == F.floor(number)) & (F.abs(number) < 9e15), "INTEGER_VALUED_FLOAT").otherwise("FLOAT_NOT_INTEGER")
    return kind, F.when(kind == "ONCHAIN_INTEGER", t).when(kind == "INTEGER_VALUED_FLOAT", number.cast("bigint").cast("string"))


def price_valid(p: Column) -> Column:
    return F.coalesce(p.isNotNull() & ~F.isnan(p) & (p > 0) & (p < float("inf")), F.lit(False))


def label_quality(n: Column, missing: Column, bad: Column) -> Column:
    """INVALID without prices, with more than half missing or any bad one; PARTIAL above a tenth."""
    return F.when((n == 0) | (missing * 2 > n) | (bad > 0), "INVALID").when(missing * 10 > n, "PARTIAL").otherwise("VALID")


def market_registry(launches: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """(chain, token): newest curve, pool and quote that are not null; both inputs have ms."""
    rows = launches.select("chain", "token", "curve", "pool", "quote_asset", "ms").unionByName(lifecycle.select("chain", "token", "curve", "pool", "quote_asset", "ms"))
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ms", c)))
    return rows.groupBy("chain", "token").agg(*(at(c).alias(c) for c in ("curve", "pool", "quote_asset")))


def resolve_markets(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Empty tokens filled by curve, then by pool; else the address itself with a flag.

    Independent of arrival order, so trades seen before their market resolve as well.
    """
    by = lambda c, n: registry.where(F.col(c).isNotNull()).groupBy("chain", F.col(c).alias(f"__{n}")).agg(F.min("token").alias(f"__t{n}"))
    out = rows.join(by("curve", "c").withColumnRenamed("chain", "__x"), (F.col("chain") == F.col("__x")) & (F.col("curve") == F.col("__c")), "left").drop("__x", "__c")
    out = out.join(by("pool", "p").withColumnRenamed("chain", "__x"), (F.col("chain") == F.col("__x")) & (F.col("pool") == F.col("__p")), "left").drop("__x", "__p")
    given = F.when(F.col("token") != "", F.col("token"))
    found = F.coalesce(given, "__tc", "__tp")
    return out.withColumn("resolved", found.isNotNull()).withColumn("token", F.coalesce(found, "curve", "pool")).drop("__tc", "__tp")


def mark_orphans(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """canonical_status ORPHANED for events in ``removed`` (event_id), else CANONICAL."""
    gone = removed.select("event_id").distinct().withColumn("__g", F.lit(True))
    return rows.join(gone, "event_id", "left").withColumn("canonical_status", F.when(F.col("__g"), "ORPHANED").otherwise("CANONICAL")).drop("__g")


def with_lags(rows: DataFrame) -> DataFrame:
    """Discovery, persist and ingest lag in ms from chain_ms, seen_ms and stored_ms."""
    return rows.withColumn("discovery_lag_ms", F.col("seen_ms") - F.col("chain_ms")).withColumn("persist_lag_ms", F.col("stored_ms") - F.col("seen_ms")).withColumn("ingest_lag_ms", F.col("stored_ms") - F.col("chain_ms"))


def successful(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("execution_status") == "success")


def provisional_launches(trades: DataFrame, launches: DataFrame) -> DataFrame:
    """A launch with an empty creator for each traded token that has none."""
    unknown = trades.join(launches.select("token"), "token", "left_anti")
    return unknown.groupBy("token").agg(F.min("ms").alias("launch_ms")).withColumn("creator", F.lit(None).cast("bigint"))


def swap_side(amount1: Column) -> Column:
    return F.when(amount1 < 0, "buy").otherwise("sell")
