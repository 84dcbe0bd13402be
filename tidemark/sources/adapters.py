"""The given tables as canonical launches and trades.

``events``: the key in ``props`` is a token, users trade it, one second stands for an
hour.  ``lineitem`` with ``orders``: parts are tokens, customers trade them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 3600


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, token, id, ms, trader, side, quote, base, price, kind."""
    k = F.get_json_object("props", "$.k")
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), (k.cast("int") % 3).cast("string")).alias("chain"), k.alias("token"), F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("user_id").alias("trader"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), "buy").otherwise("sell").alias("side"),
        F.round(F.col("value") * 100).cast("bigint").alias("quote"), F.lit(100).cast("bigint").alias("base"), F.col("value").alias("price"), F.col("event_type").alias("kind"),
    )


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, launch_ms, creator: the first trade of each token, and a token without trades for each nation."""
    t = trades(spark, sf_dir)
    first = t.groupBy("chain", "token").agg(F.min(F.struct("ms", "id", "trader")).alias("f")).select("chain", "token", F.col("f.ms").alias("launch_ms"), F.col("f.trader").alias("creator"))
    start = t.agg(F.min("ms").alias("launch_ms"))
    dead = _read(spark, sf_dir, "nation").select(F.lit("c0").alias("chain"), F.concat(F.lit("dead"), F.col("n_nationkey").cast("string")).alias("token"))
    return first.unionByName(dead.crossJoin(F.broadcast(start)).withColumn("creator", F.lit(None).cast("bigint")))


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with a (age in scaled milliseconds) and whether the creator trades."""
    born = launches(spark, sf_dir).select("token", "launch_ms", "creator")
    t = trades(spark, sf_dir).join(born, "token")
    return t.withColumn("a", F.floor((F.col("ms") - F.col("launch_ms")) / SCALE)).withColumn("mine", F.col("trader") == F.col("creator")).drop("launch_ms", "creator")


def part_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with orders as trades: token (part), day, line (unique order key), trader, side, quote, base, price."""
    lines, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("token"), F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("day"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("line"), F.col("o_custkey").alias("trader"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("quote"),
        F.round("l_quantity").cast("bigint").alias("base"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


#: The same projections as DuckDB CTEs.
SQL = f"""
t AS (SELECT 'c' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS chain, json_extract_string(props, '$.k') AS token, event_id AS id, epoch_us(ts) // 1000 AS ms,
        user_id AS trader, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'buy' ELSE 'sell' END AS side,
        CAST(round(value * 100) AS BIGINT) AS quote, CAST(100 AS BIGINT) AS base, value AS price, event_type AS kind FROM events),
l AS (SELECT chain, token, min(ms) AS launch_ms, arg_min(trader, (ms, id)) AS creator FROM t GROUP BY chain, token
      UNION ALL SELECT 'c0', 'dead' || n_nationkey, (SELECT min(ms) FROM t), NULL FROM nation),
a AS (SELECT t.*, (ms - launch_ms) // {SCALE} AS a, trader = creator AS mine FROM t JOIN l USING (token))
"""
PART_SQL = """
p AS (SELECT l_partkey AS token, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day, (l_orderkey, l_linenumber, l_suppkey) AS line, o_custkey AS trader,
        CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(round(l_extendedprice * 100) AS BIGINT) AS quote,
        CAST(round(l_quantity) AS BIGINT) AS base, l_extendedprice / l_quantity AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
