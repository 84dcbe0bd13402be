"""Source, sink and stream queries (SRC, SNK, STR): the given tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.plans.base import query, scratch
from tidemark.plans.state_queries import WITH
from tidemark.sources import adapters, corpus, sinks
from tidemark.streaming import streams


@query(
    "src1_corpus",
    f"{WITH} SELECT token, launch_ms, count(t.id) AS trades, count(t.id) FILTER (side = 'buy') AS buys, CAST(coalesce(sum(quote), 0) AS BIGINT) AS volume FROM l LEFT JOIN t USING (token) GROUP BY token, launch_ms",
)
def src1(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and sharded trades as Parquet."""
    path = scratch(spark, "corpus")
    none = F.lit(None)
    t = adapters.trades(spark, d)
    shards = t.select("id", F.col("token").alias("mint"), none.cast("string").alias("tx_signature"), F.timestamp_millis("ms").alias("event_time"), none.cast("double").alias("seconds_since_launch"), (F.col("side") == "buy").alias("is_buy"), F.col("quote").cast("double").alias("sol_amount"), F.col("base").cast("double").alias("token_amount"), F.col("trader").cast("string").alias("user_wallet"), F.col("price").alias("price_sol"), F.lit("events").alias("source"))
    shards.write.parquet(f"{path}/trades")
    adapters.launches(spark, d).select(F.col("token").alias("mint"), F.timestamp_millis("launch_ms").alias("detected_at"), F.col("creator").cast("string").alias("creator")).write.parquet(f"{path}/tokens")
    tokens, trades = corpus.read_corpus(spark, path)
    per = trades.groupBy("mint").agg(F.count("*").alias("trades"), F.count_if("is_buy").alias("buys"), F.sum("sol_amount").cast("bigint").alias("volume"))
    out = tokens.join(per, "mint", "left").na.fill(0, ["trades", "buys", "volume"])
    return out.select(F.col("mint").alias("token"), F.unix_millis("detected_at").alias("launch_ms"), "trades", "buys", "volume")


@query("src2_6_records", f"{WITH} SELECT id, token, CAST(CASE WHEN id % 4 = 0 THEN 0 ELSE quote END AS BIGINT) AS quote, CASE WHEN id % 4 = 0 THEN 'FLOAT_NOT_INTEGER' ELSE 'ONCHAIN_INTEGER' END AS amount_quality, side FROM t WHERE id % 7 <> 0")
def src2(spark: SparkSession, d: str) -> DataFrame:
    """Decoded records as JSON lines, to canonical trades: only on-chain integers keep a value."""
    path = scratch(spark, "records")
    exact = F.col("id") % 4 != 0
    t = adapters.trades(spark, d).select(
        F.when(F.col("id") % 7 == 0, "launch").otherwise("trade").alias("event_type"), F.col("token").alias("mint"), F.col("trader").cast("string").alias("trader"), "side", F.when(exact, F.col("quote").cast("string")).otherwise(F.lit("1.5")).alias("sol_amount"),
        F.col("base").cast("string").alias("token_amount"), F.when(exact, "ONCHAIN_INTEGER").otherwise("FLOAT_NOT_INTEGER").alias("amount_quality"), F.timestamp_millis("ms").alias("timestamp"), F.lit("d").alias("dataset_id"), F.lit("f").alias("source_file"), F.col("id").alias("source_row"), F.lit(0).alias("order_seq"),
    )
    t.write.json(path)
    records = corpus.read_records(spark, path)
    trades = corpus.canonical(records)["trades"]
    ids = adapters.trades(spark, d).select("id", corpus.prepare.event_id(F.lit("corpus"), corpus=[F.lit("d"), F.lit("f"), F.col("id"), F.when(F.col("id") % 7 == 0, "launch").otherwise("trade"), F.col("token"), F.lit(0)]).alias("event_id"))
    return trades.join(ids, "event_id").select("id", "token", F.col("quote").cast("bigint").alias("quote"), "amount_quality", "side")


_KINDS = ("CURVE_BUY", "CURVE_SELL", "SWAP", "TOKEN_LAUNCHED", "LAUNCH_SWEPT", "POOL_GRADUATED", "SNIPE_TAX_CHARGED", "CURVE_COMPLETED")


@query(
    "src3_5_logs",
    f"{WITH}, k AS (SELECT id, trader, quote, base, [{', '.join(repr(k) for k in _KINDS)}][id % 9 + 1] AS kind FROM t) "
    "SELECT id, kind, CASE WHEN kind IN ('CURVE_BUY', 'CURVE_SELL', 'SWAP') THEN 'trade' WHEN kind = 'TOKEN_LAUNCHED' THEN 'launch' ELSE 'lifecycle' END AS family, "
    "CASE kind WHEN 'CURVE_BUY' THEN CAST(quote AS VARCHAR) WHEN 'CURVE_SELL' THEN CAST(base AS VARCHAR) WHEN 'SWAP' THEN CAST(quote AS VARCHAR) END AS quote, CASE kind WHEN 'CURVE_BUY' THEN CAST(base AS VARCHAR) WHEN 'CURVE_SELL' THEN CAST(quote AS VARCHAR) WHEN 'SWAP' THEN CAST(base AS VARCHAR) END AS base, "
    "CASE WHEN kind IN ('TOKEN_LAUNCHED', 'LAUNCH_SWEPT', 'POOL_GRADUATED') THEN '0x' || lpad(lower(hex(trader)), 40, '0') END AS token FROM k WHERE kind IS NOT NULL",
)
def src5(spark: SparkSession, d: str) -> DataFrame:
    """Event-log documents as JSON, each delivered twice, read once and decoded by their layouts."""
    path = scratch(spark, "logs")
    topic = {v: k for k, v in corpus.TOPICS.items()}
    word = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("id") % 9).cast("int"))
    first = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k in _KINDS for x in (k, topic[k])]), kind), F.lit("0x00"))
    log = adapters.trades(spark, d).select(
        "id", F.lit("base").alias("chain"), F.lit(8453).alias("chain_id"), F.lit("0xab").alias("address"), F.array(first, *(F.concat(F.lit("0x"), word(F.col("trader"))),) * 3).alias("topics"), F.concat(F.lit("0x"), word(F.col("quote")), word(F.col("base")), word(F.lit(0)), word(F.lit(0)), word(F.lit(0)), word(F.lit(0))).alias("data"),
        F.col("id").alias("block_number"), F.lit(0).alias("transaction_index"), F.lit(0).alias("log_index"), F.concat(F.lit("0x"), word(F.col("id"))).alias("transaction_hash"), F.lit(False).alias("removed"),
    )
    twice = log.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    twice.drop("id", "copy").write.json(path)
    return corpus.typed_logs(corpus.read_logs(spark, path, multi_line=False)).select(F.col("block_number").alias("id"), "kind", "family", "quote", "base", "token")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Trades as stored events: event_id, token, ts, trader, side, quote."""
    t = adapters.trades(spark, d)
    return t.select(F.col("id").cast("string").alias("event_id"), "token", F.timestamp_millis("ms").alias("ts"), "trader", "side", "quote")


@query("snk1_store", f"{WITH} SELECT strftime(to_timestamp(ms / 1000.0) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS events, CAST(sum(quote) AS BIGINT) AS volume FROM t GROUP BY 1")
def snk1(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping deliveries appended to the store: each event stands there once."""
    path, e = scratch(spark, "store"), _events(spark, d)
    i = F.col("event_id").cast("bigint")
    for part in (i % 3 != 0, i % 2 == 0, i % 3 == 0):
        sinks.append_events(e.where(part), path, buckets=2)
    stored = sinks.read_store(spark, path, e.withColumn("day", F.lit("")).schema)
    return stored.groupBy("day").agg(F.count("*").alias("events"), F.sum("quote").alias("volume"))


_BATCH = "max(id) FILTER (id % 2 = {0}) AS o{0}, arg_max(quote, id) FILTER (id % 2 = {0} AND id % 3 <> 0) AS q{0}, arg_max(trader, id) FILTER (id % 2 = {0} AND id % 5 = 0) AS t{0}"


@query(
    "snk2_current",
    f"{WITH}, x AS (SELECT token, {_BATCH.format(0)}, {_BATCH.format(1)} FROM t GROUP BY token) SELECT token, greatest(o0, o1) AS seen, CASE WHEN o1 < o0 THEN coalesce(q0, q1) ELSE coalesce(q1, q0) END AS quote, CASE WHEN o1 < o0 THEN coalesce(t0, t1) ELSE coalesce(t1, t0) END AS trader FROM x",
)
def snk2(spark: SparkSession, d: str) -> DataFrame:
    """Current rows by token from two batches, the second of which is delivered twice; missing values keep old ones."""
    path = scratch(spark, "current")
    i = F.col("id")
    rows = adapters.trades(spark, d).select("token", i.alias("seen"), F.when(i % 3 != 0, F.col("quote")).alias("quote"), F.when(i % 5 == 0, F.col("trader")).alias("trader"))
    for rest in (0, 1, 1):
        sinks.upsert(rows.where(F.col("seen") % 2 == rest), path, ["token"], "seen")
    return spark.read.schema(rows.schema).parquet(path).select("token", "seen", "quote", "trader")


@query("str1_deduplicated", f"{WITH} SELECT token, count(*) AS events FROM t GROUP BY token")
def str1(spark: SparkSession, d: str) -> DataFrame:
    """A stream in which a third of all events is delivered again by a resumed collector."""
    path = scratch(spark, "stream")
    e = _events(spark, d)
    e.write.parquet(f"{path}/in/0")
    e.where(F.col("event_id").cast("bigint") % 3 == 0).write.parquet(f"{path}/in/1")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    s = streams.deduplicated(corpus.read_event_stream(spark, f"{path}/in/*", ddl), delay="3650 days")
    s.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{path}/out").groupBy("token").agg(F.count("*").alias("events"))


@query(
    "str4_milestones",
    f"{WITH} SELECT m.token, CAST(m.age AS BIGINT) AS age, count(a.id) FILTER (side = 'buy') AS buys, count(a.id) FILTER (side = 'sell') AS sells, count(DISTINCT trader) AS unique_traders FROM m LEFT JOIN a ON a.token = m.token AND a.a <= m.age GROUP BY m.token, m.age",
)
def str4(spark: SparkSession, d: str) -> DataFrame:
    """Milestones of all tokens from a stream of launches and trades, with timers for those that never trade."""
    path = scratch(spark, "stream")
    adapters.launches(spark, d).select("token", "launch_ms").write.parquet(f"{path}/launches")
    born = spark.read.parquet(f"{path}/launches")
    t0 = F.floor(F.col("launch_ms") / adapters.SCALE)
    trades = adapters.trades(spark, d).join(born, "token").select("token", (t0 + F.floor((F.col("ms") - F.col("launch_ms")) / adapters.SCALE)).alias("at"), "trader", "side")
    rows = born.select("token", t0.alias("at"), F.lit(None).cast("bigint").alias("trader"), F.lit("launch").alias("side")).unionByName(trades)
    rows.select("token", F.timestamp_millis("at").alias("ts"), "trader", "side").write.parquet(f"{path}/in/0")
    end = spark.read.parquet(f"{path}/in/0").agg(F.max("ts").alias("ts"))
    for k in range(1, 4):  # a clock moves event time on past the last milestone
        later = F.col("ts") + F.make_interval(days=F.lit(k))
        end.select(F.lit("clock").alias("token"), later.alias("ts"), F.lit(None).cast("bigint").alias("trader"), F.lit("tick").alias("side")).write.parquet(f"{path}/in/{k}")
    ddl = "token string, ts timestamp, trader bigint, side string"
    s = corpus.read_event_stream(spark, f"{path}/in/*", ddl, files_per_trigger=10_000)
    s = streams.milestones(s, state.MILESTONES, delay="1 hour")
    s.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("token string, age bigint, buys bigint, sells bigint, unique_traders bigint").parquet(f"{path}/out")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


_KEEP_MS = 6 * 3_600_000


@query(
    "str2_6_late_rebuild",
    f"{WITH}, nw AS (SELECT token, max(ms) AS newest FROM t WHERE id % 10 <> 0 GROUP BY token), lt AS (SELECT t.token, count(*) AS n_late FROM t JOIN nw USING (token) WHERE id % 10 = 0 AND newest - ms > {_KEEP_MS} GROUP BY t.token) "
    "SELECT token, n_late, (SELECT count(*) FROM t WHERE t.token = lt.token) AS n_events, 1 AS version FROM lt",
)
def str2_6(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of all events comes in a second batch: late ones are set apart and their tokens' counts are rebuilt from the store."""
    path, e = scratch(spark, "stream"), _events(spark, d)
    second = F.col("event_id").cast("bigint") % 10 == 0
    for k, part in enumerate((~second, second)):
        e.where(part).coalesce(1).write.parquet(f"{path}/in/{k}")
    into = streams.rebuild_into(f"{path}/counts", f"{path}/store", e.schema, lambda x: x.groupBy("token").agg(F.lit(0).cast("bigint").alias("age"), F.count("*").alias("n_events")))
    s = corpus.read_event_stream(spark, f"{path}/in/*", _ddl(e), files_per_trigger=1)
    streams.route_late(s, f"{path}/store", f"{path}/late", f"{path}/check", _KEEP_MS, versions=into).awaitTermination()
    late = sinks.committed(spark, f"{path}/late", e.withColumn("batch", F.lit(0)).schema).groupBy("token").agg(F.count("*").alias("n_late"))
    kind = spark.createDataFrame([], "token string, age bigint, n_events bigint, version int").schema
    return late.join(streams.current_version(spark, f"{path}/counts", kind), "token").select("token", "n_late", "n_events", "version")


@query("str8_shards", f"{WITH} SELECT CAST(id % 4 AS VARCHAR) AS shard, count(*) AS n_rows, count(DISTINCT token) AS tokens, CAST(sum(quote) AS BIGINT) AS volume FROM t GROUP BY 1")
def str8(spark: SparkSession, d: str) -> DataFrame:
    """Shard files as a stream, begun twice: the second start finds every shard done."""
    path, e = scratch(spark, "stream"), _events(spark, d)
    e = e.withColumn("shard", (F.col("event_id").cast("bigint") % 4).cast("string"))
    for k in range(4):
        e.where(F.col("shard") == str(k)).coalesce(1).write.parquet(f"{path}/in/{k}")
    for _ in range(2):
        s = corpus.read_event_stream(spark, f"{path}/in/*", _ddl(e), files_per_trigger=1)
        streams.shard_statistics(s, f"{path}/out", f"{path}/check").awaitTermination()
    kind = spark.createDataFrame([], "shard string, n_rows bigint, tokens bigint, volume bigint, batch int").schema
    return sinks.committed(spark, f"{path}/out", kind).drop("batch")
