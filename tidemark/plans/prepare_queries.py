"""Preparation, identity and join queries (PRE, JN, SET, SNK)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, joins, prepare
from tidemark.plans.base import query
from tidemark.sources import adapters
from tidemark.sources.adapters import PART_SQL, SQL

WITH = f"WITH {SQL}"
_TXT = "CAST({} AS VARCHAR)"


@query("pre1_event_identity", f"{WITH} SELECT id, sha256('corpus|' || token || '|' || {_TXT.format('id')}) AS event_id FROM t")
def pre1(spark, d):
    t = adapters.trades(spark, d)
    return t.select("id", prepare.event_id(F.lit("corpus"), corpus=[F.col("token"), F.col("id")]).alias("event_id"))


@query("pre2_total_order", f"{WITH} SELECT token, id, row_number() OVER (PARTITION BY token ORDER BY ms, id) AS position FROM t")
def pre2(spark, d):
    t = adapters.trades(spark, d)
    none = F.lit(None)
    key = prepare.order_key(F.col("ms"), none, F.col("id"), none, none, F.col("kind"))
    return t.select("token", "id", F.row_number().over(Window.partitionBy("token").orderBy(key)).alias("position"))


@query("pre3_hex_addresses", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '0x' || lower(hex(CAST(l_partkey AS VARCHAR))) AS address FROM lineitem")
def pre3(spark, d):
    from tidemark.functions.hexwords import normal_hex

    raw = F.concat(F.lit(" 0X"), F.hex(F.col("l_partkey").cast("string").cast("binary")), F.lit(" "))
    return adapters._read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", normal_hex(raw).alias("address"))


@query("pre4_first_delivery", f"{WITH}, twice AS (SELECT *, 1 AS copy FROM t UNION ALL SELECT *, 2 FROM t WHERE id % 3 = 0) SELECT id, min(copy) AS copy, count(*) AS deliveries FROM twice GROUP BY id")
def pre4(spark, d):
    t = adapters.trades(spark, d)
    twice = t.withColumn("copy", F.lit(1)).unionByName(t.where("id % 3 = 0").withColumn("copy", F.lit(2)))
    first = prepare.first_of_each(twice, ["id"], ["copy"]).select("id", "copy")
    more = prepare.duplicates(twice, ["id"])
    return first.join(more, "id", "left").select("id", "copy", F.coalesce("deliveries", F.lit(1)).cast("bigint").alias("deliveries"))


@query(
    "pre5_heartbeats",
    f"WITH {PART_SQL}, x AS (SELECT *, lag((day, side, trader // 50)) OVER (PARTITION BY token ORDER BY day, line) AS before FROM p) "
    "SELECT token, count(*) AS trades FROM x WHERE before IS NULL OR before <> (day, side, trader // 50) GROUP BY token",
)
def pre5(spark, d):
    p = adapters.part_trades(spark, d).withColumn("wallet", F.floor(F.col("trader") / 50))
    return prepare.without_heartbeats(p, ["day", "side", "wallet"], ["day", "line"]).groupBy("token").agg(F.count("*").alias("trades"))


@query(
    "pre6_amount_class",
    "WITH x AS (SELECT l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(l_partkey AS VARCHAR) WHEN 2 THEN CAST(l_quantity AS VARCHAR) ELSE CAST(l_discount + 0.001 AS VARCHAR) END AS amount, l_quantity, l_partkey FROM lineitem) "
    "SELECT CASE n % 4 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'ONCHAIN_INTEGER' WHEN 2 THEN 'INTEGER_VALUED_FLOAT' ELSE 'FLOAT_NOT_INTEGER' END AS amount_quality, count(*) AS n_rows, "
    "CAST(sum(CASE n % 4 WHEN 1 THEN l_partkey WHEN 2 THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS total FROM x GROUP BY 1",
)
def pre6(spark, d):
    n = F.col("l_linenumber") % 4
    text = F.when(n == 1, F.col("l_partkey").cast("string")).when(n == 2, F.col("l_quantity").cast("string")).when(n == 3, (F.col("l_discount") + 0.001).cast("string"))
    kind, value = prepare.classify_amount(text)
    rows = adapters._read(spark, d, "lineitem").select(kind.alias("amount_quality"), value.cast("bigint").alias("v"))
    return rows.groupBy("amount_quality").agg(F.count("*").alias("n_rows"), F.sum("v").alias("total"))


@query(
    "pre7_label_quality",
    f"{WITH}, x AS (SELECT token, CASE WHEN kind = 'error' THEN NULL ELSE price - 1 END AS price FROM t), y AS (SELECT token, count(*) AS n, count(*) FILTER (price IS NULL) AS missing, count(*) FILTER (price <= 0) AS bad FROM x GROUP BY token) "
    "SELECT token, CASE WHEN n = 0 OR missing * 2 > n OR bad > 0 THEN 'INVALID' WHEN missing * 10 > n THEN 'PARTIAL' ELSE 'VALID' END AS quality FROM y",
)
def pre7(spark, d):
    t = adapters.trades(spark, d).withColumn("price", F.when(F.col("kind") != "error", F.col("price") - 1))
    missing, bad = F.count_if(F.col("price").isNull()), F.count_if(F.col("price").isNotNull() & ~prepare.price_valid(F.col("price")))
    return t.groupBy("token").agg(prepare.label_quality(F.count("*"), missing, bad).alias("quality"))


_CURVES = "CASE WHEN CAST(token AS INT) % 5 < 4 THEN 'curve' || token END"


def _market(spark, d):
    """Launches know the curve, lifecycle rows (error events) bring the pool."""
    k = F.col("token").cast("int") % 5
    t = adapters.trades(spark, d)
    none = F.lit(None).cast("string")
    launch = t.groupBy("chain", "token").agg(F.min("ms").alias("ms")).select("chain", "token", F.when(k < 4, F.concat(F.lit("curve"), "token")).alias("curve"), none.alias("pool"), F.lit("usd").alias("quote_asset"), "ms")
    cycle = t.where("kind = 'error'").select("chain", "token", none.alias("curve"), F.when(k != 3, F.concat(F.lit("pool"), "token", F.lit("_"), (F.col("id") % 2).cast("string"))).alias("pool"), none.alias("quote_asset"), "ms")
    return prepare.market_registry(launch, cycle)


_REGISTRY = f"r AS (SELECT chain, token, {_CURVES} AS curve, (SELECT arg_max('pool' || e.token || '_' || (e.id % 2), e.ms) FROM t e WHERE e.token = x.token AND e.kind = 'error' AND CAST(e.token AS INT) % 5 <> 3) AS pool, 'usd' AS quote_asset FROM (SELECT DISTINCT chain, token FROM t) x)"


@query("pre10_market_registry", f"{WITH}, {_REGISTRY} SELECT * FROM r")
def pre10(spark, d):
    return _market(spark, d)


@query(
    "pre8_9_market_resolution",
    f"{WITH}, {_REGISTRY}, x AS (SELECT id, chain, token AS real, CASE WHEN id % 3 = 0 THEN token ELSE '' END AS token, 'curve' || token AS curve, CASE WHEN id % 3 = 1 THEN 'pool' || token || '_0' END AS pool FROM t) "
    "SELECT id, coalesce(nullif(x.token, ''), c.token, q.token, x.curve, x.pool) AS token, coalesce(nullif(x.token, ''), c.token, q.token) IS NOT NULL AS resolved FROM x LEFT JOIN r c ON x.chain = c.chain AND x.curve = c.curve LEFT JOIN r q ON x.chain = q.chain AND x.pool = q.pool",
)
def pre8(spark, d):
    k = F.col("id") % 3
    t = adapters.trades(spark, d)
    rows = t.select("id", "chain", F.when(k == 0, F.col("token")).otherwise("").alias("token"), F.concat(F.lit("curve"), "token").alias("curve"), F.when(k == 1, F.concat(F.lit("pool"), "token", F.lit("_0"))).alias("pool"))
    return prepare.resolve_markets(rows, _market(spark, d)).select("id", "token", "resolved")


@query("pre11_orphans", f"{WITH} SELECT token, count(*) FILTER (id % 7 <> 0) AS canonical, count(*) FILTER (id % 7 = 0) AS orphaned FROM t GROUP BY token")
def pre11(spark, d):
    t = adapters.trades(spark, d).withColumn("event_id", F.col("id"))
    marked = prepare.mark_orphans(t, t.where("id % 7 = 0").select("event_id"))
    return marked.groupBy("token").agg(F.count_if(F.col("canonical_status") == "CANONICAL").alias("canonical"), F.count_if(F.col("canonical_status") == "ORPHANED").alias("orphaned"))


@query("pre12_lags", f"{WITH} SELECT id, id % 50 AS discovery_lag_ms, id % 11 AS persist_lag_ms, id % 50 + id % 11 AS ingest_lag_ms FROM t")
def pre12(spark, d):
    t = adapters.trades(spark, d).select("id", F.col("ms").alias("chain_ms"), (F.col("ms") + F.col("id") % 50).alias("seen_ms"))
    return prepare.with_lags(t.withColumn("stored_ms", F.col("seen_ms") + F.col("id") % 11)).select("id", "discovery_lag_ms", "persist_lag_ms", "ingest_lag_ms")


@query("pre13_successful", f"{WITH} SELECT token, count(*) AS trades FROM t WHERE kind <> 'error' GROUP BY token")
def pre13(spark, d):
    t = adapters.trades(spark, d).withColumn("execution_status", F.when(F.col("kind") == "error", "failed").otherwise("success"))
    return prepare.successful(t).groupBy("token").agg(F.count("*").alias("trades"))


@query("pre14_provisional_launches", f"{WITH} SELECT token, min(ms) AS launch_ms, CAST(NULL AS BIGINT) AS creator FROM t WHERE CAST(token AS INT) % 4 = 0 GROUP BY token")
def pre14(spark, d):
    known = adapters.launches(spark, d).where("try_cast(token AS INT) % 4 <> 0")
    return prepare.provisional_launches(adapters.trades(spark, d), known)


@query("pre15_swap_side", f"{WITH} SELECT CASE WHEN side = 'buy' THEN 'buy' ELSE 'sell' END AS side, CAST(sum(quote) AS BIGINT) AS amount FROM t WHERE quote > 0 GROUP BY 1")
def pre15(spark, d):
    t = adapters.trades(spark, d).where("quote > 0").withColumn("amount1", F.when(F.col("side") == "buy", -F.col("quote")).otherwise(F.col("quote")))
    return t.groupBy(prepare.swap_side(F.col("amount1")).alias("side")).agg(F.sum(F.abs("amount1")).alias("amount"))


_NOW = "(SELECT token, id, ms FROM t WHERE side = 'sell')"


def _sides(spark, d):
    t = adapters.trades(spark, d)
    return t.where("side = 'sell'").select("token", "id", "ms"), t.where("side = 'buy'").select("token", F.col("id").alias("buy_id"), F.col("ms").alias("buy_ms"), "price")


def _asof_sql(shift: str) -> str:
    return f"{WITH}, s AS {_NOW}, b AS (SELECT token, id AS buy_id, ms AS buy_ms, price FROM t WHERE side = 'buy') SELECT s.token, s.id, b.buy_id, b.price FROM s ASOF LEFT JOIN b ON s.token = b.token AND {shift} >= b.buy_ms"


@query("jn1_as_of", _asof_sql("s.ms"))
def jn1(spark, d, shift=0):
    left, right = _sides(spark, d)
    out = asof.as_of(left, right, ["token"], F.col("ms") - shift, F.col("buy_ms"), ["buy_ms", "buy_id"], "r")
    return out.select("token", "id", "r.buy_id", "r.price")


@query("jn2_as_of_lookback", _asof_sql("s.ms - 30 * 3600000"))
def jn2(spark, d):
    return jn1(spark, d, 30 * 3600000)


@query("jn3_as_of_capped", _asof_sql("least(s.ms, 1705000000000)"))
def jn3(spark, d):
    left, right = _sides(spark, d)
    out = asof.as_of(left, right, ["token"], F.least("ms", F.lit(1705000000000)), F.col("buy_ms"), ["buy_ms", "buy_id"], "r")
    return out.select("token", "id", "r.buy_id", "r.price")


@query("jn4_latest_row", f"{WITH} SELECT token, trader, arg_max(id, (ms, id)) AS id, arg_max(price, (ms, id)) AS price FROM t GROUP BY token, trader")
def jn4(spark, d):
    return asof.latest(adapters.trades(spark, d).select("token", "trader", "ms", "id", "price"), ["token", "trader"], ["ms", "id"]).select("token", "trader", "id", "price")


@query("jn5_fills_without_position", f"{WITH} SELECT b.token, b.trader, count(*) AS fills FROM t b WHERE side = 'buy' AND NOT EXISTS (SELECT 1 FROM t s WHERE s.side = 'sell' AND s.token = b.token AND s.trader = b.trader) GROUP BY ALL")
def jn5(spark, d):
    t = adapters.trades(spark, d)
    return joins.unmatched(t.where("side = 'buy'"), t.where("side = 'sell'"), ["token", "trader"])


@query("jn6_positions_without_fill", f"{WITH} SELECT s.token, s.trader, min(s.id) AS first_id FROM t s WHERE side = 'sell' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.side = 'buy' AND s.token = b.token AND s.trader = b.trader AND b.ms <= s.ms) GROUP BY ALL")
def jn6(spark, d):
    t = adapters.trades(spark, d)
    return joins.unopened(t.where("side = 'sell'"), t.where("side = 'buy'"), ["token", "trader"], "ms")


@query("jn7_early_entries", f"{WITH} SELECT t.id, t.token FROM t JOIN l USING (token) WHERE side = 'buy' AND launch_ms < 1704100000000")
def jn7(spark, d):
    return joins.launched_before(adapters.trades(spark, d).where("side = 'buy'"), adapters.launches(spark, d), 1704100000000).select("id", "token")


@query(
    "jn8_reconcile",
    f"{WITH}, x AS (SELECT kind AS event, coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS live, b.id IS NOT NULL AS back FROM (SELECT kind, id FROM t WHERE id % 5 <> 0) a FULL JOIN (SELECT kind, id FROM t WHERE id % 7 <> 0) b USING (kind, id)) "
    "SELECT event, count(*) FILTER (live) AS live, count(*) FILTER (back) AS backfill, count(*) FILTER (live AND back) AS both_sets, count(*) FILTER (live AND NOT back) AS live_only, count(*) FILTER (back AND NOT live) AS backfill_only, round(100.0 * count(*) FILTER (live AND back) / count(*), 3) AS match_pct FROM x GROUP BY event",
)
def jn8(spark, d):
    t = adapters.trades(spark, d).select(F.col("kind").alias("event"), "id")
    return joins.compare_deliveries(t.where("id % 5 <> 0"), t.where("id % 7 <> 0"), "event", "id")


@query("set1_distinct_union", f"{WITH} SELECT token, trader FROM t WHERE kind = 'click' UNION SELECT token, trader FROM t WHERE kind = 'view' UNION SELECT token, trader FROM t WHERE kind = 'purchase'")
def set1(spark, d):
    t = adapters.trades(spark, d)
    of = lambda k: t.where(F.col("kind") == k).select("token", "trader")
    return joins.distinct_union(of("click"), of("view"), of("purchase"))


@query("set2_intersect_and_subtract", f"{WITH}, f AS (SELECT token, trader FROM t WHERE kind = 'click'), s AS (SELECT token, trader FROM t WHERE kind = 'view') SELECT 'both' AS part, * FROM (SELECT * FROM f INTERSECT SELECT * FROM s) UNION ALL SELECT 'first_only', * FROM (SELECT * FROM f EXCEPT SELECT * FROM s)")
def set2(spark, d):
    t = adapters.trades(spark, d)
    a, b = (t.where(F.col("kind") == k).select("token", "trader") for k in ("click", "view"))
    return joins.shared_and_first_only(a, b)


@query("set3_arm_matrix", "SELECT 'P' || r_regionkey || ':' || 'X' || n_nationkey AS arm_id, r_regionkey AS entry, n_nationkey AS exit FROM region, nation WHERE n_nationkey < 3")
def set3(spark, d):
    entry = adapters._read(spark, d, "region").select(F.col("r_regionkey").alias("entry"))
    leave = adapters._read(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("exit"))
    return joins.arm_matrix(entry, leave)


@query("set4_claim_once", f"{WITH} SELECT token, trader, min(ms) AS claimed_ms FROM t WHERE side = 'buy' AND (token, trader) NOT IN (SELECT token, trader FROM t WHERE kind = 'error') GROUP BY ALL")
def set4(spark, d):
    from tidemark.sources.sinks import unclaimed

    t = adapters.trades(spark, d)
    return unclaimed(t.where("side = 'buy'").select("token", "trader", F.col("ms").alias("claimed_ms")), t.where("kind = 'error'").select("token", "trader"), ["token", "trader"], "claimed_ms")


@query("snk2_current_rows", f"{WITH}, x AS (SELECT token, ms, id, CASE WHEN side = 'buy' THEN price END AS bid, CASE WHEN side = 'sell' THEN price END AS ask FROM t) SELECT token, max(ms) AS ms, arg_max(bid, (ms, id)) FILTER (bid IS NOT NULL) AS bid, arg_max(ask, (ms, id)) FILTER (ask IS NOT NULL) AS ask FROM x GROUP BY token")
def snk2(spark, d):
    t = adapters.trades(spark, d).select("token", "ms", "id", F.when(F.col("side") == "buy", F.col("price")).alias("bid"), F.when(F.col("side") == "sell", F.col("price")).alias("ask"))
    return asof.coalesced(t, ["token"], ["ms", "id"]).select("token", "ms", "bid", "ask")


@query("snk3_ordered_export", f"{WITH} SELECT ms, id, token FROM t WHERE chain = 'c1' ORDER BY ms, id LIMIT 100")
def snk3(spark, d):
    return adapters.trades(spark, d).where("chain = 'c1'").orderBy("ms", "id").limit(100).select("ms", "id", "token")
