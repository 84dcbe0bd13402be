"""Snapshot state queries (ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.amounts import bps_capped
from tidemark.operators import asof, state
from tidemark.plans.base import query
from tidemark.sources import adapters
from tidemark.sources.adapters import SQL

_MILE = ", ".join(map(str, state.MILESTONES))
#: Queries on milestones keep the output small; the grid query covers the bands.
GRID = f"""
g AS (SELECT token, age, CASE WHEN age IN ({_MILE}) THEN 'MILESTONE' ELSE 'BAND' END AS kind FROM l,
      (SELECT unnest(list_distinct([{_MILE}] || range(5000, 300001, 5000) || range(315000, 1800001, 15000) || range(1860000, 7200001, 60000))) AS age)),
m AS (SELECT * FROM g WHERE kind = 'MILESTONE')
"""
WITH = f"WITH {SQL}, {GRID}"


def ticks(spark, d, milestones=True):
    g = state.grid(adapters.launches(spark, d))
    return g.where("kind = 'MILESTONE'") if milestones else g


@query("st1_snapshot_grid", f"{WITH} SELECT token, CAST(age AS BIGINT) AS age, kind FROM g")
def st1(spark, d):
    return ticks(spark, d, False)


_ON = "LEFT JOIN a ON a.token = m.token AND a.a <= m.age GROUP BY m.token, m.age"
_B, _S, _C = "FILTER (side = 'buy')", "FILTER (side = 'sell')", "FILTER (mine AND side = '{}')"


def _big(x: str, name: str) -> str:
    return f"CAST(coalesce({x}, 0) AS BIGINT) AS {name}"


def _cumulative(columns: dict[str, str]):
    names = list(columns)
    sql = f"{WITH} SELECT m.token, CAST(m.age AS BIGINT) AS age, {', '.join(_big(x, n) for n, x in columns.items())} FROM m {_ON}"
    return sql, lambda spark, d: state.cumulative(adapters.aged(spark, d), ticks(spark, d), state.MILESTONES).select("token", "age", *names)


for _name, _columns in {
    "st4_cumulative_totals": {"buys": f"count(a.id) {_B}", "sells": f"count(a.id) {_S}", "buy_quote": f"sum(quote) {_B}", "sell_quote": f"sum(quote) {_S}", "buy_base": f"sum(base) {_B}", "sell_base": f"sum(base) {_S}"},
    "st5_unique_traders": {"unique_buyers": f"count(DISTINCT trader) {_B}", "unique_sellers": f"count(DISTINCT trader) {_S}", "unique_traders": "count(DISTINCT trader)"},
    "st7_creator_flow": {"creator_buys": f"count(*) {_C.format('buy')}", "creator_sells": f"count(*) {_C.format('sell')}", "creator_buy_quote": f"sum(quote) {_C.format('buy')}", "creator_sell_quote": f"sum(quote) {_C.format('sell')}"},
}.items():
    _sql, _run = _cumulative(_columns)
    query(_name, _sql)(_run)


@query("st2_dead_tokens", f"{WITH} SELECT token, count(*) AS rows_seen, CAST(0 AS BIGINT) AS trades FROM m WHERE token LIKE 'dead%' GROUP BY token")
def st2(spark, d):
    c = state.cumulative(adapters.aged(spark, d), ticks(spark, d), state.MILESTONES)
    return c.where("token LIKE 'dead%'").groupBy("token").agg(F.count("*").alias("rows_seen"), F.sum(F.col("buys") + F.col("sells")).alias("trades"))


@query(
    "st6_trade_ages",
    f"{WITH} SELECT m.token, CAST(m.age AS BIGINT) AS age, min(a.a) AS first_trade_age, max(a.a) AS last_trade_age, max(a.a) {_B} AS last_buy_age, max(a.a) {_S} AS last_sell_age, max(a.a) {_C.format('sell')} AS creator_last_sell_age FROM m {_ON}",
)
def st6(spark, d):
    return state.last_ages(adapters.aged(spark, d), ticks(spark, d)).drop("kind")


def _window_sql(columns, windows=state.WINDOWS):
    cols = ", ".join(_big(x.format(w=f"a.a > m.age - {w * 1000}"), f"w{w}_{n}") for w in windows for n, x in columns.items())
    return f"{WITH}, a2 AS (SELECT *, row_number() OVER (PARTITION BY token, trader, side ORDER BY a, id) = 1 AS fresh FROM a) SELECT m.token, CAST(m.age AS BIGINT) AS age, {cols} FROM m {_ON.replace('JOIN a ON', 'JOIN a2 a ON')}"


def _rolling(names):
    return lambda spark, d: state.rolling(adapters.aged(spark, d), ticks(spark, d), ages=state.MILESTONES, kinds=("unique",) if all(n.startswith("unique") for n in names) else ("flow",)).select("token", "age", *(f"w{w}_{n}" for w in state.WINDOWS for n in names))


#: All window columns, by query.
_WINDOWED = {
    "st8_rolling_flow": {f"{s}s": f"count(*) FILTER (side = '{s}' AND {{w}})" for s in state.SIDES} | {f"{s}_quote": f"sum(quote) FILTER (side = '{s}' AND {{w}})" for s in state.SIDES} | {f"creator_{s}_quote": f"sum(quote) FILTER (mine AND side = '{s}' AND {{w}})" for s in state.SIDES},
    "st9_rolling_unique": {f"unique_{s}ers": f"count(DISTINCT trader) FILTER (side = '{s}' AND {{w}})" for s in state.SIDES},
    "st10_rolling_new": {f"new_{s}ers": f"count(*) FILTER (fresh AND side = '{s}' AND {{w}})" for s in state.SIDES},
}
for _name, _columns in _WINDOWED.items():
    query(_name, _window_sql(_columns))(_rolling(list(_columns)))


@query(
    "st11_trade_sizes",
    f"{WITH}, x AS (SELECT m.token, m.age, min(quote) AS min_size, max(quote) AS max_size, list_sort(list(quote) FILTER (quote IS NOT NULL)) AS q FROM m LEFT JOIN a ON a.token = m.token AND a.a <= m.age AND a.a > m.age - 900000 GROUP BY ALL) "
    "SELECT token, CAST(age AS BIGINT) AS age, min_size, max_size, q[(len(q) + 1) // 2] + (q[len(q) // 2 + 1] - q[(len(q) + 1) // 2]) // 2 AS median_size FROM x",
)
def st11(spark, d):
    return state.rolling_sizes(adapters.aged(spark, d), ticks(spark, d), 900, state.MILESTONES).drop("kind")


@query(
    "st12_concentration",
    f"{WITH}, p AS (SELECT m.token, m.age, trader, count(*) {_B} AS b, count(*) AS n, sum(quote) AS v FROM m JOIN a ON a.token = m.token AND a.a <= m.age GROUP BY ALL), "
    "x AS (SELECT token, age, count(*) FILTER (b > 1) AS r, count(*) FILTER (b > 0) AS buyers, sum(b) AS buys, max(n) AS tn, sum(n) AS n, max(v) AS tv, sum(v) AS v, list_sort(list(b) FILTER (b > 0)) AS per FROM p GROUP BY ALL) "
    "SELECT m.token, CAST(m.age AS BIGINT) AS age, coalesce(r, 0) AS repeat_buyers, CAST(CASE WHEN buyers > 0 THEN buys * 1000 // buyers END AS BIGINT) AS mean_buys_x1000, per[len(per) // 2 + 1] AS median_buys, CAST(tn * 10000 // n AS BIGINT) AS top_trader_trades_bps, CAST(CASE WHEN v > 0 THEN tv * 10000 // v END AS BIGINT) AS top_trader_volume_bps FROM m LEFT JOIN x USING (token, age)",
)
def st12(spark, d):
    return state.concentration(adapters.aged(spark, d), ticks(spark, d), state.MILESTONES).drop("kind")


def lifecycle(spark, d):
    """Errors start a migration, the first purchase after ends it; views are snipe taxes."""
    a = adapters.aged(spark, d)
    types = F.when(F.col("kind") == "error", "MIGRATION_STARTED").when(F.col("kind") == "purchase", "MIGRATED").when(F.col("kind") == "view", "SNIPE_TAX")
    return a.select("token", "a", "id", types.alias("type"), F.col("quote").alias("amount")).where("type IS NOT NULL")


CYCLE = "y AS (SELECT token, a, id, CASE kind WHEN 'error' THEN 'MIGRATION_STARTED' WHEN 'purchase' THEN 'MIGRATED' WHEN 'view' THEN 'SNIPE_TAX' END AS type, quote AS amount FROM a WHERE kind IN ('error', 'purchase', 'view'))"


@query("st3_triggered_snapshots", f"{WITH}, {CYCLE} SELECT token, a AS age, type AS trigger FROM y WHERE type <> 'SNIPE_TAX' UNION ALL SELECT token, min(a), 'FIRST_TRADE' FROM a GROUP BY token UNION ALL SELECT token, min(a), 'AMM_FIRST_TRADE' FROM (SELECT a.token, a.a, arg_max(type, (y.a, y.id)) AS s FROM a JOIN y ON y.token = a.token AND type <> 'SNIPE_TAX' AND (y.a, y.id) <= (a.a, a.id) GROUP BY a.token, a.a, a.id) WHERE s = 'MIGRATED' GROUP BY token")
def st3(spark, d):
    return state.triggered(lifecycle(spark, d), adapters.aged(spark, d))


@query(
    "st13_lifecycle_state",
    f"{WITH}, {CYCLE} SELECT m.token, CAST(m.age AS BIGINT) AS age, coalesce(CASE arg_max(type, (y.a, y.id)) FILTER (type <> 'SNIPE_TAX') WHEN 'MIGRATED' THEN 'AMM_ACTIVE' WHEN 'MIGRATION_STARTED' THEN 'MIGRATING' END, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.token = m.token AND a.a <= m.age) THEN 'CURVE_ACTIVE' END, 'DISCOVERED') AS state FROM m LEFT JOIN y ON y.token = m.token AND y.a <= m.age GROUP BY m.token, m.age",
)
def st13(spark, d):
    return state.lifecycle_state(lifecycle(spark, d), adapters.aged(spark, d), ticks(spark, d)).drop("kind")


_PAD = "CASE chain WHEN 'c0' THEN 'pumpfun' WHEN 'c1' THEN 'clanker_v4' ELSE 'pumpswap' END"


@query(
    "st13_by_launchpad",
    f"{WITH}, {CYCLE} SELECT m.token, CAST(m.age AS BIGINT) AS age, coalesce(CASE arg_max(type, (y.a, y.id)) FILTER (type <> 'SNIPE_TAX') WHEN 'MIGRATED' THEN 'AMM_ACTIVE' WHEN 'MIGRATION_STARTED' THEN 'MIGRATING' END, CASE WHEN any_value({_PAD}) IN ('clanker_v4', 'pumpswap') THEN 'AMM_ACTIVE' END, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.token = m.token AND a.a <= m.age) THEN 'CURVE_ACTIVE' END, 'DISCOVERED') AS state FROM m JOIN l USING (token) LEFT JOIN y ON y.token = m.token AND y.a <= m.age GROUP BY m.token, m.age",
)
def st13_pads(spark, d):
    pad = F.when(F.col("chain") == "c0", "pumpfun").when(F.col("chain") == "c1", "clanker_v4").otherwise("pumpswap")
    launches = adapters.launches(spark, d).select("token", pad.alias("launchpad"))
    return state.lifecycle_state(lifecycle(spark, d), adapters.aged(spark, d), ticks(spark, d), launches).drop("kind")


#: Market data made of trades: curves, square-root prices, pools with and without a name, and plain trades.
_MARKET = f"""
k AS (SELECT token, a, id, quote, base, CASE WHEN id % 5 = 0 THEN CAST((1000000 + quote) * CAST(1000000000000 AS HUGEINT) AS VARCHAR) END AS vq, CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN CAST((1000000 - a % 300000) * CAST(1000000000000000 AS HUGEINT) AS VARCHAR) END AS vb,
        CASE WHEN id % 5 = 0 THEN CAST(quote AS VARCHAR) END AS rq, CASE WHEN id % 5 = 1 THEN CAST((79228162514 + id) * CAST(1000000000000000000 AS HUGEINT) AS VARCHAR) END AS sp, CASE WHEN id % 5 = 1 AND id % 3 <> 0 THEN CAST(quote * CAST(10000000000 AS HUGEINT) AS VARCHAR) END AS liq,
        CASE WHEN id % 5 = 1 THEN CAST(a % 1000 - 500 AS VARCHAR) END AS tick, CASE WHEN id % 2 = 0 THEN 'p' || id % 7 END AS pool, id % 5 IN (2, 3) AS on_pool FROM a),
k1 AS (SELECT *, CASE WHEN vq IS NOT NULL OR vb IS NOT NULL THEN 'BONDING_CURVE' WHEN sp IS NOT NULL THEN 'UNISWAP_V4' WHEN on_pool AND pool IS NOT NULL THEN 'CONSTANT_PRODUCT' END AS sets FROM k),
k2 AS (SELECT *, last_value(sets IGNORE NULLS) OVER (PARTITION BY token ORDER BY a, id) AS mt FROM k1),
k3 AS (SELECT *, (sets = mt OR (on_pool AND mt = 'CONSTANT_PRODUCT')) AND mt <> 'UNISWAP_V4' AS own FROM k2),
mk AS (SELECT m.token, CAST(m.age AS BIGINT) AS age, arg_max(k3.mt, (a, id)) AS mt, max((a, id)) FILTER (sets <> 'UNISWAP_V4') AS other, max((a, id)) FILTER (sets = 'UNISWAP_V4' AND pool IS NOT NULL) AS v4_at, arg_max(pool, (a, id)) FILTER (sets = 'UNISWAP_V4' AND pool IS NOT NULL) AS v4_pool,
         arg_max({{vq: vq, vb: vb, rq: rq, sp: sp, liq: liq, tick: tick, pool: pool}}, (a, id)) FILTER (sets IS NOT NULL) AS s, arg_max({{q: quote, b: base}}, (a, id)) AS tr, arg_max({{q: quote, b: base}}, (a, id)) FILTER (own) AS am,
         CAST(arg_min(vb, (a, id)) FILTER (sets = 'BONDING_CURVE' AND vb IS NOT NULL) AS HUGEINT) AS fb, CAST((arg_max({{v: vb}}, (a, id)) FILTER (sets = 'BONDING_CURVE')).v AS HUGEINT) AS cb
       FROM m LEFT JOIN k3 ON k3.token = m.token AND k3.a <= m.age GROUP BY m.token, m.age)
"""


@query(
    "st14_market",
    f"{WITH}, {_MARKET} SELECT token, age, coalesce(mt, 'UNKNOWN') AS market_type, CASE WHEN mt = 'BONDING_CURVE' THEN s.vq END AS v_quote, CASE WHEN mt = 'BONDING_CURVE' THEN s.vb END AS v_base, CASE WHEN mt = 'BONDING_CURVE' THEN s.rq END AS real_quote, CAST(NULL AS VARCHAR) AS real_base, "
    "CASE WHEN mt = 'UNISWAP_V4' THEN s.sp END AS sqrt_price, CASE WHEN mt = 'UNISWAP_V4' THEN s.liq END AS liquidity, CASE WHEN mt = 'UNISWAP_V4' THEN s.tick END AS tick, CASE mt WHEN 'UNISWAP_V4' THEN CASE WHEN other IS NULL OR v4_at > other THEN v4_pool END WHEN 'CONSTANT_PRODUCT' THEN s.pool END AS pool, "
    "CASE WHEN mt IN ('BONDING_CURVE', 'CONSTANT_PRODUCT') THEN CAST(am.q AS VARCHAR) END AS last_quote, CASE WHEN mt IN ('BONDING_CURVE', 'CONSTANT_PRODUCT') THEN CAST(am.b AS VARCHAR) END AS last_base, CASE WHEN mt IN ('BONDING_CURVE', 'UNISWAP_V4') THEN 'COMPLETE' WHEN mt = 'CONSTANT_PRODUCT' THEN 'PARTIAL' ELSE 'UNKNOWN' END AS quality, "
    "CAST(CASE WHEN mt = 'BONDING_CURVE' THEN CAST(s.vq AS HUGEINT) * 1000000000000000000 // CAST(s.vb AS HUGEINT) WHEN mt = 'CONSTANT_PRODUCT' THEN NULL ELSE CAST(tr.q AS HUGEINT) * 1000000000000000000 // tr.b END AS VARCHAR) AS price_x18, "
    "CAST(CASE WHEN cb IS NOT NULL AND fb > 0 THEN least(greatest(fb - cb, 0) * 10000 // fb, 10000) END AS BIGINT) AS curve_progress_bps FROM mk",
)
def st14_market(spark, d):
    times = lambda x, zeros: F.concat(x.cast("string"), F.lit("0" * zeros))
    k = F.col("id") % 5
    t = adapters.aged(spark, d).select(
        "token", "a", "id", "quote", "base", F.when(k == 0, times(1_000_000 + F.col("quote"), 12)).alias("v_quote"), F.when((k == 0) & (F.col("id") % 10 != 0), times(1_000_000 - F.col("a") % 300_000, 15)).alias("v_base"),
        F.when(k == 0, F.col("quote").cast("string")).alias("real_quote"), F.lit(None).cast("string").alias("real_base"), F.when(k == 1, times(79_228_162_514 + F.col("id"), 18)).alias("sqrt_price"), F.when((k == 1) & (F.col("id") % 3 != 0), times(F.col("quote"), 10)).alias("liquidity"),
        F.when(k == 1, (F.col("a") % 1000 - 500).cast("string")).alias("tick"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), (F.col("id") % 7).cast("string"))).alias("pool"), k.isin(2, 3).alias("on_pool"),
    )
    return state.market(t, ticks(spark, d)).drop("kind")


def _reserved(spark, d):
    return adapters.aged(spark, d).withColumn("v_quote", F.when(F.col("side") == "buy", 1000000 + F.col("quote"))).withColumn("v_base", F.when(F.col("id") % 3 != 0, 1000000 - F.col("a") % 300000))


@query(
    "st14_15_reserves",
    f"{WITH}, x AS (SELECT m.token, m.age, arg_max(1000000 + quote, (a, id)) {_B} AS v_quote, arg_max(1000000 - a % 300000, (a, id)) FILTER (id % 3 <> 0) AS v_base, arg_min(1000000 - a % 300000, (a, id)) FILTER (id % 3 <> 0) AS f FROM m {_ON}) "
    "SELECT token, CAST(age AS BIGINT) AS age, v_quote, v_base, CASE WHEN f > 0 THEN least(greatest(f - v_base, 0) * 10000 // f, 10000) END AS curve_progress_bps FROM x",
)
def st14(spark, d):
    return state.reserves(_reserved(spark, d), ticks(spark, d)).drop("kind")


@query("st16_graduation_progress", f"{WITH} SELECT m.token, CAST(m.age AS BIGINT) AS age, CAST(least(coalesce(sum(quote) {_B}, 0) * 10000 // 1000000, 10000) AS BIGINT) AS progress_bps FROM m {_ON}")
def st16(spark, d):
    c = state.cumulative(adapters.aged(spark, d), ticks(spark, d), state.MILESTONES)
    return c.select("token", "age", bps_capped(F.col("buy_quote"), F.lit(1_000_000)).alias("progress_bps"))


@query(
    "st17_graduation_gap",
    f"{WITH}, {CYCLE} SELECT token, min(a) FILTER (type = 'MIGRATED') - min(a) FILTER (type = 'MIGRATION_STARTED') AS gap_ms, count(*) FILTER (type = 'SNIPE_TAX') AS snipe_taxes, arg_max(amount, (a, id)) FILTER (type = 'SNIPE_TAX') AS last_tax FROM y GROUP BY token",
)
def st17(spark, d):
    renamed = lifecycle(spark, d).replace({"MIGRATED": "POOL_GRADUATED", "MIGRATION_STARTED": "LAUNCH_SWEPT"}, subset=["type"])
    return state.graduation(renamed)


@query("st18_external_reserves", f"{WITH}, r AS (SELECT token, id, 5000000 + id AS v_base, a FROM a WHERE id % 5 = 0) SELECT m.token, CAST(m.age AS BIGINT) AS age, r.v_base FROM m ASOF LEFT JOIN (SELECT token, a, max(v_base) AS v_base FROM r GROUP BY ALL) r ON m.token = r.token AND m.age >= r.a")
def st18(spark, d):
    read = adapters.aged(spark, d).where("id % 5 = 0").select("token", "a", "id", (5000000 + F.col("id")).alias("v_base"))
    return asof.as_of(ticks(spark, d), read, ["token"], F.col("age"), F.col("a"), ["a", "id"], "r").select("token", "age", "r.v_base")


#: All totals of a snapshot, by name.
_TOTALS = {"buys": f"count(a.id) {_B}", "sells": f"count(a.id) {_S}"}
for _side, _when in (("buy", _B), ("sell", _S)):
    _TOTALS |= {f"{_side}_quote": f"sum(quote) {_when}", f"{_side}_base": f"sum(base) {_when}", f"unique_{_side}ers": f"count(DISTINCT trader) {_when}", f"creator_{_side}s": f"count(*) {_C.format(_side)}", f"creator_{_side}_quote": f"sum(quote) {_C.format(_side)}"}
_TOTALS["unique_traders"] = "count(DISTINCT trader)"


def _json(columns) -> str:
    return " || ',' || ".join(f"'\"{c}\":' || " + (f"'\"' || {c} || '\"'" if c in ("token", "kind") else c) for c in sorted(columns))


_JSON = _json([*_TOTALS, "token", "age", "kind"])
_ALL = _TOTALS | {f"w{w}_{n}": x.format(w=f"a.a > m.age - {w * 1000}") for w in state.WINDOWS for columns in _WINDOWED.values() for n, x in columns.items()}
#: Fingerprints over all totals and windows.
ALL_FINGERPRINTS = (
    f"{WITH}, a2 AS (SELECT *, row_number() OVER (PARTITION BY token, trader, side ORDER BY a, id) = 1 AS fresh FROM a), x AS (SELECT m.token, CAST(m.age AS BIGINT) AS age, {', '.join(_big(v, k) for k, v in _ALL.items())} FROM m {_ON.replace('JOIN a ON', 'JOIN a2 a ON')}) "
    f"SELECT token, age, sha256('{{' || {_json([*_ALL, 'token', 'age'])} || '}}') AS fingerprint FROM x"
)


@query("st19_fingerprint", f"{WITH}, x AS (SELECT m.token, CAST(m.age AS BIGINT) AS age, 'MILESTONE' AS kind, {', '.join(_big(v, k) for k, v in _TOTALS.items())} FROM m {_ON}) SELECT token, age, sha256('{{' || {_JSON} || '}}') AS fingerprint FROM x")
def st19(spark, d):
    c = state.cumulative(adapters.aged(spark, d), ticks(spark, d), state.MILESTONES)
    return c.select("token", "age", state.fingerprint(c, sorted(c.columns)).alias("fingerprint"))


@query(
    "st20_versions",
    f"{WITH} SELECT token, CAST(age AS BIGINT) AS age, CAST(v AS INT) AS version, v = 1 AND hit AS superseded FROM (SELECT *, token IN (SELECT token FROM t WHERE id % 50 = 0) AS hit FROM m), (SELECT unnest([1, 2]) AS v) WHERE v = 1 OR hit",
)
def st20(spark, d):
    old = ticks(spark, d).select("token", "age").withColumn("version", F.lit(1)).withColumn("superseded", F.lit(False))
    late = adapters.trades(spark, d).where("id % 50 = 0").select("token").distinct()
    return state.rebuilt(old, ticks(spark, d).select("token", "age").join(late, "token"), ["token", "age"])


_H = ", ".join(map(str, state.HORIZONS))
HORIZON = f"""
h AS (SELECT l.token, hz AS h, count(a.id) FILTER (side = 'buy') AS buys, count(a.id) FILTER (side = 'sell') AS sells, count(DISTINCT trader) FILTER (side = 'buy') AS unique_buyers, count(DISTINCT trader) FILTER (side = 'sell') AS unique_sellers,
        arg_min(price, (a, id)) FILTER (price > 0) AS p0, arg_max(price, (a, id)) FILTER (price > 0) AS p1
      FROM l CROSS JOIN (SELECT unnest([{_H}]) AS hz) LEFT JOIN a ON a.token = l.token AND a.a <= hz GROUP BY ALL),
hr AS (SELECT token, hz AS h, count(*) AS repeat_buyers FROM (SELECT token, hz, trader FROM a, (SELECT unnest([{_H}]) AS hz) WHERE side = 'buy' AND a <= hz GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
hz AS (SELECT token, CAST(h AS BIGINT) AS h, buys, sells, unique_buyers, unique_sellers, coalesce(repeat_buyers, 0) AS repeat_buyers, buys - sells AS imbalance, CAST(round_even((p1 / p0 - 1) * 10000.0, 0) AS BIGINT) AS price_change_bps FROM h LEFT JOIN hr USING (token, h))
"""


@query("st21_horizons", f"WITH {SQL}, {HORIZON} SELECT * FROM hz")
def st21(spark, d):
    return state.horizons(adapters.aged(spark, d), adapters.launches(spark, d))
