"""Feature, security, candidate and signal queries (FT, SC, CD, SG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.amounts import bps
from tidemark.operators import candidate, features, security, state
from tidemark.plans.base import query
from tidemark.plans.state_queries import ALL_FINGERPRINTS, WITH, lifecycle, ticks
from tidemark.sources import adapters


def snapshots(spark, d, ages=state.MILESTONES, windows=state.WINDOWS):
    """Totals and windows in one row per tick at ``ages`` of the grid."""
    t, g = adapters.aged(spark, d), ticks(spark, d, False).where(F.col("age").isin(*ages))
    return state.cumulative(t, g, ages).drop("kind").join(state.rolling(t, g, windows, ages).drop("kind"), ["token", "age"])


def windows_only(spark, d, windows, kind):
    """Windows of one kind at the milestones and at what lies a window before them."""
    ages = state.with_earlier(state.MILESTONES, windows)
    return state.rolling(adapters.aged(spark, d), ticks(spark, d, False).where(F.col("age").isin(*ages)), windows, ages, (kind,))


def _w(side: str, w: int, what: str = "count(DISTINCT trader)") -> str:
    return f"{what} FILTER (side = '{side}' AND a.a > m.age - {w}000)"


#: Milestone snapshots as needed by the features.
SNAP = f"""
af AS (SELECT *, row_number() OVER (PARTITION BY token, trader, side ORDER BY a, id) = 1 AS fresh FROM a),
s AS (SELECT m.token, CAST(m.age AS BIGINT) AS age, count(a.id) FILTER (side = 'buy') AS buys, count(a.id) FILTER (side = 'sell') AS sells,
        CAST(coalesce(sum(quote) FILTER (side = 'buy'), 0) AS BIGINT) AS buy_quote, CAST(coalesce(sum(quote) FILTER (side = 'sell'), 0) AS BIGINT) AS sell_quote,
        count(DISTINCT trader) FILTER (side = 'buy') AS unique_buyers, count(DISTINCT trader) FILTER (side = 'sell') AS unique_sellers,
        CAST(coalesce(sum(quote) FILTER (mine AND side = 'buy'), 0) AS BIGINT) AS creator_buy_quote, CAST(coalesce(sum(quote) FILTER (mine AND side = 'sell'), 0) AS BIGINT) AS creator_sell_quote,
        {', '.join(f"{_w(x, w)} AS w{w}_unique_{x}ers" for w in (5, 15, 30) for x in state.SIDES)},
        {', '.join(f"{_w(x, w, 'count(*)')} AS w{w}_{x}s" for w in state.WINDOWS for x in state.SIDES)},
        count(*) FILTER (fresh AND side = 'buy' AND a.a > m.age - 30000) AS w30_new_buyers, max(a.a) AS last_a
      FROM m LEFT JOIN af a ON a.token = m.token AND a.a <= m.age GROUP BY m.token, m.age)
"""
WITH_SNAP = f"{WITH}, {SNAP}"


def _ratio(a: str, b: str, times: int = 10_000) -> str:
    return f"CAST(CASE WHEN {b} <> 0 THEN ({a}) * {times} // ({b}) END AS BIGINT)"


def _select(columns):
    return lambda spark, d: snapshots(spark, d).select("token", "age", *(c.alias(k) for k, c in columns().items()))


query(
    "ft1_totals",
    f"{WITH_SNAP} SELECT token, age, buys + sells AS trade_count, {_ratio('buy_quote + sell_quote', 'buys + sells', 1)} AS average_trade, {_ratio('buy_quote', 'buys', 1)} AS average_buy, {_ratio('sell_quote', 'sells', 1)} AS average_sell, buy_quote - sell_quote AS net_flow, creator_buy_quote - creator_sell_quote AS creator_net_flow FROM s",
)(_select(lambda: features.totals(None)))
#: Buyers of each milestone who bought more than once.
_REPEAT = "r AS (SELECT token, age, count(*) AS n FROM (SELECT m.token, m.age, trader FROM m JOIN a ON a.token = m.token AND a.a <= m.age WHERE side = 'buy' GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)"


@query(
    "ft2_ratios",
    f"{WITH_SNAP}, {_REPEAT} SELECT s.token, s.age, {_ratio('buys', 'sells')} AS buy_sell_count_bps, {_ratio('buy_quote', 'sell_quote')} AS buy_sell_volume_bps, {_ratio('unique_buyers', 'unique_sellers')} AS unique_buyer_seller_bps, {_ratio('creator_sell_quote', 'creator_buy_quote')} AS creator_sold_bps, {_ratio('w30_new_buyers', 'w30_unique_buyers')} AS new_buyer_30s_bps, {_ratio('coalesce(r.n, 0)', 'unique_buyers')} AS repeat_buyer_bps FROM s LEFT JOIN r ON r.token = s.token AND r.age = s.age",
)
def ft2(spark, d):
    con = state.concentration(adapters.aged(spark, d), ticks(spark, d), state.MILESTONES).select("token", "age", "repeat_buyers")
    s = snapshots(spark, d, windows=(30,)).join(con, ["token", "age"])
    return s.select("token", "age", *(c.alias(k) for k, c in features.ratios(s).items()))


query("ft3_imbalance", f"{WITH_SNAP} SELECT token, age, buys - sells AS imbalance, {', '.join(f'w{w}_buys - w{w}_sells AS w{w}_imbalance' for w in state.WINDOWS)} FROM s")(_select(lambda: features.imbalances(state.WINDOWS)))
query(
    "ft4_velocity",
    f"{WITH_SNAP} SELECT token, age, {', '.join(f'w{w}_unique_{x}ers AS {x}er_velocity_{w}s' for w in (5, 15) for x in state.SIDES)}, CAST((buys + sells) * 1000000 // age AS BIGINT) AS trades_per_second_x1000 FROM s",
)(_select(lambda: features.velocities()))


def _past(who: str, side: str, w: int) -> str:
    return f"(SELECT count(DISTINCT trader) FILTER (side = '{side}' AND a.a > b.age - {w}000) FROM (SELECT max(age) AS age FROM g WHERE g.token = s.token AND g.age <= s.age - {w}000) b LEFT JOIN a ON a.token = s.token AND a.a <= b.age WHERE b.age IS NOT NULL HAVING count(b.age) > 0)"


@query(
    "ft5_acceleration",
    f"{WITH_SNAP}, x AS (SELECT s.token, s.age, who, w, cur, (SELECT max(g.age) FROM g WHERE g.token = s.token AND g.age <= s.age - w * 1000) AS before FROM s, LATERAL (VALUES ('buy', 5, w5_unique_buyers), ('buy', 15, w15_unique_buyers), ('buy', 30, w30_unique_buyers), ('sell', 15, w15_unique_sellers), ('sell', 30, w30_unique_sellers)) v(who, w, cur)), "
    "y AS (SELECT x.token, x.age, who, w, cur, before, count(DISTINCT trader) FILTER (a.side = who AND a.a > before - w * 1000) AS old FROM x LEFT JOIN a ON a.token = x.token AND a.a <= before GROUP BY ALL) "
    "SELECT token, age, max(CASE WHEN who = 'buy' AND w = 5 AND before IS NOT NULL THEN cur - old END) AS buyer_acceleration_5s, max(CASE WHEN who = 'buy' AND w = 15 AND before IS NOT NULL THEN cur - old END) AS buyer_acceleration_15s, max(CASE WHEN who = 'buy' AND w = 30 AND before IS NOT NULL THEN cur - old END) AS buyer_acceleration_30s, "
    "max(CASE WHEN who = 'sell' AND w = 15 AND before IS NOT NULL THEN cur - old END) AS seller_acceleration_15s, max(CASE WHEN who = 'sell' AND w = 30 AND before IS NOT NULL THEN cur - old END) AS seller_acceleration_30s FROM y GROUP BY token, age",
)
def ft5(spark, d):
    x = features.accelerations(windows_only(spark, d, (5, 15, 30), "unique"), flows=())
    return x.where(F.col("age").isin(*state.MILESTONES)).select("token", "age", *(f"buyer_acceleration_{w}s" for w in (5, 15, 30)), *(f"seller_acceleration_{w}s" for w in (15, 30)))


@query(
    "ft6_flow_velocity",
    f"{WITH}, x AS (SELECT m.token, m.age, (SELECT max(g.age) FROM g WHERE g.token = m.token AND g.age <= m.age - 15000) AS before FROM m), "
    "y AS (SELECT x.token, x.age, before, coalesce(sum(CASE WHEN a.a > x.age - 15000 THEN (CASE side WHEN 'buy' THEN quote ELSE -quote END) END), 0) AS f1, coalesce(sum(CASE WHEN a.a > before - 15000 AND a.a <= before THEN (CASE side WHEN 'buy' THEN quote ELSE -quote END) END), 0) AS f0, coalesce(sum(CASE WHEN a.a > x.age - 15000 THEN quote END), 0) AS v1, coalesce(sum(CASE WHEN a.a > before - 15000 AND a.a <= before THEN quote END), 0) AS v0 FROM x LEFT JOIN a ON a.token = x.token AND a.a <= x.age GROUP BY ALL) "
    "SELECT token, CAST(age AS BIGINT) AS age, CAST(CASE WHEN before IS NOT NULL THEN f1 - f0 END AS BIGINT) AS net_flow_velocity_15s, CAST(CASE WHEN before IS NOT NULL THEN v1 - v0 END AS BIGINT) AS volume_velocity_15s FROM y",
)
def ft6(spark, d):
    x = features.accelerations(windows_only(spark, d, (15,), "flow"), wanted=(), flows=(15,))
    return x.where(F.col("age").isin(*state.MILESTONES)).select("token", "age", "net_flow_velocity_15s", "volume_velocity_15s")


def _px(shift: int) -> str:
    return f"arg_max(CAST(quote AS HUGEINT) * 1000000000000000000 // base, (a.a, a.id)) FILTER (a.a <= m.age - {shift})"


_CHANGE = ", ".join(f"CAST(CASE WHEN p{s} <> 0 THEN (p0 - p{s}) * 10000 // p{s} END AS BIGINT) AS price_change_{s}s_bps" for s in (5, 15, 30, 60))


@query("ft7_price", f"{WITH}, x AS (SELECT m.token, m.age, {_px(0)} AS p0, {', '.join(f'{_px(s * 1000)} AS p{s}' for s in (5, 15, 30, 60))} FROM m LEFT JOIN a ON a.token = m.token AND a.a <= m.age GROUP BY m.token, m.age) SELECT token, CAST(age AS BIGINT) AS age, CAST(p0 AS VARCHAR) AS price_x18, {_CHANGE} FROM x")
def ft7(spark, d):
    x = features.price_changes(ticks(spark, d), adapters.aged(spark, d))
    return x.withColumn("price_x18", F.col("price_x18").cast("string")).drop("kind")


@query(
    "ft8_9_venue",
    f"{WITH} SELECT id, CASE id % 4 WHEN 0 THEN 'CURVE' WHEN 1 THEN 'POOL' WHEN 2 THEN 'V4' END AS venue, CASE id % 4 WHEN 0 THEN quote WHEN 1 THEN base WHEN 2 THEN trader END AS liquidity, CASE id % 4 WHEN 3 THEN 'UNKNOWN' WHEN 2 THEN 'PARTIAL' ELSE 'VALUE' END AS liquidity_q, kind = 'error' AS graduating, (ms // 3600000) % 24 AS hour_of_day FROM t",
)
def ft8(spark, d):
    t = adapters.trades(spark, d)
    k = F.col("id") % 4
    venue = F.when(k == 0, "CURVE").when(k == 1, "POOL").when(k == 2, "V4")
    value, quality = features.liquidity(venue, F.col("quote"), F.col("base"), F.col("trader"))
    flags = features.stage_flags(F.when(F.col("kind") == "error", "MIGRATING").otherwise("CURVE_ACTIVE"))
    return t.select("id", venue.alias("venue"), value.alias("liquidity"), quality.alias("liquidity_q"), flags["graduating"].alias("graduating"), F.hour(F.timestamp_millis("ms")).cast("bigint").alias("hour_of_day"))


@query("ft10_venue_struct", f"{WITH} SELECT id, CASE WHEN id % 3 = 0 THEN quote END AS curve_quote, CASE WHEN id % 3 = 1 THEN quote END AS pool_quote, CASE WHEN id % 3 = 2 THEN quote END AS v4_quote FROM t")
def ft10(spark, d):
    k = F.col("id") % 3
    venue = F.when(k == 0, "CURVE").when(k == 1, "POOL").otherwise("V4")
    x = F.struct(F.col("quote").alias("q"))
    return adapters.trades(spark, d).select("id", features.venue_struct(venue, x, x, x).alias("v")).select("id", F.col("v.curve.q").alias("curve_quote"), F.col("v.pool.q").alias("pool_quote"), F.col("v.v4.q").alias("v4_quote"))


#: Evidence made of trades: errors fail a check of their trader's kind, views warn.
_CHECKS = ("PROXY_ADMIN_SLOT", "MINT_AUTHORITY", "OWNER", "SELLABILITY", "POOL_LIQUIDITY", "TEMPLATE_MATCH", "BYTECODE")
_STATUS = "CASE WHEN kind = 'view' AND id % 9 = 0 THEN 'WARN' WHEN id % 101 = 0 THEN 'UNKNOWN' ELSE 'PASS' END"
_SEV = "CASE WHEN kind = 'error' AND id % 17 = 0 THEN 'HIGH' WHEN id % 3 = 0 THEN 'LOW' ELSE 'INFO' END"
_CHECK = "[" + ", ".join(f"'{c}'" for c in _CHECKS) + "][trader % 7 + 1]"
_REJECT = "kind = 'error' AND id % 97 = 0"
EVIDENCE = f"e AS (SELECT token, a, {_CHECK} AS chk, {_STATUS} AS status, {_SEV} AS severity, {_REJECT} AS hard_reject, 'd' || id AS details FROM a)"
_CAT = "CASE WHEN chk IN ('PROXY_ADMIN_SLOT', 'TEMPLATE_MATCH', 'BYTECODE') THEN 'contract' WHEN chk = 'MINT_AUTHORITY' THEN 'mechanics' WHEN chk = 'OWNER' THEN 'privilege' WHEN chk = 'SELLABILITY' THEN 'sell' ELSE 'liquidity' END"
_RANK = "CASE severity WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END"
VERDICTS = f"""
v AS (SELECT token, CASE WHEN rejects > 0 THEN 'REJECT' WHEN unknowns > 0 THEN CASE WHEN warnings > 0 THEN 'WARN' ELSE 'UNKNOWN' END WHEN warnings > 0 OR greatest(mechanics, privilege, contract) = 3 THEN 'WARN' ELSE 'PASS' END AS verdict, rejects, warnings, contract, mechanics, privilege
      FROM (SELECT token, count(*) FILTER (hard_reject) AS rejects, count(*) FILTER (status = 'WARN' AND NOT hard_reject) AS warnings, count(*) FILTER (status = 'UNKNOWN') AS unknowns,
              {', '.join(f"coalesce(max({_RANK}) FILTER (({_CAT}) = '{c}'), 0) AS {c}" for c in ('contract', 'mechanics', 'privilege'))} FROM e GROUP BY token))
"""


def evidence(spark, d):
    a = adapters.aged(spark, d)
    status = F.when((F.col("kind") == "view") & (F.col("id") % 9 == 0), "WARN").when(F.col("id") % 101 == 0, "UNKNOWN").otherwise("PASS")
    severity = F.when((F.col("kind") == "error") & (F.col("id") % 17 == 0), "HIGH").when(F.col("id") % 3 == 0, "LOW").otherwise("INFO")
    check = F.get(F.array(*map(F.lit, _CHECKS)), (F.col("trader") % 7).cast("int"))
    return a.select("token", "a", check.alias("check"), status.alias("status"), severity.alias("severity"), ((F.col("kind") == "error") & (F.col("id") % 97 == 0)).alias("hard_reject"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("details"))


@query("sc1_assessment", f"{WITH}, {EVIDENCE}, {VERDICTS} SELECT token, verdict, ['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][contract + 1] AS contract_risk, ['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][mechanics + 1] AS mechanics_risk, ['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][privilege + 1] AS privilege_risk, rejects AS n_rejects, warnings AS n_warnings FROM v")
def sc1(spark, d):
    return security.assess(evidence(spark, d)).select("token", "verdict", "contract_risk", "mechanics_risk", "privilege_risk", F.size("rejects").cast("bigint").alias("n_rejects"), F.size("warnings").cast("bigint").alias("n_warnings"))


@query("sc6_verdict_distribution", f"{WITH}, {EVIDENCE}, {VERDICTS} SELECT verdict, count(*) AS tokens FROM v GROUP BY verdict")
def sc6(spark, d):
    return security.assess(evidence(spark, d)).groupBy("verdict").agg(F.count("*").alias("tokens"))


def _code(spark, d):
    """Bytecode made of a hash of each trade, so that selectors turn up by chance and by design."""
    t = adapters.trades(spark, d)
    body = F.concat(F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") % 5 == 0, "638da5cb5b").otherwise(""), F.when(F.col("id") % 7 == 0, "6352d1902d").otherwise(""))
    return t.select(F.col("id").alias("token"), body.alias("code"), F.when(F.col("id") % 11 == 0, "0x01").otherwise("0x00").alias("admin_slot"), F.lit(None).cast("string").alias("implementation_slot"))


_CODE = "c AS (SELECT id AS token, sha256(CAST(id AS VARCHAR)) || CASE WHEN id % 5 = 0 THEN '638da5cb5b' ELSE '' END || CASE WHEN id % 7 = 0 THEN '6352d1902d' ELSE '' END AS code FROM t)"


#: Severities of all selectors, written out here by themselves.
_SEVERITIES = {"CRITICAL": "40c10f19 3659cfe6 4f1ef286 f9f92be4 153b0d1e", "HIGH": "8456cb59 3f4ba83a 2e5bb6ff 0b78f9c0 dc1052e2 8cd09d50 bc337182 5d0044ca", "INFO": "42966c68 8a8c523c c9567bf9 c0246668 c0d78655 8187f516"}
_NAMES = {**security.SELECTORS, **{x[0]: x[1] for x in security.MORE_SELECTORS}}
_KNOWN = ", ".join(f"('{sel}', '{name}', '{next((k for k, v in _SEVERITIES.items() if sel in v), 'MEDIUM')}')" for sel, name in _NAMES.items())
#: Selectors that turn up by design, each for tokens whose id a number divides.
_PLANTED = {5: "8da5cb5b", 7: "52d1902d", 9: "40c10f19", 11: "f9f92be4", 13: "2e5bb6ff", 17: "3659cfe6", 19: "8456cb59", 23: "bc337182", 29: "2f2ff15d", 31: "42966c68"}
_PLANTED_CODE = f"c AS (SELECT id AS token, sha256(CAST(id AS VARCHAR)) || {' || '.join(f"CASE WHEN id % {n} = 0 THEN '63{sel}' ELSE '' END" for n, sel in _PLANTED.items())} AS code FROM t)"


def _planted(spark, d):
    i = F.col("id")
    return adapters.trades(spark, d).select(i.alias("token"), F.concat(F.lit("0x"), F.sha2(i.cast("string"), 256), *(F.when(i % n == 0, f"63{sel}").otherwise("") for n, sel in _PLANTED.items())).alias("code"))


@query(
    "sc2_privileges",
    f"{WITH}, {_PLANTED_CODE}, h AS (SELECT token, {', '.join(f"regexp_matches(code, '^(..)*63({'|'.join(sel)})') AS {kind}_" for kind, sel in security.KINDS.items())} FROM c) "
    "SELECT token, 'EVM_OWNER_SELECTOR' AS check_name, 'MEDIUM' AS severity, false AS hard_reject FROM h WHERE owner_ UNION ALL SELECT token, 'EVM_MINT_BACKDOOR', 'CRITICAL', true FROM h WHERE mint_ UNION ALL SELECT token, 'EVM_BLACKLIST', 'CRITICAL', true FROM h WHERE blacklist_ "
    "UNION ALL SELECT token, 'EVM_MUTABLE_TAX', 'HIGH', false FROM h WHERE tax_ UNION ALL SELECT token, 'EVM_MAX_TX_WALLET', 'HIGH', false FROM h WHERE max_ UNION ALL SELECT token, 'EVM_PAUSE', 'HIGH', false FROM h WHERE pause_ UNION ALL SELECT token, 'EVM_UPGRADER_ROLE', 'CRITICAL', false FROM h WHERE upgrade_ "
    "UNION ALL SELECT token, 'EVM_ACCESSCONTROL', 'MEDIUM', false FROM h WHERE role_ UNION ALL SELECT token, 'EVM_FAKE_RENOUNCE_RISK', 'HIGH', false FROM h WHERE owner_ AND (tax_ OR mint_ OR blacklist_ OR upgrade_) "
    "UNION ALL SELECT token, 'EVM_PRIVILEGE_SELECTORS', 'INFO', false FROM h WHERE NOT (owner_ OR mint_ OR burn_ OR pause_ OR blacklist_ OR trading_ OR tax_ OR max_ OR fees_ OR router_ OR pair_ OR upgrade_ OR role_)",
)
def sc2_privileges(spark, d):
    return security.privilege_evidence(_planted(spark, d)).select("token", F.col("check").alias("check_name"), "severity", "hard_reject")


@query(
    "sc1_sellability",
    f"{WITH}, e AS (SELECT token, id, CASE WHEN id % 4 = 0 THEN 'HONEYPOT_SIM' ELSE 'SELLABILITY' END AS chk, ['PASS', 'FAIL', 'WARN', 'UNKNOWN', 'PROVIDER_LIMITED', 'NOT_APPLICABLE'][trader % 6 + 1] AS status FROM t), "
    "x AS (SELECT token, arg_max(status, id) FILTER (chk = 'SELLABILITY') AS s, arg_max(status, id) FILTER (chk = 'HONEYPOT_SIM') AS h FROM e GROUP BY token) "
    "SELECT token, CASE s WHEN 'PASS' THEN 'SELLABLE' WHEN 'FAIL' THEN 'NOT_SELLABLE' WHEN 'NOT_APPLICABLE' THEN 'NOT_APPLICABLE' WHEN 'PROVIDER_LIMITED' THEN 'PROVIDER_LIMITED' ELSE 'UNKNOWN' END AS sellability, "
    "CASE WHEN h = 'FAIL' THEN 'HONEYPOT' WHEN h = 'PASS' THEN 'NOT_HONEYPOT' WHEN h = 'WARN' THEN 'CONDITIONAL' WHEN h IN ('UNKNOWN', 'PROVIDER_LIMITED') THEN 'SIMULATION_FAILED' ELSE 'UNKNOWN' END AS honeypot FROM x",
)
def sc1_sellability(spark, d):
    status = F.get(F.array(*map(F.lit, ("PASS", "FAIL", "WARN", "UNKNOWN", "PROVIDER_LIMITED", "NOT_APPLICABLE"))), (F.col("trader") % 6).cast("int"))
    rows = adapters.trades(spark, d).select("token", F.col("id").alias("seq"), F.when(F.col("id") % 4 == 0, "HONEYPOT_SIM").otherwise("SELLABILITY").alias("check"), status.alias("status"), F.lit("INFO").alias("severity"), F.lit(False).alias("hard_reject"), F.lit("").alias("details"))
    return security.assess(rows).select("token", "sellability", "honeypot")


@query("sc2_selectors", f"{WITH}, {_CODE} SELECT token, 'PRIVILEGE_' || label AS check_name, severity FROM c, (VALUES {_KNOWN}) v(sel, label, severity) WHERE regexp_matches(code, '^(..)*63' || sel)")
def sc2(spark, d):
    return security.selector_evidence(_code(spark, d)).select("token", F.col("check").alias("check_name"), "severity")


@query("sc3_templates", f"{WITH} SELECT id AS token, CASE WHEN id % 6 = 0 THEN 'UNKNOWN' WHEN CAST(token AS INT) % 10 > 4 THEN 'UNKNOWN' WHEN id % 4 = 0 THEN 'PASS' ELSE 'WARN' END AS status FROM t")
def sc3(spark, d):
    t = adapters.trades(spark, d)
    factory = F.col("token").cast("int") % 10
    tokens = t.select(F.col("id").alias("token"), factory.alias("factory"), F.when(F.col("id") % 6 != 0, F.when(F.col("id") % 4 == 0, F.concat(F.lit("h"), factory.cast("string"))).otherwise("x")).alias("code_hash"))
    registry = t.select(factory.alias("factory")).distinct().where("factory <= 4").withColumn("template_hash", F.concat(F.lit("h"), F.col("factory").cast("string")))
    return security.template_evidence(tokens, registry).select("token", "status")


@query("sc4_proxies", f"{WITH}, {_CODE} SELECT token, 'PROXY_UUPS' AS check_name FROM c WHERE contains(code, '6352d1902d') UNION ALL SELECT token, 'PROXY_ADMIN_SLOT' FROM c WHERE token % 11 = 0")
def sc4(spark, d):
    return security.proxy_evidence(_code(spark, d)).select("token", F.col("check").alias("check_name"))


@query("sc5_account_policy", f"{WITH} SELECT id AS token, 'MINT_AUTHORITY' AS check_name, 'WARN' AS status FROM t WHERE id % 2 = 0 UNION ALL SELECT id, 'FREEZE_AUTHORITY', 'FAIL' FROM t WHERE id % 13 = 0 UNION ALL SELECT id, 'NON_TRANSFERABLE', 'FAIL' FROM t WHERE id % 19 = 0")
def sc5(spark, d):
    none = F.lit(None).cast("string")
    a = adapters.trades(spark, d).select(F.col("id").alias("token"), F.when(F.col("id") % 2 == 0, F.col("trader")).alias("mint_authority"), F.when(F.col("id") % 13 == 0, F.col("trader")).alias("freeze_authority"), none.alias("transfer_hook"), none.alias("permanent_delegate"), (F.col("id") % 19 == 0).alias("non_transferable"))
    return security.account_evidence(a).select("token", F.col("check").alias("check_name"), "status")


@query(
    "sc7_program_evidence",
    f"{WITH} SELECT id AS token, 'TOKEN_PROGRAM' AS check_name, CASE WHEN kind = 'error' THEN 'FAIL' ELSE 'PASS' END AS status FROM t UNION ALL SELECT id, unnest(['GRADUATION_GAP', 'SELLABILITY']), unnest(['WARN', 'NOT_APPLICABLE']) FROM t WHERE id % 5 = 0 UNION ALL SELECT id, 'BYTECODE', CASE WHEN id % 2 = 0 THEN 'UNKNOWN_HISTORICAL_STATE' ELSE 'UNKNOWN' END FROM t WHERE id % 3 = 0 UNION ALL SELECT id, 'BYTECODE_SCAN', 'INFO' FROM t WHERE id % 3 <> 0 AND id % 4 <> 0",
)
def sc7(spark, d):
    i = F.col("id")
    rows = adapters.trades(spark, d).select(i.alias("token"), F.col("kind").alias("program"), F.when(i % 5 == 0, "GRADUATION_GAP").otherwise("CURVE_ACTIVE").alias("state"), (i % 3 != 0).alias("has_code"), (i % 2 == 0).alias("historical"), (i % 4 == 0).alias("template_match"))
    return security.program_evidence(rows, ["click", "view", "purchase", "signup"], ["error"]).select("token", F.col("check").alias("check_name"), "status")


def candidates(spark, d):
    """Snapshots of the whole grid with verdicts, as the funnel reads them."""
    t = adapters.aged(spark, d)
    g = ticks(spark, d, False)
    s = state.cumulative(t, g, state.AGES).join(state.last_ages(t, g).select("token", "age", "last_trade_age"), ["token", "age"])
    v = security.assess(evidence(spark, d)).select("token", "verdict")
    return s.join(v, "token", "left").select("token", "age", (F.col("buys") + F.col("sells")).alias("trade_count"), "unique_buyers", (F.col("age") - F.col("last_trade_age")).alias("idle"), F.lit("CURVE_ACTIVE").alias("lifecycle"), "verdict")


def funnel_log(spark, d):
    # one second stands for an hour, so a quiet market is one of 50 hours
    wide = [candidate.Policy(**{**p.__dict__, "quiet": 3_000_000, "max_age": 5_400_000}) for p in (candidate.DEFAULT, candidate.CONSERVATIVE)]
    return candidate.transitions(candidates(spark, d), wide)


def _first(n: int, buyers: int, age: int) -> str:
    return f"min(age) FILTER (age >= {age} AND trade_count >= {n} AND unique_buyers >= {buyers})"


#: The fold in closed form: each threshold is first met once, expiry ends it.
FUNNEL = f"""
cs AS (SELECT g.token, CAST(g.age AS BIGINT) AS age, count(a.id) AS trade_count, count(DISTINCT trader) FILTER (side = 'buy') AS unique_buyers, g.age - max(a.a) AS idle FROM g LEFT JOIN a ON a.token = g.token AND a.a <= g.age GROUP BY g.token, g.age),
cf AS (SELECT cs.token, verdict, min(age) AS born, min(age) FILTER (age > 5400000 OR (trade_count = 0 AND age >= 3000000) OR (trade_count > 0 AND idle >= 3000000)) AS expired, {_first(1, 1, 5000)} AS confirming, {_first(3, 2, 15000)} AS eligible_default, {_first(8, 5, 30000)} AS eligible_conservative FROM cs LEFT JOIN v USING (token) GROUP BY ALL),
ce AS (SELECT token, policy_id, verdict, born, coalesce(expired, 1000000000000) AS expired, confirming, CASE policy_id WHEN 'default' THEN eligible_default ELSE eligible_conservative END AS eligible FROM cf, (VALUES ('default'), ('conservative')) p(policy_id))
"""
_OPEN = "verdict IN ('PASS', 'WARN')"


_LOG = (
    "SELECT token, policy_id, born AS age, 'SECURITY_REJECTED' AS to_state FROM ce WHERE verdict = 'REJECT' "
    "UNION ALL SELECT token, policy_id, expired, 'EXPIRED' FROM ce WHERE (verdict IS NULL OR verdict <> 'REJECT') AND expired < 1000000000000 "
    "UNION ALL SELECT token, policy_id, born, CASE WHEN verdict IS NULL THEN 'SECURITY_PENDING' WHEN verdict = 'UNKNOWN' THEN 'DATA_INCOMPLETE' ELSE 'WATCHING' END FROM ce WHERE (verdict IS NULL OR verdict <> 'REJECT') AND born < expired "
    f"UNION ALL SELECT token, policy_id, confirming, 'CONFIRMING' FROM ce WHERE {_OPEN} AND confirming < expired UNION ALL SELECT token, policy_id, eligible, 'ELIGIBLE' FROM ce WHERE {_OPEN} AND eligible < expired"
)


@query("cd1_2_transitions", f"{WITH}, {EVIDENCE}, {VERDICTS}, {FUNNEL} {_LOG}")
def cd1(spark, d):
    return funnel_log(spark, d).select("token", "policy_id", "age", "to_state")


@query("cd3_first_eligible", f"{WITH}, {EVIDENCE}, {VERDICTS}, {FUNNEL} SELECT token, policy_id, eligible AS eligible_age FROM ce WHERE {_OPEN} AND eligible < expired")
def cd3(spark, d):
    return candidate.first_eligible(funnel_log(spark, d))


@query(
    "cd4_funnel",
    f"""{WITH}, {EVIDENCE}, {VERDICTS}, {FUNNEL}, lg AS ({_LOG}), fn AS (SELECT policy_id, to_state, count(DISTINCT token) AS tokens FROM lg GROUP BY ALL),
top AS (SELECT token, policy_id, arg_max(to_state, CASE to_state {' '.join(f"WHEN '{k}' THEN {v}" for k, v in candidate.RANK.items())} END) AS to_state FROM lg GROUP BY ALL)
SELECT policy_id, to_state, tokens, highest FROM fn LEFT JOIN (SELECT policy_id, to_state, count(*) AS highest FROM top GROUP BY ALL) USING (policy_id, to_state)""",
)
def cd4(spark, d):
    log = funnel_log(spark, d)
    top = candidate.highest_state(log).groupBy("policy_id", F.col("highest_state").alias("to_state")).agg(F.count("*").alias("highest"))
    return candidate.funnel(log).join(top, ["policy_id", "to_state"], "left")


def signal_features(spark, d):
    """Milestone features with verdict and candidate state, as the strategies read them."""
    s = features.accelerations(snapshots(spark, d, state.with_earlier(state.MILESTONES, (15,)), (15, 30)), wanted=(("buyers", 15),), flows=()).where(F.col("age").isin(*state.MILESTONES))
    s = s.withColumns({**features.totals(None), "imbalance": F.col("buys") - F.col("sells"), "buyer_velocity_15s": F.col("w15_unique_buyers"), "new_buyer_30s_bps": bps(F.col("w30_new_buyers"), F.col("w30_unique_buyers"))})
    con = state.concentration(adapters.aged(spark, d), ticks(spark, d), state.MILESTONES).select("token", "age", "repeat_buyers")
    v = security.assess(evidence(spark, d)).select("token", "verdict")
    s = s.join(con, ["token", "age"]).join(v, "token", "left")
    return s.withColumn("repeat_buyer_bps", bps(F.col("repeat_buyers"), F.col("unique_buyers"))).withColumn("candidate", F.when(F.col("verdict").isin("PASS", "WARN"), "ELIGIBLE").otherwise("DATA_INCOMPLETE")).withColumn("curve_progress_bps", F.when(F.col("buys") > 0, F.least(F.col("buy_quote") / 10, F.lit(10000))).cast("bigint"))


_REASON_S3 = "CASE WHEN verdict = 'REJECT' THEN 'SECURITY_REJECT' WHEN verdict IS NULL OR verdict NOT IN ('PASS', 'WARN') THEN 'NOT_ELIGIBLE' WHEN s.age < 15000 THEN 'MIN_AGE' WHEN unique_buyers < 3 OR coalesce(r.n, 0) * 10000 // nullif(unique_buyers, 0) > 6000 OR w30_new_buyers * 10000 // nullif(w30_unique_buyers, 0) < 2000 THEN 'STRATEGY_FILTER' ELSE 'SIGNAL' END"


@query(
    "sg1_broad_participation",
    f"{WITH_SNAP}, {EVIDENCE}, {VERDICTS}, {_REPEAT} SELECT s.token, s.age, {_REASON_S3} AS reason FROM s LEFT JOIN v USING (token) LEFT JOIN r ON r.token = s.token AND r.age = s.age",
)
def sg1(spark, d):
    return candidate.strategies(signal_features(spark, d)).where("strategy = 'S3_BROAD_PARTICIPATION'").select("token", "age", "reason")


#: Features of the strategies, in SQL.
_ACCEL = (
    "xb AS (SELECT s.token, s.age, w15_unique_buyers AS cur, (SELECT max(g.age) FROM g WHERE g.token = s.token AND g.age <= s.age - 15000) AS before FROM s), "
    "y AS (SELECT xb.token, xb.age, CASE WHEN before IS NOT NULL THEN cur - count(DISTINCT trader) FILTER (a.side = 'buy' AND a.a > before - 15000) END AS accel FROM xb LEFT JOIN a ON a.token = xb.token AND a.a <= before GROUP BY xb.token, xb.age, cur, before)"
)
_FEATURES = f"""{_REPEAT}, {_ACCEL},
f AS (SELECT s.*, verdict, CASE WHEN verdict IN ('PASS', 'WARN') THEN 'ELIGIBLE' ELSE 'DATA_INCOMPLETE' END AS candidate, accel, buys - sells AS imbalance, buy_quote - sell_quote AS net_flow, CASE WHEN buys > 0 THEN least(buy_quote // 10, 10000) END AS progress,
        coalesce(r.n, 0) * 10000 // nullif(unique_buyers, 0) AS repeated, w30_new_buyers * 10000 // nullif(w30_unique_buyers, 0) AS fresh
      FROM s JOIN y USING (token, age) LEFT JOIN v USING (token) LEFT JOIN r ON r.token = s.token AND r.age = s.age)"""
_GATE = "WHEN verdict = 'REJECT' THEN 'SECURITY_REJECT' WHEN candidate <> 'ELIGIBLE' THEN 'NOT_ELIGIBLE'"
_MIN_AGE = "WHEN age < 15000 THEN 'MIN_AGE'"
_GROWTH = "WHEN accel IS NULL THEN 'DATA_INCOMPLETE' WHEN accel < 1 OR w15_unique_buyers < 2 THEN 'STRATEGY_FILTER'"
_FLOWS = "WHEN net_flow < 0 OR imbalance < 0 THEN 'STRATEGY_FILTER'"
_BROAD = "WHEN unique_buyers < 3 OR repeated > 6000 OR fresh < 2000 THEN 'STRATEGY_FILTER'"
_CURVE = "WHEN progress < 200 OR progress > 8000 THEN 'STRATEGY_FILTER'"
_FEW = "WHEN unique_buyers < 3 THEN 'STRATEGY_FILTER'"
_RULES = {
    "S0_BASELINE": "", "S1_BUYER_GROWTH": f"{_MIN_AGE} {_GROWTH}", "S2_FLOW_CONFIRMATION": f"{_MIN_AGE} {_GROWTH} {_FLOWS}", "S3_BROAD_PARTICIPATION": f"{_MIN_AGE} {_BROAD}", "S4_CREATOR_FILTERED": _MIN_AGE,
    "S5_CURVE_CONFIRMATION": f"{_MIN_AGE} {_CURVE} WHEN progress IS NULL THEN 'DATA_INCOMPLETE' {_FEW}", "S6_HYBRID": f"{_MIN_AGE} {_GROWTH} {_FLOWS} {_BROAD} {_CURVE} {_FEW}",
}
_REASONS = " UNION ALL ".join(f"SELECT '{name}' AS strategy, CASE {_GATE} {rules} ELSE 'SIGNAL' END AS reason FROM f" for name, rules in _RULES.items())


@query("sg1_all_strategies", f"{WITH_SNAP}, {EVIDENCE}, {VERDICTS}, {_FEATURES} SELECT strategy, reason, count(*) AS n FROM ({_REASONS}) GROUP BY strategy, reason")
def sg1_all(spark, d):
    return candidate.strategies(signal_features(spark, d)).groupBy("strategy", "reason").agg(F.count("*").alias("n"))


def signals(spark, d):
    f = signal_features(spark, d).join(features.price_changes(ticks(spark, d), adapters.aged(spark, d), (15, 30)).select("token", "age", "price_change_15s_bps", "price_change_30s_bps"), ["token", "age"])
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("policy"), c.alias("enter")) for k, c in candidate.prospective().items())))
    return f.where("candidate = 'ELIGIBLE'").select("token", "age", every.alias("x")).select("token", "age", "x.policy", "x.enter")


@query("sg2_p1_signals", f"{WITH_SNAP}, {EVIDENCE}, {VERDICTS} SELECT token, age, greatest(w30_unique_buyers, unique_buyers) >= 3 AS enter FROM s JOIN v USING (token) WHERE verdict IN ('PASS', 'WARN')")
def sg2(spark, d):
    return signals(spark, d).where("policy = 'P1_SOLANA_BUYERS_3_30S'").select("token", "age", "enter")


_UP = "coalesce(price_change_30s_bps, price_change_15s_bps, 0) > 0"
_GROWING = "(w30_new_buyers > 0 OR coalesce(accel, 0) > 0)"
_UB = "greatest(w30_unique_buyers, unique_buyers) >= 3"


@query(
    "sg2_all_policies",
    f"{WITH_SNAP}, {EVIDENCE}, {VERDICTS}, {_FEATURES}, px AS (SELECT m.token, m.age, {_px(0)} AS p0, {', '.join(f'{_px(x * 1000)} AS p{x}' for x in (15, 30))} FROM m LEFT JOIN a ON a.token = m.token AND a.a <= m.age GROUP BY m.token, m.age), "
    "pc AS (SELECT token, age, CAST(CASE WHEN p15 <> 0 THEN (p0 - p15) * 10000 // p15 END AS BIGINT) AS price_change_15s_bps, CAST(CASE WHEN p30 <> 0 THEN (p0 - p30) * 10000 // p30 END AS BIGINT) AS price_change_30s_bps FROM px), e2 AS (SELECT * FROM f JOIN pc USING (token, age) WHERE candidate = 'ELIGIBLE') "
    f"SELECT token, age, policy, enter FROM (SELECT token, age, 'P0_FIRST_ELIGIBLE_CONTROL' AS policy, true AS enter FROM e2 UNION ALL SELECT token, age, 'P1_SOLANA_BUYERS_3_30S', {_UB} FROM e2 UNION ALL SELECT token, age, 'P2_SOLANA_BUYERS_PLUS_IMBALANCE', {_GROWING} AND imbalance > 0 FROM e2 "
    f"UNION ALL SELECT token, age, 'P3_PRICE_WITHOUT_BUYERS_AVOID', NOT ({_UP}) OR {_GROWING} FROM e2 UNION ALL SELECT token, age, 'P4_LOW_PARTICIPATION_FILTER', {_UB} FROM e2)",
)
def sg2_all(spark, d):
    return signals(spark, d)


_DELAYS = " UNION ALL ".join(f"SELECT ce.token, 'E{k + 1}' AS policy, min(g.age) AS age FROM ce JOIN g ON g.token = ce.token AND g.age >= eligible + {x} WHERE policy_id = 'default' AND {_OPEN} AND eligible < expired GROUP BY ce.token" for k, x in enumerate((0, 30_000, 60_000, 120_000)))


@query(
    "sg3_delayed_entries",
    f"{WITH}, {EVIDENCE}, {VERDICTS}, {FUNNEL}, de AS ({_DELAYS}) SELECT token, policy, CAST(age AS BIGINT) AS age FROM de UNION ALL SELECT token, 'E5', CAST(age AS BIGINT) FROM de WHERE policy = 'E1' AND CAST('0x' || substr(sha256('e5|' || token), 1, 15) AS BIGINT) % 10000 < 5000",
)
def sg3(spark, d):
    return candidate.delayed_entries(ticks(spark, d, False), candidate.first_eligible(funnel_log(spark, d)).where("policy_id = 'default'"))


@query("sg4_signal_counts", f"{WITH_SNAP}, {EVIDENCE}, {VERDICTS} SELECT count(*) AS n_obs, count(*) FILTER (greatest(w30_unique_buyers, unique_buyers) >= 3) AS n_signals, count(*) FILTER (greatest(w30_unique_buyers, unique_buyers) >= 3 AND CAST(token AS INT) % 2 = 0) AS hits FROM s JOIN v USING (token) WHERE verdict IN ('PASS', 'WARN')")
def sg4(spark, d):
    hit = adapters.launches(spark, d).select("token", F.coalesce(F.expr("try_cast(token AS INT) % 2 = 0"), F.lit(False)).alias("hit"))
    p1 = "P1_SOLANA_BUYERS_3_30S"
    return candidate.signal_counts(signals(spark, d).where(F.col("policy") == p1), hit, (p1,)).drop("policy")


_MEDIAN = "list_sort(list({0}) FILTER ({0} IS NOT NULL))[(count({0}) - 1) * 50 // 100 + 1]"


@query(
    "sg5_trained_thresholds",
    f"{WITH_SNAP}, x AS (SELECT s.token, s.age, w15_unique_buyers AS cur, (SELECT max(g.age) FROM g WHERE g.token = s.token AND g.age <= s.age - 15000) AS before FROM s), "
    "y AS (SELECT x.token, x.age, CASE WHEN before IS NOT NULL THEN cur - count(DISTINCT trader) FILTER (a.side = 'buy' AND a.a > before - 15000) END AS accel FROM x LEFT JOIN a ON a.token = x.token AND a.a <= before GROUP BY x.token, x.age, cur, before) "
    f"SELECT greatest({_MEDIAN.format('unique_buyers')}, 2) AS unique_buyers, greatest({_MEDIAN.format('w15_unique_buyers')}, 1) AS buyer_velocity_15s, greatest({_MEDIAN.format('accel')}, 1) AS buyer_acceleration_15s FROM s JOIN y USING (token, age)",
)
def sg5(spark, d):
    return candidate.trained(signal_features(spark, d)).select("unique_buyers", "buyer_velocity_15s", "buyer_acceleration_15s")


@query("ft11_security_at_snapshot", f"{WITH}, {EVIDENCE} SELECT m.token, CAST(m.age AS BIGINT) AS age, arg_max(e.status, (e.a, e.details)) AS status FROM m LEFT JOIN e ON e.token = m.token AND e.a <= m.age GROUP BY m.token, m.age")
def ft11(spark, d):
    from tidemark.operators.asof import as_of

    return as_of(ticks(spark, d), evidence(spark, d), ["token"], F.col("age"), F.col("a"), ["a", "details"], "r").select("token", "age", "r.status")


@query("ft12_fingerprint", ALL_FINGERPRINTS)
def ft12(spark, d):
    s = snapshots(spark, d)
    return s.select("token", "age", state.fingerprint(s, sorted(s.columns)).alias("fingerprint"))


@query(
    "ft13_violations",
    f"{WITH}, x AS (SELECT token, id, CASE WHEN id % 40 = 0 THEN NULL ELSE '1' END AS version, CASE WHEN id % 55 = 0 THEN NULL ELSE ms - CASE WHEN id % 70 = 0 THEN 1000000000 ELSE 0 END END AS tm, CASE WHEN id % 60 = 0 THEN 0 END AS holders FROM t), "
    "y AS (SELECT *, lag(tm) OVER (PARTITION BY token ORDER BY id) AS before FROM x) SELECT token, id AS seq, 'MISSING_VERSION' AS problem FROM y WHERE version IS NULL UNION ALL SELECT token, id, 'MISSING_TIME' FROM y WHERE tm IS NULL UNION ALL SELECT token, id, 'UNKNOWN_AS_ZERO' FROM y WHERE holders = 0 UNION ALL SELECT token, id, 'TIME_BACKWARDS' FROM y WHERE tm < before",
)
def ft13(spark, d):
    i = F.col("id")
    at = F.when(i % 55 != 0, F.col("ms") - F.when(i % 70 == 0, 1000000000).otherwise(0))
    t = adapters.trades(spark, d).select("token", i.alias("seq"), F.when(i % 40 != 0, "1").alias("feature_version"), at.alias("as_of"), F.when(i % 60 == 0, 0).alias("holder_count"), i.alias("trade_count"))
    return features.violations(t)


@query("ft14_15_schema_checks", f"{WITH} SELECT token, CAST(age AS BIGINT) AS age, 0 AS leaks, CAST(NULL AS BIGINT) AS holder_count FROM m")
def ft14(spark, d):
    s = features.with_unknown(snapshots(spark, d))
    return s.select("token", "age", F.lit(len(features.leaks(s.schema))).alias("leaks"), "holder_count")


@query("ft12_totals", f"{WITH_SNAP} SELECT token, age, sha256('{{\"age\":' || age || ',\"buys\":' || buys || ',\"net_flow\":' || (buy_quote - sell_quote) || ',\"token\":\"' || token || '\",\"w30_new_buyers\":' || w30_new_buyers || '}}') AS fingerprint FROM s")
def ft12_totals(spark, d):
    s = snapshots(spark, d, windows=(30,)).withColumn("net_flow", features.totals(None)["net_flow"])
    return s.select("token", "age", state.fingerprint(s, ["age", "buys", "net_flow", "token", "w30_new_buyers"]).alias("fingerprint"))


@query(
    "ft14_leaks",
    f"{WITH_SNAP} SELECT 'shared.reached_2x' AS leak, count(*) AS n_rows, count(*) FILTER (buy_quote > 2 * sell_quote) AS n_true FROM s UNION ALL SELECT 'max_drawdown_bps', count(*), count(*) FILTER (age > 100000) FROM s",
)
def ft14_leaks(spark, d):
    """A frame into which two outcome columns were let, one of them nested: each is named, with what it gives away."""
    s = snapshots(spark, d, windows=(30,))
    s = s.select("token", F.struct("buys", (F.col("buy_quote") > 2 * F.col("sell_quote")).alias("reached_2x")).alias("shared"), F.when(F.col("age") > 100_000, F.col("age")).alias("max_drawdown_bps"), (F.col("sells") > 0).alias("reached"))
    found = features.leaks(s.schema)
    told = F.explode(F.array(*(F.struct(F.lit(c).alias("leak"), (F.coalesce(F.col(c), F.lit(False)) if c.startswith("shared") else F.col(c).isNotNull()).alias("told")) for c in found)))
    return s.select(told.alias("x")).groupBy("x.leak").agg(F.count("*").alias("n_rows"), F.count_if("x.told").alias("n_true"))
