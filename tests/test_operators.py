import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import amounts, hexwords, lookups, metadata
from tidemark.operators import asof, candidate, features, joins, outcomes, prepare, quality, research, security, state


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_exact_division(spark):
    big = lambda n: F.lit(Decimal(n))
    r = one(
        spark, a=amounts.floor_div(big("29999999999999999999999999999"), big("3000000000000000000000")), b=amounts.bps(F.lit(1), F.lit(3)), c=amounts.bps(F.lit(1), F.lit(0)),
        d=amounts.bps_capped(F.lit(9), F.lit(2)), e=amounts.return_bps(F.lit(1), F.lit(3)), f=amounts.trunc_div(F.lit(-7), F.lit(2)), g=amounts.muldiv(big(10**30), big(10**20), big(10**15)), h=amounts.muldiv(big(10**37), big(10**37), big(1)),
        i=amounts.return_bps_even(F.lit(2.0), F.lit(1.0)), j=amounts.sat_sub(F.lit(1), F.lit(5)), k=amounts.adverse(F.lit(999), 100),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (9999999, 3333, None, 10000, -6666, -3, 10**35, None)
    assert (r.i, r.j, r.k) == (10000, 0, 989)
    wide = spark.createDataFrame([(str(10**60), str(3), str(7)), ("1", "1", "0")], "a string, b string, c string").select(amounts.muldiv_text("a", "b", "c").alias("x")).collect()
    assert [w.x for w in wide] == [str(10**60 * 3 // 7), None]


def test_medians_and_ranks(spark):
    r = one(spark, a=amounts.median_floor(F.array(*map(F.lit, (5, 1, 2, 9)))), b=amounts.median_floor(F.array().cast("array<int>")), c=amounts.nearest_rank(F.array(*map(F.lit, (4, 1, 3, 2))), 50))
    assert (r.a, r.b, r.c) == (3, None, 2)


def test_hex(spark):
    w = lambda n: F.lit(f"{n % (1 << 256):064x}")
    r = one(spark, a=hexwords.unsigned(w(2**119)), b=hexwords.unsigned(w(2**130)), c=hexwords.signed(w(-3)), d=hexwords.normal_hex(F.lit(" 0XaB ")), e=hexwords.word(F.lit("0x12"), 0))
    assert (r.a, r.b, r.c, r.d, r.e) == (2**119, None, -3, "0xab", None)


TRADES = "token string, a bigint, id bigint, trader bigint, side string, quote bigint, base bigint, mine boolean"


@pytest.fixture
def trades(spark):
    rows = [("t", 4_000, 1, 1, "buy", 10, 5, True), ("t", 5_000, 2, 1, "buy", 20, 5, True), ("t", 9_000, 3, 2, "sell", 5, 1, False), ("t", 10_000, 4, 1, "sell", 7, 1, True), ("t", 10_000, 5, 3, "buy", 9, 1, False)]
    return spark.createDataFrame(rows, TRADES)


@pytest.fixture
def ticks(spark):
    return spark.createDataFrame([(t, a, "MILESTONE") for t in ("t", "dead") for a in (5_000, 10_000, 15_000)], "token string, age bigint, kind string")


def test_windows_exclude_their_start_and_include_their_end(trades, ticks):
    got = {(r.token, r.age): r for r in state.rolling(trades, ticks, (5,)).collect()}
    assert (got["t", 5000].w5_buys, got["t", 5000].w5_unique_buyers, got["t", 5000].w5_new_buyers) == (2, 1, 1)
    # at 10 s the trades at 5 s are out, those at 10 s in
    assert (got["t", 10000].w5_buys, got["t", 10000].w5_sells, got["t", 10000].w5_unique_buyers, got["t", 10000].w5_unique_sellers) == (1, 2, 1, 2)
    assert got["t", 10000].w5_new_buyers == 1 and got["t", 15000].w5_buys == 0
    assert got["dead", 15000].w5_buys == 0


def test_sums_up_to_the_next_tick_change_nothing(trades, ticks):
    for f in (state.cumulative, state.rolling):
        assert sorted(map(str, f(trades, ticks).collect())) == sorted(map(str, f(trades, ticks, ages=[5_000, 10_000, 15_000]).collect()))
    assert state.AGES[0] == 5_000 and len(state.AGES) == 60 + 100 + 90 and state.with_earlier((5_000, 300_000), (5, 15)) == [5_000, 285_000, 295_000, 300_000]


def test_next_age(spark):
    ages = [5, 10, 15, 20, 50, 80, 110, 111]
    rows = spark.range(-3, 130).select("id", state.next_age(F.col("id"), ages).alias("x")).collect()
    assert all(r.x == min((a for a in ages if a >= r.id), default=None) for r in rows)


def test_accelerations_look_back_to_a_snapshot(spark):
    rows = [("t", a, 10 * a, a, 1) for a in (1_000, 6_000, 11_500)] + [("u", 6_000, 7, None, 1)]
    s = spark.createDataFrame(rows, "token string, age bigint, w5_unique_buyers bigint, w15_buy_quote bigint, w15_sell_quote bigint")
    got = {(r.token, r.age): r for r in features.accelerations(s, (("buyers", 5),), (15,)).collect()}
    assert [got["t", a].buyer_acceleration_5s for a in (1_000, 6_000, 11_500)] == [None, 50_000, 55_000]
    assert got["t", 11_500].net_flow_velocity_15s is None and got["u", 6_000].buyer_acceleration_5s is None and got["t", 6_000].w5_unique_buyers == 60_000


def test_drawdown_and_quintiles_as_brute_force(spark):
    rng = random.Random(3)
    rows = [(p, rng.randrange(50), i, rng.randrange(-100, 101)) for i, p in enumerate("ab" * 150)]
    pnl = spark.createDataFrame(rows, "policy string, at bigint, id bigint, pnl bigint").repartition(3)
    got = {r.policy: r.drawdown_bps for r in outcomes.drawdown(pnl, "policy").collect()}
    for p in "ab":
        eq = peak = fall = 0
        for _, at, i, x in sorted(r for r in rows if r[0] == p):
            eq += x
            peak = max(peak, eq)
            fall = max(fall, peak - eq)
        assert got[p] == (fall * 10_000 // peak if peak else 10_000 if fall else 0)
    marks = [("h", f"{i:03}", rng.choice([None, 0, 0, 0, 1, 5]), rng.random() < 0.4) for i in range(203)]
    table = spark.createDataFrame(marks, "h string, token string, v int, reached_5x boolean")
    known = sorted((v, t, hit) for _, t, v, hit in marks if v is not None)
    want = {}
    for i, (_, _, hit) in enumerate(known):
        want.setdefault(1 + sum(i >= len(known) * q // 5 for q in range(1, 5)), []).append(hit)
    assert {r.quintile: (r.n, r.hit_bps) for r in research.quintiles(table, "v", ["h"]).collect()} == {q: (len(x), sum(x) * 10_000 // len(x)) for q, x in want.items()}


def test_future_trades_change_no_earlier_row(spark, trades, ticks):
    later = trades.unionByName(spark.createDataFrame([("t", 12_000, 9, 4, "buy", 1000, 1, False)], TRADES))
    for f in (state.cumulative, state.rolling, state.last_ages, state.rolling_sizes, state.concentration):
        old, new = ({(r.token, r.age): r for r in f(x, ticks).collect() if r.age <= 10_000} for x in (trades, later))
        assert old == new


def test_cumulative_and_dead_tokens(trades, ticks):
    got = {(r.token, r.age): r for r in state.cumulative(trades, ticks).collect()}
    r = got["t", 10000]
    assert (r.buys, r.sells, r.buy_quote, r.unique_buyers, r.unique_sellers, r.unique_traders, r.creator_buys, r.creator_sell_quote) == (3, 2, 39, 2, 2, 3, 2, 7)
    assert all(got["dead", a].buys == 0 for a in (5000, 10000, 15000))


def test_row_order_does_not_matter(trades, ticks):
    a = sorted(map(str, state.rolling(trades, ticks).collect()))
    assert a == sorted(map(str, state.rolling(trades.orderBy(F.desc("id")), ticks).collect()))


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("x", 9)], "key string, at int")
    right = spark.createDataFrame([("k", 2, 1, "a"), ("k", 5, 1, "b"), ("k", 5, 2, "c"), ("k", 6, 1, "d")], "key string, at int, id int, v string")
    got = asof.as_of(left, right, ["key"], F.col("at"), F.col("at"), ["at", "id"], "r").collect()
    assert sorted((r.key, r["at"], r.r.v if r.r else None) for r in got) == [("k", 1, None), ("k", 5, "c"), ("x", 9, None)]


def test_heartbeats_and_amounts(spark):
    rows = spark.createDataFrame([("t", 1, 1.0), ("t", 2, 1.0), ("t", 3, 2.0), ("u", 4, 1.0)], "token string, id int, price double")
    assert sorted(r.id for r in prepare.without_heartbeats(rows, ["price"], ["id"]).collect()) == [1, 3, 4]
    kind, value = prepare.classify_amount(F.col("x"))
    got = spark.createDataFrame([(None,), ("",), ("12",), ("3.0",), ("3.5",), ("abc",)], "x string").select(kind.alias("k"), value.alias("v")).collect()
    assert [tuple(r) for r in got] == [("MISSING", None), ("MISSING", None), ("ONCHAIN_INTEGER", "12"), ("INTEGER_VALUED_FLOAT", "3"), ("FLOAT_NOT_INTEGER", None), ("FLOAT_NOT_INTEGER", None)]


def test_security_unknown_never_passes(spark):
    rows = [("a", "OWNER", "PASS", "INFO", False, ""), ("b", "BYTECODE", "UNKNOWN", "INFO", False, ""), ("c", "OWNER", "WARN", "LOW", False, "w"), ("c", "BYTECODE", "UNKNOWN", "INFO", False, ""), ("d", "MINT_AUTHORITY", "FAIL", "CRITICAL", True, "m"), ("e", "OWNER", "PASS", "HIGH", False, "")]
    got = security.assess(spark.createDataFrame(rows, "token string, check string, status string, severity string, hard_reject boolean, details string")).collect()
    assert {r.token: r.verdict for r in got} == {"a": "PASS", "b": "UNKNOWN", "c": "WARN", "d": "REJECT", "e": "WARN"}


def test_selectors_only_at_whole_bytes(spark):
    rows = spark.createDataFrame([("hit", "0x00638da5cb5b"), ("odd", "0x0638da5cb5b0"), ("none", None)], "token string, code string")
    assert [r.token for r in security.selector_evidence(rows).collect()] == ["hit"]


def test_selectors_reach_the_verdict(spark):
    code = {"blacklist": "f9f92be4", "set_blacklist": "153b0d1e", "mint": "40c10f19", "tax": "8cd09d50", "wallet": "5d0044ca", "role": "91d14854", "burn": "42966c68", "owner": "8da5cb5b"}
    rows = spark.createDataFrame([(t, f"0x6000{'63' + s}14") for t, s in code.items()], "token string, code string")
    got = {r.token: r.verdict for r in security.assess(security.selector_evidence(rows)).collect()}
    assert got == {"blacklist": "REJECT", "set_blacklist": "REJECT", "mint": "REJECT", "tax": "WARN", "wallet": "WARN", "role": "WARN", "burn": "PASS", "owner": "WARN"}
    assert security.selector_evidence(rows.where("token = 'mint'"), reject_mint=False).first().status == "WARN"
    assert len({*security.SELECTORS, *(s[0] for s in security.MORE_SELECTORS)}) == 27


def test_candidate_fold(spark):
    rows = [("a", 5_000, 1, 1, 0, "X", "PASS"), ("a", 15_000, 3, 2, 0, "X", "PASS"), ("a", 30_000, 3, 2, 0, "X", "REJECT"), ("a", 40_000, 9, 9, 0, "X", "PASS"), ("b", 5_000, 0, 0, None, "X", None), ("b", 300_000, 0, 0, None, "X", "PASS"), ("b", 315_000, 9, 9, 0, "X", "PASS")]
    s = spark.createDataFrame(rows, "token string, age bigint, trade_count bigint, unique_buyers bigint, idle bigint, lifecycle string, verdict string")
    log = candidate.transitions(s, (candidate.DEFAULT,)).orderBy("token", "seq").collect()
    assert [(r.token, r.age, r.to_state) for r in log] == [("a", 5000, "WATCHING"), ("a", 5000, "CONFIRMING"), ("a", 15000, "ELIGIBLE"), ("a", 30000, "SECURITY_REJECTED"), ("b", 5000, "SECURITY_PENDING"), ("b", 300000, "EXPIRED")]


def test_strategies_and_policies(spark):
    good = dict(verdict="PASS", candidate="ELIGIBLE", trade_count=9, age=30_000, buyer_acceleration_15s=2, buyer_velocity_15s=3, net_flow=5, imbalance=2, unique_buyers=4, repeat_buyer_bps=1_000, new_buyer_30s_bps=5_000, creator_sells=1, curve_progress_bps=500)
    cases = {
        "good": {}, "reject": {"verdict": "REJECT"}, "pending": {"candidate": "WATCHING"}, "young": {"age": 5_000}, "no_trades": {"trade_count": None}, "no_accel": {"buyer_acceleration_15s": None},
        "slow": {"buyer_velocity_15s": 1}, "outflow": {"net_flow": -1}, "repeats": {"repeat_buyer_bps": 6_001}, "curve": {"curve_progress_bps": 8_001}, "no_curve": {"curve_progress_bps": None},
    }
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'bigint'}" for k, v in good.items())
    rows = spark.createDataFrame([(k, *(good | v).values()) for k, v in cases.items()], f"token string, {kinds}")
    got = {(r.token, r.strategy[:2]): r.reason for r in candidate.strategies(rows).collect()}
    passing = lambda t: {k[1] for k, why in got.items() if k[0] == t and why == "SIGNAL"}
    every = {f"S{k}" for k in range(7)}
    assert passing("good") == every and passing("reject") == passing("pending") == set()
    assert passing("young") == passing("no_trades") == {"S0"} and got["young", "S4"] == "MIN_AGE" and got["no_trades", "S1"] == "DATA_INCOMPLETE"
    assert passing("no_accel") == passing("slow") == {"S0", "S3", "S4", "S5"} and got["no_accel", "S2"] == "DATA_INCOMPLETE" and got["slow", "S6"] == "STRATEGY_FILTER"
    assert passing("outflow") == every - {"S2", "S6"} and passing("repeats") == every - {"S3", "S6"} and passing("curve") == every - {"S5", "S6"} and got["no_curve", "S5"] == "DATA_INCOMPLETE"
    creator = candidate.strategies(rows.where("token = 'good'"), candidate.Thresholds(reject_creator_sold=True)).where("reason <> 'SIGNAL'").collect()
    assert {r.strategy[:2] for r in creator} == {"S4", "S6"}

    f = [("many", 3, 1, 1, 0, None, 0, 1), ("growth", 1, 1, 2, 1, None, 50, 1), ("price", 1, 0, 0, 0, 90, None, 0), ("quiet", 0, 0, -1, None, None, None, 0)]
    f = spark.createDataFrame(f, "token string, w30_unique_buyers bigint, unique_buyers bigint, imbalance bigint, buyer_acceleration_15s bigint, price_change_30s_bps bigint, price_change_15s_bps bigint, w30_new_buyers bigint")
    got = {r.token: {k[:2] for k in candidate.prospective() if r[k]} for r in f.select("token", *(c.alias(k) for k, c in candidate.prospective().items())).collect()}
    assert got == {"many": {"P0", "P1", "P2", "P3", "P4"}, "growth": {"P0", "P2", "P3"}, "price": {"P0"}, "quiet": {"P0", "P3"}}


def test_funnel_and_delayed_entries(spark):
    log = spark.createDataFrame([("a", "p", 1, "WATCHING"), ("a", "p", 2, "ELIGIBLE"), ("a", "p", 9, "EXPIRED"), ("b", "p", 1, "WATCHING")], "token string, policy_id string, age bigint, to_state string")
    assert {r.to_state: r.tokens for r in candidate.funnel(log).collect()} == {"WATCHING": 2, "ELIGIBLE": 1, "EXPIRED": 1}
    assert {r.token: r.highest_state for r in candidate.highest_state(log).collect()} == {"a": "ELIGIBLE", "b": "WATCHING"}
    ticks = spark.range(40).selectExpr("explode(array('a', 'b')) AS token", "id * 5000 AS age")
    eligible = spark.createDataFrame([("a", 7_000), ("b", 100_000)], "token string, eligible_age bigint")
    got = {(r.token, r.policy): r.age for r in candidate.delayed_entries(ticks, eligible, chance_bps=10_000).collect()}
    want = {("a", "E1"): 10_000, ("a", "E2"): 40_000, ("a", "E3"): 70_000, ("a", "E4"): 130_000, ("a", "E5"): 10_000, ("b", "E1"): 100_000, ("b", "E2"): 130_000, ("b", "E3"): 160_000, ("b", "E5"): 100_000}
    assert got == want
    assert not [r for r in candidate.delayed_entries(ticks, eligible, chance_bps=0).collect() if r.policy == "E5"]


def test_fingerprints(spark):
    import hashlib

    rows = spark.createDataFrame([("a", 1), ("b", None)], "token string, n bigint")
    got = [r.f for r in rows.select(state.fingerprint(rows, ["n", "token"]).alias("f")).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in ('{"n":1,"token":"a"}', '{"n":null,"token":"b"}')]


def test_reconcile_and_gaps(spark):
    fills = spark.createDataFrame([("a", "buy", 10, 100), ("a", "sell", 4, 60), ("a", "sell", 6, 30), ("b", "buy", 3, 10), ("b", "sell", 5, 9), ("c", "sell", 1, 1)], "k string, side string, base bigint, quote bigint")
    got = {r.k: (r.remaining, r.realized_pnl, r.status) for r in quality.reconcile(fills, ["k"]).collect()}
    assert got == {"a": (0, -10, "CLOSED"), "b": (0, -1, "OVERSOLD"), "c": (0, None, "SELL_WITHOUT_ENTRY")}
    hours = spark.createDataFrame([(h * 3_600_000,) for h in (10, 11, 20, 21)], "ms bigint")
    assert [tuple(r) for r in research.hour_gaps(hours, "ms", []).collect()] == [(12, 19)]


def test_positions_against_fills(spark):
    fills = spark.createDataFrame([("a", "buy", 10, 100), ("a", "sell", 4, 60), ("b", "buy", 3, 10), ("b", "sell", 5, 9), ("d", "buy", 5, 50)], "k string, side string, base bigint, quote bigint")
    rows = [("a", 0, 0, 6, 20, False), ("b", 0, 0, 0, -1, True), ("c", 4, 40, 4, 0, True), ("d", 0, 0, 1, 3, False)]
    stored = spark.createDataFrame(rows, "k string, initial bigint, cost bigint, remaining bigint, realized_pnl bigint, closed boolean")
    got = {r.k: r for r in quality.reconcile_positions(stored, fills, ["k"]).collect()}
    assert got["a"].ok and (got["a"].remaining, got["a"].realized_pnl) == (6, 20)
    assert got["b"].oversold and got["b"].inventory_ok and got["b"].pnl_ok and not got["b"].ok
    assert got["c"].closed_without_exit_fill and got["c"].failed_exit_marked_closed and (got["c"].bought, got["c"].sold) == (4, 0)
    assert not got["d"].inventory_ok and not got["d"].pnl_ok


def test_gate(spark):
    names = ("events", "invalid", "ordering_violations", "with_slot", "with_signature", "amount_integer", "amount_float", "amount_missing", "trades", "launches", "graduated", "zero_trade")
    good = dict(zip(names, (10, 0, 0, 10, 10, 10, 0, 0, 8, 2, 1, 0)))
    cases = {"good": {}, "derived": {"with_slot": 9}, "floats": {"amount_float": 1}, "order": {"ordering_violations": 1}, "survivors": {"graduated": 2}, "empty": dict.fromkeys(names, 0)}
    rows = [(k, *(good | v).values()) for k, v in cases.items()]
    got = quality.gate(spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} bigint" for n in names)), by=("k",)).collect()
    assert {r.k: r.verdict for r in got} == {"good": "RESEARCH_VALID", "derived": "FEATURE_ONLY", "floats": "FEATURE_ONLY", "order": "INVALID", "survivors": "INVALID", "empty": "INVALID"}
    assert {r.check for r in got if r.k == "derived" and not r.passed} == {"curve_reconstructable", "execution_valid"}


def test_exit_rules(spark):
    flat = (0, 0, 0, 0)
    marks = [("t", 1, 1, 130, *flat), ("t", 2, 2, 99, *flat), ("u", 1, 1, 90, *flat), ("u", 2, 2, 69, *flat), ("v", 1, 1, 100, -2, 0, 5, 0), ("v", 2, 2, 100, 0, 2, -1, 0), ("v", 3, 3, 100, 0, 2, 1, 3)]
    m = spark.createDataFrame(marks, "token string, a bigint, id bigint, px bigint, buyer_accel bigint, seller_accel bigint, net_flow bigint, creator_sells bigint")
    e = spark.createDataFrame([(t, 0, 100, 2) for t in "tuv"], "token string, entry_age bigint, entry_px bigint, entry_creator_sells bigint")
    got = {(r.token, r.rule): r.exit_age for r in outcomes.exits(e, m, 1_000_000).collect()}
    # 130 to 99 is a fall of 31 points of return; 31 % below an entry that never gained isn't trailed
    assert got == {("t", "X5_TRAILING"): 2, ("v", "X7_FLOW_DECAY"): 1, ("v", "X8_CREATOR_SELL"): 3}
    left = {r.token: (r.reason, r.remaining_bps) for r in outcomes.scaled_out(e, m, cap_ms=2).collect()}
    assert left == {"t": ("TIME_STOP", 0), "u": ("TIME_STOP", 0), "v": ("MOMENTUM_DECAY", 0)}


def test_proxy_selectors_stand_at_whole_bytes(spark):
    rows = spark.createDataFrame([("odd", "0x06352d1902d0"), ("even", "0x006352d1902d")], "token string, code string").selectExpr("*", "cast(null AS string) AS admin_slot", "cast(null AS string) AS implementation_slot")
    assert [(r.token, r.check) for r in security.proxy_evidence(rows).collect()] == [("even", "PROXY_UUPS")]


def test_intervals_with_a_dead_provider(spark):
    rows = [("s", 0, "VALID"), ("s", 10_000, "VALID"), ("s", 20_000, "INVALID"), ("s", 30_000, "VALID"), ("s", 130_000, "VALID")]
    got = quality.intervals(spark.createDataFrame(rows, "s string, ms bigint, status string"), "s").orderBy("started_ms").collect()
    assert [(r.status, r.started_ms, r.ended_ms) for r in got] == [("VALID", 0, 20_000), ("INVALID", 20_000, 30_000), ("PARTIAL", 30_000, 130_000), ("VALID", 130_000, 130_000)]


def test_outcomes(spark):
    prices = [("bad", 1, 1, -1.0), ("up", 1, 1, 1.0), ("up", 2, 2, 5.5), ("nan", 1, 1, float("nan"))]
    tokens = spark.createDataFrame([("bad",), ("up",), ("nan",), ("dead",)], "token string")
    got = {r.token: r for r in outcomes.descriptive(spark.createDataFrame(prices, "token string, a bigint, id bigint, price double"), tokens).collect()}
    assert (got["bad"].cohort, got["nan"].cohort, got["dead"].cohort, got["up"].cohort, got["up"].time_to_5x_ms) == ("INVALID", "INVALID", "DEAD / NO TRADE", "5X+", 2)
    e = spark.createDataFrame([("t", 0, 100)], "token string, entry_age bigint, entry_px bigint")
    m = spark.createDataFrame([("t", 1, 1, 150), ("t", 2, 2, 190), ("t", 3, 3, 400), ("t", 4, 4, 250)], "token string, a bigint, id bigint, px bigint")
    r = outcomes.scaled_out(e, m).first()
    # 20 % of the rest at each step, then all the rest
    assert (r.stage, r.remaining_bps, r.reason, r.realized) == (3, 0, "TRAIL", 2000 * 150 // 10000 + 1600 * 190 // 10000 + 1280 * 400 // 10000 + 5120 * 250 // 10000)
    b = outcomes.bootstrap(spark.range(400).select(F.lit("g").alias("g"), "id", (F.col("id") % 10).cast("double").alias("value")), "g").first()
    assert b.p5 < b.mean < b.p95 and abs(b.mean - 4.5) < 1e-9


def fitting(pool, limit, notionals):
    """The largest of ``notionals`` that the quote's own rule accepts, tried one by one."""
    vq, vb, real, fee = pool
    best = None
    for notional in notionals:
        net = notional * (10_000 - fee) // 10_000
        out = vb * net // (vq + net)
        if 0 < out <= real and (impact := max(net * vb * 10_000 // (out * vq) - 10_000, 0)) <= limit:
            best = (notional, impact)
    return best


def largest_fitting(vq, vb, real, fee, limit):
    """(notional, impact): the largest notional that fits, by jumps over Python's integers."""
    keep, most = 10_000 - min(fee, 10_000), (1 << 63) - 1
    if min(vq, vb, real, keep) <= 0:
        return None
    q = min((vq * (limit + 1) - 1) // 10_000, most * keep // 10_000)
    if vb > real + 1:
        q = min(q, ((real + 1) * vq - 1) // (vb - real - 1))
    while q > 0 and (r := vb * q // (vq + q)) > 0:
        n = ((10_001 + limit) * r * vq - 1) // (10_000 * vb)
        if q <= n:
            return min(((q + 1) * 10_000 - 1) // keep, most), max(q * vb * 10_000 // (r * vq) - 10_000, 0)
        q = n
    return None


POOLS = "id bigint, v_quote {0}, v_base {0}, real_base {0}, fee_bps bigint"


@pytest.mark.parametrize("room", [9e37, 0])
@pytest.mark.parametrize("limit", [0, 7, 300, 5_000])
def test_largest_notional_as_brute_force(spark, monkeypatch, limit, room):
    if room == 0 and limit == 0:
        limit = 30
    monkeypatch.setattr(outcomes, "ROOM", room)
    rng = random.Random(7)
    pools = []
    for _ in range(300):
        vq, vb = (rng.randint(1, 10 ** rng.randint(1, 4)) for _ in range(2))
        pools.append((vq, vb, rng.randint(1, 2 * vb), rng.choice([0, 100, 250])))
    want = {}
    for k, pool in enumerate(pools):
        top = (pool[0] * (limit + 1) // 10_000 + 2) * 10_000 // (10_000 - pool[3]) + 2
        want[k] = fitting(pool, limit, range(top))
        assert want[k] == largest_fitting(*pool, limit)
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(pools)], POOLS.format("bigint"))
    got = {r.id: r.max_notional and (r.max_notional, r.impact_bps) for r in outcomes.max_notional(table, ["id"], limit).collect()}
    assert got == want
    found = outcomes.max_notional(table, ["id"], limit)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_largest_notional_of_any_size(spark):
    pools = [(10**e, 10**f, real, 100) for e in range(3, 19) for f in (3, e, 18) for real in (10**f, 10**f // 1000)]
    pools += [(1_000_000, 50_000_000, 40_000_000, 100), (1_000_000, 50_000_000, 1_000, 100), (10**18, 1, 1, 0), ((1 << 63) - 1, (1 << 63) - 1, (1 << 63) - 1, 0)]
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(pools)] + [(-1, None, 5, 5, 100), (-2, 1_000, 1_000, 1_000, 10_000), (-3, 5, 5, 5, None)], POOLS.format("bigint"))
    for limit in (300, 2):
        got = {r.id: r.max_notional and (r.max_notional, r.impact_bps) for r in outcomes.max_notional(table, ["id"], limit).collect()}
        assert got == {k: largest_fitting(*p, limit) for k, p in enumerate(pools)} | {-1: None, -2: None, -3: None}
        for k, pool in enumerate(pools):
            if got[k] and got[k][0] < (1 << 63) - 3000:
                assert fitting(pool, limit, [got[k][0]]) == got[k] and fitting(pool, limit, range(got[k][0] + 1, got[k][0] + 3000)) is None
    wide = [(10**24 * 7, 10**27, 8 * 10**26, 100), (10**70, 10**60, 10**60, 30), (3 * 10**30, 10**9, 10**9, 0), (10**6, 10**75, 10**75, 0)]
    table = spark.createDataFrame([(k, *map(str, p[:3]), p[3]) for k, p in enumerate(wide)] + [(9, "x", "1", "1", 0)], POOLS.format("string"))
    got = {r.id: r.max_notional for r in outcomes.max_notional(table, ["id"], 250).collect()}
    for k, pool in enumerate(wide):
        assert fitting(pool, 250, [int(got[k])]) and not fitting(pool, 250, range(int(got[k]) + 1, int(got[k]) + 2000))
    assert got[9] is None and len(got[1]) > 60


def test_wide_quotes_as_python_integers(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        size = rng.choice([3, 18, 37, 60, 75])
        vq, vb, real, notional = (rng.randint(0, 10**size) for _ in range(4))
        rows.append((k, str(notional), str(vq), str(rng.choice([vb, 0])), str(rng.choice([real, 10**75])), rng.choice([0, 100, 9_000]), rng.choice([0, 50, 2_000])))
    rows += [(900, "5", None, "5", "5", 0, 0), (901, None, "5", "5", "5", 0, 0), (902, "5", "5", "5", None, 0, 0), (903, "5", "5", "5", "5", None, 0)]
    names = "id bigint, notional {0}, v_quote {0}, v_base {0}, real_base {0}, fee_bps int, tax_bps int"
    got = {r.id: (r.net_quote, r.tokens_out, r.status, r.impact_bps) for r in outcomes.quoted_wide(spark.createDataFrame(rows, names.format("string"))).collect()}
    for k, *rest in rows[:120]:
        notional, vq, vb, real = map(int, rest[:4])
        net = notional * (10_000 - min(rest[4] + rest[5], 10_000)) // 10_000
        raw = vb * net // (vq + net) if vq + net else None
        if raw is None:
            continue
        out = min(raw, real)
        status = "NO_LIQUIDITY" if out == 0 else "CAPPED" if raw > real else "OK"
        impact = max(net * vb * 10_000 // (out * vq) - 10_000, 0) if status == "OK" and vq else None
        assert got[k] == (str(net), str(out), status, impact if impact is None or impact < 1 << 63 else None), k
    assert [got[k][2] for k in (900, 901, 902, 903)] == ["NO_RESERVES", "UNKNOWN", "OK", "UNKNOWN"]
    small = [(k, rng.randint(1, 10**6), rng.randint(1, 10**9), rng.randint(1, 10**9), rng.randint(0, 10**6), rng.choice([0, 99]), 5) for k in range(200)]
    by_number = outcomes.quoted(spark.createDataFrame(small, names.format("bigint"))).select("id", F.col("net_quote").cast("string"), F.col("tokens_out").cast("string"), "status", "impact_bps")
    by_limbs = outcomes.quoted_wide(spark.createDataFrame([(r[0], *map(str, r[1:5]), *r[5:]) for r in small], names.format("string"))).select("id", "net_quote", "tokens_out", "status", "impact_bps")
    assert sorted(map(tuple, by_number.collect())) == sorted(map(tuple, by_limbs.collect()))


def test_leaks_and_violations(spark):
    assert features.leaks(spark.range(1).select(F.struct(F.lit(1).alias("reached_2x")).alias("shared")).schema) == ["shared.reached_2x"]
    rows = [("t", 1, "1", 5, None, 3), ("t", 2, None, 4, 0, 2)]
    got = features.violations(spark.createDataFrame(rows, "token string, seq int, feature_version string, as_of int, holder_count int, trade_count int")).collect()
    assert sorted(r.problem for r in got) == ["COUNT_DECREASED", "MISSING_VERSION", "TIME_BACKWARDS", "UNKNOWN_AS_ZERO"]


def test_orphans_and_rebuild(spark, ticks):
    rows = spark.createDataFrame([("e1",), ("e2",)], "event_id string")
    assert {r.event_id: r.canonical_status for r in prepare.mark_orphans(rows, rows.where("event_id = 'e1'")).collect()} == {"e1": "ORPHANED", "e2": "CANONICAL"}
    old = ticks.select("token", "age").withColumn("version", F.lit(1)).withColumn("superseded", F.lit(False))
    again = state.rebuilt(old, ticks.where("token = 't'").select("token", "age"), ["token", "age"])
    assert again.where("not superseded and version = 2 and token = 't'").count() == 3 and again.where("superseded").count() == 3


def test_lookups(spark):
    assert lookups.chains(spark).count() == 3 and lookups.delays(spark).count() == 9 and lookups.factories(spark).count() == 6
    rows = spark.createDataFrame([("pons_v2", "CURVE_ACTIVE", 999), ("pons_v2", "AMM_ACTIVE", 1000), ("pumpfun", None, None), (None, "AMM_ACTIVE", 0), ("other", "x", 5)], "pad string, state string, age bigint")
    got = [tuple(r) for r in rows.select(lookups.protocol_bps(F.col("pad"), F.col("state")), lookups.snipe_tax_bps(F.col("pad"), F.col("age"))).collect()]
    assert got == [(100, 9900), (25, 0), (100, 0), (0, 0), (0, 0)]
    forced = rows.select(lookups.snipe_tax_bps(F.col("pad"), F.col("age"), F.lit(True)).alias("x")).collect()
    assert [r.x for r in forced] == [9900, 9900, 0, 0, 0]


def test_text_or_number(spark):
    rows = spark.createDataFrame([(j,) for j in ('{"a": "x"}', '{"a": 12}', '{"a": 1.5}', '{"a": true}', '{"a": [1]}', '{"a": {"b": 1}}', '{"a": null}', "{}", "not json", "", None, '{"a": "true"}')], "j string")
    assert [r.x for r in rows.select(metadata.text_or_number(F.col("j"), "a").alias("x")).collect()] == ["x", "12", "1.5"] + [None] * 8 + ["true"]


def test_recovered_gaps(spark):
    gaps = spark.createDataFrame([("s", 5, 9), ("s", 20, 30), ("t", 5, 9), ("s", 40, 41)], "stream string, first_missing bigint, last_missing bigint")
    repaired = spark.createDataFrame([("s", 1, 9), ("s", 6, 30), ("s", 20, 25), ("t", 6, 9), ("s", 40, 40), ("s", 41, 41)], "stream string, first bigint, last bigint")
    got = {(r.stream, r.first_missing): r.recovered for r in quality.with_recovery(gaps, repaired, "stream").collect()}
    # two repaired ranges that adjoin cover the last gap together
    assert got == {("s", 5): True, ("s", 20): True, ("t", 5): False, ("s", 40): True}
    assert quality.with_recovery(gaps, repaired.limit(0), "stream").where("recovered").count() == 0
    assert quality.with_recovery(gaps.limit(0), repaired, "stream").count() == 0


def test_capabilities(spark):
    schema = "session int, status string, complete boolean, price_labels_ok boolean, executable boolean, live boolean"
    rows = [(1, "LIVE_COMPLETE", True, True, True, True), (2, "HISTORICAL_REPLAY", True, None, None, None), (3, "LIVE_COMPLETE", None, True, True, True), (4, None, True, True, True, True)]
    got = [tuple(r)[1:] for r in quality.capabilities(spark.createDataFrame(rows, schema)).orderBy("session").collect()]
    assert got == [(True, True, True, True, False, True), (True, False, False, False, False, False)] + [(False, False, False, False, True, False)] * 2


def test_lifecycle_balance(spark):
    orders = spark.createDataFrame([("a", "buy", "FILLED"), ("a", "buy", "FAILED"), ("a", "sell", "PARTIAL_FILL"), ("a", "sell", None), ("b", "buy", "FILLED")], "k string, side string, status string")
    positions = spark.createDataFrame([("a", "OPEN"), ("c", "LOST")], "k string, status string")
    got = {r.k: r for r in quality.lifecycle_balance(orders, positions, ["k"]).collect()}
    a = got["a"]
    assert (a.entry_orders, a.entry_fills, a.exit_orders, a.exit_fills, a.partial_exit_fills, a.failed_exit_attempts, a.positions_balanced, a.entries_balanced) == (2, 1, 2, 1, 1, 1, True, True)
    assert (got["b"].positions_balanced, got["b"].entries_balanced) == (True, False)
    assert (got["c"].positions_balanced, got["c"].entries_balanced, got["c"].positions_opened) == (False, False, 1)


def test_test_gate(spark):
    import hashlib

    h = hashlib.sha256(b"{}").hexdigest()
    ok = dict(config="{}", locked_config="{}", locked_hash=h, status="LIVE_COMPLETE", dataset_hash="d", actual_hash="d", test_runs=None)
    cases = {
        "OK": {}, "DATASET_NOT_RESEARCH_VALID": {"status": None}, "DATASET_HASH_MISSING": {"dataset_hash": None}, "DATASET_HASH_MISMATCH": {"actual_hash": None}, "NOT_LOCKED": {"locked_hash": None},
        "HASH_MISMATCH": {"locked_config": "{1}"}, "CONFIG_DRIFT": {"config": "{2}"}, "TEST_ALREADY_RUN": {"test_runs": 1},
    }
    schema = "experiment string, config string, locked_config string, locked_hash string, status string, dataset_hash string, actual_hash string, test_runs int"
    rows = spark.createDataFrame([(k, *{**ok, **change}.values()) for k, change in cases.items()], schema)
    assert all(r.gate == r.experiment for r in quality.test_gate(rows).collect())


def test_counters_and_hours(spark):
    rows = spark.createDataFrame([("a", x) for x in (-3, 1, 2, 3, 100)] + [("b", None)], "k string, lag bigint")
    got = {r.k: tuple(r)[1:] for r in quality.counters(rows, "lag", ["k"], (50, 99)).collect()}
    assert got["a"] == (5, 106, 100, 2, 3) and got["b"] == (1, None, None, None, None)
    hours = spark.createDataFrame([(0,), (3_599_999,), (3_600_000,), (-1,), (None,)], "ms bigint")
    assert {(r.hour, r.n) for r in research.hour_histogram(hours, "ms", []).collect()} == {(0, 2), (1, 1), (-1, 1)}


def test_joins(spark):
    buys = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 3, 9), (None, 4, 1)], "k string, id int, ms bigint")
    sells = spark.createDataFrame([("a", 7, 7), ("b", 8, 8), ("c", 9, 8)], "k string, id int, ms bigint")
    assert {tuple(r) for r in joins.unmatched(buys, sells, ["k"]).collect()} == {(None, 1)}
    assert {tuple(r) for r in joins.unopened(sells, buys, ["k"], "ms").collect()} == {("b", 8), ("c", 9)}
    got = joins.compare_deliveries(buys.withColumn("e", F.lit("x")), sells.withColumn("e", F.lit("x")), "e", "k").first()
    assert (got.live, got.backfill, got.both_sets, got.live_only, got.backfill_only) == (3, 3, 2, 1, 1)


def test_read_corpus(spark, tmp_path):
    from tidemark.sources import corpus

    t = spark.createDataFrame([(i, f"m{i % 2}", None, None, 0.5, True, 1.0, 2.0, "w", None, "s") for i in range(4)], corpus.TRADES)
    t.repartition(2, "id").write.parquet(str(tmp_path / "trades"))
    spark.createDataFrame([("m0", None, None, None, None, 2, False)], corpus.TOKENS).write.parquet(str(tmp_path / "tokens"))
    tokens, trades = corpus.read_corpus(spark, str(tmp_path))
    assert tokens.first().mint == "m0" and trades.count() == 4 and trades.where("shard LIKE 'part-%'").count() == 4
    plan = trades.select("mint")._jdf.queryExecution().toString().split("ReadSchema: ")[1]
    assert plan.startswith("struct<mint:string") and "tx_signature" not in plan


def test_missing_is_never_a_bound(spark):
    rows = spark.createDataFrame([(1, 0), (None, 5), (7, None), (7, 5), (2, 5)], "a bigint, b bigint")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in rows.select(amounts.bps_capped(a, b), amounts.sat_sub(a, b)).collect()]
    assert got == [(None, 1), (None, None), (None, None), (10000, 2), (4000, 0)]


def test_quotes_of_missing_inputs(spark):
    names = "notional bigint, v_quote bigint, v_base bigint, real_base bigint, fee_bps int, tax_bps int"
    rows = spark.createDataFrame([(100, None, 10, 5, 0, 0), (100, 1000, 1000, 500, None, 0), (None, 1000, 1000, 500, 0, 0), (100, 1000, 1000, None, 0, 0), (100, 1000, 1000, 5, 0, 0)], names)
    got = [(r.tokens_out, r.status) for r in outcomes.quoted(rows).collect()]
    assert got == [(None, "NO_RESERVES"), (None, "UNKNOWN"), (None, "UNKNOWN"), (90, "OK"), (5, "CAPPED")]


def test_wide_quotes_in_one_pass(spark):
    """No lambdas row by row in the plan (20 000 quotes by limbs took half a minute); odd texts are no numbers."""
    rows = [(1, " 00500 ", "1000000", "5000000", "30000"), (2, "5.5", "1", "1", "1"), (3, "5", str(1 << 256), "1", "1"), (4, "", "1", "1", "1"), (5, "0", "0", "7", "7"), (6, str((1 << 256) - 1), "1", str((1 << 256) - 1), str((1 << 256) - 1))]
    x = spark.createDataFrame(rows, "id bigint, notional string, v_quote string, v_base string, real_base string").withColumns({"fee_bps": F.lit(0), "tax_bps": F.lit(0)})
    q = outcomes.quoted_wide(x)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("ArrowEvalPython") == 1
    got = {r.id: (r.net_quote, r.tokens_out, r.status, r.impact_bps) for r in q.collect()}
    assert got[1] == ("500", str(5_000_000 * 500 // 1_000_500), "OK", 500 * 5_000_000 * 10_000 // (2498 * 1_000_000) - 10_000)
    assert got[2] == (None, None, "UNKNOWN", None) and got[3] == ("5", None, "NO_RESERVES", None) and got[4][2] == "UNKNOWN" and got[5] == ("0", None, "UNKNOWN", None)
    most = (1 << 256) - 1
    assert got[6] == (str(most), str(most * most // (most + 1)), "OK", None)


def test_labels_of_values_in_cents(spark, tmp_path):
    """The query keeps the label of a token that once trades at 0.00; the operator alone calls it INVALID."""
    from tidemark.plans import research_queries

    rows = [(k, f"2024-01-01 00:00:{k:02d}", k, "click", v, '{"k": 7}') for k, v in enumerate((0.0, 2.0, 11.0, 0.0))]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0,)], "n_nationkey bigint").write.parquet(f"{tmp_path}/nation.parquet")
    got = {r.token: r for r in research_queries.oc2(spark, str(tmp_path)).collect()}
    assert (got["7"].quality, got["7"].cohort, got["7"].max_return_bps, got["7"].reached_5x) == ("VALID", "5X+", 45_000, True)
    assert research_queries.ra1(spark, str(tmp_path)).first().invalid_labels == 0
    prices = spark.createDataFrame([("t", k, k, r[4]) for k, r in enumerate(rows)], "token string, a bigint, id bigint, price double")
    assert outcomes.descriptive(prices, prices.select("token").distinct()).first().quality == "INVALID"


def test_intervals_of_samples_at_one_time(spark):
    rows = [("s", 0, "VALID"), ("s", 10_000, "VALID"), ("s", 10_000, "INVALID"), ("s", 90_000, "VALID")]
    of = lambda r: sorted(map(tuple, quality.intervals(spark.createDataFrame(r, "s string, ms bigint, status string").coalesce(1), "s").collect()))
    assert of(rows) == of(rows[::-1])


def test_signal_counts_without_observations(spark, tmp_path):
    """Without any token that passes, the query has one row of zeros, as its SQL has."""
    from tidemark.plans import feature_queries

    rows = [(97 * k, f"2024-01-01 00:00:{k:02d}", k, "error", 1.0, '{"k": 7}') for k in range(3)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0,)], "n_nationkey bigint").write.parquet(f"{tmp_path}/nation.parquet")
    assert list(map(tuple, feature_queries.sg4(spark, str(tmp_path)).collect())) == [(0, 0, 0)]
    signals = spark.createDataFrame([("t", "A", True), ("t", "A", False), ("u", "A", True)], "token string, policy string, enter boolean")
    hits = spark.createDataFrame([("t", True)], "token string, hit boolean")
    of = lambda *more: sorted(map(tuple, candidate.signal_counts(signals, hits, *more).collect()))
    assert of() == [("A", 3, 2, 1)] and of(("A", "B")) == [("A", 3, 2, 1), ("B", 0, 0, 0)]
