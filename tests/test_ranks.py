import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, research, security, state


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_ranks_of_random_values(spark, kind):
    rng = random.Random(5)
    rows = []
    for g in ("a", "b", None, "one"):
        for _ in range(1 if g == "one" else 700):
            x = rng.choice([0, -1, 1, rng.randint(-50, 50), rng.randint(-(10**12), 10**12), rng.randint(10**6, 10**6 + 300), None])
            rows.append((g, x if kind == "bigint" or x is None else x / 7))
    table = spark.createDataFrame(rows, f"g string, x {kind}")
    percents = (0, 1, 25, 50, 75, 99, 100)

    def want(values):
        v = sorted(x for x in values if x is not None)
        return tuple(v[(len(v) - 1) * q // 100] for q in percents) if v else (None,) * len(percents)

    got = {r.g: tuple(r)[1:] for r in research.rank_values(table, "x", percents, ["g"]).collect()}
    assert got == {g: want([x for h, x in rows if h == g]) for g in got} and len(got) >= 3
    assert tuple(research.rank_values(table, "x", percents).first()) == want([x for _, x in rows])
    assert research.rank_values(table.limit(0), "x", percents, ["g"]).count() == 0
    counts = table.where("x IS NOT NULL").groupBy("g", "x").agg(F.count("*").alias("n"))
    for r in research.placed(counts, ["g"], "x", "n").collect():
        own = [x for h, x in rows if h == r.g and x is not None]
        assert (r.start, r.total) == (sum(x < r.x for x in own), len(own))


def test_no_window_holds_a_group(spark):
    counts = spark.range(100_000).select((F.col("id") * 37).alias("x"), F.lit(1).alias("n"))
    sizes = counts.select(*research._classes(F.col("x"))).toDF("a", "b")
    assert sizes.select("a").distinct().count() < 3000
    assert sizes.groupBy("a", "b").count().agg(F.max("count")).first()[0] < 30


def test_hash_of_many_lines(spark):
    files = [(f"p{k:05d}", hashlib.sha256(str(k).encode()).hexdigest(), k) for k in range(3000)]
    files += [("é", "x", 1), ("é", "x", 1), ("z", None, 2)]
    table = spark.createDataFrame(files, "path string, sha string, size bigint")
    lines = sorted((":".join(str(x) for x in f if x is not None) for f in files), key=lambda x: x.encode())
    assert quality.dataset_hash(table.repartition(7)).first().dataset_hash == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert [r.dataset_hash for r in quality.dataset_hash(table.limit(0)).collect()] == [hashlib.sha256(b"").hexdigest()]


def test_adjoining_repairs(spark):
    ranges = spark.createDataFrame([("s", 1, 4), ("s", 5, 5), ("s", 7, 9), ("s", 2, 3), ("s", 12, 11), ("t", 6, 6), (None, 1, 1)], "stream string, first bigint, last bigint")
    assert sorted(map(str, quality.united(ranges, "stream").collect())) == sorted(["Row(stream='s', first=1, last=5)", "Row(stream='s', first=7, last=9)", "Row(stream='t', first=6, last=6)", "Row(stream=None, first=1, last=1)"])
    gaps = spark.createDataFrame([("s", 1, 5), ("s", 4, 6), ("s", 7, 8), ("t", 6, 7), ("u", 1, 1)], "stream string, first_missing bigint, last_missing bigint")
    got = {(r.stream, r.first_missing): r.recovered for r in quality.with_recovery(gaps, ranges.where("stream IS NOT NULL"), "stream").collect()}
    assert got == {("s", 1): True, ("s", 4): False, ("s", 7): True, ("t", 6): False, ("u", 1): False}


def test_sizes_and_concentration_as_brute_force(spark):
    rng = random.Random(2)
    trades = [(rng.choice("ab"), rng.randint(0, 70_000), k, rng.randint(1, 6), rng.choice(["buy", "sell"]), rng.choice([None, rng.randint(1, 9), 10**9])) for k in range(500)]
    ages = [5_000, 15_000, 30_000, 60_000]
    table = spark.createDataFrame(trades, "token string, a bigint, id bigint, trader bigint, side string, quote bigint")
    ticks = spark.createDataFrame([(t, a, "MILESTONE") for t in "abz" for a in ages], "token string, age bigint, kind string")
    for given in (None, ages, state.MILESTONES):
        got = {(r.token, r.age): (r.min_size, r.max_size, r.median_size) for r in state.rolling_sizes(table, ticks, 20, given).collect()}
        for t in "abz":
            for age in ages:
                v = sorted(x[5] for x in trades if x[0] == t and age - 20_000 < x[1] <= age and x[5] is not None)
                middle = v and v[(len(v) - 1) // 2] + (v[len(v) // 2] - v[(len(v) - 1) // 2]) // 2
                assert got[t, age] == ((v[0], v[-1], middle) if v else (None, None, None))
        con = {(r.token, r.age): r for r in state.concentration(table.where("quote IS NOT NULL"), ticks, given).collect()}
        for t in "ab":
            for age in ages:
                buys = {}
                for x in trades:
                    if x[0] == t and x[1] <= age and x[4] == "buy" and x[5] is not None:
                        buys[x[3]] = buys.get(x[3], 0) + 1
                b = sorted(buys.values())
                assert (con[t, age].repeat_buyers, con[t, age].median_buys, con[t, age].mean_buys_x1000) == (sum(n > 1 for n in b), b[len(b) // 2], sum(b) * 1000 // len(b))
        assert con["z", 5_000].repeat_buyers == 0 and con["z", 5_000].median_buys is None


def test_controls_by_kind(spark):
    rows = [("plain", "0x6001"), ("fake", "638DA5CB5B632E5BB6FF"), ("shifted", "0638da5cb5b0"), ("mint", "0x6340c10f19"), ("burn", "6342966c68"), ("none", None)]
    code = spark.createDataFrame(rows, "token string, code string")
    got = sorted((r.token, r.check, r.status, r.hard_reject) for r in security.privilege_evidence(code).collect())
    assert got == [
        ("fake", "EVM_FAKE_RENOUNCE_RISK", "FOUND", False), ("fake", "EVM_MUTABLE_TAX", "FOUND", False), ("fake", "EVM_OWNER_SELECTOR", "FOUND", False), ("mint", "EVM_MINT_BACKDOOR", "FOUND", True),
        ("plain", "EVM_PRIVILEGE_SELECTORS", "NOT_FOUND", False), ("shifted", "EVM_PRIVILEGE_SELECTORS", "NOT_FOUND", False),
    ]
    assert not security.privilege_evidence(code, reject_mint=False).where("hard_reject").count()


def test_markets_by_venue(spark):
    names = "token string, a bigint, id bigint, quote bigint, base bigint, pool string, on_pool boolean, v_quote string, v_base string, real_quote string, real_base string, sqrt_price string, liquidity string, tick string"
    wide = str(10**60)
    row = lambda a, **k: ("t", a, a, 10 + a, 5, k.get("pool"), k.get("on_pool", False), k.get("vq"), k.get("vb"), None, None, k.get("sp"), k.get("liq"), k.get("tick"))
    trades = [
        row(1), row(2, on_pool=True), row(3, vq=wide, vb=str(4 * 10**50), sp="7"), row(4, vq=wide, vb=str(3 * 10**50)), row(5, vq="9"), row(6, sp="77", pool="v4", liq="5", tick="-3"), row(7, sp="78"),
        row(8, on_pool=True, pool="cp"), row(9, on_pool=True), row(10, sp="79"), row(11),
    ]
    ticks = spark.createDataFrame([("t", a, "MILESTONE") for a in range(12)], "token string, age bigint, kind string")
    got = {r.age: r for r in state.market(spark.createDataFrame(trades, names), ticks).collect()}
    assert [got[a].market_type for a in range(12)] == ["UNKNOWN"] * 3 + ["BONDING_CURVE"] * 3 + ["UNISWAP_V4"] * 2 + ["CONSTANT_PRODUCT"] * 2 + ["UNISWAP_V4"] * 2
    assert [got[a].price_x18 for a in (0, 1, 3, 5, 7, 9, 11)] == [None, str(11 * 10**18 // 5), str(10**60 * 10**18 // (4 * 10**50)), None, str(17 * 10**18 // 5), None, str(21 * 10**18 // 5)]
    assert [got[a].curve_progress_bps for a in (2, 3, 4, 5, 8)] == [None, 0, 2500, None, None]
    assert [(got[a].sqrt_price, got[a].liquidity, got[a].tick, got[a].pool) for a in (6, 7, 10)] == [("77", "5", "-3", "v4"), ("78", None, None, "v4"), ("79", None, None, None)]
    assert (got[8].last_quote, got[9].last_quote, got[9].pool, got[9].quality, got[6].quality, got[0].quality) == ("18", "19", "cp", "PARTIAL", "COMPLETE", "UNKNOWN")
    assert math.isclose(float(got[3].v_quote), 1e60) and got[6].v_quote is None
