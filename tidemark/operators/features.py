"""Feature columns of a snapshot; nothing looks past the snapshot's own age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.amounts import bps, floor_div, return_bps, wide
from tidemark.operators.asof import as_of

E18 = 10**18
#: Feature names that would come from the future.
OUTCOMES = ("final_return_bps", "max_return_bps", "max_drawdown_bps", "reached_2x", "reached_5x", "reached_10x", "reached_20x", "outcome_maturity")
#: Columns without a source yet: always NULL, never 0.
UNKNOWN = ("holder_count", "bundle_share_bps", "cluster_count", "wash_share_bps", "exit_capacity")


def totals(s: DataFrame) -> dict[str, Column]:
    n, v = F.col("buys") + F.col("sells"), F.col("buy_quote") + F.col("sell_quote")
    return {
        "trade_count": n, "average_trade": floor_div(v, n).cast("bigint"), "average_buy": floor_div(F.col("buy_quote"), F.col("buys")).cast("bigint"), "average_sell": floor_div(F.col("sell_quote"), F.col("sells")).cast("bigint"),
        "net_flow": F.col("buy_quote") - F.col("sell_quote"), "creator_net_flow": F.col("creator_buy_quote") - F.col("creator_sell_quote"),
    }


def ratios(s: DataFrame | None) -> dict[str, Column]:
    """Ratios in basis points, uncapped; of repeat buyers too if ``s`` has them (``state.concentration``)."""
    repeat = {"repeat_buyer_bps": bps(F.col("repeat_buyers"), F.col("unique_buyers"))} if s is not None and "repeat_buyers" in s.columns else {}
    return repeat | {
        "buy_sell_count_bps": bps(F.col("buys"), F.col("sells")), "buy_sell_volume_bps": bps(F.col("buy_quote"), F.col("sell_quote")), "unique_buyer_seller_bps": bps(F.col("unique_buyers"), F.col("unique_sellers")),
        "creator_sold_bps": bps(F.col("creator_sell_quote"), F.col("creator_buy_quote")), "new_buyer_30s_bps": bps(F.col("w30_new_buyers"), F.col("w30_unique_buyers")),
    }


def imbalances(windows) -> dict[str, Column]:
    return {"imbalance": F.col("buys") - F.col("sells")} | {f"w{w}_imbalance": F.col(f"w{w}_buys") - F.col(f"w{w}_sells") for w in windows}


def velocities() -> dict[str, Column]:
    rate = floor_div((F.col("buys") + F.col("sells")) * 1_000_000, F.col("age"))
    return {f"{s}er_velocity_{w}s": F.col(f"w{w}_unique_{s}ers") for s in ("buy", "sell") for w in (5, 15)} | {"trades_per_second_x1000": rate.cast("bigint")}


def accelerations(snapshots: DataFrame, wanted=(("buyers", 5), ("buyers", 15), ("buyers", 30), ("sellers", 15), ("sellers", 30)), flows=(15,)) -> DataFrame:
    """Window value at T less that of the latest snapshot at or before T - W; NULL without one. Net flow is signed.

    One row per (token, age). Each row is dealt out once per lag and the past values are carried along one sorted
    window, so all lags share a shuffle by token.
    """
    values: dict[str, tuple[int, Column]] = {f"{who[:-1]}_acceleration_{w}s": (w, F.col(f"w{w}_unique_{who}")) for who, w in wanted}
    for w in flows:
        values[f"net_flow_velocity_{w}s"] = w, F.col(f"w{w}_buy_quote") - F.col(f"w{w}_sell_quote")
        values[f"volume_velocity_{w}s"] = w, F.col(f"w{w}_buy_quote") + F.col(f"w{w}_sell_quote")
    lags = sorted({w for w, _ in values.values()})
    now = F.struct(*(c.alias(k) for k, (_, c) in values.items()))
    rows = snapshots.select("token", "age", F.struct("*").alias("__row"), now.alias("__now")).withColumn("__w", F.explode(F.array(*map(F.lit, [0, *lags]))))
    w = Window.partitionBy("token").orderBy(F.col("age") - 1000 * F.col("__w"), F.col("__w") > 0).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("__w") == 0
    rows = rows.select("token", "age", "__w", F.when(own, F.col("__row")).alias("__row"), F.last(F.when(own, F.col("__now")), ignorenulls=True).over(w).alias("__then"))
    then = (F.max(F.when(F.col("__w") == lag, F.col("__then")[k])).alias(f"__{k}") for k, (lag, _) in values.items())
    out = rows.groupBy("token", "age").agg(F.first("__row", ignorenulls=True).alias("__row"), *then)
    return out.select("__row.*", *(F.col(f"__{k}") for k in values)).select(*snapshots.columns, *((c - F.col(f"__{k}")).alias(k) for k, (_, c) in values.items()))


def price_x18(quote: Column, base: Column) -> Column:
    """Price of one unit times 10**18, floored; NULL beyond 38 digits."""
    return floor_div(F.try_multiply(wide(quote), F.lit(E18).cast("decimal(19,0)")).cast("decimal(38,0)"), base)


def price_changes(ticks: DataFrame, trades: DataFrame, seconds=(5, 15, 30, 60)) -> DataFrame:
    """Last trade price at each tick and its change in bps against that of T - s, truncated toward zero.

    Equal ticks give one row. All lags share one as-of join.
    """
    px = trades.select("token", F.col("a").alias("__at"), "id", price_x18(F.col("quote"), F.col("base")).alias("px"))
    asked = ticks.withColumn("__s", F.explode(F.array(*map(F.lit, [0, *seconds]))))
    found = as_of(asked, px, ["token"], F.col("age") - 1000 * F.col("__s"), F.col("__at"), ["__at", "id"], "__p")
    at = (F.max(F.when(F.col("__s") == s, F.col("__p.px"))).alias(f"__{s}") for s in (0, *seconds))
    change = (return_bps(F.col("__0"), F.col(f"__{s}")).alias(f"price_change_{s}s_bps") for s in seconds)
    return found.groupBy(*ticks.columns).agg(*at).select(*ticks.columns, F.col("__0").alias("price_x18"), *change)


def liquidity(venue: Column, curve_real: Column, pool_quote: Column, v4: Column) -> tuple[Column, Column]:
    """(liquidity, quality) by venue."""
    value = F.when(venue == "CURVE", curve_real).when(venue == "POOL", pool_quote).when(venue == "V4", v4)
    return value, F.when(value.isNull(), "UNKNOWN").when(venue == "V4", "PARTIAL").otherwise("VALUE")


def stage_flags(state: Column) -> dict[str, Column]:
    return {"on_curve": state.isin("DISCOVERED", "CURVE_ACTIVE"), "graduating": state.isin("MIGRATING", "GRADUATION_GAP"), "graduated": state == "AMM_ACTIVE"}


def venue_struct(venue: Column, curve: Column, pool: Column, v4: Column) -> Column:
    """One struct with a branch for each venue, NULL where it isn't that one."""
    return F.struct(venue.alias("type"), F.when(venue == "CURVE", curve).alias("curve"), F.when(venue == "POOL", pool).alias("pool"), F.when(venue == "V4", v4).alias("v4"))


def with_unknown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast("bigint") for c in UNKNOWN})


def violations(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows (token, seq, problem): missing version or time, unknown as zero, time going back, counts that shrink."""
    w = Window.partitionBy("token").orderBy(seq)
    checks = {
        "MISSING_VERSION": F.col("feature_version").isNull(), "MISSING_TIME": F.col("as_of").isNull(), "UNKNOWN_AS_ZERO": F.coalesce(F.col("holder_count") == 0, F.lit(False)),
        "TIME_BACKWARDS": F.coalesce(F.col("as_of") < F.lag("as_of").over(w), F.lit(False)), "COUNT_DECREASED": F.coalesce(F.col("trade_count") < F.lag("trade_count").over(w), F.lit(False)),
    }
    flagged = rows.select("token", seq, *(c.alias(k) for k, c in checks.items()))
    return flagged.select("token", seq, F.explode(F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in checks)))).alias("problem"))


def leaks(schema, outcomes=OUTCOMES) -> list[str]:
    """Outcome columns among a schema's, nested ones included."""
    found = []

    def walk(fields, at):
        for f in fields:
            if f.name in outcomes:
                found.append(at + f.name)
            if hasattr(f.dataType, "fields"):
                walk(f.dataType.fields, f"{at}{f.name}.")

    walk(schema.fields, "")
    return found
