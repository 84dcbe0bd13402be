"""Candidate funnel: states of a token as its snapshots come, and signals from features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.wideint import let

MAX_HOPS = 8
RANK = {"DISCOVERED": 0, "SECURITY_PENDING": 1, "DATA_INCOMPLETE": 2, "WATCHING": 3, "CONFIRMING": 4, "ELIGIBLE": 5}


@dataclass(frozen=True)
class Policy:
    policy_id: str = "default"
    confirm_age: int = 5_000
    confirm_trades: int = 1
    confirm_buyers: int = 1
    eligible_age: int = 15_000
    eligible_trades: int = 3
    eligible_buyers: int = 2
    max_age: int = 3_600_000
    quiet: int = 300_000
    allow_warn: bool = True


DEFAULT = Policy()
CONSERVATIVE = Policy("conservative", eligible_age=30_000, eligible_trades=8, eligible_buyers=5)


def _step(state: Column, x: Column, p: Policy) -> Column:
    """'STATE REASON' of the next transition, or NULL."""
    to = lambda s, why: F.lit(f"{s} {why}")
    age, n, buyers, verdict = x["age"], x["trade_count"], x["unique_buyers"], x["verdict"]
    progress = (
        F.when(state.isin("DISCOVERED", "SECURITY_PENDING", "DATA_INCOMPLETE"), to("WATCHING", "SECURITY_PASS_OR_WARN"))
        .when((state == "WATCHING") & (age >= p.confirm_age) & (n >= p.confirm_trades) & (buyers >= p.confirm_buyers), to("CONFIRMING", "MIN_MARKET_EVIDENCE"))
        .when((state == "CONFIRMING") & (age >= p.eligible_age) & (n >= p.eligible_trades) & (buyers >= p.eligible_buyers), to("ELIGIBLE", "MIN_DATA_FOR_STRATEGY_EVAL"))
    )
    if not p.allow_warn:
        progress = F.when(verdict == "WARN", F.when(state != "DATA_INCOMPLETE", to("DATA_INCOMPLETE", "SECURITY_WARN_NOT_ALLOWED"))).otherwise(progress)
    return (
        F.when(state == "SECURITY_REJECTED", None)
        .when(F.coalesce(verdict == "REJECT", F.lit(False)), to("SECURITY_REJECTED", "SECURITY_REJECT"))
        .when(state == "EXPIRED", None)
        .when(x["lifecycle"] == "INACTIVE", to("EXPIRED", "PROTOCOL_ENDED"))
        .when(age > p.max_age, F.when(buyers < p.eligible_buyers, to("EXPIRED", "INSUFFICIENT_BUYERS")).otherwise(to("EXPIRED", "MAX_WATCH_AGE")))
        .when((n == 0) & (age >= p.quiet), to("EXPIRED", "NO_ACTIVITY"))
        .when((n > 0) & F.coalesce(x["idle"] >= p.quiet, F.lit(False)), to("EXPIRED", "MARKET_DEAD"))
        .when(verdict.isNull(), F.when(state == "DISCOVERED", to("SECURITY_PENDING", "AWAITING_SECURITY")))
        .when(verdict == "UNKNOWN", F.when(state.isin("DISCOVERED", "SECURITY_PENDING"), to("DATA_INCOMPLETE", "SECURITY_UNKNOWN")))
        .otherwise(progress)
    )


def _hop(p: Policy):
    """One step of the fold: the state after it, the log of transitions, and the snapshot that gives no further one."""

    def merge(acc, hop):
        x = hop["x"]

        def moved(step):
            entry = F.struct(x["age"].cast("bigint").alias("age"), acc["state"].alias("from_state"), step.alias("step"))
            on = F.struct(F.split_part(step, F.lit(" "), F.lit(1)).alias("state"), F.concat(acc["log"], F.array(entry)).alias("log"), F.lit(-1).alias("over"))
            return F.when(step.isNotNull(), on).otherwise(F.struct(acc["state"].alias("state"), acc["log"].alias("log"), hop["i"].alias("over")))

        return F.when(acc["over"] == hop["i"], acc).otherwise(let(_step(acc["state"], x, p), moved))

    return merge


def transitions(snapshots: DataFrame, policies=(DEFAULT, CONSERVATIVE)) -> DataFrame:
    """(token, policy_id, seq, age, from_state, to_state, reason): a fold over each token's ordered snapshots.

    ``snapshots``: token, age, trade_count, unique_buyers, idle, lifecycle, verdict.  A
    snapshot may make several hops; a token has a bounded number of snapshots.  All policies
    fold the same array, so snapshots are gathered once.
    """
    rows = snapshots.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("age", "trade_count", "unique_buyers", "idle", "lifecycle", "verdict"))).alias("xs"))
    # one element for each hop that a snapshot may make; after one that changes nothing the others are passed over
    hops = rows.select("token", F.flatten(F.transform("xs", lambda x, i: F.array_repeat(F.struct(i.alias("i"), x.alias("x")), MAX_HOPS))).alias("hops"))
    log = F.array().cast("array<struct<age:bigint,from_state:string,step:string>>")
    start = F.struct(F.lit("DISCOVERED").alias("state"), log.alias("log"), F.lit(-1).alias("over"))
    folds = F.array(*(F.struct(F.lit(p.policy_id).alias("policy_id"), F.aggregate("hops", start, _hop(p), lambda a: a["log"]).alias("log")) for p in policies))
    out = hops.select("token", F.explode(folds).alias("f")).select("token", "f.policy_id", "f.log")
    return out.select("token", "policy_id", F.posexplode("log").alias("seq", "x")).select("token", "policy_id", "seq", "x.age", "x.from_state", F.split_part("x.step", F.lit(" "), F.lit(1)).alias("to_state"), F.split_part("x.step", F.lit(" "), F.lit(2)).alias("reason"))


def first_eligible(log: DataFrame) -> DataFrame:
    return log.where("to_state = 'ELIGIBLE'").groupBy("token", "policy_id").agg(F.min("age").alias("eligible_age"))


def highest_state(log: DataFrame) -> DataFrame:
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), "to_state")
    return log.groupBy("token", "policy_id").agg(F.max_by("to_state", F.when(rank.isNotNull(), rank)).alias("highest_state"))


def funnel(log: DataFrame) -> DataFrame:
    """Tokens that ever reached each state."""
    return log.groupBy("policy_id", "to_state").agg(F.count_distinct("token").alias("tokens"))


@dataclass(frozen=True)
class Thresholds:
    accel: int = 1
    velocity: int = 2
    buyers: int = 3
    max_repeat: int = 6_000
    min_new: int = 2_000
    curve: tuple[int, int] = (200, 8_000)
    age: int = 15_000
    reject_creator_sold: bool = False


STRATEGIES = ("S0_BASELINE", "S1_BUYER_GROWTH", "S2_FLOW_CONFIRMATION", "S3_BROAD_PARTICIPATION", "S4_CREATOR_FILTERED", "S5_CURVE_CONFIRMATION", "S6_HYBRID")


def strategy_reason(name: str, t: Thresholds = Thresholds()) -> Column:
    """SIGNAL, or why a strategy doesn't enter; columns are features with verdict and candidate state."""
    no, gap = F.lit("STRATEGY_FILTER"), F.lit("DATA_INCOMPLETE")
    c = F.col
    checks = [(F.coalesce(c("verdict") == "REJECT", F.lit(False)), F.lit("SECURITY_REJECT")), (c("candidate") != "ELIGIBLE", F.lit("NOT_ELIGIBLE"))]
    if name != "S0_BASELINE":
        checks += [(c("trade_count").isNull(), gap), (c("age") < t.age, F.lit("MIN_AGE"))]
    s = name[:2]
    if s in ("S1", "S2", "S6"):
        checks += [(c("buyer_acceleration_15s").isNull(), gap), (c("buyer_acceleration_15s") < t.accel, no), (F.coalesce(c("buyer_velocity_15s") < t.velocity, F.lit(True)), no)]
    if s in ("S2", "S6"):
        checks += [(c("net_flow") < 0, no), (c("imbalance") < 0, no)]
    if s in ("S3", "S6"):
        checks += [(c("unique_buyers") < t.buyers, no), (c("repeat_buyer_bps") > t.max_repeat, no), (c("new_buyer_30s_bps") < t.min_new, no)]
    if s in ("S4", "S6") and t.reject_creator_sold:
        checks += [(c("creator_sells") > 0, no)]
    if s in ("S5", "S6"):
        checks += [(c("curve_progress_bps") < t.curve[0], no), (c("curve_progress_bps") > t.curve[1], no)]
        checks += [(c("curve_progress_bps").isNull(), gap)] if s == "S5" else []
        checks += [(c("unique_buyers") < t.buyers, no)]
    out = F.lit("SIGNAL")
    for bad, why in reversed(checks):
        out = F.when(bad, why).otherwise(out)
    return out


def strategies(features: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(token, age, strategy, enter, reason) for all strategies."""
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), strategy_reason(n, t).alias("reason")) for n in STRATEGIES)))
    return features.select("token", "age", every.alias("x")).select("token", "age", "x.strategy", (F.col("x.reason") == "SIGNAL").alias("enter"), "x.reason")


def prospective() -> dict[str, Column]:
    """Policies P0-P4 over features; eligibility and verdict are checked by the caller."""
    ub = F.greatest("w30_unique_buyers", "unique_buyers")
    up = F.coalesce("price_change_30s_bps", "price_change_15s_bps", F.lit(0)) > 0
    growth = (F.col("w30_new_buyers") > 0) | (F.coalesce("buyer_acceleration_15s", F.lit(0)) > 0)
    return {"P0_FIRST_ELIGIBLE_CONTROL": F.lit(True), "P1_SOLANA_BUYERS_3_30S": ub >= 3, "P2_SOLANA_BUYERS_PLUS_IMBALANCE": growth & (F.col("imbalance") > 0), "P3_PRICE_WITHOUT_BUYERS_AVOID": ~up | growth, "P4_LOW_PARTICIPATION_FILTER": ub >= 3}


def delayed_entries(snapshots: DataFrame, eligible: DataFrame, delays=(0, 30_000, 60_000, 120_000), seed: str = "e5", chance_bps: int = 5_000) -> DataFrame:
    """(token, policy, age): first snapshot at or after eligibility and each delay, and a seeded control."""
    from tidemark.functions.amounts import seeded_hit

    every = F.explode(F.array(*(F.struct(F.lit(f"E{k + 1}").alias("policy"), F.lit(d).cast("bigint").alias("delay")) for k, d in enumerate(delays))))
    wanted = eligible.select("token", "eligible_age", every.alias("p")).select("token", (F.col("eligible_age") + F.col("p.delay")).alias("from_age"), "p.policy")
    rows = snapshots.select("token", "age").join(wanted, "token").where("age >= from_age").groupBy("token", "policy").agg(F.min("age").alias("age"))
    control = rows.where("policy = 'E1'").where(seeded_hit(seed, F.col("token"), chance_bps)).withColumn("policy", F.lit("E5"))
    return rows.unionByName(control)


def signal_counts(signals: DataFrame, outcomes: DataFrame, policies: tuple[str, ...] = ()) -> DataFrame:
    """Per policy: observations, signals and hits (outcomes: token, hit).  ``policies`` have a row, of zeros, even without observations."""
    j = signals.join(outcomes, "token", "left")
    out = j.groupBy("policy").agg(F.count("*").alias("n_obs"), F.count_if("enter").alias("n_signals"), F.count_if(F.col("enter") & F.coalesce("hit", F.lit(False))).alias("hits"))
    if policies:
        named = signals.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, policies))).alias("policy"))
        out = out.join(named, "policy", "full").na.fill(0, ["n_obs", "n_signals", "hits"])
    return out


def trained(features: DataFrame) -> DataFrame:
    """Thresholds from medians of the training rows, floored at 1, 1 and 2.

    The medians are order statistics of whole columns, taken by counting values.
    """
    from tidemark.operators.research import rank_values

    floors = {"buyer_acceleration_15s": 1, "buyer_velocity_15s": 1, "unique_buyers": 2}
    # one row for each column and value, so that all three are taken at once
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("value")) for c in floors)))
    found = rank_values(features.select(each.alias("x")).select("x.*"), "value", (50,), ["column"])
    return found.agg(*(F.greatest(F.max(F.when(F.col("column") == c, F.col("p50"))), F.lit(least)).alias(c) for c, least in floors.items()))
