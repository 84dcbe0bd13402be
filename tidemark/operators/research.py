"""Research aggregation: cohorts, lifts, hypotheses, quantiles, splits and wallets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.amounts import bps

HITS = ("reached_2x", "reached_5x", "reached_10x")


def rate(hit: str | Column, where: Column | None = None) -> Column:
    """Share of rows with a flag, to six digits; NULL without rows."""
    h = F.col(hit) if isinstance(hit, str) else hit
    value = h.cast("int")
    return F.round(F.avg(value if where is None else F.when(where, value)), 6)


def population(outcomes: DataFrame) -> DataFrame:
    """One row: launches, zero-trade, active, invalid and usable labels, and base rates."""
    ok = F.col("quality") != "INVALID"
    return outcomes.agg(
        F.count("*").alias("all_launches"), F.count_if(F.col("n") == 0).alias("zero_trade"), F.count_if(F.col("n") > 0).alias("active"), F.count_if(~ok).alias("invalid_labels"), F.count_if(ok).alias("usable_labels"),
        *(rate(h, ok).alias(f"p{h[8:-1]}") for h in HITS),
    )


def cohorts(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("quality <> 'INVALID'").groupBy("cohort").agg(F.count("*").alias("tokens"))


def usable(horizons: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Horizon rows of tokens with a usable label."""
    return horizons.join(outcomes.where("quality <> 'INVALID'").select("token", *HITS), "token")


def lift(rows: DataFrame, buyers: int = 3) -> DataFrame:
    """Hit rates by horizon with and without early participation."""
    return rows.groupBy("h", (F.col("unique_buyers") >= buyers).alias("broad")).agg(F.count("*").alias("n"), *(rate(h).alias(f"p{h[8:-1]}") for h in HITS))


def pairwise(rows: DataFrame) -> DataFrame:
    """Buyers with net flow against a price rise without buyers, by horizon."""
    grew = F.col("buys") >= 2
    both, price = grew & (F.col("imbalance") > 0), (F.coalesce("price_change_bps", F.lit(0)) > 0) & ~grew
    return rows.groupBy("h").agg(F.count_if(both).alias("flow_n"), rate("reached_10x", both).alias("flow_p10"), F.count_if(price).alias("price_only_n"), rate("reached_10x", price).alias("price_only_p10"))


def hypotheses(rows: DataFrame, by: list[str]) -> DataFrame:
    """H1-H4 per group: n, p2, p10."""
    ub, imb = F.col("unique_buyers"), F.col("imbalance")
    up, growth = F.coalesce("price_change_bps", F.lit(0)) > 0, (F.col("unique_buyers") >= 2) | (F.col("buys") >= 2)
    tests = {"H1_buyers_ge_3": ub >= 3, "H1_complement": ub < 3, "H2_buyers_plus_imbalance": growth & (imb > 0), "H3_price_without_buyers": up & ~growth, "H4_low_participation": ub < 3}
    long = rows.select(*by, *HITS, F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c.alias("c")) for k, c in tests.items()))).alias("t"))
    c = F.col("t.c")
    return long.groupBy(*by, F.col("t.k").alias("hypothesis")).agg(F.count_if(c).alias("n"), rate("reached_2x", c).alias("p2"), rate("reached_10x", c).alias("p10"))


#: (label, the hypothesis that should be higher, the one it is compared with).
DIRECTIONS = (("H1", "H1_buyers_ge_3", "H1_complement"), ("H2", "H2_buyers_plus_imbalance", "H3_price_without_buyers"), ("H4", "H4_low_participation", "H1_buyers_ge_3"))


def directions(per_shard: DataFrame) -> DataFrame:
    """Whether each hypothesis points one way in all shards (shard, hypothesis, n, p2, p10)."""
    wide = per_shard.groupBy("shard").agg(*(F.max(F.when(F.col("hypothesis") == k, F.col("p2"))).alias(k) for k in sorted({x for d in DIRECTIONS for x in d[1:]})))
    rows = wide.select("shard", F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.signum(F.col(a) - F.col(b)).alias("s")) for k, a, b in DIRECTIONS))).alias("x")).select("x.*")
    out = rows.groupBy("label").agg(F.count("s").alias("n_comparable"), F.min("s").alias("low"), F.max("s").alias("high"))
    verdict = F.when(F.col("n_comparable") == 0, "INSUFFICIENT").when(F.col("low") == 1, "CONSISTENT_DIRECTION").when(F.col("high") == -1, "OPPOSITE").otherwise("MIXED")
    return out.select("label", "n_comparable", verdict.alias("verdict"))


def pooled(per_shard: DataFrame) -> DataFrame:
    """Hypotheses over all shards, weighted by their n."""
    w = lambda p: F.round(F.sum(F.col(p) * F.col("n")) / F.sum(F.when(F.col("n") > 0, F.col("n"))), 6)
    return per_shard.groupBy("hypothesis").agg(F.sum("n").alias("n"), w("p2").alias("p2"), w("p10").alias("p10"))


def _classes(value: Column) -> tuple[Column, Column]:
    """Two levels of classes that keep the order of numbers: some thousand coarse ones, each in up to 4096."""
    x = value.cast("double")
    size = F.log2(F.abs(x) + 1) * 64
    sign = F.signum(x)
    return (sign * F.floor(size)).cast("bigint"), (sign * F.floor((size - F.floor(size)) * 4096)).cast("bigint")


def placed(counts: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """``counts`` (by, value, n; one row a value) with ``start``, the rows of its group before the value, and ``total``.

    Prefix sums on three levels: over coarse classes, over the classes within one, and over the values within that.
    No window has more rows than there are classes or values in a class, so a large group is many tasks' work.
    """
    coarse, fine = _classes(F.col(value))
    x = counts.withColumns({"__a": coarse, "__b": fine})
    small = x.groupBy(*by, "__a", "__b").agg(F.sum(n).alias("__s"))
    group = [*by] or [F.lit(0)]
    middle = small.groupBy(*by, "__a").agg(F.sum("__s").alias("__m"))
    over = Window.partitionBy(*group)
    before = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    middle = middle.select(*(F.col(c).alias(f"__g{k}") for k, c in enumerate(by)), F.col("__a").alias("__a2"), before("__m", over.orderBy("__a")).alias("__base"), F.sum("__m").over(over).alias("total"))
    same = lambda keys: [F.col(c).eqNullSafe(F.col(f"__g{k}")) for k, c in enumerate(by)] + [F.col(c) == F.col(f"{c}2") for c in keys]
    small = small.withColumn("__in", before("__s", Window.partitionBy(*by, "__a").orderBy("__b"))).join(middle, same(["__a"]))
    small = small.select(*(F.col(f"__g{k}") for k in range(len(by))), "__a2", F.col("__b").alias("__b2"), (F.col("__base") + F.col("__in")).alias("__base"), "total")
    out = x.join(small, same(["__a", "__b"])).withColumn("start", F.col("__base") + before(n, Window.partitionBy(*by, "__a", "__b").orderBy(value)))
    return out.select(*counts.columns, "start", "total")


def rank_values(rows: DataFrame, column: str, percents: tuple[int, ...], by=()) -> DataFrame:
    """Nearest-rank quantiles of each group, all in one pass: p25 and so on, the values at index floor((n - 1) q / 100).

    Values are counted first, so that distinct values and not rows are ordered.
    """
    by = list(by)
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("c"))
    x = placed(counts, by, "value", "c")
    at = lambda q: F.floor((F.col("total") - 1) * q / 100)
    return x.groupBy(*by).agg(*(F.max(F.when((F.col("start") <= at(q)) & (at(q) < F.col("start") + F.col("c")), F.col("value"))).alias(f"p{q}") for q in percents))


def rank_value(rows: DataFrame, column: str, percent: int, by=()) -> DataFrame:
    """One nearest-rank quantile of each group, as ``value``."""
    return rank_values(rows, column, (percent,), by).withColumnRenamed(f"p{percent}", "value")


def feature_stats(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """n, quartiles and missing rate of a feature per group."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), bps(F.count_if(F.col(column).isNull()), F.count("*")).alias("missing_bps"))
    return out.join(rank_values(rows, column, (25, 50, 75), by), by, "left")


def feature_lift(rows: DataFrame, signal: Column, by: list[str]) -> DataFrame:
    """Hit rate of rows with a signal against all."""
    hit = F.col("reached_5x")
    return rows.groupBy(*by).agg(bps(F.count_if(hit), F.count("*")).alias("base_bps"), F.coalesce(bps(F.count_if(hit & signal), F.count_if(signal)), F.lit(0)).alias("signal_bps"))


def quintiles(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Hit rate by fifth of a feature, cut at floor(n q / 5); ties by token.

    Values are counted first; only rows of a value that a cut goes through are ordered.
    """
    keys, hit = [*by, "value"], F.coalesce(F.col("reached_5x"), F.lit(False))
    v = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("value"), "token", hit.alias("hit"))
    counts = v.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    counts = placed(counts, by, "value", "n").withColumnRenamed("total", "n_all")
    fifth = lambda i: sum((F.when(i >= F.floor(F.col("n_all") * q / 5), 1).otherwise(0) for q in range(1, 5)), F.lit(1))
    counts = counts.withColumn("quintile", fifth(F.col("start"))).withColumn("last", fifth(F.col("start") + F.col("n") - 1))
    cut = v.join(counts.where("quintile < last").select(*keys, "start", "n_all"), keys)
    place = F.col("start") + F.row_number().over(Window.partitionBy(*keys).orderBy("token")) - 1
    cut = cut.withColumn("quintile", fifth(place)).groupBy(*by, "quintile").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    parts = counts.where("quintile = last").select(*by, "quintile", "n", "hits").unionByName(cut)
    return parts.groupBy(*by, "quintile").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(*by, "quintile", "n", bps(F.col("hits"), F.col("n")).alias("hit_bps"))


def split_by_time(tokens: DataFrame, time: str) -> DataFrame:
    """TRAIN, VALIDATION or TEST by 60/20/20 of the time span."""
    span = tokens.agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    at = F.col(time) - F.col("__a")
    out = tokens.crossJoin(F.broadcast(span))
    return out.withColumn("split", F.when(at * 10 < (F.col("__b") - F.col("__a")) * 6, "TRAIN").when(at * 10 < (F.col("__b") - F.col("__a")) * 8, "VALIDATION").otherwise("TEST")).drop("__a", "__b")


def sample_label(n: Column) -> Column:
    return F.when(n < 30, "INSUFFICIENT").when(n < 200, "EXPLORATORY").otherwise("ADEQUATE")


def milestone_coverage(grid: DataFrame, features: DataFrame, ages: DataFrame) -> DataFrame:
    """Per milestone: tokens old enough (ages: token, age_now) and those with a feature row."""
    old = grid.where("kind = 'MILESTONE'").join(ages, "token").where("age_now >= age").select("token", "age")
    have = features.select("token", "age").distinct().withColumn("have", F.lit(True))
    return old.join(have, ["token", "age"], "left").groupBy("age").agg(F.count("*").alias("due"), F.count("have").alias("present"))


def hour_gaps(rows: DataFrame, ms: str, by: list[str]) -> DataFrame:
    """Missing hours between observed ones: first and last of each gap."""
    hours = rows.select(*by, F.floor(F.col(ms) / 3_600_000).alias("hour")).distinct()
    x = hours.withColumn("next", F.lead("hour").over(Window.partitionBy(*by).orderBy("hour")))
    return x.where("next - hour > 1").select(*by, (F.col("hour") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"))


def hour_histogram(rows: DataFrame, ms: str, by: list[str]) -> DataFrame:
    """Rows per hour since 1970, hours without rows left out."""
    return rows.where(F.col(ms).isNotNull()).groupBy(*by, F.floor(F.col(ms) / 3_600_000).alias("hour")).agg(F.count("*").alias("n"))


def cross_chain(activity: DataFrame) -> DataFrame:
    """Wallets on two chains or more."""
    return activity.groupBy("trader").agg(F.count_distinct("chain").alias("chains")).where("chains >= 2")


def wallet_rollup(trades: DataFrame) -> DataFrame:
    """Activity by (wallet, chain) and by (wallet, chain, token); token is NULL in the coarser rows."""
    aggregates = [F.count("*").alias("trades"), F.count_if(F.col("side") == "buy").alias("buys"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")]
    return trades.groupingSets([[F.col("trader"), F.col("chain"), F.col("token")], [F.col("trader"), F.col("chain")]], "trader", "chain", "token").agg(*aggregates)


def recent(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(n)
