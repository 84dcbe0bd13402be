"""Point-in-time state: the snapshot grid, running totals and sliding windows.

Times are ages in ms since launch.  A snapshot at T sees trades with age <= T; a
window of W sees those in (T - W, T].  Sliding sums are running sums over entries and
exits: a trade enters at its age and leaves W later.  A trader counts as distinct in
a window from each of their trades until their next one or until W has passed.  So
one sort per token gives every window, whatever its number of trades.

Where the ages of the ticks are given, changes are summed up to the next tick before
the sort, so a hot token sorts no more rows than it has ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MILESTONES = (5_000, 15_000, 30_000, 60_000, 120_000, 300_000, 900_000, 1_800_000, 3_600_000)
#: (until, step) of the snapshot bands.
BANDS = ((300_000, 5_000), (1_800_000, 15_000), (7_200_000, 60_000))
WINDOWS = (5, 15, 30, 60, 120, 300, 900)
HORIZONS = (5_000, 15_000, 30_000, 60_000, 120_000, 300_000, 900_000)
SIDES = ("buy", "sell")
#: All ages of the grid.
AGES = sorted({*MILESTONES, *(a for begin, (until, step) in zip((0, *(u for u, _ in BANDS)), BANDS) for a in range(begin + step, until + 1, step))})


def with_earlier(ages, seconds, known=AGES) -> list[int]:
    """``ages`` and, for each lag, the last known age at or before an age less that lag."""
    earlier = {max((k for k in known if k <= a - 1000 * s), default=None) for a in ages for s in seconds}
    return sorted({*ages, *earlier} - {None})


def next_age(age: Column, ages) -> Column:
    """The first of ``ages`` at or after ``age``; NULL past the last one."""
    runs: list[list[int]] = []  # first, last and step
    for a in sorted(set(ages)):
        if runs and runs[-1][2] in (0, a - runs[-1][1]):
            runs[-1][1:] = [a, a - runs[-1][1]]
        else:
            runs.append([a, a, 0])
    out = F.lit(None).cast("bigint")
    for first, last, step in reversed(runs):
        if step:
            out = F.when(age <= last, F.lit(first) + F.ceil((age - first) / step) * step).otherwise(out)
        out = F.when(age <= first, F.lit(first)).otherwise(out)
    return out.cast("bigint")


def grid(launches: DataFrame, milestones=MILESTONES, bands=BANDS) -> DataFrame:
    """(token, age, kind) for every launch, traded or not."""
    steps, begin = [F.array(*(F.lit(m).cast("bigint") for m in milestones))], 0
    for until, step in bands:
        steps.append(F.sequence(F.lit(begin + step).cast("bigint"), F.lit(until).cast("bigint"), F.lit(step).cast("bigint")))
        begin = until
    ages = launches.select("token", F.explode(F.array_sort(F.array_distinct(F.concat(*steps)))).alias("age"))
    return ages.withColumn("kind", F.when(F.col("age").isin(*milestones), "MILESTONE").otherwise("BAND"))


def due(ticks: DataFrame, after: int, until: int) -> DataFrame:
    """Ticks of the half-open interval (after, until]."""
    return ticks.where((F.col("age") > after) & (F.col("age") <= until))


def _sums(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("token", "age", "tick", "kind")]


def _carried(ticks: DataFrame, changes: DataFrame, ages=None) -> DataFrame:
    """Running sums of ``changes`` at each tick, changes at the tick's own age included.

    ``ages`` holds every age that a tick has; without it each change is sorted by itself.
    """
    w = Window.partitionBy("token").orderBy("age").rangeBetween(Window.unboundedPreceding, 0)
    names = _sums(changes)
    if ages is not None:
        changes = changes.withColumn("age", next_age(F.col("age"), ages)).where("age IS NOT NULL").groupBy("token", "age").agg(*(F.sum(c).alias(c) for c in names))
    both = changes.withColumn("tick", F.lit(False)).withColumn("kind", F.lit(None).cast("string")).unionByName(ticks.withColumn("tick", F.lit(True)), allowMissingColumns=True)
    return both.select("token", "age", "kind", "tick", *(F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint").alias(c) for c in names)).where("tick").drop("tick")


def cumulative(trades: DataFrame, ticks: DataFrame, ages=None) -> DataFrame:
    """Totals, unique traders and creator flow at every tick.

    ``trades``: token, a (age), id, trader, side, quote, base, mine (by the creator); ``ages``: every age of the ticks.
    """
    first = lambda *by: (F.row_number().over(Window.partitionBy("token", *by).orderBy("a", "id")) == 1).cast("bigint")
    t = trades.withColumn("first", first("trader")).withColumn("first_side", first("trader", "side"))
    one, mine = F.lit(1).cast("bigint"), F.coalesce(F.col("mine"), F.lit(False))
    cols = {}
    for s in SIDES:
        is_s = F.col("side") == s
        cols |= {f"{s}s": F.when(is_s, one), f"{s}_quote": F.when(is_s, F.col("quote")), f"{s}_base": F.when(is_s, F.col("base")), f"unique_{s}ers": F.when(is_s, F.col("first_side"))}
        cols |= {f"creator_{s}s": F.when(is_s & mine, one), f"creator_{s}_quote": F.when(is_s & mine, F.col("quote"))}
    cols["unique_traders"] = F.col("first")
    return _carried(ticks, t.select("token", F.col("a").alias("age"), *(F.coalesce(v, F.lit(0)).alias(k) for k, v in cols.items())), ages)


def last_ages(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """Age of the first and last trade, last buy, last sell and the creator's last sell at every tick."""
    w = Window.partitionBy("token").orderBy("age").rangeBetween(Window.unboundedPreceding, 0)
    rows = trades.select("token", F.col("a").alias("age"), "side", "mine").withColumn("tick", F.lit(False)).withColumn("kind", F.lit(None).cast("string"))
    both = rows.unionByName(ticks.withColumn("tick", F.lit(True)), allowMissingColumns=True)
    at = lambda c: F.when(~F.col("tick") & c, F.col("age"))
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    out = both.select(
        "token", "age", "kind", "tick", F.min(at(F.lit(True))).over(w).alias("first_trade_age"), F.max(at(F.lit(True))).over(w).alias("last_trade_age"), F.max(at(buy)).over(w).alias("last_buy_age"),
        F.max(at(sell)).over(w).alias("last_sell_age"), F.max(at(sell & F.col("mine"))).over(w).alias("creator_last_sell_age"),
    )
    return out.where("tick").drop("tick")


def rolling(trades: DataFrame, ticks: DataFrame, windows=WINDOWS, ages=None, kinds=("flow", "unique")) -> DataFrame:
    """For each window of w seconds: counts, volumes, creator volumes and new traders (flow), unique traders (unique) by side.

    ``ages``: every age of the ticks.
    """
    per_side = Window.partitionBy("token", "trader", "side").orderBy("a", "id")
    flow, unique = "flow" in kinds, "unique" in kinds
    t = trades
    if unique:
        t = t.withColumn("next", F.lead("a").over(per_side))
    if flow:
        t = t.withColumn("new", (F.row_number().over(per_side) == 1).cast("bigint"))
    mine = F.coalesce(F.col("mine"), F.lit(False)).cast("bigint")
    # entries count for all windows (w = 0), exits after a window for that one; a trader's stay ends with the next trade at the latest
    move = lambda w, age, f, u: F.struct(F.lit(w).alias("w"), age.alias("age"), F.lit(f).cast("bigint").alias("f"), F.lit(u).cast("bigint").alias("u"))
    moves = [move(0, F.col("a"), 1, 1)]
    moves += [move(w, F.col("a") + 1000 * w, -1, 0) for w in windows] if flow else []
    moves += [move(w, F.least(F.col("a") + 1000 * w, F.col("next")), 0, -1) for w in windows] if unique else []
    values = {}
    for s in SIDES:
        is_s = (F.col("side") == s).cast("bigint")
        if flow:
            values |= {f"{s}s": F.col("x.f") * is_s, f"{s}_quote": F.col("x.f") * is_s * F.col("quote"), f"creator_{s}_quote": F.col("x.f") * is_s * mine * F.col("quote"), f"new_{s}ers": F.col("x.f") * is_s * F.col("new")}
        if unique:
            values |= {f"unique_{s}ers": F.col("x.u") * is_s}
    rows = t.withColumn("x", F.explode(F.array(*moves)))
    # a few narrow columns are summed up to the next tick first; windows stand side by side only after that
    age = next_age(F.col("x.age"), ages) if ages is not None else F.col("x.age")
    rows = rows.select("token", age.alias("age"), F.col("x.w").alias("w"), *(F.coalesce(v, F.lit(0)).alias(k) for k, v in values.items())).where("age IS NOT NULL")
    sums = rows.groupBy("token", "age", "w").agg(*(F.sum(k).alias(k) for k in values))
    of = lambda w, k: F.coalesce(F.sum(F.when(F.col("w").isin(0, w), F.col(k))), F.lit(0)).alias(f"w{w}_{k}")
    return _carried(ticks, sums.groupBy("token", "age").agg(*(of(w, k) for w in windows for k in values)))


def _later(trades: DataFrame, ticks: DataFrame, ages, within: int | None) -> DataFrame:
    """``trades`` (token, a and others) once for each tick that sees them, as ``age``.

    With ``ages``, a fixed list that holds those of the ticks, a trade finds its ages in the list by itself.  Without it
    it meets the ticks of its token.
    """
    sees = lambda age: (age >= F.col("a")) & ((age < F.col("a") + within) if within else F.lit(True))
    if ages is None:
        return trades.join(ticks.select("token", "age"), "token").where(sees(F.col("age")))
    every = F.array(*(F.lit(x).cast("bigint") for x in sorted(set(ages))))
    return trades.withColumn("age", F.explode(F.filter(every, sees)))


def _at_ranks(counts: DataFrame, keys: list[str], value: str, n: str, ranks: dict[str, Column]) -> DataFrame:
    """Per ``keys`` the values at given ranks from 0, as functions of ``total``, from counts of each value.

    A running count over sorted values, so that no list of values is built.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    x = counts.withColumns({"__upto": F.sum(n).over(w), "total": F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    at = lambda r: (F.col("__upto") - F.col(n) <= r) & (r < F.col("__upto"))
    return x.groupBy(*keys).agg(*(F.max(F.when(at(r), F.col(value))).alias(k) for k, r in ranks.items()))


def rolling_sizes(trades: DataFrame, ticks: DataFrame, window: int = 60, ages=None) -> DataFrame:
    """Smallest, largest and median trade size in the window (an even count gives the floored middle).

    Sizes are counted per tick; ``ages``, a fixed list that holds the ages of the ticks, saves the join with these.
    """
    seen = _later(trades.where("quote IS NOT NULL").select("token", "a", "quote"), ticks, ages, 1000 * window)
    counts = seen.groupBy("token", "age", "quote").agg(F.count("*").alias("n"))
    middle = _at_ranks(counts, ["token", "age"], "quote", "n", {"low": F.floor((F.col("total") - 1) / 2), "high": F.floor(F.col("total") / 2)})
    ends = counts.groupBy("token", "age").agg(F.min("quote").alias("min_size"), F.max("quote").alias("max_size"))
    out = ends.join(middle, ["token", "age"]).select("token", "age", "min_size", "max_size", (F.col("low") + F.floor((F.col("high") - F.col("low")) / 2)).cast("bigint").alias("median_size"))
    return ticks.join(out, ["token", "age"], "left").select("token", "age", "kind", "min_size", "max_size", "median_size")


def concentration(trades: DataFrame, ticks: DataFrame, ages=None) -> DataFrame:
    """Wallet concentration at each tick: repeat buyers, buys per buyer, top trader's share of trades and volume.

    Trades are summed up per trader and next tick first.  Give milestone ticks: each takes its own pass over a token's
    traders.  ``ages``, a fixed list that holds the ages of the ticks, saves the join with these.
    """
    from tidemark.functions.amounts import bps, floor_div

    sums = lambda b, n, v: (F.sum(b).alias("b"), F.sum(n).alias("n"), F.sum(v).alias("v"))
    bought = F.when(F.col("side") == "buy", 1).otherwise(0)
    first = trades.withColumn("a", next_age(F.col("a"), ages)).where("a IS NOT NULL") if ages is not None else trades
    per = first.groupBy("token", "trader", "a").agg(*sums(bought, F.lit(1), "quote"))
    per = _later(per, ticks, ages, None).groupBy("token", "age", "trader").agg(*sums("b", "n", "v"))
    out = per.groupBy("token", "age").agg(
        F.count_if(F.col("b") > 1).alias("repeat_buyers"), F.count_if(F.col("b") > 0).alias("buyers"), F.sum("b").alias("buys"), F.max("n").alias("top_n"), F.sum("n").alias("n"), F.max("v").alias("top_v"), F.sum("v").alias("v"),
    )
    sizes = per.where("b > 0").groupBy("token", "age", "b").agg(F.count("*").alias("m"))
    median = _at_ranks(sizes, ["token", "age"], "b", "m", {"median_buys": F.floor(F.col("total") / 2)})
    out = out.join(median, ["token", "age"], "left").select(
        "token", "age", "repeat_buyers", floor_div(F.col("buys") * 1000, F.col("buyers")).cast("bigint").alias("mean_buys_x1000"),
        "median_buys", bps(F.col("top_n"), F.col("n")).alias("top_trader_trades_bps"), bps(F.col("top_v"), F.col("v")).alias("top_trader_volume_bps"),
    )
    return ticks.join(out, ["token", "age"], "left").withColumn("repeat_buyers", F.coalesce("repeat_buyers", F.lit(0)))


def triggered(lifecycle: DataFrame, trades: DataFrame, launches: DataFrame | None = None) -> DataFrame:
    """Snapshots outside the grid: each lifecycle event but SNIPE_TAX, the first trade, and the first trade on the pool.

    ``launches`` (token, launchpad) adds tokens that are on a pool from the start.
    """
    first = trades.groupBy("token").agg(F.min("a").alias("age")).withColumn("trigger", F.lit("FIRST_TRADE"))
    pool = _events(lifecycle, trades, None).where("trade")
    if launches is not None:
        pool = pool.join(launches.select("token", initial_state(F.col("launchpad")).alias("initial")), "token", "left")
        pool = pool.withColumn("set", F.coalesce("set", "initial"))
    pool = pool.where("set = 'AMM_ACTIVE'").groupBy("token").agg(F.min("age").alias("age")).withColumn("trigger", F.lit("AMM_FIRST_TRADE"))
    return lifecycle.where(F.col("type") != "SNIPE_TAX").select("token", F.col("a").alias("age"), F.col("type").alias("trigger")).unionByName(first).unionByName(pool)


#: State that an event sets; a first trade only leads out of DISCOVERED.
LIFECYCLE_STATE = {"TOKEN_CREATED": "DISCOVERED", "MIGRATION_STARTED": "MIGRATING", "LAUNCH_SWEPT": "GRADUATION_GAP", "MIGRATED": "AMM_ACTIVE", "POOL_GRADUATED": "AMM_ACTIVE"}
#: Launchpads whose tokens trade on a pool from the start.
ON_POOL = ("clanker_v4", "pumpswap")


def initial_state(launchpad: Column) -> Column:
    """Lifecycle state of a new token."""
    return F.when(launchpad.isin(*ON_POOL), "AMM_ACTIVE").otherwise("DISCOVERED")


def _events(lifecycle: DataFrame, trades: DataFrame, ticks: DataFrame | None) -> DataFrame:
    """Trades, events and ticks of tokens in order, with ``set``, the state that the last event set, and ``traded``."""
    to = F.create_map(*[F.lit(x) for kv in LIFECYCLE_STATE.items() for x in kv])
    w = Window.partitionBy("token").orderBy("age", "side", "id", "trade").rowsBetween(Window.unboundedPreceding, 0)
    rows = lifecycle.select("token", F.col("a").alias("age"), "id", F.try_element_at(to, F.col("type")).alias("s"), F.lit(0).alias("side"), F.lit(False).alias("trade"))
    rows = rows.unionByName(trades.select("token", F.col("a").alias("age"), "id", F.lit(0).alias("side"), F.lit(True).alias("trade")), allowMissingColumns=True)
    if ticks is not None:
        rows = rows.unionByName(ticks.select("token", "age", "kind", F.lit(1).alias("side"), F.lit(False).alias("trade")), allowMissingColumns=True)
    # DISCOVERED is no state of its own once a trade is in
    last = F.last(F.when(F.col("s") != "DISCOVERED", F.col("s")), ignorenulls=True).over(w)
    return rows.withColumns({"set": last, "traded": F.max("trade").over(w)})


def lifecycle_state(lifecycle: DataFrame, trades: DataFrame, ticks: DataFrame, launches: DataFrame | None = None) -> DataFrame:
    """State at each tick: of the last state-setting event, else the launchpad's own, else CURVE_ACTIVE after a trade, else DISCOVERED.

    ``launches`` (token, launchpad) tells which tokens begin on a pool; without it all begin as DISCOVERED.
    """
    found = _events(lifecycle, trades, ticks).where("side = 1")
    begin = F.lit(None).cast("string")
    if launches is not None:
        found = found.join(launches.select("token", initial_state(F.col("launchpad")).alias("initial")), "token", "left")
        begin = F.when(F.col("initial") != "DISCOVERED", F.col("initial"))
    return found.select("token", "age", "kind", F.coalesce("set", begin, F.when(F.col("traded"), "CURVE_ACTIVE"), F.lit("DISCOVERED")).alias("state"))


def market(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """The market of each token at each tick, from the last trade that says something of it.

    ``trades``: token, a, id, quote, base, pool, on_pool (whether it is a trade on a pool without reserves of its own) and, as decimal
    text of any length below 2**256, v_quote, v_base, real_quote, real_base, sqrt_price, liquidity and tick.  Virtual reserves make it a
    curve; failing that a square-root price makes it a V4 pool; failing that ``on_pool`` with a pool makes it a
    constant-product pool, and one without a pool only renews the amounts of such a pool.  Other trades change nothing.

    market_type, the fields of that type (NULL for the others), last amounts, quality, price_x18 and curve_progress_bps.
    """
    from tidemark.functions import wideint

    order = Window.partitionBy("token").orderBy("age", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    curve = F.col("v_quote").isNotNull() | F.col("v_base").isNotNull()
    kind = F.when(curve, "BONDING_CURVE").when(F.col("sqrt_price").isNotNull(), "UNISWAP_V4").when(F.col("on_pool") & F.col("pool").isNotNull(), "CONSTANT_PRODUCT")
    fields = ("v_quote", "v_base", "real_quote", "real_base", "sqrt_price", "liquidity", "tick", "pool")
    rows = trades.select("token", F.col("a").alias("age"), "id", F.lit(0).alias("side"), kind.alias("sets"), *fields, F.col("quote").cast("string").alias("quote"), F.col("base").cast("string").alias("base"), F.coalesce("on_pool", F.lit(False)).alias("on_pool"))
    both = rows.unionByName(ticks.select("token", "age", "kind", F.lit(1).alias("side")), allowMissingColumns=True)
    last = lambda c, when: F.last(F.when(when, c), ignorenulls=True).over(order)
    at = F.struct("age", "side", "id")
    x = both.withColumns({
        "market_type": last(F.col("sets"), F.col("sets").isNotNull()),
        "state": last(F.struct("sets", *fields), F.col("sets").isNotNull()),
        "traded": last(F.struct("quote", "base"), F.col("side") == 0),
        "first_base": F.first(F.when(F.col("sets") == "BONDING_CURVE", F.col("v_base")), ignorenulls=True).over(order),
        "curve_base": last(F.struct("v_base"), F.col("sets") == "BONDING_CURVE"),
        "v4_pool": last(F.struct(at.alias("at"), "pool"), (F.col("sets") == "UNISWAP_V4") & F.col("pool").isNotNull()),
        "other": last(at, F.col("sets") != "UNISWAP_V4"),
    })
    own = (F.col("sets") == F.col("market_type")) | (F.col("on_pool") & (F.col("market_type") == "CONSTANT_PRODUCT"))
    x = x.withColumn("amounts", last(F.struct("quote", "base"), own & (F.col("side") == 0) & F.col("market_type").isin("BONDING_CURVE", "CONSTANT_PRODUCT"))).where("side = 1")
    is_ = lambda t: F.col("market_type") == t
    of = lambda c, t: F.when(is_(t), F.col(f"state.{c}")).alias(c)
    # a V4 pool is remembered while the market stays one
    kept = F.when(F.col("other").isNull() | (F.col("v4_pool.at") > F.col("other")), F.col("v4_pool.pool"))
    pool = F.when(is_("UNISWAP_V4"), kept).when(is_("CONSTANT_PRODUCT"), F.col("state.pool"))
    scale = F.lit(str(10**18))
    # last trades give a price where there are no reserves to ask; a pool without known reserves has none
    from_curve = F.when(F.col("state.v_base").try_cast("double") == 0, F.when(F.col("state.v_quote").isNotNull(), "0")).otherwise(wideint.muldiv("state.v_quote", scale, "state.v_base"))
    price = F.when(is_("BONDING_CURVE"), from_curve).when(~F.coalesce(is_("CONSTANT_PRODUCT"), F.lit(False)), wideint.muldiv("traded.quote", scale, "traded.base"))
    amounts = F.when(is_("BONDING_CURVE") | is_("CONSTANT_PRODUCT"), F.col("amounts"))
    quality = F.when(is_("BONDING_CURVE") | is_("UNISWAP_V4"), "COMPLETE").when(is_("CONSTANT_PRODUCT"), "PARTIAL").otherwise("UNKNOWN")
    before, now = wideint.parse("first_base"), wideint.parse("curve_base.v_base")
    sold = wideint.let(F.struct(before.alias("a"), now.alias("b")), lambda s: F.when(s["b"].isNotNull() & s["a"].isNotNull(), F.when(wideint.less(s["a"], s["b"]), "0").otherwise(wideint.text(wideint.subtract(s["a"], s["b"])))))
    progress = F.least(wideint.muldiv(sold, F.lit("10000"), "first_base").cast("bigint"), F.lit(10_000).cast("bigint"))
    progress = F.when(sold.isNotNull() & (F.col("first_base").try_cast("double") > 0), progress)
    return x.select(
        "token", "age", "kind", F.coalesce("market_type", F.lit("UNKNOWN")).alias("market_type"), *(of(c, "BONDING_CURVE") for c in fields[:4]), *(of(c, "UNISWAP_V4") for c in fields[4:7]), pool.alias("pool"),
        amounts["quote"].alias("last_quote"), amounts["base"].alias("last_base"), quality.alias("quality"), price.alias("price_x18"), progress.alias("curve_progress_bps"),
    )


def reserves(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """Last seen quote and base reserves at each tick, and how far the base is below its first value (capped bps)."""
    from tidemark.functions.amounts import bps_capped

    w = Window.partitionBy("token").orderBy("age", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.select("token", F.col("a").alias("age"), "id", "v_quote", "v_base", F.lit(0).alias("side"))
    both = rows.unionByName(ticks.select("token", "age", "kind", F.lit(1).alias("side")), allowMissingColumns=True)
    out = both.select("token", "age", "kind", "side", F.last("v_quote", True).over(w).alias("v_quote"), F.last("v_base", True).over(w).alias("v_base"), F.first("v_base", True).over(w).alias("first"))
    progress = bps_capped(F.greatest(F.col("first") - F.col("v_base"), F.lit(0)), F.col("first"))
    return out.where("side = 1").select("token", "age", "kind", "v_quote", "v_base", progress.alias("curve_progress_bps"))


def graduation(lifecycle: DataFrame) -> DataFrame:
    """Per token: gap between sweep and pool, and count and last amount of snipe tax events."""
    at = lambda t: F.min(F.when(F.col("type") == t, F.col("a")))
    tax = F.col("type") == "SNIPE_TAX"
    return lifecycle.groupBy("token").agg((at("POOL_GRADUATED") - at("LAUNCH_SWEPT")).alias("gap_ms"), F.count_if(tax).alias("snipe_taxes"), F.max_by("amount", F.when(tax, F.struct("a", "id"))).alias("last_tax"))


def fingerprint(rows: DataFrame, columns: list[str]) -> Column:
    """sha256 over the columns as JSON, in their order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def rebuilt(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Versions after a rebuild: ``new`` rows supersede the current ones of their keys (version + 1)."""
    top = old.groupBy(*keys).agg(F.max("version").alias("__v"))
    fresh = new.join(top, keys, "left").withColumn("version", F.coalesce(F.col("__v") + 1, F.lit(1))).drop("__v").withColumn("superseded", F.lit(False))
    touched = new.select(*keys).distinct().withColumn("__t", F.lit(True))
    kept = old.join(touched, keys, "left").withColumn("superseded", F.col("superseded") | F.coalesce("__t", F.lit(False))).drop("__t")
    return kept.unionByName(fresh)


def horizons(trades: DataFrame, launches: DataFrame, at=HORIZONS, system: list = ()) -> DataFrame:
    """Horizon features on float prices: counts, unique traders (without system wallets), imbalance, price change."""
    from tidemark.functions.amounts import return_bps_even
    from tidemark.operators.prepare import price_valid

    ages = F.explode(F.array(*(F.lit(h).cast("bigint") for h in at)))
    valid, user = price_valid(F.col("price")), ~F.col("trader").isin(*system) if system else F.lit(True)
    # a trade belongs to every horizon at or after it: bounded by the number of horizons
    t = trades.withColumn("h", ages).where("a <= h")
    per = t.groupBy("token", "h", "trader").agg(
        F.count_if(F.col("side") == "buy").alias("b"), F.count_if(F.col("side") == "sell").alias("s"), F.max(user).alias("user"),
        F.min(F.when(valid, F.struct("a", "id", "price"))).alias("first"), F.max(F.when(valid, F.struct("a", "id", "price"))).alias("last"),
    )
    out = per.groupBy("token", "h").agg(
        F.sum("b").alias("buys"), F.sum("s").alias("sells"), F.count_if((F.col("b") > 0) & F.col("user")).alias("unique_buyers"), F.count_if((F.col("s") > 0) & F.col("user")).alias("unique_sellers"),
        F.count_if((F.col("b") > 1) & F.col("user")).alias("repeat_buyers"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    every = launches.select("token", ages.alias("h")).join(out, ["token", "h"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return every.select("token", "h", zero("buys"), zero("sells"), zero("unique_buyers"), zero("unique_sellers"), zero("repeat_buyers"), (F.coalesce("buys", F.lit(0)) - F.coalesce("sells", F.lit(0))).alias("imbalance"), return_bps_even(F.col("last.price"), F.col("first.price")).alias("price_change_bps"))
