"""Data-quality and audit jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.amounts import at_least, floor_div
from tidemark.operators.research import rank_values


def scan(rows: DataFrame, key: list[str], file: str, order: list[str], time: str, by: list[str], slot: str | None = None, signature: str | None = None, amount: str | None = None) -> DataFrame:
    """Counts, duplicate rows and ordering violations per group, in file order.

    ``slot``, ``signature`` and ``amount`` (a class of :func:`tidemark.operators.prepare.amount_class`) name the
    columns of which presence and classes are counted too.
    """
    prev = F.lag(time).over(Window.partitionBy(file).orderBy(*order))
    x = rows.withColumn("__back", F.coalesce(F.col(time) < prev, F.lit(False)))
    more = {}
    if slot:
        more["with_slot"] = F.count(slot)
    if signature:
        more["with_signature"] = F.count_if(F.coalesce(F.length(F.col(signature).cast("string")) > 0, F.lit(False)))
    if amount:
        more["amount_integer"] = F.count_if(F.col(amount) == "ONCHAIN_INTEGER")
        more["amount_float"] = F.count_if(F.col(amount).isin("FLOAT_NOT_INTEGER", "INTEGER_VALUED_FLOAT"))
        more["amount_missing"] = F.count("*") - F.count_if(F.coalesce(F.col(amount).isin("ONCHAIN_INTEGER", "FLOAT_NOT_INTEGER", "INTEGER_VALUED_FLOAT"), F.lit(False)))
    per = x.groupBy(*by, *key).agg(F.count("*").alias("c"), F.count_if("__back").alias("back"), F.count_if(F.col(time).isNull()).alias("bad"), *(c.alias(k) for k, c in more.items()))
    return per.groupBy(*by).agg(F.sum("c").alias("events"), F.sum("bad").alias("invalid"), F.sum(F.col("c") - 1).alias("duplicates"), F.sum("back").alias("ordering_violations"), *(F.sum(k).alias(k) for k in more))


def coverage(launches: DataFrame, trades: DataFrame, survived=(30_000, 300_000, 900_000), by: tuple[str, ...] = (), graduated: DataFrame | None = None) -> DataFrame:
    """Per group of launches: their number, with at least 1 and 10 trades, survivors of each age, without trades.

    ``graduated``: tokens that did; adds their number.
    """
    per = trades.groupBy("token").agg(F.count("*").alias("n"), F.max("a").alias("last"))
    j = launches.select("token", *by).join(per, "token", "left")
    n, more = F.coalesce("n", F.lit(0)), []
    if graduated is not None:
        j = j.join(graduated.select("token", F.lit(True).alias("__g")).distinct(), "token", "left")
        more = [F.count("__g").alias("graduated")]
    return j.groupBy(*by).agg(F.count("*").alias("launches"), F.count_if(n >= 1).alias("traded"), F.count_if(n >= 10).alias("traded_10"), *(F.count_if(F.col("last") >= s).alias(f"survived_{s // 1000}s") for s in survived), F.count_if(n == 0).alias("zero_trade"), *more)


def duplicate_report(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("distinct_keys")).withColumn("duplicates", F.col("n_rows") - F.col("distinct_keys"))


def gate(figures: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Checks of a dataset before research, from one row of scan and coverage figures: ``by``, verdict, check, passed.

    Needs events, invalid, ordering_violations, with_slot, with_signature, amount_integer, amount_float, amount_missing,
    trades, launches, graduated and zero_trade.  Missing hours are recorded elsewhere and never fail the check.
    """
    c = F.col
    schema = (c("invalid") == 0) & (c("launches") > 0)
    population = (c("launches") > 0) & (c("graduated") < c("launches"))
    dead = (c("zero_trade") > 0) | (c("graduated") < c("launches"))
    exact = (c("events") > 0) & (c("with_signature") == c("events")) & (c("with_slot") == c("events"))
    amounts = (c("trades") > 0) & (c("amount_integer") > 0) & (c("amount_missing") == 0) & (c("amount_float") == 0)
    ordered = c("ordering_violations") == 0
    feature = schema & ordered & population & dead & (c("events") > 0)
    checks = {
        "schema_valid": schema, "ordering_valid": ordered, "launch_population_valid": population, "dead_tokens_present": dead, "trade_amounts_valid": amounts,
        "curve_reconstructable": amounts & exact, "temporal_coverage_valid": F.lit(True), "feature_valid": feature, "execution_valid": feature & amounts & exact,
    }
    verdict = F.when(~schema | ~population | ~feature, "INVALID").when(checks["execution_valid"], "RESEARCH_VALID").otherwise("FEATURE_ONLY")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), x.alias("passed")) for k, x in checks.items())))
    identity = F.when(exact, "ONCHAIN_EXACT").otherwise("DERIVED")
    bias = F.when(c("launches") == 0, "UNKNOWN").when(c("graduated") == c("launches"), "GRADUATED_ONLY").otherwise("ALL_LAUNCHES")
    return figures.select(*by, verdict.alias("verdict"), identity.alias("identity_quality"), bias.alias("graduation_bias"), rows.alias("x")).select(*by, "verdict", "identity_quality", "graduation_bias", "x.check", "x.passed")


def complete_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of sessions whose source is complete."""
    return rows.join(sessions.where("complete").select("session"), "session", "left_semi")


#: Session statuses that research may rest on.
COMPLETE_STATUSES = ("HISTORICAL_REPLAY", "LIVE_COMPLETE")


def capabilities(sessions: DataFrame) -> DataFrame:
    """What each session may be used for: feature, descriptive-outcome, execution and paper research, and strategy PnL.

    ``sessions``: session, status, complete, price_labels_ok, executable (exact curve reads), live.  An incomplete source
    allows nothing (``non_research_valid``); missing flags count as false.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    whole = yes("complete") & F.coalesce(F.col("status").isin(*COMPLETE_STATUSES), F.lit(False))
    flags = {"feature_valid": whole, "descriptive_outcome_valid": whole & yes("price_labels_ok"), "execution_valid": whole & yes("executable"), "paper_live_valid": whole & yes("executable") & yes("live"), "non_research_valid": ~whole}
    out = sessions.select("session", *(c.alias(k) for k, c in flags.items()))
    return out.withColumn("allows_strategy_pnl", F.col("execution_valid") | F.col("paper_live_valid"))


def dataset_hash(files: DataFrame) -> DataFrame:
    """Hash over sorted ``path:sha:size`` lines.

    Lines are sorted by range in many tasks; one task then reads the sorted parts in turn and feeds a digest, a batch at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, begun = hashlib.sha256(), False
        for batch in batches:
            for line in batch.column("line").to_pylist():
                if line is not None:
                    h.update((b"\n" if begun else b"") + line.encode())
                    begun = True
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["dataset_hash"])

    line = F.concat_ws(":", "path", "sha", F.col("size").cast("string")).alias("line")
    # a row without a line makes sure that there is a task
    none = files.sparkSession.range(1).select(F.lit(None).cast("string").alias("line"))
    return files.select(line).unionByName(none).orderBy(F.col("line").asc_nulls_first()).coalesce(1).mapInArrow(digest, "dataset_hash string")


def sequence_gaps(rows: DataFrame, stream: str, seq: str) -> DataFrame:
    """Ranges missing from each stream's numbers."""
    x = rows.select(stream, seq).distinct().withColumn("p", F.lag(seq).over(Window.partitionBy(stream).orderBy(seq)))
    return x.where(F.col(seq) - F.col("p") > 1).select(stream, (F.col("p") + 1).alias("first_missing"), (F.col(seq) - 1).alias("last_missing"))


def united(ranges: DataFrame, stream: str) -> DataFrame:
    """Ranges (stream, first, last) with overlapping and adjoining ones made one."""
    w = Window.partitionBy(stream).orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = ranges.where("first <= last").withColumn("__new", F.when(F.col("first") <= before + 1, 0).otherwise(1))
    x = x.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(stream, "__island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__island")


def with_recovery(gaps: DataFrame, repaired: DataFrame, stream: str) -> DataFrame:
    """Gaps with ``recovered``: whether repaired ranges (stream, first, last) cover the gap, one of them or several together.

    Ranges are united first.  The furthest end of those that start at or before a gap is then carried along one sort of
    the stream, so ranges and gaps are never paired.
    """
    g = gaps.select(stream, F.col("first_missing").alias("__at"), F.lit(1).alias("__gap"), "last_missing", F.lit(None).cast("bigint").alias("__end"))
    r = united(repaired.select(stream, "first", "last"), stream).select(stream, F.col("first").alias("__at"), F.lit(0).alias("__gap"), F.lit(None).cast("bigint").alias("last_missing"), F.col("last").alias("__end"))
    reach = F.max("__end").over(Window.partitionBy(stream).orderBy("__at", "__gap").rowsBetween(Window.unboundedPreceding, 0))
    x = g.unionByName(r).withColumn("__reach", reach).where("__gap = 1")
    return x.select(stream, F.col("__at").alias("first_missing"), "last_missing", F.coalesce(F.col("__reach") >= F.col("last_missing"), F.lit(False)).alias("recovered"))


def head_gap(checkpoint: Column, head: Column, overlap: int = 64) -> Column:
    """What to do from a checkpoint to the head."""
    return F.when(checkpoint.isNull(), "START_AT_HEAD").when(head - checkpoint > overlap, "STALE_SKIP").when(head > checkpoint, "OVERLAP_BACKFILL").otherwise("CURRENT")


def intervals(samples: DataFrame, by: str, stale_ms: int = 45_000) -> DataFrame:
    """Health samples (``by``, ms, status) to intervals of one status; a silence makes a PARTIAL one.

    Samples of one time stand in the order of their status, so that results don't depend on the order of rows.
    """
    w, each = Window.partitionBy(by).orderBy("ms"), Window.partitionBy(by).orderBy("ms", "status")
    x = samples.withColumn("__next", F.lead("ms").over(each)).withColumn("__s", F.when(F.col("__next") - F.col("ms") > stale_ms, "PARTIAL").otherwise(F.col("status")))
    x = x.withColumn("__new", F.coalesce((F.col("__s") != F.lag("__s").over(each)).cast("int"), F.lit(0))).withColumn("__island", F.sum("__new").over(w))
    out = x.groupBy(by, "__island", "__s").agg(F.min("ms").alias("started_ms"), F.max(F.coalesce("__next", "ms")).alias("ended_ms"))
    return out.select(by, F.col("__s").alias("status"), "started_ms", "ended_ms")


def observed(found: DataFrame, by: str, least: float = 0.95) -> DataFrame:
    """Share of the elapsed time that VALID intervals cover."""
    out = found.groupBy(by).agg(F.sum(F.when(F.col("status") == "VALID", F.col("ended_ms") - F.col("started_ms")).otherwise(0)).alias("valid_ms"), (F.max("ended_ms") - F.min("started_ms")).alias("elapsed_ms"))
    share = F.when(F.col("elapsed_ms") > 0, F.round(F.col("valid_ms") / F.col("elapsed_ms"), 6))
    return out.withColumn("coverage", share).withColumn("enough", F.coalesce(share >= least, F.lit(False)))


def side_status_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"))


def lifecycle_balance(orders: DataFrame, positions: DataFrame, by: list[str]) -> DataFrame:
    """Orders (side, status) and positions (status) per group, and whether they add up.

    ``positions_balanced``: each position opened is closed, open or left open at the end of its session.
    ``entries_balanced``: as many positions as filled entries.
    """
    filled = F.col("status").isin("FILLED", "PARTIAL_FILL")
    of = lambda side, c=F.lit(True): F.count_if((F.col("side") == side) & c)
    o = orders.groupBy(*by).agg(
        of("buy").alias("entry_orders"), of("buy", filled).alias("entry_fills"), of("sell").alias("exit_orders"), of("sell", filled).alias("exit_fills"),
        of("sell", F.col("status") == "PARTIAL_FILL").alias("partial_exit_fills"), of("sell", ~F.coalesce(filled, F.lit(False))).alias("failed_exit_attempts"),
    )
    at = lambda s: F.count_if(F.col("status") == s)
    p = positions.groupBy(*by).agg(F.count("*").alias("positions_opened"), at("CLOSED").alias("positions_closed"), at("OPEN").alias("positions_open"), at("SESSION_ENDED_OPEN").alias("positions_session_ended"))
    j = o.join(p, by, "full").na.fill(0)
    c = F.col
    return j.withColumn("positions_balanced", c("positions_opened") == c("positions_closed") + c("positions_open") + c("positions_session_ended")).withColumn("entries_balanced", c("positions_opened") == c("entry_fills"))


def operational_counts(rows: DataFrame, by: list[str], failed: Column, filled: Column) -> DataFrame:
    """Tokens, traders, failures and fills per group."""
    return rows.groupBy(*by).agg(F.count_distinct("token").alias("tokens"), F.count_distinct("trader").alias("traders"), F.count_if(failed).alias("failed"), F.count_if(filled).alias("filled"))


def counters(rows: DataFrame, lag: str, by: list[str], percents: tuple[int, ...] = ()) -> DataFrame:
    """Events, total and largest lag per group, and lags by nearest rank.

    A negative lag counts as 0, a missing one as an event only.
    """
    x = rows.withColumn(lag, at_least(F.col(lag), F.lit(0)))
    out = x.groupBy(*by).agg(F.count("*").alias("events"), F.sum(lag).alias("lag_ms"), F.max(lag).alias("max_lag_ms"))
    if percents:
        out = out.join(rank_values(x, lag, percents, by).withColumnsRenamed({f"p{q}": f"p{q}_ms" for q in percents}), by, "left")
    return out


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def arm_problems(arms: DataFrame, experiment: str, entries: list[str], leaves: list[str]) -> DataFrame:
    """(arm_id, problem) of ids that are not experiment:entry:exit with known policies."""
    p = F.split("arm_id", ":")
    why = F.when(F.size(p) != 3, "PARTS").when(p[0] != experiment, F.when(p[0].startswith("smoke"), "SMOKE_LEAK").otherwise("CROSS_EXPERIMENT")).when(~p[1].isin(*entries), "UNKNOWN_ENTRY").when(~p[2].isin(*leaves), "UNKNOWN_EXIT")
    return arms.select("arm_id", why.alias("problem")).where("problem IS NOT NULL")


def reconcile(fills: DataFrame, keys: list[str]) -> DataFrame:
    """Positions from fills (side, base, quote): bought, sold, remaining, pro-rata PnL and flags."""
    of = lambda side, c: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    p = fills.groupBy(*keys).agg(of("buy", "base").alias("bought"), of("buy", "quote").alias("cost"), of("sell", "base").alias("sold"), of("sell", "quote").alias("received"))
    used = floor_div(F.col("cost") * F.least("sold", "bought"), F.col("bought")).cast("bigint")
    flag = F.when(F.col("bought") == 0, "SELL_WITHOUT_ENTRY").when(F.col("sold") > F.col("bought"), "OVERSOLD").when(F.col("sold") == F.col("bought"), "CLOSED").when(F.col("sold") == 0, "OPEN").otherwise("PARTIAL")
    return p.select(*keys, "bought", "sold", F.greatest(F.col("bought") - F.col("sold"), F.lit(0)).alias("remaining"), (F.col("received") - used).alias("realized_pnl"), flag.alias("status"))


def reconcile_positions(positions: DataFrame, fills: DataFrame, keys: list[str]) -> DataFrame:
    """Stored positions against their fills: bought, sold, remaining, realized_pnl and what doesn't agree.

    ``positions``: keys, initial (base), cost (quote), remaining, realized_pnl, closed.  Without buy fills the stored
    entry counts.  PnL is what was received less the pro-rata cost of what was sold, at most all of it.
    """
    of = lambda side, c: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    f = fills.groupBy(*keys).agg(of("buy", "base").alias("__b"), of("buy", "quote").alias("__q"), of("sell", "base").alias("__s"), of("sell", "quote").alias("__r"), F.count_if(F.col("side") == "sell").alias("__n"))
    stored = positions.withColumnsRenamed({"remaining": "__left", "realized_pnl": "__pnl"})
    c, zero = F.col, lambda x: F.coalesce(x, F.lit(0))
    entered = zero("__b") > 0
    j = stored.join(f, keys, "left").select(
        *keys, "closed", "__left", "__pnl", F.when(entered, c("__b")).otherwise(c("initial")).alias("bought"), F.when(entered, c("__q")).otherwise(c("cost")).alias("paid"), zero("__s").alias("sold"), zero("__r").alias("received"), zero("__n").alias("sells")
    )
    used = F.when(c("bought") > 0, floor_div(c("paid") * F.least("sold", "bought"), c("bought"))).cast("bigint")
    j = j.withColumn("left", F.greatest(c("bought") - c("sold"), F.lit(0))).withColumn("pnl", F.when(c("bought") > 0, c("received") - used).otherwise(0))
    j = j.select(
        *keys, "bought", "sold", c("left").alias("remaining"), c("pnl").alias("realized_pnl"), (c("__left") == c("left")).alias("inventory_ok"), (c("__pnl") == c("pnl")).alias("pnl_ok"), (c("sold") > c("bought")).alias("oversold"),
        (c("closed") & (c("sells") == 0)).alias("closed_without_exit_fill"), (c("closed") & (c("left") > 0)).alias("failed_exit_marked_closed"),
    )
    return j.withColumn("ok", c("inventory_ok") & c("pnl_ok") & ~c("oversold") & ~c("closed_without_exit_fill") & ~c("failed_exit_marked_closed"))


def lock_drift(registry: DataFrame) -> DataFrame:
    """Experiments whose configuration differs from the locked one, or whose test ran twice."""
    x = registry.withColumn("hash", F.sha2("config", 256))
    return x.select("experiment", "hash", (F.col("hash") != F.col("locked_hash")).alias("drifted"), (F.col("test_runs") > 1).alias("test_repeated"))


def test_gate(registry: DataFrame) -> DataFrame:
    """Whether the one test of an experiment may run: experiment, hash, gate (OK or the first reason that forbids it).

    ``registry``: experiment, config and locked_config (canonical JSON), locked_hash, status, dataset_hash, actual_hash,
    test_runs.  Missing runs count as none.
    """
    c = F.col
    now = F.sha2("config", 256)
    differs = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    gate_ = (
        F.when(differs(c("status").isin(*COMPLETE_STATUSES), F.lit(True)), "DATASET_NOT_RESEARCH_VALID").when(c("dataset_hash").isNull(), "DATASET_HASH_MISSING").when(differs(c("dataset_hash"), c("actual_hash")), "DATASET_HASH_MISMATCH")
        .when(c("locked_hash").isNull() | c("locked_config").isNull(), "NOT_LOCKED").when(c("locked_hash") != F.sha2("locked_config", 256), "HASH_MISMATCH").when(differs(c("locked_hash"), now), "CONFIG_DRIFT")
        .when(c("test_runs") >= 1, "TEST_ALREADY_RUN").otherwise("OK")
    )
    return registry.select("experiment", now.alias("hash"), gate_.alias("gate"))


def import_statistics(rows: DataFrame, by: str, ok: Column, ms: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("rows_read"), F.count_if(ok).alias("emitted"), F.count_if(~ok).alias("rejected"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))
