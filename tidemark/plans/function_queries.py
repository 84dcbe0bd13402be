"""Queries of the functions by themselves (FN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import amounts, hexwords, lookups, metadata
from tidemark.plans.base import query
from tidemark.sources import adapters
from tidemark.sources.adapters import SQL

WITH = f"WITH {SQL}"
_NAMES = [f for f, _ in lookups.CURVE_BPS.items()] + ["clanker_v4"]


def _cents(spark, d):
    return adapters._read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("q"), F.col("l_partkey").cast("bigint").alias("b"))


_CENTS = "c AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS q, l_partkey AS b FROM lineitem)"


@query("fn1_amounts", f"WITH {_CENTS} SELECT l_orderkey, l_linenumber, l_suppkey, greatest(b - q // 1000, 0) AS less, CAST(CAST(q AS HUGEINT) * b // 7919 AS BIGINT) AS scaled, CAST(least(q, b) AS BIGINT) AS low FROM c")
def fn1(spark, d):
    q, b = F.col("q"), F.col("b")
    return _cents(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", amounts.sat_sub(b, F.floor(q / 1000)).alias("less"), amounts.muldiv(q, b, F.lit(7919)).cast("bigint").alias("scaled"), F.least(q, b).alias("low"))


@query(
    "fn2_ratios",
    f"WITH {_CENTS} SELECT l_orderkey, l_linenumber, l_suppkey, CAST(CAST(b AS HUGEINT) * 10000 // nullif(l_suppkey % 7, 0) AS BIGINT) AS ratio_bps, CASE WHEN l_suppkey % 7 > 0 THEN CAST(least(CAST(b AS HUGEINT) * 10000 // nullif(l_suppkey % 7, 0), 10000) AS BIGINT) END AS capped_bps, "
    "CASE WHEN l_suppkey > b THEN CAST((l_suppkey - b) * 10000 // nullif(b, 0) AS BIGINT) ELSE -CAST((b - l_suppkey) * 10000 // nullif(b, 0) AS BIGINT) END AS return_bps FROM c",
)
def fn2(spark, d):
    b, s = F.col("b"), F.col("l_suppkey")
    return _cents(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", amounts.bps(b, s % 7).alias("ratio_bps"), amounts.bps_capped(b, s % 7).alias("capped_bps"), amounts.return_bps(s, b).alias("return_bps"))


@query("fn3_words", f"{WITH} SELECT id, CAST(quote AS BIGINT) AS unsigned_value, CAST(-1 - quote AS BIGINT) AS signed_value, quote % 2 = 1 AS flag FROM t")
def fn3(spark, d):
    low = F.lpad(F.lower(F.hex("quote")), 64, "0")
    bit = F.lpad((F.col("quote") % 2).cast("string"), 64, "0")
    data = F.concat(F.lit("0x"), low, F.translate(low, "0123456789abcdef", "fedcba9876543210"), bit)
    value = lambda f, i: f(hexwords.word(data, i))
    return adapters.trades(spark, d).select("id", value(hexwords.unsigned, 0).cast("bigint").alias("unsigned_value"), value(hexwords.signed, 1).cast("bigint").alias("signed_value"), value(hexwords.flag, 2).alias("flag"))


@query("fn4_seeded_haircut", f"{WITH} SELECT id, CAST('0x' || substr(sha256('s1|' || id), 1, 15) AS BIGINT) % 10000 < 1500 AS hit, CAST(quote * (10000 - id % 300) // 10000 AS BIGINT) AS adverse FROM t")
def fn4(spark, d):
    i = F.col("id")
    return adapters.trades(spark, d).select("id", amounts.seeded_hit("s1", i, 1500).alias("hit"), amounts.adverse(F.col("quote"), i % 300).cast("bigint").alias("adverse"))


_FEE = lambda table: f"CASE pad {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in table.items())} ELSE 0 END"


@query(
    "fn5_delays_and_fees",
    f"{WITH}, x AS (SELECT id, a, kind, ['solana', 'base', 'robinhood'][id % 3 + 1] AS chain, ['fast', 'base', 'slow', 'none'][trader % 4 + 1] AS scenario, {_NAMES}[id % 4 + 1] AS pad FROM a) "
    f"SELECT id, CASE chain {' '.join(f'''WHEN '{c}' THEN {'NULL' if n is None else n}''' for c, n in lookups.CHAINS)} END AS evm_chain_id, CASE chain || scenario {' '.join(f'''WHEN '{c}{s}' THEN {ms}''' for c, s, ms in lookups.DELAYS)} END AS delay_ms, "
    f"CASE WHEN kind = 'purchase' THEN {_FEE(lookups.AMM_BPS)} ELSE {_FEE(lookups.CURVE_BPS)} END AS protocol_bps, CASE WHEN pad = 'pons_v2' AND (a < 1000 OR kind = 'error') THEN 9900 ELSE 0 END AS snipe_tax_bps FROM x",
)
def fn5(spark, d):
    pick = lambda names, c: F.get(F.array(*map(F.lit, names)), c.cast("int"))
    i = F.col("id")
    x = adapters.aged(spark, d).select("id", "a", "kind", pick(("solana", "base", "robinhood"), i % 3).alias("chain"), pick(("fast", "base", "slow", "none"), F.col("trader") % 4).alias("scenario"), pick(_NAMES, i % 4).alias("pad"))
    x = x.join(F.broadcast(lookups.chains(spark)), "chain", "left").join(F.broadcast(lookups.delays(spark)), ["chain", "scenario"], "left")
    state = F.when(F.col("kind") == "purchase", "AMM_ACTIVE").otherwise("CURVE_ACTIVE")
    return x.select("id", "evm_chain_id", "delay_ms", lookups.protocol_bps(F.col("pad"), state).alias("protocol_bps"), lookups.snipe_tax_bps(F.col("pad"), F.col("a"), F.col("kind") == "error").alias("snipe_tax_bps"))


@query("fn6_hours", f"{WITH} SELECT id, ms // 3600000 AS hour_bucket, ms // 3600000 % 24 AS hour_of_day FROM t")
def fn6(spark, d):
    hour = F.floor(F.col("ms") / 3_600_000)
    return adapters.trades(spark, d).select("id", hour.alias("hour_bucket"), (hour % 24).alias("hour_of_day"))


_RAW = "CASE id % 7 WHEN 0 THEN '{{\"x\":' || id || '}}' WHEN 1 THEN '{{\"x\":\"t' || id || '\"}}' WHEN 2 THEN '{{\"x\":true}}' WHEN 3 THEN '{{\"x\":[1]}}' WHEN 4 THEN '{{\"x\":null}}' WHEN 5 THEN '{{\"y\":1}}' ELSE '{{\"x\":0.5}}' END".replace("{{", "{").replace("}}", "}")


@query("fn7_metadata", f"{WITH}, x AS (SELECT id, {_RAW} AS j FROM t) SELECT id, CASE WHEN json_type(j, '$.x') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract_string(j, '$.x') END AS x FROM x")
def fn7(spark, d):
    return adapters.trades(spark, d).select("id", F.expr(_RAW).alias("j")).select("id", metadata.text_or_number(F.col("j"), "x").alias("x"))
