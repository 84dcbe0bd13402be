"""Fixed tables of chains, launchpads, factories, delays and fees, as small DataFrames and column functions.

Every table has a fixed number of rows, so a join may broadcast it.  An unknown key gives NULL, but for fees, which are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
CHAINS = (("solana", None), ("base", 8453), ("robinhood", 4663))
FACTORIES = (
    ("solana", "pumpfun", "6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P"),
    ("robinhood", "pons_v2", "0x7ed598bcef8bd9edd8c97a195c6d13f40801ec7e"),
    ("base", "clanker_v4", "0xe85a59c628f7d27878aceb4bf3b35733630083a9"),
    ("solana", "pumpswap", "pAMMBay6oceH9fJKBRHGP5D4bD4sWpmSwMn52FMfXEA"),
    ("robinhood", "pons_v2", "0x8366a39cc670b4001a1121b8f6a443a643e40951"),
    ("base", "clanker_v4", "0x498581ff718922c3f8e6a244956af099b2652b2b"),
)
DELAYS = (
    ("solana", "fast", 500), ("solana", "base", 2_000), ("solana", "slow", 5_000),
    ("base", "fast", 2_000), ("base", "base", 4_000), ("base", "slow", 8_000),
    ("robinhood", "fast", 500), ("robinhood", "base", 1_000), ("robinhood", "slow", 2_000),
)
CURVE_BPS = {"pumpfun": 100, "pumpswap": 25, "pons_v2": 100}
AMM_BPS = {"pumpfun": 100, "pumpswap": 25, "pons_v2": 25}
SNIPE_BPS, SNIPE_MS = {"pons_v2": 9_900}, 1_000


def chains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAINS, "chain string, evm_chain_id bigint")


def factories(spark: SparkSession) -> DataFrame:
    """Verified factories; EVM addresses in lower case."""
    return spark.createDataFrame(FACTORIES, "chain string, launchpad string, address string")


def delays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DELAYS, "chain string, scenario string, delay_ms bigint")


def _of(table: dict[str, int], key: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(0))


def protocol_bps(launchpad: Column, state: Column) -> Column:
    """Fee of a venue: that of its curve until the token trades on an AMM."""
    return F.when(state == "AMM_ACTIVE", _of(AMM_BPS, launchpad)).otherwise(_of(CURVE_BPS, launchpad))


def snipe_tax_bps(launchpad: Column, age_ms: Column, forced: Column | None = None) -> Column:
    """Tax of the first second after a launch, or wherever it is forced."""
    active = F.coalesce(age_ms < SNIPE_MS, F.lit(False))
    if forced is not None:
        active = active | F.coalesce(forced, F.lit(False))
    return F.when(active, _of(SNIPE_BPS, launchpad)).otherwise(0)
