"""Readers of corpora and event streams, with explicit schemas, and their canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hexwords
from tidemark.operators import prepare

RECORD = (
    "source_kind string, dataset_id string, source_file string, source_row bigint, order_seq bigint, event_type string, identity_quality string, mint string, creator string, trader string, side string, "
    "token_amount string, sol_amount string, amount_quality string, timestamp timestamp, seconds_since_launch_milli bigint, slot bigint, transaction_index bigint, signature string, instruction_index int, "
    "inner_instruction_index int, v_sol_bonding_curve string, v_tokens_bonding_curve string, data_quality string, normalization_version string, original string"
)
TOKENS = "mint string, detected_at timestamp, creator string, bonding_curve_key string, graduated_at timestamp, trade_count bigint, is_zombie boolean"
TRADES = "id bigint, mint string, tx_signature string, event_time timestamp, seconds_since_launch double, is_buy boolean, sol_amount double, token_amount double, user_wallet string, price_sol double, source string"
LOG = "chain string, chain_id bigint, address string, topics array<string>, data string, block_number bigint, transaction_index bigint, log_index bigint, block_hash string, transaction_hash string, tx_from string, block_timestamp bigint, removed boolean"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, trades) of a corpus; trades carry the shard they come from."""
    trades = spark.read.schema(TRADES).parquet(f"{path}/trades").withColumn("shard", F.col("_metadata.file_name"))
    return spark.read.schema(TOKENS).parquet(f"{path}/tokens"), trades


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Decoded records, one JSON object a line; blank lines go, broken ones keep their text in ``corrupt``."""
    rows = spark.read.schema(f"{RECORD}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    return rows.where(F.col("corrupt").isNull() | (F.trim("corrupt") != ""))


def read_logs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A folder of event-log documents: one row per event id, with id and total order.

    A file is one document or a list of them, or with ``multi_line`` off a document a line.
    """
    rows = spark.read.schema(LOG).option("multiLine", multi_line).json(path)
    rows = rows.withColumn("event_id", prepare.event_id(F.lit("evm"), chain_id=F.col("chain_id"), tx=F.col("transaction_hash"), log=F.col("log_index")))
    rows = prepare.first_of_each(rows, ["event_id"], ["block_number", "transaction_index", "log_index"])
    none = F.lit(None)
    return rows.withColumn("order", prepare.order_key(F.col("block_number"), F.col("transaction_index"), F.col("log_index"), none, none, F.col("event_id")))


def read_event_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


#: Public event layouts by kind, as the place (topic t or data word w) and type of each field.
#: Names of the first line of a kind are columns, the others go to ``metadata``.
LAYOUTS: dict[str, tuple[dict[str, tuple[str, int, str]], dict[str, tuple[str, int, str]]]] = {
    "TOKEN_LAUNCHED": (
        {"token": ("t", 1, "address"), "curve": ("t", 2, "address"), "trader": ("t", 3, "address"), "quote_asset": ("w", 0, "address")},
        {"launchConfigId": ("w", 1, "uint"), "graduationThreshold": ("w", 2, "uint")},
    ),
    "TOKEN_CREATED": (
        {"token": ("t", 1, "address"), "trader": ("w", 0, "address"), "pool": ("w", 8, "bytes"), "quote_asset": ("w", 9, "address")},
        {"tokenAdmin": ("t", 2, "address"), "startingTick": ("w", 6, "int"), "poolHook": ("w", 7, "address"), "locker": ("w", 10, "address"), "extensionsSupply": ("w", 12, "uint")},
    ),
    "LAUNCH_SWEPT": ({"token": ("t", 1, "address")}, {"quoteOut": ("w", 0, "uint"), "tokenOut": ("w", 1, "uint")}),
    "POOL_GRADUATED": ({"token": ("t", 1, "address")}, {"positionId": ("w", 0, "uint"), "tokenAmount": ("w", 1, "uint"), "pairTokenAmount": ("w", 2, "uint")}),
    "CURVE_BUY": (
        {"trader": ("t", 1, "address"), "quote": ("w", 0, "uint"), "base": ("w", 1, "uint")},
        {"recipient": ("t", 2, "address"), "fee": ("w", 2, "uint"), "tax": ("w", 3, "uint")},
    ),
    "CURVE_SELL": (
        {"trader": ("t", 1, "address"), "base": ("w", 0, "uint"), "quote": ("w", 1, "uint")},
        {"recipient": ("t", 2, "address"), "fee": ("w", 2, "uint"), "tax": ("w", 3, "uint")},
    ),
    "SNIPE_TAX_CHARGED": ({"trader": ("t", 1, "address")}, {"amount": ("w", 0, "uint")}),
    "CURVE_COMPLETED": ({"trader": ("w", 0, "address")}, {"quoteOut": ("w", 1, "uint"), "tokenOut": ("w", 2, "uint")}),
    "SWAP": (
        {"pool": ("t", 1, "bytes"), "trader": ("t", 2, "address"), "quote": ("w", 0, "abs"), "base": ("w", 1, "abs")},
        {"amount0": ("w", 0, "int"), "amount1": ("w", 1, "int"), "sqrtPriceX96": ("w", 2, "uint"), "liquidity": ("w", 3, "uint"), "tick": ("w", 4, "int"), "fee": ("w", 5, "uint")},
    ),
    "INITIALIZE": (
        {"pool": ("t", 1, "bytes")},
        {"currency0": ("t", 2, "address"), "currency1": ("t", 3, "address"), "fee": ("w", 0, "uint"), "tickSpacing": ("w", 1, "int"), "hooks": ("w", 2, "address"), "sqrtPriceX96": ("w", 3, "uint"), "tick": ("w", 4, "int")},
    ),
}
#: First topics of these events.
TOPICS = {
    "0x8d4aad4953d0ca700d468f3753aa14432d1b35b43ec6409f051fb6aa43a89607": "TOKEN_LAUNCHED", "0xcdb72f157fd3666758a6ce201387ffb52038c7562e4fff352828da1096c4b6b4": "LAUNCH_SWEPT",
    "0x0a44ef75df69c534f43cd6c1aa3ef8983065fe5fe79ef9e79f6494e6f258c259": "POOL_GRADUATED", "0xec36bf571f136799e8dc0b0b8bea4b04d8bd3d43de838aab0d5fc21d4cbfc455": "CURVE_BUY",
    "0x8113d738abdcb6b38357e9d53a54a7157861a09031b453651f0fe7fe151f59df": "CURVE_SELL", "0x3bc39a5562b28f5fe8f36cecabfbaa12bb969acf05717994709225fc412a9934": "SNIPE_TAX_CHARGED",
    "0xf8d37a90738ae063b8b8058b66f5880cf3cf7ab0c5d4fa78219696591dfbfb67": "CURVE_COMPLETED", "0x9299d1d1a88d8e1abdc591ae7a167a6bc63a8f17d695804e9091ee33aa89fb67": "TOKEN_CREATED",
    "0x40e9cecb9f5f1f1c5b9c97dec2917b7ee92e57ba5563708daca94dd84ad7112f": "SWAP", "0xdd466e674ea557f56295e2d0218a125ea4b4f0f6f3307b95f85e6110838d6438": "INITIALIZE",
}
#: What a kind is: a launch, a trade or another event in a token's life.
_FAMILY = {"TOKEN_LAUNCHED": "launch", "TOKEN_CREATED": "launch", "CURVE_BUY": "trade", "CURVE_SELL": "trade", "SWAP": "trade"}
#: Kinds whose emitter is the curve.
_BY_CURVE = ("CURVE_BUY", "CURVE_SELL", "SNIPE_TAX_CHARGED", "CURVE_COMPLETED")


def _field(place: str, at: int, kind: str) -> Column:
    word = hexwords.word(F.col("data"), at) if place == "w" else F.when(F.size("topics") > at, F.lower(F.substring(F.get("topics", F.lit(at)), 3, 64)))
    word = F.lower(word)
    if kind == "address":
        return F.when(word.isNotNull(), hexwords.address(word))
    if kind == "bytes":
        return F.concat(F.lit("0x"), word)
    return hexwords.unsigned_text(word) if kind == "uint" else hexwords.signed_text(word, absolute=kind == "abs")


def typed_logs(logs: DataFrame, topics: dict[str, str] = TOPICS) -> DataFrame:
    """Events of known topics by their own layouts, one row a log.

    kind, family (launch, trade or lifecycle), token, trader (who launches, trades or pays), curve, pool, quote_asset, side, quote and base
    (decimal text of up to 256 bits), metadata (map of text) and the log's own columns.  Missing words give NULL.  Logs
    taken back keep their row, with ``removed``; unknown topics are left out.
    """
    table = F.create_map(*[F.lit(x) for kv in topics.items() for x in kv])
    first = F.lower(F.get("topics", F.lit(0)))
    rows = logs.where(first.isin(*topics)).withColumn("kind", F.try_element_at(table, first))
    known = {k: v for k, v in LAYOUTS.items() if k in topics.values()}

    def column(name: str) -> Column:
        out = F.lit(None).cast("string")
        for kind, (fields, _) in known.items():
            if name in fields:
                out = F.when(F.col("kind") == kind, _field(*fields[name])).otherwise(out)
        return out

    metadata = F.lit(None).cast("map<string,string>")
    for kind, (_, more) in known.items():
        metadata = F.when(F.col("kind") == kind, F.create_map(*[x for n, f in more.items() for x in (F.lit(n), _field(*f))])).otherwise(metadata)
    family = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _FAMILY.items() for x in kv]), F.col("kind")), F.lit("lifecycle"))
    own = [c for c in ("event_id", "order", "chain", "block_number", "transaction_index", "log_index", "transaction_hash", "block_timestamp") if c in logs.columns]
    address = hexwords.normal_hex(F.col("address"))
    negative = F.col("metadata")["amount1"].startswith("-")
    side = F.when(F.col("kind") == "CURVE_BUY", "buy").when(F.col("kind") == "CURVE_SELL", "sell").when(F.col("kind") == "SWAP", F.when(negative, "buy").otherwise("sell"))
    rows = rows.select(*own, "kind", family.alias("family"), address.alias("address"), *(column(c).alias(c) for c in ("token", "trader", "curve", "pool", "quote_asset", "quote", "base")), metadata.alias("metadata"), F.coalesce("removed", F.lit(False)).alias("removed"))
    return rows.withColumn("curve", F.when(F.col("kind").isin(*_BY_CURVE), F.col("address")).otherwise(F.col("curve"))).withColumn("side", side)


#: Kinds of log by what their topics and data hold; topic hashes are given by the caller.
def decode_logs(logs: DataFrame, topics: dict[str, str]) -> DataFrame:
    """Typed events of known topics: kind, token, trader, side, base, quote (NULL past 120 bits, with their text).

    ``topics`` maps a first topic to CURVE_BUY, CURVE_SELL, LAUNCH, SWEEP, GRADUATION,
    SNIPE_TAX or SWAP.  A curve trade has the token and trader as indexed topics and quote
    and base as words; a swap has two signed amounts.  Removed logs are left out.
    """
    table = F.create_map(*[F.lit(x) for kv in topics.items() for x in kv])
    kind = F.try_element_at(table, F.col("topics")[0])
    rows = logs.where(F.col("topics")[0].isin(*topics) & ~F.coalesce("removed", F.lit(False))).withColumn("kind", kind)
    w0, w1 = hexwords.word(F.col("data"), 0), hexwords.word(F.col("data"), 1)
    topic = lambda k: F.when(F.size("topics") > k, hexwords.address(F.substring(F.col("topics")[k], 3, 64)))
    swap, trade = F.col("kind") == "SWAP", F.col("kind").isin("CURVE_BUY", "CURVE_SELL")
    a0, a1 = hexwords.signed(w0), hexwords.signed(w1)
    side = F.when(F.col("kind") == "CURVE_BUY", "buy").when(F.col("kind") == "CURVE_SELL", "sell").when(swap, prepare.swap_side(a1))
    return rows.select(
        "chain", "block_number", "transaction_index", "log_index", "transaction_hash", "kind", hexwords.normal_hex(F.col("address")).alias("address"), topic(1).alias("token"), topic(2).alias("trader"), side.alias("side"),
        F.when(swap, F.abs(a0)).when(trade, hexwords.unsigned(w0)).otherwise(hexwords.unsigned(w0)).alias("quote"), F.when(swap, F.abs(a1)).otherwise(hexwords.unsigned(w1)).alias("base"), w0.alias("quote_word"), w1.alias("base_word"),
    )


def canonical(records: DataFrame) -> dict[str, DataFrame]:
    """launches, trades and lifecycle of decoded records; only on-chain integers keep a value."""

    def amount(c: str) -> Column:
        return F.when((F.col("amount_quality") == "ONCHAIN_INTEGER") & F.col(c).rlike("^[0-9]{1,38}$"), F.col(c).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))

    parts = [F.col(c) for c in ("dataset_id", "source_file", "source_row", "event_type", "mint", "order_seq")]
    r = records.withColumn("event_id", prepare.event_id(F.lit("corpus"), corpus=parts)).withColumn("ms", F.unix_millis("timestamp"))
    key = ["event_id", F.col("mint").alias("token"), "ms"]
    return {
        "launches": r.where("event_type = 'launch'").select(*key, "creator"),
        "trades": r.where("event_type = 'trade'").select(*key, "trader", "side", amount("sol_amount").alias("quote"), amount("token_amount").alias("base"), "amount_quality"),
        "lifecycle": r.where("event_type = 'graduation'").select(*key, F.lit("POOL_GRADUATED").alias("type")),
    }
