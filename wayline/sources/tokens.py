"""Token metadata and contract-label dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.schema import TOKEN_METADATA, conform
from wayline.session import constant_frame

# Chain names of the price provider.
CHAIN_TO_PLATFORM = {
    "ethereum": "ethereum",
    "base": "base",
    "arbitrum": "arbitrum-one",
    "optimism": "optimistic-ethereum",
}

# Address, chain, symbol, decimals, name.
KNOWN_TOKENS = [
    ("0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2", "ethereum", "WETH", 18, "Wrapped Ether"),
    ("0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", "ethereum", "USDC", 6, "USD Coin"),
    ("0xdac17f958d2ee523a2206206994597c13d831ec7", "ethereum", "USDT", 6, "Tether"),
    ("0x6b175474e89094c44da98b954eedeac495271d0f", "ethereum", "DAI", 18, "Dai Stablecoin"),
    ("0x2260fac5e5542a773aa44fbcfedf7c193bc2c599", "ethereum", "WBTC", 8, "Wrapped BTC"),
    ("0x4200000000000000000000000000000000000006", "base", "WETH", 18, "Wrapped Ether"),
    ("0x833589fcd6edb6e08f4c7c32d4f71b54bda02913", "base", "USDC", 6, "USD Coin"),
    ("0x50c5725949a6f0c72e6c4a641f24049a917db0cb", "base", "DAI", 18, "Dai Stablecoin"),
    ("0x82af49447d8a07e3bd95bd0d56f35241523fbab1", "arbitrum", "WETH", 18, "Wrapped Ether"),
    ("0xaf88d065e77c8cc2239327c5edb3a432268e5831", "arbitrum", "USDC", 6, "USD Coin"),
    ("0xfd086bc7cd5c481dcc9c85ebe478a1c0b69fcbb9", "arbitrum", "USDT", 6, "Tether"),
    ("0x4200000000000000000000000000000000000042", "optimism", "OP", 18, "Optimism"),
    ("0x0b2c639c533813f4aa9d7837caf62653d097ff85", "optimism", "USDC", 6, "USD Coin"),
]

CONTRACT_INFO_SCHEMA = "chain string, address string, landed_at timestamp, body string"
_CONTRACT_BODY = (
    "symbol string, name string, detail_platforms map<string,struct<decimal_place:int>>"
)


def known_tokens(spark: SparkSession) -> DataFrame:
    names = ("token_address", "chain", "symbol", "decimals", "name")
    return constant_frame(spark, [dict(zip(names, t)) for t in KNOWN_TOKENS], TOKEN_METADATA)


def contract_info(landed: DataFrame) -> DataFrame:
    """Landed contract-info payloads to metadata rows; unknown chains give none."""
    platform = F.lit(None).cast("string")
    for chain, name in CHAIN_TO_PLATFORM.items():
        platform = F.when(F.col("chain") == chain, F.lit(name)).otherwise(platform)
    rows = (
        landed.withColumn("__platform", platform)
        .where(F.col("__platform").isNotNull())
        .withColumn("__body", F.from_json("body", _CONTRACT_BODY))
        .where(F.col("__body").isNotNull())
    )
    detail = F.try_element_at("__body.detail_platforms", F.col("__platform"))
    return conform(
        rows.select(
            F.col("address").alias("token_address"),
            "chain",
            F.upper(F.coalesce("__body.symbol", F.lit(""))).alias("symbol"),
            F.coalesce(detail["decimal_place"], F.lit(18)).alias("decimals"),
            F.coalesce("__body.name", F.lit("")).alias("name"),
            F.col("landed_at").alias("inserted_at"),
        ),
        TOKEN_METADATA,
    )


def latest_metadata(metadata: DataFrame) -> DataFrame:
    """The last inserted row per (chain, token); the greatest values on a tie."""
    values = [F.col(c) for c in ("inserted_at", "symbol", "decimals", "name")]
    return (
        metadata.groupBy("chain", "token_address")
        .agg(F.max(F.struct(*values)).alias("__last"))
        .select(
            "token_address",
            "chain",
            *[F.col(f"__last.{c}").alias(c) for c in ("symbol", "decimals", "name", "inserted_at")],
        )
    )


def label_addresses(events: DataFrame, labels: DataFrame, column: str = "venue") -> DataFrame:
    """Events with the label and category of the contract in ``column``.

    ``labels(chain, address, label, category)``; the first label in text order
    counts when a contract has several.
    """
    one = (
        labels.groupBy("chain", F.lower("address").alias("__address"))
        .agg(F.min(F.struct("label", "category")).alias("__label"))
        .withColumnRenamed("chain", "__chain")
    )
    return events.join(
        one, (F.col("chain") == F.col("__chain")) & (F.lower(column) == F.col("__address")), "left"
    ).select(
        *[F.col(c) for c in events.columns],
        F.col("__label.label").alias("contract_label"),
        F.col("__label.category").alias("contract_category"),
    )
