"""Landed price payloads to price rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.schema import TOKEN_PRICES, conform
from wayline.sources.tokens import CHAIN_TO_PLATFORM

PAYLOAD_SCHEMA = "chain string, landed_at timestamp, body string"
_QUOTES = "map<string,struct<usd:decimal(38,18),usd_24h_vol:decimal(38,2)>>"


def price_rows(payloads: DataFrame, requested: DataFrame, source: str = "coingecko") -> DataFrame:
    """One price per payload and requested ``(chain, token_address)`` it quotes.

    The payload's addresses are lower case; the row keeps the address as it was
    requested.  Tokens without a price and chains without a platform give none.
    """
    quotes = (
        payloads.where(F.col("chain").isin(list(CHAIN_TO_PLATFORM)))
        .select("chain", "landed_at", F.explode(F.from_json("body", _QUOTES)).alias("__key", "__quote"))
        .where(F.col("__quote.usd").isNotNull())
    )
    wanted = requested.select("chain", "token_address", F.lower("token_address").alias("__key"))
    rows = quotes.join(wanted, ["chain", "__key"]).select(
        "token_address",
        "chain",
        F.col("landed_at").alias("timestamp"),
        F.col("__quote.usd").alias("price_usd"),
        F.lit(source).alias("source"),
        F.col("__quote.usd_24h_vol").alias("volume_24h_usd"),
    )
    return conform(rows, TOKEN_PRICES)


def count_by_chain(prices: DataFrame) -> DataFrame:
    """How many price rows a load gives per chain."""
    return prices.groupBy("chain").agg(F.count(F.lit(1)).alias("n_prices"))
