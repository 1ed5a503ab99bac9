"""Landed chain logs: normalise, scan, attach block times, chain union."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import hexwords as H
from wayline.schema import CANONICAL_LOGS, conform

LANDED_LOG_SCHEMA = (
    "source_system string, address string, blockNumber string, logIndex string, "
    "transactionHash string, data string, topics array<string>, block_time timestamp"
)


def normalise_logs(landed: DataFrame) -> DataFrame:
    """Provider JSON rows (``LANDED_LOG_SCHEMA``) to canonical log rows."""
    columns = {
        "chain": F.replace(F.col("source_system"), F.lit("evm_"), F.lit("")),
        "block_number": H.prefixed_int("blockNumber"),
        "tx_hash": F.col("transactionHash"),
        "log_index": H.prefixed_int("logIndex"),
        "data": F.coalesce(F.col("data"), F.lit("0x")),
    }
    columns |= {f"topic{i}": F.get(F.col("topics"), F.lit(i)) for i in range(4)}
    return conform(landed.withColumns(columns), CANONICAL_LOGS).drop(
        "decoded", "decoder_version", "inserted_at"
    )


def scan_logs(
    logs: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    addresses: list[str] | str | None = None,
) -> DataFrame:
    """All logs in a closed time range, of some contracts if given.

    Only comparisons of plain columns with literals, so they reach the scan.
    """
    if isinstance(addresses, str):
        addresses = [addresses]
    if start is not None:
        logs = logs.where(F.col("block_time") >= F.lit(start))
    if end is not None:
        logs = logs.where(F.col("block_time") <= F.lit(end))
    if addresses:
        wanted = sorted({a.lower() for a in addresses})
        logs = logs.where(F.lower("address").isin(wanted))
    return logs


def scan_known_logs(
    logs: DataFrame,
    topic0s: list[str],
    start: datetime | None = None,
    end: datetime | None = None,
    addresses: list[str] | str | None = None,
) -> DataFrame:
    """``scan_logs`` limited to the event signatures of a registry."""
    return scan_logs(logs, start, end, addresses).where(F.col("topic0").isin(list(topic0s)))


def block_seconds(hex_seconds: Column | str) -> Column:
    """Hex epoch seconds to a timestamp."""
    return F.timestamp_seconds(H.prefixed_int(hex_seconds))


def attach_block_times(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fill a null ``block_time`` from ``blocks(chain, number, timestamp_hex)``.

    Rows that have their time carry a key of their own, so that they are
    neither matched nor gathered in one task.
    """
    times = blocks.select(
        F.col("chain").alias("__chain"),
        F.col("number").cast("string").alias("__number"),
        block_seconds("timestamp_hex").alias("__time"),
    )
    missing = F.col("block_time").isNull()
    own = F.concat_ws("\u0000", F.lit(""), F.col("tx_hash"), F.col("log_index").cast("string"))
    keyed = logs.withColumn(
        "__key", F.when(missing, F.col("block_number").cast("string")).otherwise(own)
    )
    return (
        keyed.join(times, (F.col("chain") == F.col("__chain")) & (F.col("__key") == F.col("__number")), "left")
        .withColumn("block_time", F.coalesce("block_time", "__time"))
        .drop("__key", "__chain", "__number", "__time")
    )


def block_bounds(blocks: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """First and last block number per chain in a closed time range."""
    timed = blocks.withColumn("__time", block_seconds("timestamp_hex"))
    return (
        timed.where(F.col("__time").between(F.lit(start), F.lit(end)))
        .groupBy("chain")
        .agg(F.min("number").alias("start_block"), F.max("number").alias("end_block"))
    )


def union_chains(frames: dict[str, DataFrame]) -> DataFrame:
    """One log stream of several chains, each row tagged with its chain."""
    tagged = [
        df.withColumns({"chain": F.lit(chain), "source_system": F.lit(f"evm_{chain}")})
        for chain, df in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
