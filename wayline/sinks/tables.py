"""Writing the tables: layout, defaults, idempotent re-ingest, write-back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayline.operators.enrich import affected_months, apply_updates
from wayline.schema import (
    CANONICAL_EVENTS,
    CANONICAL_LOGS,
    EXACT_AMOUNTS,
    TOKEN_PRICES,
    conform,
    to_storage_nulls,
)
from wayline.sinks import snapshots
from wayline.sinks.layout import LAYOUT, laid_out, with_options


def event_rows(events: DataFrame) -> DataFrame:
    """Stored form of canonical events."""
    return to_storage_nulls(conform(events, CANONICAL_EVENTS, keep=EXACT_AMOUNTS))


def log_rows(logs: DataFrame, inserted_at: datetime | Column | None = None) -> DataFrame:
    """Stored form of raw logs: not decoded yet, version 0."""
    when = F.current_timestamp() if inserted_at is None else F.lit(inserted_at)
    return conform(
        logs.withColumns({"decoded": F.lit(0), "decoder_version": F.lit(0), "inserted_at": when}), CANONICAL_LOGS
    )


def price_table_rows(prices: DataFrame, inserted_at: datetime | Column | None = None) -> DataFrame:
    when = F.current_timestamp() if inserted_at is None else F.lit(inserted_at)
    return conform(prices.withColumn("inserted_at", when), TOKEN_PRICES)


def deduplicate(events: DataFrame) -> DataFrame:
    """One row per event id: re-pulled rows carry the same id."""
    return events.dropDuplicates(["event_id"])


def write_table(df: DataFrame, path: str, table: str, mode: str = "append") -> int:
    """Write the rows in the layout of the table and return how many there were."""
    month = LAYOUT[table][0]
    written = Observation()
    rows = laid_out(df, table).observe(written, F.count(F.lit(1)).alias("n"))
    writer = with_options(rows.write.mode(mode), table)
    if month is not None:
        writer = writer.partitionBy(month)
    writer.parquet(path)
    return written.get["n"]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a snapshot table, or the files of a plain one."""
    if snapshots.is_snapshot_table(spark, path):
        return snapshots.read(spark, path)
    return spark.read.parquet(path)


def month_between(df: DataFrame, table: str, start: datetime, end: datetime) -> DataFrame:
    """Partition predicate that follows from a closed time range."""
    month, source, _ = LAYOUT[table]
    first, last = start.date().replace(day=1), end.date().replace(day=1)
    return df.where(F.col(month).between(F.lit(first), F.lit(last))).where(
        F.col(source).between(F.lit(start), F.lit(end))
    )


def write_back(spark: SparkSession, path: str, updates: DataFrame, staging: str) -> int:
    """Fill enrichment updates into the stored events.

    The months an update touches are written anew.  A snapshot table swaps them
    all in one rename.  Files of a plain folder have no such swap: the months go
    to ``staging`` first and replace their folders one by one, so a job lost in
    that last write leaves some months to be copied from ``staging``.
    """
    if snapshots.is_snapshot_table(spark, path):
        return snapshots.write_back(spark, path, updates)
    events = read_table(spark, path)
    months = [row[0] for row in affected_months(events, updates).collect()]
    if not months:
        return 0
    touched = events.where(F.col("event_month").isin(months)).drop("event_month")
    write_table(apply_updates(touched, updates), staging, "canonical_events", mode="overwrite")
    staged = read_table(spark, staging)
    (
        staged.sortWithinPartitions("event_month", "entity_id", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("event_month")
        .parquet(path)
    )
    return updates.select("event_id").distinct().count()
