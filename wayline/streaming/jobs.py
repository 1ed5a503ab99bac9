"""Streaming forms of the ingest steps."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.scalars import seconds


def _interval(span: timedelta | float) -> str:
    return f"{seconds(span)} seconds"


def deduplicate_stream(events: DataFrame, late: timedelta = timedelta(hours=1)) -> DataFrame:
    """First arrival of each event id; ids are forgotten ``late`` after their time."""
    return events.withWatermark("timestamp", _interval(late)).dropDuplicatesWithinWatermark(["event_id"])


def hourly_counts_stream(events: DataFrame, keys: list[str], late: timedelta = timedelta(hours=1)) -> DataFrame:
    """Events per key and hour, emitted once an hour is complete."""
    return (
        events.withWatermark("timestamp", _interval(late))
        .groupBy(*keys, F.window("timestamp", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(*keys, F.col("w.start").alias("hour"), "n_events")
    )


def match_stream(
    outs: DataFrame,
    ins: DataFrame,
    late: timedelta = timedelta(hours=1),
    max_delay: timedelta = timedelta(days=7),
) -> DataFrame:
    """Links as their second side arrives, and outs left without one.

    Each key counts once per side within the watermark, so a repeated key gives
    no pairs.  An out without an in comes out with a null far side after the
    watermark has passed ``max_delay``; the batch match keeps it open for ever.
    """
    src = (
        outs.where(F.col("link_key") != "")
        .withWatermark("timestamp", _interval(late))
        .dropDuplicatesWithinWatermark(["link_key"])
        .select(
            "link_key",
            F.col("timestamp").alias("src_block_time"),
            F.col("entity_id").alias("src_entity_id"),
            F.col("event_id").alias("src_event_id"),
        )
    )
    dst = (
        ins.where(F.col("link_key") != "")
        .withWatermark("timestamp", _interval(late))
        .dropDuplicatesWithinWatermark(["link_key"])
        .select(
            F.col("link_key").alias("dst_link_key"),
            F.col("timestamp").alias("dst_block_time"),
            F.col("entity_id").alias("dst_entity_id"),
            F.col("event_id").alias("dst_event_id"),
        )
    )
    near = F.expr(
        f"link_key = dst_link_key "
        f"AND dst_block_time >= src_block_time - INTERVAL {int(seconds(max_delay))} SECONDS "
        f"AND dst_block_time <= src_block_time + INTERVAL {int(seconds(max_delay))} SECONDS"
    )
    return src.join(dst, near, "leftOuter").drop("dst_link_key")


def run_available(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    state_partitions: int | None = None,
    state_store: str | None = None,
) -> DataFrame:
    """Process what has arrived into Parquet files and return them as a table.

    ``state_partitions`` is the number of partitions the state keeps; a stream
    fixes it at its first start, and restarts with the same checkpoint keep it.
    ``state_store`` is the class that keeps it, if not the session's.
    """
    spark = stream.sparkSession
    wanted = {"spark.sql.shuffle.partitions": state_partitions, "spark.sql.streaming.stateStore.providerClass": state_store}
    wanted = {setting: str(value) for setting, value in wanted.items() if value is not None}
    session_values = {setting: spark.conf.get(setting) for setting in wanted}
    for setting, value in wanted.items():
        spark.conf.set(setting, value)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for setting, value in session_values.items():  # a started stream has its own copy
            spark.conf.set(setting, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
