"""Feeds, hourly rollups, trends and what happens after a transfer."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.functions.scalars import seconds
from wayline.operators.asof import asof_join

FEED_COLUMNS = ["entity_id", "event_type", "protocol", "chain", "block_number", "tx_hash", "timestamp"]


def recent_events(events: DataFrame, n: int = 100) -> DataFrame:
    """The newest events, newest first; a top-k, so only k rows per task move."""
    extra = ["event_id"] if "event_id" in events.columns else []
    return events.orderBy(F.desc("timestamp"), *extra).limit(n).select(*FEED_COLUMNS)


def feed_type_counts(feed: DataFrame) -> DataFrame:
    return feed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


def newest(feed: DataFrame, n: int = 20) -> DataFrame:
    return feed.orderBy(F.desc("timestamp")).limit(n)


def hourly_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events per key and hour."""
    return events.groupBy(*keys, F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("n_events")
    )


def trending(hourly: DataFrame, keys: list[str], factor: float = 3.0, lag: timedelta = timedelta(hours=24)) -> DataFrame:
    """Hours with more than ``factor`` times the count exactly ``lag`` before.

    The lag is time, not rows: an hour without events has no row.  The window
    runs over the rollup, which has at most one row per key and hour.
    """
    span = int(seconds(lag))
    same_hour_before = W.partitionBy(*keys).orderBy(F.unix_seconds("hour")).rangeBetween(-span, -span)
    return (
        hourly.withColumn("n_before", F.max("n_events").over(same_hour_before))
        .withColumn("growth", F.try_divide("n_events", "n_before"))
        .where(F.col("growth") > factor)
    )


def after_arrivals(
    events: DataFrame,
    arrival: str = "bridge_in",
    within: timedelta = timedelta(hours=24),
    entity: str = "entity_id",
) -> DataFrame:
    """Events other than arrivals with the latest arrival of their entity before them."""
    others = events.where(F.col("event_type") != arrival)
    arrivals = events.where(F.col("event_type") == arrival).select(
        entity, F.col("timestamp").alias("arrival_ts"), F.col("event_id").alias("arrival_id")
    )
    return asof_join(
        others, arrivals, [entity], "timestamp", "arrival_ts", ["arrival_id"], tolerance=within,
        bucket=timedelta(days=1),
    ).where(F.col("arrival_id").isNotNull())


def next_events(followed: DataFrame, n: int) -> DataFrame:
    """The first ``n`` events after each arrival, numbered.

    Each task keeps ``n`` rows per arrival before the shuffle.
    """
    order = W.partitionBy("arrival_id").orderBy("timestamp", "event_id")
    return followed.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def arrival_outcomes(
    events: DataFrame,
    arrival: str = "bridge_in",
    action: str = "swap",
    within: timedelta = timedelta(hours=24),
    keys: list[str] | None = None,
) -> DataFrame:
    """Of the arrivals, the share followed by ``action`` and the share followed by nothing."""
    keys = keys or []
    followed = after_arrivals(events, arrival, within)
    per_arrival = followed.groupBy(F.col("arrival_id").alias("event_id")).agg(
        F.max(F.col("event_type") == action).alias("__acted")
    )
    arrivals = events.where(F.col("event_type") == arrival).join(per_arrival, "event_id", "left")
    return (
        arrivals.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_arrivals"),
            F.count_if(F.coalesce("__acted", F.lit(False))).alias("n_acted"),
            F.count_if(F.col("__acted").isNull()).alias("n_idle"),
        )
        .withColumns(
            {
                "acted_rate": F.round(F.try_divide("n_acted", "n_arrivals"), 6),
                "idle_rate": F.round(F.try_divide("n_idle", "n_arrivals"), 6),
            }
        )
    )


def apps_after_arrivals(followed: DataFrame, app: str = "protocol") -> DataFrame:
    """Which apps are used after arrivals: events, entities."""
    per_entity = followed.where(F.col(app).isNotNull()).groupBy(app, "entity_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_entity.groupBy(app).agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_entities"))
