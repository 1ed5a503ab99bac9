"""Landed web-analytics report pages to canonical events.

A page is one response of the report: column headers, rows of values in header
order, and the landing columns ``pull_id``, ``page_offset`` and ``landed_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.scalars import event_id, json_properties, minute_timestamp, short_hash
from wayline.operators.asof import running_offset
from wayline.schema import CANONICAL_EVENTS, conform

PAGE_SCHEMA = (
    "pull_id string, page_offset bigint, landed_at timestamp, "
    "dimensionHeaders array<struct<name:string>>, "
    "rows array<struct<dimensionValues:array<struct<value:string>>>>, rowCount string"
)

# Report event names and the event types they become.
EVENT_TYPES = {
    "session_start": "session_start",
    "page_view": "pageview",
    "pageview": "pageview",
    "first_visit": "first_visit",
    "user_engagement": "user_engagement",
}


def map_event_type(name: Column, mapping: dict[str, str]) -> Column:
    """Event type of a source's event name, null when the source's map lacks it."""
    mapped = F.lit(None).cast("string")
    for source_name, event_type in mapping.items():
        mapped = F.when(name == source_name, F.lit(event_type)).otherwise(mapped)
    return mapped


def report_rows(pages: DataFrame) -> DataFrame:
    """One row per report row with its index over all pages of the pull.

    The index counts rows of every page before, so it is taken from the page
    sizes alone, without moving the payload twice.
    """
    sizes = pages.select("pull_id", "page_offset", F.coalesce(F.size("rows"), F.lit(0)).alias("__size"))
    offsets = running_offset(sizes, ["pull_id"], "page_offset", "__size", "__before").drop("__size")
    rows = pages.select(
        "pull_id",
        "page_offset",
        "landed_at",
        F.col("dimensionHeaders.name").alias("__names"),
        F.posexplode("rows").alias("__position", "__row"),
    ).withColumn("__values", F.col("__row.dimensionValues.value"))

    def value(header: str) -> Column:
        at = F.array_position("__names", header).cast("int") - 1
        return F.coalesce(F.get("__values", at), F.lit(""))

    return rows.join(offsets, ["pull_id", "page_offset"]).select(
        (F.col("__before") + F.col("__position")).alias("row_index"),
        "landed_at",
        *[
            value(header).alias(name)
            for name, header in {
                "event_name": "eventName",
                "client_id": "clientId",
                "session_id": "sessionId",
                "minute": "dateHourMinute",
                "url": "pageLocation",
                "referrer": "pageReferrer",
                "utm_source": "sessionSource",
                "utm_medium": "sessionMedium",
            }.items()
        ],
    )


def report_events(pages: DataFrame, source_system: str = "ga4", stable_ids: bool = False) -> DataFrame:
    """Canonical events of the report.

    Rows without event name, client or known event type are dropped but still
    counted by the row index.  An unreadable minute falls back to the landing
    time.  ``stable_ids`` leaves the row index out of the identity, so that
    pulling another date range gives a row the same id.
    """
    rows = (
        report_rows(pages)
        .where((F.col("event_name") != "") & (F.col("client_id") != ""))
        .withColumn("event_type", map_event_type(F.col("event_name"), EVENT_TYPES))
        .where(F.col("event_type").isNotNull())
    )
    identity = [F.col(c) for c in ("client_id", "session_id", "event_name", "minute")]
    if not stable_ids:
        identity.append(F.col("row_index"))
    source_event_id = short_hash(*identity)
    events = rows.select(
        F.col("client_id").alias("entity_id"),
        F.lit("device_id").alias("entity_type"),
        event_id(F.lit(source_system), source_event_id).alias("event_id"),
        "event_type",
        F.lit("acquisition").alias("event_category"),
        F.coalesce(minute_timestamp(F.col("minute")), F.col("landed_at")).alias("timestamp"),
        F.lit(source_system).alias("source_system"),
        source_event_id.alias("source_event_id"),
        json_properties(
            {c: F.col(c) for c in ("session_id", "url", "referrer", "utm_source", "utm_medium")}
        ).alias("extra"),
    )
    return conform(events, CANONICAL_EVENTS)
