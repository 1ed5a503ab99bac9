"""Landed product-analytics event pages to canonical events.

A page is one response: a list of events, a link to the next page, and the
landing columns ``pull_id``, ``page_no`` and ``landed_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.scalars import (
    cursor_of,
    event_id,
    iso_timestamp,
    json_properties,
    short_hash,
)
from wayline.operators.asof import running_offset
from wayline.schema import CANONICAL_EVENTS, conform
from wayline.sources.web_report import map_event_type

PAGE_SCHEMA = (
    "pull_id string, page_no bigint, landed_at timestamp, "
    "results array<struct<distinct_id:string,event:string,timestamp:string,"
    "properties:map<string,string>>>, next string"
)

# Product event names and the event types they become.
EVENT_TYPES = {
    "$pageview": "pageview",
    "$session_start": "session_start",
    "$autocapture": "autocapture",
}


def page_cursors(pages: DataFrame) -> DataFrame:
    """The cursor each page hands to its successor, null on the last page."""
    return pages.select("pull_id", "page_no", cursor_of(F.col("next")).alias("cursor"))


def product_rows(pages: DataFrame) -> DataFrame:
    """One row per event with its index over all pages of the pull."""
    sizes = pages.select("pull_id", "page_no", F.coalesce(F.size("results"), F.lit(0)).alias("__size"))
    offsets = running_offset(sizes, ["pull_id"], "page_no", "__size", "__before").drop("__size")
    rows = pages.select(
        "pull_id", "page_no", "landed_at", F.posexplode("results").alias("__position", "__event")
    )

    def text(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(""))

    return rows.join(offsets, ["pull_id", "page_no"]).select(
        (F.col("__before") + F.col("__position")).alias("row_index"),
        "landed_at",
        text("__event.distinct_id").alias("distinct_id"),
        text("__event.event").alias("event_name"),
        text("__event.timestamp").alias("timestamp_raw"),
        F.col("__event.properties").alias("properties"),
    )


def product_events(pages: DataFrame, source_system: str = "posthog", stable_ids: bool = False) -> DataFrame:
    """Canonical events of the pages; see ``report_events`` for the shared rules."""
    rows = (
        product_rows(pages)
        .where((F.col("distinct_id") != "") & (F.col("event_name") != ""))
        .withColumn("event_type", map_event_type(F.col("event_name"), EVENT_TYPES))
        .where(F.col("event_type").isNotNull())
    )
    identity = [F.col(c) for c in ("distinct_id", "event_name", "timestamp_raw")]
    if not stable_ids:
        identity.append(F.col("row_index"))
    source_event_id = short_hash(*identity)

    def property_of(name: str) -> Column:
        return F.try_element_at("properties", F.lit(name))

    events = rows.select(
        F.col("distinct_id").alias("entity_id"),
        F.lit("device_id").alias("entity_type"),
        event_id(F.lit(source_system), source_event_id).alias("event_id"),
        "event_type",
        F.lit("acquisition").alias("event_category"),
        F.coalesce(iso_timestamp(F.col("timestamp_raw")), F.col("landed_at")).alias("timestamp"),
        F.lit(source_system).alias("source_system"),
        source_event_id.alias("source_event_id"),
        json_properties(
            {
                "session_id": property_of("$session_id"),
                "url": property_of("$current_url"),
                "referrer": property_of("$referrer"),
                "utm_source": property_of("utm_source"),
                "utm_medium": property_of("utm_medium"),
            }
        ).alias("extra"),
    )
    return conform(events, CANONICAL_EVENTS)
