"""The scheduled jobs, each one Spark plan from landed rows to snapshot tables.

A run pulls a lookback that the run before has pulled in part, and may itself be
repeated: rows that are stored already are left out by their keys, so the same
run twice leaves the same tables.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.decode import DecoderRegistry, decode_logs
from wayline.operators.enrich import enrich_window
from wayline.operators.identity import relationship_rows, resolve_batch
from wayline.operators.links import link_rows, match
from wayline.sinks import snapshots, tables
from wayline.sources.chain_logs import normalise_logs, scan_logs


def ingest_logs(landed: DataFrame, base: str, registry: DecoderRegistry | None = None) -> dict[str, int]:
    """Landed logs to the log and event tables under ``base``.

    Events are decoded from this run's normalised frame, not fetched again.
    Counts are those of the rows that are new.
    """
    logs = normalise_logs(landed)
    n_logs = snapshots.insert_new(tables.log_rows(logs), f"{base}/canonical_logs", "canonical_logs")
    events = tables.event_rows(decode_logs(logs, registry))
    n_events = snapshots.insert_new(events, f"{base}/canonical_events", "canonical_events")
    return {"raw_logs_ingested": n_logs, "decoded_events": n_events}


def link_transfers(
    logs: DataFrame,
    arrivals: DataFrame | None,
    base: str,
    end: datetime,
    lookback: timedelta = timedelta(minutes=30),
    registry: DecoderRegistry | None = None,
) -> int:
    """Match the outs of the lookback with ins of twice the lookback and store the links.

    The built-in decoders know no arrival event, so ``arrivals`` supplies rows
    of type ``bridge_in`` from elsewhere.
    """
    recent = decode_logs(scan_logs(logs, end - 2 * lookback, end), registry)
    outs = recent.where((F.col("event_type") == "bridge_out") & (F.col("timestamp") >= F.lit(end - lookback)))
    ins = recent.where(F.col("event_type") == "bridge_in")
    if arrivals is not None:
        within = F.col("timestamp").between(F.lit(end - 2 * lookback), F.lit(end))
        ins = ins.unionByName(arrivals.where(within), allowMissingColumns=True)
    return snapshots.upsert(link_rows(match(outs, ins)), f"{base}/bridge_links", "bridge_links")


def price_events(
    base: str, metadata: DataFrame, prices: DataFrame, end: datetime, window: timedelta = timedelta(hours=1)
) -> int:
    """Price the pending events of a window and fill the values in."""
    spark = metadata.sparkSession
    events = tables.read_table(spark, f"{base}/canonical_events")
    window_events = tables.month_between(events, "canonical_events", end - window, end)
    updates = enrich_window(window_events, metadata, prices, end=end, window=window)
    updates.write.mode("overwrite").parquet(f"{base}/canonical_events_updates")
    stored = spark.read.parquet(f"{base}/canonical_events_updates")
    return tables.write_back(spark, f"{base}/canonical_events", stored, f"{base}/_staging")


def resolve_identities(entities: DataFrame, resolvers: list[DataFrame], base: str) -> int:
    """Resolve entities and add the links that the relationship table doesn't have."""
    rows = relationship_rows(resolve_batch(entities, resolvers))
    return snapshots.insert_new(rows, f"{base}/entity_relationships", "entity_relationships")
