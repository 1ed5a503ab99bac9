"""The anchor index as a maintained table: each micro-batch writes anew the rows of its own entities only.

The table is a log of rows by batch behind a manifest (``sinks.snapshots``). A batch of events is
first put into the event table, by key, so that a repeated batch adds nothing. Then the index rows
of the entities it names are built from all their stored events and appended under the batch's
number, with one row without an event for each such entity, so that one whose rows are all gone is
known too. An entity's rows are those of its newest batch. A batch that is run again after a
failure finds its number in the manifest and is left out; as the manifest is swapped in one rename,
its rows are either all there or not at all.

A late event, a new anchor or an event that comes again are alike: their entity is rebuilt. What a
batch reads are its entities' events (a join on the entity, whose files hold narrow ranges and
Bloom filters of it), and what it writes are their rows. ``compact`` drops what newer batches replaced.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.trajectory import trajectory_index
from wayline.session import materialize
from wayline.sinks import snapshots

TABLE = "anchor_index"


class AnchorIndex:
    """The index of one anchor type around stored events; ``base`` holds both tables."""

    def __init__(self, base: str, anchor: str, before: timedelta | float, after: timedelta | float) -> None:
        self.events, self.index = f"{base}/canonical_events", f"{base}/{TABLE}"
        self.anchor, self.before, self.after = anchor, before, after

    def update(self, batch: DataFrame, number: int) -> None:
        """Take a batch of stored-form events; a function for ``foreachBatch``."""
        spark = batch.sparkSession
        batch = materialize(batch, "batch")
        snapshots.insert_new(batch, self.events, "canonical_events")
        done = [p.ranges["batch"][1] for p in snapshots.manifest(spark, self.index).parts]
        if max(done, default=-1) >= number:
            return
        touched = batch.select("entity_id").where(F.col("entity_id").isNotNull()).distinct()
        own = snapshots.read(spark, self.events).join(touched, "entity_id", "left_semi")
        rows = trajectory_index(own, self.anchor, self.before, self.after)
        marks = touched.select("entity_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[1:]])
        rows = rows.unionByName(marks).withColumn("batch", F.lit(number).cast("long"))
        snapshots.rewrite(spark, self.index, TABLE, lambda _: False, lambda df: df, rows)

    def read(self, spark: SparkSession) -> DataFrame:
        """entity_id, anchor_ts, event_id, offset_seconds, as ``trajectory_index`` of all stored events."""
        return _newest(snapshots.read(spark, self.index)).where(F.col("event_id").isNotNull()).drop("batch")

    def compact(self, spark: SparkSession) -> None:
        """Keep each entity's newest rows only, in one folder."""
        snapshots.rewrite(spark, self.index, TABLE, lambda _: True, _newest)


def _newest(rows: DataFrame) -> DataFrame:
    """Of each entity the rows of its last batch. The marks alone tell which that is: one an entity and batch."""
    marks = rows.where(F.col("event_id").isNull())
    last = marks.groupBy(F.col("entity_id").alias("__id")).agg(F.max("batch").alias("__last"))
    return rows.join(last, (F.col("entity_id") == F.col("__id")) & (F.col("batch") == F.col("__last"))).drop("__id", "__last")


def maintain(stream: DataFrame, index: AnchorIndex, checkpoint: str) -> None:
    """Run what has arrived of a stream of stored-form events into the index."""
    query = stream.writeStream.foreachBatch(index.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
