"""Strict match by chain: every out and every in takes part in one link at most.

A deposit id says nothing without the chain it was made on, so transfers match within
(link_key_type, link_key, origin chain, destination chain), as far as both sides know the chains.
Within such a key rows are taken in order of time: an in takes the latest out that is still free.
This is how brackets match, and brackets match by counting: with +1 for an out and -1 for an in, an
out that opens a level is closed by the next in on that level. A delay that is too long is judged
afterwards: if the latest free out is too old, all earlier ones are older still.

A key is one window group, after one shuffle, and nothing is written between. Keys are counted
first, by hash cell; those of a crowded cell are cut into time buckets. Brackets are matched within
a bucket first; what is left of a bucket is some ins, then some outs, whose levels follow from two
counts of each bucket before. On one level a bucket leaves one row of a side at most, so no window
of the second round holds more than two rows a bucket. Window functions throughout.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.functions.scalars import seconds
from wayline.operators.asof import SLICE_ROWS, crowded_cells, in_cells
from wayline.session import materialize

SRC = ["src_chain", "src_block_time", "src_tx_hash", "src_entity_id", "src_event_id", "token", "amount"]
DST = ["dst_chain", "dst_block_time", "dst_tx_hash", "dst_entity_id", "dst_event_id"]
KEY = ["link_key_type", "link_key", "origin_chain", "destination_chain"]
SOURCES = {
    **{name: name.split("_", 1)[1] for name in [*SRC, *DST] if "_" in name},
    "src_block_time": "timestamp", "dst_block_time": "timestamp", "token": "token_out", "amount": "amount_out",
}


def _rows(events: DataFrame, side: str, origin: Column, destination: Column, names: list[str]) -> DataFrame:
    # time and id travel once, beside the rest of the row
    rest = [F.col(SOURCES[n]).alias(n) for n in names if SOURCES[n] not in ("timestamp", "event_id")]
    return events.where((F.col("link_key") != "") & F.col("timestamp").isNotNull()).select(
        F.coalesce("link_key_type", F.lit("unknown")).alias("link_key_type"),
        "link_key",
        origin.cast("string").alias("origin_chain"),
        destination.cast("string").alias("destination_chain"),
        F.col("timestamp").alias("ts"),
        F.lit(side == "src").alias("is_out"),
        "event_id",
        *([F.struct(*rest).alias(side)] if rest else []),
    )


def match_by_chain(
    outs: DataFrame,
    ins: DataFrame,
    origin: Column | None = None,
    destination: Column | None = None,
    max_delay: timedelta | None = None,
    bucket: timedelta = timedelta(days=1),
    columns: list[str] | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Links of outs and ins, one to one; columns as of ``links.match``.

    ``columns`` names those of the two sides that are wanted besides the key and the times: others
    are not carried through the shuffle, which Catalyst can't prune.

    ``origin`` tells, of an in, the chain it comes from; ``destination``, of an out, the chain it
    goes to. Without one that chain takes no part; a row that should know it and doesn't (null)
    has no link. An out at the time of an in is before it; then event ids decide.

    Keys whose cell holds more than ``slice_rows`` rows are cut into buckets of time. The count
    runs when the plan is built.
    """
    any_chain = F.lit("")
    # the time decides a delay
    wanted = {
        side: [n for n in names if columns is None or n in columns or SOURCES[n] == "timestamp"]
        for side, names in (("src", SRC), ("dst", DST))
    }
    left = _rows(outs, "src", F.col("chain") if origin is not None else any_chain, destination if destination is not None else any_chain, wanted["src"])
    right = _rows(ins, "dst", origin if origin is not None else any_chain, F.col("chain") if destination is not None else any_chain, wanted["dst"])
    rows = left.unionByName(right, allowMissingColumns=True)
    rows = rows.where(F.col("origin_chain").isNotNull() & F.col("destination_chain").isNotNull())

    crowded = crowded_cells(rows, KEY, slice_rows)
    links = _brackets(rows.where(~in_cells(KEY, crowded)) if crowded else rows, KEY).where(~F.col("is_out") & ~F.col("alone"))
    links = links.select(*KEY, "partner", *_side(links, "dst"))
    if crowded:
        links = links.unionByName(_by_bucket(rows.where(in_cells(KEY, crowded)), bucket))

    at = {"timestamp": "ts", "event_id": "event_id"}
    src = [F.col("partner." + at.get(SOURCES[n], f"src.{n}")).alias(n) for n in wanted["src"]]
    dst = [F.col(at.get(SOURCES[n], f"dst.{n}")).alias(n) for n in wanted["dst"]]
    links = links.select("link_key_type", "link_key", *src, *dst)
    if max_delay is None:
        return links
    delay = F.unix_micros("dst_block_time") - F.unix_micros("src_block_time")
    return links.where(delay <= F.lit(round(seconds(max_delay) * 1_000_000)))


def _side(rows: DataFrame, side: str) -> list[str]:
    return [c for c in ("ts", "event_id", side) if c in rows.columns]


def _brackets(rows: DataFrame, here: list[str]) -> DataFrame:
    """Rows with their level within ``here``; an in has its out as ``partner`` or is ``alone``."""
    order = [F.col("ts"), F.col("is_out").desc(), F.col("event_id")]
    so_far = W.partitionBy(*here).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = so_far.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("sum", F.sum(F.when(F.col("is_out"), 1).otherwise(-1)).over(so_far))
    rows = rows.withColumns(
        {
            "least": F.least(F.lit(0), F.min("sum").over(so_far)),
            "least_before": F.coalesce(F.least(F.lit(0), F.min("sum").over(before)), F.lit(0)),
        }
    )
    unmatched = ~F.col("is_out") & (F.col("sum") < F.col("least_before"))
    level = F.col("sum") - F.col("least") + F.when(F.col("is_out"), 0).otherwise(1)
    # an in without an out here counts the ins before it instead
    rows = rows.withColumns({"alone": unmatched, "level": F.when(unmatched, -F.col("sum")).otherwise(level)})
    on_level = W.partitionBy(*here, "alone", "level").orderBy(*order)
    partner = F.lag(F.struct(*_side(rows, "src"))).over(on_level)
    return rows.withColumns({"partner": partner, "closed": F.lead("is_out").over(on_level)}).drop("sum", "least", "least_before")


def _by_bucket(rows: DataFrame, bucket: timedelta) -> DataFrame:
    """Ins with their partner, of keys cut into buckets of time."""
    here = [*KEY, "bucket"]
    rows = rows.withColumn("bucket", F.floor(F.unix_micros("ts") / F.lit(round(seconds(bucket) * 1_000_000))))
    # an out that its bucket closes is needed as a partner only
    rows = materialize(_brackets(rows, here).where("NOT is_out OR closed IS NULL"), "brackets")
    matched = rows.where(~F.col("is_out") & ~F.col("alone"))

    # rows that found nothing in their bucket: ins that close a level of before, outs that stay open
    left_over = rows.where("alone OR is_out").drop("partner", "closed")
    counts = left_over.groupBy(*here).agg(F.count_if("alone").alias("n_ins"), F.count_if("is_out").alias("n_outs"))
    along = W.partitionBy(*KEY).orderBy("bucket")
    until, earlier = along.rowsBetween(W.unboundedPreceding, W.currentRow), along.rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("at_end", F.sum(F.col("n_outs") - F.col("n_ins")).over(until))
    # the lowest point of a bucket is after its ins
    counts = counts.withColumn("lowest", F.least(F.lit(0), F.min(F.col("at_end") - F.col("n_outs")).over(until)))
    counts = counts.withColumn("open", F.coalesce(F.lag(F.col("at_end") - F.col("lowest")).over(along), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"__{c}") for c in here], "n_ins", "open")
    same = [left_over[c] == counts[f"__{c}"] for c in here]
    placed = left_over.join(counts, same)
    inner = F.when(F.col("alone"), F.col("open") - F.col("level") + 1).otherwise(F.greatest(F.col("open") - F.col("n_ins"), F.lit(0)) + F.col("level"))
    placed = placed.withColumn("outer_level", inner).where(F.col("outer_level") > 0)
    across = W.partitionBy(*KEY, "outer_level").orderBy(F.col("bucket"), F.col("is_out"))
    placed = placed.withColumn("partner", F.lag(F.struct(*_side(rows, "src"))).over(across))
    late = placed.where(~F.col("is_out") & F.col("partner").isNotNull())
    ends = [*KEY, "partner", *_side(rows, "dst")]
    return matched.select(*ends).unionByName(late.select(*ends))
