"""Trajectories: the events of entities around an anchor event."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions.scalars import seconds, seconds_between, shift
from wayline.operators.identity import resolve_to_wallet
from wayline.schema import EVENT_COLUMNS
from wayline.session import constant_frame, materialize

Span = timedelta | float

QUERY = ["query_entity_id", "query_entity_type"]

_ROOTS = T.StructType(
    [T.StructField("entity_id", T.StringType()), T.StructField("entity_type", T.StringType())]
)

_OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "LIKE": lambda c, v: c.like(v),
    "NOT LIKE": lambda c, v: ~c.like(v),
    "IN": lambda c, v: c.isin(list(v)),
    "NOT IN": lambda c, v: ~c.isin(list(v)),
}


@dataclass(frozen=True)
class Filter:
    """``field op value`` on a canonical column."""

    field: str
    op: str
    value: Any

    def column(self) -> Column:
        if self.field not in EVENT_COLUMNS:
            raise ValueError(f"Invalid filter field: {self.field}")
        if self.op.upper() not in _OPERATORS:
            raise ValueError(f"Invalid filter operator: {self.op}")
        return _OPERATORS[self.op.upper()](F.col(self.field), self.value)


def _queries(roots: DataFrame | Iterable[str] | None, edges: DataFrame | None, events: DataFrame) -> DataFrame | None:
    """Requested entities with the id their events are stored under."""
    if roots is None:
        return None
    if not isinstance(roots, DataFrame):
        rows = [{"entity_id": i, "entity_type": "wallet"} for i in dict.fromkeys(roots)]
        roots = constant_frame(events.sparkSession, rows, _ROOTS)
    if "entity_type" not in roots.columns:
        roots = roots.withColumn("entity_type", F.lit("wallet"))
    return resolve_to_wallet(roots, edges).select(
        F.col("entity_id").alias("query_entity_id"),
        F.col("entity_type").alias("query_entity_type"),
        F.col("wallet").alias("__id"),
    )


def anchors(events: DataFrame, anchor: str) -> DataFrame:
    """Time of the latest anchor event of each entity that has one."""
    return (
        events.where(F.col("event_type") == anchor)
        .groupBy("entity_id")
        .agg(F.max("timestamp").alias("anchor_ts"))
    )


#: Partition column of stored events.
MONTH = "event_month"


def _in_months(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events of the months that the windows touch; one value a month reaches the driver."""
    first, last = F.trunc(F.col("__from").cast("date"), "month"), F.trunc(F.col("__until").cast("date"), "month")
    touched = windows.where(first <= last).select(F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("month")).distinct()
    months = sorted(r["month"] for r in touched.where("month is not null").collect())
    return events.where(F.col(MONTH).isin(months)) if months else events.where(F.lit(False))


def _in_order(df: DataFrame, ordered: bool) -> DataFrame:
    if not ordered:
        return df
    return df.orderBy("query_entity_id", "query_entity_type", "timestamp", "event_id")


def _windows(
    events: DataFrame, anchor: str, before: Span, after: Span, roots: DataFrame | Iterable[str] | None, edges: DataFrame | None
) -> DataFrame:
    """Window of each requested entity, one row; written first if events lie in month folders."""
    queries = _queries(roots, edges, events)
    found = anchors(events, anchor).withColumnRenamed("entity_id", "__id")
    if queries is None:
        found = found.select(
            F.col("__id").alias("query_entity_id"),
            F.lit("wallet").alias("query_entity_type"),
            "__id",
            "anchor_ts",
        )
    else:
        found = queries.join(found, "__id")
    found = found.select(
        *QUERY,
        "__id",
        "anchor_ts",
        shift(F.col("anchor_ts"), -seconds(before)).alias("__from"),
        shift(F.col("anchor_ts"), after).alias("__until"),
    )
    return materialize(found, "anchors") if MONTH in events.columns else found


def _shown(anchor: str, filters: Iterable[Filter], include_anchor: bool, exclude_internal: bool) -> list[Column]:
    """What an event in a window must meet besides."""
    conditions = [f.column() for f in filters]
    if not include_anchor:
        conditions.append(F.col("event_type") != anchor)
    if exclude_internal:
        conditions.append(F.col("event_type") != "swap_internal")
    return conditions


def _of_roots(events: DataFrame, roots: DataFrame | Iterable[str] | None, edges: DataFrame | None) -> DataFrame:
    if isinstance(roots, (list, tuple, set)) and edges is None:
        return events.where(F.col("entity_id").isin(sorted(set(roots))))
    return events


def _inside(events: DataFrame, windows: DataFrame, *conditions: Column) -> DataFrame:
    """Each event with the windows of its entity that it lies in."""
    if MONTH in events.columns:
        events = _in_months(events, windows)
    inside = (F.col("entity_id") == F.col("__id")) & F.col("timestamp").between(F.col("__from"), F.col("__until"))
    return events.join(windows, reduce(lambda a, b: a & b, conditions, inside))


def trajectory(
    events: DataFrame,
    anchor: str,
    before: Span,
    after: Span,
    *,
    roots: DataFrame | Iterable[str] | None = None,
    edges: DataFrame | None = None,
    filters: Iterable[Filter] = (),
    include_anchor: bool = True,
    exclude_internal: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Events of each entity from ``before`` to ``after`` its latest anchor event.

    ``roots`` are wallet ids or a table ``(entity_id[, entity_type])``; other
    types are resolved to a wallet through ``edges`` first.  Without roots every
    entity that has an anchor event is taken.  Both window ends are inclusive.
    ``include_anchor=False`` leaves out all events of the anchor type, and the
    filters apply to the events in the window, never to the search for the
    anchor.  The result starts with the requested entity and ``anchor_ts``.

    The anchors are one row per entity, found by partial aggregation, and meet
    the events in an equi-join on the entity, whose hot partitions Spark may
    split.  Ids passed as a list also reach the scan as a filter.  Events in
    month folders are read from the months that some window touches: these are
    known before the scan is planned, so the anchors are written first.
    """
    conditions = _shown(anchor, filters, include_anchor, exclude_internal)
    events = _of_roots(events, roots, edges)
    found = _windows(events, anchor, before, after, roots, edges)
    hits = _inside(events, found, *conditions)
    return _in_order(hits.select(*QUERY, "anchor_ts", *events.columns), ordered)


def trajectory_across(
    events: DataFrame,
    links: DataFrame,
    anchor: str,
    before: Span,
    after: Span,
    *,
    roots: DataFrame | Iterable[str] | None = None,
    edges: DataFrame | None = None,
    filters: Iterable[Filter] = (),
    include_anchor: bool = True,
    exclude_internal: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """A trajectory continued on the far side of the entity's transfers.

    Takes the options of ``trajectory``.  The far side of every linked transfer
    among its events, entity and chain, adds that entity's events on that chain
    between the first and last event of the trajectory.  Filters and
    ``include_anchor`` do not apply to the added events; an event already there
    is not repeated.

    A first pass takes the times and link keys of the near side alone, which are
    written to the shared folder once: they tell its bounds and its transfers.
    Far sides are reduced to distinct (entity, chain) per requested entity.  The
    windows of both sides then meet the events in one join, so whole events are
    shuffled to their entity once, with the columns that are asked for.
    """
    conditions = _shown(anchor, filters, include_anchor, exclude_internal)
    own = _of_roots(events, roots, edges)
    found = _windows(own, anchor, before, after, roots, edges)
    out_key = F.when((F.col("event_type") == "bridge_out") & (F.col("link_key") != ""), F.col("link_key"))
    near = _inside(own.withColumn("__out_key", out_key), found, *conditions)
    near = materialize(near.select(*QUERY, "anchor_ts", "__id", "timestamp", "__out_key"), "near-side")

    bounds = near.groupBy(*QUERY, "anchor_ts", "__id").agg(
        F.min("timestamp").alias("__from"), F.max("timestamp").alias("__until")
    )
    outs = near.where(F.col("__out_key").isNotNull()).select(
        *QUERY, F.col("__out_key").alias("link_key"), F.col("__id").alias("src_entity_id")
    )
    far = (
        outs.distinct()
        .join(
            links.where(F.col("dst_entity_id") != "").select(
                "link_key", "src_entity_id", "dst_entity_id", "dst_chain"
            ),
            ["link_key", "src_entity_id"],
        )
        .select(*QUERY, F.col("dst_entity_id").alias("__far_id"), F.col("dst_chain").alias("__chain"))
        .distinct()
        .join(bounds, QUERY)
    )
    window = [*QUERY, "anchor_ts", "__from", "__until"]
    windows = bounds.select(*window, "__id", F.lit(None).cast("string").alias("__chain"), F.lit(False).alias("__far")).unionByName(
        far.select(*window, F.col("__far_id").alias("__id"), "__chain", F.lit(True).alias("__far"))
    )
    if MONTH in events.columns:
        windows = materialize(windows, "windows")
    # all near events lie within their bounds
    shown = reduce(lambda a, b: a & b, conditions, ~F.col("__far"))
    hits = _inside(events, windows, shown | (F.col("__far") & (F.col("chain") == F.col("__chain"))))
    again = W.partitionBy(*QUERY, "event_id").orderBy("__far")
    rows = hits.withColumn("__nth", F.row_number().over(again)).where(~F.col("__far") | (F.col("__nth") == 1))
    return _in_order(rows.select(*QUERY, "anchor_ts", *events.columns), ordered)


def trajectory_index(events: DataFrame, anchor: str, before: Span, after: Span) -> DataFrame:
    """Anchor-to-neighbour table for repeated lookups: entity, anchor, event, offset."""
    hits = trajectory(events, anchor, before, after, ordered=False)
    return hits.select(
        F.col("query_entity_id").alias("entity_id"),
        "anchor_ts",
        "event_id",
        seconds_between(F.col("timestamp"), F.col("anchor_ts")).alias("offset_seconds"),
    )
