"""Windowed funnel: how deep each entity gets within a span of any of its starts.

One pass over events in order of (entity, time), with a state per step: the latest start from
which that step is reached. A later start is never worse, so one value a step is enough, and an
event of step k reaches it when the start that stands for step k - 1 is no further back than the
span. Within an Arrow batch a start is its row number, which grows with time and with the entity,
so a running maximum serves all entities of the batch at once.

Rows are range-partitioned on entity and time, so a very active entity is cut over several tasks
and no task holds more than a batch. Entities at the edges of a partition leave a summary instead
of a result: their own states, and how early a start from before would get from step i to step j
here. There are two summaries a partition at most; joining those of an entity, in order, gives
what one pass over all its events would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wayline.functions.scalars import seconds
from wayline.session import materialize

NONE = np.iinfo(np.int64).min  # no start, no time


@dataclass
class Best:
    depth: int = 0
    reached: int = NONE
    start: int = NONE

    def offer(self, depth: int, reached: int, start: int) -> None:
        """Take what is deeper, else earlier reached, else later begun."""
        if (depth, -reached, start) > (self.depth, -self.reached, self.start) if self.depth else depth:
            self.depth, self.reached, self.start = depth, reached, start


@dataclass
class Summary:
    """An entity's events so far; lists are by step, from 1 (place 0 is unused)."""

    steps: int
    best: Best = field(default_factory=Best)
    starts: list[int] = field(default_factory=list)
    #: earliest[i][j]: when a start that has reached step i before gets to step j here
    earliest: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.starts = self.starts or [NONE] * (self.steps + 1)
        self.earliest = self.earliest or [[NONE] * (self.steps + 1) for _ in range(self.steps + 1)]

    def follow(self, other: Summary, within: int) -> None:
        """Append a later stretch of events of the same entity."""
        for i in range(1, self.steps + 1):
            if self.starts[i] == NONE:
                continue
            for j in range(i + 1, self.steps + 1):
                at = other.earliest[i][j]
                if at != NONE and at - self.starts[i] <= within:
                    self.best.offer(j, at, self.starts[i])
        if other.best.depth:
            self.best.offer(other.best.depth, other.best.reached, other.best.start)
        for j in range(self.steps, 0, -1):
            here = [self.starts[i] for i in range(1, j) if other.earliest[i][j] != NONE]
            self.starts[j] = max(self.starts[j], other.starts[j], *here)


def _reach(ts: np.ndarray, step: np.ndarray, first: np.ndarray, steps: int, begun: np.ndarray | None = None) -> np.ndarray:
    """Row of the latest start from which each row's step is reached, or -1. `first` is the first row
    of each row's entity; rows that `begun` flags stand for a start themselves."""
    n = len(ts)
    start = np.where(step == 1, np.arange(n), -1)
    if begun is not None:
        start[begun] = np.flatnonzero(begun)
    for k in range(2, steps + 1):
        rows = np.flatnonzero(step == k)
        if not len(rows):
            break
        before = np.maximum.accumulate(np.where(step == k - 1, start, -1))[rows]
        free = rows if begun is None else rows[~begun[rows]]
        before = before if begun is None else before[~begun[rows]]
        start[free] = np.where(before >= first[free], before, -1)
    return start


def _whole(ts: np.ndarray, step: np.ndarray, edges: np.ndarray, steps: int, within: int) -> tuple[np.ndarray, ...]:
    """depth, reached, start of entities whose events are all here, from `edges[e]` to `edges[e + 1]`."""
    sizes = np.diff(edges)
    entity = np.repeat(np.arange(len(sizes)), sizes)
    start = _reach(ts, step, np.repeat(edges[:-1], sizes), steps)
    begun = np.where(start >= 0, ts[np.maximum(start, 0)], NONE)
    timely = (start >= 0) & (ts - np.where(start >= 0, begun, ts) <= within)
    depth = np.zeros(len(sizes), np.int64)
    np.maximum.at(depth, entity[timely], step[timely])
    hit = np.flatnonzero(timely & (step == depth[entity]))
    at, place = np.unique(entity[hit], return_index=True)  # the first row that reaches the depth
    reached, begins = np.full(len(sizes), NONE), np.full(len(sizes), NONE)
    reached[at], begins[at] = ts[hit[place]], begun[hit[place]]
    return depth, reached, begins


def _extend(of: Summary, ts: np.ndarray, step: np.ndarray, within: int) -> None:
    """More events of one entity."""
    steps = of.steps
    for i in range(1, steps):
        at = NONE
        for j in range(i + 1, steps + 1):
            if of.earliest[i][j] == NONE:
                times = ts[step == j]
                k = int(np.searchsorted(times, at, "right"))
                if k == len(times):
                    break
                of.earliest[i][j] = int(times[k])
            at = of.earliest[i][j]
    known = [k for k in range(steps, 0, -1) if of.starts[k] != NONE]  # deeper steps have the earlier starts
    begun = np.zeros(len(known) + len(ts), bool)
    begun[: len(known)] = True
    ts = np.concatenate([np.array([of.starts[k] for k in known], np.int64), ts])
    step = np.concatenate([np.array(known, np.int64), step])
    start = _reach(ts, step, np.zeros(len(ts), np.int64), steps, begun)
    for k in range(1, steps + 1):
        rows = np.flatnonzero((step == k) & (start >= 0))
        if not len(rows):
            continue
        of.starts[k] = int(ts[start[rows].max()])
        rows = rows[~begun[rows]]
        rows = rows[ts[rows] - ts[start[rows]] <= within]
        if len(rows):
            of.best.offer(k, int(ts[rows[0]]), int(ts[start[rows[0]]]))


def windowed_funnel(events: DataFrame, steps: list[str], within: timedelta | float, entity: str = "entity_id", partitions: int | None = None) -> DataFrame:
    """The entity column, depth, started_at, reached_at of each entity that takes the first step.

    depth is the most steps taken in order, each later than the one before and all within the span
    of the first of them, whichever start that is; reached_at is when that depth is first reached,
    started_at the latest start it can be reached from. Events without entity or time take no
    part; a type may be several steps; repeated events change nothing.
    """
    if not steps:
        raise ValueError("a funnel has a step at least")
    places: dict[str, list[int]] = {}
    for k, name in enumerate(steps, 1):
        places.setdefault(name, []).append(k)
    of_type = F.create_map(*[x for name, ks in places.items() for x in (F.lit(name), F.array(*[F.lit(k).cast("long") for k in ks]))])
    rows = events.where(F.col("event_type").isin(list(places)) & F.col(entity).isNotNull() & F.col("timestamp").isNotNull())
    rows = rows.select(
        F.col(entity).alias("entity"),
        F.unix_micros("timestamp").alias("ts"),
        F.explode(F.element_at(of_type, F.col("event_type"))).alias("step"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),  # lets equal events be cut too
    )
    # at one time the deepest step comes first: it has to be later than the one before it
    order = [F.col("entity"), F.col("ts"), F.col("step").desc(), F.col("spread")]
    placed = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order).select("entity", "ts", "step")
    kind, span, n_steps = events.schema[entity].dataType, round(seconds(within) * 1_000_000), len(steps)
    longs = T.ArrayType(T.LongType())
    found = T.StructType([T.StructField("entity", kind), *[T.StructField(n, T.LongType()) for n in ("depth", "reached", "start")]])
    more = {"part": T.IntegerType(), "starts": longs, "earliest": T.ArrayType(longs)}
    out = T.StructType([*found.fields, *[T.StructField(n, t) for n, t in more.items()]])
    sent = to_arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_entity, state, edge = None, None, True  # edge: the open entity may have begun before this partition

        def closed(at_edge: bool) -> pa.RecordBatch:
            row = [open_entity, state.best.depth, state.best.reached, state.best.start]
            row += [part, state.starts, state.earliest] if at_edge else [None, None, None]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, sent)], schema=sent)

        for batch in batches:
            if not len(batch):
                continue
            names = batch.column(0)
            ts, step = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            codes = names.dictionary_encode().indices.to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(ts)]])
            a = 0
            if state is not None:
                if names[0].as_py() == open_entity:
                    _extend(state, ts[: edges[1]], step[: edges[1]], span)
                    a = 1
                if len(edges) - 1 > a:  # another entity follows
                    yield closed(edge)
                    edge, state = False, None
            elif len(edges) > 2:  # the first entity of the partition ends here
                state, open_entity = Summary(n_steps), names[0].as_py()
                _extend(state, ts[: edges[1]], step[: edges[1]], span)
                yield closed(True)
                edge, state, a = False, None, 1
            if len(edges) - 2 > a:  # entities that begin and end in this batch
                lo, hi = edges[a], edges[-2]
                depth, reached, start = _whole(ts[lo:hi], step[lo:hi], edges[a:-1] - lo, n_steps, span)
                whole = [names.take(pa.array(edges[a:-2])), pa.array(depth), pa.array(reached), pa.array(start)]
                whole += [pa.nulls(len(depth), f.type) for f in sent][4:]
                yield pa.RecordBatch.from_arrays(whole, schema=sent)
            if state is None:
                lo = edges[-2]
                state, open_entity = Summary(n_steps), names[lo].as_py()
                _extend(state, ts[lo:], step[lo:], span)
        if state is not None:
            yield closed(True)

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        whole = Summary(n_steps)
        for r in parts.itertuples():
            best = Best(int(r.depth), int(r.reached), int(r.start))
            whole.follow(Summary(n_steps, best, [int(x) for x in r.starts], [[int(x) for x in y] for y in r.earliest]), span)
        return pd.DataFrame({"entity": [parts["entity"].iloc[0]], "depth": [whole.best.depth], "reached": [whole.best.reached], "start": [whole.best.start]})

    # written, as both readers must see the same cuts between partitions
    scanned = materialize(placed.mapInArrow(scan, out), "funnel")
    # two rows a partition at most have a part
    joined = scanned.where("part is not null").groupBy("entity").applyInPandas(join, found)
    all_found = scanned.where("part is null").select(*found.fieldNames()).unionByName(joined).where("depth > 0")
    return all_found.select(
        F.col("entity").alias(entity),
        F.col("depth").cast("int").alias("depth"),
        F.timestamp_micros("start").alias("started_at"),
        F.timestamp_micros("reached").alias("reached_at"),
    )


def depth_counts(found: DataFrame, steps: list[str]) -> DataFrame:
    """Entities per step and conversion from the first and the previous step."""
    counts = found.agg(*[F.count_if(F.col("depth") >= k).alias(f"n{k}") for k in range(1, len(steps) + 1)])
    rate = lambda a, b: F.round(F.try_divide(F.col(f"n{a}"), F.col(f"n{b}")), 6)
    rows = [
        F.struct(
            F.lit(k).alias("step"),
            F.lit(name).alias("event_type"),
            F.col(f"n{k}").alias("n_entities"),
            rate(k, 1).alias("rate_from_first"),
            rate(k, max(k - 1, 1)).alias("rate_from_previous"),
        )
        for k, name in enumerate(steps, 1)
    ]
    return counts.select(F.inline(F.array(*rows)))
