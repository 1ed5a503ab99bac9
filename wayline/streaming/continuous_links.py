"""Continuous match of transfers: a later out replaces a pending one, an out without an in is given out in time.

State is kept by link key, many keys to a group: what has arrived but not been reached by the watermark,
the out that is pending, and the first in that came before any out. Rows may arrive in any order within the
watermark's delay; they take effect in order of time once the watermark has passed them, so the
links don't depend on how the rows fell into batches.

In that order an out takes the place of a pending one, and an in takes the pending out and makes
a link. An in without an out waits for one, if its key has no link yet. A pending out is given
out with a null far side once `max_delay` has passed; a waiting in is then forgotten. Where all
outs of a key come before its ins this is the batch match: last out, first in. Where a key is
used again after its link, the batch match keeps one link and this one makes another.

Rows that arrive behind the watermark are dropped by Spark. A group's rows meet in one task, as
a key's order decides; its state lies in RocksDB and holds what the watermark has not passed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayline.functions.scalars import seconds

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KINDS = {"is_out": bool, "ts": "int64"}
LINKS = "link_key string, src bigint, src_entity_id string, src_event_id string, dst bigint, dst_entity_id string, dst_event_id string"


@dataclass
class Held:
    """State of a key; times in microseconds."""

    out_ts: int | None = None
    out_event: str | None = None
    out_entity: str | None = None
    in_ts: int | None = None
    in_event: str | None = None
    in_entity: str | None = None
    linked_until: int | None = None

    def _out(self) -> tuple:
        return self.out_ts, self.out_entity, self.out_event

    def _clear_out(self) -> None:
        self.out_ts = self.out_event = self.out_entity = None

    def _clear_in(self) -> None:
        self.in_ts = self.in_event = self.in_entity = None

    def expire(self, now: int, max_delay: int) -> Iterator[tuple]:
        """Forget what is older than the delay at this time; gives the out, if one is pending."""
        if self.out_ts is not None and self.out_ts + max_delay < now:
            yield (*self._out(), None, None, None)
            self._clear_out()
        if self.in_ts is not None and self.in_ts + max_delay < now:
            self._clear_in()
        if self.linked_until is not None and self.linked_until < now:
            self.linked_until = None

    def take(self, is_out: bool, ts: int, event: str, entity: str, max_delay: int) -> Iterator[tuple]:
        """The next row in order of time."""
        yield from self.expire(ts, max_delay)
        if is_out:
            self.out_ts, self.out_event, self.out_entity = ts, event, entity
            if self.in_ts is None:
                return
            yield (*self._out(), self.in_ts, self.in_entity, self.in_event)
            self._clear_in()
        elif self.out_ts is not None:
            yield (*self._out(), ts, entity, event)
        else:
            if self.in_ts is None and self.linked_until is None:
                self.in_ts, self.in_event, self.in_entity = ts, event, entity
            return
        self._clear_out()
        self.linked_until = ts + max_delay

    def next_time(self, max_delay: int) -> int | None:
        """When something held is too old."""
        times = [t + max_delay + 1 for t in (self.out_ts, self.in_ts) if t is not None]
        times += [self.linked_until + 1] if self.linked_until is not None else []
        return min(times, default=None)


class LinkMatcher(StatefulProcessor):
    """State of a group of link keys, as JSON text: a call to the state store, and a row passed to it, cost far more than the text."""

    def __init__(self, max_delay: int) -> None:
        self.max_delay = max_delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.inbox = handle.getListState("inbox", "arrived string")  # a list of rows each batch
        self.held = handle.getValueState("held", "by_key string")

    def _advance(self, arrived: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Take what the watermark has passed, keep the rest, and ask to be called for what comes next."""
        now = watermark_ms * 1000
        stored, known = self.inbox.exists(), self.held.exists()
        waiting = [tuple(x) for batch in self.inbox.get() for x in json.loads(batch[0])] if stored else []
        waiting += arrived
        held = {key: Held(*values) for key, values in json.loads(self.held.get()[0]).items()} if known else {}
        # a millisecond is passed when the watermark is beyond it
        passed = sorted((x for x in waiting if x[2] < now), key=lambda x: (x[2], x[3] or ""))
        left = [x for x in waiting if x[2] >= now]
        links = []
        for key, is_out, ts, event, entity in passed:
            links += [(key, *x) for x in held.setdefault(key, Held()).take(is_out, ts, event, entity, self.max_delay)]
        for key, one in held.items():
            links += [(key, *x) for x in one.expire(now, self.max_delay)]
        kept = {key: one for key, one in held.items() if one != Held()}
        if left:
            self.inbox.put([(json.dumps(left),)])
        elif stored:
            self.inbox.clear()
        if kept:
            self.held.update((json.dumps({key: astuple(one) for key, one in kept.items()}),))
        elif known:
            self.held.clear()
        self._call_at([x[2] + 1 for x in left] + [one.next_time(self.max_delay) for one in kept.values()], watermark_ms)
        if links:
            # objects, as a column of numbers with nulls would become one of floats
            yield pd.DataFrame(links, columns=[c.split()[0] for c in LINKS.split(", ")], dtype=object)

    def _call_at(self, times: list[int], watermark_ms: int) -> None:
        """A timer for the first of the times."""
        wanted = max(min(times) // 1000 + 1, watermark_ms + 1) if times else None
        if wanted is not None and wanted not in set(self.handle.listTimers()):
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["link_key", "is_out", "ts", "event_id", "entity_id"]
        arrived = [x for df in rows for x in zip(*[df[c].astype(_KINDS.get(c, object)).tolist() for c in columns])]
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        if min(x[2] for x in arrived) >= watermark_ms * 1000:
            # nothing to take yet; what waits from before has its timer
            self.inbox.appendValue((json.dumps(arrived),))
            self._call_at([x[2] + 1 for x in arrived], watermark_ms)
        else:
            yield from self._advance(arrived, watermark_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())


def match_continuous(outs: DataFrame, ins: DataFrame, late: timedelta = timedelta(hours=1), max_delay: timedelta = timedelta(days=7), groups: int = 4096) -> DataFrame:
    """link_key, then time, entity and event of the source and of the destination.

    The query that runs it needs `STATE_STORE` as its state store (`jobs.run_available(..., state_store=STATE_STORE)`).
    Keys are dealt by hash to `groups`, which a stream fixes at its first start. A batch reads and writes the whole
    state of each group whose time has come: raise the number with the keys that are held.
    """
    rows = [df.select("link_key", "timestamp", "event_id", "entity_id", F.lit(is_out).alias("is_out")) for df, is_out in ((outs, True), (ins, False))]
    both = rows[0].unionByName(rows[1]).where(F.col("link_key") != "")
    both = both.withWatermark("timestamp", f"{seconds(late)} seconds").withColumn("ts", F.unix_micros("timestamp"))
    both = both.withColumn("group", F.pmod(F.xxhash64("link_key"), F.lit(groups)).cast("int"))
    found = both.groupBy("group").transformWithStateInPandas(
        statefulProcessor=LinkMatcher(round(seconds(max_delay) * 1_000_000)), outputStructType=LINKS, outputMode="Append", timeMode="EventTime"
    )
    return found.select(
        "link_key",
        F.timestamp_micros("src").alias("src_block_time"),
        "src_entity_id",
        "src_event_id",
        F.timestamp_micros("dst").alias("dst_block_time"),
        "dst_entity_id",
        "dst_event_id",
    )
