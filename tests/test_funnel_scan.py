"""Windowed funnel against every chain of events, over batches and partitions."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import at, event, events
from wayline.operators.funnel_scan import depth_counts, windowed_funnel

HOUR = timedelta(hours=1)


def brute(rows, steps, within):
    """entity → depth, start, reached, by the set of all starts of every event."""
    by = {}
    for entity, kind, t in set(rows):
        if entity is not None:
            by.setdefault(entity, []).append((t, kind))
    found = {}
    for entity, own in by.items():
        starts, best = {}, None
        for t, k in sorted(((t, k) for t, kind in own for k, s in enumerate(steps, 1) if s == kind), key=lambda x: (x[0], -x[1])):
            starts[t, k] = {t} if k == 1 else set().union(*[s for (u, j), s in starts.items() if j == k - 1 and u < t])
            timely = [s for s in starts[t, k] if t - s <= within]
            if timely:
                best = max([b for b in (best, (k, -t, max(timely))) if b])
        if best:
            found[entity] = (best[0], best[2], -best[1])
    return found


def frame(spark, rows):
    made = spark.createDataFrame(rows, "entity_id string, event_type string, s long")
    return made.select("entity_id", "event_type", F.timestamp_seconds("s").alias("timestamp"))


def found(df):
    rows = df.select("entity_id", "depth", F.unix_seconds("started_at"), F.unix_seconds("reached_at")).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_chains(spark, seed):
    rnd = random.Random(seed)
    steps = [["a", "b", "c"], ["a", "b", "a", "c"], ["a", "a"]][seed]
    # one entity has a third of all events, and an id of one event each is common
    rows = [(rnd.choice(["hot", f"e{rnd.randint(0, 60)}", f"f{i}"]), rnd.choice("abcd"), rnd.randint(0, 400)) for i in range(900)]
    rows += [(None, "a", 1), ("n", "b", 1), ("tie", "a", 5), ("tie", "b", 5), ("tie", "c", 5)] + [("twice", "a", 3)] * 40 + [("twice", "b", 4)] * 40
    within = [8, 30, 2][seed]
    want = brute(rows, steps, within)
    events_ = frame(spark, rows).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for partitions in (1, 4, 60):
            assert found(windowed_funnel(events_, steps, within, partitions=partitions)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found(windowed_funnel(events_, steps, timedelta(seconds=within))) == want


def test_a_later_start_converts(spark):
    rows = [("u", "a", 0), ("u", "a", 360_000), ("u", "b", 363_600)]
    assert found(windowed_funnel(frame(spark, rows), ["a", "b"], 2 * HOUR)) == {"u": (2, 360_000, 363_600)}
    assert found(windowed_funnel(frame(spark, rows[::2]), ["a", "b"], 2 * HOUR)) == {"u": (1, 0, 0)}


def test_empty_and_odd_inputs(spark):
    none = events(spark)
    assert windowed_funnel(none, ["a"], HOUR).collect() == []
    with pytest.raises(ValueError):
        windowed_funnel(none, [], HOUR)
    df = events(spark, event("1", "a", "2024-01-01"), event("2", "b", "2024-01-01T00:30"), event("3", "b", "2024-01-02", entity="0xb"))
    df = df.withColumn("depth", F.lit("clash")).withColumn("step", F.lit(1))
    got = windowed_funnel(df, ["a", "b"], HOUR).collect()
    assert [(r.entity_id, r.depth, r.started_at, r.reached_at) for r in got] == [("0xaaa", 2, at("2024-01-01"), at("2024-01-01T00:30"))]
    counts = {r.step: (r.event_type, r.n_entities, r.rate_from_previous) for r in depth_counts(windowed_funnel(df, ["a", "b"], HOUR), ["a", "b"]).collect()}
    assert counts == {1: ("a", 1, 1.0), 2: ("b", 1, 1.0)}
    numbers = df.select(F.lit(5).alias("entity_id"), "event_type", F.lit(None).cast("timestamp").alias("timestamp"))
    assert windowed_funnel(numbers, ["a"], HOUR).collect() == []
