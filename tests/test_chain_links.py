"""One-to-one match by chain against a stack over rows in order of time."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import event, events
from wayline.operators.chain_links import match_by_chain
from wayline.schema import extra_value

HOUR = timedelta(hours=1)


def origin():
    return extra_value("origin")


def brute(rows, max_hours):
    """rows: (is_out, key, origin, hour, event_id); pairs of event ids."""
    found, stacks = set(), {}
    for is_out, key, origin, hour, event_id in sorted(rows, key=lambda r: (r[3], not r[0], r[4])):
        if origin is None:
            continue
        stack = stacks.setdefault((key, origin), [])
        if is_out:
            stack.append((hour, event_id))
        elif stack:
            out = stack.pop()
            if max_hours is None or hour - out[0] <= max_hours:
                found.add((out[1], event_id))
    return found


def frames(spark, rows):
    def at(hour):
        return f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}:00"

    outs = [event(e, "bridge_out", at(h), link_key=k, link_key_type="t", chain=o, entity="0xa") for out, k, o, h, e in rows if out]
    ins = [event(e, "bridge_in", at(h), link_key=k, link_key_type="t", chain="dst", entity="0xb", extra=f'{{"origin": "{o}"}}' if o else None) for out, k, o, h, e in rows if not out]
    return events(spark, *outs), events(spark, *ins)


@pytest.mark.parametrize("seed,bucket,most", [(1, 24, None), (2, 3, None), (3, 5, 30), (4, 1000, 6), (5, 1, 12)])
def test_equals_a_stack(spark, seed, bucket, most):
    r = random.Random(seed)
    rows = [(r.random() < 0.5, r.choice(["1", "2", "hot", "hot", "hot"]), r.choice(["base", "base", "arb", None]), r.randint(0, 240), f"e{i:03d}") for i in range(260)]
    outs, ins = frames(spark, rows)
    got = match_by_chain(outs, ins, origin(), max_delay=most and most * HOUR, bucket=bucket * HOUR).collect()
    pairs = [(r.src_event_id, r.dst_event_id) for r in got]
    assert len(set(pairs)) == len(pairs) and set(pairs) == brute(rows, most) and len(pairs) > 20


def test_one_id_on_two_chains_and_links_of_both(spark):
    rows = [(True, "7", "base", 1, "o1"), (True, "7", "arb", 2, "o2"), (False, "7", "arb", 3, "i1"), (False, "7", "base", 4, "i2")]
    outs, ins = frames(spark, rows)
    got = {(r.src_event_id, r.dst_event_id, r.src_chain, r.dst_chain, r.link_key_type) for r in match_by_chain(outs, ins, origin()).collect()}
    assert got == {("o1", "i2", "base", "dst", "t"), ("o2", "i1", "arb", "dst", "t")}
    # without chains one key holds them all: still both outs have an in
    assert {(r.src_event_id, r.dst_event_id) for r in match_by_chain(outs, ins).collect()} == {("o2", "i1"), ("o1", "i2")}
    to = F.when(F.col("event_id") == "o1", "dst").otherwise("elsewhere")
    assert [(r.src_event_id, r.dst_event_id) for r in match_by_chain(outs, ins, origin(), to).collect()] == [("o1", "i2")]


def test_empty_sides_and_missing_keys(spark):
    outs, ins = frames(spark, [(True, "7", "base", 1, "o1"), (False, "", "base", 2, "i1")])
    assert match_by_chain(outs, ins, origin()).collect() == [] and match_by_chain(events(spark), ins).collect() == []
    untimed = outs.withColumn("timestamp", F.lit(None).cast("timestamp"))
    assert match_by_chain(untimed, ins, origin()).collect() == []


def test_only_wanted_columns_are_carried(spark):
    outs, ins = frames(spark, [(True, "7", "base", 1, "o1"), (False, "7", "base", 4, "i1")])
    wanted = match_by_chain(outs, ins, origin(), max_delay=5 * HOUR, columns=["src_event_id", "dst_event_id"])
    assert wanted.columns == ["link_key_type", "link_key", "src_block_time", "src_event_id", "dst_block_time", "dst_event_id"]
    assert [(r.src_event_id, r.dst_event_id) for r in wanted.collect()] == [("o1", "i1")]


@pytest.mark.parametrize("seed,bucket,slice_rows", [(6, 3, 0), (7, 5, 60), (8, 30, 60), (9, 1, 260)])
def test_crowded_keys_are_cut_and_others_stay_whole(spark, seed, bucket, slice_rows):
    r = random.Random(seed)
    rows = [(r.random() < 0.5, r.choice(["1", "2", "hot", "hot", "hot"]), r.choice(["base", "base", "arb", None]), r.randint(0, 240), f"e{i:03d}") for i in range(260)]
    outs, ins = frames(spark, rows)
    links = match_by_chain(outs, ins, origin(), max_delay=20 * HOUR, bucket=bucket * HOUR, slice_rows=slice_rows)
    pairs = [(r.src_event_id, r.dst_event_id) for r in links.collect()]
    assert len(set(pairs)) == len(pairs) and set(pairs) == brute(rows, 20)
    assert bool(links.inputFiles()) == (slice_rows < 260)


def test_a_row_is_shuffled_once_and_its_id_travels_once(spark):
    outs, ins = frames(spark, [(True, "7", "base", 1, "o1"), (False, "7", "base", 4, "i1")])
    links = match_by_chain(outs, ins, origin(), columns=["src_event_id", "dst_event_id"])
    assert not links.inputFiles()  # no table between
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    wide = match_by_chain(outs, ins, origin()).collect()
    assert [(r.src_event_id, r.dst_event_id, r.src_entity_id, r.dst_entity_id, r.dst_chain) for r in wide] == [("o1", "i1", "0xa", "0xb", "dst")]
