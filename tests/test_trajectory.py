import random
from datetime import timedelta

import pytest

from tests.helpers import at, event, events
from wayline.operators import funnel, trajectory as T
from wayline.operators.trajectory import Filter
from wayline.session import materialize
from wayline.sinks import tables

D2 = timedelta(days=2)
LINK = "link_key string, src_entity_id string, dst_entity_id string, dst_chain string"
EDGE = (
    "from_entity_type string, from_entity string, to_entity_type string, to_entity string, "
    "confidence_score double, edge_ord int"
)


def ids(df):
    return [r.event_id for r in df.collect()]


def test_window_is_inclusive_and_latest_anchor_wins(spark):
    df = events(
        spark,
        event("old", "bridge_out", "2024-01-05T12:00"),
        event("from", "swap", "2024-01-13T12:00"),
        event("anchor", "bridge_out", "2024-01-15T12:00"),
        event("until", "swap", "2024-01-17T12:00"),
        event("late", "swap", "2024-01-17T12:00:01"),
        event("other", "swap", "2024-01-15T12:00", entity="0xbbb"),
    )
    assert ids(T.trajectory(df, "bridge_out", D2, D2)) == ["from", "anchor", "until"]
    assert ids(T.trajectory(df, "bridge_out", D2, D2, roots=["0xaaa"])) == ["from", "anchor", "until"]
    assert ids(T.trajectory(df, "bridge_out", D2, D2, roots=["0xbbb"])) == []
    assert ids(T.trajectory(df, "absent", D2, D2)) == []


def test_anchor_exclusion_drops_all_of_its_type(spark):
    df = events(
        spark,
        event("a1", "bridge_out", "2024-01-14T12:00"),
        event("a2", "bridge_out", "2024-01-15T12:00"),
        event("s", "swap", "2024-01-14T13:00"),
    )
    assert ids(T.trajectory(df, "bridge_out", D2, D2, include_anchor=False)) == ["s"]


@pytest.mark.parametrize(
    "op,value,expected",
    [
        ("=", "swap", ["s1"]), ("!=", "swap", ["t1", "a"]), (">", "swap", ["t1"]), ("<", "swap", ["a"]),
        (">=", "swap", ["s1", "t1"]), ("<=", "swap", ["s1", "a"]), ("like", "%out", ["t1", "a"]),
        ("not like", "%out", ["s1"]), ("IN", ["swap"], ["s1"]), ("NOT IN", ["swap"], ["t1", "a"]),
    ],
)
def test_filters(spark, op, value, expected):
    df = events(
        spark,
        event("s1", "swap", "2024-01-14T12:00"),
        event("t1", "transfer_out", "2024-01-14T13:00"),
        event("a", "bridge_out", "2024-01-15"),
    )
    assert ids(T.trajectory(df, "bridge_out", D2, D2, filters=[Filter("event_type", op, value)])) == expected


def test_filter_errors(spark):
    df = events(spark, event("a", "bridge_out", "2024-01-15"))
    with pytest.raises(ValueError, match="Invalid filter field"):
        T.trajectory(df, "bridge_out", D2, D2, filters=[Filter("nope", "=", 1)])
    with pytest.raises(ValueError, match="Invalid filter operator"):
        T.trajectory(df, "bridge_out", D2, D2, filters=[Filter("event_type", "~", 1)])


def test_identity_is_resolved_first(spark):
    df = events(
        spark,
        event("a", "bridge_out", "2024-01-15", entity="0xabc"),
        event("o", "swap", "2024-01-14", entity="0xabc"),
        event("raw", "bridge_out", "2024-01-14", entity="vitalik.eth", entity_type="ens"),
    )
    edges = spark.createDataFrame([("ens", "vitalik.eth", "wallet", "0xabc", 0.95, 0)], EDGE)
    roots = spark.createDataFrame([("vitalik.eth", "ens"), ("unknown.eth", "ens")], "entity_id string, entity_type string")
    rows = T.trajectory(df, "bridge_out", D2, D2, roots=roots, edges=edges).collect()
    assert [(r.query_entity_id, r.entity_id, r.event_id) for r in rows] == [
        ("vitalik.eth", "0xabc", "o"), ("vitalik.eth", "0xabc", "a"),
    ]


def test_across_chains(spark):
    df = events(
        spark,
        event("before", "swap", "2024-01-14T12:00"),
        event("anchor", "bridge_out", "2024-01-15T12:00", link_key="dep_123"),
        event("dst_swap", "swap", "2024-01-15T11:00", entity="0xbbb", chain="ethereum"),
        event("after_last", "swap", "2024-01-15T12:30", entity="0xbbb", chain="ethereum"),
        event("elsewhere", "swap", "2024-01-15T11:00", entity="0xbbb", chain="base"),
    )
    links = spark.createDataFrame(
        [("dep_123", "0xaaa", "0xbbb", "ethereum"), ("dep_123", "0xzzz", "0xbbb", "base"), ("dep_123", "0xaaa", "", "base")],
        LINK,
    )
    assert ids(T.trajectory_across(df, links, "bridge_out", D2, D2)) == ["before", "dst_swap", "anchor"]
    # no transfer among the events: the near side only
    hidden = T.trajectory_across(df, links, "bridge_out", D2, D2, include_anchor=False)
    assert ids(hidden) == ["before"]


def test_across_does_not_repeat_events(spark):
    df = events(spark, event("anchor", "bridge_out", "2024-01-15T12:00", link_key="k", chain="ethereum"))
    links = spark.createDataFrame([("k", "0xaaa", "0xaaa", "ethereum")], LINK)
    assert ids(T.trajectory_across(df, links, "bridge_out", D2, D2)) == ["anchor"]


def test_unified_funnel(spark):
    df = events(
        spark,
        event("sess_1", "session_start", "2024-01-15T12:00", chain=None),
        event("pv_1", "pageview", "2024-01-15T12:02", chain=None),
        event("pv_2", "pageview", "2024-01-15T12:05", chain=None),
        event("bridge_1", "bridge_out", "2024-01-15T12:15", link_key="dep_123"),
        event("swap_1", "swap", "2024-01-15T12:25", chain="arbitrum"),
    )
    links = spark.createDataFrame([("dep_123", "0xaaa", "0xaaa", "arbitrum")], LINK)
    steps = funnel.funnel_steps(df, links, ordered=True)
    assert ids(steps) == ["sess_1", "pv_1", "pv_2", "bridge_1", "swap_1"]
    row = funnel.unified_funnel(df, links).collect()[0]
    assert (row.n_steps, row.time_to_bridge, row.time_to_swap, row.converted) == (5, 900.0, 600.0, True)
    none = funnel.unified_funnel(events(spark, event("s", "session_start", "2024-01-15")), links).collect()[0]
    assert (none.time_to_bridge, none.time_to_swap, none.converted) == (None, None, False)
    assert funnel.unified_funnel(events(spark, event("s", "swap", "2024-01-15")), links).count() == 0


def test_stored_events_are_read_from_the_months_of_the_windows(spark, tmp_path):
    months = [f"2024-{m:02d}" for m in range(1, 10)]
    rows = [event(f"e{m}{k}", "swap", f"{m}-{10 + k}T12:00", entity=f"0x{k}") for m in months for k in range(4)]
    rows += [event("a1", "session_start", "2024-03-31T20:00", entity="0x1"), event("a0", "session_start", "2024-07-12T20:00", entity="0x0")]
    rows += [event("far", "swap", "2024-04-01T03:00", entity="0x1")]
    tables.write_table(tables.event_rows(events(spark, *rows)), str(tmp_path / "t"), "canonical_events")
    stored = tables.read_table(spark, str(tmp_path / "t"))
    found = T.trajectory(stored, "session_start", timedelta(days=1), timedelta(hours=12), roots=["0x1"])
    assert [r.event_id for r in found.collect()] == ["a1", "far"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [event_month#" in plan or "PartitionFilters: [isnotnull(event_month" in plan
    assert "2024-03-01, 2024-04-01" in plan or "IN (2024-03-01,2024-04-01)" in plan
    both = T.trajectory(stored, "session_start", timedelta(days=1), timedelta(hours=12)).collect()
    assert sorted(r.event_id for r in both) == ["a0", "a1", "far"]
    assert T.trajectory(stored, "no such", timedelta(days=1), timedelta(days=1)).collect() == []
    whole = T.trajectory(stored.drop("event_month"), "session_start", timedelta(days=1), timedelta(hours=12)).collect()
    assert sorted(r.event_id for r in whole) == ["a0", "a1", "far"]


@pytest.mark.parametrize("include_anchor", [True, False])
@pytest.mark.parametrize("filtered", [False, True])
def test_across_equals_a_search_per_entity(spark, include_anchor, filtered):
    r = random.Random(5)
    who, where = ["0xa", "0xb", "0xc"], ["base", "arb"]
    rows = [
        event(f"e{i}", r.choice(["bridge_out", "swap", "bridge_in"]), f"2024-01-{r.randint(1, 20):02d}T{r.randint(0, 23):02d}:00",
              entity=r.choice(who), chain=r.choice(where), link_key=r.choice(["k1", "k2", "k3", "", None]))
        for i in range(60)
    ]
    rows += rows[:30]  # pulled twice
    pairs = [("k1", "0xa", "0xa", "arb"), ("k2", "0xa", "0xb", "base"), ("k3", "0xb", "0xc", "arb"), ("k1", "0xb", "0xa", "base"), ("k2", "0xc", "0xb", "arb")]
    filters = [Filter("event_type", "!=", "bridge_in")] if filtered else []
    got = T.trajectory_across(events(spark, *rows), spark.createDataFrame(pairs, LINK), "bridge_out", 6 * D2, D2, filters=filters, include_anchor=include_anchor)
    expected = []
    for root in who:
        at = max(e["timestamp"] for e in rows if e["entity_id"] == root and e["event_type"] == "bridge_out")
        near = [e for e in rows if e["entity_id"] == root and at - 6 * D2 <= e["timestamp"] <= at + D2]
        near = [e for e in near if (include_anchor or e["event_type"] != "bridge_out") and not (filtered and e["event_type"] == "bridge_in")]
        expected += [(root, e["event_id"]) for e in near]
        sides = {(p[2], p[3]) for e in near if e["event_type"] == "bridge_out" for p in pairs if p[0] == e["link_key"] and p[1] == root}
        lo, hi = min(e["timestamp"] for e in near), max(e["timestamp"] for e in near)
        far = {e["event_id"] for e in rows if (e["entity_id"], e["chain"]) in sides and lo <= e["timestamp"] <= hi}
        expected += [(root, e) for e in far - {e["event_id"] for e in near}]
    assert sorted((r.query_entity_id, r.event_id) for r in got.collect()) == sorted(expected)


def test_the_near_side_is_written_without_its_events(spark, monkeypatch):
    written = {}

    def seen(df, label):
        written[label] = df.columns
        return materialize(df, label)

    monkeypatch.setattr(T, "materialize", seen)
    df = events(spark, event("a", "bridge_out", "2024-01-15T12:00", link_key="k"), event("b", "swap", "2024-01-15T12:00", entity="0xb"))
    links = spark.createDataFrame([("k", "0xaaa", "0xb", "base")], LINK)
    found = T.trajectory_across(df, links, "bridge_out", D2, D2)
    assert ids(found) == ["a", "b"] and found.columns == ["query_entity_id", "query_entity_type", "anchor_ts", *df.columns]
    assert "event_id" not in written["near-side"]


def test_stored_events_are_followed_across(spark, tmp_path):
    rows = [event("a", "bridge_out", "2024-03-30T12:00", link_key="k"), event("b", "swap", "2024-04-01T11:00")]
    rows += [event(f"f{m}", "swap", f"2024-0{m}-01T08:00", entity="0xb") for m in range(1, 8)]
    tables.write_table(tables.event_rows(events(spark, *rows)), str(tmp_path / "t"), "canonical_events")
    links = spark.createDataFrame([("k", "0xaaa", "0xb", "base")], LINK)
    found = T.trajectory_across(tables.read_table(spark, str(tmp_path / "t")), links, "bridge_out", D2, D2)
    assert ids(found) == ["a", "f4", "b"]
