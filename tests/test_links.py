from datetime import datetime, timedelta

from tests.helpers import event, events
from wayline.operators import links as L


def out(event_id, key, ts, **more):
    return event(event_id, "bridge_out", ts, link_key=key, **more)


def into(event_id, key, ts, **more):
    return event(event_id, "bridge_in", ts, link_key=key, chain="ethereum", entity="0xdef", **more)


def test_last_out_and_first_in_of_a_key(spark):
    outs = events(
        spark,
        out("o1", "k1", "2024-01-01T12:00", link_key_type="across_deposit_id", amount_out=1000, token_out="0xt"),
        out("o2", "k1", "2024-01-01T13:00", amount_out=7),
        out("o3", "k2", "2024-01-01T12:00"),
        out("o4", None, "2024-01-01T12:00"),
        out("o5", "", "2024-01-01T12:00"),
        out("o6", "k3", "2024-01-05T12:00"),
    )
    ins = events(
        spark,
        into("i2", "k1", "2024-01-01T12:30"),
        into("i1", "k1", "2024-01-01T12:05"),
        into("i3", "k3", "2024-01-01T12:00"),
        into("i4", "k9", "2024-01-01T12:00"),
    )
    rows = {r.link_key: r for r in L.match(outs, ins).collect()}
    assert sorted(rows) == ["k1", "k3"]
    k1 = rows["k1"]
    assert (k1.src_event_id, k1.dst_event_id, k1.amount, k1.link_key_type) == ("o2", "i1", 7, "unknown")
    assert (k1.dst_chain, k1.dst_entity_id) == ("ethereum", "0xdef")
    assert [r.link_key for r in L.pending(outs, ins).collect()] == ["k2"]
    stats = L.link_stats(L.reconcile(outs, ins)).collect()[0]
    assert (stats.pending, stats.completed) == (1, 2)
    stored = L.link_rows(L.match(outs, ins), datetime(2024, 1, 1)).collect()
    assert all(r.link_confidence == 1.0 and r.amount_usd is None for r in stored)


def test_strict_match_uses_each_out_once(spark):
    outs = events(
        spark,
        out("o1", "101", "2024-01-01T12:00", link_key_type="t"),
        out("o2", "101", "2024-01-01T13:00", link_key_type="t"),
        out("o3", "101", "2024-01-01T12:00", link_key_type="other"),
    )
    ins = events(
        spark,
        into("i0", "101", "2024-01-01T11:00", link_key_type="t"),
        into("i1", "101", "2024-01-01T12:10", link_key_type="t"),
        into("i2", "101", "2024-01-01T12:20", link_key_type="t"),
        into("i3", "101", "2024-01-01T13:10", link_key_type="t"),
        into("i4", "101", "2024-01-03T13:10", link_key_type="other"),
    )
    rows = L.match_strict(outs, ins, max_delay=timedelta(hours=2)).collect()
    assert sorted((r.src_event_id, r.dst_event_id) for r in rows) == [("o1", "i1"), ("o2", "i3")]


def test_sample_limits_before_the_shuffle(spark):
    outs = events(spark, *[out(f"o{i}", f"k{i}", "2024-01-01T12:00", link_key_type="t") for i in range(80)])
    ins = events(spark, *[into(f"i{i}", f"k{i}", "2024-01-01T12:00") for i in range(80)])
    sample = L.sample_links(L.match(outs, ins))
    assert sample.count() == 50
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()


def test_only_wanted_columns_of_the_sides(spark):
    outs, ins = events(spark, out("o1", "k1", "2024-01-01T12:00")), events(spark, into("i1", "k1", "2024-01-01T12:30"))
    links = L.match(outs, ins, columns=["src_entity_id", "dst_entity_id"])
    assert links.columns == ["link_key", "src_entity_id", "dst_entity_id"]
    assert [tuple(r) for r in links.collect()] == [("k1", "0xaaa", "0xdef")]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert not any("tx_hash" in line for line in plan.splitlines() if "Aggregate" in line)
    assert [r.link_key for r in L.pending(outs, ins, columns=["src_event_id"]).collect()] == []
