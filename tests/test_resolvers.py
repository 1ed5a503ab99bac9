"""Resolvers of intervals against a plain search; overlaps, removals and upgrades in one block."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from tests.helpers import at
from wayline.operators import identity as G
from wayline.operators import resolvers as R

DAY0 = at("2024-01-01")


def hours(n):
    return None if n is None else DAY0 + timedelta(hours=n)


def brute(intervals, entity, t):
    """intervals: (account, wallet, from, to); the one that began last, if it still holds."""
    begun = [x for x in intervals if x[0] == entity and x[2] <= t]
    if not begun:
        return None
    _, wallet, since, until = max(begun, key=lambda x: (x[2], x[1]))
    return wallet if until is None or t < until else None


def test_overlapping_intervals_against_a_search(spark):
    r = random.Random(2)
    rows, used = [], set()
    for i in range(120):
        account, since = f"a{r.randint(0, 5)}", r.randint(0, 200)
        if (account, since) not in used:
            used.add((account, since))
            rows.append((account, f"0xw{i:03d}", since, r.choice([None, since + r.randint(1, 60)])))
    landed = spark.createDataFrame([(a, w, hours(s), hours(u)) for a, w, s, u in rows], "account_id string, address string, verified_at timestamp, removed_at timestamp")
    intervals = R.account_wallets(landed)
    assert intervals.columns == R.INTERVALS
    asked = [(i, "farcaster", f"a{r.randint(0, 7)}", r.randint(-5, 280)) for i in range(300)]
    events = spark.createDataFrame([(i, t, e, hours(h)) for i, t, e, h in asked], "id int, entity_type string, entity_id string, timestamp timestamp")
    got = {x.id: x.to_entity for x in R.resolve_as_of(events, intervals).collect()}
    assert got == {i: brute(rows, e, h) for i, _, e, h in asked} and len(set(got.values())) > 30
    for h in (0, 77, 150):
        mapping = {x.entity_id: x.to_entity for x in R.mapping_at(intervals, hours(h)).collect()}
        assert mapping == {e: w for e in {x[0] for x in rows} if (w := brute(rows, e, h))}


def test_proxies_by_block(spark):
    rows = [("base", "0xP", "0xI1", 10, 0), ("base", "0xP", "0xI2", 20, 1), ("base", "0xP", "0xI3", 20, 2), ("arb", "0xP", "0xJ", 15, 0), ("base", "0xQ", None, 5, 0), ("base", "0xQ", "", 6, 0)]
    intervals = R.proxy_implementations(spark.createDataFrame(rows, "chain string, proxy string, implementation string, block_number long, log_index int"))
    calls = [(9, "base:0xp"), (10, "base:0xp"), (19, "base:0xp"), (20, "base:0xp"), (99, "arb:0xp"), (99, "base:0xnone")]
    frame = spark.createDataFrame([("contract", c, b) for b, c in calls], "entity_type string, entity_id string, block long").withColumn("at", R.at_block("block"))
    got = {(x.block, x.entity_id): x.to_entity for x in R.resolve_as_of(frame, intervals, "at").collect()}
    assert got == {(9, "base:0xp"): None, (10, "base:0xp"): "base:0xi1", (19, "base:0xp"): "base:0xi1", (20, "base:0xp"): "base:0xi3", (99, "arb:0xp"): "arb:0xj", (99, "base:0xnone"): None}


def test_clients_in_a_batch_resolution(spark):
    logins = spark.createDataFrame([("c1", "0xA", hours(1)), ("c1", "0xB", hours(5)), ("c2", "0xC", hours(2)), ("", "0xD", hours(1)), ("c3", None, hours(1))], "client_id string, wallet string, timestamp timestamp")
    intervals = R.client_wallets(logins)
    entities = spark.createDataFrame([("client_id", "c1"), ("client_id", "c2"), ("client_id", "c3")], "entity_type string, entity_id string")
    early = {x.from_entity: (x.to_entity, x.relationship_type) for x in G.resolve_batch(entities, [R.mapping_at(intervals, hours(3))]).collect()}
    late = {x.from_entity: x.to_entity for x in G.resolve_batch(entities, [R.mapping_at(intervals, F.lit(hours(9)))]).collect()}
    assert early == {"c1": ("0xa", "logged_in_as"), "c2": ("0xc", "logged_in_as")} and late == {"c1": "0xb", "c2": "0xc"}
    assert R.mapping_at(intervals, hours(0)).collect() == []
