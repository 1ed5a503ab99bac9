from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.helpers import at, event, events
from wayline.functions.scalars import usd_value
from wayline.operators import enrich as E
from wayline.schema import TOKEN_METADATA, TOKEN_PRICES
from wayline.sources import prices as P
from wayline.sources import tokens as TK

USDC = "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48"


def test_usd_value(spark):
    cases = [
        ("1500000000000000000", "0xc0", 18, "3500", "5250"),
        ("1500000", USDC, 6, "1.00", "1.5"),
        ("1500000", USDC.upper().replace("0X", "0x"), 6, "0.99", "1.5"),
        ("1500000", USDC, None, None, "1.5"),
        ("1500000", USDC, 0, None, "1.5"),
        ("1500000000000000000", "0xunknown", 18, None, None),
        ("5", "0xc0", None, "1", None),
        (None, "0xaaa", 18, "1.00", None),
        ("300000000000", "0xc0", 18, "3500", "0.00105"),
        ("15", "0xc0", 0, "2.5", "37.5"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r string, t string, d int, p string, e string")
    value = usd_value(F.col("r").cast("decimal(38,0)"), F.col("t"), F.col("d"), F.col("p").cast("decimal(38,18)"))
    for row in df.withColumn("usd", value).collect():
        assert row.usd == (None if row.e is None else Decimal(row.e)), row


def _tables(spark):
    metadata = spark.createDataFrame(
        [("0xt", "base", "T", 9, "old", at("2020-01-01")), ("0xt", "base", "T", 2, "new", at("2021-01-01"))], TOKEN_METADATA
    )
    price = [("2024-01-01T10:00", "1", "2024-01-01"), ("2024-01-01T12:00", "3", "2024-01-01"), ("2024-01-01T12:00", "2", "2024-01-02")]
    prices = spark.createDataFrame(
        [("0xt", "base", at(t), Decimal(p), "s", None, at(i)) for t, p, i in price], TOKEN_PRICES
    )
    return metadata, prices


def test_enrichment(spark):
    metadata, prices = _tables(spark)
    df = events(
        spark,
        event("early", "swap", "2024-01-01T09:00", token_in="0xt", amount_in=100),
        event("between", "swap", "2024-01-01T11:00", token_in="0xt", amount_in=150, token_out=USDC, amount_out=2_000_000),
        event("tie", "swap", "2024-01-01T12:00", token_out="0xt", amount_out=100),
        event("no_token", "swap", "2024-01-01T12:00", amount_in=100),
        event("done", "swap", "2024-01-01T12:00", token_in="0xt", amount_in=100, amount_in_usd=9),
        event("none", "swap", "2024-01-01T12:00"),
        event("outside", "swap", "2024-01-03T12:00", token_in="0xt", amount_in=100),
    )
    start, end = at("2024-01-01"), at("2024-01-02")
    pending = E.pending_events(df, start, end)
    assert sorted(r.event_id for r in pending.collect()) == ["between", "early", "no_token", "tie"]
    assert E.pending_events(df, start, end, limit=2).count() == 2
    updates = E.enrichment_updates(pending, metadata, prices)
    rows = {r.event_id: (r.amount_in_usd, r.amount_out_usd) for r in updates.collect()}
    # at the event's own time the newest inserted price counts; before the first price there is none
    assert rows == {"between": (Decimal("1.5"), Decimal(2)), "tie": (None, Decimal(2))}
    filled = {r.event_id: r for r in E.apply_updates(df, updates).collect()}
    assert filled["between"].amount_in_usd == Decimal("1.5") and filled["done"].amount_in_usd == 9
    again = E.pending_events(E.apply_updates(df, updates), start, end)
    assert "tie" in [r.event_id for r in again.collect()]
    settled = E.pending_events(E.apply_updates(df, updates), start, end, pending="any")
    assert "tie" not in [r.event_id for r in settled.collect()]
    row = E.coverage(E.apply_updates(df, updates), end=end).collect()[0]
    assert (row.total, row.enriched, row.pending, row.rate) == (4, 2, 2, 0.5)
    empty = E.coverage(df, end=at("2000-01-01")).collect()[0]
    assert (empty.total, empty.rate) == (0, 0.0)
    trailing = E.enrich_window(df, metadata, prices, end=at("2024-01-01T12:00"), window=timedelta(minutes=30))
    assert [r.event_id for r in trailing.collect()] == ["tie"]
    with pytest.raises(ValueError):
        E.pending_events(df, start, end, pending="both")


def test_price_payload(spark):
    body = '{"0xaaa": {"usd": 3500.0, "usd_24h_vol": 1000000.0}, "0xbbb": {"usd": 1.0}, "0xccc": {}}'
    payloads = spark.createDataFrame([("base", datetime(2024, 1, 1), body), ("nowhere", datetime(2024, 1, 1), body), ("base", datetime(2024, 1, 2), "{}")], P.PAYLOAD_SCHEMA)
    wanted = spark.createDataFrame([("base", "0xAAA"), ("base", "0xbbb"), ("base", "0xccc"), ("nowhere", "0xaaa")], "chain string, token_address string")
    rows = {r.token_address: (r.price_usd, r.volume_24h_usd) for r in P.price_rows(payloads, wanted).collect()}
    assert rows == {"0xAAA": (Decimal(3500), Decimal(1000000)), "0xbbb": (Decimal(1), None)}
    assert P.price_rows(payloads, wanted.where("false")).count() == 0


def test_token_dimension(spark):
    assert TK.known_tokens(spark).count() == 13
    metadata, _ = _tables(spark)
    assert [(r.decimals, r.name) for r in TK.latest_metadata(metadata).collect()] == [(2, "new")]


def test_legs_meet_their_metadata_once(spark):
    legs = spark.range(3).selectExpr(
        "id", "'c' AS chain", "element_at(array('known', 'unknown', '0xA0b86991c6218b36c1d19d4a2e9eb0ce3606eb48'), int(id) + 1) AS token_address",
        "timestamp'2024-01-02' AS timestamp", "CAST(5000000 AS DECIMAL(38,0)) AS amount",
    )
    metadata = spark.sql("SELECT 'known' AS token_address, 'c' AS chain, 's' AS symbol, 6 AS decimals, 'n' AS name, timestamp'2024-01-01' AS inserted_at")
    prices = spark.sql("SELECT explode(array('known', 'unknown')) AS token_address, 'c' AS chain, timestamp'2024-01-01' AS timestamp, 2 AS price_usd, timestamp'2024-01-01' AS inserted_at")
    priced = E.price_legs(legs, metadata, prices)
    assert [(r.price_ts is None, r.amount_usd) for r in priced.orderBy("id").collect()] == [(False, 10), (True, None), (True, 5)]
    # stablecoins look up a few broadcast rows, so their legs are not shuffled a second time
    assert "strategy=broadcast" in priced._jdf.queryExecution().analyzed().toString()


def test_metadata_of_both_sides(spark):
    usdc = "0xA0b86991c6218b36c1d19d4a2e9eb0ce3606eb48"
    events = spark.createDataFrame(
        [(1, "c", "known", None), (2, "c", usdc, "known"), (3, "c", "unknown", usdc), (4, "d", "known", usdc), (5, None, None, "unknown")],
        "id int, chain string, token_in string, token_out string",
    )
    metadata = spark.sql(
        f"SELECT t.*, 's' AS symbol, 'n' AS name, timestamp'2024-01-01' AS inserted_at FROM VALUES ('known', 'c', 6), ('{usdc}', 'c', 7) AS t(token_address, chain, decimals)"
    )
    rows = E.with_metadata(events, metadata)
    assert rows.columns == [*events.columns, "decimals_in", "decimals_out"]
    found = [(r.id, r.decimals_in, r.decimals_out) for r in rows.orderBy("id").collect()]
    assert found == [(1, 6, None), (2, 7, 6), (3, None, 7), (4, None, None), (5, None, None)]
    # stablecoins and missing tokens look up a few broadcast rows, so their events are not shuffled
    assert "strategy=broadcast" in rows._jdf.queryExecution().analyzed().toString()


def test_legs_are_shuffled_once_for_price_and_metadata(spark):
    df = events(spark, event("a", "swap", "2024-01-01T12:00", token_in="0xt", amount_in=150), event("b", "swap", "2024-01-01T13:00", token_in="0xu", amount_in=150))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        priced = E.price_legs(E.token_legs(df), *_tables(spark))
        plan = priced._jdf.queryExecution().executedPlan().toString()
        assert [(r.event_id, r.decimals, r.price_usd) for r in priced.orderBy("event_id").collect()] == [("a", 2, 2), ("b", None, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_updates_keep_ids_as_bytes(spark):
    df = events(spark, event("00ff", "swap", "2024-01-01T12:00", token_in="0xt", amount_in=150)).withColumn("event_id", F.unhex("event_id"))
    updates = E.enrichment_updates(df, *_tables(spark))
    assert [bytes(r.event_id) for r in updates.collect()] == [b"\x00\xff"]
    assert [r.amount_in_usd for r in E.apply_updates(df, updates).collect()] == [3]
