from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tests.helpers import at, event, events
from wayline.operators import registry as R
from wayline.plans import ingest
from wayline.schema import TOKEN_METADATA, TOKEN_PRICES, from_storage_nulls
from wayline.sinks import tables
from wayline.sources import chain_logs as C
from wayline.operators import decode as D
from wayline.streaming import jobs


def test_storage_rules(spark):
    df = events(spark, event("e", "swap", "2024-01-01", protocol="", extra="{bad", chain=None), event("f", "swap", "2024-01-01", extra='{"a": 1}'))
    stored = {r.event_id: r for r in tables.event_rows(df).collect()}
    assert stored["e"].chain == "" and stored["e"].venue == "" and stored["e"].token_in is None
    read = {r.event_id: r for r in from_storage_nulls(tables.event_rows(df)).collect()}
    assert read["e"].chain is None and read["e"].protocol is None and read["e"].extra is None
    assert read["f"].extra == '{"a": 1}' and read["f"].chain == "base"
    bare = tables.event_rows(events(spark, event("g", "swap", "2024-01-01"))).collect()[0]
    assert bare.extra == "{}"


def test_layout_and_write_back(spark, tmp_path):
    path, staging = str(tmp_path / "events"), str(tmp_path / "staging")
    rows = [event(f"e{i}", "swap", f"2024-0{1 + i % 3}-05T12:00", entity=f"0x{i % 5}", amount_in=100) for i in range(60)]
    assert tables.write_table(tables.event_rows(events(spark, *rows)), path, "canonical_events") == 60
    stored = tables.read_table(spark, path)
    pruned = tables.month_between(stored, "canonical_events", at("2024-02-01"), at("2024-02-20"))
    assert pruned.count() == 20
    assert "PartitionFilters: [isnotnull(event_month" in pruned._jdf.queryExecution().executedPlan().toString()
    updates = spark.createDataFrame([(Decimal(5), None, "e0"), (Decimal(6), None, "e3")], "amount_in_usd decimal(38,6), amount_out_usd decimal(38,6), event_id string")
    assert tables.write_back(spark, path, updates, staging) == 2
    after = tables.read_table(spark, path)
    assert after.count() == 60
    assert {r.event_id: r.amount_in_usd for r in after.where("amount_in_usd is not null").collect()} == {"e0": 5, "e3": 6}
    spark.catalog.clearCache()


def test_ingest_link_and_price_jobs(spark, tmp_path):
    def w(v):
        return f"{v:064x}"

    user = "0x" + "aa" * 20
    landed = spark.createDataFrame(
        [
            ("evm_base", "0x" + "cc" * 20, "0x1", "0x0", "0xt1", "0x" + w(700) + w(64) + w(0), [D.BASE_ETH_BRIDGE, "0x" + w(int(user, 16)), "0x" + w(1)], at("2024-01-01T12:00")),
            ("evm_base", "0x" + "dd" * 20, "0x1", "0x1", "0xt2", "0x" + w(100), [D.TRANSFER, "0x" + w(int(user, 16)), "0x" + w(1)], at("2024-01-01T12:10")),
            ("evm_base", "0x" + "dd" * 20, "0x1", "0x2", "0xt3", "0x", ["0x99"], at("2024-01-01T12:10")),
        ],
        C.LANDED_LOG_SCHEMA,
    )
    base = str(tmp_path)
    assert ingest.ingest_logs(landed, base) == {"raw_logs_ingested": 3, "decoded_events": 2}
    arrivals = events(spark, event("in", "bridge_in", "2024-01-01T12:20", link_key="0xt1:eth", chain="ethereum", entity="0xbb"))
    logs = tables.read_table(spark, f"{base}/canonical_logs")
    assert ingest.link_transfers(logs, arrivals, base, at("2024-01-01T12:25")) == 1
    token = "0x" + "dd" * 20
    metadata = spark.createDataFrame([(token, "base", "D", 2, "d", at("2020-01-01"))], TOKEN_METADATA)
    prices = spark.createDataFrame([(token, "base", at("2024-01-01"), Decimal(3), "s", None, at("2024-01-01"))], TOKEN_PRICES)
    assert ingest.price_events(base, metadata, prices, at("2024-01-01T12:30")) == 1
    priced = tables.read_table(spark, f"{base}/canonical_events").where("amount_out_usd is not null").collect()
    assert [(r.tx_hash, r.amount_out_usd) for r in priced] == [("0xt2", 3)]


def test_registry(spark):
    registry = R.registry_frame(spark)
    rows = {r.event_type: r for r in registry.collect()}
    assert len(rows) == 25 and rows["swap"].category == "transaction" and "token_in" in rows["swap"].required
    extended = R.registry_frame(spark, R.EVENT_TYPES | {"custom_event": R.EventType("product", ("action",))})
    df = events(
        spark,
        event("a", "swap", "2024-01-01", token_in="0xt", amount_in=1, extra='{"token_out": "0xu"}'),
        event("b", "approval", "2024-01-01"),
        event("c", "custom_event", "2024-01-01", extra='{"action": "x"}'),
    )
    plain = {r.event_id: r for r in R.validate(df, registry).collect()}
    assert (plain["a"].is_valid, plain["b"].is_valid, plain["c"].is_valid) == (True, False, False)
    assert plain["a"].missing == ["amount_out"] and plain["b"].missing is None
    more = {r.event_id: r for r in R.validate(df, extended).collect()}
    assert more["c"].is_valid and more["c"].missing == [] and more["c"].registry_category == "product"


def test_streams(spark, tmp_path):
    schema = "event_id string, event_type string, timestamp timestamp, link_key string, entity_id string"
    rows = [("a", "x", at("2024-01-01T10:10")), ("a", "x", at("2024-01-01T10:10")), ("b", "x", at("2024-01-01T10:50")), ("c", "x", at("2024-01-01T14:00"))]
    source = str(tmp_path / "in")
    spark.createDataFrame([(*r, "k" + r[0], "u") for r in rows], schema).coalesce(1).write.parquet(source)

    def stream():
        return spark.readStream.schema(schema).parquet(source)

    def run(frame, name):
        return jobs.run_available(frame, str(tmp_path / name), str(tmp_path / f"{name}-cp")).collect()

    assert sorted(r.event_id for r in run(jobs.deduplicate_stream(stream()), "dedup")) == ["a", "b", "c"]
    hours = run(jobs.hourly_counts_stream(stream(), ["event_type"]), "hourly")
    assert [(r.hour, r.n_events) for r in hours] == [(at("2024-01-01T10:00"), 3)]
    ins = stream().where(F.col("event_id") == "b").withColumn("event_id", F.lit("in"))
    links = run(jobs.match_stream(stream(), ins, max_delay=timedelta(hours=1)), "links")
    assert {(r.src_event_id, r.dst_event_id) for r in links if r.dst_event_id} == {("b", "in")}
