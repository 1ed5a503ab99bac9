"""Snapshot tables: re-runs, lost jobs, two writers, old versions and pruned reads."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.helpers import at, event, events
from wayline.operators import decode as D
from wayline.plans import ingest
from wayline.sinks import snapshots, tables
from wayline.sources import chain_logs as C

TABLE = "canonical_events"


def batch(spark, numbers, entity="0x1", **more):
    rows = [event(f"e{i}", "swap", f"2024-0{1 + i % 3}-05T12:00", entity=entity, **more) for i in numbers]
    return tables.event_rows(events(spark, *rows))


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def word(v):
    return f"0x{v:064x}"


def landed(spark, ids):
    rows = [("evm_base", "0x" + "dd" * 20, "0x1", "0x2", f"0xt{i}", word(i), [D.TRANSFER, word(7), word(1)], at("2024-01-01T12:10")) for i in ids]
    return spark.createDataFrame(rows, C.LANDED_LOG_SCHEMA)


def test_ingest_twice_leaves_the_same_tables(spark, tmp_path):
    base = str(tmp_path)
    assert ingest.ingest_logs(landed(spark, range(5)), base) == {"raw_logs_ingested": 5, "decoded_events": 5}
    before = snapshots.manifest(spark, f"{base}/{TABLE}")
    assert ingest.ingest_logs(landed(spark, range(5)), base) == {"raw_logs_ingested": 0, "decoded_events": 0}
    assert snapshots.manifest(spark, f"{base}/{TABLE}") == before
    # the lookback of the next run overlaps
    assert ingest.ingest_logs(landed(spark, range(3, 9)), base) == {"raw_logs_ingested": 4, "decoded_events": 4}
    for name in (TABLE, "canonical_logs"):
        assert tables.read_table(spark, f"{base}/{name}").count() == 9


def test_a_lost_job_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert snapshots.insert_new(batch(spark, range(6)), path, TABLE) == 6
    old = snapshots.manifest(spark, path)

    def lost(*_):
        raise RuntimeError("lost before the rename")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", lost)
        for write in (
            lambda: snapshots.insert_new(batch(spark, range(4, 12)), path, TABLE),
            lambda: snapshots.upsert(batch(spark, range(6), entity="0x2"), path, TABLE),
            lambda: snapshots.write_back(spark, path, spark.createDataFrame([("e1", Decimal(1), None)], "event_id string, amount_in_usd decimal(38,6), amount_out_usd decimal(38,6)")),
        ):
            with pytest.raises(RuntimeError):
                write()
            assert snapshots.manifest(spark, path) == old and tables.read_table(spark, path).count() == 6
    assert snapshots.insert_new(batch(spark, range(4, 12)), path, TABLE) == 6
    assert ids(tables.read_table(spark, path)) == sorted(f"e{i}" for i in range(12))
    assert snapshots.expire(spark, path, older_than_seconds=-60) == 3  # what the lost jobs left
    assert tables.read_table(spark, path).count() == 12


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.insert_new(batch(spark, range(3)), path, TABLE)
    commit, turns = snapshots._commit, []

    def second_first(session, p, new):
        if not turns:
            turns.append(1)
            commit(session, p, snapshots.manifest(session, p).__class__(new.version, TABLE, new.schema, new.parts))
        return commit(session, p, new)

    monkeypatch.setattr(snapshots, "_commit", second_first)
    # the other writer took the version with the same rows: they are found and not added again
    assert snapshots.insert_new(batch(spark, range(6)), path, TABLE) == 0
    assert tables.read_table(spark, path).count() == 6
    monkeypatch.setattr(snapshots, "_commit", commit)
    with pytest.raises(snapshots.Conflict):
        snapshots._commit(spark, path, snapshots.manifest(spark, path))


def test_upsert_versions_and_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    for part in (range(0, 4), range(4, 8), range(8, 12)):
        snapshots.insert_new(batch(spark, part), path, TABLE)
    assert snapshots.upsert(batch(spark, [1, 20], entity="0x9"), path, TABLE) == 2
    now = {r.event_id: r.entity_id for r in tables.read_table(spark, path).collect()}
    assert len(now) == 13 and now["e1"] == now["e20"] == "0x9" and now["e2"] == "0x1"
    assert snapshots.read(spark, path, version=3).count() == 12
    assert snapshots.compact(spark, path) > 0
    assert {p.month for p in snapshots.manifest(spark, path).parts} == {"2024-01-01", "2024-02-01", "2024-03-01"}
    assert len(snapshots.manifest(spark, path).parts) == 3 and {r.event_id: r.entity_id for r in tables.read_table(spark, path).collect()} == now
    snapshots.expire(spark, path, keep=1, older_than_seconds=-60)
    assert snapshots.read(spark, path).count() == 13
    assert snapshots._versions(spark, path) == [5]


def test_keys_with_nulls_new_columns_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    none = batch(spark, [])
    assert snapshots.insert_new(none, path, TABLE) == 0 and tables.read_table(spark, path).collect() == []
    untimed = batch(spark, range(2)).withColumns({"timestamp": F.lit(None).cast("timestamp"), "event_id": F.lit(None).cast("string")})
    assert snapshots.insert_new(untimed, path, TABLE) == 1  # one row for each key, null being one
    assert snapshots.insert_new(untimed, path, TABLE) == 0
    assert snapshots.insert_new(batch(spark, range(2)).withColumn("more", F.lit("x")), path, TABLE) == 2
    rows = tables.read_table(spark, path)
    assert sorted(str(r.more) for r in rows.collect()) == ["None", "x", "x"]
    assert snapshots.upsert(none, path, TABLE) == 0 and tables.read_table(spark, path).count() == 3


def test_moved_rows_are_found_anywhere(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.insert_new(batch(spark, [0]), path, TABLE)
    moved = batch(spark, [0]).withColumn("timestamp", F.lit(at("2024-03-09")))
    assert snapshots.insert_new(moved, path, TABLE, anywhere=True) == 0
    assert snapshots.upsert(moved, path, TABLE, anywhere=True) == 1
    assert tables.read_table(spark, path).count() == 1


def test_a_range_lists_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.insert_new(batch(spark, range(9)), path, TABLE)
    found = snapshots.read(spark, path, timestamp=(at("2024-02-01"), at("2024-02-20")))
    assert found.count() == 3 and {f.split("event_month=")[1][:10] for f in found.inputFiles()} == {"2024-02-01"}
    assert snapshots.read(spark, path, timestamp=(at("2025-02-01"), None)).collect() == []
    logs = f"{tmp_path}/l"
    snapshots.insert_new(tables.log_rows(C.normalise_logs(landed(spark, range(3)))), logs, "canonical_logs")
    assert snapshots.read(spark, logs, block_number=(1, 1)).count() == 3 and snapshots.read(spark, logs, block_number=(2, None)).count() == 0
    # logs lie in months of their arrival; the manifest knows their block times too
    times = snapshots.read(spark, logs, block_time=(at("2024-01-01"), at("2024-01-02")))
    assert times.count() == 3 and times.inputFiles() and not snapshots.read(spark, logs, block_time=(at("2024-01-02"), None)).inputFiles()


def test_other_jobs_twice(spark, tmp_path):
    base = str(tmp_path)
    out = events(spark, event("out", "bridge_out", "2024-01-01T12:10", link_key="k", link_key_type="t", chain="base", entity="0xaa"))
    assert snapshots.insert_new(tables.event_rows(out), f"{base}/{TABLE}", TABLE) == 1
    from wayline.operators.links import link_rows, match

    into = events(spark, event("in", "bridge_in", "2024-01-01T12:20", link_key="k", chain="ethereum", entity="0xbb"))
    for _ in range(2):
        assert snapshots.upsert(link_rows(match(out, into)), f"{base}/bridge_links", "bridge_links") == 1
    assert tables.read_table(spark, f"{base}/bridge_links").count() == 1
