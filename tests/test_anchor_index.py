"""The maintained anchor index equals the index built at once, whatever the batches."""

import random
from datetime import timedelta

import pytest

from tests.helpers import event, events
from wayline.operators.trajectory import trajectory_index
from wayline.sinks import snapshots, tables
from wayline.streaming.anchor_index import AnchorIndex, maintain

SPAN = timedelta(hours=6)


def rows_of(seed, n):
    r = random.Random(seed)
    kinds = ["start", "swap", "swap", "view"]
    return [event(f"e{i:03d}", r.choice(kinds), f"2024-0{r.randint(1, 2)}-0{r.randint(1, 3)}T{r.randint(0, 23):02d}:00", entity=f"0x{r.randint(0, 7)}") for i in range(n)]


def found(df):
    return sorted(tuple(x) for x in df.collect())


def test_batches_equal_one_build(spark, tmp_path):
    rows = rows_of(3, 60)
    index = AnchorIndex(str(tmp_path), "start", SPAN, SPAN)
    # a batch of one entity writes that entity's rows only; one batch comes again, one has nothing new
    parts = [rows[:25], rows[25:50], [x for x in rows[50:] if x["entity_id"] == "0x1"], rows[50:], rows[:5]]
    for number, part in enumerate(parts):
        batch = tables.event_rows(events(spark, *part))
        index.update(batch, number)
        if number == 1:
            before = snapshots.manifest(spark, index.index)
            index.update(batch, number)
            assert snapshots.manifest(spark, index.index) == before
        seen = [x for p in parts[: number + 1] for x in p]
        whole = tables.event_rows(events(spark, *{x["event_id"]: x for x in seen}.values()))
        assert found(index.read(spark)) == found(trajectory_index(whole, "start", SPAN, SPAN))
    last = snapshots.read(spark, index.index, batch=(2, 2))
    assert {x["entity_id"] for x in last.collect()} == {x["entity_id"] for x in parts[2]}
    want = found(index.read(spark))
    index.compact(spark)
    assert found(index.read(spark)) == want and len(snapshots.manifest(spark, index.index).parts) == 1


def test_a_lost_batch_is_run_again(spark, tmp_path, monkeypatch):
    rows = rows_of(5, 30)
    index = AnchorIndex(str(tmp_path), "start", SPAN, SPAN)
    index.update(tables.event_rows(events(spark, *rows[:15])), 0)
    want = found(index.read(spark))
    with monkeypatch.context() as m:
        m.setattr(snapshots, "rewrite", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.update(tables.event_rows(events(spark, *rows[15:])), 1)
    assert found(index.read(spark)) == want
    index.update(tables.event_rows(events(spark, *rows[15:])), 1)
    assert found(index.read(spark)) == found(trajectory_index(tables.event_rows(events(spark, *rows)), "start", SPAN, SPAN))


def test_a_stream_keeps_the_index(spark, tmp_path):
    rows = rows_of(8, 24)
    for i in range(3):
        tables.event_rows(events(spark, *rows[i::3])).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    schema = spark.read.parquet(f"{tmp_path}/in/b=0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*")
    index = AnchorIndex(str(tmp_path / "base"), "start", SPAN, SPAN)
    maintain(stream, index, str(tmp_path / "cp"))
    assert found(index.read(spark)) == found(trajectory_index(tables.event_rows(events(spark, *rows)), "start", SPAN, SPAN))
