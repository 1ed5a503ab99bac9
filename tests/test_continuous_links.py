"""Continuous match: a plain engine over rows in order of time, in any arrival order and batches."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from wayline.operators.links import match
from wayline.streaming import jobs
from wayline.streaming.continuous_links import STATE_STORE, Held, match_continuous


def frame(spark, rows):
    made = spark.createDataFrame([(*r, "u", None, "c", "t", None, None) for r in rows], "is_out boolean, link_key string, m long, event_id string, entity_id string, tx_hash string, chain string, link_key_type string, token_out string, amount_out decimal(38,0)")
    return made.withColumn("timestamp", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("m") * 60)).drop("m")


def brute(rows, max_delay):
    """key → pairs of (out, in); one engine a key, rows in order of time."""
    out, by = [], {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for key, own in by.items():
        pending = early = linked = None
        for is_out, _, m, event in sorted(own, key=lambda r: (r[2], r[3])):
            if pending and pending[0] + max_delay < m:
                out.append((key, pending[1], None))
                pending = None
            if early and early[0] + max_delay < m:
                early = None
            if linked is not None and linked + max_delay < m:
                linked = None
            if is_out:
                pending = (m, event)
            if is_out and early or not is_out and pending:
                out.append((key, pending[1], early[1] if is_out else event))
                pending = early = None
                linked = m
            elif not is_out and linked is None and not early:
                early = (m, event)
        if pending:
            out.append((key, pending[1], None))
    return sorted(out, key=str)


def run(spark, tmp_path, batches, **options):
    """Rows of each batch in a file of its own, read one a trigger; the last closes all."""
    source = str(tmp_path / "in")
    batches = [*batches, [(True, "end", 10_000_000, "end")], [(True, "end", 20_000_000, "end2")]]
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{source}/b={i:03d}")
    schema = spark.read.parquet(f"{source}/b=000").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/b=*")
    found = match_continuous(stream.where("is_out"), stream.where("not is_out"), **options)
    done = jobs.run_available(found, str(tmp_path / "out"), str(tmp_path / "cp"), state_partitions=3, state_store=STATE_STORE)
    return sorted([(r["link_key"], r["src_event_id"], r["dst_event_id"]) for r in done.collect() if r["link_key"] != "end"], key=str)


def test_steps_of_the_engine():
    r = random.Random(1)
    for _ in range(500):
        rows = [(r.random() < 0.5, "k", r.randint(0, 30), f"e{i:02d}") for i in range(r.randint(0, 12))]
        delay, held, found = r.choice([0, 3, 100]), Held(), []
        for is_out, _, m, event in sorted(rows, key=lambda x: (x[2], x[3])):
            found += held.take(is_out, m, event, "u", delay)
        found += held.expire(10_000, delay)
        assert held == Held() and held.next_time(delay) is None
        assert sorted([("k", x[2], x[5]) for x in found], key=str) == brute(rows, delay)


@pytest.mark.parametrize("late", [60, 5])
def test_stream_equals_the_engine(spark, tmp_path, late):
    r = random.Random(late)
    rows = [(r.random() < 0.5, f"k{r.randint(0, 12)}" if r.random() < 0.7 else "hot", r.randint(0, 400), f"e{i:03d}") for i in range(160)]
    # batches overlap by less than the delay of the watermark, so nothing is late and all is out of order
    rows.sort(key=lambda x: x[2] + r.uniform(0, late - 1))
    got = run(spark, tmp_path, [rows[i : i + 40] for i in range(0, 160, 40)], late=timedelta(minutes=late), max_delay=timedelta(minutes=90))
    assert got == brute(rows, 90)


def test_late_rows_are_dropped_and_old_outs_given_out(spark, tmp_path):
    first = [(True, "a", 0, "o1"), (True, "b", 5, "o2"), (True, "a", 20, "o3"), (True, "x", 500, "o4")]
    second = [(False, "b", 8, "late"), (False, "a", 500, "i1"), (False, "x", 520, "i2"), (True, "x", 800, "o5")]
    between = [(True, "x", 501, "o6")]  # Spark drops by the watermark of the batch before
    got = run(spark, tmp_path, [first, between, second], late=timedelta(minutes=10), max_delay=timedelta(minutes=100))
    assert got == sorted([("a", "o3", None), ("b", "o2", None), ("x", "o6", "i2"), ("x", "o5", None)], key=str)


def test_equals_the_batch_match_where_outs_come_first(spark, tmp_path):
    r = random.Random(9)
    outs = [(True, f"k{r.randint(0, 20)}", r.randint(0, 100), f"o{i:02d}") for i in range(50)]
    ins = [(False, f"k{r.randint(0, 25)}", r.randint(101, 200), f"i{i:02d}") for i in range(30)]
    got = run(spark, tmp_path, [outs + ins], max_delay=timedelta(days=30))
    batch = frame(spark, outs + ins)
    links = match(batch.where("is_out"), batch.where("not is_out")).collect()
    assert [x for x in got if x[2]] == sorted([(x.link_key, x.src_event_id, x.dst_event_id) for x in links], key=str)


def test_keys_share_the_calls_to_the_state_store(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.random() < 0.6, f"k{r.randint(0, 40)}", r.randint(0, 300), f"e{i:03d}") for i in range(200)]
    rows.sort(key=lambda x: x[2])
    batches = [rows[:100], rows[100:]]
    got = run(spark, tmp_path, batches, late=timedelta(minutes=5), max_delay=timedelta(minutes=90), groups=2)
    assert got == brute(rows, 90)
