import random
from datetime import datetime, timedelta

import pytest

from wayline.operators import asof
from wayline.operators.asof import asof_join, running_offset
from wayline.session import materialize

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("slice_rows", [10**6, 900, 7])
@pytest.mark.parametrize("tolerance", [None, timedelta(minutes=5)])
def test_every_row_finds_the_latest_match(spark, slice_rows, tolerance):
    rng = random.Random(3)
    keys = ["a", "a", "a", "b", None]

    def moment():
        return T0 + timedelta(minutes=rng.randint(0, 3000))

    left = [(i, rng.choice(keys), moment()) for i in range(2000)]
    left += [(5000, "a", T0 + timedelta(hours=1))] * 50  # identical copies
    right = [(rng.choice(["a", "b", "c"]), moment(), rng.randint(0, 9), float(rng.randint(1, 1000))) for _ in range(300)]
    joined = asof_join(
        spark.createDataFrame(left, "id int, k string, t timestamp"),
        spark.createDataFrame(right, "k string, pt timestamp, ins int, p double"),
        ["k"], "t", "pt", ["p"], newest_by="ins", slice_rows=slice_rows, tolerance=tolerance,
    ).collect()
    expected = []
    for i, k, t in left:
        before = [(pt, ins, p) for key, pt, ins, p in right if key == k and pt <= t]
        best = max(before) if before else None
        ok = best and (tolerance is None or t - best[0] <= tolerance)
        expected.append((i, best[0] if ok else None, best[2] if ok else None))
    assert sorted(((r.id, r.pt, r.p) for r in joined), key=str) == sorted(expected, key=str)


def test_running_offset(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), i, rng.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, pos int, n int")
    for r in running_offset(df, ["g"], "pos", "n", "before", block=7).collect():
        assert r.before == sum(n for g, p, n in rows if g == r.g and p < r.pos)


@pytest.mark.parametrize("slice_rows", [10**6, 900, 7])
def test_facts_of_a_key_reach_all_its_rows(spark, slice_rows):
    rng = random.Random(6)
    left = [(i, rng.choice(["a", "a", "a", "b", "c", None]), T0 + timedelta(minutes=rng.randint(0, 3000))) for i in range(2000)]
    left += [(2000 + i, k, None) for i, k in enumerate(["a", "b", None])]
    right = [(rng.choice(["a", "b"]), T0 + timedelta(minutes=rng.randint(0, 3000)), float(i)) for i in range(200)]
    facts = spark.createDataFrame([("a", 1, "x"), ("c", None, "z"), ("d", 4, "w"), (None, 5, "n")], "k string, n int, s string")
    args = [spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, pt timestamp, p double"), ["k"], "t", "pt", ["p"]]
    rows = asof_join(*args, slice_rows=slice_rows, facts=facts).collect()
    told = {"a": (1, "x"), "c": (None, "z")}
    assert {(r.id, r.n, r.s) for r in rows} == {(i, *told.get(k, (None, None))) for i, k, _ in left} and len(rows) == len(left)
    plain = asof_join(*args, slice_rows=slice_rows).collect()
    assert {(r.id, r.pt, r.p) for r in rows} == {(r.id, r.pt, r.p) for r in plain}


def test_keys_are_counted_by_cell_first(spark, monkeypatch):
    written = []
    monkeypatch.setattr(asof, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    left = spark.range(100).selectExpr("id", "id % 3 AS k", "timestamp_seconds(id) AS t")
    right = spark.range(100).selectExpr("id % 3 AS k", "timestamp_seconds(id) AS pt", "id AS p")
    assert asof_join(left, right, ["k"], "t", "pt", ["p"]).count() == 100 and written == []
    assert asof_join(left, right, ["k"], "t", "pt", ["p"], slice_rows=50).count() == 100 and written == ["asof-crowded", "asof-grid"]
