"""Held-out accuracy of the quality classifier, recall of the forest, and their odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import embeddings_forest, ordinal_quality

NEUTRAL = [f"word{i}" for i in range(300)]


def graded(seed, n):
    """Texts of neutral words; poor ones have words in symbols, bad ones a word of a small list."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        grade = r.choice([0, 1, 2, 2])
        words = r.choices(NEUTRAL, k=r.randint(30, 200))
        if grade == 0:
            words[r.randrange(len(words))] = r.choice(["awful", "nasty", "vile"])
        if grade == 1:
            words = [w + r.choice(["", "", "#"]) for w in words]
        rows.append((i, " ".join(words), grade))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = graded(1, 900)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, grade string, latent int")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(5, None), (99_999, 2)], "doc_id long, grade int")
    return ordinal_quality.train(docs, ratings)


def test_held_out_accuracy(spark, model):
    rows = graded(2, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ordinal_quality.score(docs, model, tail=2).collect()}
    good = [(got[i]["tail_probability"] >= 0.5) == (g == 2) for i, _, g in rows]
    mean = [np.mean([got[i]["expected_grade"] for i, _, g in rows if g == grade]) for grade in range(3)]
    assert np.mean(good) > 0.95 and mean[0] < mean[1] < mean[2] - 0.3
    assert model.thresholds[0] < model.thresholds[1]


def test_odd_rows_are_scored(spark, model):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "vile " * 40_000), (2, "word1"), (2, "word1")], "doc_id long, text string")
    got = ordinal_quality.score(docs, model, tail=1).collect()
    assert len(got) == 5 and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    assert ordinal_quality.score(docs.limit(0), model, tail=1).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"a{i % 3} b") for i in range(60)], "doc_id long, text string")
    ratings = docs.selectExpr("doc_id", "doc_id % 2 AS grade")
    fit = ordinal_quality.Fit(max_rows=20)
    assert ordinal_quality._sample(docs, ratings, "doc_id", "text", "grade", fit).count() == 20


def test_few_grades_have_defined_results(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = ordinal_quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert {tuple(r)[2:] for r in ordinal_quality.score(docs, none, tail=1).collect()} == {(None, None)}
    one = ordinal_quality.train(docs, spark.createDataFrame([(1, 3)], "doc_id long, grade int"))
    assert {tuple(r)[2:] for r in ordinal_quality.score(docs, one, tail=3).collect()} == {(3.0, 1.0)}
    assert {r["tail_probability"] for r in ordinal_quality.score(docs, one, tail=4).collect()} == {0.0}


def test_grades_count_by_rank(spark, model):
    """Grades below 0 and with gaps give the same thresholds, and means on their own scale."""
    rows = graded(1, 900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    odd = ordinal_quality.train(docs, spark.createDataFrame([(i, [-5, 0, 7][g]) for i, _, g in rows], "doc_id long, grade int"))
    assert odd.grades == (-5, 0, 7) and np.allclose(odd.thresholds, model.thresholds)
    same = {r["doc_id"]: r["tail_probability"] for r in ordinal_quality.score(docs, model, tail=2).collect()}
    for r in ordinal_quality.score(docs, odd, tail=7).collect():
        assert r["tail_probability"] == pytest.approx(same[r["doc_id"]]) and -5 <= r["expected_grade"] <= 7


def exact(rows, k):
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            near = sorted((math.dist(v, w), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [i for _, i in near[:k]]
    return out


@pytest.mark.parametrize("block_vectors", [embeddings_forest.BLOCK_VECTORS, 1000])
def test_recall_against_brute_force(spark, block_vectors):
    r = np.random.default_rng(4)
    x = r.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for row in embeddings_forest.nearest(frame, F.col("vec_id") % 100 == 0, block_vectors=block_vectors).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    want = exact(rows, 10)
    assert got.keys() == want.keys() and all(sorted(v) == list(range(1, 11)) for v in got.values())
    recall = np.mean([len({i for i, _ in got[q].values()} & set(want[q])) / 10 for q in want])
    assert recall >= 0.9
    for q, found in got.items():
        for i, score in found.values():
            assert score == pytest.approx(math.dist(x[q], x[i]), abs=1e-12)


def test_ties_odd_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [0.0, 1.0]), (100, [0.0, 0.0]), (200, None), (7, [nan, 1.0]), (8, [inf, 1.0])]
    rows += [(9, [None, 1.0]), (300, [1.0, 2.0, 3.0]), (400, []), (None, [1.0, 1.0]), (5, [0.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in embeddings_forest.nearest(frame, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 5, math.sqrt(2))]
    assert embeddings_forest.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_many_equal_vectors_are_all_candidates(spark):
    rows = [(i, [0.6, 0.8]) for i in range(500)] + [(1000 + i, [1.0, float(i)]) for i in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embeddings_forest.nearest(frame, F.col("vec_id") == 100).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10)) and {r["score"] for r in got} == {0.0}


def test_the_ascent_gathers_what_it_is_asked_for():
    x = np.random.default_rng(1).standard_normal((300, 8))
    forest = embeddings_forest.Forest(x, trees=4)
    for wanted in (1, 50, 300, 1000):
        all_kept = forest.candidates(x[:20], np.full(20, wanted), np.full(20, 1000))
        assert min(map(len, all_kept)) >= min(wanted, 300)
        few = forest.candidates(x[:20], np.full(20, wanted), np.full(20, 5))
        assert all(len(c) == min(5, len(w)) and set(c) <= set(w) for c, w in zip(few, all_kept))


@pytest.mark.parametrize("n", [100, 500, 10_000, 50_000])
def test_recall_at_every_size_without_a_switch(n):
    """Vectors without structure, through the forest alone, a tenth measured."""
    r = np.random.default_rng(n)
    x = r.standard_normal((n, 64))
    recalls = []
    for block in np.array_split(np.arange(n), max(1, n // embeddings_forest.BLOCK_VECTORS)):
        own, asked = x[block], x[:: max(1, n // 40)]
        forest = embeddings_forest.Forest(own)
        wanted, kept = (np.full(len(asked), embeddings_forest.part_of(len(own), p, 10)) for p in (embeddings_forest.GATHERED, embeddings_forest.MEASURED))
        for q, found in zip(asked, forest.candidates(asked, wanted, kept)):
            distance = ((own - q) ** 2).sum(1)
            true = np.argsort(distance, kind="stable")[:11]
            assert len(found) <= kept[0]
            recalls.append(len(set(true) & set(found)) / 11)
    assert np.mean(recalls) >= 0.9


def test_rows_of_the_query_id_take_no_places(spark):
    rows = [(100, [1.0, 0.001 * i]) for i in range(40)] + [(i, [1.0, 1.0 + i]) for i in range(1, 15)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embeddings_forest.nearest(frame.where("vec_id <> 100").unionByName(frame.where("vec_id = 100")), F.col("vec_id") == 100).collect()
    assert {r["vec_id"] for r in got} <= set(range(1, 15)) and len(got) == 10
