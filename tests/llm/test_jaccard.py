"""Jaccard join against brute force over all pairs, with tasks small enough to be cut into chunks."""

import random
import re

import numpy as np
import pytest

from wayline.llm import jaccard
from wayline.llm.components import components


def grams(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, pct):
    sets = {i: grams(t, k) for i, t in rows}
    near = {i: {j for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j])} for i in sets}
    out = []
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        same = min(j for j in sets if sets[j] == sets[i]) if sets[i] else i
        out.append((i, len(sets[i]), same, min(seen), len(near[i])))
    return sorted(out)


def near_copies(seed, n):
    r = random.Random(seed)
    bases = [[r.choice("abcdefghijklmnop") for _ in range(r.randint(20, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            words[r.randrange(len(words))] = r.choice("ABCxyz")
        rows.append((i * 3 + 1, " ".join(words[: r.choice([None, None, -1, -6])])))
    return rows


@pytest.mark.parametrize("task_grams", [jaccard.TASK_GRAMS, 900])
def test_against_all_pairs(spark, task_grams):
    rows = near_copies(5, 150) + [(900, None), (901, ""), (902, "A b"), (903, "a B"), (904, "a b c"), (905, " \n"), (906, "w" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.join(docs, block_bytes=1500, task_grams=task_grams)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 80)


def test_large_components_are_cut(spark):
    rows = [(i, f"c{i % 2}", 40) for i in range(200)]
    groups = spark.createDataFrame(rows, "doc_id long, component string, n long").selectExpr("*", "doc_id a", "doc_id b", "1L copies")
    tasks = jaccard._tasks(groups, 1000).collect()
    by = {}
    for r in tasks:
        by.setdefault(r["task"], {}).setdefault(r["chunk"], set()).add(r["doc_id"])
    assert max(len(c) for c in by.values()) == 2
    met = {frozenset((x, y)) for c in by.values() for a in c for b in c if a != b or len(c) == 1 for x in c[a] for y in c[b]}
    wanted = {frozenset((x, y)) for x in range(200) for y in range(200) if x % 2 == y % 2}
    assert met == wanted


def test_a_component_of_fewer_sets_than_chunks(spark):
    words = [f"w{i}" for i in range(400)]
    for first in range(0, 12, 3):  # chunks are dealt by the hash of the id
        rows = [(first + i, " ".join(words[: 400 - i])) for i in range(3)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = jaccard.join(docs, block_bytes=1500, task_grams=300)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 80)


def test_repeated_rows_nulls_and_other_columns(spark):
    text = "one two three four five six seven"
    rows = [(1, text, 1, "q"), (1, text, 1, "q"), (None, text, 2, "q"), (4, text + " eight", 3, None), (5, None, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long, component string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, pct=70).collect()}
    assert got == {(1, 3, 1), (None, 3, 1), (4, 4, 1), (5, 0, 5)}


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_search_probes_and_scans_alike():
    r = np.random.default_rng(2)
    sets = [np.sort(r.choice(60, 40, replace=False)).astype(np.uint64) for _ in range(80)]
    search = jaccard.Search(sets, 60)
    for q in range(80):
        want = [j for j in range(q) if 100 * len(np.intersect1d(sets[j], sets[q])) >= 60 * len(np.union1d(sets[j], sets[q]))]
        assert search.partners(q).tolist() == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
