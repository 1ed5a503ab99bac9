"""Blocks of documents hold their bytes, whatever the ids, and ascend with id and text."""

import random

import pytest

from wayline.llm.blocks import ROW_BYTES, in_blocks

from tests.llm.test_jaccard import brute as all_pairs
from tests.llm.test_repeats import brute as all_windows
from tests.llm.test_repeats import found

from wayline.llm import jaccard, repeats

KINDS = "doc_id long, text string"


def blocks_of(spark, rows, block_bytes):
    docs, name, total = in_blocks(spark.createDataFrame(rows, KINDS).repartition(3), "doc_id", "text", block_bytes)
    assert total == sum(len((t or "").encode()) for _, t in rows)
    by = {}
    for r in docs.collect():
        by.setdefault(r[name], []).append((r["doc_id"], r["text"]))
    return [by[b] for b in sorted(by)]


def weight(block):
    return sum(len((t or "").encode()) + ROW_BYTES for _, t in block)


def key(row):
    return (row[0] is not None, row[0] or 0, (row[1] or "").encode())


@pytest.mark.parametrize("case", ["null ids", "one id", "long texts together", "empty texts"])
def test_blocks_hold_their_bytes(spark, case):
    r = random.Random(4)
    text = lambda n: "same beginning é " + "".join(r.choice("abé ") for _ in range(n))
    rows = [(i + 2**60, text(50)) for i in range(300)]
    if case == "long texts together":
        rows[100:110] = [(i, text(900)) for i, _ in rows[100:110]]
    elif case == "empty texts":
        rows = [(i, "" if i % 2 else None) for i, _ in rows]
    else:
        rows[::3] = [(None if case == "null ids" else 7, t) for _, t in rows[::3]]
    found = blocks_of(spark, rows, 2000)
    assert sorted(sum(found, []), key=key) == sorted(rows, key=key)
    assert max(weight(b) for b in found) <= 2000
    assert all(max(map(key, a)) <= min(map(key, b)) for a, b in zip(found, found[1:]))
    assert len(found) < 3 * sum(map(weight, found)) / 2000


def test_equal_rows_are_dealt_over_blocks(spark):
    rows = [(i, f"other {i}") for i in range(20)] + [(5, "equal text")] * 1000 + [(None, "equal text")] * 1000
    found = blocks_of(spark, rows, 4000)
    assert sorted(sum(found, []), key=key) == sorted(rows, key=key)
    assert max(weight(b) for b in found) <= 4000


def crowded():
    r = random.Random(6)
    text = lambda n: " ".join(r.choice("abcdef") for _ in range(n))
    rows = [(r.choice([None, 3, i]), text(r.randint(0, 25))) for i in range(60)]
    return rows + [(3, "a b c d e f a a b")] * 40 + [(90, "a b c d e f a a b")] * 2


def test_repeats_of_crowded_ids(spark):
    rows = crowded()
    got = found(repeats.remove_repeats(spark.createDataFrame(rows, KINDS).repartition(3), length=5, block_bytes=500, group_paths=40))
    assert got == all_windows(rows, 5)


def test_links_of_equal_rows_in_many_blocks(spark):
    rows = [(r, t) for r, t in crowded() if r not in (None, 3)]
    docs = spark.createDataFrame(rows + [(3, "a b c d e f a a b c")] * 40, KINDS).repartition(3)
    got = {tuple(x)[:4] for x in jaccard.join(docs, block_bytes=500).collect()}
    assert got == {x[:4] for x in all_pairs(dict([*rows, (3, "a b c d e f a a b c")]).items(), 5, 80)}
