"""Substring dedup against brute force, and its odd cases."""

import random
import re

import numpy as np

from wayline.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """(id, kept words) of rows (id, text), by comparing all windows."""
    seen, out = set(), []
    for id_, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        out.append((id_, len(words), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["kept_text"]) for r in df.collect()), key=str)


def rows_of(seed, n, vocabulary=6, most=60):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefghij"[:vocabulary]) for _ in range(r.randint(0, most))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(base)]


def test_small_blocks_and_groups(spark):
    rows = rows_of(3, 120) + [(200, None), (201, ""), (202, " \n "), (203, "a b c d e"), (204, "a b c d e"), (205, "é " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found(repeats.remove_repeats(docs, length=5, block_bytes=600, group_paths=40))
    assert got == brute(rows, 5)


def test_ties_repeated_rows_nulls_and_clashing_columns(spark):
    text = "one two three four five six"
    rows = [(7, text), (7, text), (None, text + " seven"), (3, text)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, block string, n_words int, kept_text int")
    out = repeats.remove_repeats(docs, length=4)
    assert out.columns == [*docs.columns, "n_words_", "n_removed", "removed", "kept_text_"]
    got = sorted(((r["doc_id"], r["n_words_"], r["kept_text_"]) for r in out.collect()), key=str)
    assert got == brute(rows, 4)
    spans = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in out.collect()}
    assert spans[3] == [(0, 6)] and spans[None] == []


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_cuts_hold_groups_to_size():
    census = np.zeros(1 << repeats.CENSUS_BITS, np.int64)
    census[[0, 1, 2, 700, 4095]] = [10, 10, 25, 100, 3]
    cuts = repeats.prefix_cuts(census, 30)
    assert (np.diff(cuts.astype(np.int64)) > 0).all()
    prefixes = np.repeat(np.arange(len(census), dtype=np.int64) << 20, census)
    prefixes += np.concatenate([np.arange(n) * (1 << 20) // max(n, 1) for n in census])  # spread within a label
    sizes = np.bincount(np.searchsorted(cuts, prefixes, "right"))
    assert sizes.sum() == census.sum() and sizes.max() <= 30


def test_shared_depths():
    near = np.array([1, 1, 1, 1, 2], np.uint16)
    rest = np.array([5 << 48, (5 << 48) + 1, (5 << 48) + 1, 6 << 48, 6 << 48], np.uint64)
    assert repeats.shared_depth(near, rest, 20).tolist() == [0, 10, 20, 4, 0]
