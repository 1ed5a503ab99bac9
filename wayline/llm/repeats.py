"""Substring dedup by prefix-partitioned suffix trees.

Every word of a document begins a suffix. A suffix is known by the labels of its path in the
tree: codes of its first 4, first 10 and first `length` words (DEPTHS and the length). Suffixes
that pass the same node at a depth have the same label there; 80 bits tell paths apart.

1. Census: how many suffixes begin with each 12-bit label at depth 4, over all documents.
2. Variable-length prefixes: neighbouring rare labels share a group; a frequent one is cut by as
   many further bits (the rest of its label, then the label at depth 10) as make its parts fit
   a task's memory. Each block of documents sends its distinct paths, sorted, to the groups.
3. A group sorts the paths of all blocks: the leaves of a subtree, with the depths that
   neighbours share. Internal nodes at depth `length` or more are repeats; all of a node's
   blocks but the earliest are told that the path starts earlier.
4. Each block, formed again, marks the words of such windows and of those that repeat within
   the block; adjoining windows make up the maximal repeats, which are removed.

A passage in very many documents has one leaf a block at most, so no group grows with its
copies. Windows are judged on the input: removing one does not save another.

Defined results: words are runs of characters other than space and \\t to \\r; a null text has
none; rows of equal id are taken in the order of their texts, and a repeated row counts as a
later one; a text of any length is judged whole, in one task that takes some 15 times its bytes; no
rows give no rows. All columns of the documents are kept; the added columns take
names that they don't have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wayline.llm.blocks import BLOCK_BYTES, in_blocks, in_order, pack
from wayline.llm.tables import fresh, lighten, plus
from wayline.llm.words import U64, Words, covered, rolling, words_of

#: Words whose labels come before the one of the whole window.
DEPTHS = (4, 10)
#: Bits of the label at depth 4 that the census counts.
CENSUS_BITS = 12
#: Paths in a group, about: 8 bytes each, and some 6 times as much to sort them.
GROUP_PATHS = 2_000_000


def path_labels(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places of all windows, their labels at depth 4 (16 bits), and those below it (16 + 48 bits)."""
    codes, places = words.codes(), words.windows(length)
    near, mid = (rolling(codes, min(d, length))[places] for d in DEPTHS)
    full = rolling(codes, length)[places]
    return places, (near >> U64(48)).astype(np.uint16), (mid & U64(0xFFFF << 48)) | (full >> U64(16))


def path_order(near: np.ndarray, rest: np.ndarray) -> np.ndarray:
    order = np.argsort(rest)
    return order[np.argsort(near[order], kind="stable")]


def shared_depth(near: np.ndarray, rest: np.ndarray, length: int) -> np.ndarray:
    """Words that each sorted path shares with the one before it: 0, a label's depth, or the length."""
    out = np.zeros(len(rest), np.int64)
    same = near[1:] == near[:-1]
    out[1:][same] = DEPTHS[0]
    out[1:][same & ((rest[1:] ^ rest[:-1]) >> U64(48) == 0)] = DEPTHS[1]
    out[1:][same & (rest[1:] == rest[:-1])] = length
    return out


@dataclass
class Paths:
    """Distinct paths of a block, sorted; `first` is the window of each that comes first."""

    near: np.ndarray
    rest: np.ndarray
    first: np.ndarray
    n_windows: int


def distinct_paths(near: np.ndarray, rest: np.ndarray, length: int) -> Paths:
    if len(rest) == 0:
        return Paths(near, rest, np.empty(0, np.int64), 0)
    order = path_order(near, rest)
    heads = np.flatnonzero(shared_depth(near[order], rest[order], length) < length)
    return Paths(near[order[heads]], rest[order[heads]], np.minimum.reduceat(order, heads), len(rest))


def block_paths(texts: pa.ChunkedArray, length: int) -> Paths:
    found = [path_labels(words, length)[1:] for words in words_of(texts)]
    near = np.concatenate([x[0] for x in found]) if found else np.empty(0, np.uint16)
    rest = np.concatenate([x[1] for x in found]) if found else np.empty(0, U64)
    return distinct_paths(near, rest, length)


def prefix_cuts(census: np.ndarray, group_paths: int = GROUP_PATHS) -> np.ndarray:
    """First 32-bit prefixes of the groups but the first, from the counts of the census."""
    cuts, held, free = [], 0, 32 - CENSUS_BITS
    for label, count in enumerate(census.tolist()):
        if label and held + count > group_paths:
            cuts.append(label << free)
            held = 0
        bits = 0
        while count > group_paths << bits and bits < free:
            bits += 1
        cuts += [(label << free) + (part << (free - bits)) for part in range(1, 1 << bits)]
        held = group_paths if bits else held + count
    return np.array(cuts, np.uint32)


def _prefix(near: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (near.astype(np.uint32) << np.uint32(16)) | (rest >> U64(48)).astype(np.uint32)


def _census(docs: DataFrame, text_col: str, length: int) -> np.ndarray:
    """Suffixes by label, over all documents: as many numbers as labels reach the driver."""
    kinds = T.StructType.fromDDL("label int, n bigint")
    arrow = to_arrow_schema(kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << CENSUS_BITS, np.int64)
        for batch in batches:
            for words in words_of(batch.column(0)):
                near = rolling(words.codes(), min(DEPTHS[0], length))[words.windows(length)]
                sums += np.bincount((near >> U64(64 - CENSUS_BITS)).astype(np.int64), minlength=len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], schema=arrow)

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, kinds)
    out = np.zeros(1 << CENSUS_BITS, np.int64)
    for label, n in rows.groupBy("label").agg(F.sum("n").alias("n")).collect():
        out[label] = n
    return out


def earlier_elsewhere(blobs: list[tuple[int, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """The subtree of a group: for each block's sorted paths, flags of those that an earlier block has."""
    near = np.concatenate([x[1] for x in blobs])
    rest = np.concatenate([x[2] for x in blobs])
    sizes = [len(x[2]) for x in blobs]
    block = np.repeat(np.array([x[0] for x in blobs], np.int32), sizes)
    order = path_order(near, rest)
    heads = np.flatnonzero(shared_depth(near[order], rest[order], length) < length)
    flags = np.zeros(len(rest), bool)
    if len(heads):
        runs = np.diff(np.append(heads, len(order)))
        earliest = np.minimum.reduceat(block[order], heads)
        flags[order] = block[order] != np.repeat(earliest, runs)
    return np.split(flags, np.cumsum(sizes)[:-1])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, block_bytes: int = BLOCK_BYTES, group_paths: int = GROUP_PATHS) -> DataFrame:
    """The documents with n_words, n_removed, removed (word ranges: start, end) and kept_text
    (the kept words joined by one space) added, under other names if these are taken."""
    cuts = prefix_cuts(_census(docs, text_col, length), group_paths)
    blocks, block_col, _ = in_blocks(docs, id_col, text_col, block_bytes)
    sent = to_arrow_schema(kinds := T.StructType.fromDDL("block int, part int, low int, counts binary, rest binary"))

    def send(block: pa.Table) -> pa.Table:
        """A row per group that the block has paths of."""
        lighten()
        number = block[block_col][0].as_py()
        paths = block_paths(in_order(block, id_col, text_col)[text_col], length)
        edges = np.concatenate([[0], np.searchsorted(_prefix(paths.near, paths.rest), cuts), [len(paths.rest)]])
        rows = []
        for part in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[part], edges[part + 1])
            low = int(paths.near[at][0])
            counts = np.bincount(paths.near[at].astype(np.int64) - low).astype("<u4")
            rows.append((number, part, low, pack(counts), pack(paths.rest[at])))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, sent)], schema=sent)

    answered = to_arrow_schema(answer_kinds := T.StructType.fromDDL("block int, part int, flags binary"))

    def answer(group: pa.Table) -> pa.Table:
        lighten()
        numbers = group["block"].to_pylist()
        blobs = []
        for i, (low, counts, rest) in enumerate(zip(group["low"], group["counts"], group["rest"])):
            counts = np.frombuffer(counts.as_buffer(), "<u4")
            near = np.repeat(np.arange(low.as_py(), low.as_py() + len(counts), dtype=np.uint16), counts)
            blobs.append((numbers[i], near, np.frombuffer(rest.as_buffer(), "<u8")))
        flags = [pack(np.packbits(x)) for x in earlier_elsewhere(blobs, length)]
        return pa.Table.from_arrays([group["block"], group["part"], pa.array(flags, pa.binary())], schema=answered)

    flags = blocks.groupBy(block_col).applyInArrow(send, kinds).groupBy("part").applyInArrow(answer, answer_kinds)

    names = {name: fresh(docs, name) for name in ("n_words", "n_removed", "removed", "kept_text")}
    added_kinds = ("bigint", "bigint", "array<struct<start:int,end:int>>", "string")
    out_kinds = plus(docs.schema, **dict(zip(names.values(), added_kinds)))
    out_schema, own = to_arrow_schema(out_kinds), docs.columns

    def cut(block: pa.Table, found: pa.Table) -> pa.Table:
        if block.num_rows == 0:
            return out_schema.empty_table()
        lighten()
        block = in_order(block, id_col, text_col)
        paths = block_paths(block[text_col], length)
        edges = np.concatenate([[0], np.searchsorted(_prefix(paths.near, paths.rest), cuts), [len(paths.rest)]])
        elsewhere = np.zeros(len(paths.rest), bool)
        for part, bits in zip(found["part"].to_pylist(), found["flags"]):
            n = edges[part + 1] - edges[part]
            elsewhere[edges[part] : edges[part + 1]] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=n)
        again = np.ones(paths.n_windows, bool)
        again[paths.first[~elsewhere]] = False
        added = _cut_rows(block[text_col], again, length)
        kept = [block[name].cast(out_schema.field(name).type) for name in own]
        return pa.Table.from_arrays([*kept, *[pa.array(x, out_schema.field(names[k]).type) for k, x in added.items()]], schema=out_schema)

    return blocks.groupBy(block_col).cogroup(flags.groupBy("block")).applyInArrow(cut, out_kinds)


def _cut_rows(texts: pa.ChunkedArray, again: np.ndarray, length: int) -> dict[str, list]:
    """n_words, n_removed, removed and kept_text of rows, from the flags of their windows."""
    out: dict[str, list] = {"n_words": [], "n_removed": [], "removed": [], "kept_text": []}
    done = 0
    for w in words_of(texts):
        places = w.windows(length)
        gone = covered(len(w.starts), places[again[done : done + len(places)]], length)
        done += len(places)
        lost = np.bincount(w.row[gone], minlength=w.n_rows).tolist()
        out["n_words"] += w.counts.tolist()
        out["n_removed"] += lost
        data = w.data.tobytes()
        bounds, rows = w.bounds.tolist(), w.rows.tolist()
        for r in range(w.n_rows):
            words = data[rows[r] : rows[r + 1]].split()
            spans = []
            if lost[r]:
                flags = gone[bounds[r] : bounds[r + 1]]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2])]
                ends = [0, *turns, len(words)]
                words = [x for a, b in zip(ends[::2], ends[1::2]) for x in words[a:b]]
            out["removed"].append(spans)
            out["kept_text"].append(b" ".join(words).decode())
    return out
