"""Cost-balanced packing of documents into sequences of a token capacity.

Attention over a piece of n tokens costs about `linear * n + quadratic * n * n`. A document
becomes ids and an end id; whole capacities of a longer one are sequences of their own, its
rest (less than a capacity) is packed. Rests are dealt by a hash to groups of some thousand,
each packed in one task: in descending order of tokens, each goes to the sequence of lowest
cost so far that has room for it. A group opens just as many sequences as its tokens fill, so
at the end some rests fit nowhere whole: these are cut to fill what is left, largest gap
first. Less than one capacity stays free in a group, whatever the lengths are.

Defined results: a null text is empty, a document of one end id; ids are those of whole texts;
equal lengths go by id, then by text code; rows of equal id or repeated rows are packed each, and
dealt to groups by their place in the input, so they never fill one; ids of any type that sorts,
a null id is packed like others; a text of any length is encoded whole, in one task; no rows give none. Only the named columns are read, so extra
columns can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.tables import arrow_schema, as_table, release
from wayline.llm.tokens import CACHED, crc32, encoder

#: Documents in a group, about: some 4 MB of ids.
GROUP_DOCS = 4096
#: Documents whose ids a task holds at a time.
BATCH_DOCS = 1024
#: Sequence ids of a group begin at its number times this.
GROUP_IDS = 1 << 32


@dataclass(frozen=True)
class Packing:
    capacity: int = 1024
    end_id: int = 0
    linear: float = 1.0
    #: of a token pair: at this value a piece of 1024 costs as much for its pairs as for its tokens
    quadratic: float = 1.0 / 1024

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


def assign(lengths: list[int], how: Packing) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of pieces, for items in descending order of length."""
    if not lengths:
        return []
    n = -(-sum(lengths) // how.capacity)
    room, used = [how.capacity] * n, [0.0] * n
    # open sequences by room: a heap of (cost, number) each, and the lowest cost in it
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(how.capacity + 1)]
    by_room[how.capacity] = [(0.0, s) for s in range(n)]
    lowest = np.full(how.capacity + 1, np.inf)
    lowest[how.capacity] = 0.0
    pieces, left = [], []

    def put(item: int, start: int, length: int, s: int) -> None:
        pieces.append((item, start, length, s, how.capacity - room[s]))
        room[s] -= length
        used[s] += how.cost(length)

    for item, length in enumerate(lengths):
        at = length + int(lowest[length:].argmin())
        if lowest[at] == np.inf:
            left.append(item)
            continue
        _, s = heapq.heappop(by_room[at])
        lowest[at] = by_room[at][0][0] if by_room[at] else np.inf
        put(item, 0, length, s)
        if room[s]:
            heapq.heappush(by_room[room[s]], (used[s], s))
            lowest[room[s]] = by_room[room[s]][0][0]
    gaps = [(-room[s], s) for s in range(n) if room[s]]
    heapq.heapify(gaps)
    for item in left:
        start = 0
        while start < lengths[item]:
            _, s = heapq.heappop(gaps)
            length = min(lengths[item] - start, room[s])
            put(item, start, length, s)
            start += length
            if room[s]:
                heapq.heappush(gaps, (-room[s], s))
    return pieces


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, how: Packing, groups: int, cached: int = CACHED) -> DataFrame:
    """A row per document: its group, full (crc32 of each whole capacity) and rest (ids of what is left)."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    place = F.monotonically_increasing_id()
    narrow = narrow.withColumns({"code": F.xxhash64("doc_id", "text"), "deal": F.xxhash64("doc_id", "text", place)})
    kinds = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, code long, deal long, n long, full array<long>, rest binary"
    out = arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encode = encoder(tokenizer, cached)
        end = np.array([how.end_id], encode.dtype)
        for batch in (b.slice(at, BATCH_DOCS) for b in batches for at in range(0, b.num_rows, BATCH_DOCS)):
            sizes, full, rest = [], [], []
            for text in batch.column(1):
                ids = np.concatenate([encode.encode(text.as_py()), end])
                whole = len(ids) // how.capacity * how.capacity
                sizes.append(len(ids))
                full.append([crc32(ids[i : i + how.capacity]) for i in range(0, whole, how.capacity)])
                rest.append(ids[whole:].tobytes())
            columns = {"doc_id": batch.column(0), "code": batch.column(2), "deal": batch.column(3), "n": sizes, "full": full, "rest": rest}
            yield from as_table(columns, out).to_batches()

    rows = narrow.mapInArrow(run, kinds)
    return rows.withColumn("pack_group", F.pmod("deal", F.lit(groups))).drop("deal")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", how: Packing = Packing(), group_docs: int = GROUP_DOCS, cached: int = CACHED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost.

    The documents are counted first, which reads no text. Texts are encoded where they are read;
    ids of the rests are what is shuffled. Fewer cached pieces cost time and leave memory to others.
    """
    groups = max(1, -(-docs.count() // group_docs))
    rows = tokenized(docs, id_col, text_col, tokenizer, how, groups, cached)
    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
    out, capacity = arrow_schema(kinds), how.capacity

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        n = group["n"].to_numpy()
        rest = n % capacity
        by = [("id", "ascending"), ("code", "ascending")]
        keys = pa.table({"rest": rest, "id": group["doc_id"], "code": group["code"]})
        order = pc.sort_indices(keys, [("rest", "descending"), *by], null_placement="at_start").to_numpy()
        order = order[rest[order] > 0]
        rows = []
        for item, start, length, sequence, offset in assign(rest[order].tolist(), how):
            d = int(order[item])
            data = group["rest"][d].as_buffer()
            ids = np.frombuffer(data, f"<u{len(data) // int(rest[d])}")[start : start + length]
            rows.append((d, int(n[d] - rest[d]) + start, length, crc32(ids), sequence, offset))
        sequence = -(-int(rest.sum()) // capacity)
        for d in pc.sort_indices(keys, by, null_placement="at_start").to_pylist():
            for i, crc in enumerate(group["full"][d].as_py()):
                rows.append((d, i * capacity, capacity, crc, sequence, 0))
                sequence += 1
        if not rows:
            return out.empty_table()
        first = group["pack_group"][0].as_py() * GROUP_IDS
        d, start, length, crc, sequences, offset = (np.array(x, np.int64) for x in zip(*rows))
        columns = {"doc_id": group["doc_id"].take(pa.array(d)), "start": start, "length": length, "ids_crc32": crc}
        columns |= {"doc_tokens": n[d], "sequence_id": first + sequences, "offset": offset}
        return as_table(columns | {"cost": how.linear * length + how.quadratic * length * length}, out)

    return rows.groupBy("pack_group").applyInArrow(run, kinds)
