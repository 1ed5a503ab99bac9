"""Documents in blocks: ranges of (id, text) of about equal bytes that one task holds at a time.

The operators on word windows send sorted codes of a block to the groups that compare them,
and get an answer per code back. A block is therefore formed twice with the same rows: its
bounds are fixed numbers taken from all rows first, so a lost task forms it again alike.

Ids are cut where their bytes, summed in order, fill a block. An id (or the null id) whose rows
don't fit one is cut by its texts, and rows of equal id and text that don't fit one either are
dealt over several by their place in the input. Only a single row can be larger than a block.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.tables import arrow_schema, as_table, fresh
from wayline.session import materialize

#: Text of a block, about. The arrays for it take some 15 times as much in a task.
BLOCK_BYTES = 6 << 20
#: What a row counts besides its text, so that rows of empty texts fill a block too.
ROW_BYTES = 32
#: Ids that a task puts in order to cut them, about.
TASK_IDS = 50_000


def _cut(keys: DataFrame, parts: int, block_bytes: int, by_text: bool) -> list[tuple[int | None, bytes, int, int]]:
    """First id, a prefix of its first text, weight and rows of each block of keys (id, text, weight, n), in order.

    The prefix is greater than the texts before it. Blocks of a null id have no others, nor do
    those of any id if they are cut by text. More than block_bytes are of a single key.
    """
    sent = arrow_schema(kinds := "id long, text binary, weight long, n long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, before = [], None
        for batch in batches:
            for id_, text, weight, n in zip(*(batch.column(c).to_pylist() for c in sent.names)):
                apart = before is None or (id_ != before[0] and (by_text or before[0] is None))
                if apart or blocks[-1][2] + weight > block_bytes:
                    start = text
                    if before is not None:
                        start = b"" if id_ != before[0] else text[: _shared(before[1], text) + 1]
                    blocks.append([id_, start, 0, 0])
                blocks[-1][2] += weight
                blocks[-1][3] += n
                before = id_, text
        yield from as_table(dict(zip(sent.names, zip(*blocks) if blocks else [[]] * 4)), sent).to_batches()

    ordered = keys.repartitionByRange(parts, "id", "text").sortWithinPartitions("id", "text")
    found = sorted((tuple(r) for r in ordered.mapInArrow(cut, kinds).collect()), key=lambda r: (r[0] is not None, r[0] or 0, bytes(r[1])))
    out: list[tuple[int | None, bytes, int, int]] = []
    for id_, text, weight, n in found:
        last = out[-1] if out else None
        alike = last is not None and (last[0] == id_ or (last[0] is not None and not by_text))
        if last is not None and alike and last[2] + weight <= block_bytes:
            out[-1] = (last[0], last[1], last[2] + weight, last[3] + n)
        else:
            out.append((id_, bytes(text), weight, n))
    return out


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def in_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str, int]:
    """The documents with the number of their block, that column's name, and the bytes of all texts.

    Blocks ascend with the id, a null id first, and then with the text. Ids must be whole numbers.
    """
    ids = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    weight = F.octet_length(text).cast("long") + ROW_BYTES
    sizes = docs.select(ids.alias("id"), weight.alias("weight")).groupBy("id").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "sizes").select("id", F.lit(b"").alias("text"), "weight", "n")
    starts = _cut(sizes, max(1, math.ceil(sizes.count() / TASK_IDS)), block_bytes, by_text=False)
    total = sum(x[2] - ROW_BYTES * x[3] for x in starts)

    large = {id_: w for id_, _, w, n in starts if w > block_bytes and n > 1}
    listed = F.lit(False)
    if large:
        listed = F.when(ids.isNull(), F.lit(None in large)).otherwise(ids.isin([x for x in large if x is not None]))
        texts = docs.where(listed).select(ids.alias("id"), text.alias("text")).groupBy("id", "text").agg(F.count(F.lit(1)).alias("n"))
        texts = texts.select("id", "text", ((F.octet_length("text") + ROW_BYTES) * F.col("n")).alias("weight"), "n")
        inner = _cut(texts, max(1, math.ceil(sum(large.values()) / (8 * block_bytes))), block_bytes, by_text=True)
    # number of the first block of each range of ids, and, within large ids, of each range of texts
    numbers, within, done, dealt = [], {}, 0, False
    for id_, *_ in starts:
        numbers.append(done)
        if id_ not in large:
            done += 1
            continue
        within[id_] = bounds, firsts, spread = [], [], []
        for _, start, w, n in (x for x in inner if x[0] == id_):
            bounds.append(start)
            firsts.append(done)
            spread.append(min(n, math.ceil(2 * w / block_bytes)) if w > block_bytes else 1)
            done += spread[-1]
            dealt |= spread[-1] > 1
    known = [i for i, x in enumerate(starts) if x[0] is not None]
    cuts, blocks = np.array([starts[i][0] for i in known], np.int64), np.array([numbers[i] for i in known], np.int32)

    @F.pandas_udf(T.IntegerType())
    def block_of(values: pd.Series, null: pd.Series, texts: pd.Series, places: pd.Series) -> pd.Series:
        found = np.zeros(len(values), np.int32)
        some = np.flatnonzero(~null.to_numpy(bool))
        found[some] = blocks[np.searchsorted(cuts, values.to_numpy(np.int64)[some], "right") - 1]
        if within:
            for i, (id_, none, own, place) in enumerate(zip(values.tolist(), null.tolist(), texts.tolist(), places.tolist())):
                if own is not None:
                    bounds, firsts, spread = within[None if none else id_]
                    at = max(0, bisect_right(bounds, bytes(own)) - 1)
                    found[i] = firsts[at] + place % spread[at]
        return pd.Series(found)

    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31)) if dealt else F.lit(0).cast("long")
    own = F.when(listed, text) if large else F.lit(None).cast("binary")
    name = fresh(docs, "block")
    return docs.withColumn(name, block_of(F.coalesce(ids, F.lit(0).cast("long")), ids.isNull(), own, place)), name, total


def in_order(block: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """Rows by id (null first), then by text (null as empty)."""
    keys = pa.table({"id": block[id_col], "text": pc.fill_null(block[text_col], "")})
    return block.take(pc.sort_indices(keys, [("id", "ascending"), ("text", "ascending")], null_placement="at_start"))


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
