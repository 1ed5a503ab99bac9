"""Token ids of a corpus in files of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents, cut into blocks of 256 ids. A block stores its
smallest id, and every id less that, packed in as many bits as 95 of 100 of its values need.
Larger values store their low bits in place; place and high bits go to the exceptions (the
patches). Index: where each block begins, and where each document ends.

Shards are binary values, one a row, in a table that Spark writes: its committer makes lost
tasks safe, on any file system. Rows carry the shard's place in the order of ids, its first id
and its counts, so that a reader finds a document's shard without opening others.

Shard layout, little endian: magic `WPF1`; u4 counts of ids, documents, blocks, exceptions;
u4 document ends; u4 block byte starts and their end; u4 exception starts by block and their
end; u4 block minima; u1 block widths; exceptions u1 place and u4 high bits; packed values, a plane of bits at a time.

Defined results: a null text is empty, a document of one end id; documents of equal id follow by
text, repeated rows one after another; null ids come first; a text of any length is encoded whole, in one
task, and is a shard of its own beyond SHARD_IDS; no rows give no shards. Only the
named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.tables import arrow_schema, as_table
from wayline.llm.tokens import crc32, encoder
from wayline.session import materialize

BLOCK = 256
PERCENTILE = 95
#: Ids of a shard, about (one longer document is a shard of its own).
SHARD_IDS = 1 << 19
#: Text of a range of documents that one task encodes, about.
RANGE_BYTES = 16 << 20
MAGIC = b"WPF1"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of bytes, one plane of bits after another."""
    planes = [np.packbits(((values >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8), axis=1) for bit in range(width)]
    return np.concatenate(planes, axis=1)


def unpack_bits(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data), BLOCK), np.uint32)
    for bit, plane in enumerate(np.split(data, width, axis=1)):
        out |= np.unpackbits(plane, axis=1).astype(np.uint32) << np.uint32(bit)
    return out


_LENGTHS = np.zeros(1 << 16, np.uint8)  # of 16-bit numbers, in bits
for _bit in range(16):
    _LENGTHS[1 << _bit :] = _bit + 1


def _bit_length(values: np.ndarray) -> np.ndarray:
    high = values >> np.uint32(16)
    if not high.any():
        return _LENGTHS[values]
    return np.where(high > 0, 16 + _LENGTHS[high], _LENGTHS[values & np.uint32(0xFFFF)])


def encode_shard(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """Bytes of a shard from its ids and where its documents end."""
    n_blocks = math.ceil(len(ids) / BLOCK)
    padded = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    padded[: len(ids)] = ids
    blocks = padded.reshape(n_blocks, BLOCK)
    least = blocks.min(axis=1) if n_blocks else np.empty(0, np.uint32)
    rest = blocks - least[:, None]
    nth = math.ceil(BLOCK * PERCENTILE / 100) - 1
    widths = np.partition(_bit_length(rest), nth, axis=1)[:, nth] if n_blocks else np.empty(0, np.uint8)
    high = rest >> widths[:, None].astype(np.uint32)
    block, place = np.nonzero(high)
    low = rest & ((np.uint32(1) << widths[:, None].astype(np.uint32)) - np.uint32(1))
    starts = np.concatenate([[0], np.cumsum(widths.astype(np.int64) * BLOCK // 8)])
    body = np.zeros(starts[-1], np.uint8)
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == width)
        body[starts[at][:, None] + np.arange(width * BLOCK // 8)] = pack_bits(low[at], width)
    patches = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=n_blocks))])
    u4 = lambda x: np.asarray(x).astype("<u4").tobytes()
    head = [MAGIC, u4([len(ids), len(ends), n_blocks, len(block)]), u4(ends), u4(starts), u4(patches), u4(least), widths.tobytes()]
    return b"".join([*head, place.astype(np.uint8).tobytes(), u4(high[block, place]), body.tobytes()])


@dataclass
class Shard:
    """A shard's index; blocks are decoded on demand."""

    data: bytes

    def __post_init__(self) -> None:
        if self.data[:4] != MAGIC:
            raise ValueError("Not a shard of token ids")
        self.at = 4
        self.n_ids, n_docs, self.n_blocks, n_patches = self._take("<u4", 4).tolist()
        self.ends, self.starts = self._take("<u4", n_docs), self._take("<u4", self.n_blocks + 1)
        self.patches, self.least = self._take("<u4", self.n_blocks + 1), self._take("<u4", self.n_blocks)
        self.widths = self._take("u1", self.n_blocks)
        self.place, self.high = self._take("u1", n_patches), self._take("<u4", n_patches)
        self.body = self._take("u1", int(self.starts[-1]))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from first to before last."""
        widths = self.widths[first:last]
        out = np.zeros((last - first, BLOCK), np.uint32)
        for width in np.unique(widths[widths > 0]).tolist():
            at = np.flatnonzero(widths == width)
            begin = self.starts[first:last][at].astype(np.int64)
            out[at] = unpack_bits(self.body[begin[:, None] + np.arange(width * BLOCK // 8)], width)
        some = slice(int(self.patches[first]), int(self.patches[last]))
        block = np.repeat(np.arange(last - first), np.diff(self.patches[first : last + 1].astype(np.int64)))
        out[block, self.place[some]] |= self.high[some] << widths[block].astype(np.uint32)
        out += self.least[first:last, None]
        return out.reshape(-1)

    def ids(self) -> np.ndarray:
        return self.blocks(0, self.n_blocks)[: self.n_ids]

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, from its blocks alone."""
        begin, end = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        first = begin // BLOCK
        return self.blocks(first, math.ceil(end / BLOCK))[begin - first * BLOCK : end - first * BLOCK]


def shards(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Rows of shards: range_no, shard_no (in ascending id), n_ids, doc_ids, data."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = narrow.repartitionByRange(max(1, math.ceil(size / RANGE_BYTES)), F.col("doc_id").asc_nulls_first())
    ranges = ranges.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    out = arrow_schema(kinds := "range_no int, shard_no int, n_ids long, doc_ids array<long>, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end, range_no, shard_no = np.array([end_id], encode.dtype), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        held = 0

        def shard() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in ids])
            data = encode_shard(np.concatenate(ids), ends)
            row = {"range_no": [range_no], "shard_no": [shard_no], "n_ids": [int(ends[-1])], "doc_ids": [doc_ids], "data": [data]}
            return as_table(row, out).to_batches()[0]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.concatenate([encode.encode(text.as_py()), end])
                if ids and held + len(new) > shard_ids:
                    yield shard()
                    shard_no, ids, doc_ids, held = shard_no + 1, [], [], 0
                ids.append(new)
                doc_ids.append(doc_id)
                held += len(new)
        if ids:
            yield shard()

    return ranges.mapInArrow(run, kinds)


def write(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the shards to the shared folder, and give the table of them as it is read back."""
    return materialize(shards(docs, tokenizer, **options), "token-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    Starts: ids of earlier ranges and, within a range, of earlier shards; both are sums over
    counts of shards, not over documents. They are written, so that Spark knows their size and
    joins them to the shards without a shuffle where it is small.
    """
    per_range = files.groupBy("range_no").agg(F.sum("n_ids").alias("ids"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of documents
    base = per_range.select("range_no", F.coalesce(F.sum("ids").over(before(Window.orderBy("range_no"))), F.lit(0)).alias("base"))
    within = Window.partitionBy("range_no").orderBy("shard_no")
    starts = files.select("range_no", "shard_no", F.coalesce(F.sum("n_ids").over(before(within)), F.lit(0)).alias("inner"))
    starts = starts.join(base, "range_no").select("range_no", "shard_no", (F.col("base") + F.col("inner")).alias("first"))
    placed = files.join(materialize(starts, "shard-starts"), ["range_no", "shard_no"]).select("first", "doc_ids", "data")
    out = arrow_schema(kinds := "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, data in zip(*[batch.column(i) for i in range(3)]):
                shard = Shard(data.as_py())
                ids, ends = shard.ids(), shard.ends.astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                crcs = [crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = {"doc_id": doc_ids.values, "start": first.as_py() + begins, "n_tokens": ends - begins, "ids_crc32": crcs}
                yield from as_table(columns, out).to_batches()

    return placed.mapInArrow(run, kinds)
