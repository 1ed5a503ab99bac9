"""Nearest neighbours by a hash-prefix forest.

Vectors are dealt by a hash of their id to blocks that a task can hold. Each block has its own
forest: a tree is a sorted array of 64-bit hash strings, a bit for each side of a random plane
through the block's mean. A query descends every tree at once by binary search, to the entries
that share the longest prefix with its own string, however long that is; then all trees
ascend together, a bit a step, until the entries that share so long a prefix in some tree are
the part GATHERED of the block. A shared prefix says little about a vector without close
neighbours, so what is gathered is put in order by the equal bits of all strings, which the
trees hold anyway, and the part MEASURED of the block, those with most equal bits, is measured
exactly, in double precision. Both parts are the same for blocks of every size, and four times the
neighbours asked for at least.

Queries are packed too, and meet the blocks by a join on the block number: a pair of packs is
one row, results of a pair are the nearest of one block, and a last ranking keeps the nearest
of all. Index and memory of a task are bounded by the block; all vectors are indexed. A forest is
built for every pack of queries that meets its block, which is a hundredth of that pack's work.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part; vectors of different length are not compared; a query with fewer candidates gets all;
ties go to the smaller id; rows of equal id are candidates each, and no candidates of their own
id; a null id takes no part; no rows give none. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.tables import arrow_schema, as_table

TREES = 48
BITS = 64
#: Vectors in a block, and queries in a pack.
BLOCK_VECTORS = 16_384
PACK_QUERIES = 4_096
#: Part of a block that the ascent gathers, and part that is measured.
GATHERED = 0.65
MEASURED = 0.1


class Forest:
    """Sorted hash strings of a block's vectors, tree by tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 11):
        self.mean = vectors.mean(axis=0)
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * BITS)).astype(np.float32)
        self.own = self.codes(vectors)
        self.order = np.argsort(self.own, axis=0, kind="stable")
        self.strings = np.take_along_axis(self.own, self.order, axis=0)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings as numbers, a column per tree."""
        out = []
        for part in np.array_split(vectors, max(1, len(vectors) // 1024)):
            side = (part - self.mean).astype(np.float32) @ self.planes > 0
            packed = np.packbits(side.reshape(len(part), -1, BITS), axis=2)
            out.append(packed.reshape(len(part), -1).view(">u8").astype(np.uint64))
        return np.concatenate(out)

    def candidates(self, queries: np.ndarray, wanted: np.ndarray, kept: np.ndarray) -> list[np.ndarray]:
        """For each query so many vectors as it keeps, or all: those of most equal bits of at least `wanted` from the ascent."""
        codes = self.codes(queries)
        n, trees = self.strings.shape
        wanted = np.minimum(wanted, n)
        low, high = np.zeros((BITS + 1, trees, len(queries)), np.int32), np.zeros((BITS + 1, trees, len(queries)), np.int32)
        for depth in range(BITS + 1):
            rest = np.uint64((1 << (BITS - depth)) - 1)
            for t in range(trees):
                low[depth, t] = np.searchsorted(self.strings[:, t], codes[:, t] & ~rest)
                high[depth, t] = np.searchsorted(self.strings[:, t], codes[:, t] | rest, "right")
        found_at = (high - low).sum(axis=1)  # entries by depth and query, with repeats between trees
        out = []
        for q in range(len(queries)):
            # no deeper level can hold enough; from there on every step counts different vectors
            depth = int(np.flatnonzero(found_at[:, q] >= wanted[q])[-1])
            while True:
                parts = [self.order[low[depth, t, q] : high[depth, t, q], t] for t in range(trees)]
                marks = np.zeros(n, bool)
                marks[np.concatenate(parts)] = True
                found = np.flatnonzero(marks)
                if len(found) >= wanted[q]:
                    break
                depth -= 1
            equal = BITS * trees - np.bitwise_count(self.own[found] ^ codes[q]).sum(axis=1, dtype=np.int32)
            out.append(found[np.argsort(-equal, kind="stable")[: kept[q]]])
        return out


def part_of(n: int, part: float, k: int) -> int:
    return max(4 * k, math.ceil(part * n))


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _packs(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: n, ids and the components of its vectors as bytes."""
    out = arrow_schema(kinds := "dim int, part int, ids binary, vectors binary")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("vec_id")
        flat = np.asarray(group["vector"].chunk(0).flatten() if group["vector"].num_chunks else [], "<f8")
        row = {"dim": [group["dim"][0].as_py()], "part": [group["part"][0].as_py()]}
        return as_table(row | {"ids": [group["vec_id"].to_numpy().astype("<i8").tobytes()], "vectors": [flat.tobytes()]}, out)

    return rows.groupBy(*key).applyInArrow(run, kinds)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    gathered: float = GATHERED,
    measured: float = MEASURED,
    block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest found.

    `is_query` is a condition on the input's columns.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("vector"))).withColumn("dim", F.size("vector"))
    total, asking = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    blocks, packs = max(1, math.ceil(total / block_vectors)), max(1, math.ceil(asking / PACK_QUERIES))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", "vector", F.lit(seed)), F.lit(n)).cast("int")
    held = _packs(rows.withColumn("part", deal(blocks, 1)).select("dim", "part", "vec_id", "vector"), ["dim", "part"])
    asked = _packs(rows.where("asks").withColumn("part", deal(packs, 2)).select("dim", "part", "vec_id", "vector"), ["dim", "part"])
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = held.join(asked, ["dim", "part"]).select("dim", "ids", "vectors", "q_ids", "q_vectors")
    out = arrow_schema(kinds := "query_id long, vec_id long, score double")

    def run(batches):
        for batch in batches:
            for dim, ids, data, q_ids, q_data in zip(*[c for c in batch.columns]):
                dim = dim.as_py()
                read = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
                ids, own = read(ids, "<i8"), read(data, "<f8").reshape(-1, dim)
                q_ids, queries = read(q_ids, "<i8"), read(q_data, "<f8").reshape(-1, dim)
                forest = Forest(own, trees)
                # rows of the query's own id come on top: they are no candidates
                same = np.searchsorted(ids, q_ids, "right") - np.searchsorted(ids, q_ids)
                wanted, kept = (part_of(len(own), part, k) + same for part in (gathered, measured))
                for a in range(0, len(queries), 256):
                    some = slice(a, a + 256)
                    for q, found in zip(range(a, len(queries)), forest.candidates(queries[some], wanted[some], kept[some])):
                        found = found[ids[found] != q_ids[q]]
                        score = np.sqrt(((own[found] - queries[q]) ** 2).sum(axis=1))
                        best = np.lexsort((ids[found], score))[:k]
                        columns = {"query_id": np.full(len(best), q_ids[q]), "vec_id": ids[found[best]], "score": score[best]}
                        yield from as_table(columns, out).to_batches()

    near = pairs.mapInArrow(run, kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
