"""Importance resampling towards a target corpus, by hashed word runs.

Features of a text are its runs of 1 to `longest` words, each hashed by CRC-32 into buckets. The
CRC of all runs of a megabyte of text comes from a table by byte and distance from the run's end
(`crc_tables`). The counts of all buckets, over all documents and all target texts, give each
bucket a gain (how much commoner the target has it); a document's weight is the mean gain of its
features, and adding Gumbel noise from a hash of the id makes the highest scores a draw without
replacement by the weights.

On Spark: a task adds up the counts of its texts and sends at most one row a bucket; the counts
(as many as buckets, whatever the input) make the gains, which go to the tasks of the second
pass. What that pass keeps of a document is four numbers. Ranks come from a range partitioning by
score, the place in a partition and the sizes of the partitions before it: no row is compared in
one task with all others, and rows that are equal in all else are spread by their place.

Defined results: a null text has no words; no features give weight 0; a null id hashes as an empty
string and is ranked behind equal scores; rows of equal id have equal noise and are drawn each,
ties by the text's hash; null target texts add nothing, no target texts leave all gains to
smoothing; a text of any length is read whole (runs of 1 MB, a longer text is a run of its own, at
some 40 bytes a byte of it in the task); no documents give none. Only the named columns are read,
so extra columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.crc_tables import gram_codes
from wayline.llm.tables import arrow_schema, as_table, fresh, plus
from wayline.llm.words import ALPHANUMERIC, Words, per_row, words_of
from wayline.session import constant_frame, materialize


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    longest: int = 2
    seed: int = 7
    #: documents of so many words are drawn from, and this part of them is drawn
    least_words: int = 20
    draw_pct: int = 25


def _buckets(words: Words, how: Resampling) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First words and buckets of all runs of 1, 2 … words."""
    lengths = words.ends - words.starts
    n = len(lengths)
    if not n:
        return
    inside = np.zeros(len(words.data) + 1, np.int32)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    bytes_of_words = words.data[np.cumsum(inside[:-1]) > 0]
    spaced = np.full(len(bytes_of_words) + n, 32, np.uint8)
    spaced[np.arange(len(bytes_of_words)) + np.repeat(np.arange(n), lengths)] = bytes_of_words
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    for k, codes in enumerate(gram_codes(spaced, starts, how.longest), 1):
        places = words.windows(k)
        yield places, (codes[places] % np.uint32(how.buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", how: Resampling = Resampling()) -> DataFrame:
    """bucket, n: features of all texts in a bucket, for the buckets that have any."""
    sent = arrow_schema(kinds := "bucket long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(how.buckets, np.int64)
        for batch in batches:
            for words in words_of(batch.column(0), ALPHANUMERIC, lower=True):
                for _, found in _buckets(words, how):
                    sums += np.bincount(found, minlength=how.buckets)
        some = np.flatnonzero(sums)
        yield from as_table({"bucket": some, "n": sums[some]}, sent).to_batches()

    rows = texts.select(texts[f"`{text_col}`"].cast("string").alias("text"))
    return rows.mapInArrow(count, kinds).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", how: Resampling = Resampling()) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target and in the documents, each smoothed by one."""

    def counts(texts: DataFrame, column: str) -> list[int]:
        out = [0] * how.buckets
        for bucket, n in bucket_counts(texts, column, how).collect():  # at most a row a bucket
            out[bucket] = n
        return out

    s, t = counts(docs, text_col), counts(target, target_text_col)
    all_s, all_t = sum(s) + how.buckets, sum(t) + how.buckets
    return np.array([math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", how: Resampling = Resampling()) -> DataFrame:
    """The id column, n_words, n_features, weight."""
    rows = docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"].cast("string").alias("text_" if id_col == "text" else "text"))
    out = plus(rows.select(f"`{id_col}`").schema, n_words="long", n_features="long", weight="long", text_code="long")
    sent = arrow_schema("n_words long, n_features long, weight long, text_code long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1), ALPHANUMERIC, lower=True):
                sums, n = np.zeros(words.n_rows, np.int64), np.zeros(words.n_rows, np.int64)
                for places, found in _buckets(words, how):
                    at = np.zeros(len(words.starts), np.int64)
                    at[places] = gains[found]
                    sums += per_row(at, words.bounds)
                    at[:] = 0
                    at[places] = 1
                    n += per_row(at, words.bounds)
                # tells rows of one id apart, whose texts differ in words
                code = per_row((words.codes() >> np.uint64(1)).view(np.int64), words.bounds)
                columns = {"n_words": words.counts.astype(np.int64), "n_features": n, "weight": sums // np.maximum(n, 1), "text_code": code}
                ids = batch.column(0).slice(words.first, words.n_rows)
                yield from as_table(columns, sent).add_column(0, pa.field(id_col, ids.type), ids).to_batches()

    return rows.mapInArrow(run, out)


def _ranked(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """Rows with their place (from 1) in the order of the keys."""
    part, at = fresh(rows, "part"), fresh(rows, "at")
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the id of a row is its partition's number, then its place there
    place = F.monotonically_increasing_id()
    placed = materialize(placed.select("*", F.shiftright(place, 33).alias(part), place.bitwiseAND((1 << 33) - 1).alias(at)), "placed")
    sizes = sorted((p, n) for p, n in placed.groupBy(part).agg(F.count(F.lit(1))).collect())  # a row a partition
    before, done = [], 0
    part_, first = fresh(placed, "part_"), fresh(placed, "first")
    for p, n in sizes:
        before.append({part_: p, first: done})
        done += n
    offsets = constant_frame(rows.sparkSession, before, T.StructType.fromDDL(f"`{part_}` long, `{first}` long"))
    joined = placed.join(offsets, placed[part] == offsets[part_])
    return joined.withColumn(name, F.col(first) + F.col(at) + 1).drop(part, at, part_, first)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", how: Resampling = Resampling()
) -> DataFrame:
    """The id column, n_features, weight, score, rank (null where not drawn)."""
    gains = bucket_gains(docs, target, text_col, target_text_col, how)
    weighed = weigh(docs, gains, id_col, text_col, how)
    id_ = F.col(f"`{id_col}`")
    key = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")
    spread = F.xxhash64(F.monotonically_increasing_id())
    scored = weighed.select("*", (F.col("weight") + noise).alias("score"), spread.alias("spread"))
    scored = materialize(scored, "scored")
    enough = F.col("n_words") >= how.least_words
    drawn = scored.where(enough).count() * how.draw_pct // 100
    ranked = _ranked(scored.where(enough), [F.col("score").desc(), id_.asc_nulls_last(), F.col("text_code"), F.col("spread")], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    out = [id_, "n_features", "weight", "score"]
    return ranked.select(*out, rank).unionByName(scored.where(~enough).select(*out, F.lit(None).cast("long").alias("rank")))
