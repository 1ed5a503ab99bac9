"""Quality rules by host: rule failures of documents, pooled by host, shrunk, and joined back.

Every document is measured in one pass over its whole text. Its base rules decide alone. The
softer rules only count against a document whose host fails them in most of its documents:
the failure rate of a host is shrunk towards the rate of all hosts by a beta prior fitted to
them, so that a host of few documents is not judged by them alone. The fit is by moments of the
beta-binomial: hosts weigh as their documents, and what their rates would differ by chance alone
is taken off what they do differ by. Hosts that differ no more than by chance, or of one document
each, say nothing of how hosts differ: all then get the common rate. A prior counts as one document
at least. The host is the column `source`
unless another is named.

A text of any length is measured whole: texts share a run of 1 MB, a longer one is a run of its
own and takes some 40 times its bytes in the task.

Defined results: a null or empty text has no words and fails the base rules; a null host is a
host of its own; repeated rows count as often as they occur; no rows give no rows. Only the
named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.tables import arrow_schema, as_table, fresh, plus
from wayline.llm.words import SPACED, U64, covered, mix, per_row, repeated, span_codes, rolling, words_of
from wayline.session import materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_pct: int = 50
    #: soft rules, in percent
    max_symbol_pct: int = 10
    max_soft_repeat_pct: int = 30
    max_dup_lines: int = 2
    #: a host is rejected from this shrunk failure rate on
    host_rate: float = 0.5


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of each text of a column."""
    out = {name: np.zeros(len(column), np.int64) for name in MEASURES}
    for w in words_of(column):
        at = slice(w.first, w.first + w.n_rows)
        out["n_words"][at] = w.counts
        out["word_chars"][at] = per_row(SPACED[w.data] & (w.data & 0xC0 != 0x80), w.rows)
        out["n_symbols"][at] = per_row(_SYMBOL[w.data], w.rows)
        breaks = np.flatnonzero(w.data == 10)
        edges = np.unique(np.concatenate([breaks + 1, w.rows]))
        begin, end = edges[:-1], edges[1:]
        end = end - (w.data[end - 1] == 10)
        begins = np.zeros(len(w.data), bool)
        begins[w.starts] = True
        full = per_row(begins, edges) > 0
        begin, end = begin[full], end[full]
        row = np.searchsorted(w.rows, begin, "right") - 1
        again, _ = repeated(span_codes(w.data, begin, end) + mix(row.astype(U64)))
        out["n_dup_lines"][at] = np.bincount(row[again], minlength=w.n_rows)
        row, places = w.row, w.windows(3)
        _, shared = repeated(rolling(w.codes(), 3)[places] + mix(row[places].astype(U64)))
        out["n_repeat_words"][at] = np.bincount(row[covered(len(row), places[shared], 3)], minlength=w.n_rows)
    return out


def with_measures(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """All columns of the documents, and the measures under names the documents don't have."""
    names = {m: fresh(docs, f"q_{m}") for m in MEASURES}
    kinds = plus(docs.schema, **{name: "bigint" for name in names.values()})

    def run(batches):
        for batch in batches:
            found = measure(batch.column(batch.schema.get_field_index(text)))
            arrays = [*batch.columns, *[pa.array(found[m], pa.int64()) for m in names]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names.values()])

    return docs.mapInArrow(run, kinds), names


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, host and MEASURES of each document."""
    schema = ", ".join(["id string", "host string", *[f"{m} bigint" for m in MEASURES]])
    kind = docs.schema[id_col].dataType.simpleString()
    schema = schema.replace("id string", f"id {kind}", 1)
    arrow = arrow_schema(schema)
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{host_col}`"].cast("string").alias("host"), docs[f"`{text_col}`"].alias("text"))

    def run(batches):
        for b in batches:
            columns = {"id": b.column(0), "host": b.column(1), **measure(b.column(2))}
            yield from as_table(columns, arrow).to_batches()

    return narrow.mapInArrow(run, schema)


def base_failed(rules: Rules, c: dict[str, Column]) -> Column:
    return (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_pct * c["n_words"])


def soft_failed(rules: Rules, c: dict[str, Column]) -> Column:
    return (
        (100 * c["n_symbols"] > rules.max_symbol_pct * c["word_chars"])
        | (100 * c["n_repeat_words"] > rules.max_soft_repeat_pct * c["n_words"])
        | (c["n_dup_lines"] > rules.max_dup_lines)
    )


#: Strength of a prior, in documents, that counts as hosts all alike.
STRONGEST = 1e6


def prior(hosts: int, docs: float, failed: float, docs_squared: float, failed_squared_by_docs: float) -> tuple[float, float]:
    """Mean and strength (in documents) of the beta prior, from sums over hosts: of n, x, n * n and x * x / n."""
    if docs == 0:
        return 0.0, STRONGEST
    mean = failed / docs
    chance, spread = mean * (1 - mean), failed_squared_by_docs - failed * failed / docs
    # expected spread: chance * (hosts - 1 + correlation * room), correlation = 1 / (1 + strength)
    room = docs - docs_squared / docs - (hosts - 1)
    if chance <= 0 or room <= 1e-9 * docs:
        return mean, STRONGEST
    correlation = (spread / chance - (hosts - 1)) / room
    return mean, min(max(1 / correlation - 1, 1.0), STRONGEST) if correlation > 0 else STRONGEST


def host_verdicts(measured: DataFrame, rules: Rules) -> DataFrame:
    """host, host_docs, host_failed, host_rate, host_rejected; one row per host, null host included.

    The totals are written; five sums for the prior reach the driver.
    """
    c = {m: F.col(m) for m in MEASURES}
    failed = base_failed(rules, c) | soft_failed(rules, c)
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(failed.cast("long")).alias("host_failed"))
    hosts = materialize(hosts, "hosts")
    x, n = F.col("host_failed").cast("double"), F.col("host_docs").cast("double")
    sums = hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(x), F.sum(n * n), F.sum(x * x / n)).first()
    mean, strength = prior(*[v or 0 for v in sums])
    rate = (F.col("host_failed") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate >= rules.host_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row per document: its id, MEASURES, host figures, base_failed, soft_failed and kept.

    The measured rows (no texts) are written once to the shared folder: the host totals and
    the join back read them there. Verdicts are joined by host; Spark broadcasts them if
    their written size allows, and else splits a hot host's rows.
    """
    measured = materialize(measures(docs, id_col, text_col, host_col), "measures")
    hosts = host_verdicts(measured, rules)
    c = {m: measured[m] for m in MEASURES}
    joined = measured.join(hosts, measured["host"].eqNullSafe(hosts["host"]), "left")
    bad, soft = base_failed(rules, c), soft_failed(rules, c)
    return joined.select(
        measured["id"].alias("doc_id"),
        *[c[m] for m in MEASURES],
        bad.alias("base_failed"),
        (~bad & ~(hosts["host_rejected"] & soft)).alias("kept"),
        soft.alias("soft_failed"),
        hosts["host_rejected"],
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns.

    Two passes over the texts (host totals; verdicts) instead of one pass and a join of whole
    texts on their id: no text is shuffled.
    """
    hosts = host_verdicts(measures(docs, id_col, text_col, host_col), rules)
    measured, names = with_measures(docs, text_col)
    c = {m: measured[f"`{n}`"] for m, n in names.items()}
    kept = measured.where(~base_failed(rules, c))
    suspects = hosts.where("host_rejected").select(hosts["host"].alias(fresh(measured, "q_host")))
    host = measured[f"`{host_col}`"].cast("string").eqNullSafe(suspects[suspects.columns[0]])
    kept = kept.join(suspects, host & soft_failed(rules, c), "left_anti")
    return kept.select(*[kept[f"`{name}`"] for name in docs.columns])
