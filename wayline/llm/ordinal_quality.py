"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature gives a document its latent quality s; ordered thresholds
t0 < t1 < ... cut it into grades: P(grade <= j) = sigmoid(t_j - s). All grades share the weights.
Results are the expected grade and the probability of the wanted grade or a better one.

Features of a text, each present or not: its distinct words; the bytes that at least a twentieth
of its words end with; the tenth that its share of distinct words lies in; the power of two of
its length. Only features whose presence depends on the grade (chi squared, over the sample)
get a weight: the rest add noise.

The fit uses at most `max_rows` rated documents, those of the smallest hash of their id. Their
features are kept in `PARTS` parts; a round fits each part from the common weights on (adaptive
gradient steps) and averages the results. Scoring is one pass over all documents.

Defined results: null ratings and rated ids without a document are not used; the lowest of
several ratings of an id holds; grades are any whole numbers, fitted by their rank; with one grade
only, every document gets it; without any ratings nothing is known, and scores are null; a null or
empty text has the features of its length only; a text of any length is read whole (texts share a
run of 1 MB, a longer one is a run of its own); repeated rows are scored each, and used each where
their id is rated; no rows give none. Only the named columns are read, so extra columns
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.tables import arrow_schema, as_table
from wayline.llm.words import ALPHANUMERIC, U64, mix, words_of
from wayline.session import materialize

FEATURE_BITS = 17
PARTS = 8


@dataclass(frozen=True)
class Fit:
    #: bound of the rated documents used
    max_rows: int = 20_000
    min_documents: int = 5
    min_chi_squared: float = 30.0
    rounds: int = 10
    epochs: int = 5
    step: float = 0.1
    threshold_step: float = 0.03
    seed: int = 5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray = field(repr=False)
    thresholds: np.ndarray
    #: the grades in ascending order, one more than thresholds
    grades: tuple[int, ...]

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > j) for every threshold j."""
        return 1 - _sigmoid(self.thresholds[None] - latent[:, None])

    def expected(self, latent: np.ndarray) -> np.ndarray | list[None]:
        """The mean grade, null without a model."""
        return self.grades[0] + self.tails(latent) @ np.diff(self.grades) if self.grades else [None] * len(latent)

    def at_least(self, latent: np.ndarray, grade: int) -> np.ndarray | list[None]:
        """Probability of the grade or a better one, null without a model."""
        below = sum(g < grade for g in self.grades)
        if not self.grades:
            return [None] * len(latent)
        if below in (0, len(self.grades)):
            return np.full(len(latent), float(below == 0))
        return self.tails(latent)[:, below - 1]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes >> U64(64 - FEATURE_BITS)).astype(np.int64)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, features), distinct and sorted by row, a run of rows at a time."""
    for w, v in zip(words_of(column, ALPHANUMERIC, lower=True), words_of(column)):
        n, width = w.n_rows, 1 << FEATURE_BITS
        words = np.unique(w.row * width + _bucket(w.codes()))
        distinct = np.bincount(words // width, minlength=n)
        ends = np.bincount(v.row * 256 + v.data[v.ends - 1], minlength=n * 256).reshape(n, 256)
        row, last = np.nonzero((ends > 0) & (ends * 20 >= v.counts[:, None]))
        spread = 10 * distinct // np.maximum(1, w.counts)
        length = np.log2(w.counts + 1).astype(np.int64)
        style = np.concatenate([1000 + last, 3000 + spread, 4000 + length]).astype(U64)
        owner = np.concatenate([row, np.arange(n), np.arange(n)])
        pairs = np.unique(np.concatenate([words, owner * width + _bucket(mix(style))]))
        yield w.first, n, pairs // width, pairs % width


def _sample(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, grade_col: str, fit: Fit) -> DataFrame:
    """part, doc_id, grade and features of the rated documents used."""
    rated = ratings.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{grade_col}`").cast("int").alias("grade"))
    rated = rated.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    used = rated.orderBy(F.xxhash64("doc_id", F.lit(fit.seed)), "doc_id").limit(fit.max_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # max_rows rows at most
    texts = texts.join(F.broadcast(used), "doc_id").select("doc_id", "grade", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    out = arrow_schema(kinds := f"doc_id {kind}, grade int, features array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, feature in features(batch.column(2)):
                bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))
                columns = {"doc_id": batch.column(0).slice(first, n), "grade": batch.column(1).slice(first, n)}
                yield from as_table(columns | {"features": lists.cast(out.field("features").type)}, out).to_batches()

    rows = texts.mapInArrow(run, kinds)
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(fit.seed + 1)), F.lit(PARTS)).cast("int"))


def _screened(sample: DataFrame, fit: Fit) -> tuple[np.ndarray, tuple[int, ...]]:
    """Features that depend on the grade, and the grades. At most 2**FEATURE_BITS numbers reach the driver."""
    sizes = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    grades = tuple(sorted(sizes))
    if len(grades) < 2:
        return np.empty(0, np.int64), grades
    total = sum(sizes.values())
    seen = sample.select("grade", F.explode("features").alias("feature"))
    counts = seen.groupBy("feature").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.count(F.when(F.col("grade") == g, 1)).cast("double").alias(f"g{i}") for i, g in enumerate(grades)],
    )
    chi = sum(((F.col(f"g{i}") - F.col("n") * (sizes[g] / total)) ** 2) / (F.col("n") * (sizes[g] / total)) for i, g in enumerate(grades))
    rare = F.greatest(1 - F.col("n") / total, F.lit(1e-6))
    kept = counts.where((F.col("n") >= fit.min_documents) & (chi / rare >= fit.min_chi_squared))
    return np.sort(np.array([r[0] for r in kept.select("feature").collect()], np.int64)), grades


def train_part(rows: list[tuple[int, np.ndarray]], state: np.ndarray, n_features: int, fit: Fit, seed: int) -> np.ndarray:
    """Weights, their squared gradient sums and thresholds after some epochs over the rows."""
    state = state.copy()
    weights, squares, cuts = state[:n_features], state[n_features : 2 * n_features], state[2 * n_features :]
    order = np.random.default_rng(seed)
    for _ in range(fit.epochs):
        for i in order.permutation(len(rows)):
            grade, own = rows[i]
            s = weights[own].sum()
            low = _sigmoid(cuts[grade - 1] - s) if grade > 0 else 0.0
            high = _sigmoid(cuts[grade] - s) if grade < len(cuts) else 1.0
            p = max(high - low, 1e-9)
            slope_low, slope_high = low * (1 - low) / p, high * (1 - high) / p
            g = slope_high - slope_low
            squares[own] += g * g
            weights[own] -= fit.step * g / np.sqrt(squares[own])
            if grade > 0:
                cuts[grade - 1] -= fit.threshold_step * slope_low
            if grade < len(cuts):
                cuts[grade] += fit.threshold_step * slope_high
            np.maximum.accumulate(cuts, out=cuts)
    return state


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", fit: Fit = Fit()) -> Model:
    """Fit weights and thresholds to ratings (id, grade)."""
    sample = materialize(_sample(docs, ratings, id_col, text_col, grade_col, fit), "rated")
    used, grades = _screened(sample, fit)
    n = len(used)
    if len(grades) < 2:
        return Model(np.zeros(1 << FEATURE_BITS), np.empty(0), grades)
    state, rank = np.concatenate([np.zeros(n), np.full(n, 1e-8), np.linspace(-1, 1, len(grades) - 1)]), {g: i for i, g in enumerate(grades)}
    out = arrow_schema(kinds := "part int, n long, state binary")

    def round_of(state: np.ndarray, turn: int):
        def run(part: pa.Table) -> pa.Table:
            part, rows = part.combine_chunks().sort_by("doc_id"), []
            for grade, own in zip(part["grade"].to_pylist(), part["features"]):
                own = own.values.to_numpy()
                at = np.minimum(np.searchsorted(used, own), max(0, n - 1))
                rows.append((rank[grade], at[used[at] == own] if n else at[:0]))
            number = part["part"][0].as_py()
            new = train_part(rows, state, n, fit, fit.seed + 1000 * turn + number)
            return as_table({"part": [number], "n": [len(rows)], "state": [new.tobytes()]}, out)

        return run

    for turn in range(fit.rounds):
        # PARTS states, each as large as the screened features
        found = sorted(sample.groupBy("part").applyInArrow(round_of(state, turn), kinds).collect())
        total = sum(r["n"] for r in found)
        state = sum(np.frombuffer(r["state"]) * (r["n"] / total) for r in found)
    weights = np.zeros(1 << FEATURE_BITS)
    weights[used] = state[:n]
    return Model(weights, state[2 * n :], grades)


def score(docs: DataFrame, model: Model, tail: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, latent, expected_grade and tail_probability (of grade `tail` or better)."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = arrow_schema(kinds := f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, latent double, expected_grade double, tail_probability double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, feature in features(batch.column(1)):
                latent = np.bincount(row, weights=model.weights[feature], minlength=n)
                expected, wanted = model.expected(latent), model.at_least(latent, tail)
                columns = {"doc_id": batch.column(0).slice(first, n), "latent": latent}
                yield from as_table(columns | {"expected_grade": expected, "tail_probability": wanted}, out).to_batches()

    return narrow.mapInArrow(run, kinds)
