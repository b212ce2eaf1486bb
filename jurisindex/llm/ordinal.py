"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is the sum of the weights of its hashed features.  The chance that its grade is above k is the
logistic function of the score less the k-th threshold; all thresholds share the weights and stand in order.
From them follow the expected grade and the chance of the top grade, by which texts are selected.

The model is fitted on a sample of rated texts of at most SAMPLE_ROWS rows, chosen by hash; every text is
scored.  Weights have an L1 penalty, so those of features that tell nothing are zero.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisindex.llm.features import BITS, features
from jurisindex.llm.words import sliced

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 12_000
KEEP = 0.75
PENALTY, ROUNDS, RARE = 0.003, 250, 3


@dataclass(frozen=True)
class Model:
    """Feature numbers with their weights (all others have none), and the ordered thresholds."""

    numbers: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, offsets: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The chance of a grade above each threshold, a row for each text."""
        dense = np.zeros(1 << BITS)
        dense[self.numbers] = self.weights
        sums = np.concatenate([[0.0], np.cumsum(dense[numbers])])
        score = sums[offsets[1:]] - sums[offsets[:-1]]
        return _logistic(score[:, None] - self.thresholds)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fitted(grade: np.ndarray, offsets: np.ndarray, numbers: np.ndarray) -> Model:
    """The model of rated texts, by accelerated proximal gradient steps on features scaled by how rare they are."""
    n, levels = len(grade), int(grade.max(initial=0))
    above = grade[:, None] > np.arange(levels)
    share = np.clip(above.mean(axis=0), 0.5 / n, 1 - 0.5 / n)
    thresholds = np.log((1 - share) / share)
    counts = np.bincount(numbers, minlength=1 << BITS)
    row = np.repeat(np.arange(n), np.diff(offsets))
    common = counts[numbers] >= RARE
    row, (used, column) = row[common], np.unique(numbers[common], return_inverse=True)
    if not len(used) or not levels:
        return Model(used[:0], np.zeros(0), thresholds)
    scale = np.sqrt(n / counts[used])

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, (scale * w)[column], minlength=n)

    def back(g: np.ndarray) -> np.ndarray:
        return scale * np.bincount(column, g[row], minlength=len(used))

    probe = np.ones(len(used))
    for _ in range(15):
        probe = back(times(probe / np.linalg.norm(probe)))
    step = 1 / (levels * np.linalg.norm(probe) / (4 * n) + 1)
    weight, momentum = np.zeros(len(used)), 1.0
    ahead, ahead_thresholds = weight, thresholds
    for _ in range(ROUNDS):
        error = _logistic(times(ahead)[:, None] - ahead_thresholds) - above
        moved = ahead - step * back(error.sum(axis=1) / n)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_thresholds = np.sort(ahead_thresholds + step * error.mean(axis=0))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        ahead, ahead_thresholds = new + pull * (new - weight), new_thresholds + pull * (new_thresholds - thresholds)
        weight, thresholds, momentum = new, new_thresholds, following
    told = np.flatnonzero(weight)
    return Model(used[told], (weight * scale)[told], thresholds)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        offsets, numbers = features(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(numbers.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), lists], names=["doc_id", "grade", "numbers"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    grade = np.concatenate([b.column("grade").to_numpy() for b in parts])
    sizes = np.concatenate([b.column("numbers").value_lengths().to_numpy() for b in parts])
    numbers = np.concatenate([b.column("numbers").flatten().to_numpy() for b in parts]).astype(np.int64)
    model = fitted(grade, np.concatenate([[0], np.cumsum(sizes)]), numbers)
    yield pa.RecordBatch.from_arrays(
        [pa.array([x]) for x in (model.numbers, model.weights, model.thresholds)], names=["numbers", "weights", "thresholds"])


def fit(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> Model | None:
    """The model of `docs` (doc_id, text) rated by `ratings` (doc_id, grade: 0, 1, ..); None without any.

    A document rated more than once has its lowest grade, of rows with the same doc_id one is taken.  Ratings
    without a grade, or of no document here, count for nothing.  At most `sample_rows` rows are taken and one
    task fits them; what comes back is bounded by the number of features.
    """
    sample = (
        ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id")
        .agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows)
    )
    # The sample has at most `sample_rows` rows.
    rated = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    id_type = rated.schema["doc_id"].dataType.simpleString()
    rows = rated.mapInArrow(_featured, f"doc_id {id_type}, grade int, numbers array<int>")
    one_each = rows.groupBy("doc_id").agg(F.min(F.struct("numbers", "grade")).alias("r")).select("r.grade", "r.numbers")
    found = one_each.repartition(1).mapInArrow(
        _fit, "numbers array<bigint>, weights array<double>, thresholds array<double>").collect()
    if not found:
        return None
    numbers, weights, thresholds = found[0]
    return Model(np.array(numbers, np.int64), np.array(weights, np.float64), np.array(thresholds, np.float64))


def scored(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """`docs` (with text) with expected_grade, p_top (the chance of the top grade) and kept (p_top >= keep).

    A null text counts as an empty one.  Without a model nothing is known: the scores are null and all is
    kept.  Columns of docs with these names are replaced.
    """
    new = ("expected_grade", "p_top", "kept")
    own = docs.select(*[f"`{c}`" for c in docs.columns if c not in new])
    if model is None or not len(model.thresholds):
        null = F.lit(None).cast("double")
        return own.select("*", null.alias("expected_grade"), null.alias("p_top"), F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast((model.numbers, model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent_model = Model(*sent.value)
        for batch in sliced(batches):
            chances = sent_model.chances(*features(batch.column("text")))
            columns = [pa.array(chances.sum(axis=1)), pa.array(chances[:, -1]), pa.array(chances[:, -1] >= keep)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{kinds}, expected_grade double, p_top double, kept boolean")


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels: a point for quality, and one for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores and verdicts of every document, by a model of the labels."""
    texts = docs.select("doc_id", "text")
    return scored(texts, fit(texts, graded(labels))).drop("text")
