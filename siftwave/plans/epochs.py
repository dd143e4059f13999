"""Text classifier trained by epochs; the epoch with the best validation score is kept.

Multinomial logistic regression over hashed words and word pairs. Every epoch starts
from the weights of the one before. Spark sums the gradient over the training rows,
in the tasks first; the step itself works on one weight per feature and label. After
each epoch the validation rows are predicted and written, one folder per epoch, so
scores and the choice can be computed again from that table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.similarity import tokens
from ..functions.text import let
from ..session import cut, shared_folder
from .evaluate import metrics

FEATURES = 1 << 14
EPOCHS = 12
RATE = 2.0
DECAY = 1e-6
LABELS = len(fv.LABELS)


@dataclass
class Trained:
    weights: np.ndarray  # (features + 1, labels) of the best epoch; the last row is the bias
    epoch: int
    predictions: str  # folder of (epoch, id, expected, predicted) of the validation rows
    scores: list[float]  # macro F1 of each epoch


def hashed_terms(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``terms``: the distinct hashed words and pairs of neighbouring words of ``text``."""

    def terms(words):
        pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.transform(F.concat(words, pairs), lambda t: F.pmod(F.xxhash64(t), F.lit(FEATURES)).cast("int")))

    return rows.select(*columns, let(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")), terms).alias("terms"))


def probabilities(weights: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(shares, row, term, value)``: label shares of each list of terms, and the lists as a sparse matrix of unit rows."""
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    size = np.asarray(terms.value_lengths()).astype(np.int64)
    row, term = np.repeat(np.arange(len(size)), size), np.asarray(terms.flatten()).astype(np.int64)
    value = 1 / np.sqrt(np.maximum(size, 1))[row]
    scores = np.stack([np.bincount(row, weights=weights[term, k] * value, minlength=len(size)) for k in range(weights.shape[1])], axis=1) + weights[-1]
    shares = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(size) else scores
    return shares / shares.sum(axis=1, keepdims=True), row, term, value


def _gradient(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(weights)
        for batch in batches:
            shares, row, term, value = probabilities(weights, batch.column("terms"))
            labels = np.asarray(batch.column("label_id"))
            shares[np.arange(len(labels)), labels] -= 1
            for k in range(weights.shape[1]):
                total[:-1, k] += np.bincount(term, weights=shares[row, k] * value, minlength=len(weights) - 1)
            total[-1] += shares.sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "g"])

    return run


def predict(weights: np.ndarray, rows: DataFrame) -> DataFrame:
    """``(id, normal, spam, scam, predicted)`` of ``rows(id, text)``; of equal shares the first label counts."""
    return predict_terms(weights, hashed_terms(rows, "id"))


def predict_terms(weights: np.ndarray, rows: DataFrame) -> DataFrame:
    """The same of ``rows(id, terms, ...)``; further columns stay."""

    def run(terms: pa.Array) -> pa.Array:
        shares = probabilities(weights, terms)[0]
        return pa.array(shares.tolist(), pa.list_(pa.float64()))

    more = [c for c in rows.columns if c not in ("id", "terms")]
    told = rows.select("id", *more, F.arrow_udf(run, "array<double>")("terms").alias("p"))
    names = F.array(*[F.lit(x) for x in fv.LABELS])
    best = F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))
    return told.select("id", *[F.element_at("p", k + 1).alias(name) for k, name in enumerate(fv.LABELS)], best.alias("predicted"), *more)


def train_by_epochs(train_rows: DataFrame, val_rows: DataFrame, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Trained:
    """Best of ``epochs`` epochs over rows ``(id, text, label_id)``; of equal scores the earliest counts. Without validation rows the last one."""
    spark = train_rows.sparkSession
    ready, checked = cut(hashed_terms(train_rows, "label_id")), cut(hashed_terms(val_rows, "id", "label_id"))  # words are hashed once, not in every epoch
    n = max(1, ready.count())
    weights = np.zeros((FEATURES + 1, LABELS))
    squares = np.zeros_like(weights)
    folder = f"{shared_folder(spark).rstrip('/')}/epochs-{uuid.uuid4().hex}"
    names = F.array(*[F.lit(x) for x in fv.LABELS])
    best, scores, held = 0, [], not checked.isEmpty()
    kept = weights
    for epoch in range(1, epochs + 1):
        sums = ready.mapInArrow(_gradient(weights), "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).toArrow()  # one number per weight
        gradient = np.zeros(weights.size)
        gradient[np.asarray(sums.column("at").combine_chunks()).astype(np.int64)] = np.asarray(sums.column("g").combine_chunks())
        gradient = gradient.reshape(weights.shape) / n + decay * weights
        squares = squares + gradient * gradient
        weights = weights - rate * gradient / (np.sqrt(squares) + 1e-10)
        if held:
            said = (F.array_position(names, F.col("predicted")) - 1).cast("int").alias("predicted")
            predict_terms(weights, checked).select("id", F.col("label_id").alias("expected"), said).write.parquet(f"{folder}/epoch={epoch}")
            scores.append(metrics(spark.read.parquet(f"{folder}/epoch={epoch}")).first()["macro_f1"])
        if not held or not best or scores[-1] > scores[best - 1]:
            best, kept = epoch, weights
    return Trained(kept, best, folder, scores)
