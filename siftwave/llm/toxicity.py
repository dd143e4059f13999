"""Toxicity by a factorization machine over hashed terms.

    logit = w0 + sum of w_i + sum over i < j of <v_i, v_j>      (i, j: terms of the text)

The factors learn what pairs of terms mean together, such as an insult beside a
mention of a group, which a sum of single weights can't. All terms are hashed into a
table of ``TERMS`` places; none is left out for what it tells on its own.

Spark counts the terms by class over all labelled texts that aren't held out. A
term's weight starts at the logarithm of the classes' shares, as far as its counts
are surer than chance would make one of so many terms (``sure_weights``). The fit, by
numpy on a sample of at most about ``bound / 2`` texts of each class, moves weights and
factors from there as far as the labels outweigh a Gaussian prior, so a few dozen
positive texts aren't learnt by heart. The bias is set right for the classes' shares
in the sample. Scoring reads every whole text in the scan's tasks and shuffles nothing.

Null and empty texts have no terms and get the score of the bias alone. Without
labels of both classes the score is their share (0 without labels). Repeated rows
get the same score. Language, source, id and labels are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Labelled, held_out, labelled, matrix, score_column
from .tables import packed, unpacked

BOUND = 8_000  # labelled rows the fit sees at most
TERMS = 1 << 17
FACTORS = 8
THRESHOLD = 0.7
SPREAD = 0.5  # of weights and factors around where they start


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def logits(m: Machine, row: np.ndarray, index: np.ndarray, rows: int) -> np.ndarray:
    out = np.full(rows, m.bias) + np.bincount(row, weights=m.weights[index], minlength=rows)
    for f in range(m.factors.shape[1]):
        v = m.factors[index, f]
        out += 0.5 * (np.bincount(row, weights=v, minlength=rows) ** 2 - np.bincount(row, weights=v * v, minlength=rows))
    return out


def scores(m: Machine, row: np.ndarray, index: np.ndarray, rows: int) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(m, row, index, rows), -30, 30)))


def sure_weights(ones: np.ndarray, zeros: np.ndarray, n_ones: int, n_zeros: int) -> np.ndarray:
    """Log ratio of each term's shares in the classes, shrunk by how far its chi-square exceeds what chance reaches among all terms."""
    if not n_ones or not n_zeros or not len(ones):
        return np.zeros(len(ones))
    ratio = np.log((ones + 0.5) / (n_ones + 1)) - np.log((zeros + 0.5) / (n_zeros + 1))
    share = (ones + zeros) / (n_ones + n_zeros)
    spread = share * (1 - share) * (1 / n_ones + 1 / n_zeros)
    square = np.divide((ones / n_ones - zeros / n_zeros) ** 2, spread, out=np.zeros(len(ones)), where=spread > 0)
    chance = 2 * np.log(max(2, int((ones + zeros > 0).sum())))
    return ratio * np.maximum(0, 1 - chance / np.maximum(square, 1e-12))


def fit(row: np.ndarray, index: np.ndarray, label: np.ndarray, terms: int, factors: int = FACTORS, epochs: int = 10, batch: int = 512, rate: float = 0.2, spread: float = SPREAD, start: np.ndarray | None = None, seed: int = 5) -> Machine:
    """Log loss with a Gaussian prior around ``start``, by mini-batches with momentum, steps scaled by the usual size of the whole gradient; ``row`` is sorted."""
    n = len(label)
    share = float(label.mean()) if n else 0.0
    bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (-30.0 if share == 0 else 30.0)
    random = np.random.default_rng(seed)
    if not 0 < share < 1 or not terms:
        return Machine(bias, np.zeros(max(1, terms)), np.zeros((max(1, terms), factors)))
    used, own = np.unique(index, return_inverse=True)  # only terms of the sample are moved
    prior = np.zeros((len(used), factors + 1))
    if start is not None:
        prior[:, 0] = start[used]
    theta = prior.copy()
    theta[:, 1:] = random.normal(0, 0.02, (terms, factors))[used]
    first = np.searchsorted(row, np.arange(n + 1))
    mean, square, step = np.zeros_like(theta), np.zeros(2), 0
    bias_mean = bias_square = 0.0
    for _ in range(epochs):
        order = random.permutation(n)
        for a in range(0, n, batch):
            docs = order[a : a + batch]
            length = first[docs + 1] - first[docs]
            at = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            r, i = np.repeat(np.arange(len(docs)), length), own[at]
            full = np.flatnonzero(length)
            begins = (np.cumsum(length) - length)[full]
            v = theta[i]
            sums, squares = np.zeros((len(docs), factors + 1)), np.zeros(len(docs))
            if len(full):
                sums[full] = np.add.reduceat(v, begins)
                squares[full] = np.add.reduceat((v[:, 1:] * v[:, 1:]).sum(1), begins)
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[docs]) / len(docs)
            pull = sums[r] - v
            pull[:, 0] = 1
            pull *= error[r][:, None]
            by_term = np.argsort(i, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(i[by_term]) != 0)) if len(i) else np.zeros(0, np.int64)
            grad = (theta - prior) / (n * spread * spread)
            if len(i):
                grad[i[by_term[heads]]] += np.add.reduceat(pull[by_term], heads)
            step += 1
            sizes = np.array([(grad[:, 0] ** 2).sum(), (grad[:, 1:] ** 2).sum()])
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * sizes
            scale = rate / (np.sqrt(square / (1 - 0.99**step)) + 1e-12) / (1 - 0.9**step)
            theta[:, 0] -= scale[0] * mean[:, 0]
            theta[:, 1:] -= scale[1] * mean[:, 1:]
            g = float(error.sum())
            bias_mean, bias_square = 0.9 * bias_mean + 0.1 * g, 0.999 * bias_square + 0.001 * g * g
            bias -= rate * (bias_mean / (1 - 0.9**step)) / (np.sqrt(bias_square / (1 - 0.999**step)) + 1e-8)
    weights, every = np.zeros(terms) if start is None else start.copy(), np.zeros((terms, factors))
    weights[used], every[used] = theta[:, 0], theta[:, 1:]
    return Machine(bias, weights, every)


def fitted(data: Labelled, terms: int) -> Machine:
    """A machine for the classes' true shares."""
    if not data.ones or not data.zeros:
        return Machine(30.0 if data.ones else -30.0, np.zeros(terms), np.zeros((terms, FACTORS)))
    start = sure_weights(data.term_ones, data.term_zeros, data.ones, data.zeros)
    machine = fit(*matrix(data.sampled, terms), terms=terms, start=start)
    machine.bias += float(np.log(data.shares[1] / data.shares[0]))  # the sample may hold more of one class
    return machine


def judge_toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = BOUND, terms: int = TERMS, threshold: float = THRESHOLD) -> DataFrame:
    """``(row, held_out, score, predicted)`` of every document; the model is fitted on labelled rows of ``train_docs``."""
    machine = fitted(labelled(train_docs, labels, id_col, text_col, label_col, bound, terms), terms)
    texts = packed(docs, id_col, text_col)
    scored = texts.select("row", held_out(f"row.{id_col}").alias("held_out"), score_column(docs.sparkSession, terms, machine, scores, F.col("body")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def remove_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't predicted toxic, as they are."""
    return unpacked(judge_toxicity(docs, train_docs, labels, **options).filter("predicted = 0"))
