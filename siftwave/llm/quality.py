"""Document quality by hierarchical empirical Bayes.

A classifier gives each document a probability from its whole text alone. Sites
share evidence: the documents of a host, and of a path of that host, are summed by
grouped aggregation, and each level is shrunk towards the one above,

    path mean = (sum of the path's probabilities + k_path * host mean) / (n + k_path)
    host mean = (sum of the host's probabilities + k_host * global mean) / (n + k_host)

with strengths ``k`` estimated from how much sites differ beyond chance (a beta
prior by the method of moments). A document's own evidence is taken out of its
site's sums first, so nothing counts twice. Its score joins the log-odds:
evidence of the document plus prior of its path.

The classifier is a logistic regression over binned features of the text, fitted on
a bounded sample of labelled rows; sums, means and strengths cover all documents.

A null host or path is a site of its own. Null and empty texts have the features of
an empty text. Without labels of both classes the evidence is neutral. Repeated
rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Words, pieces, space_words
from .labelled import held_out, sample
from .tables import as_key, packed, stored, unpacked

BOUND = 20_000  # labelled rows the fit sees at most
BINS = 12
THRESHOLD = 0.5
FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "digits", "bang", "pipe", "symbols", "stops", "breaks", "beyond_ascii", "distinct", "doubled", "top_word", "short_words", "spaces"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``(rows, features)`` of whole texts."""
    rows = len(offsets) - 1
    words = Words(data, offsets, space_words())
    size = np.diff(offsets).astype(float)
    n = words.count.astype(float)

    def share(*values: int | range) -> np.ndarray:
        table = np.zeros(256, bool)
        for v in values:
            table[list(v) if isinstance(v, range) else v] = True
        total = np.concatenate([[0], np.cumsum(table[data])])[offsets]
        return np.diff(total) / np.maximum(1, size)

    order = np.lexsort([words.hash, words.row])
    row, h = words.row[order], words.hash[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    top = np.zeros(rows)
    np.maximum.at(top, row[at], times)
    doubled = np.zeros(len(h), bool)
    doubled[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    per_word = lambda x: np.bincount(words.row, weights=x, minlength=rows) / np.maximum(1, n)
    length = words.end - words.start
    columns = [
        np.log1p(size), np.log1p(n), per_word(length), share(range(0x41, 0x5B)), share(range(0x30, 0x3A)), share(0x21), share(0x7C), share(*b"#$%&*<>=@^_~\\{}[]"), share(*b".,;:?"), share(0x0A), share(range(0x80, 0x100)),
        np.bincount(row[at], minlength=rows) / np.maximum(1, n), per_word(doubled), top / np.maximum(1, n), per_word(length < 3), share(0x20),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Classifier:
    edges: np.ndarray  # (features, bins - 1)
    weights: np.ndarray  # (features, bins)
    bias: float
    prior: float  # log-odds of the sample


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[f], x[:, f], "right") for f in range(x.shape[1])], axis=1) + np.arange(x.shape[1]) * (edges.shape[1] + 1)


def fit(x: np.ndarray, label: np.ndarray, bins: int = BINS, ridge: float = 1.0, rounds: int = 15) -> Classifier | None:
    """Logistic regression on one-hot bins by Newton steps; None without both classes."""
    if not len(label) or label.min() == label.max():
        return None
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    cells = _binned(x, edges)
    size = x.shape[1] * bins
    hot = np.zeros((len(x), size + 1))
    hot[np.arange(len(x))[:, None], cells] = 1
    hot[:, size] = 1
    share = label.mean()
    prior = float(np.log(share / (1 - share)))
    theta = np.zeros(size + 1)
    theta[size] = prior
    penalty = np.full(size + 1, ridge)
    penalty[size] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(hot @ theta, -30, 30)))
        gradient = hot.T @ (p - label) + penalty * (theta - np.where(np.arange(size + 1) == size, prior, 0))
        curvature = (hot * (p * (1 - p) + 1e-6)[:, None]).T @ hot + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(edges, theta[:size], float(theta[size]), prior)


def log_odds(c: Classifier, x: np.ndarray) -> np.ndarray:
    return np.clip(c.weights[_binned(x, c.edges)].sum(axis=1) + c.bias, -12, 12)


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    rows = sample(docs, labels, id_col, text_col, label_col, bound)

    def run(texts: pa.Array) -> pa.Array:
        x = [features(d, o) for _, _, d, o in pieces(texts)]
        flat = np.concatenate(x).ravel() if x else np.zeros(0)
        return pa.FixedSizeListArray.from_arrays(pa.array(flat), len(FEATURES)).cast(pa.list_(pa.float64()))

    got = rows.select("label", F.arrow_udf(run, "array<double>")("body").alias("x")).toArrow().combine_chunks()  # `bound` rows
    if not len(got):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    label = np.asarray(got.column("label").combine_chunks()).astype(float)
    order = np.lexsort([label, *x.T])  # sums in one order, so that a fit can be repeated
    return x[order], label[order]


def _strength(sites: DataFrame, mean: float) -> float:
    """Beta prior strength of site means around ``mean``: what they vary more than documents of one site would."""
    within = F.col("n") * F.col("m") * (1 - F.col("m"))
    row = sites.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("m") - mean) * (F.col("m") - mean)).alias("between"), F.sum(within).alias("within"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    n, k = float(row["n"] or 0), int(row["k"] or 0)
    if k < 2 or n <= k:
        return 1e6
    inside = float(row["within"]) / (n - k)
    spread = max(0.0, (float(row["between"]) - (k - 1) * inside) / max(1e-9, n - float(row["nn"]) / n))
    total = max(1e-6, mean * (1 - mean))
    return min(1e6, total / spread) if spread > total * 1e-6 else 1e6


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    bound: int = BOUND,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(key, held_out, host, path, evidence, host_mean, path_mean, score, predicted)``, one row per input row.

    ``key`` is the id as long. ``evidence`` is the document's log-odds against the
    labelled sample's; ``path_mean`` leaves the document itself out.
    """
    classifier = fit(*_sampled(docs, labels, id_col, text_col, label_col, bound))
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(texts: pa.Array) -> pa.Array:
        c = shared.value
        out = [log_odds(c, features(d, o)) if c else np.zeros(len(o) - 1) for _, _, d, o in pieces(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    prior = classifier.prior if classifier else 0.0
    chance = lambda z: 1 / (1 + F.exp(-z))
    rows = docs.select(as_key(id_col).alias("key"), held_out(id_col).alias("held_out"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.arrow_udf(run, "double")(F.col(text_col).cast("string")).alias("z"))
    rows = stored(rows.withColumn("p", chance(F.col("z"))), "evidence")
    blank = F.coalesce(F.col("host"), F.lit("\0")), F.coalesce(F.col("path"), F.lit("\0"))
    keyed = rows.withColumn("h", blank[0]).withColumn("w", blank[1])
    paths = stored(keyed.groupBy("h", "w").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = stored(paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(whole["s"]) / whole["n"] if whole["n"] else 0.5
    k_host = _strength(hosts.select("n", (F.col("s") / F.col("n")).alias("m")), mean)
    k_path = _strength(paths.select("n", (F.col("s") / F.col("n")).alias("m")), mean)
    sites = paths.join(hosts.select("h", F.col("n").alias("hn"), F.col("s").alias("hs")), "h")
    sites = stored(sites, "sites")
    both = keyed.join(sites, ["h", "w"])
    host_mean = (F.col("hs") - F.col("p") + F.lit(k_host * mean)) / (F.col("hn") - 1 + F.lit(k_host))
    path_mean = (F.col("s") - F.col("p") + F.lit(k_path) * F.col("host_mean")) / (F.col("n") - 1 + F.lit(k_path))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    both = both.withColumn("host_mean", inside(host_mean)).withColumn("path_mean", inside(path_mean))
    both = both.withColumn("evidence", F.col("z") - F.lit(prior))
    both = both.withColumn("score", chance(F.col("evidence") + F.log(F.col("path_mean") / (1 - F.col("path_mean")))))
    return both.select("key", "held_out", "host", "path", "evidence", "host_mean", "path_mean", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents predicted to be of good quality, as they are. Of rows that repeat an id all stay if any is good."""
    good = judge_quality(docs, labels, host, path, id_col, text_col, **options).filter("predicted = 1").select("key").distinct()
    return unpacked(packed(docs, id_col, text_col).select("row", "key").join(good, "key", "left_semi"))
