"""Metrics of predictions and a text classifier on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.decision import argmax_label
from ..functions.similarity import tokens
from ..functions.text import mask_normalized
from ..session import cut


def confusion(pairs: DataFrame) -> DataFrame:
    """``(expected, predicted, n)``."""
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def _scores(cells: DataFrame, n_labels: int) -> DataFrame:
    labels = cells.sparkSession.range(n_labels).select(F.col("id").cast("int").alias("label"))
    hits = cells.filter("expected = predicted").select(F.col("expected").alias("label"), F.col("n").alias("tp"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    real = cells.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("real"))
    joined = labels.join(hits, "label", "left").join(said, "label", "left").join(real, "label", "left")
    f1 = F.coalesce(2 * F.col("tp") / (F.col("said") + F.col("real")), F.lit(0.0))
    return joined.select("label", f1.alias("f1"))


def label_scores(pairs: DataFrame, n_labels: int = len(fv.LABELS)) -> DataFrame:
    """``(label, f1)`` for labels ``0 .. n_labels-1``; 0 without a true positive.

    Computed from the confusion counts, at most ``n_labels`` squared rows.
    """
    return _scores(confusion(pairs), n_labels)


def metrics(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One row ``(macro_f1, scam_f1, accuracy)`` of ``pairs(id, expected, predicted)``.

    The rows are read once, for the confusion counts; the rest works on those.
    """
    names = labels or fv.LABELS
    cells = cut(confusion(pairs))
    target = names.index("scam") if "scam" in names else len(names) - 1
    none = F.lit(None)
    scores = _scores(cells, len(names)).select("label", "f1", none.cast("long").alias("n"), none.cast("long").alias("hit"))
    hit = F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    counts = cells.select(none.cast("int").alias("label"), none.cast("double").alias("f1"), "n", hit.cast("long").alias("hit"))
    return scores.unionByName(counts).agg(
        (F.sum("f1") / len(names)).alias("macro_f1"),
        F.max(F.when(F.col("label") == target, F.col("f1"))).alias("scam_f1"),
        F.coalesce(F.try_divide(F.sum("hit"), F.sum("n")), F.lit(0.0)).alias("accuracy"),
    )


def max_abs_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference between two logit tables ``(id, logits)``."""
    left, right = a.select("id", F.col("logits").alias("x")), b.select("id", F.col("logits").alias("y"))
    gap = F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return left.join(right, "id").agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("max_abs_diff"))


def training_rows(rows: DataFrame) -> DataFrame:
    """``(id, text, label_id)``: masked text and label index of a labelled dataset."""
    names = F.array(*[F.lit(x) for x in fv.LABELS])
    index = F.array_position(names, F.col("label")).cast("int") - 1
    return rows.select("id", mask_normalized(F.col("text")).alias("text"), index.alias("label_id"))


def classifier(features: int = 1 << 13, regularisation: float = 0.0) -> Pipeline:
    """Word unigrams and bigrams, TF-IDF, multinomial logistic regression."""
    return Pipeline(
        stages=[
            NGram(n=2, inputCol="words", outputCol="bigrams"),
            HashingTF(inputCol="words", outputCol="word_tf", numFeatures=features),
            HashingTF(inputCol="bigrams", outputCol="bigram_tf", numFeatures=features),
            VectorAssembler(inputCols=["word_tf", "bigram_tf"], outputCol="tf"),
            IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(
                featuresCol="features", labelCol="label_id", family="multinomial", regParam=regularisation, maxIter=30
            ),
        ]
    )


def _words(rows: DataFrame) -> DataFrame:
    return rows.withColumn("words", tokens(F.col("text")))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``(id, normal, spam, scam, predicted)`` of ``rows(id, text)``; feeds the label decision."""
    shares = model.transform(_words(rows)).select("id", vector_to_array("probability").alias("p"))
    # labels the training data never had have no class in the model
    cells = [F.coalesce(F.try_element_at("p", F.lit(i + 1)), F.lit(0.0)) for i in range(len(fv.LABELS))]
    full = shares.select("id", F.array(*cells).alias("p"))
    named = [F.element_at("p", i + 1).alias(name) for i, name in enumerate(fv.LABELS)]
    return full.select("id", *named, argmax_label(F.col("p")).alias("predicted"))


def train(
    train_rows: DataFrame, val_rows: DataFrame, grid: tuple[float, ...] = (0.0, 0.01, 0.1)
) -> tuple[PipelineModel, float]:
    """Model with the best macro F1 on the validation rows, and that score.

    Rows are ``(id, text, label_id)``. The loop runs over the settings, not the data.
    """
    best: tuple[float, PipelineModel] | None = None
    names = F.array(*[F.lit(x) for x in fv.LABELS])
    words = _words(train_rows).persist()
    for strength in grid:
        model = classifier(regularisation=strength).fit(words)
        said = predict(model, val_rows).select("id", (F.array_position(names, F.col("predicted")) - 1).alias("predicted"))
        pairs = val_rows.select("id", F.col("label_id").alias("expected")).join(said, "id")
        score = metrics(pairs).first()["macro_f1"]
        if best is None or score > best[0]:
            best = (score, model)
    words.unpersist()
    return best[1], best[0]
