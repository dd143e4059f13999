"""Stratified, seeded and stable dataset split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.joins import lookup_join
from ..operators.ranks import stratum_rank
from ..session import cut


def shuffle_key(seed: str, key: Column) -> Column:
    """Position of a row in the seeded order; depends on the row alone, so reruns agree."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def new_test(rows: DataFrame, stratum: str = "label", seed: str = "42-test", share: float = fv.TEST_SHARE) -> DataFrame:
    """Ids of a new test set: per stratum a fixed share of all rows, synthetic rows never."""
    totals = cut(rows.groupBy(stratum).agg(F.count("*").alias("total")))  # one row per stratum
    real = rows.filter(F.col("source") != "synthetic").select("id", stratum)
    ranked = stratum_rank(real, stratum, shuffle_key(seed, F.col("id")))
    wanted = F.bround(F.col("total") * F.lit(share), 0)
    return lookup_join(ranked, totals, [stratum]).filter(F.col("rank") <= wanted).select("id")


def train_val(rows: DataFrame, stratum: str = "label", seed: str = "42-train-val", share: float = fv.VAL_SHARE) -> DataFrame:
    """``(id, split)`` of the rows outside the test set."""
    ranked = stratum_rank(rows.select("id", stratum), stratum, shuffle_key(seed, F.col("id")))
    wanted = F.bround(F.col("stratum_size") * F.lit(share), 0)
    return ranked.select("id", F.when(F.col("rank") <= wanted, "val").otherwise("train").alias("split"))


def split(rows: DataFrame, stratum: str = "label", existing_test: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``(id, split)`` with train, val and test; an existing test set is kept as it is.

    An existing test set with columns beside ``id`` must still hold the same rows,
    none of them synthetic: otherwise it raises.
    """
    if existing_test is not None and set(rows.columns) <= set(existing_test.columns):
        wrong = verify_test(existing_test, rows).groupBy("error").count().orderBy("error").collect()  # a row per kind of error
        if wrong:
            raise ValueError("the test set is broken: " + ", ".join(f"{r['error']} ({r['count']})" for r in wrong))
    test = new_test(rows, stratum, f"{seed}-test") if existing_test is None else existing_test.select("id")
    rest = rows.join(test, "id", "left_anti")
    return train_val(rest, stratum, f"{seed}-train-val").unionByName(test.select("id", F.lit("test").alias("split")))


def training_parts(ready: DataFrame, rows: DataFrame) -> Callable[[str], DataFrame]:
    """Part of ``ready(id, text, label_id)`` by its name, split as ``rows(id, label, source)`` are; masked and split once for all parts."""
    whole = cut(ready.join(split(rows.select("id", "label", "source")), "id"))
    return lambda name: whole.filter(F.col("split") == name).select("id", "text", "label_id")


def verify_test(test: DataFrame, rows: DataFrame) -> DataFrame:
    """``(id, error)`` of test rows that vanished, changed, or are synthetic."""
    columns = [c for c in rows.columns if c != "id"]
    current = rows.select("id", F.struct(*columns).alias("now"))
    frozen = test.select("id", F.struct(*columns).alias("then"), F.col("source").alias("src"))
    error = (
        F.when(F.col("now").isNull(), "missing")
        .when(~F.col("now").eqNullSafe(F.col("then")), "changed")
        .when(F.col("src") == "synthetic", "synthetic")
    )
    return frozen.join(current, "id", "left").select("id", error.alias("error")).filter("error is not null")


def labels_without_test(rows: DataFrame, test: DataFrame, stratum: str = "label") -> DataFrame:
    return rows.select(stratum).distinct().subtract(test.select(stratum))
