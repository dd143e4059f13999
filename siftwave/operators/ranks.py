"""Ranks inside strata without putting a stratum into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ids import row_numbers
from .joins import lookup_join


def stratum_rank(df: DataFrame, stratum: str, order: Column, column: str = "rank") -> DataFrame:
    """Rank from 1 per stratum plus the stratum size ``stratum_size``.

    A window per stratum would put a third of all rows into one task. Here rows
    are numbered over a range partitioning on (stratum, order), which cuts a
    large stratum into many ranges, and the stratum's first number is taken off.
    """
    numbered = row_numbers(df, [F.col(stratum), order], start=1, column="_n")
    sizes = cut(df.groupBy(stratum).agg(F.count("*").alias("stratum_size")))  # one row per stratum
    before = Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("stratum_size").over(before), F.lit(0)))
    ranked = lookup_join(numbered, starts, [stratum])
    return ranked.withColumn(column, F.col("_n") - F.col("_before")).drop("_n", "_before")
