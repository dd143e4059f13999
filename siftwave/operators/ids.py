"""Sequential ids without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def row_numbers(df: DataFrame, order: list[Column], start: int = 0, column: str = "n") -> DataFrame:
    """Dense numbers from ``start`` in the given order.

    The rows are written first, because dealing by range reads them twice, the first
    time for the bounds alone; what makes them would run twice. Then they are
    range-partitioned and written again to the checkpoint folder, so the
    partition of a row cannot change when an executor is lost. Each partition
    numbers its own rows and adds the count of the partitions before it; that
    offset table has one row per partition.
    """
    keyed = cut(df.withColumn("_order", F.struct(*order)))
    placed = cut(keyed.repartitionByRange("_order").withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_order"))
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(column, inside + F.col("_offset") + _number(start - 1))
    return numbered.drop("_part", "_order", "_offset")


def _number(n: int) -> Column:
    return F.lit(n) if abs(n) < 2**62 else F.lit(str(n)).cast("decimal(38,0)")


def format_id(prefix: str, number: Column) -> Column:
    """``prefix`` plus at least six digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))


def next_number(df: DataFrame, prefix: str, column: str = "id") -> DataFrame:
    """One row ``next``: largest number behind the prefix plus one, as a decimal of 38 digits."""
    rest = F.substr(F.col(column), F.lit(len(prefix) + 1))
    number = F.when(F.col(column).startswith(prefix) & rest.rlike(r"^\d+$"), rest.cast("decimal(38,0)"))
    return df.agg((F.coalesce(F.max(number), F.lit(0).cast("decimal(38,0)")) + 1).cast("decimal(38,0)").alias("next"))


def assign_ids(new: DataFrame, existing: DataFrame, prefix: str, order: list[Column]) -> DataFrame:
    """New rows with ids that continue after the existing ones, in arrival order."""
    start = int(next_number(existing, prefix).first()["next"])  # one number
    numbered = row_numbers(new, order, start=start, column="_n")
    return numbered.withColumn("id", format_id(prefix, F.col("_n"))).drop("_n")
