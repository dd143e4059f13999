"""Tables between the steps of an operator, and joins that bear hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

NO_ID = -(2**63)  # stands for a null id
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark drops the shuffle files of a query when that query has ended."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a step's rows as Parquet to the shared checkpoint folder and reads them back.

    Cuts the lineage like a checkpoint, but columns can be pruned afterwards and
    the step's shuffle files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with short_lived_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_key(column: str) -> Column:
    """Id as a non-null long that keeps the order; a null id is the smallest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID).cast("long"))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, key, body)``: the whole input row as one struct, so that no column name of the input can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), as_key(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))


def as_mark() -> Column:
    """Tells texts apart that share an id: a 64-bit hash of the body of ``packed`` rows."""
    return F.xxhash64("body").alias("mark")


def unpacked(judged: DataFrame, **changes: Column) -> DataFrame:
    """The input rows again, with some of their columns changed."""
    fields = judged.schema["row"].dataType.fieldNames()
    return judged.select(*[changes.get(c, F.col("row")[c]).alias(c) for c in fields])
