"""Structured Streaming jobs. Per-batch work reuses the batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from .. import schemas
from ..functions import fixed_values as fv
from ..functions.text import text_key
from ..operators.joins import first_by
from ..plans.reports import over_limit, submit_reports
from ..plans.scoring import Intel, score_messages
from ..sources.tables import read_table

LATENESS = "10 minutes"


def message_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Arriving files as an unbounded table; the checkpoint keeps the offset."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def load_intel(spark: SparkSession, folder: str, fmt: str = "csv") -> Intel:
    """Threat tables of a folder as they are now; empty rows are dropped by the plans."""
    end = ".csv" if fmt == "csv" else ""

    def table(name: str, schema: T.StructType) -> DataFrame:
        return read_table(spark, f"{folder}/{name}{end}", schema, fmt)

    return Intel(
        table("blocked_domains", schemas.BLOCKED_DOMAINS),
        table("allowed_domains", schemas.ALLOWED_DOMAINS),
        table("scam_templates", schemas.TEMPLATES),
    )


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool, every: str, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def start_scoring(
    stream: DataFrame,
    intel: Callable[[], Intel],
    sink: str,
    checkpoint: str,
    predictions: Callable[[DataFrame], DataFrame] | None = None,
    threshold: float = fv.SCAM_THRESHOLD,
    once: bool = False,
    every: str = "60 seconds",
) -> StreamingQuery:
    """Score ``(msg_id, text)`` as it arrives; threat tables are read again for every batch.

    Results go to one folder per batch id, so a batch that is run again after a
    failure replaces its own rows.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        model = predictions(batch) if predictions else None
        scored = score_messages(batch.select("msg_id", "text"), intel(), model, threshold)
        scored.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(stream, work, checkpoint, once, every)


def drop_repeats(stream: DataFrame, lateness: str = LATENESS, time: str = "ts") -> DataFrame:
    """Each text once while it is remembered: state is bounded by time, keyed by the text's key."""
    keyed = stream.withColumn("key", text_key(F.col("text")))
    return keyed.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["key"])


def limit_stream(stream: DataFrame, limit: int = fv.REQUESTS_PER_WINDOW, window: str = "60 seconds", lateness: str = LATENESS) -> DataFrame:
    """Windows ``(client, ts)`` above the request limit."""
    return over_limit(stream.withWatermark("ts", lateness), limit, window)


def start_limits(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    limit: int = fv.REQUESTS_PER_WINDOW,
    window: str = "60 seconds",
    lateness: str = LATENESS,
    once: bool = False,
    every: str = "5 seconds",
) -> StreamingQuery:
    """Windows above the limit as soon as they are, the open ones too.

    Every batch writes the windows it changed to a folder of its own;
    ``limits_now`` takes the last state of each.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(limit_stream(stream, limit, window, lateness), work, checkpoint, once, every, "update")


def limits_now(spark: SparkSession, sink: str) -> DataFrame:
    """``(client, window_start, requests, refused)``: counts only grow, so the largest is the last."""
    rows = spark.read.parquet(sink)
    return rows.groupBy("client", "window_start").agg(F.max("requests").alias("requests"), F.max("refused").alias("refused"))


def start_intake(stream: DataFrame, table: str, checkpoint: str, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Accepted reports appended to the report table, one folder per day."""
    rows = submit_reports(stream).withColumn("day", F.to_date("created_at"))
    writer = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    writer = writer.partitionBy("day").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def newest_texts(batch: DataFrame, k: int = 10, order: str = "ord") -> DataFrame:
    """The last ``k`` distinct texts of a micro-batch, in arrival order of their first sight."""
    first = first_by(batch.withColumn("key", text_key(F.col("text"))), ["key"], [F.col(order)])
    return first.orderBy(F.desc(order)).limit(k)


def start_newest(stream: DataFrame, sink: str, checkpoint: str, k: int = 10, order: str = "ord", once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    def work(batch: DataFrame, batch_id: int) -> None:
        newest_texts(batch, k, order).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(stream, work, checkpoint, once, every)
