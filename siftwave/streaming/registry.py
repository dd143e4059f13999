"""Streaming queries over the driver tables, run until the available rows are used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scoring import Intel
from ..registry import french_domains, junk_domains, query, variant
from ..session import shared_folder
from . import clients, jobs, snapshots


def _scratch(spark: SparkSession, name: str) -> str:
    """New folder below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _table_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: a pattern may stand for both."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return _table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _collected(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Append-mode sink as files, read back when the stream has run dry."""
    folder = _scratch(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query
def stream_scores(spark, d):
    folder = _scratch(spark, "scores")
    stream = _table_stream(spark, d, "pages").select(
        F.col("page_id").alias("msg_id"), F.concat(F.lit("Check "), variant(F.col("url")), F.lit(" now")).alias("text")
    )
    threats = lambda: Intel(junk_domains(spark, d), french_domains(spark, d))  # noqa: E731  (read again per batch)
    jobs.start_scoring(stream, threats, f"{folder}/rows", f"{folder}/state", once=True).awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.select("msg_id", "status", "label", F.round("confidence", 9).alias("confidence"), F.array_join("reasons", ",").alias("reasons"))


@query
def stream_first_texts(spark, d):
    stream = _event_stream(spark, d).select("ts", F.concat_ws(" ", "event_type", "props").alias("text"))
    return _collected(jobs.drop_repeats(stream, "40 days"), spark, "first").select("key")


@query
def stream_over_limit(spark, d):
    stream = _event_stream(spark, d).select(F.col("user_id").alias("client"), "ts")
    folder = _scratch(spark, "limit")
    jobs.start_limits(stream, f"{folder}/rows", f"{folder}/state", 3, "1 day", "40 days", once=True).awaitTermination()
    return jobs.limits_now(spark, f"{folder}/rows").select("client", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", "refused")


@query
def stream_reports(spark, d):
    folder = _scratch(spark, "reports")
    label = F.when(F.col("event_type") == "view", "Spam").when(F.col("event_type") == "error", "none").otherwise("scam")
    stream = _event_stream(spark, d).select(
        F.col("event_id").alias("request_id"), F.concat_ws(" ", "event_type", "props").alias("text"), label.alias("label"),
        F.when(F.col("event_type") == "click", "telegram").otherwise("api").alias("channel"), F.col("ts").alias("created_at"),
    )
    jobs.start_intake(stream, f"{folder}/rows", f"{folder}/state", once=True).awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.select("id", "masked_text", "reported_label", "channel", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


@query
def stream_newest_texts(spark, d):
    folder = _scratch(spark, "newest")
    stream = _table_stream(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")
    jobs.start_newest(stream, f"{folder}/rows", f"{folder}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("ord", "key")


@query
def stream_scores_by_version(spark, d):
    """Pages arriving in two halves; between them the threat tables get a second version."""
    folder = _scratch(spark, "versions")
    arriving = spark.read.parquet(f"{d}/pages.parquet").select(
        F.col("page_id").alias("msg_id"), F.concat(F.lit("Check "), variant(F.col("url")), F.lit(" now")).alias("text")
    )
    schema = arriving.schema
    listed = [junk_domains(spark, d), junk_domains(spark, d).unionByName(french_domains(spark, d)).distinct()]
    for half, blocked in enumerate(listed):
        snapshots.publish(spark, f"{folder}/intel", Intel(blocked, french_domains(spark, d)))
        arriving.filter(F.col("msg_id") % 2 == half).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        snapshots.start_versioned_scoring(stream, f"{folder}/intel", f"{folder}/rows", f"{folder}/state", once=True).awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.select("msg_id", "intel_version", "status", "label", F.round("confidence", 9).alias("confidence"), F.array_join("reasons", ",").alias("reasons"))


@query
def stream_fresh_texts(spark, d):
    """Texts of each user that aren't among the user's last two fresh ones."""
    text = F.concat_ws(" ", "event_type", F.floor(F.length("props") / 8))
    stream = _event_stream(spark, d).select(F.col("user_id").alias("client"), "event_id", "ts", text.alias("text"))
    return _collected(clients.first_texts(stream, 2), spark, "fresh").select("client", "event_id", "fresh")


def _limited(rows):
    return rows.select("client", "event_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"), "refused")


@query
def stream_client_windows(spark, d):
    stream = _event_stream(spark, d).select(F.col("user_id").alias("client"), "event_id", "ts")
    return _limited(_collected(clients.limit_clients(stream, 3, "1 day", "40 days"), spark, "windows"))


@query
def client_windows(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("client"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _limited(clients.limited_requests(events, 3, 86_400))
