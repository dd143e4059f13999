"""Reports of users: intake, listing, hand-over to review, request limits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import mask, message_error, normalize, parse_label, parse_report_channel


def time_ordered_id(created_at: Column, *parts: Column) -> Column:
    """UUID of version 7 layout: milliseconds first, the rest from a digest of the row.

    A digest instead of random bits gives a retried task the same ids.
    """
    millis = F.lpad(F.lower(F.hex(F.unix_millis(created_at))), 12, "0")
    digest = F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws(
        "-",
        F.substring(millis, 1, 8),
        F.substring(millis, 9, 4),
        F.concat(F.lit("7"), F.substring(digest, 1, 3)),
        F.concat(F.lit("8"), F.substring(digest, 4, 3)),
        F.substring(digest, 7, 12),
    )


def judge_reports(requests: DataFrame) -> DataFrame:
    """Requests ``(request_id, text, label, channel, created_at)`` with masked text and ``error``.

    The length counts twice: before masking and, as placeholders may be longer than
    what they stand for, after it.
    """
    prepared = requests.withColumn("_normal", normalize(F.coalesce("text", F.lit(""))))
    masked = prepared.withColumn("masked_text", mask(F.col("_normal")))
    label, channel = parse_label(F.col("label")), parse_report_channel(F.col("channel"))
    error = (
        F.when(label.isNull(), "report.invalid_label")
        .when(channel.isNull(), "report.invalid_channel")
        .otherwise(
            F.coalesce(
                message_error(F.col("text"), F.col("_normal")),
                F.when(F.length("masked_text") > fv.MAX_MESSAGE_LENGTH, "classification.text_too_long"),
            )
        )
    )
    return masked.select(
        "request_id", error.alias("error"), "masked_text", label.alias("reported_label"), channel.alias("channel"), "created_at"
    )


def submit_reports(requests: DataFrame) -> DataFrame:
    """Accepted reports ``(id, masked_text, reported_label, channel, created_at)``."""
    good = judge_reports(requests).filter("error is null")
    return good.select(
        time_ordered_id(F.col("created_at"), F.col("request_id"), F.col("masked_text")).alias("id"),
        "masked_text", "reported_label", "channel", "created_at",
    )


def append_reports(reports: DataFrame, path: str) -> None:
    """Append to the report table, one folder per day, so a listing since a time reads few files."""
    reports.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def clamp_limit(limit: int | None) -> int:
    smallest, default, largest = fv.REPORT_LIMITS
    return max(smallest, min(default if limit is None else limit, largest))


def list_reports(reports: DataFrame, since: datetime | str | None = None, limit: int | None = None) -> DataFrame:
    """Oldest reports from ``since`` on; the limit is kept between 1 and 500."""
    rows = reports
    if since is not None:
        moment = F.lit(since).cast("timestamp")
        rows = rows.filter(F.col("created_at") >= moment)
        if "day" in reports.columns:
            rows = rows.filter(F.col("day") >= F.to_date(moment))
    return rows.orderBy("created_at", "id").limit(clamp_limit(limit))


def review_rows(reports: DataFrame) -> DataFrame:
    """Reports in the layout of the review file."""
    return reports.select(
        F.col("id").alias("report_id"),
        F.col("masked_text").alias("text"),
        F.col("reported_label").alias("label"),
        F.lit("").alias("scam_type"),
        F.when(F.col("channel") == "telegram", "telegram").otherwise("other").alias("channel"),
        F.lit("contributed").alias("source"),
        F.date_format("created_at", "yyyy-MM-dd").alias("collected_at"),
        F.lit("").alias("annotator"),
    )


def over_limit(requests: DataFrame, limit: int = fv.REQUESTS_PER_WINDOW, window: str = "60 seconds") -> DataFrame:
    """``(client, window_start, requests, refused)`` of fixed windows above the limit; batch or stream."""
    counted = requests.groupBy("client", F.window("ts", window).alias("w")).agg(F.count("*").alias("requests"))
    return counted.filter(F.col("requests") > limit).select(
        "client", F.col("w.start").alias("window_start"), "requests", (F.col("requests") - limit).alias("refused")
    )


def refused_requests(requests: DataFrame, limit: int = fv.REQUESTS_PER_WINDOW, window: str = "60 seconds") -> DataFrame:
    """Requests ``(event_id, client, ts)`` beyond the first ``limit`` of their client and window.

    The literal rank filter lets every task keep only the first ``limit`` rows per
    window before the shuffle; the refused ones are all the others.
    """
    slot = requests.withColumn("w", F.window("ts", window).getField("start"))
    rank = F.row_number().over(Window.partitionBy("client", "w").orderBy("ts", "event_id"))
    served = slot.withColumn("_rank", rank).filter(F.col("_rank") <= F.lit(limit)).select("event_id")
    return requests.join(served, "event_id", "left_anti")
