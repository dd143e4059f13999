"""Versions of threat tables that a running stream can change between.

A version is a folder of Parquet tables and, written last, one manifest file that
names it. The manifest is created with its final name or not at all, so readers see
whole versions only. A stream pins every micro-batch to the version that was the
newest when the batch first ran, and a batch that runs again after a failure reads
the same one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import fixed_values as fv
from ..plans.scoring import Intel, score_messages
from .jobs import _start

TABLES = ("blocked", "official", "templates")


def _system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file under a name of its own and renames it; False if the name is taken."""
    target, system = _system(spark, path)
    if system.exists(target):
        return False
    system.mkdirs(target.getParent())
    draft, _ = _system(spark, f"{target.getParent().toString()}/.{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = system.rename(draft, target)
    if not done:
        system.delete(draft, False)
    return bool(done)


def _read(spark: SparkSession, path: str) -> str | None:
    target, system = _system(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        out = bytearray()
        while (byte := stream.read()) >= 0:
            out.append(byte)
        return out.decode()
    finally:
        stream.close()


def newest_version(spark: SparkSession, folder: str) -> int:
    """Number of the newest whole version; 0 if there is none."""
    path, system = _system(spark, f"{folder}/manifests")
    if not system.exists(path):
        return 0
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def publish(spark: SparkSession, folder: str, intel: Intel) -> int:
    """Writes the tables as a new version; of two writers at once each gets a number of its own."""
    data = f"{folder}/data/{uuid.uuid4().hex}"
    for name in TABLES:
        table = getattr(intel, name)
        if table is not None:
            table.write.parquet(f"{data}/{name}")
    while True:
        version = newest_version(spark, folder) + 1
        if _create(spark, f"{folder}/manifests/{version:012d}", data):
            return version


def read_version(spark: SparkSession, folder: str, version: int) -> Intel:
    """The tables of one version; version 0 has none."""
    data = _read(spark, f"{folder}/manifests/{version:012d}")
    if data is None:
        if version:
            raise ValueError(f"there is no version {version} in {folder}")
        return Intel()
    tables = {}
    for name in TABLES:
        path, system = _system(spark, f"{data}/{name}")
        tables[name] = spark.read.parquet(f"{data}/{name}") if system.exists(path) else None
    return Intel(**tables)


def pinned_version(spark: SparkSession, folder: str, pins: str, batch_id: int) -> int:
    """Version of a micro-batch: the newest one when it is asked for first, the same one ever after."""
    path = f"{pins}/{batch_id}"
    _create(spark, path, str(newest_version(spark, folder)))
    return int(_read(spark, path) or 0)


def start_versioned_scoring(
    stream: DataFrame,
    folder: str,
    sink: str,
    checkpoint: str,
    predictions: Callable[[DataFrame], DataFrame] | None = None,
    threshold: float = fv.SCAM_THRESHOLD,
    once: bool = False,
    every: str = "60 seconds",
) -> StreamingQuery:
    """Score ``(msg_id, text)`` as it arrives, each micro-batch with one version of the threat tables in ``folder``."""
    spark = stream.sparkSession

    def work(batch: DataFrame, batch_id: int) -> None:
        version = pinned_version(spark, folder, f"{checkpoint}-pins", batch_id)
        model = predictions(batch) if predictions else None
        scored = score_messages(batch.select("msg_id", "text"), read_version(spark, folder, version), model, threshold)
        scored.withColumn("intel_version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(stream, work, checkpoint, once, every)
