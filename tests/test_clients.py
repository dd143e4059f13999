"""Per-client state and versioned threat tables against loops over the rows."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwave.plans.scoring import Intel
from siftwave.streaming import clients, snapshots

BEGIN = datetime(2024, 1, 1)


def requests(seed: int, n: int = 400) -> list[tuple]:
    r = random.Random(seed)
    at, out = 0.0, []
    for i in range(n):
        at += r.choice([0, 0.5, 3, 20, 59, 60, 61, 400])
        out.append((r.choice([1, 1, 1, 2, 3]), i, BEGIN + timedelta(seconds=at), r.choice(["a", "b", "c", "d", " A ", "e"])))
    return out


def stream_of(spark, folder, rows, files):
    """Arriving files in order, one a micro-batch."""
    size = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], "client long, event_id long, ts timestamp, text string")
        part.coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finished(spark, stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").collect()


@pytest.mark.parametrize("files", [1, 5])
def test_fresh_texts_are_bounded_by_count(spark, tmp_path, files):
    rows = requests(1)
    got = finished(spark, clients.first_texts(stream_of(spark, f"{tmp_path}/in", rows, files), 3), tmp_path)
    held, want = {}, {}
    for client, i, _, text in rows:
        own, key = held.setdefault(client, OrderedDict()), text.strip().lower()
        want[i] = key not in own
        if want[i]:
            own[key] = None
            if len(own) > 3:
                own.popitem(last=False)
    assert {r.event_id: r.fresh for r in got} == want and 0 < sum(want.values()) < len(want)


def windows_by_hand(rows, limit, seconds):
    start, used, out = {}, {}, {}
    for client, i, ts, *_ in sorted(rows, key=lambda r: (r[2], r[1])):
        if client not in start or ts >= start[client] + timedelta(seconds=seconds):
            start[client], used[client] = ts, 0
        used[client] += 1
        out[i] = (start[client], used[client] > limit)
    return out


@pytest.mark.parametrize("seed, n", [(2, 400), (3, 1), (4, 0)])
def test_windows_start_with_a_request(spark, tmp_path, seed, n):
    rows = requests(seed, n)
    want = windows_by_hand(rows, 2, 60)
    df = spark.createDataFrame([r[:3] for r in rows] + [(None, -1, BEGIN), (7, -2, None)], "client long, event_id long, ts timestamp")
    assert {r.event_id: (r.window_start, r.refused) for r in clients.limited_requests(df, 2, 60).collect()} == want
    if n > 1:
        got = finished(spark, clients.limit_clients(stream_of(spark, f"{tmp_path}/in", rows, 4), 2, "60 seconds"), tmp_path)
        assert {r.event_id: (r.window_start, r.refused) for r in got} == want


def test_a_busy_client_is_no_single_window(spark):
    rows = [(1, i, BEGIN + timedelta(seconds=i * 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "client long, event_id long, ts timestamp")
    starts = clients.window_starts(df, 60).count()
    assert starts == len({w for w, _ in windows_by_hand(rows, 1, 60).values()})


def test_batches_keep_their_version(spark, tmp_path):
    folder, pins = f"{tmp_path}/intel", f"{tmp_path}/pins"
    assert snapshots.newest_version(spark, folder) == 0 and snapshots.read_version(spark, folder, 0) == Intel()
    assert snapshots.pinned_version(spark, folder, pins, 0) == 0
    domains = lambda *names: spark.createDataFrame([(n,) for n in names], "domain string")
    assert snapshots.publish(spark, folder, Intel(domains("bad.example"))) == 1
    assert snapshots.pinned_version(spark, folder, pins, 1) == 1
    assert snapshots.publish(spark, folder, Intel(domains("bad.example", "worse.example"), domains("good.example"))) == 2
    assert [snapshots.pinned_version(spark, folder, pins, k) for k in (0, 1, 2, 1)] == [0, 1, 2, 1]
    assert snapshots.read_version(spark, folder, 1).blocked.count() == 1 and snapshots.read_version(spark, folder, 1).official is None
    assert snapshots.read_version(spark, folder, 2).official.filter(F.col("domain") == "good.example").count() == 1
    with pytest.raises(ValueError):
        snapshots.read_version(spark, folder, 3)
