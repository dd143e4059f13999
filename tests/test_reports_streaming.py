import time

from pyspark.sql import functions as F

from siftwave import schemas
from siftwave.plans import reports, scoring
from siftwave.sources import tables
from siftwave.streaming import jobs


def requests(spark):
    rows = [
        ("r1", "Gọi 0912345678 ngay", " SCAM ", "Telegram", "2026-01-02 00:00:01"), ("r2", " ", "spam", "api", "2026-01-01 00:00:00"),
        ("r3", "x", "zzz", "api", "2026-01-01 00:00:00"), ("r4", "x", "spam", "sms", "2026-01-01 00:00:00"), ("r5", "tin thường", "normal", "extension", "2026-01-01 00:00:00"),
        ("r6", "a@b.vn " * 285, "spam", "api", "2026-01-01 00:00:00"),
    ]
    return spark.createDataFrame(rows, "request_id string, text string, label string, channel string, at string").withColumn("created_at", F.col("at").cast("timestamp"))


def test_intake_listing_and_review_rows(spark):
    errors = {r.request_id: r.error for r in reports.judge_reports(requests(spark)).collect()}
    assert errors == {
        "r1": None, "r2": "classification.empty_text", "r3": "report.invalid_label", "r4": "report.invalid_channel", "r5": None, "r6": "classification.text_too_long",
    }
    done = reports.submit_reports(requests(spark))
    listed = reports.list_reports(done).collect()
    assert [r.masked_text for r in listed] == ["tin thường", "Gọi <PHONE> ngay"]
    assert listed[0].id < listed[1].id and listed[0].id[14] == "7"
    assert [r.reported_label for r in reports.list_reports(done, "2026-01-02", 0).collect()] == ["scam"]
    assert [reports.clamp_limit(x) for x in (None, 0, 5, 9999)] == [100, 1, 5, 500]
    rows = {r.text: (r.channel, r.source, r.collected_at) for r in reports.review_rows(done).collect()}
    assert rows == {"Gọi <PHONE> ngay": ("telegram", "contributed", "2026-01-02"), "tin thường": ("other", "contributed", "2026-01-01")}


def test_report_table_by_day(spark, tmp_path):
    path = str(tmp_path / "reports")
    reports.append_reports(reports.submit_reports(requests(spark)), path)
    table = spark.read.parquet(path)
    assert reports.list_reports(table, "2026-01-02 00:00:00").count() == 1


def test_request_windows(spark):
    rows = [(i, "a", f"2026-01-01 00:00:{i:02d}") for i in range(5)] + [(9, "b", "2026-01-01 00:00:00"), (10, "a", "2026-01-01 00:01:00")]
    events = spark.createDataFrame(rows, "event_id int, client string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [(r.client, r.requests, r.refused) for r in reports.over_limit(events, 3).collect()] == [("a", 5, 2)]
    assert {r.event_id for r in reports.refused_requests(events, 3).collect()} == {3, 4}


def test_stream_scores_equal_batch_and_follow_new_tables(spark, tmp_path):
    source, intel_dir = tmp_path / "in", tmp_path / "intel"
    intel_dir.mkdir()
    schema = "msg_id long, text string"
    (intel_dir / "blocked_domains.csv").write_text("domain,source,source_url,first_seen,evidence\nxau.vn,s,u,d,e\n", encoding="utf-8")

    def arrive(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / name))

    def run():
        stream = jobs.message_stream(spark, str(source / "*"), spark.createDataFrame([], schema).schema)
        jobs.start_scoring(stream, lambda: jobs.load_intel(spark, str(intel_dir)), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
        return {r.msg_id: r.label for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    arrive([(1, "xem xau.vn"), (2, "xem moi.vn")], "a")
    assert run() == {1: "scam", 2: None}
    time.sleep(1)
    (intel_dir / "blocked_domains.csv").write_text("domain,source,source_url,first_seen,evidence\nmoi.vn,s,u,d,e\n", encoding="utf-8")
    arrive([(3, "xem moi.vn"), (4, "xem xau.vn")], "b")
    assert run() == {1: "scam", 2: None, 3: "scam", 4: None}
    batch = scoring.score_messages(spark.createDataFrame([(3, "xem moi.vn"), (4, "xem xau.vn")], schema), jobs.load_intel(spark, str(intel_dir)))
    assert {r.msg_id: r.label for r in batch.collect()} == {3: "scam", 4: None}


def test_stream_drops_repeats(spark, tmp_path):
    rows = [("2026-01-01 00:00:01", "Xin chào"), ("2026-01-01 00:00:02", " xin  CHÀO "), ("2026-01-01 00:00:03", "khác")]
    spark.createDataFrame(rows, "t string, text string").select(F.col("t").cast("timestamp").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    query = jobs.drop_repeats(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_intake_and_newest(spark, tmp_path):
    requests(spark).drop("at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    jobs.start_intake(stream, str(tmp_path / "table"), str(tmp_path / "s1"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    batch = spark.createDataFrame([(0, "a"), (1, "b"), (2, "A"), (3, "c")], "ord int, text string")
    assert [r.ord for r in jobs.newest_texts(batch, 2).collect()] == [3, 1]


def test_empty_intel_folder(spark, tmp_path):
    intel = jobs.load_intel(spark, str(tmp_path / "none"))
    assert intel.blocked.count() == 0 and intel.blocked.columns == schemas.BLOCKED_DOMAINS.names
    assert tables.path_exists(spark, str(tmp_path))


def test_stream_of_a_table_in_many_files(spark, tmp_path):
    """A table may be a folder of part files."""
    from siftwave.streaming import registry

    rows = spark.createDataFrame([(i, f"text {i % 7}", "en", "s") for i in range(30)], "doc_id long, text string, lang string, source string")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.ord for r in registry.stream_newest_texts(spark, str(tmp_path)).collect()) == list(range(7))


def test_scores_of_a_table_in_many_files(spark, tmp_path):
    from siftwave.streaming import registry

    rows = spark.createDataFrame([(i, f"http://www.a-b{i}.example.com/{'fr' if i % 3 else 'en'}/x", "") for i in range(30)], "page_id long, url string, html string")
    rows.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert registry.stream_scores(spark, str(tmp_path)).count() == 30
