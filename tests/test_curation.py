from pyspark.sql import functions as F

from siftwave import schemas
from siftwave.functions.text import text_key
from siftwave.operators import ids
from siftwave.plans import curation, evaluate, quality, split

CAND = schemas.CANDIDATES


def candidate(number, text, **more):
    row = dict.fromkeys(CAND.names, "") | {"id": f"cand_{number:06d}", "text": text, "origin": "news", "source": "collected", "collected_at": "2026-01-01"}
    return tuple((row | more)[c] for c in CAND.names)


def test_row_numbers_are_dense_over_many_partitions(spark):
    rows = spark.range(1000).repartition(7).select("id", F.sha2(F.col("id").cast("string"), 256).alias("k"))
    out = ids.row_numbers(rows, [F.col("k")], start=5).orderBy("k").collect()
    assert [r.n for r in out] == list(range(5, 1005))


def test_ids_continue_and_outgrow_six_digits(spark):
    old = spark.createDataFrame([("msg_999999",), ("other",)], "id string")
    new = spark.createDataFrame([(2, "b"), (1, "a")], "ord int, t string")
    out = {r.t: r.id for r in ids.assign_ids(new, old, "msg_", [F.col("ord")]).collect()}
    assert out == {"a": "msg_1000000", "b": "msg_1000001"}


def test_collect_counts_invalid_then_name_then_duplicate(spark):
    existing = spark.createDataFrame([candidate(3, "Tin đã có sẵn rồi")], CAND)
    dataset = spark.createDataFrame([("Tin trong bộ dữ liệu",)], "text string")
    reviewed = spark.createDataFrame([("Tin đã duyệt xong",)], "text string").select(text_key(F.col("text")).alias("key"))
    known = curation.known_keys(existing, dataset, reviewed)
    texts = ["tin ĐÃ có  sẵn rồi", "Tin trong bộ dữ liệu", "Tin đã duyệt xong", "Chào anh Nam nhé", "Tin mới tinh hôm nay", "no vietnamese", "ô", "tin mới tinh hôm nay"]
    offers = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").select(
        "*", F.lit("manual").alias("source_name"), F.lit(0).alias("source_ord"), F.lit("manual").alias("origin"), F.lit("contributed").alias("source"), F.lit("").alias("source_url")
    )
    outcomes = curation.collect_outcomes(offers, known)
    assert [r.outcome for r in outcomes.orderBy("ord").collect()] == ["duplicate"] * 3 + ["name", "added", "invalid", "invalid", "duplicate"]
    assert curation.collection_report(outcomes).first().asDict() == {"source_name": "manual", "added": 1, "duplicate": 4, "name": 1, "invalid": 2}
    assert [(r.id, r.text) for r in curation.new_candidates(outcomes, existing, "2026-02-02").collect()] == [("cand_000004", "Tin mới tinh hôm nay")]


def test_cap_stops_before_a_source_and_cuts_rows(spark):
    rows = [(s * 10 + i, s, "added") for s in range(3) for i in range(4)]
    outcomes = spark.createDataFrame(rows, "ord long, source_ord int, outcome string")
    assert {r.source_ord for r in curation.within_cap(outcomes, 5).collect()} == {0, 1}
    assert {r.source_ord for r in curation.within_cap(outcomes, 4).collect()} == {0}


def test_suggestions(spark):
    waiting = spark.createDataFrame([candidate(1, "a"), candidate(2, "b")], CAND)
    cells = "ord int, id string, label string, scam_type string, channel string, confidence string, note string"
    asked = spark.createDataFrame(
        [
            (1, "cand_000001", "spam", "", "sms", "low", "lý do đủ dài"), (2, "cand_000001", " scam ", "job_scam", "sms", "high", "lý do đủ dài"),
            (3, "cand_000009", "spam", "", "sms", "low", "lý do đủ dài"), (4, "cand_000002", "exclude", "", "", "", "x"), (5, "cand_000002", "normal", "job_scam", "sms", "low", "lý do đủ dài"),
        ],
        cells,
    )
    errors = {(r.id, r.error) for r in curation.check_suggestions(asked, waiting).collect()}
    assert errors == {("cand_000009", "unknown_id"), ("cand_000002", "note"), ("cand_000002", "scam_type_without_scam")}
    done = {r.id: (r.suggested_label, r.suggested_scam_type) for r in curation.apply_suggestions(waiting, asked.filter("ord < 3")).collect()}
    assert done["cand_000001"] == ("scam", "job_scam")


def test_reviews_and_append(spark):
    waiting = spark.createDataFrame([candidate(i, f"Tin nhắn số {i} xem a.vn") for i in range(1, 5)], CAND)
    decisions = spark.createDataFrame(
        [("cand_000001", True, "scam", "job_scam", ""), ("cand_000002", True, "exclude", "", "sms"), ("cand_000003", False, "spam", "", "sms")], schemas.DECISIONS
    )
    remaining, messages, reviewed = curation.apply_reviews(waiting, decisions, "a1", "2026-03-03")
    assert [r.id for r in remaining.collect()] == ["cand_000004"]
    assert sorted(r.decision for r in reviewed.collect()) == ["accepted", "rejected", "rejected"]
    assert [(r.label, r.scam_type, r.channel) for r in messages.collect()] == [("scam", "job_scam", "other")]
    dataset = spark.createDataFrame([("msg_000041", "x", "normal", "", "sms", "collected", "false", "2026-01-01", "a")], schemas.MESSAGES)
    out = {r.id: r.has_url for r in curation.append_messages(dataset, messages).collect()}
    assert out == {"msg_000041": "false", "msg_000042": "true"}


def test_synthetic_rows_come_with_a_suggestion(spark):
    rows = spark.createDataFrame([(0, "Bạn trúng thưởng rồi nhé", "scam", "prize_scam", "sms"), (1, "bạn trúng thưởng  rồi nhé", "scam", "prize_scam", "sms")], "ord long, text string, label string, scam_type string, channel string")
    none = spark.createDataFrame([], "key string")
    out = curation.synthetic_candidates(rows, spark.createDataFrame([], CAND), none, "2026-01-01").collect()
    assert [(r.id, r.suggested_label, r.confidence) for r in out] == [("cand_000001", "scam", "high")]


def test_anonymize(spark):
    rows = spark.createDataFrame([(1, " Gọi 0912345678 hoặc a.vn ", " scam ", "sms", "collected", "2026-01-01", "a1")], "ord int, text string, label string, channel string, source string, collected_at string, annotator string")
    row = curation.anonymize(rows, 7).first()
    assert (row.id, row.text, row.label, row.has_url) == ("msg_000007", "Gọi <PHONE> hoặc <URL>", "scam", "true")


def labelled(spark, n=20):
    rows = [(f"msg_{i:06d}", ("scam", "spam", "normal")[i % 3], "collected") for i in range(3 * n)]
    return spark.createDataFrame(rows, "id string, label string, source string")


def test_split_sizes_stability_and_fixed_test(spark):
    rows = labelled(spark)
    first = {r.id: r.split for r in split.split(rows).collect()}
    counts = {s: list(first.values()).count(s) for s in ("train", "val", "test")}
    assert counts == {"train": 42, "val": 9, "test": 9} and len(first) == 60
    assert {r.id: r.split for r in split.split(rows.repartition(5)).collect()} == first
    test = rows.filter(F.col("id").isin([i for i, s in first.items() if s == "test"]))
    again = {r.id: r.split for r in split.split(rows, existing_test=test).collect()}
    assert again == first
    assert split.verify_test(test, rows).count() == 0
    changed = rows.withColumn("label", F.when(F.col("id") == test.first().id, "x").otherwise(F.col("label")))
    assert [r.error for r in split.verify_test(test, changed).collect()] == ["changed"]
    assert split.labels_without_test(rows, test.filter("label <> 'scam'")).first().label == "scam"


def test_synthetic_rows_never_reach_the_test_set(spark):
    rows = labelled(spark).withColumn("source", F.when(F.col("label") == "scam", "synthetic").otherwise("collected"))
    out = rows.join(split.split(rows), "id").filter("split = 'test'")
    assert out.filter("label = 'scam'").count() == 0 and out.count() == 6


def test_metrics(spark):
    pairs = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 2, 2), (3, 2, 2), (4, 1, 0)], "id int, expected int, predicted int")
    row = evaluate.metrics(pairs).first()
    assert (round(row.macro_f1, 6), row.scam_f1, row.accuracy) == (0.5, 1.0, 0.6)
    assert evaluate.metrics(pairs.filter("false")).first().accuracy == 0.0


def test_classifier_learns_simple_words(spark):
    base = {0: "hẹn ăn cơm nhà", 1: "giảm giá mua ngay", 2: "nhập otp chuyển tiền"}
    rows = spark.createDataFrame([(i, f"{base[i % 3]} {i}", i % 3) for i in range(60)], "id int, text string, label_id int")
    model, score = evaluate.train(rows.filter("id < 45"), rows.filter("id >= 45"), grid=(0.01,))
    assert score == 1.0
    out = evaluate.predict(model, rows.limit(5)).first()
    assert abs(out.normal + out.spam + out.scam - 1) < 1e-9


def test_dataset_rules(spark):
    rows = [
        (0, "msg_000001", "Gọi 0912345678 ngay", "scam", "", "sms", "collected", "false", "2026-01-01", "a"),
        (1, "msg_1", "tin <FOO> <PHONE> nhé", "spam", "job_scam", "fax", "x", "true", "2026-13-01", ""),
        (2, "msg_000001", "tin  <FOO> <phone> NHÉ", "normal", "", "sms", "synthetic", "false", "2026-01-01", "a"),
        (3, "msg_000004", "abc", "oops", "", "sms", "collected", "false", "2026-01-01", "a"),
    ]
    cols = "ord int, id string, text string, label string, scam_type string, channel string, source string, has_url string, collected_at string, annotator string"
    out = {(r.key, r.rule) for r in quality.check_dataset(spark.createDataFrame(rows, cols)).collect()}
    assert out == {
        ("msg_000001", "text_pii"), ("msg_000001", "scam_type_required"), ("msg_1", "unknown_placeholder"), ("msg_1", "scam_type_without_scam"),
        ("msg_1", "channel"), ("msg_1", "source"), ("msg_1", "id_format"), ("msg_1", "has_url"), ("msg_1", "collected_at"), ("msg_1", "annotator"),
        ("msg_000001", "unknown_placeholder"), ("msg_000001", "duplicate_id"), ("msg_000001", "duplicate_text"), ("msg_000004", "text_length"),
        ("msg_000004", "label"), ("synthetic", "synthetic_share"),
    }


def test_intel_rules(spark):
    domains = spark.createDataFrame(
        [("Bad.vn", "s", "2026-01-01", ""), ("com.vn", "s", "x", ""), ("a.gov.vn", "", "2026-01-01", "goi 0912345678"), ("ok-x.vn", "s", "2026-01-01", ""), ("ok-x.vn", "s", "2026-01-01", "")],
        "domain string, source string, first_seen string, evidence string",
    )
    allow = spark.createDataFrame([("gov.vn",)], "domain string")
    out = {(r.key, r.rule) for r in quality.check_blocked_domains(domains, allow).collect()}
    assert out == {("Bad.vn", "not_canonical"), ("com.vn", "public_suffix"), ("com.vn", "first_seen"), ("a.gov.vn", "source_missing"), ("a.gov.vn", "evidence_pii"), ("a.gov.vn", "allowlisted")}
    text = "Tài khoản của quý khách bị tạm khóa, vui lòng truy cập <URL> để xác minh trong 24h"
    rows = spark.createDataFrame([("tpl_000001", text), ("tpl_000002", text + "!"), ("tpl_000003", "khác hẳn nhé")], "id string, text string")
    dup = quality.check_intel_unique(domains, rows).collect()
    assert {(r.key, r.rule) for r in dup} == {("ok-x.vn", "duplicate_domain"), ("tpl_000001", "near_duplicate")}


def test_dates(column):
    from siftwave.plans import quality

    good = ["2026-02-28", "20260228", "2026-W09-6", "2026W096", "2026-W09", "2020-W53-1"]
    bad = ["2026-0228", "202602-28", "2026-02-30", "2026-W54", "2025-W53-1", "2026-W09-8", "", "2026-2-8"]
    assert column(quality.is_date, good + bad) == [True] * len(good) + [False] * len(bad)


def test_ids_of_any_length(spark):
    from siftwave.operators import ids

    known = spark.createDataFrame([("msg_1234567890123456789012",), ("msg_x",), ("other_9",)], "id string")
    assert int(ids.next_number(known, "msg_").first()["next"]) == 1234567890123456789013
    new = spark.createDataFrame([(1, "a")], "ord int, text string")
    assert ids.assign_ids(new, known, "msg_", [F.col("ord")]).first()["id"] == "msg_1234567890123456789013"


def test_suggestions_and_broken_test_sets_are_refused(spark):
    import pytest

    from siftwave.plans import split

    waiting = spark.createDataFrame([("c1", "", "", "", "", "")], "id string, suggested_label string, suggested_scam_type string, suggested_channel string, confidence string, note string")
    asked = spark.createDataFrame([("c1", 1, "perhaps", "", "sms", "low", "a longer note")], "id string, ord int, label string, scam_type string, channel string, confidence string, note string")
    with pytest.raises(ValueError, match="label"):
        curation.apply_suggestions(waiting, asked)
    rows = spark.createDataFrame([("a", "spam", "x"), ("b", "spam", "synthetic")], "id string, label string, source string")
    with pytest.raises(ValueError, match="synthetic"):
        split.split(rows, existing_test=rows.filter("id = 'b'"))


def test_broken_rows_count_nowhere_else(spark):
    from siftwave.plans import quality

    cells = {"id": "msg_000001", "text": "xin chao ban", "label": "normal", "scam_type": "", "channel": "sms", "source": "synthetic", "has_url": "false", "collected_at": "2026-01-01", "annotator": "a1"}
    schema = ", ".join(f"{c} string" for c in cells) + ", _extra boolean, _missing boolean, ord int"
    rows = spark.createDataFrame([(*cells.values(), True, False, 1), (*cells.values(), False, False, 2)], schema)
    rules = {r.rule for r in quality.check_dataset(rows.withColumn("source", F.when(F.col("_extra"), "synthetic").otherwise("collected"))).collect()}
    assert "extra_cells" in rules and not rules & {"duplicate_id", "duplicate_text", "synthetic_share"}
