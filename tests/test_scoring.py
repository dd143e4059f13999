import pytest
from pyspark.sql import functions as F

from siftwave.functions import decision
from siftwave.plans import scoring


@pytest.fixture(scope="module")
def intel(spark):
    return scoring.Intel(
        spark.createDataFrame([("lua-dao.vip",), ("top",), (" Xau.com ",)], "domain string"),
        spark.createDataFrame([("vietcombank.com.vn",)], "domain string"),
        spark.createDataFrame([("tpl_000001", "quý khách vui lòng truy cập <URL> để xác minh ngay"), ("tpl_000002", "")], "id string, text string"),
    )


MESSAGES = [
    (1, "   "),
    (2, "a" * 2001),
    (3, "vao m.lua-dao.vip ngay"),
    (4, "Quý khách vui lòng truy cập abc.vn/x để xác minh ngay hôm nay"),
    (5, "xem vietcombank-xacminh.top nhe"),
    (6, "xem vcb.vietcombank.com.vn nhe"),
    (7, "chieu nay di choi"),
    (8, "xem xau.com va bit.ly/a"),
    (9, "xem a.top"),
]


def score(spark, intel, predictions=None, **more):
    rows = spark.createDataFrame(MESSAGES, "msg_id long, text string")
    out = scoring.score_messages(rows, intel, predictions, **more).collect()
    return {r.msg_id: (r.status, r.label, None if r.confidence is None else round(r.confidence, 6), r.reasons) for r in out}


def test_decisions_without_a_model(spark, intel):
    out = score(spark, intel)
    assert out[1] == ("classification.empty_text", None, None, None)
    assert out[2] == ("classification.text_too_long", None, None, None)
    assert out[3] == ("ok", "scam", 0.99, ["url_blocklisted", "url_suspicious_tld"])
    assert out[4] == ("ok", "scam", 1.0, ["matches_known_scam_template"])
    assert out[5] == ("ok", "scam", 0.72, ["url_suspicious_tld", "url_brand_impersonation"])
    assert out[8] == ("ok", "scam", 0.99, ["url_blocklisted", "url_shortener"])
    for quiet in (6, 7, 9):
        assert out[quiet][0] == "classification.model_unavailable"


def test_decisions_with_a_model(spark, intel):
    shares = [(5, 0.9, 0.05, 0.05), (6, 0.1, 0.6, 0.3), (7, 0.4, 0.4, 0.2), (9, 0.3, 0.1, 0.6), (3, 1.0, 0.0, 0.0)]
    out = score(spark, intel, spark.createDataFrame(shares, "msg_id long, normal double, spam double, scam double"))
    assert out[3][1:] == ("scam", 0.99, ["url_blocklisted", "url_suspicious_tld"])
    assert out[5][1:] == ("scam", 0.734, ["url_suspicious_tld", "url_brand_impersonation"])
    assert out[6][1:] == ("spam", 0.6, ["model_predicted_spam"])
    assert out[7][1:] == ("normal", 0.4, [])
    assert out[9][1:] == ("scam", 0.72, ["url_suspicious_tld"])


def test_extra_findings_and_threshold(spark, intel):
    extra = spark.createDataFrame([(7, "url_ip_address_host")], "msg_id long, reason string")
    out = score(spark, intel, findings=extra, threshold=0.4)
    assert out[7] == ("ok", "scam", 0.4, ["url_ip_address_host"])


def test_model_queue_holds_all_but_strong_signals(spark, intel):
    rows = spark.createDataFrame(MESSAGES, "msg_id long, text string")
    assert {r.msg_id for r in scoring.messages_for_model(rows, intel).collect()} == {5, 6, 7, 9}


def fuse(spark, normal, spam, scam, reasons, **more):
    shares = F.struct(F.lit(normal).alias("normal"), F.lit(spam).alias("spam"), F.lit(scam).alias("scam"))
    array = F.array(*[F.lit(r) for r in reasons]).cast("array<string>")
    r = spark.range(1).select(decision.fuse(shares, array, **more).alias("r")).first().r
    return r.label, round(r.confidence, 9), r.reasons


def test_fusion_table(spark):
    assert fuse(spark, 0.1, 0.2, 0.7, []) == ("scam", 0.7, ["model_predicted_scam"])
    assert fuse(spark, 0.2, 0.2, 0.6, ["url_punycode", "url_punycode"]) == ("scam", 0.76, ["url_punycode"])
    assert fuse(spark, 0.35, 0.35, 0.3, ["url_shortener"]) == ("normal", 0.35, ["scam_probability_below_threshold", "url_shortener"])
    assert fuse(spark, 0.3, 0.4, 0.3, []) == ("spam", 0.4, ["model_predicted_spam"])
    signal = dict(blocked=F.lit(False), template_coverage=F.lit(0.8))
    assert fuse(spark, 0.9, 0.05, 0.05, [], **signal) == ("scam", 0.8, ["matches_known_scam_template"])


def test_model_outputs(spark, column):
    p = column(lambda c: decision.softmax(c, ["scam", "normal", "spam"]), [[0.0, 0.0, 0.0], [1000.0, 0.0, 0.0]], "array<float>")
    assert p[0].normal == pytest.approx(1 / 3) and p[1].scam == pytest.approx(1.0)
    with pytest.raises(ValueError):
        decision.softmax(F.lit(None), ["scam", "scam", "spam"])
    v = column(decision.llm_verdict, ['{"label":"Scam","confidence":0.2}', '{"label":"spam"}', "x", '{"label":"q","confidence":1}'])
    assert (v[0].scam, v[0].normal) == (0.5, 0.25) and v[1:] == [None, None, None]
    assert column(decision.argmax_label, [[1.0, 1.0, 0.0]], "array<double>") == ["normal"]


def test_link_requests(spark, intel):
    rows = [("a", 0, "https://x.lua-dao.vip/a"), ("a", 1, "https://ok.vn"), ("b", 0, " "), ("b", 1, "https://ok.vn"), ("d", 0, None)]
    rows += [("c", i, f"https://a.vn/{i}") for i in range(51)] + [("e", 0, "momo.top")]
    out = scoring.inspect_requests(spark.createDataFrame(rows, "request_id string, pos int, url string"), intel).collect()
    verdicts = {(r.request_id, r.pos): (r.verdict, r.reasons) for r in out if r.error is None}
    assert verdicts == {
        ("a", 0): ("dangerous", ["url_blocklisted", "url_suspicious_tld"]),
        ("a", 1): ("safe", []),
        ("e", 0): ("dangerous", ["url_suspicious_tld", "url_brand_impersonation"]),
    }
    errors = {r.request_id: r.error for r in out if r.error}
    assert errors == {"b": "link_inspection.invalid_link", "c": "link_inspection.too_many_links", "d": "link_inspection.no_links"}


def test_reason_texts(spark):
    rows = spark.createDataFrame([("url_shortener",), ("own_code",)], "reason string")
    out = {r.reason: r.description for r in scoring.describe_reasons(rows).collect()}
    assert out["own_code"] == "own_code" and out["url_shortener"].startswith("Có link")
