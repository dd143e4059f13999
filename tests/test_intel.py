from pyspark.sql import functions as F

from siftwave.functions import similarity as sets
from siftwave.plans import intel, policy

ADDRESS = "Thẻ của quý khách sắp bị ngừng sử dụng, mời mở {} và xác minh thông tin thẻ hôm nay"
PARCEL = "Bưu kiện của bạn đang chờ, vui lòng liên hệ Zalo {} rồi nạp tiền để nhận quà ngay"
POINTS = "Điểm thưởng sắp hết hạn, quý khách vui lòng đăng nhập tài khoản để nhận quà trong hôm nay"


def test_template_candidate_rules(column):
    yes = [
        PARCEL.format("<PHONE>"),
        ADDRESS.format("<URL>"),
    ]
    no = [
        "Khi nhận tin như vậy, bạn tuyệt đối không chuyển khoản và không mở trang đăng nhập của người lạ",
        "Bằng thủ đoạn giả danh, đối tượng yêu cầu nạn nhân mở <URL> rồi đăng nhập tài khoản ngân hàng",
        "Nạp tiền hôm nay",
        "Kindly log in to your card account today and pay the small fee to get the gift",
        ADDRESS.format("<URL>") + " x" * 300,
    ]
    assert column(intel.is_template_candidate, yes + no) == [True] * 2 + [False] * 5


def test_domain_merge_order_and_counters(spark):
    rows = [
        ("s1", 0, 1, "new.vn"), ("s1", 0, 2, "old.vn"), ("s1", 0, 3, "bad.vn"), ("s1", 0, 4, "blogspot.com"), ("s1", 0, 5, "x.blogspot.com"),
        ("s1", 0, 6, "a.ok.vn"), ("s2", 1, 7, "new.vn"), ("s2", 1, 8, "bad.vn"), ("s2", 1, 9, "b.gov.vn"),
    ]
    seen = spark.createDataFrame(rows, "source string, source_ord int, ord int, domain string").withColumn("source_url", F.lit("u")).withColumn("evidence", F.lit("e"))
    existing = spark.createDataFrame([("old.vn", "s", "u", "2025-01-01", "")], "domain string, source string, source_url string, first_seen string, evidence string")
    allow = spark.createDataFrame([("ok.vn",), ("gov.vn",)], "domain string")
    rejected = spark.createDataFrame([("bad.vn",)], "domain string")
    table, new, counters = intel.merge_domains(seen, existing, allow, rejected, "2026-01-01")
    assert [r.domain for r in table.collect()] == ["new.vn", "old.vn", "x.blogspot.com"]
    assert {(r.domain, r.source) for r in new.collect()} == {("new.vn", "s1"), ("x.blogspot.com", "s1")}
    assert counters.first().asDict() == {"new_domains": 2, "skipped_allowed": 2, "skipped_rejected": 3}


def test_bare_suffix_counts_in_the_allowlist_only(spark):
    hosts = spark.createDataFrame([(1, "a.b.vn")], "id int, host string")
    listed = spark.createDataFrame([("vn",)], "domain string")
    from siftwave.operators.joins import suffix_join

    assert suffix_join(hosts, "host", listed, ["id"]).count() == 0
    assert suffix_join(hosts, "host", listed, ["id"], include_tld=True).count() == 1


def templates(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, source string, source_url string, first_seen string")


def test_template_merge_blocks_copies_of_rejected_texts(spark):
    first = ADDRESS.format("abc.vn/x")
    other = PARCEL.format("0987654321")
    offered = [(0, first), (1, first + "!"), (2, other), (3, "vài chữ"), (4, POINTS)]
    texts = spark.createDataFrame(offered, "ord long, text string").withColumn("source", F.lit("s")).withColumn("source_url", F.lit("u"))
    old = templates(spark, [("tpl_000007", POINTS, "s", "u", "d")])
    mask = ADDRESS.format("<URL>")
    rejected = spark.createDataFrame([(mask,)], "text string").select(F.array_join(sets.fingerprint(F.col("text")), " ").alias("fingerprint"))
    new, barred = intel.merge_templates(texts, old, rejected, "2026-01-01")
    assert [(r.id, "<PHONE>" in r.text) for r in new.collect()] == [("tpl_000008", True)]
    assert [r.ord for r in barred.collect()] == [0]


def test_rejecting_moves_rows_and_keeps_only_fingerprints(spark):
    active = spark.createDataFrame([("a.vn", "s"), ("b.vn", "s")], "domain string, source string")
    gone = spark.createDataFrame([], "domain string, reason string, rejected_at string")
    asked = spark.createDataFrame([(" A.vn ", "trang chính chủ"), ("c.vn", "không có trong bảng"), ("b.vn", "ngắn")], "domain string, reason string")
    kept, moved, errors = intel.reject_domains(active, gone, asked, "2026-01-01")
    assert [r.domain for r in kept.collect()] == ["b.vn"] and [r.domain for r in moved.collect()] == ["a.vn"]
    blank = spark.createDataFrame([("a.vn", "\t\t\t\tok\u00a0\t\t\t\t\t")], "domain string, reason string")
    assert [r.error for r in intel.reject_domains(active, gone, blank, "2026-01-01")[2].collect()] == ["reason_too_short"]

    assert {(r.domain, r.error) for r in errors.collect()} == {("c.vn", "unknown_domain"), ("b.vn", "reason_too_short")}
    rows = templates(spark, [("tpl_000001", "một hai ba bốn", "s", "u", "d"), ("tpl_000002", "năm sáu", "s", "u", "d")])
    none = spark.createDataFrame([], "fingerprint string, reason string, rejected_at string")
    ask = spark.createDataFrame([("tpl_000001", "không phải lừa đảo")], "id string, reason string")
    kept, moved, errors = intel.reject_templates(rows, none, ask, "2026-01-01")
    assert [r.id for r in kept.collect()] == ["tpl_000002"] and len(moved.first().fingerprint.split()) == 2 and errors.count() == 0


def test_sources_in_one_place_add_a_domain_once(spark):
    seen = spark.createDataFrame([("s2", 5, 1, "n.vn"), ("s1", 5, 2, "n.vn")], "source string, source_ord int, ord int, domain string").withColumn("source_url", F.lit("u")).withColumn("evidence", F.lit("e"))
    none = spark.createDataFrame([], "domain string, source string, source_url string, first_seen string, evidence string")
    table, new, counters = intel.merge_domains(seen, none, none.select("domain"), none.select("domain"), "2026-01-01")
    assert [(r.domain, r.source) for r in table.collect()] == [("n.vn", "s1")] and counters.first().new_domains == 1



def test_robots_policy(spark):
    files = {
        "open": "User-agent: *\nDisallow: /\n",
        "signal": "content-signal: search=yes, AI-train=no\n",
        "later_yes": "Content-Signal: ai-train=no, ai-train=yes\n",
        "group": "User-agent: GPTBot\nUser-agent: x\nAllow: /a\nDisallow: / # het\n",
        "other_group": "User-agent: GPTBot\nDisallow: /a\nUser-agent: x\nDisallow: /\n",
        "missing": None,
    }
    rows = spark.createDataFrame(list(files.items()), "host string, text string")
    out = {r.host: (r.allowed, r.agents) for r in policy.training_policy(rows).collect()}
    assert out == {
        "open": (True, []), "signal": (False, []), "later_yes": (True, []), "group": (False, ["gptbot"]), "other_group": (True, []), "missing": (True, []),
    }
