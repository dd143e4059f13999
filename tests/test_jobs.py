"""The two recurring jobs over a handful of pages."""

from siftwave.plans import jobs

PLEA = "Quý khách vui lòng truy cập trang này ngay hôm nay để xác minh tài khoản ngân hàng"
PAGES = "source string, source_ord int, kind string, page_id long, url string, content string, error string"


def article(*blocks: str) -> str:
    return "<html><body>" + "".join(f"<p>{b}</p>" for b in blocks) + "</body></html>"


def test_threat_tables_are_updated_in_one_run(spark):
    crawled = [
        ("press", 1, "article", 1, "https://press.example.com/1", article(f"Cảnh báo website lừa đảo bad-shop.com và press.example.com: “{PLEA}”", "Hai tên miền bad-shop.com, ok-shop.com lừa đảo"), None),
        ("press", 1, "article", 2, "https://press.example.com/2", article("Website lừa đảo old-shop.com"), None),
        ("press", 1, "article", 3, "https://press.example.com/3", None, "timeout"),
        ("list", 2, "domain_list", 4, "https://list.example.org/a", '[{"domain": "bad-shop.com"}, "listed-shop.com"]', None),
        ("list", 2, "domain_page", 5, "https://list.example.org/b", "<td>paged-shop.com</td><td>list.example.org</td>", None),
        ("people", 3, "manual", 6, "form", f"Tin nhắn từ sent-shop.com “{PLEA}!”", None),
        (None, 4, "manual", 7, None, None, None),
    ]
    table = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    done = jobs.update_intel(
        table(PAGES, *crawled),
        table("domain string, source string, source_url string, first_seen string, evidence string", ("old-shop.com", "s", "u", "2025-01-01", "")),
        table("id string, text string, source string, source_url string, first_seen string"),
        table("domain string", ("ok-shop.com",)),
        table("domain string", ("listed-shop.com",)),
        table("fingerprint string"),
        "2026-01-01",
        mode="block",
    )
    assert {(r.domain, r.source) for r in done.new_domains.collect()} == {("bad-shop.com", "press"), ("paged-shop.com", "list"), ("sent-shop.com", "people")}
    assert [r.domain for r in done.domains.collect()] == ["bad-shop.com", "old-shop.com", "paged-shop.com", "sent-shop.com"]
    assert [(r.id, r.source) for r in done.new_templates.collect()] == [("tpl_000001", "press")]  # the sent one is a near copy
    assert done.counters == {"articles": 6, "errors": 1, "new_domains": 3, "skipped_allowed": 1, "skipped_rejected": 1, "new_templates": 1}
    report = {r.source: (r.articles, r.domains, r.texts, r.errors) for r in done.report.collect()}
    assert report["press"] == (2, 3, 1, 1) and report["list"] == (2, 3, 0, 0) and report["people"] == (1, 1, 2, 0)


def test_collection_stops_at_the_cap(spark):
    quote = lambda i: f"Xin chào bạn, đây là tin nhắn thử nghiệm số {'abcdefghij'[i] * 4} của chúng tôi"
    pages = [(f"s{k}", k, "news", "barred.example" if k == 2 and i == 0 else f"h{k}.example", 10 * k + i, f"https://h{k}.example/{i}", article(f"Họ viết: “{quote(i + 2 * k)}”"), "timeout" if k == 1 and i == 1 else None) for k in (1, 2, 3, 4) for i in (0, 1)]
    schema = "source_name string, source_ord int, origin string, host string, page_id long, url string, html string, error string"
    robots = spark.createDataFrame([("barred.example", "User-agent: GPTBot\nDisallow: /"), ("h1.example", None)], "host string, text string")
    none = spark.createDataFrame([], "id string, text string, collected_at string")
    known = spark.createDataFrame([], "key string")
    run = lambda cap: jobs.collect_sources(spark.createDataFrame(pages, schema), robots, none, known, "2026-01-01", cap, mode="block")
    whole = run(100)
    assert [(r.source_name, r.articles, r.added, r.errors) for r in whole.report.orderBy("source_name").collect()] == [("s1", 1, 1, 1), ("s2", 1, 1, 1), ("s3", 2, 2, 0), ("s4", 2, 2, 0)]
    assert whole.counters == {"barred_pages": 1, "failed_pages": 1, "added": 6, "duplicate": 0, "name": 0, "invalid": 0}
    first = run(2)
    assert [r.id for r in first.candidates.orderBy("id").collect()] == ["cand_000001", "cand_000002"]
    assert [r.source_name for r in first.report.orderBy("source_name").collect()] == ["s1", "s2"]  # later sources aren't read any more


def test_registry_of_more_than_a_thousand_sources(spark, tmp_path):
    """Each list of sources is a file of its own: Spark reads the first list of a file only."""
    from siftwave import more_queries

    spark.range(3500).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    names = {r.name for r in more_queries.source_registry(spark, str(tmp_path)).collect()}
    assert names == {f"s{i}" for i in range(3500) if i % 3}


def test_titles_and_adverts_are_not_collected(spark):
    """A quote in the title, or in a part without a content tag, is none of the article's; an unclosed paragraph still is."""
    from siftwave.sources import html

    quote = lambda c: f"“{c * 40}”"
    page = f"<html><head><title>{quote('a')}</title></head><body><div class=ad>{quote('b')}</div><h1>{quote('c')}</h1>{quote('d')}<ul><li>{quote('e')}<p>{quote('f')}</p>{quote('g')}</li></ul><p>{quote('h')}<br><p>{quote('i')}</p>"
    pages = spark.createDataFrame([("s", 1, "news", "h", 1, "https://h/1", page, None)], "source_name string, source_ord int, origin string, host string, page_id long, url string, html string, error string")
    robots, none, known = (spark.createDataFrame([], x) for x in ("host string, text string", "id string, text string, collected_at string", "key string"))
    done = jobs.collect_sources(pages, robots, none, known, "2026-01-01", mode="block")
    assert done.counters["invalid"] == 6 and done.report.first().invalid == 6
    rows = html.paragraphs(pages.select("page_id", "url", "html"), "block", outside=False).orderBy("pos").collect()
    assert [r.paragraph[1] for r in rows] == list("cefghi") and [r.pos for r in rows] == list(range(6))
