from siftwave.plans import intel
from siftwave.sources import feeds, html, tables

PAGE = """<html><head><title>T</title><script>var a = "<p>khong lay doan nay vi la script</p>";</script></head><body>
<nav><p>Muc luc khong duoc lay vao ket qua x.vn</p></nav>
<p>Canh bao website gia mao <b>shop-x[.]vip</b> va hxxps://y.top/a, khong truy cap.</p>
<!-- <p>ghi chu khong duoc lay vao ket qua</p> -->
<ul><li>Ke gian nhan: “Quy khach vui long truy cap link de xac minh tai khoan ngay”<br>het</li></ul>
<div class="post main">Dong mot<br>Dong  hai<blockquote>Trich <i>dan</i></blockquote></div>
<a href="/tin/1">mot</a> <a href='../khac?x=1&amp;y=2'>hai</a> <a href="https://own.vn/tin/1">lap</a> <a href="#dau">ba</a>
<footer><p>Ban quyen thuoc ve own.vn va lien he quang cao</p></footer></body></html>"""


def page(spark, html_text=PAGE, url="https://own.vn/muc/bai.html"):
    return spark.createDataFrame([(1, url, html_text)], "page_id long, url string, html string")


def test_paragraph_modes_agree_on_closed_tags(spark):
    depth = [r.paragraph for r in html.paragraphs(page(spark), "depth").orderBy("pos").collect()]
    block = [r.paragraph for r in html.paragraphs(page(spark), "block").orderBy("pos").collect()]
    assert len(depth) == 2 and depth[0].startswith("Canh bao website") and depth[1].endswith("het")
    assert block[:2] == depth


def test_unclosed_paragraph_swallows_the_rest_in_depth_mode_only(spark):
    broken = "<p>mot doan van khong dong the<p>doan thu hai cung dai nhu vay</p><p>doan thu ba cung dai nhu vay</p>"
    assert html.paragraphs(page(spark, broken), "depth").count() == 0
    assert html.paragraphs(page(spark, broken), "block").count() == 3


def test_visible_text_skips_and_decodes(spark):
    text = html.page_text(page(spark, "<p>A &amp; B</p><style>x</style><nav>no</nav>C<aside>khong dong the D")).first().text
    assert text == "A & B C"


def test_links_resolve_in_order_without_repeats(spark):
    links = [r.link for r in html.page_links(page(spark)).orderBy("pos").collect()]
    assert links == ["https://own.vn/tin/1", "https://own.vn/khac?x=1&y=2", "https://own.vn/muc/bai.html#dau"]
    assert [r.link for r in html.page_links(page(spark), "/tin/").collect()] == ["https://own.vn/tin/1"]


def test_class_texts(spark):
    out = [r.text for r in html.class_texts(page(spark), "post").collect()]
    assert out == ["Dong mot\nDong hai\nTrich dan"]


def test_warned_domains_leave_out_the_own_host(spark):
    rows = html.paragraphs(page(spark), "depth")
    out = {r.domain: r.evidence for r in intel.warned_domains(rows).collect()}
    assert set(out) == {"shop-x.vip", "y.top"} and "<URL>" in out["y.top"]
    assert [r.quote for r in html.quotes_of(rows).collect()] == ["Quy khach vui long truy cap link de xac minh tai khoan ngay"]


def test_list_page_domains(spark):
    rows = page(spark, "<td>a-b[.]top</td><td>ho-tro.own.vn</td><td>x.vip</td><nav>n.vn</nav>")
    assert [r.domain for r in intel.listed_page_domains(rows).collect()] == ["a-b.top", "x.vip"]


def test_feeds(spark, tmp_path):
    rss = "<rss><channel><item><title>Kh&amp;ocirc;ng &amp;amp;apos;a&amp;amp;apos;</title><link>https://a.vn/1</link><pubDate>d</pubDate><description><![CDATA[<p>Cảnh <b>báo</b></p>]]></description></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://a.vn/x"/><updated>u</updated><summary>s</summary></entry></feed>'
    stored = spark.createDataFrame([("r", "u1", rss), ("a", "u2", atom)], "source string, url string, xml string")
    out = {r.source: (r.title, r.link, r.published, r.summary) for r in feeds.parse_feeds(stored).collect()}
    assert out == {"r": ("Không 'a'", "https://a.vn/1", "d", "Cảnh báo"), "a": ("T", "https://a.vn/x", "u", "s")}
    for name, text in (("rss.xml", rss), ("atom.xml", atom)):
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert [r.link for r in feeds.read_feed(spark, str(tmp_path / "rss.xml")).collect()] == ["https://a.vn/1"]
    assert [(r.link, r.published) for r in feeds.read_feed(spark, str(tmp_path / "atom.xml")).collect()] == [("https://a.vn/x", "u")]


def test_domain_lists(spark):
    content = '["Q1.shop", {"website": "http://q2.live/?a=1", "count": 3}, [["q3.icu"]], {"lists": {"bad": {"link": "q4.top", "url": "q5.top"}}}, 7, true]'
    lines = "q6.vn\n   # not.a.domain\n\t\nno domain here\nhttps://q7.site/x\n"
    deep = "[" * 8 + '"q8.com"' + "]" * 8
    nested = '{"a":' * 6 + '{"domain": "q9.com"}' + "}" * 6
    null = '{"domain": null, "more": {"url": "q10.com"}}'
    rows = spark.createDataFrame([("j", "u", content), ("t", "v", lines), ("d", "w", deep), ("n", "x", nested), ("0", "y", null)], "source string, source_url string, content string")
    out = {(r.source, r.domain) for r in tables.domain_list(rows).collect()}
    assert out == {("j", d) for d in ("q1.shop", "q2.live", "q3.icu", "q4.top", "q5.top")} | {("t", "q6.vn"), ("t", "q7.site"), ("d", "q8.com"), ("n", "q9.com")}


def test_nested_and_self_closed_elements(spark):
    text = lambda h: html.page_text(page(spark, h)).first().text
    assert text("<nav>a<nav>b</nav>c</nav>d") == "d"
    assert text("<p>a</p><svg/><p>b</p>") == "a b"
    assert text("x<script/>y<script>z</script>") == "x y"
    assert text("&check; &NotEqual; &copy2026 &#x80; &amp;lt;") == "✓ ≠ ©2026 € &lt;"
    depth = lambda h: [r.paragraph for r in html.paragraphs(page(spark, h), "depth").collect()]
    assert depth("<li>outer text that is long<p>inner text that is long</p> and more</li>tail") == ["outer text that is longinner text that is long and more"]
    assert depth("</p><p>one paragraph that is long</p>") == ["one paragraph that is long"]
    assert depth("<nav><p>menu text that is long enough</nav> then </p><p>shown text that is long</p>") == ["shown text that is long"]
    inner = html.class_texts(page(spark, '<div class="k">a<div class="k">b</div><img>c</div><p class="k x">d<svg>e</svg></p><i class="k">open'), "k").collect()
    assert [(r.pos, r.text) for r in inner] == [(0, "a\nb\nc"), (1, "d")]


def test_links_with_many_steps_up(spark):
    base = "https://a.vn/1/2/3/4/x?y#z"
    pairs = {"../" * 12 + "y": "https://a.vn/y", "../../../../../z": "https://a.vn/z", "./b/../c": "https://a.vn/1/2/3/4/c", "..": "https://a.vn/1/2/3/", "/q/./r/../s?t=../u": "https://a.vn/q/s?t=../u", "//b.vn/../c": "https://b.vn/../c", "d//e": "https://a.vn/1/2/3/4/d/e"}
    anchors = "".join(f'<a href="{k}">x</a>' for k in pairs)
    assert [r.link for r in html.page_links(page(spark, anchors, base)).orderBy("pos").collect()] == list(pairs.values())


def test_article_links_cut_in_two_orders(spark):
    rows = [("s", 2, [], 0, "Lừa đảo mới", "", ""), ("s", 2, [], 1, "tin khác", "l1", ""), ("s", 2, [], 2, "x", "l2", "CẢNH BÁO"), ("s", 2, [], 3, "giả mạo", "l3", "")]
    items = spark.createDataFrame(rows, "source string, max_items int, keywords array<string>, pos int, title string, link string, summary string")
    assert {r.link for r in intel.article_links(items).collect()} == {"l2"}
    assert {r.link for r in intel.article_links(items, empty_links_first=True).collect()} == {"l2", "l3"}


def test_csv_tables_and_registries(spark, tmp_path):
    import pytest

    from siftwave import schemas

    path = tmp_path / "allowed_domains.csv"
    path.write_text('﻿domain,note\na.vn,"hai\ndong, ""x"""\nb.vn\n', encoding="utf-8")
    out = [(r.domain, r.note) for r in tables.read_table(spark, str(path), schemas.ALLOWED_DOMAINS).collect()]
    assert out == [("a.vn", 'hai\ndong, "x"'), ("b.vn", "")]
    assert tables.read_table(spark, str(tmp_path / "none.csv"), schemas.ALLOWED_DOMAINS).count() == 0
    assert tables.check_header(spark, str(tmp_path / "none.csv"), schemas.ALLOWED_DOMAINS).count() == 1
    sources = tmp_path / "sources.json"
    sources.write_text('[{"name": "a", "kind": "rss", "url": "https://a.vn"}, {"name": "b", "kind": "manual", "enabled": false}]', encoding="utf-8")
    rows = tables.read_sources(spark, str(sources), "intel").collect()
    assert [(r.name, r.max_items, r.keywords) for r in rows] == [("a", 15, [])]
    sources.write_text('[{"name": "a", "kind": "csv_dataset"}]', encoding="utf-8")
    for kind in ("intel", "training"):
        with pytest.raises(tables.TableError):
            tables.read_sources(spark, str(sources), kind)
    with pytest.raises(tables.TableError):
        tables.write_masked(rows and spark.range(1), str(tmp_path / "raw" / "x"))
    tables.write_masked(spark.createDataFrame([("a", 'q"')], "id string, text string"), str(tmp_path / "out"))
    back = tables.read_table(spark, str(tmp_path / "out"), schemas._strings("id text"))
    assert [(r.id, r.text) for r in back.collect()] == [("a", 'q"')]


def test_strict_dataset_scan(spark, tmp_path):
    import pytest

    from siftwave import schemas
    from siftwave.plans import quality

    header = ",".join(schemas.MESSAGES.names)
    good = "msg_000001,xin chao ban,normal,,sms,collected,false,2026-01-01,a1"
    path = tmp_path / "d.csv"
    path.write_text(f"{header}\n{good}\n{good},thua\nmsg_000003,thieu cot\n", encoding="utf-8")
    rows = tables.read_dataset(spark, str(path))
    found = {(r.rule) for r in quality.check_rows(rows).collect()}
    assert found == {"extra_cells", "missing_cells"}
    for text in (f"﻿{header}\n{good}\n", "id,text\n1,2\n", header + "\n"):
        path.write_text(text, encoding="utf-8")
        with pytest.raises(tables.TableError):
            tables.read_dataset(spark, str(path))
