from pyspark.sql import functions as F

from siftwave.functions import urls


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_hosts(column):
    cases = {
        "http://a.example/x": "a.example", "HTTPS://A.EXAMPLE:8080": "a.example", "bit.ly/a?u=http://b": "bit.ly",
        "http://bücher.de": "xn--bcher-kva.de", "http://u:p@h.com/": "h.com", "http://[::1]/": "::1", "http://3232235777/": "192.168.1.1",
        "": None, "http://": None, "https://exa mple.com": None, "http://a..b": None, "http://h.com:99999": None,
    }
    assert column(urls.host, list(cases)) == list(cases.values())


def test_numeric_hosts(column):
    cases = {
        "http://0300.0250.1.01/": "192.168.1.1", "http://0xC0.0xa8.0x1.0X01:80": "192.168.1.1", "http://192.168.257": "192.168.1.1", "http://192.11010305/a": "192.168.1.1",
        "http://030052000401": "192.168.1.1", "http://0xc0a80101": "192.168.1.1", "http://0": "0.0.0.0", "http://1.2.3.4": "1.2.3.4", "http://127.1": "127.0.0.1",
        "http://4294967295": "255.255.255.255", "http://4294967296": "4294967296", "http://1.2.3.256": "1.2.3.256", "http://256.1.1.1": "256.1.1.1", "http://08.1.1.1": "08.1.1.1",
        "http://1.2.3.4.5": "1.2.3.4.5", "http://0x.1": "0x.1", "http://1.2.3.com": "1.2.3.com", "http://0x00000000ff": "0.0.0.255",
    }
    assert column(urls.host, list(cases)) == list(cases.values())


def test_domains(column):
    cases = {
        " HTTPS://www.Shop-X.vn:80/a ": "shop-x.vn", "a.com.": "a.com", "q.1": None, "TP.HCM": None, "x.unknowntld": None,
        "a" * 64 + ".com": None, "địa-chỉ.vn": "xn--a-ch-ooa51gm37k.vn",
    }
    out = column(urls.domain, list(cases))
    expected = [v if v is None or not v.startswith("xn--") else "địa-chỉ.vn".encode("idna").decode() for v in cases.values()]
    assert out == expected
    assert column(urls.domains, ["vao shop[.]vip va shop.vip, hxxp://b.top/x"]) == [["shop.vip", "b.top"]]


def test_suffix_rules(column):
    assert column(lambda c: F.sort_array(urls.suffixes(c)), ["a.b.vn.", "vn"]) == [["a.b.vn", "b.vn"], []]
    assert column(lambda c: F.sort_array(urls.suffixes(c, True)), ["b.vn", "vn"]) == [["b.vn", "vn"], ["vn"]]


def test_findings_keep_order_and_mark_hidden_links(column):
    facts = column(urls.link_facts, ["xem bit.ly/a, vtp[.]online va xn--a.top"])[0]
    assert [(f.url, f.reasons) for f in facts] == [
        ("bit.ly/a", ["url_shortener"]),
        ("vtp.online", ["url_obfuscated", "url_suspicious_tld"]),
        ("xn--a.top", ["url_punycode", "url_suspicious_tld"]),
    ]


def test_brand_rules(column):
    hits = ["bidv-x.com", "my.acb.net", "xvietcombank1.vn", "vietc0mbank.com", "v1etcornbank.net", "techcombnak.com", "login_vcb.net"]
    misses = ["acbd.com", "vibe.net", "shoppe.com", "example.com", ""]
    assert column(urls.brand_like, hits + misses) == [True] * len(hits) + [False] * len(misses)


def test_osa_matches_dynamic_program(spark):
    words = ["", "a", "ab", "ba", "abc", "acb", "abcd", "abdc", "bacd", "abce", "abcde", "aabc", "xyz", "khóa", "khoa"]
    pairs = [(a, b) for a in words for b in words]
    rows = spark.createDataFrame(pairs, "a string, b string")
    out = rows.select("a", "b", urls.osa_within_1(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == (osa(r.a, r.b) <= 1) for r in out)


def test_risk(column):
    values = [["url_shortener", "url_shortener", "zzz"], ["url_brand_impersonation", "url_suspicious_tld"], []]
    assert [round(x, 9) for x in column(urls.noisy_or, values, "array<string>")] == [0.15, 0.72, 0.0]


def test_client_links(column):
    values = ["https://U:p@Ex.com:443?x=1", "http://a.b:8080/p?q", "ftp://x/y", "https://a.b/" + "c" * 500]
    assert column(urls.inspectable_link, values) == ["https://ex.com/", "http://a.b:8080/p", None, None]
    wrapped = "https://l.facebook.com/l.php?u=https%3A%2F%2Fa.b%2Fc&h=1"
    assert column(urls.unwrap_redirect, [wrapped, "https://a.b/l.php?u=x"]) == ["https://a.b/c", "https://a.b/l.php?u=x"]
