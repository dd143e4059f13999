"""Main text of pages, spelling variants and whitening against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwave.llm import dom, eigen, fmindex, queries, sitetree, spelling, whitening

SMALL = "/root/testdata/sf0.001"


def same_rows(spark, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    found = con.execute(queries.ORACLE[name])
    assert sorted(c[0] for c in found.description) == sorted(df.columns)
    want = sorted(map(repr, (tuple(r) for r in found.fetchall())))
    assert want and sorted(map(repr, (tuple(r) for r in df.select(*[c[0] for c in found.description]).collect()))) == want


# spelling

def near_by_hand(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(words: dict, ratio: int = 5) -> dict:
    out = {}
    for w, n in words.items():
        near = [v for v in words if near_by_hand(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    full = {}
    for w, (n, k, form, form_n) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        full[w] = (n, k, form, form_n, root)
    return full


def some_words(seed: int, size: int = 500) -> dict:
    r = random.Random(seed)
    words = set()
    while len(words) < size:
        w = "".join(r.choice("abé") for _ in range(r.randint(6, 9)))
        words.add(w)
        words.add(w[:3] + r.choice("abxÿ") + w[3:])
    words |= {"a" * 40, "a" * 41, "b" * 6, "b" * 7, "ab" * 300, "ab" * 300 + "a"}
    return {w: r.choice([5, 6, 30, 160, 900]) for w in sorted(words)}


@pytest.mark.parametrize("block_chars", [200_000, 400])
def test_near_words(spark, block_chars):
    words = some_words(1)
    want = variants_by_hand(words)
    vocabulary = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {r.word: tuple(r)[1:] for r in spelling.near_words(vocabulary, block_chars).collect()}
    assert {w: v[:2] for w, v in near.items()} == {w: v[:2] for w, v in want.items()}
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(vocabulary).collect()}
    assert got == want
    assert any(v[4] != w and want[v[2]][2] for w, v in want.items())  # chains of several forms


def test_one_error_searches_of_an_index():
    words = ["abcabc", "abcab", "abcabcc", "xbcabc", "abc", "zzzzzz"]
    index = fmindex.FmIndex(*spelling._coded([w[::-1] for w in words]))
    codes, starts = spelling._coded(["abcabc", "zzzzzy", ""])
    pattern, word = index.one_error(codes, starts, np.array([3, 3, 0]))
    assert {(p, words[w]) for p, w in zip(pattern, word)} == {(0, "abcab"), (0, "abcabcc"), (1, "zzzzzz")}
    empty = fmindex.FmIndex(*spelling._coded([]))
    assert len(empty.one_error(codes, starts, np.array([3, 3, 0]))[0]) == 0


def test_words_are_counted_with_typing_errors(spark):
    texts = [(1, "Straße straße STRASSE größer, größer größer ÉCLAIR éclair Éclair"), (2, None), (None, "strasse " * 3), (3, ""), (4, "strasses " * 6 + "a" * 5), (4, "x" * 100_000 + " éclair")]
    texts += [(i, f"wordnumber {'longerword' * 2} wordnumbér") for i in range(10, 400)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, word string")
    got = {r.word: r.n for r in spelling.count_words(docs, min_count=1, drop_one_in=199).collect()}
    want = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                want[w] += 1
    assert got == dict(want)
    nothing = spelling.group_variants(spelling.count_words(docs.filter("doc_id = 2")))
    assert nothing.collect() == [] and nothing.columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_spelling_query_equals_sql(spark):
    same_rows(spark, "op12_spelling_variants", "documents")


# whitening

def test_rank_one_updates_keep_an_eigendecomposition():
    r = np.random.default_rng(4)
    for dim in (1, 2, 7, 30):
        d, q, full = np.zeros(dim), np.eye(dim), np.zeros((dim, dim))
        steps = [r.normal(size=dim) for _ in range(2 * dim)] + [np.eye(dim)[0], np.zeros(dim), np.ones(dim), np.ones(dim), 1e-9 * np.ones(dim)]
        for v in steps:
            w = float(r.choice([0.5, 1.0, 40.0]))
            full += w * np.outer(v, v)
            d, q = eigen.rank_one(d, q, v, w)
            assert np.all(np.diff(d) >= 0) and np.abs(q.T @ q - np.eye(dim)).max() < 1e-12
            assert np.abs(q * d @ q.T - full).max() < 1e-11 * max(1, np.abs(full).max())


def whitened_by_hand(rows: list, components: int = 16) -> dict:
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = [k for k in range(len(values)) if values[k] > 1e-9 * max(values[0], 1e-300)][:components]
    return {i: (n, int(((n * v - sums) ** 2).sum()), (n * v - sums) / n @ vectors[:, some] / np.sqrt(values[some]), values[some] / values.sum()) for i, v in x.items()}


@pytest.mark.parametrize("rows_of_a_task", [4096, 9])
def test_whitening(spark, monkeypatch, rows_of_a_task):
    monkeypatch.setattr(whitening, "ROWS", rows_of_a_task)
    r = np.random.default_rng(2)
    wide = [(i, (r.normal(size=20) * np.linspace(1, 3, 20)).tolist()) for i in range(60)]
    short = [(100 + i, r.normal(size=3).tolist()) for i in range(12)]
    flat = [(200 + i, [float(i), 1.0, 2.0, float(i)]) for i in range(5)]  # one component has variance
    one = [(300, [1.0, 2.0, 3.0, 4.0, 5.0])]
    copies = [(400 + i, wide[0][1]) for i in range(40)] + [(400, wide[0][1]), (None, wide[1][1])]
    bad = [(500, None), (501, []), (502, [math.nan] * 20), (503, [None] * 20), (504, [math.inf] * 3), (505, [1e300] * 3)]
    rows = wide + short + flat + one + copies + bad
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, x int")
    judged = whitening.whiten(df)
    got = judged.select("row.vec_id", "row.n", judged.n.alias("fitted"), "deviation", "whitened", "explained", "identity_error").collect()
    assert len(got) == len(rows) - len(bad)
    want = {}
    for group in (wide + copies, short, flat, one):
        want |= whitened_by_hand(group)
    signs = {}
    for g in got:
        n, deviation, white, explained = want[g.vec_id]
        assert g.fitted == n and int(g.deviation) == deviation and g.identity_error < 1e-9
        assert len(g.whitened) == len(white) and np.allclose(g.explained, explained, rtol=1e-9)
        for k, (a, b) in enumerate(zip(g.whitened, white)):
            assert abs(abs(a) - abs(b)) < 1e-8
            if abs(b) > 1e-3:
                assert signs.setdefault((len(white), n, k), a * b > 0) == (a * b > 0)
    lines = whitening.by_component(judged).groupBy("row.vec_id").agg(F.max("component").alias("k")).collect()
    assert {x.vec_id: x.k for x in lines} == {g.vec_id: len(want[g.vec_id][2]) for g in got if len(want[g.vec_id][2])}


def test_whitening_of_nothing_and_of_large_numbers(spark):
    none = whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert none.collect() == [] and none.columns == ["row", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(i, [2.0**46 * (i % 7), float(i)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((40 * c - s) ** 2 for c, s in zip(v, sums)) for (i, _), v in zip(rows, x)}
    assert {g.row.vec_id: int(g.deviation) for g in got} == want


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    want = whitened_by_hand([(r.vec_id, r.embedding) for r in rows])
    got = queries.QUERIES["op13_embedding_whitening"](spark, SMALL).toPandas()
    assert len(got) == sum(len(w[2]) for w in want.values()) and got.identity_error.max() < 1e-9
    for r in got.itertuples():
        n, deviation, white, explained = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(white[r.component - 1])) < 1e-7 and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-8)


# pages

def entropy_by_hand(values: list) -> float:
    m = len(values)
    return 1.0 if m == 1 else -sum(k / m * math.log(k / m, m) for k in Counter(values).values())


def soup(i: int, r: random.Random) -> str:
    """A page whose parts have no telling names."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    text = "".join(f"<p>{' '.join(word() for _ in range(r.randint(4, 9)))}</p>" for _ in range(r.randint(1, 6)))
    return f"<html><body><div class=x1><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div><div class=x2>{text}</div><div class=x3>All rights kept by us</div></body></html>"


def test_templates_without_telling_names_are_found_by_entropy(spark):
    r = random.Random(3)
    bodies = [soup(i, r) for i in range(30)]
    pages = [(i, "http://www.Site.example/p?x", b) for i, b in enumerate(bodies)] + [(100 + i, "http://www.site.example/p#y", bodies[0]) for i in range(200)]
    pages += [(400, "http://alone.example", bodies[1])]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, host string")
    for known in (sitetree.KNOWN, 0):
        got = {x.row.page_id: x.blocks for x in sitetree.extract_main(df, known=known).collect()}
        for i, _, body in pages[:-1]:
            assert got[i] == re.findall("<p>(.*?)</p>", body)
        assert got[400] == ["Home", "News", *re.findall("<p>(.*?)</p>", bodies[1]), "All rights kept by us"]  # nothing to compare with


def test_entropies_of_the_site_tree(spark):
    r = random.Random(5)
    rows = [dom.parse(soup(i, r), "h") for i in range(12)]
    seen = [(i, [(p, c, v) for p, c, v in sitetree.observations(page)]) for i, page in enumerate(rows)]
    tree = {t.path: (t.style, t.content) for t in sitetree.site_tree(spark.createDataFrame(seen, sitetree.OBSERVED)).collect()}
    every = {}
    for _, obs in seen:
        for p, c, v in obs:
            every.setdefault((p, c), []).append(v)
    for (p, c), values in every.items():
        if len(values) > 1:
            assert math.isclose(tree[p][c], entropy_by_hand(values), abs_tol=1e-9)
        else:
            assert p not in tree or tree[p][c] is None


def test_entropies_decide_inside_a_named_article(spark):
    r = random.Random(4)
    words = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(5))
    article = lambda p, n: f"<article><h1>News</h1>{''.join(f'<p>{x}</p>' for x in p)}<table><tr><td>{'yes' if n % 3 else 'no'}</table><div class=x9>Get our app</div></article>"
    told = [[words() for _ in range(r.randint(1, 4))] for _ in range(40)]
    copied = [words(), words()]
    rows = [(i, "http://told.example", article(p, i), " ".join(["News", *p, "yes" if i % 3 else "no"])) for i, p in enumerate(told)]
    # too few pages to tell, and copies of an article beside other adverts
    rows += [(100 + i, "http://few.example", article(p, i), " ".join(["News", *p, "yes" if i % 3 else "no", "Get our app"])) for i, p in enumerate(told[:5])]
    rows += [(200 + i, "http://copies.example", f"<div class=ad>{words()}</div>{article(copied, 1)}", " ".join(["News", *copied, "yes Get our app"])) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    for known in (sitetree.KNOWN, 0):
        for x in sitetree.extract_main(df, known=known).collect():
            assert " ".join(x.blocks) == x.row.want


def test_named_branches(spark):
    page = """<!doctype html><html><head><title>T &amp; T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
    <div class="with-sidebar"><article><header><h1>Head &eacute;&#33;</h1></header><p>One  <b>bold</b>
    line<br>two&nbsp;three<div class=ads><p>Buy</p></div><table><tr><td>c1<td>c2</table><form>Name <input></form><p>Last</article></div>
    <aside>Beside</aside><section class="comments"><article>Great post</article></section><div hidden>Secret</div><footer>End</footer><noscript>No</noscript>"""
    odd = [(1, page), (2, None), (3, ""), (4, "plain < text & more"), (5, "<article>" * 3000 + "deep" + "<b>" * 3000 + "!"), (6, "<p>unclosed <i>a<p>b</i> c</span> <!-- never closed"), (7, "<p>x</p>" * 20_000), (1, page), (None, page)]
    df = spark.createDataFrame([(i, f"http://h{i}.example/", h, 1) for i, h in odd], "page_id long, url string, html string, blocks int")
    got = {x.row.page_id: " ".join(x.blocks) for x in sitetree.extract_main(df).collect()}
    assert got[1] == got[None] == "Head é! One bold line two three c1 c2 Last"
    assert got[2] == got[3] == "" and got[4] == "plain < text & more" and got[5] == "deep!" and got[6] == "unclosed a b c" and got[7] == " ".join("x" * 20_000)
    assert sitetree.extract_main(df.filter("page_id = 9")).collect() == []


def test_page_query_equals_sql(spark):
    same_rows(spark, "op11_html_main_text", "pages")
    for r in queries.QUERIES["op11_html_main_text"](spark, SMALL).limit(20).collect():
        assert r.n_chars == len(r.text)
