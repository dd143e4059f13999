"""Vectors, tokens, urls, archives and learnt scores, and the pipeline."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwave.llm import bloom, packing, pstable, quality, queries, toxicity, warc
from siftwave.llm.tables import NO_ID, stored

from . import brute

SMALLEST = "/root/testdata/sf0.001"


def vectors(seed: int) -> list[tuple]:
    r = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        center = r.normal(size=16)
        for _ in range(int(r.integers(1, 14))):
            rows.append((center + r.normal(size=16) * r.choice([0.02, 0.1, 0.2])).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], None, [0.0] * 16, [math.nan] * 16, [None] * 16, [1.0], []]
    order = r.permutation(len(rows))
    return [(int(i) * 2, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [1024, 4])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(pstable, "BLOCK", block)
    rows = vectors(1)
    sound = lambda v: v is not None and len(v) == 16 and None not in v and all(map(math.isfinite, v)) and any(v)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if sound(v)}
    want = brute.groups([i for i, _ in rows], lambda a, b: a in unit and b in unit and float(unit[a] @ unit[b]) >= 0.9)
    df = spark.createDataFrame([(i, v, 5, 6) for i, v in rows + rows[:3]], "vec_id long, embedding array<double>, label int, key int")
    judged = pstable.near_vectors(df)
    got = judged.select("row.vec_id", "n_links", "component").collect()
    assert len(got) == len(rows) + 3 and {r[0]: (r[1], r[2]) for r in got} == want
    assert {r.vec_id for r in pstable.keep_one(df).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_embedding_dedup_of_nothing(spark):
    for rows in ([], [(1, None), (None, [0.0])]):
        got = pstable.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
        assert len(got) == len(rows) and all(r.n_links == 0 and r.component == r.key for r in got)


def test_vectors_of_any_length_and_id_are_compared(spark):
    rows = [(1, [1.0, 0.5, 0.0]), (4, [1.0, 0.5]), (5, [1.0, 0.51]), (2, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0]), (6, [0.0, 1e-300, 1.0]), (7, [-1e200, -1e200]), (8, [-1e200, -0.9e200]), (9, []), (None, None)]
    judged = pstable.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("row.vec_id", "row.embedding", "n_links", "component", "first").collect()
    assert len(judged) == len(rows)
    got = {(r.vec_id, str(r.embedding)): (r.n_links, r.component, r.first) for r in judged}
    assert got[(4, "[1.0, 0.5]")] == (1, 4, True) and got[(5, "[1.0, 0.51]")] == (1, 4, False)
    assert got[(2, "[0.0, 1.0, 0.0]")] == (1, NO_ID, False) and got[(None, "[0.0, 1.0, 0.01]")] == (1, NO_ID, True)
    assert got[(None, "[0.0, 0.0, 1.0]")] == (1, NO_ID, True) and got[(6, "[0.0, 1e-300, 1.0]")][:2] == (1, NO_ID)
    assert got[(7, "[-1e+200, -1e+200]")] == (1, 7, True) and got[(8, "[-1e+200, -9e+199]")] == (1, 7, False) and got[(9, "[]")] == (0, 9, True)


def test_pieces_of_equal_hash_get_their_own_ids():
    import pyarrow as pa

    from siftwave.llm import arrays, tokens

    word = "a"
    while len(word) < 4096:  # two words that a polynomial modulo 2 ** 64 can't tell apart
        word += word.translate({97: 98, 98: 97})
    twin = word.translate({97: 98, 98: 97})
    data, offsets = arrays.text_buffer(pa.array([word, twin]))
    p = arrays.prefix_sums(arrays.byte_values()[data])
    assert len(np.unique(arrays.span_hash(p, offsets[:-1], offsets[1:]))) == 1
    for texts in ([word, twin, word], [twin], [f"x {word} y", f"x {twin} y"]):
        fresh = tokens.Encoder(queries.tokenizer_file())
        fresh.encode(*arrays.text_buffer(pa.array(["x " + word])))  # known before
        ids, size, row, _, _ = fresh.encode(*arrays.text_buffer(pa.array(texts)))
        got = np.split(ids, np.cumsum(np.bincount(row, weights=size, minlength=len(texts)).astype(int))[:-1])
        assert [g.tolist() for g in got] == [fresh._ids(t) for t in texts]


def test_url_filter_of_long_hosts_and_bare_hosts(spark):
    long = ".".join(["a"] * 30_000) + ".bad.example"
    pages = [(1, f"http://{long}/x"), (2, "http://bad.example"), (3, "http://good.bad.example/y"), (4, f"http://{'b.' * 20_000}other/"), (5, "http://notbad.example/")]
    rules = spark.createDataFrame([("bad.example", "block"), ("good.bad.example/y", "allow"), (None, "block"), ("", "block")], "rule string, action string")
    got = {r.row.page_id: (r.rule, r.verdict) for r in bloom.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got == {1: ("bad.example", "block"), 2: ("bad.example", "block"), 3: ("good.bad.example/y", "allow"), 4: (None, "allow"), 5: (None, "allow")}


def test_tables_follow_from_the_recall():
    assert pstable.collision(0.1, 2.0) > pstable.collision(0.4, 2.0) > pstable.collision(1.4, 2.0)
    some, more = pstable.plan(10_000, 0.9, 0.9, 64), pstable.plan(10_000, 0.9, 0.999, 64)
    assert more.tables > some.tables and pstable.plan(10**8, 0.9, 0.999, 64).tables < 300


def test_hashing_keeps_its_recall_at_the_threshold():
    r = np.random.default_rng(7)
    a = pstable.unit(r.normal(size=(4000, 64)))
    side = r.normal(size=a.shape)
    side = pstable.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side  # cosine 0.9 exactly
    of = pstable.plan(100_000, 0.9, 0.99, 64)
    tables = pstable.Tables(64, of)
    assert (tables.buckets(a) == tables.buckets(b)).any(axis=1).mean() > 0.99 - 3 * (0.01 * 0.99 / 4000) ** 0.5


def test_best_cuts_are_the_cheapest():
    r = random.Random(3)
    for _ in range(60):
        place = np.unique([0] + [r.randint(1, 40) for _ in range(9)])
        if len(place) < 2 or np.diff(place).max() > 8:
            continue
        penalty = np.array([r.choice([0.0, 1.0, 4.0]) for _ in place])

        def cost(cuts):
            total = 0.0
            for a, b in itertools.pairwise(cuts):
                n = int(place[b] - place[a])
                exact = n & (n - 1) == 0 and (n >= packing.SHORTEST or b == len(place) - 1)
                total += (0 if exact else 8 - n) + penalty[b] + packing.WINDOW_COST
            return total

        inner = range(1, len(place) - 1)
        every = ([0, *c, len(place) - 1] for k in range(len(place) - 1) for c in itertools.combinations(inner, k))
        fits = [c for c in every if all(place[b] - place[a] <= 8 for a, b in itertools.pairwise(c))]
        assert cost(packing.best_cuts(place, penalty, 8).tolist()) == pytest.approx(min(map(cost, fits)))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    docs = [(i, t) for i, t in spark.read.parquet(f"{SMALLEST}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, None), (-1, ""), (-2, "no sentence " * 4000), (-3, "\n\n ! .")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, start int, body int").coalesce(2)
    pieces = packing.pack(df, path).collect()
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    for i, t in docs:
        own = sorted(by_doc[i], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in own), "<u4").tolist()
        assert ids == plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist() and {p.doc_tokens for p in own} == {len(ids)}
    padding = total = 0
    for own in by_window.values():
        own.sort(key=lambda p: p.offset)
        size = sum(p.length for p in own)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist() and 0 < size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
        total += size
    assert padding < 0.01 * total


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("a.org/fr/", "block"), ("a.org/fr/", "allow"), (None, "block")]
URLS = [
    "http://x.example.net/en/1?q#f",
    "HTTP://EXAMPLE.NET/en",
    "https://a.net",
    "https://a.net/",
    "https://a.org/fr/x",
    "http://b.org/fr/",
    "http://borg/fr/",
    "ftp://example.com/de/://x",
    "no scheme",
    None,
    "://",
    "http://é.com/de/",
    "http://example.com/de/?#",
    "http://sub.example.com/de/x",
    "http://example.com.net/en/",
    "x://net?/",
    "http://a.org:80/fr/",
]


def rule_of(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = brute.lower(rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best, action = None, "allow"
    for rule, said in sorted((x for x in RULES if x[0]), key=lambda x: (len(x[0]), x[0].index("/"), x[1])):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best, action = rule, said
    return host, path, best, action


@pytest.mark.parametrize("bound", [bloom.CASCADE_BYTES, 0])
def test_url_filter(spark, bound):
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string, keys string")
    rules = spark.createDataFrame(RULES, "rule string, action string")
    got = bloom.judge_urls(pages, rules, max_bytes=bound).select("row.page_id", "host", "path", "rule", "verdict").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: rule_of(u) for i, u in enumerate(URLS + URLS[:2])}
    none = bloom.judge_urls(pages, rules.limit(0)).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in none] == [(None, "allow")] and bloom.judge_urls(pages.limit(0), rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    cascade = bloom.build_cascade(keys.filter("key % 37 = 0"), keys)
    rows = bloom.hashed(keys).join(keys.select("key", F.xxhash64("key").alias("h1")), "h1").collect()
    u64 = lambda c: np.array([r[c] for r in rows], np.int64).view(np.uint64)
    assert cascade.contains(u64("h1"), u64("h2")).tolist() == [int(r.key) % 37 == 0 for r in rows]
    assert len(cascade.levels) >= 2


def test_archive_round_trip(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/\r\nb", big), (5, None, big), (3, "u", big), (4, "u", "small"), (9, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", other), (5, None, big)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    archive = warc.write_archive(pages)
    assert archive.payloads.count() == 4
    got = {r.key: r for r in warc.read_records(archive).collect()}
    assert warc.read_records(archive).count() == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        same = [k if k is not None else NO_ID for k, _, h in rows if h == html]
        first = len(body) < 1000 or (i if i is not None else NO_ID) == max(same)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, bytes(r.payload)) == (len(body), hashlib.sha1(body).hexdigest(), body)
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", max(same)))
    for r in warc.whole_records(archive).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert len(block) == int(fields[b"Content-Length"]) + 4 and block.endswith(b"\r\n\r\n") and b"\n" not in head.replace(b"\r\n", b"")
    broken = warc.Archive(archive.records, archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"x"))))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(broken).collect()
    assert warc.read_records(warc.write_archive(pages.limit(0))).count() == 0


def test_machine_is_the_sum_over_pairs():
    r = np.random.default_rng(2)
    m = toxicity.Machine(0.3, r.normal(size=5), r.normal(size=(5, 3)))
    want = 0.3 + m.weights[[0, 2, 4]].sum() + sum(m.factors[a] @ m.factors[b] for a, b in ((0, 2), (0, 4), (2, 4)))
    assert toxicity.logits(m, np.array([0, 0, 0]), np.array([0, 2, 4]), 2) == pytest.approx([want, 0.3])


def test_machine_learns_what_only_a_pair_means():
    r = np.random.default_rng(4)
    x = r.random((3000, 12)) < 0.4
    label = (x[:, 0] == x[:, 1]).astype(float)  # no single term tells anything
    row, index = np.nonzero(x)
    p = toxicity.scores(toxicity.fit(row, index, label, 12, epochs=60), row, index, 3000)
    assert ((p > 0.5) == (label > 0)).mean() > 0.95


def test_machine_finds_a_pair_among_thousands_of_other_terms():
    r = np.random.default_rng(8)
    x = np.concatenate([np.tile([[0, 0], [0, 1], [1, 0], [1, 1]], (1500, 1)), r.random((6000, 5000)) < 0.004], axis=1).astype(bool)
    label = (x[:, 0] == x[:, 1]).astype(float)
    seen = np.arange(6000) % 3 > 0
    ones, zeros = (x[seen & (label == k)].sum(axis=0) for k in (1, 0))
    assert (np.abs(ones - zeros) > 2 + abs(int(ones[0]) - int(zeros[0]))).sum() > 2500  # on their own, thousands of other terms tell more
    row, index = np.nonzero(x[seen])
    m = toxicity.fit(row, index, label[seen], 5002, epochs=60, start=toxicity.sure_weights(ones, zeros, int(label[seen].sum()), int((1 - label[seen]).sum())))
    row, index = np.nonzero(x[~seen])
    p = toxicity.scores(m, row, index, int((~seen).sum()))
    assert ((p > 0.5) == (label[~seen] > 0)).mean() > 0.9


def test_sure_weights():
    w = toxicity.sure_weights(np.array([20, 1, 10, 0] + [0] * 500), np.array([0, 0, 100, 0] + [1] * 500), 33, 330)
    assert w[0] > 3 and w[1] == w[2] == w[3] == 0  # one text among many terms is chance
    assert (toxicity.sure_weights(np.array([3]), np.array([0]), 3, 0) == 0).all()


def test_counts_cover_every_labelled_text(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} common" if i % 5 else None) for i in range(300)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    from siftwave.llm import labelled

    data = labelled.labelled(docs, labels, "doc_id", "text", "toxic", 20, 1 << 10)
    learnt = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert (data.ones, data.zeros) == (sum(i % 10 == 0 for i in learnt), sum(i % 10 > 0 for i in learnt))
    assert data.term_ones.max() == 0 and data.term_zeros.max() == sum(i % 5 > 0 for i in learnt)
    assert data.shares[0] > data.shares[1] and 5 < data.sampled.count() < 45


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(None, None, "x"), (-1, "", "y"), (-2, "idiot " * 20_000, "z")], "doc_id long, text string, score string")
    judged = toxicity.judge_toxicity(docs.select("doc_id", "text").withColumn("score", F.lit("s")).unionByName(odd), docs, labels)
    rows = judged.select("row.doc_id", "held_out", "score", "predicted").toPandas()
    assert len(rows) == 1003 and rows.score.between(0, 1).all()
    for r in rows.dropna().itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
    known = rows.merge(labels.toPandas(), on="doc_id")
    known = known[known.held_out]
    assert known.score[known.toxic == 1].mean() > 0.5 > 0.2 > known.score[known.toxic == 0].mean()
    clean = toxicity.remove_toxic(docs, docs, labels.limit(0))
    assert clean.columns == docs.columns and clean.count() == 1000


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, 0), (-1, "", "en", None, 0)], docs.schema)
    judged = quality.judge_quality(docs.unionByName(odd), labels, F.col("source"), F.concat_ws("/", "source", "lang")).toPandas()
    assert len(judged) == 1002 and judged.score.between(0, 1).all()
    known = judged.merge(labels.toPandas(), left_on="key", right_on="doc_id")
    held = known[known.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert quality.judge_quality(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
    assert quality.judge_quality(docs, labels.limit(0), F.col("source"), F.col("lang")).select("evidence").distinct().count() == 1


def test_sites_are_shrunk_towards_the_prior(spark):
    """With evidence that differs by site, the strength is finite and small sites stay near the mean."""
    r = np.random.default_rng(6)
    sites = spark.createDataFrame([(int(n), float(m)) for n, m in zip(r.integers(5, 60, 80), r.beta(4, 2, 80))], "n long, m double")
    assert 2 < quality._strength(sites, 4 / 6) < 30


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SMALLEST), name)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        rows = {r.doc_id: r.text for r in docs.collect()}
        was = {r.doc_id: r.text for r in before.collect()}
        assert set(rows) <= set(was)
        if name == "line_dedup":
            want = brute.without_lines(list(was.items()))
            assert rows == {i: x[2] for i, x in want.items()}
            assert docs.filter("n_chars <> length(text)").count() == 0
        if name == "ngram_jaccard_join":
            assert set(rows) == {i for i, (_, c) in brute.jaccard_groups(list(was.items())).items() if c == i}
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALLEST}/benchmark.parquet").collect()]
            want = brute.contamination(list(was.items()), items)
            assert set(rows) == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    packed = corpus_pipeline.pack_sequences(spark, docs, SMALLEST)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(rows)
    assert corpus_pipeline.run(spark, SMALLEST).count() == packed.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALLEST}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALLEST)
    want = con.sql(queries.ORACLE[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
