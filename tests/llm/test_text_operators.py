"""Operators on texts against brute force, on rows with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwave.llm import chosenpath, lines, substrings, suffixes
from siftwave.llm.tables import stored

from . import brute

SCHEMA = "doc_id long, text string, key long, row string, body string, n_words int, runs string, component long, kept string"


def table(spark, docs):
    return spark.createDataFrame([(i, t, 7, "r", None, 1, "x", 3, "k") for i, t in docs], SCHEMA)


def corpus(seed: int, size: int = 60, vocabulary: int = 400) -> list[tuple]:
    r = random.Random(seed)
    vocab = [r.choice(["", "É", "Q"]) + "".join(r.choice("abcdeé.,") for _ in range(r.randint(2, 6))) for _ in range(vocabulary)]
    passages = [" ".join(r.choice(vocab) for _ in range(30)) for _ in range(4)]
    boiler = ["All rights reserved by everyone.", "  SHORT", "one very common line, that many share\t"]
    docs = []
    for i in range(size):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 4))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), r.choice(boiler))
        docs.append((i * 3, r.choice(["\n", "\n", " \n"]).join(parts)))
    docs += [(1000 + i, docs[r.randint(0, size - 1)][1]) for i in range(12)]
    for i in range(12):
        w = docs[r.randint(0, size - 1)][1].split(" ")
        w[r.randint(0, len(w) - 1)] = "changed"
        docs.append((2000 + i, " ".join(w)))
    docs += [(1, None), (2, ""), (4, " \t\n "), (5, "one two"), (7, "one  two"), (3000, " ".join(r.choice(vocab) for _ in range(6000)) + "\n" + passages[0])]
    return docs


def answers(df, *columns):
    rows = df.select("row.doc_id", *columns).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def test_substring_dedup(spark):
    docs = corpus(1)
    judged = substrings.judge_repeats(table(spark, docs + docs[:3]), k=20)
    assert judged.count() == len(docs) + 3
    assert answers(judged, "n_words", "n_removed", "kept") == brute.without_repeats(docs)
    spans = {(r.key, r.start): r for r in substrings.repeated_spans(table(spark, docs)).collect()}
    split = {i: brute.words(t) for i, t in docs}
    for r in spans.values():
        assert r.n_words >= 20 and (r.source_key, r.source_start) < (r.key, r.start)
        assert split[r.key][r.start : r.start + r.n_words] == split[r.source_key][r.source_start : r.source_start + r.n_words]
    out = substrings.remove_repeats(table(spark, docs))
    assert out.columns == table(spark, docs).columns


def test_line_dedup(spark):
    docs = corpus(2)
    state = lines.new_state(table(spark, docs + docs[:3]))
    want = brute.without_lines(docs)
    assert answers(lines.judge_lines(table(spark, docs), state), "n_lines", "n_dropped", "kept") == want
    assert any(n for _, n, _ in want.values())


def test_line_dedup_without_broadcast_filters(spark, monkeypatch):
    monkeypatch.setattr(lines, "FILTER_BYTES", -1)
    docs = corpus(3, 20)
    judged = lines.judge_lines(table(spark, docs), lines.new_state(table(spark, docs), shards=3))
    assert answers(judged, "n_lines", "n_dropped", "kept") == brute.without_lines(docs)


def test_line_dedup_is_reversible(spark):
    docs = corpus(4, 24)
    first, more = docs[::2], docs[1::2]
    state = lines.insert(lines.new_state(table(spark, first), shards=2), table(spark, more))
    grown = answers(lines.judge_lines(table(spark, docs), state), "n_dropped", "kept")
    assert grown == {i: x[1:] for i, x in brute.without_lines(docs).items()}
    state = lines.delete(state, spark.createDataFrame([(i,) for i, _ in more], "doc_id long"))
    assert answers(lines.judge_lines(table(spark, first), state), "n_dropped", "kept") == {i: x[1:] for i, x in brute.without_lines(first).items()}
    again = lines.new_state(table(spark, first), shards=2)
    as_set = lambda s: {(r.shard, bytes(r.digest), r.n_docs, r.top_doc) for r in s.counts.collect()}
    assert as_set(state) == as_set(again)


def shared_ids(seed: int) -> list[tuple]:
    """Long and short texts of which many have a null id and many the same one; some rows twice."""
    docs = corpus(seed, 30)
    docs = [(None if n % 3 == 0 else 9 if n % 3 == 1 else i, t) for n, (i, t) in enumerate(docs)]
    return docs + docs[:4]


def test_line_dedup_of_different_texts_of_one_id(spark):
    docs = shared_ids(8)
    known = [(-1 if i is None else i, t) for i, t in docs]
    want = [(i, *brute.without_lines([*known, (i, t)])[i]) for i, t in known]  # the last row of an id gives its answer
    judged = lines.judge_lines(table(spark, docs), lines.new_state(table(spark, docs)))
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in judged.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert sorted(got) == sorted(want) and any(n for _, _, n, _ in want)


def test_substring_dedup_of_different_texts_of_one_id(spark):
    docs = shared_ids(9)
    marked = table(spark, docs).select(F.coalesce("doc_id", F.lit(-1)), F.xxhash64("text"), "text").collect()
    places = {place: n for n, place in enumerate(sorted({(i, m) for i, m, _ in marked}))}
    out = brute.without_repeats([(places[i, m], t) for i, m, t in marked])
    want = [(i, *out[places[i, m]]) for i, m, _ in marked]
    judged = substrings.judge_repeats(table(spark, docs), k=20)
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in judged.select("row.doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got) == sorted(want) and any(n for _, _, n, _ in want)


def test_benchmark_decontamination(spark):
    docs = corpus(5)
    w = brute.words(docs[3][1] + " " + docs[4][1])
    items = [(1, " ".join(w[:40])), (2, "ONE, two!"), (10, " ".join(brute.words(docs[0][1])[:15])), (3, None), (4, "..."), (None, " ".join(w[60:75]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, [("" if i is None else i, t) for i, t in items])
    for bound in (suffixes.BENCHMARK_BYTES, 120):
        judged = suffixes.judge_contamination(table(spark, docs + docs[:3]), bench, max_bytes=bound)
        got = answers(judged, "n_words", "n_hit", "items", "contaminated")
        assert {i: x[:3] for i, x in got.items()} == want
        assert {i: x[3] for i, x in got.items()} == {i: h > 0 and 20 * h >= n for i, (n, h, _) in want.items()}
    left = {r.doc_id for r in suffixes.decontaminate(table(spark, docs), bench).collect()}
    assert left == {i for i, (n, h, _) in want.items() if not (h > 0 and 20 * h >= n)}


def test_longest_matches(spark):
    docs = corpus(6, 20)
    text = [brute.words(brute.lower(t or ""), brute.ALNUM) for _, t in docs]
    item = text[3][:50]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    want = set()
    for (i, _), w in zip(docs, text):
        for a in range(len(item)):
            for b in range(len(w)):
                if a and b and item[a - 1] == w[b - 1]:
                    continue
                n = 0
                while a + n < len(item) and b + n < len(w) and item[a + n] == w[b + n]:
                    n += 1
                if n >= 13:
                    want.add((i, "1", a, b, n))
    got = {tuple(r) for r in suffixes.longest_matches(table(spark, docs), bench).collect()}
    assert got == want and want


@pytest.mark.parametrize("small,block", [(64, 512), (3, 4)])
def test_jaccard_join(spark, monkeypatch, small, block):
    monkeypatch.setattr(chosenpath, "SMALL", small)
    monkeypatch.setattr(chosenpath, "BLOCK", block)
    monkeypatch.setattr(chosenpath, "MATES", block)
    docs = corpus(7, 40)
    base = docs[5][1].split(" ")
    shared = " ".join(f"w{i}" for i in range(40))
    docs += [(5000 + i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(15)]
    docs += [(6000 + i, shared + " " + " ".join(f"own{i}_{j}" for j in range(25))) for i in range(20)]
    judged = chosenpath.judge_near(table(spark, docs + docs[:3]))
    assert answers(judged, "n_links", "component") == brute.jaccard_groups(docs)
    kept = chosenpath.keep_one(table(spark, docs + docs[:3]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute.jaccard_groups(docs).items() if c == i)


def test_documents_without_an_id_are_compared_each(spark):
    r = random.Random(4)
    t1, t2, t3 = (" ".join(r.choice("abcdefgh") * 3 + str(r.randint(0, 99)) for _ in range(60)) for _ in range(3))
    docs = [(None, t1), (None, t2), (None, t3), (None, t1), (1, t1), (2, t2), (3, t2 + " end"), (9, None), (None, None), (None, "")]
    judged = chosenpath.judge_near(table(spark, docs)).select("row.doc_id", "row.text", "n_links", "component", "first").collect()
    assert len(judged) == len(docs)
    got = {(x.doc_id, x.text): (x.n_links, x.component, x.first) for x in judged}
    assert got[(1, t1)][0] == 1 and got[(2, t2)][0] == got[(3, t2 + " end")][0] == got[(None, t2)][0] == 2
    assert got[(None, t1)][0] == 1 and got[(None, t3)][0] == 0 and not got[(2, t2)][2] and got[(None, t2)][2]
    kept = sorted((repr((x.doc_id, x.text)) for x in chosenpath.keep_one(table(spark, docs)).collect()))
    assert kept == sorted(map(repr, [(None, t1), (None, t2), (None, t3), (9, None), (None, None), (None, "")]))


def test_long_texts_are_compared_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosenpath, "BLOCK_BYTES", 20_000)
    base = [f"word{i}" for i in range(900)]
    docs = [(i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(12)] + [(50, "something else entirely here")]
    assert answers(chosenpath.judge_near(table(spark, docs)), "n_links", "component") == brute.jaccard_groups(docs)


def test_filters_let_every_wanted_key_through(spark):
    from siftwave.llm import picking

    keys = spark.range(0, 3_000_000, 7).selectExpr("xxhash64(id) h")
    shared = picking.wanted_filter(keys)
    every = spark.range(0, 3_000_000).selectExpr("id", "xxhash64(id) h").filter(picking.may_be_wanted(shared, F.col("h")))
    wanted, others = every.filter("id % 7 = 0").count(), every.filter("id % 7 > 0").count()
    assert wanted == keys.count() and others < 150_000


def test_runs_follow_from_the_recall():
    meet = chosenpath.first_meeting(0.8)
    assert 0.5 < meet < 1 and chosenpath.runs_for(0.9, meet) < chosenpath.runs_for(0.999, meet)
    assert 1 - (1 - meet) ** chosenpath.runs_for(0.999, meet) >= 0.999
    assert chosenpath.path_length(1_000) < chosenpath.path_length(1_000_000)


@pytest.mark.parametrize("sets", [100_000, 1_000_000, 10_000_000])
def test_longer_paths_meet_with_the_target_recall(sets):
    pairs, shared, own = 3000, 40, 5  # Jaccard similarity 40 / 50
    first_runs, recall = chosenpath.plan(0.8, 0.995)
    assert (1 - (1 - chosenpath.first_meeting(0.8)) ** first_runs) * recall >= 0.995 - 1e-12
    length = chosenpath.path_length(sets)
    runs = chosenpath.runs_for(recall, 0.8**length)
    random = np.random.default_rng(3)
    both = random.integers(0, 1 << 64, (pairs, shared), np.uint64)
    sides = [np.sort(np.hstack([both, random.integers(0, 1 << 64, (pairs, own), np.uint64)]), axis=1) for _ in range(2)]
    count = np.full(pairs, shared + own)
    ends = zip(*[chosenpath.end_nodes(side.ravel(), count, runs, length) for side in sides])
    met = np.zeros(pairs, bool)
    for a, b in ends:
        met |= a == b
    assert met.mean() >= recall - 3 * (recall * (1 - recall) / pairs) ** 0.5


def test_empty_tables_and_null_ids(spark):
    none = table(spark, [])
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    for docs, rows in ((none, 0), (table(spark, [(None, "a b c"), (None, None), (3, "a b c")]), 3)):
        docs = stored(docs, "docs")
        assert substrings.remove_repeats(docs).count() == rows
        assert lines.dedup_lines(docs).count() == rows
        assert suffixes.judge_contamination(docs, empty).filter("contaminated").count() == 0
        assert suffixes.judge_contamination(docs, bench).count() == rows
        assert chosenpath.judge_near(docs).count() == rows
    null = chosenpath.judge_near(table(spark, [(None, "a b c"), (3, "a b c")])).select("row.doc_id", "n_links", F.col("key") == F.col("component")).collect()
    assert {tuple(r) for r in null} == {(None, 1, True), (3, 1, False)}
