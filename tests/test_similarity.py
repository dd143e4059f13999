import random
import re

from pyspark.sql import functions as F

from siftwave.functions import similarity as sets
from siftwave.operators import similarity as similar


def grams(text):
    words = re.findall(r"<[A-Z]+>|[^\W_]+", text)
    words = [w if w.startswith("<") else w.lower() for w in words]
    if len(words) < 3:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def frame(spark, texts, name="id"):
    rows = spark.createDataFrame(list(enumerate(texts)), f"{name} long, text string")
    return rows.select(name, sets.shingles(F.col("text")).alias("shingles"))


def test_tokens_and_shingles(column):
    assert column(sets.tokens, ["Xin CHÀO, <URL> a_b!"]) == [["xin", "chào", "<URL>", "a", "b"]]
    assert column(sets.shingles, ["", "a b", "a b c", "a b c a b c"]) == [[], ["a b"], ["a b c"], ["a b c", "b c a", "c a b"]]


def test_fingerprint_is_sorted_hex(column):
    prints = column(sets.fingerprint, ["a b c d", ""])
    assert prints[0] == sorted(prints[0]) and len(prints[0]) == 2 and all(re.fullmatch("[0-9a-f]{12}", h) for h in prints[0])
    assert prints[1] == []


def test_best_template_prefers_coverage_then_id(spark):
    texts = ["a b c d e x", "nothing here at all", "a b c d e f and more"]
    templates = [("tpl_2", "a b c d e f"), ("tpl_1", "A b c d e f"), ("tpl_3", "b c d e"), ("tpl_4", "")]
    messages = frame(spark, texts, "msg_id")
    known = spark.createDataFrame(templates, "tpl_id string, text string").select("tpl_id", sets.shingles(F.col("text")).alias("shingles"))
    for limit in (1_000, 0):
        out = {r.msg_id: (r.tpl_id, r.coverage) for r in similar.best_template(messages, known, 0.6, limit).collect()}
        assert out == {0: ("tpl_3", 1.0), 2: ("tpl_1", 1.0)}


def random_texts(rng, n, words, hot=False):
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            base = rng.choice(texts).split()
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))))
    if hot:
        stem = " ".join(words[:12])
        texts += [f"{stem} {' '.join(words[:8])} {rng.choice(words)} {i % 7}" for i in range(n // 2)]
    return texts


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = random_texts(rng, 150, words, hot=True)
    sets_ = [grams(t) for t in texts]
    first = {}
    for i, s in enumerate(sets_):
        if s:
            first.setdefault(frozenset(s), i)
    reps = sorted(first.values())
    expected = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if jaccard(sets_[a], sets_[b]) >= 0.8}
    found = {(r.id_a, r.id_b) for r in similar.near_pairs(frame(spark, texts)).collect()}
    assert found == expected


def long_texts(rng, stems, words):
    """Long texts with near copies on both sides of the threshold, and exact ones."""
    texts = []
    for _ in range(stems):
        stem = [rng.choice(words) for _ in range(rng.choice([4, 20, 60, 180]))]
        for changes in (0, 0, 1, 2, 4, 7):
            copy = list(stem)
            for _ in range(changes * len(stem) // 60 + (changes > 0)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_near_pairs_deal_and_write_prefixes_only(spark, monkeypatch):
    rng = random.Random(8)
    texts = long_texts(rng, 60, [f"w{i}" for i in range(40)])
    sets_ = {f"t{i}": grams(t) for i, t in enumerate(texts)}
    first = {}
    for i in sorted(sets_):  # as strings
        first.setdefault(frozenset(sets_[i]), i)
    reps = sorted(first.values())
    expected = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if jaccard(sets_[a], sets_[b]) >= 0.8}
    written, cut = [], similar.cut
    monkeypatch.setattr(similar, "cut", lambda df: written.append(cut(df)) or written[-1])
    rows = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "id string, text string")
    found = {(r.id_a, r.id_b) for r in similar.near_pairs(rows, shingles=sets.shingles(F.col("text"))).collect()}
    assert found == expected and len(expected) > 25
    arrays = [[n for n, kind in df.dtypes if kind.startswith("array")] for df in written]
    assert sum(arrays, []) == ["prefix"]
    kept = next(df for df in written if "prefix" in df.columns).agg(F.sum("n").alias("n"), F.sum(F.size("prefix")).alias("p")).first()
    assert kept.p < 0.35 * kept.n


def test_near_pairs_do_not_depend_on_the_counted_sets(spark, monkeypatch):
    texts = long_texts(random.Random(9), 12, [f"w{i}" for i in range(30)])
    pairs = lambda: {tuple(r) for r in similar.near_pairs(frame(spark, texts)).collect()}
    found = pairs()
    for name, value in (("COUNTED", 1), ("FREQUENT", 0)):
        monkeypatch.setattr(similar, name, value)
        assert pairs() == found


def sequential(texts, threshold=0.8):
    kept = []
    for i, t in enumerate(texts):
        if all(jaccard(grams(t), grams(texts[k])) < threshold for k in kept):
            kept.append(i)
    return set(kept)


def test_greedy_dedup_equals_sequential_loop(spark):
    words = [f"w{i}" for i in range(25)]
    for seed, limit in ((1, 64), (2, 1), (3, 3)):
        texts = random_texts(random.Random(seed), 90, words, hot=True) + ["", ""]
        kept = {r.id for r in similar.greedy_dedup(frame(spark, texts), bucket_limit=limit).collect()}
        assert kept == sequential(texts)


def test_greedy_dedup_survives_a_hot_group_of_near_copies(spark):
    stem = " ".join(f"s{i}" for i in range(40))
    texts = [f"{stem} v{i}" for i in range(400)] + [f"other {i} text number {i} here" for i in range(50)]
    kept = {r.id for r in similar.greedy_dedup(frame(spark, texts)).collect()}
    assert kept == sequential(texts) and len(kept) == 51


def test_copies_fold_onto_the_first(spark):
    out = {r.id: r.rep for r in similar.fold_equal_sets(frame(spark, ["a b c", "A, b c!", "", "x y z"])).collect()}
    assert out == {0: 0, 1: 0, 3: 3}


def test_known_sets_match_on_both_paths(spark):
    rng = random.Random(9)
    texts = random_texts(rng, 80, [f"w{i}" for i in range(20)])
    known = texts[:10] + [texts[40] + " extra"]
    expected = {i for i, t in enumerate(texts) if any(jaccard(grams(t), grams(k)) >= 0.8 for k in known)}
    for limit in (100_000, 0):
        out = similar.near_sets(frame(spark, texts), frame(spark, known).select("shingles"), max_index_rows=limit)
        assert {r.id for r in out.collect()} == expected


def test_join_groups_keeps_all_rows_of_a_hot_group(spark):
    from siftwave.operators import joins

    rows = spark.range(600).select("id", F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"))
    groups = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    out = joins.join_groups(rows, groups, ["key"], "n")
    assert out.count() == 600 and out.filter("key = 'hot'").select("first").distinct().collect()[0].first == 0
    assert joins.join_groups(rows, groups.filter("n > 50").select("key", "n"), ["key"], "n", "left_anti").count() == 300


def test_lookup_join_gives_the_same_rows_on_both_paths(spark):
    from siftwave.operators import joins

    left = spark.range(200).select("id", (F.col("id") % 7).alias("k"))
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = joins.lookup_join(left, right, ["k"], how).select("id", "k")
        salted = joins.lookup_join(left, right, ["k"], how, max_rows=1).select("id", "k")
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, salted.collect()))


def test_greedy_dedup_ends_soon_on_unlike_texts_with_common_shingles(spark, monkeypatch):
    """Rounds grow with the logarithm of a bucket: before, each one decided a single text of it."""
    rows = [(i, ["c1", "c2", "c3"] + [f"{i % 40}-{j}" for j in range(4)] + [f"{i // 40}+{j}" for j in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, shingles array<string>")
    rounds, among = [], similar._among
    monkeypatch.setattr(similar, "_among", lambda *args: rounds.append(1) or among(*args))
    assert similar.greedy_dedup(df, bucket_limit=4).count() == 60
    assert len(rounds) <= 6


def test_tokens_are_dealt_once_for_prefixes(spark):
    rows = [(i, [i, i + 1, 100 + i, 1000]) for i in range(20)]
    sets = spark.createDataFrame(rows, "id long, h array<long>")
    prefixes = similar.prefix_tokens(sets, 0.5)
    found = {(r.id, r.token, r.df, r.n, r.pos) for r in prefixes.collect()}
    want = set()
    count = {}
    for _, h in rows:
        for t in h:
            count[t] = count.get(t, 0) + 1
    for i, h in rows:
        order = sorted(h, key=lambda t: (count[t] > 1 and count[t], t))
        want |= {(i, t, count[t], 4, pos) for pos, t in enumerate(order[:3]) if count[t] > 1}
    assert found == want
    assert "ReusedExchange" in prefixes._jdf.queryExecution().executedPlan().toString()


def test_large_index_of_known_sets_is_not_repeated_by_salts(spark):
    """Both ways give the same ids; the one for a large index joins by rare tokens, without salts."""
    rng = random.Random(5)
    sets_ = [rng.sample(range(60), rng.randint(1, 12)) for _ in range(150)]
    sets_ += [sorted({*s[1:], 77}) for s in sets_[:60]] + [[]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets_)], "id long, fp array<long>")
    known = df.filter("id % 9 = 0").select("fp")
    targets = [set(s) for i, s in enumerate(sets_) if i % 9 == 0 and s]
    want = {i for i, s in enumerate(sets_) if any(len(set(s) & t) >= 0.8 * len(set(s) | t) - 1e-9 for t in targets)}
    found = similar.fingerprint_matches(df, known, max_index_rows=1)
    assert {r.id for r in found.collect()} == want
    assert found.count() == len(want)
    plan = found._jdf.queryExecution().toString()
    assert "sequence(" not in plan
    assert {r.id for r in similar.fingerprint_matches(df, known).collect()} == want
