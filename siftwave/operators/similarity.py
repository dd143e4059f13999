"""Set-similarity joins on shingle arrays.

No join here compares all pairs. A pair that reaches the threshold must share a
token inside the *prefix* of both sets under one common token order, so only
prefix tokens are joined and only the pairs found this way are verified, on the
whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import cut
from .joins import BROADCAST_ROWS, is_small, join_groups, lookup_join

BUCKET_LIMIT = 64  # larger buckets take the bucket-minimum route of greedy_dedup
SALTS = 16
PICKED_ROWS = 4_000_000  # so many ids are broadcast to pick sets, if they fit in the bytes
SALT_ABOVE = 1_000  # tokens seen more often than this are salted
COUNTED = 16  # one set in so many is counted to order the tokens of near_pairs
FREQUENT = 1_000_000  # tokens whose count orders them; no pair depends on it
SHARED, SHARED_STEP = 3, 16  # prefix tokens that two near sets of near_pairs share at least: more in longer sets


def prefix_size(n: Column, threshold: float) -> Column:
    """Prefix length for Jaccard or coverage at least ``threshold`` of a set of ``n`` tokens."""
    needed = F.ceil(n * F.lit(threshold) - F.lit(1e-9))
    return (n - needed + 1).cast("int")


def repeated_tokens(tokens: DataFrame, column: str) -> DataFrame:
    """All tokens that occur more than once, with their counts, written once.

    As a table of its own it can meet the tokens in any way the planner finds best:
    broadcast if its size allows, else a join whose hot keys are split at run time.
    """
    return cut(tokens.groupBy(column).agg(F.count("*").alias("df")).filter("df > 1"))


def template_index(templates: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(sets, prefixes)`` of ``templates(tpl_id, shingles)``.

    Equal sets are folded onto their smallest id. Tokens shared by few templates
    come first, which keeps the prefixes selective. Both tables are written once,
    because every scoring plan reads them more than once.
    """
    sets = (
        templates.filter(F.size("shingles") > 0)
        .groupBy(F.sort_array("shingles").alias("tpl_shingles"))
        .agg(F.min("tpl_id").alias("tpl_id"))
        .withColumn("tpl_size", F.size("tpl_shingles"))
    )
    sets = cut(sets)
    tokens = sets.select("tpl_id", "tpl_size", F.explode("tpl_shingles").alias("shingle"))
    ordered = (
        tokens.join(repeated_tokens(tokens, "shingle"), "shingle", "left")
        .groupBy("tpl_id", "tpl_size")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle"))).alias("ordered"))
    )
    prefix = F.slice("ordered", F.lit(1), prefix_size(F.col("tpl_size"), threshold))
    prefixes = ordered.select("tpl_id", F.explode(prefix).alias("t")).select("tpl_id", F.col("t.shingle").alias("shingle"))
    return sets, cut(prefixes)


def template_matches(
    messages: DataFrame,
    templates: DataFrame,
    threshold: float = fv.MIN_TEMPLATE_COVERAGE,
    max_index_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(msg_id, tpl_id, coverage)`` of all templates covered at least ``threshold``.

    Input: ``messages(msg_id, shingles)`` and ``templates(tpl_id, shingles)``.
    Equal templates answer with their smallest id. With a template index below
    ``max_index_rows`` messages are never shuffled: shingles are exploded,
    probed and verified in one stage. A larger index is joined by hash with a
    salt, and sets meet again only for the pairs found.
    """
    sets, prefixes = template_index(templates, threshold)
    whole = messages.select("msg_id", F.col("shingles").alias("msg_shingles"))
    shared = F.size(F.array_intersect("tpl_shingles", "msg_shingles"))
    score = (shared / F.col("tpl_size")).alias("coverage")
    reached = F.col("coverage") >= threshold
    if is_small(prefixes, max_index_rows) and is_small(sets, max_index_rows):
        probes = whole.select("msg_id", "msg_shingles", F.explode("msg_shingles").alias("shingle"))
        found = probes.join(F.broadcast(prefixes), "shingle").join(F.broadcast(sets), "tpl_id")
        scored = found.select("msg_id", "tpl_id", score).filter(reached)
        return scored.distinct()
    probes = whole.select("msg_id", F.explode(F.transform("msg_shingles", lambda s: F.xxhash64(s))).alias("h"))
    index = prefixes.select("tpl_id", F.xxhash64("shingle").alias("h"))
    salted = probes.withColumn("s", F.pmod(F.xxhash64("msg_id"), F.lit(SALTS)))
    repeated = index.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pairs = salted.join(repeated, ["h", "s"]).select("msg_id", "tpl_id").distinct()
    return pairs.join(sets, "tpl_id").join(whole, "msg_id").select("msg_id", "tpl_id", score).filter(reached)


def best_template(
    messages: DataFrame,
    templates: DataFrame,
    threshold: float = fv.MIN_TEMPLATE_COVERAGE,
    max_index_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Best covered template per message: highest coverage, then smallest id."""
    matches = template_matches(messages, templates, threshold, max_index_rows)
    best = F.min(F.struct((-F.col("coverage")).alias("rank"), "tpl_id")).alias("best")
    return matches.groupBy("msg_id").agg(best).select(
        "msg_id", F.col("best.tpl_id").alias("tpl_id"), (-F.col("best.rank")).alias("coverage")
    )


def hashed_sets(df: DataFrame) -> DataFrame:
    """``(id, h, digest)`` of the non-empty sets: hashed shingles and a digest of the whole set."""
    h = F.transform("shingles", lambda s: F.xxhash64(s))
    sets = df.filter(F.size("shingles") > 0).select("id", F.sort_array(h).alias("h"))
    return sets.select("id", "h", F.sha2(F.array_join(F.col("h").cast("array<string>"), ","), 256).alias("digest"))


def fold_equal_sets(df: DataFrame) -> DataFrame:
    """``(id, rep)``: every text with the first text that has the same shingle set.

    Copies are folded by a digest with a map-side minimum, so a third of all rows
    being copies of one text costs one row per task. Empty sets match nothing.
    """
    hashed = hashed_sets(df)
    keyed = cut(hashed.select("id", "digest"))
    first = keyed.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    return join_groups(keyed, first, ["digest"], "n").select("id", "rep")


def distinct_sets(df: DataFrame) -> DataFrame:
    """One row ``(id, h)`` per distinct non-empty shingle set: smallest id, hashed shingles.

    Written once: prefixes and verification both read it, and eight bytes per
    shingle are far less than the text they come from.
    """
    keyed = cut(hashed_sets(df))
    first = cut(keyed.groupBy("digest").agg(F.min("id").alias("id")).select("id"))
    return picked(keyed, first).select("id", "h")


def picked(sets: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``sets`` whose id is in ``ids``, a written table: long rows stay where they are while the ids can be broadcast."""
    return sets.join(F.broadcast(ids) if is_small(ids, PICKED_ROWS) else ids, key, "left_semi")


def prefix_tokens(sets: DataFrame, threshold: float) -> DataFrame:
    """``(token, df, id, n, pos)``: prefix tokens of each set that other sets hold too, rare tokens first.

    The token order is (how often it occurs, its hash). Any fixed order keeps the join
    exact; this one keeps frequent tokens out of the prefixes. Tokens of one set only come
    first of all and meet nothing: they take up places of the prefix and are not emitted.
    Tokens are dealt once, for their counts and for the join with them: a token has at
    most one row per set, so none is hot.
    """
    tokens = sets.select("id", F.size("h").alias("n"), F.explode("h").alias("token")).repartition("token")
    every = F.count_if(F.col("id").isNotNull() & (F.col("n") > 0))  # a count that reads all columns, so that both sides are one shuffle
    repeated = tokens.groupBy("token").agg(every.alias("df")).filter("df > 1")
    held = tokens.join(repeated, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ordered"))
    alone = F.col("n") - F.size("ordered")
    left = F.greatest(prefix_size(F.col("n"), threshold) - alone, F.lit(0))
    return held.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("ordered", F.lit(1), left)).alias("i", "t")).select(
        F.col("t.token").alias("token"), F.col("t.df").alias("df"), "id", "n", (F.col("alone") + F.col("i")).alias("pos")
    )


def _may_reach(threshold: float) -> Column:
    """Size and position bounds of a candidate pair."""
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    seen = F.least("a.pos", "b.pos")
    needed = F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - F.lit(1e-6)
    return (small >= large * F.lit(threshold) - F.lit(1e-6)) & (left + seen >= needed)


def _candidates(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``(id_a < id_b)`` that share a prefix token."""
    return _meet(prefixes, prefixes, threshold)


def _meet(earlier: DataFrame, later: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``(id_a < id_b)`` of two tables of prefix tokens.

    Only frequent tokens are salted: their left rows are spread by id, their
    right rows repeated once per salt.
    """
    zero, last = F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")
    frequent = F.col("df") > SALT_ABOVE
    a = earlier.withColumn("salt", F.when(frequent, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(zero)).alias("a")
    every = F.when(frequent, F.sequence(zero, last)).otherwise(F.array(zero))
    b = later.withColumn("salt", F.explode(every)).alias("b")
    same = (F.col("a.token") == F.col("b.token")) & (F.col("a.salt") == F.col("b.salt"))
    joined = a.join(b, same & (F.col("a.id") < F.col("b.id")) & _may_reach(threshold))
    return joined.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float, h: Column | None = None) -> DataFrame:
    """Pairs whose whole sets reach the threshold, with their similarity.

    Only sets that are in a pair travel, and only for them ``h`` is made.
    """
    pairs = cut(pairs)
    ids = cut(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct())
    sets = picked(sets, ids).select("id", (F.col("h") if h is None else h).alias("h"))
    a = sets.select(F.col("id").alias("id_a"), F.col("h").alias("h_a"))
    b = sets.select(F.col("id").alias("id_b"), F.col("h").alias("h_b"))
    shared = F.size(F.array_intersect("h_a", "h_b"))
    both = pairs.join(a, "id_a").join(b, "id_b").select(
        "id_a", "id_b", shared.alias("s"), F.size("h_a").alias("n"), F.size("h_b").alias("m")
    )
    score = F.col("s") / (F.col("n") + F.col("m") - F.col("s"))
    return both.select("id_a", "id_b", score.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def _hashes(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def frequent_tokens(df: DataFrame, shingles: Column) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT`` hashed shingles that many sets of ``df(id, ...)`` hold, ascending, and their counts.

    Every ``COUNTED``-th set by the hash of its id is counted. The counts only set the
    order of the tokens; any order gives the same pairs, this one keeps the tokens that
    many sets share out of the prefixes.
    """
    some = df.filter(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0)
    tokens = some.select(F.explode(_hashes(shingles)).alias("token"))
    counts = cut(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    least, held = 2, 0
    for n, many in sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True):  # a row per count
        held += many
        if held > FREQUENT:
            least = n + 1
            break
    rows = counts.filter(F.col("n") >= least).toArrow()
    found, n = rows["token"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def outside_prefix(n: Column, threshold: float) -> Column:
    """Tokens of a set of ``n`` that ``_digests_and_prefixes`` leaves out."""
    needed = F.ceil(n * F.lit(threshold) - F.lit(1e-9))
    return needed - F.least(F.lit(SHARED) + F.floor(n / SHARED_STEP), needed)


def _digests_and_prefixes(batches: Iterable[pa.RecordBatch], threshold: float, tokens: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(id, h)``, ``h`` ascending and not empty, to ``(id, digest, n, prefix)``: first tokens by (count, hash)."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):  # bounds what is held beside the batch
            part = batch.slice(start, 500)
            h = part.column("h").flatten().to_numpy(zero_copy_only=False)
            n = part.column("h").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            digests = [sha256(h[e - k : e].tobytes()).digest() for k, e in zip(n.tolist(), ends.tolist())]
            rank = np.zeros(len(h), np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                rank = np.where(tokens[at] == h, counts[at], 0)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((rank, row))  # stable, so hashes stay ascending
            needed = np.ceil(n * threshold - 1e-9).astype(np.int64)
            size = n - needed + np.minimum(SHARED + n // SHARED_STEP, needed)  # as in outside_prefix
            first = (np.arange(len(h)) - np.repeat(ends - n, n)) < np.repeat(size, n)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[order][first]))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.binary()), pa.array(n.astype(np.int32)), prefix], names=["id", "digest", "n", "prefix"])


def prefixed_sets(df: DataFrame, shingles: Column, threshold: float = fv.NEAR_DUPLICATE_JACCARD) -> DataFrame:
    """``(k, id, digest, n, prefix)`` of the non-empty sets ``shingles`` of ``df(id, ...)``, written once; ``k`` numbers them.

    All tokens of a set meet in its scan, where their order is known, so only prefixes leave it.
    """
    tokens, counts = (df.sparkSession.sparkContext.broadcast(a) for a in frequent_tokens(df, shingles))
    hashed = df.select("id", F.sort_array(_hashes(shingles)).alias("h")).filter(F.size("h") > 0)
    kind = dict(df.dtypes)["id"]
    made = hashed.mapInArrow(lambda batches: _digests_and_prefixes(batches, threshold, tokens.value, counts.value), f"id {kind}, digest binary, n int, prefix array<bigint>")
    return cut(made.select(F.monotonically_increasing_id().alias("k"), "*"))


def copies_of(sets: DataFrame) -> DataFrame:
    """``(id, rep)`` of ``prefixed_sets`` that have the same set as an earlier id, the first one."""
    first = sets.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    return join_groups(sets.select("id", "digest"), first, ["digest"], "n").filter("id != rep").select("id", "rep")


def pairs_of(sets: DataFrame, df: DataFrame, shingles: Column, threshold: float = fv.NEAR_DUPLICATE_JACCARD) -> DataFrame:
    """``(id_a, id_b, jaccard)`` of near sets among the distinct ones; ``sets`` are the ``prefixed_sets`` of ``df``.

    Prefix tokens are dealt once, under the number of their set. Only those that another
    set of like size holds are kept, and of them only those of sets that have as many as a near
    set needs, so few tokens of unlike texts meet. Two sets share no more than they do in
    the prefixes and what the prefix that ends first leaves out, which few but near ones get
    by. Whole sets are made again for the texts of such a pair only.
    """
    first = cut(sets.groupBy("digest").agg(F.min(F.struct("id", "k")).alias("first")).select("first.k", "first.id"))
    tokens = picked(sets.select("k", "n", "prefix"), first.select("k"), "k").select(F.col("k").alias("id"), "n", F.posexplode("prefix").alias("pos", "token"))
    by_size = Window.partitionBy("token").orderBy("n")
    alike = (F.lag("n").over(by_size) >= F.col("n") * F.lit(threshold) - F.lit(1e-6)) | (F.col("n") >= F.lead("n").over(by_size) * F.lit(threshold) - F.lit(1e-6))
    held = cut(tokens.withColumn("alike", alike).filter("alike").drop("alike"))
    fewest = F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) - outside_prefix(F.col("n"), threshold) - 1
    enough = cut(held.groupBy("id").agg(F.count("*").alias("shared"), F.min("n").alias("n")).filter(F.col("shared") >= fewest).select("id"))
    held = picked(held, enough)
    a, b = held.alias("a"), held.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & _may_reach(threshold))
    counted = met.groupBy(F.col("a.id").alias("k_a"), F.col("b.id").alias("k_b")).agg(F.count("*").alias("shared"), F.min("a.n").alias("n"), F.min("b.n").alias("m"))
    outside = F.greatest(*[outside_prefix(F.col(c), threshold) for c in ("n", "m")])
    needed = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m")) - F.lit(1e-6)
    numbered = counted.filter(F.col("shared") + outside >= needed).select("k_a", "k_b")
    named = [first.select(F.col("k").alias(f"k_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab"]
    pairs = numbered.join(named[0], "k_a").join(named[1], "k_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return _verify(pairs, df, threshold, _hashes(shingles))


def near_pairs(df: DataFrame, threshold: float = fv.NEAR_DUPLICATE_JACCARD, shingles: Column | None = None) -> DataFrame:
    """``(id_a, id_b, jaccard)`` of near-duplicate texts among distinct shingle sets.

    Input ``df(id, shingles)``, or ``df(id, ...)`` and the column of ``shingles``, which is
    then made for the rows that need it only. Copies are folded first (see ``fold_equal_sets``
    for the copy → first text mapping), so a group of copies gives no pairs among
    its members.
    """
    shingles = F.col("shingles") if shingles is None else shingles
    return pairs_of(prefixed_sets(df, shingles, threshold), df, shingles, threshold)


def fingerprint_matches(
    df: DataFrame,
    known: DataFrame,
    threshold: float = fv.NEAR_DUPLICATE_JACCARD,
    max_index_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Ids of ``df(id, fp)`` whose set of hashes is near a known one ``known(fp)``.

    The order of the hashes is the token order, so prefixes are cut row by row
    without a shuffle; the known side is broadcast while its index is small.
    """

    def prefix(fp: Column) -> Column:
        n = F.size(fp)
        return F.slice(fp, F.lit(1), prefix_size(n, threshold))

    targets = known.filter(F.size("fp") > 0).select(F.sort_array(F.array_distinct("fp")).alias("known_fp"))
    targets = cut(targets.distinct().withColumn("known_id", F.sha2(F.array_join(F.col("known_fp").cast("array<string>"), " "), 256)))
    if targets.isEmpty():  # nothing is near them, and no text is read for it
        return df.select("id").limit(0)
    index = targets.select("known_id", F.explode(prefix(F.col("known_fp"))).alias("token"))
    own = df.filter(F.size("fp") > 0).select("id", F.sort_array(F.array_distinct("fp")).alias("own_fp"))
    n, m = F.size("own_fp"), F.size("known_fp")
    alike = F.least(n, m) >= F.greatest(n, m) * F.lit(threshold) - F.lit(1e-6)  # sizes first: cheap
    # shared / (n + m - shared) >= threshold, solved for shared so that the sets meet once
    near = alike & (F.size(F.array_intersect("own_fp", "known_fp")) * F.lit(1 + threshold) >= (n + m) * F.lit(threshold) - F.lit(1e-9))
    if is_small(index, max_index_rows) and is_small(targets, max_index_rows):
        probes = own.select("id", "own_fp", F.explode(prefix(F.col("own_fp"))).alias("token"))
        found = probes.join(F.broadcast(index), "token").join(F.broadcast(targets), "known_id")
        return found.filter(near).select("id").distinct()
    return _matches_by_rarity(cut(own), targets, index, threshold)


def _matches_by_rarity(own: DataFrame, targets: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """The same for a large index: ``own(id, own_fp)``, ``targets(known_id, known_fp)``, and the first tokens of the targets by hash.

    A text that is near a target holds one of the index tokens in its own prefix, and
    enough tokens that some target holds. What is left is joined by prefixes in the order
    (how many targets hold it, hash), so frequent tokens meet only where they must. No
    token is repeated by salts, and whole sets travel for the pairs found only: each id
    first with the target it shares most prefix tokens with, the rest if that one isn't near.
    """
    targets = cut(targets.select("known_fp").withColumn("known_id", F.monotonically_increasing_id()))  # numbered once, as it is written
    n = F.size("own_fp")
    firsts = own.select("id", F.explode(F.slice("own_fp", F.lit(1), prefix_size(n, threshold))).alias("token"))
    maybe = cut(firsts.join(index.select("token").distinct(), "token", "left_semi").select("id").distinct())
    counts = cut(targets.select(F.explode("known_fp").alias("token")).groupBy("token").agg(F.count("*").alias("df")))
    ordered = F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ordered")

    def prefixes(sets: DataFrame, fp: str, key: str) -> DataFrame:
        """``(token, df, key, n, pos)``; tokens that no target holds come first and meet nothing."""
        tokens = sets.select(F.col(key).alias("id"), F.size(fp).alias("n"), F.explode(fp).alias("token"))
        held = tokens.join(counts, "token").groupBy("id", "n").agg(ordered)
        alone = F.col("n") - F.size("ordered")
        left = F.greatest(prefix_size(F.col("n"), threshold) - alone, F.lit(0))
        rows = held.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("ordered", F.lit(1), left)).alias("i", "t"))
        return cut(rows.select(F.col("t.token").alias("token"), "id", "n", (F.col("alone") + F.col("i")).alias("pos")))

    a = prefixes(picked(own, maybe), "own_fp", "id").alias("a")
    b = prefixes(targets, "known_fp", "known_id").alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & _may_reach(threshold))
    pairs = cut(met.groupBy(F.col("a.id").alias("id"), F.col("b.id").alias("known_id")).agg(F.count("*").alias("shared")))

    def near(rows: DataFrame) -> DataFrame:
        rows = cut(rows)
        sets = picked(own, cut(rows.select("id").distinct()))
        both = rows.join(targets, "known_id").join(sets, "id")
        shared, total = F.size(F.array_intersect("own_fp", "known_fp")), F.size("own_fp") + F.size("known_fp")
        return cut(both.filter(shared * F.lit(1 + threshold) >= total * F.lit(threshold) - F.lit(1e-9)).select("id").distinct())

    likeliest = pairs.groupBy("id").agg(F.max_by("known_id", F.struct("shared", "known_id")).alias("known_id"))
    found = near(likeliest)
    others = pairs.join(found, "id", "left_anti").join(likeliest, ["id", "known_id"], "left_anti")
    return found.unionByName(near(others.select("id", "known_id")))


def greedy_dedup(
    df: DataFrame,
    threshold: float = fv.NEAR_DUPLICATE_JACCARD,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """Ids of ``df(id, shingles)`` kept by the arrival-order rule; ``id`` is the order.

    A text is kept iff no text kept before it is near it. The same result as the
    sequential loop comes from rounds over the undecided texts:

    * prefix buckets of at most ``bucket_limit`` texts give a verified pair list,
      whose size grows linearly with the data;
    * of a larger bucket, a round pairs the first undecided texts only, ``bucket_limit``
      of them in the first round and twice as many in each further one. A text that
      stands among the first in all its large buckets has all its undecided earlier
      neighbours in verified pairs. The texts kept then meet the rest of their buckets
      once, so a group of near copies shrinks before it could give its pairs, and a
      bucket of unlike texts ends after a number of rounds that grows with the
      logarithm of its size.

    Texts without an undecided earlier neighbour are kept, texts near a kept one
    are dropped, until nothing is undecided. The first undecided text is always
    decided, so the rounds end.
    """
    empty = df.filter(F.size("shingles") == 0).select("id")
    sets = cut(distinct_sets(df))
    prefixes = cut(prefix_tokens(sets, threshold))
    sizes = cut(prefixes.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"))
    large = sizes.filter(F.col("size") > bucket_limit).select("token")
    small_buckets = sizes.filter(F.col("size") <= bucket_limit).select("token")
    cold = prefixes.join(small_buckets, "token", "left_semi")
    pairs = cut(_verify(_candidates(cold, threshold), sets, threshold).select("id_a", "id_b"))
    hot = cut(lookup_join(prefixes, large, ["token"], "left_semi"))
    linked = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).unionByName(hot.select("id"))
    undecided = cut(linked.distinct())
    kept = sets.select("id").join(undecided, "id", "left_anti")  # these share no bucket and have no neighbour at all
    window = bucket_limit
    while not undecided.isEmpty():
        pairs = cut(_among(pairs, undecided))
        hot = cut(hot.join(undecided, "id", "left_semi"))
        has_hot = not hot.isEmpty()
        near, blocked = pairs, pairs.select(F.col("id_b").alias("id"))
        if has_hot:
            place = F.row_number().over(Window.partitionBy("token").orderBy("id"))
            first = cut(hot.withColumn("place", place).filter(F.col("place") <= window).drop("place"))
            last = cut(first.groupBy("token").agg(F.max("id").alias("last_id")))
            behind = cut(lookup_join(hot, last, ["token"]).filter(F.col("id") > F.col("last_id")).select("id").distinct())
            found = _verify(_candidates(first, threshold), sets, threshold).select("id_a", "id_b")
            near = cut(near.unionByName(found).distinct())
            blocked = near.select(F.col("id_b").alias("id")).unionByName(behind)
        now_kept = cut(undecided.join(blocked.distinct(), "id", "left_anti"))
        covered = near.join(now_kept.withColumnRenamed("id", "id_a"), "id_a", "left_semi").select(F.col("id_b").alias("id"))
        if has_hot:
            met = behind.join(covered.distinct(), "id", "left_anti")
            rest = hot.join(met, "id", "left_semi")
            probes = _meet(hot.join(now_kept, "id", "left_semi"), rest, threshold)
            covered = covered.unionByName(_verify(probes, sets, threshold).select(F.col("id_b").alias("id")))
        decided = now_kept.unionByName(covered)
        kept = kept.unionByName(now_kept)
        undecided = cut(undecided.join(decided.distinct(), "id", "left_anti"))
        window *= 2
    return kept.unionByName(empty)


def _among(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs both of whose texts are in ``ids``."""
    return pairs.join(ids.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(ids.withColumnRenamed("id", "id_b"), "id_b", "left_semi").select("id_a", "id_b")


def near_sets(
    df: DataFrame,
    known: DataFrame,
    threshold: float = fv.NEAR_DUPLICATE_JACCARD,
    max_index_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Ids of ``df(id, shingles)`` that are near any set of ``known(shingles)``."""
    own = df.select("id", F.transform("shingles", lambda s: F.xxhash64(s)).alias("fp"))
    other = known.select(F.transform("shingles", lambda s: F.xxhash64(s)).alias("fp"))
    return fingerprint_matches(own, other, threshold, max_index_rows)
