"""URL rules by a cascade of Bloom filters.

The first filter holds the listed keys. Asked for every key of the corpus it lets
some unlisted ones through; the second filter holds those, the third holds the
listed keys that the second lets through, and so on until nothing is left. Walking
down to the first filter that says no answers every key of that universe exactly,
without a join. Each level is a small fraction of the one before.

A rule is a host and a path prefix. It fits its host and all subdomains, for paths
that start with its path; the longest rule that fits decides (of equally long ones,
that with the longer host), and a url that none fits is allowed. A rule without a
slash is a host with the empty path. A key listed as both is blocked. Null urls, and urls without ``://``, have an empty host and path
and fit no rule. Repeated rows are judged alike; without rules all is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U64
from .tables import stored

BITS, HASHES = 12, 6  # per key of a level
CASCADE_BYTES = 128 << 20  # of all levels; beyond it keys are joined
MAX_LEVELS = 64
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CascadeTooLarge(ValueError):
    """The listed keys need more bytes than may be broadcast."""


@dataclass
class Cascade:
    levels: list[np.ndarray]  # bits of each level, as 64-bit words

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(h1), bool)
        left = np.arange(len(h1))
        for depth, words in enumerate(self.levels):
            yes = _asked(words, depth, h1[left], h2[left])
            inside[left[~yes]] = depth % 2 == 1
            left = left[yes]
            if not len(left):
                return inside
        inside[left] = len(self.levels) % 2 == 1
        return inside


def _places(h1: np.ndarray, h2: np.ndarray, depth: int, words: int) -> np.ndarray:
    step = h2 | U64(1)
    with np.errstate(over="ignore"):
        start = (h1 ^ U64(depth * 0x9E3779B97F4A7C15 % 2**64)) * U64(0xBF58476D1CE4E5B9)
        spread = start[:, None] + np.arange(HASHES, dtype=U64) * (step * U64(2 * depth + 1))[:, None]
    return (spread >> U64(20)) % U64(words * 64)


def _asked(words: np.ndarray, depth: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = _places(h1, h2, depth, len(words))
    return ((words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).all(axis=1)


def hashed(keys: DataFrame) -> DataFrame:
    """``(h1, h2)`` of the distinct strings in ``key``."""
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")).distinct()


def _u64(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(U64)


def _bits(depth: int, words: int):
    """Partial filters of a partition: ``(word, bits)``."""

    def run(batches):
        for batch in batches:
            at = _places(_u64(batch.column("h1")), _u64(batch.column("h2")), depth, words).ravel()
            word = (at >> U64(6)).astype(np.int64)
            order = np.argsort(word, kind="stable")
            word, bit = word[order], (U64(1) << (at & U64(63)))[order]
            if len(word):
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))], names=["word", "bits"])

    return run


def _level(keys: DataFrame, n: int, depth: int) -> np.ndarray:
    words = max(1, -(-n * BITS // 64))
    rows = keys.mapInArrow(_bits(depth, words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    level = np.zeros(words, U64)
    level[np.asarray(rows.column("word").combine_chunks())] = _u64(rows.column("bits").combine_chunks())
    return level


def _passing(keys: DataFrame, level: np.ndarray, depth: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)
    test = F.arrow_udf(lambda a, b: pa.array(_asked(shared.value, depth, _u64(a), _u64(b))), "boolean")
    return keys.filter(test("h1", "h2"))


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = CASCADE_BYTES) -> Cascade:
    """Cascade that tells the listed keys (``key``) from all other keys of the universe (``key``).

    Every level's size is known from the count of its keys before it is built.
    """
    inside = stored(hashed(listed), "listed")
    outside = hashed(universe).join(inside, ["h1", "h2"], "left_anti")
    levels: list[np.ndarray] = []
    size = inside.count()
    while size:
        depth = len(levels)
        if depth >= MAX_LEVELS or (sum(map(len, levels)) * 8 + size * BITS // 8) > max_bytes:
            raise CascadeTooLarge(f"{size} keys at level {depth + 1}")
        levels.append(_level(inside, size, depth))
        through = stored(_passing(outside, levels[-1], depth), "through")
        inside, outside = through, inside
        size = inside.count()
    return Cascade(levels)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_behind(url), r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1)


def _behind(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """All keys a rule that fits could have, the longest first: the host's suffixes of at most ``labels`` labels with the path's prefixes of the given lengths."""
    tail = F.substring_index(host, ".", -labels)
    labels = F.split(tail, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct((-(F.length(h) + F.length(p))).alias("rank"), (-F.length(h)).alias("host"), F.concat(h, p).alias("key")))))
    return F.transform(F.array_sort(keys), lambda k: k["key"])


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", max_bytes: int = CASCADE_BYTES) -> DataFrame:
    """``(row, host, path, rule, verdict)`` per page; ``rules(rule, action)`` holds ``host/path`` strings and ``block`` or ``allow``."""
    spark = pages.sparkSession
    clean = rules.filter("rule <> ''").select("rule", (F.col("action") == "block").alias("block"))
    clean = stored(clean.groupBy("rule").agg(F.max("block").alias("block")), "rules")
    slash = F.instr(F.col("rule"), "/")
    path_length = F.when(slash > 0, F.length("rule") - slash + 1).otherwise(0)
    # no listed host has more labels, so longer suffixes of a page's host can't be listed
    most = clean.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\.")))).first()[0]
    lengths = sorted(r[0] for r in clean.select(path_length).distinct().collect())  # distinct lengths of paths: a few hundred at most
    url = F.col(url_col).cast("string")
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not lengths:
        return base.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    asked = base.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths, most))
    universe = asked.select(F.explode("keys").alias("key")).distinct().unionByName(clean.select(F.col("rule").alias("key")))
    universe = stored(universe.distinct(), "universe")
    try:
        found = [build_cascade(clean.filter(F.col("block") == b).select(F.col("rule").alias("key")), universe, max_bytes // 2) for b in (True, False)]
    except CascadeTooLarge:
        return _joined(asked, clean, universe)
    shared = spark.sparkContext.broadcast(found)

    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        h1, h2 = _u64(first.flatten()), _u64(second.flatten())
        blocked, allowed = (c.contains(h1, h2) for c in shared.value)
        said = np.where(blocked, 2, np.where(allowed, 1, 0)).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.asarray(first.value_lengths()))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(said))

    answers = F.arrow_udf(run, "array<int>")(F.transform("keys", lambda k: F.xxhash64(k)), F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)))
    told = asked.withColumn("said", answers)
    hit = F.filter(F.arrays_zip(F.col("keys").alias("key"), F.col("said").alias("said")), lambda z: z["said"] > 0)
    return _verdicts(told.withColumn("hit", F.get(hit, F.lit(0))), F.col("hit.key"), F.col("hit.said") == 2)


def _verdicts(df: DataFrame, rule: Column, block: Column) -> DataFrame:
    return df.select("row", "host", "path", rule.alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"))


def _joined(asked: DataFrame, clean: DataFrame, universe: DataFrame) -> DataFrame:
    """The same answers by joins, for lists too large to broadcast: the corpus's few distinct key lists meet the rules."""
    lists = stored(asked.select("keys").distinct(), "lists")
    rows = lists.select("keys", F.posexplode("keys").alias("place", "rule"))
    best = rows.join(clean, "rule").groupBy("keys").agg(F.min(F.struct("place", "rule", "block")).alias("hit"))
    return _verdicts(asked.join(best, "keys", "left"), F.col("hit.rule"), F.col("hit.block"))
