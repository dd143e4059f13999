"""Benchmark decontamination with suffix arrays of the training text.

The training texts are cut into shards (some MB of whole documents, inside the
scan's tasks). Each shard gets a suffix array over its words: the places where a
suffix starts, in the order of the words that follow. Places whose first words
occur nowhere in the benchmark are left out, no test suffix could end up there.
Every test suffix is then binary-searched in every shard, one word deeper at a
time, which leaves the interval of all its verbatim occurrences. Documents are
never shuffled; only the benchmark travels, as a broadcast of checked size, in
several rounds if it is larger.

Words: ``A-Z`` lower-cased, then runs of ASCII letters, digits and everything
beyond ASCII. A window is ``window`` consecutive words of one item; an item with
fewer words, but not none, is one window. A document word inside any occurrence of
a window is hit. A document is contaminated if it has hits and they are at least
1 in ``share`` of its words.

Null and empty texts have no words; null ids are allowed on both sides (a null
item id is reported as an empty string). Repeated rows and items don't change any
result, each row is judged alone. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Words, alnum_words, covered, lower_ascii, pieces, text_buffer
from .tables import packed, stored, unpacked

WINDOW = 13
SHARE = 20
BENCHMARK_BYTES = 32 << 20  # benchmark text broadcast at once
HITS = "struct<n_words:bigint,n_hit:bigint,starts:array<bigint>,lengths:array<bigint>,items:array<string>>"


@dataclass
class TestSuffixes:
    """Windows of the benchmark: word hashes ``(n, window)``, length and item of each, and a filter of first words."""

    words: np.ndarray
    length: np.ndarray
    item: np.ndarray
    ids: list[str]
    head: int
    heads: np.ndarray


def test_suffixes(ids: list[str], texts: list[str | None], window: int = WINDOW) -> TestSuffixes:
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    words = Words(lower_ascii(data), offsets, alnum_words())
    length = np.minimum(words.count, window)[words.row]
    place = np.arange(len(words))
    end = words.first[1:][words.row]
    first = np.flatnonzero(place + length <= end)
    length = length[first]
    padded = np.concatenate([words.hash, np.zeros(window, U64)])
    deep = padded[first[:, None] + np.arange(window)]
    head = int(min(3, length.min())) if len(length) else 1
    heads = np.unique(words.window_hash(head)[first]) if len(first) else np.zeros(0, U64)
    return TestSuffixes(deep, length, words.row[first], ids, head, heads)


def suffix_array(stream: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the ``depth`` words that follow them; ``stream`` has ``depth`` words to spare."""
    return places[np.lexsort([stream[places + d] for d in range(depth - 1, -1, -1)])]


def search(stream: np.ndarray, array: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Interval ``[low, high)`` of the suffix array that starts with each test suffix."""
    n = len(tests.length)
    low, high = np.zeros(n, np.int64), np.full(n, len(array), np.int64)
    for d in range(tests.words.shape[1]):
        open_ = np.flatnonzero((low < high) & (tests.length > d))
        if not len(open_):
            break
        column, wanted = stream[array + d], tests.words[open_, d]
        low[open_], high[open_] = _bound(column, wanted, low[open_], high[open_], False), _bound(column, wanted, low[open_], high[open_], True)
    return low, high


def _bound(column: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """First place in each ``[low, high)`` whose word isn't below (or, ``after``, is above) the wanted one."""
    low, high = low.copy(), high.copy()
    while (going := low < high).any():
        middle = (low + high) >> 1
        here = column[np.minimum(middle, len(column) - 1)]
        right = going & ((here <= wanted) if after else (here < wanted))
        low = np.where(right, middle + 1, low)
        high = np.where(going & ~right, middle, high)
    return low


def shard_hits(words: Words, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, length, test)`` of every occurrence of a test suffix in the shard."""
    none = np.zeros(0, np.int64)
    n = len(words)
    if not n or not len(tests.length):
        return none, none, none
    table = np.zeros(1 << 20, bool)  # cheap flags in front of the exact test of first words
    table[(tests.heads >> U64(64 - 20)).astype(np.int64)] = True
    heads = words.window_hash(tests.head)
    maybe = np.flatnonzero(table[(heads >> U64(64 - 20)).astype(np.int64)])
    at = np.minimum(np.searchsorted(tests.heads, heads[maybe]), len(tests.heads) - 1)
    maybe = maybe[tests.heads[at] == heads[maybe]]
    if not len(maybe):
        return none, none, none
    depth = tests.words.shape[1]
    stream = np.zeros(n + len(words.count) + depth, U64)  # a zero word ends each document
    stream[np.arange(n) + words.row] = words.hash
    array = suffix_array(stream, maybe + words.row[maybe], depth)
    low, high = search(stream, array, tests)
    count = high - low
    test = np.repeat(np.arange(len(count)), count)
    place = array[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    starts = words.first[:-1] + np.arange(len(words.count))  # of the documents in the stream
    word = place - (np.searchsorted(starts, place, "right") - 1)
    return word, tests.length[test], test


def _hits(tests):
    def run(body: pa.Array) -> pa.Array:
        index = tests.value
        n_words, n_hit, counts, starts, lengths, item_counts, items = [], [], [], [], [], [], []
        for i, j, data, offsets in pieces(body):
            words = Words(lower_ascii(data), offsets, alnum_words())
            word, length, test = shard_hits(words, index)
            order = np.lexsort([-length, word])
            word, length, row = word[order], length[order], words.row[word[order]]
            first = np.ones(len(word), bool)
            first[1:] = word[1:] != word[:-1]
            n_words.append(words.count)
            n_hit.append(np.bincount(words.row[covered(len(words), word, word + length)], minlength=j - i))
            counts.append(np.bincount(row[first], minlength=j - i))
            starts.append(word[first] - words.first[row[first]])
            lengths.append(length[first])
            pairs = np.unique(np.stack([row, index.item[test[order]]]), axis=1)
            item_counts.append(np.bincount(pairs[0], minlength=j - i))
            items += [index.ids[x] for x in pairs[1]]
        cat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        ends = lambda parts: pa.array(np.concatenate([[0], np.cumsum(cat(parts))]).astype(np.int32))
        return pa.StructArray.from_arrays(
            [
                pa.array(cat(n_words)),
                pa.array(cat(n_hit)),
                pa.ListArray.from_arrays(ends(counts), pa.array(cat(starts))),
                pa.ListArray.from_arrays(ends(counts), pa.array(cat(lengths))),
                pa.ListArray.from_arrays(ends(item_counts), pa.array(items, pa.string())),
            ],
            names=["n_words", "n_hit", "starts", "lengths", "items"],
        )

    return F.arrow_udf(run, HITS)


def _hit_words(n: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
    size = np.asarray(n)
    first = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(size)), np.asarray(starts.value_lengths()))
    at = np.asarray(starts.flatten()) + first[row]
    hit = covered(int(first[-1]), at, at + np.asarray(lengths.flatten()))
    total = np.concatenate([[0], np.cumsum(hit)])
    return pa.array((total[first[1:]] - total[first[:-1]]).astype(np.int64))


def _blocks(spark, benchmark: DataFrame, id_col: str, text_col: str, window: int, max_bytes: int) -> list:
    """Broadcast test suffixes, ``max_bytes`` of benchmark text each."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("body"))
    items = items.filter("body IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // max_bytes))
    out = []
    for b in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("id", "body"), F.lit(n)) == b)
        rows = own.distinct().orderBy("id", "body").collect()  # at most about max_bytes of text
        out.append(spark.sparkContext.broadcast(test_suffixes([r.id for r in rows], [r.body for r in rows], window)))
    return out


def judge_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
    max_bytes: int = BENCHMARK_BYTES,
) -> DataFrame:
    """``(row, n_words, n_hit, items, contaminated)`` per document; ``items`` are ids as sorted strings."""
    blocks = _blocks(docs.sparkSession, benchmark, item_col, item_text, window, max_bytes)
    texts = packed(docs, id_col, text_col).select("row", "body")
    if len(blocks) == 1:
        judged = texts.select("row", _hits(blocks[0])(F.col("body")).alias("h")).select("row", "h.n_words", "h.n_hit", "h.items")
    else:  # one pass of the texts for each block; hits meet by the digest of the text
        keyed = texts.withColumn("digest", F.sha2(F.coalesce("body", F.lit("")), 256))
        parts = [stored(keyed.select("digest", _hits(b)(F.col("body")).alias("h")).select("digest", "h.*").distinct(), "hits") for b in blocks]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        merged = every.groupBy("digest").agg(
            F.first("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("lengths")).alias("lengths"), F.flatten(F.collect_list("items")).alias("items")
        )
        found = keyed.select("row", "digest").join(merged, "digest").drop("digest")
        judged = found.withColumn("n_hit", F.arrow_udf(_hit_words, "bigint")("n_words", "starts", "lengths"))
    return judged.select(
        "row", "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, as they are."""
    return unpacked(judge_contamination(docs, benchmark, **options).filter("not contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(key, item_id, item_start, start, n_words)``: every verbatim match of at least a window that can't be made longer.

    Starts count words. ``key`` is the document's id as long.
    """
    blocks = _blocks(docs.sparkSession, benchmark, item_col, item_text, window, BENCHMARK_BYTES)
    texts = packed(docs, id_col, text_col).select("key", "body")
    out = None
    for block in blocks:
        part = texts.mapInArrow(_runs(block), "key long, item_id string, item_start long, start long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def _runs(tests):
    def run(batches):
        index = tests.value
        place = np.arange(len(index.item)) - np.searchsorted(index.item, index.item)  # window number in its item
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            for i, j, data, offsets in pieces(batch.column("body")):
                words = Words(lower_ascii(data), offsets, alnum_words())
                word, length, test = shard_hits(words, index)
                item, at = index.item[test], place[test]
                order = np.lexsort([word, word - at, item, words.row[word]])  # windows of one match stand one after another
                word, length, item, at = word[order], length[order], item[order], at[order]
                row = words.row[word]
                new = np.ones(len(word), bool)
                new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (word[1:] != word[:-1] + 1) | (at[1:] != at[:-1] + 1)
                head = np.flatnonzero(new)
                last = np.append(head[1:], len(word)) - 1 if len(head) else head
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i:j][row[head]]), pa.array([index.ids[x] for x in item[head]], pa.string()), pa.array(at[head]), pa.array(word[head] - words.first[row[head]]), pa.array(word[last] + length[last] - word[head])],
                    names=["key", "item_id", "item_start", "start", "n_words"],
                )

    return run
