"""Grouping of spelling variants by search in an FM-index of the vocabulary.

Words are maximal runs of the letters ``A-Za-z`` and U+00C0 to U+00FF, ``A-Z``
lower-cased, of at least ``min_chars`` code points and with at least ``min_count``
occurrences in all texts. Two words are near if they differ by exactly one inserted,
deleted or replaced code point. A word's form is the near word that occurs most often
(ties: the first in code-point order) if it occurs at least ``ratio`` times as often
as the word; following forms to the last gives the root.

One error leaves one half of a word as it is. So near words share their first or last
``KEY`` code points, and the vocabulary is dealt twice, by beginnings and by endings.
A shard indexes its words (reversed for the beginnings) and searches all of them:
the half at the shared end exactly, one error in the other (``fmindex``). A pair that
both searches would find is the first one's. Beginnings or endings that very many
words share are cut into blocks, and every block is searched in every block, so none
is one task's work.

Null and empty texts have no words; a null id is an empty id. Repeated rows count
each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FmIndex
from .tables import stored

LETTERS = "[A-Za-zÀ-ÿ]"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
KEY = 3  # code points; at most half of the shortest word
HELD = 200_000  # words that a task counts before it hands them on
BLOCK_CHARS = 200_000  # letters of a shard, or of a block of a frequent beginning


def _counts(min_chars: int, drop_one_in: int | None):
    runs_of = re.compile(f"{LETTERS}{{{min_chars},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("body")):
                body = text.as_py()
                if not body:
                    continue
                own: dict[str, int] = {}
                for w in runs_of(body.encode().lower().decode()):  # of bytes, only A-Z change
                    own[w] = own.get(w, 0) + 1
                begin = zlib.crc32(f"{key or ''}:".encode())
                for w, n in own.items():
                    if drop_one_in:
                        h = zlib.crc32(w.encode(), begin)
                        if not h % drop_one_in:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < min_chars:
                                continue
                    counts[w] = counts.get(w, 0) + n
                if len(counts) >= HELD:
                    yield _word_rows(counts)
                    counts = {}
        if counts:
            yield _word_rows(counts)

    return run


def _word_rows(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_one_in: int | None = None) -> DataFrame:
    """``(word, n)`` of the vocabulary.

    ``drop_one_in`` makes typing errors for tests: where it divides the crc32 ``h`` of
    ``<id>:<word>``, the word loses its code point ``h % length`` before it is counted.
    """
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("body"))
    counted = texts.mapInArrow(_counts(min_chars, drop_one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one after another, and where each starts."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def _near(rows: pa.Table) -> pa.Table:
    """Number of near words and the most frequent one, of the words to be searched, among those to be indexed."""
    words, n = rows.column("word").to_pylist(), np.asarray(rows.column("n").combine_chunks())
    forward = bool(rows.column("forward")[0].as_py())  # beginnings are shared: read to the right
    asked, listed = (np.flatnonzero(np.asarray(rows.column(c).combine_chunks().cast(pa.int8()))) for c in ("asked", "listed"))
    turned = lambda w: w[::-1]
    index = FmIndex(*_coded([turned(words[i]) if forward else words[i] for i in listed]))
    codes, starts = _coded([words[i] if forward else turned(words[i]) for i in asked])
    length = np.diff(starts)
    half = length // 2
    pattern, word = index.one_error(codes, starts, half if forward else length - half)
    a, b = asked[pattern], listed[word]
    if not forward:  # with an equal first half, it was found among the beginnings
        every, first = _coded(words)
        same, at = np.arange(len(a)), 0
        size = half[pattern]
        twice = np.zeros(len(a), bool)
        while len(same):
            twice[same[size[same] == at]] = True
            same = same[size[same] > at]
            same = same[every[first[a[same]] + at] == every[first[b[same]] + at]]
            at += 1
        a, b = a[~twice], b[~twice]
    place = np.empty(len(words), np.int64)
    place[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    order = np.lexsort([place[b], -n[b], a])
    a, b = a[order], b[order]
    head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    best = np.full(len(words), -1)
    best[a[head]] = b[head]
    found = np.bincount(a, minlength=len(words))
    forms = best[asked]
    return pa.table(
        {
            "word": pa.array([words[i] for i in asked], pa.string()),
            "n": pa.array(n[asked], pa.int64()),
            "n_near": pa.array(found[asked], pa.int64()),
            "form": pa.array([words[i] if i >= 0 else None for i in forms], pa.string()),
            "form_n": pa.array(n[forms], pa.int64(), mask=forms < 0),
        }
    )


NEAR = "word string, n long, n_near long, form string, form_n long"


def near_words(vocabulary: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(word, n, n_near, form, form_n)`` of every row of ``vocabulary(word, n)``: how many words are near, and the most frequent of them.

    Words are distinct and have at least ``2 * KEY`` code points.
    """
    ends = F.array(F.struct(F.lit(True).alias("forward"), F.substring("word", 1, KEY).alias("end")), F.struct(F.lit(False).alias("forward"), F.substring("word", -KEY, KEY).alias("end")))
    rows = vocabulary.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.forward", "e.end")
    sizes = stored(rows.groupBy("forward", "end").agg(F.sum(F.length("word")).alias("chars")), "ends")
    blocks = F.ceil(F.col("chars") / F.lit(block_chars)).cast("int")
    rows = rows.join(sizes, ["forward", "end"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("word", F.lit(9)), blocks).cast("int"))
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)
    asking = F.transform(numbers, lambda i: F.struct(F.col("block").alias("ask"), i.alias("list"), F.lit(True).alias("asked"), (i == F.col("block")).alias("listed")))
    listed = F.transform(F.filter(numbers, lambda i: i != F.col("block")), lambda i: F.struct(i.alias("ask"), F.col("block").alias("list"), F.lit(False).alias("asked"), F.lit(True).alias("listed")))
    units = rows.select("word", "n", "forward", "end", "blocks", F.explode(F.concat(asking, listed)).alias("u")).select("word", "n", "forward", "end", "blocks", "u.*")
    shards = max(1, int((sizes.agg(F.sum("chars")).first()[0] or 0) / block_chars))
    alone = F.col("blocks") > 1  # a block pair is searched on its own; small ends share an index
    dealt = units.withColumn("shard", F.when(alone, F.xxhash64("end", "ask", "list")).otherwise(F.pmod(F.xxhash64("end"), F.lit(shards)))).withColumn("alone", alone)
    dealt = dealt.select("word", "n", "asked", "listed", "forward", "alone", "shard")
    return dealt.groupBy("forward", "alone", "shard").applyInArrow(_near, NEAR).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))).alias("best")
    ).select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the rows of ``forms(word, form)``: the end of each chain of forms. Chains are halved in each round."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every row of ``vocabulary(word, n)``."""
    near = near_words(stored(vocabulary, "vocabulary"))
    enough = F.col("form_n") >= F.lit(ratio) * F.col("n")
    near = stored(near.select("word", "n", "n_near", F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "near")
    ends = roots(near.filter("form IS NOT NULL").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
