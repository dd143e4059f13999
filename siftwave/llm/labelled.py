"""Labelled rows: bounded samples, and counts of hashed terms by class over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import is_small
from .arrays import U64, Words, alnum_words, lower_ascii, pieces, span_hash
from .tables import stored

FOLDS, HELD_OUT = 3, 1
PREFIXES = (4, 5, 6)  # bytes; inflected words share them


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from; a null id counts as one to learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % F.lit(FOLDS) == HELD_OUT, F.lit(False))


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(id, label)`` to learn from: no held-out rows, no nulls, the largest label of an id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    return stored(known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label")), "labels")


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int) -> DataFrame:
    """About ``bound`` labelled texts at most, ``(body, label)``, chosen by a hash of the id, written once.

    Labels of held-out rows and null labels are left out; of several labels of one
    id the largest counts.
    """
    known = known_labels(labels, id_col, label_col)
    share = min(1.0, bound / max(1, known.count()))
    chosen = known.filter(_drawn(F.lit(share)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    return stored(texts.join(F.broadcast(chosen), "id").select("body", "label"), "sample")  # at most about `bound` narrow rows


def _drawn(share: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < (share * F.lit(1 << 30)).cast("long")


@dataclass
class Labelled:
    """Labelled texts: their numbers by class, the counts of their terms, and a sample for a fit."""

    ones: int
    zeros: int
    term_ones: np.ndarray  # texts of each class that hold a term
    term_zeros: np.ndarray
    sampled: DataFrame  # (body, label)
    shares: tuple[float, float]  # share of the ones and of the zeros that are in the sample


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int, size: int) -> Labelled:
    """Term counts cover every labelled text that isn't held out; at most about ``bound / 2`` texts of each class are sampled."""
    known = known_labels(labels, id_col, label_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    all_rows = texts.join(F.broadcast(known) if is_small(known, 1_000_000) else known, "id")
    counts = all_rows.select("body", "label").mapInArrow(_counts_of(size), "term int, ones long, zeros long")
    counts = counts.groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toArrow()  # `size` + 1 rows at most
    table = np.zeros((size + 1, 2), np.int64)
    for k, name in enumerate(("ones", "zeros")):
        table[np.asarray(counts.column("term").combine_chunks()), k] = np.asarray(counts.column(name).combine_chunks())
    ones, zeros = int(table[size, 0]), int(table[size, 1])
    half = max(1, bound // 2)
    shares = min(1.0, half / max(1, ones)), min(1.0, half / max(1, zeros))
    drawn = known.filter(_drawn(F.when(F.col("label") > 0, F.lit(shares[0])).otherwise(F.lit(shares[1]))))
    sampled = stored(texts.join(F.broadcast(drawn), "id").select("body", "label"), "sample")  # at most about `bound` narrow rows
    return Labelled(ones, zeros, table[:size, 0], table[:size, 1], sampled, shares)


def terms(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the hashed terms: whole words in lower case, and the first bytes of longer ones."""
    words = Words(lower_ascii(data), offsets, alnum_words())
    rows, hashes = [words.row], [words.hash]
    for k in prefixes:
        long = np.flatnonzero(words.end - words.start > k)
        rows.append(words.row[long])
        hashes.append(span_hash(words.bytes, words.start[long], words.start[long] + k) ^ U64(k))
    return np.concatenate(rows), np.concatenate(hashes)


def hashed_terms(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, index)`` of the distinct terms of each text, hashed into a table of ``size``, a power of two; sorted."""
    row, h = terms(data, offsets)
    bits = int(size).bit_length() - 1
    pair = np.unique(row * size + (h >> U64(64 - bits)).astype(np.int64))
    return pair // size, pair % size


def _counts_of(size: int):
    """Partial counts of terms by class; row ``size`` counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, size + 1), np.int64)
        for batch in batches:
            label = np.asarray(batch.column("label")) > 0
            for i, j, data, offsets in pieces(batch.column("body")):
                row, index = hashed_terms(data, offsets, size)
                one = label[i:j]
                table[0, :size] += np.bincount(index[one[row]], minlength=size)
                table[1, :size] += np.bincount(index[~one[row]], minlength=size)
                table[0, size] += int(one.sum())
                table[1, size] += int((~one).sum())
        some = np.flatnonzero(table.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(table[0, some]), pa.array(table[1, some])], names=["term", "ones", "zeros"])

    return run


def matrix(sampled: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, index, label)``: the sample's hashed terms as a sparse matrix, rows in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("body")):
                row, index = hashed_terms(data, offsets, size)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(index.astype(np.int32)))], names=["label", "terms"])

    rows = sampled.mapInArrow(run, "label int, terms array<int>").withColumn("order", F.xxhash64("terms", "label")).toArrow().combine_chunks()
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows = rows.take(pa.array(np.argsort(np.asarray(rows.column("order").combine_chunks()), kind="stable")))
    lists = rows.column("terms").combine_chunks()
    row = np.repeat(np.arange(len(rows)), np.asarray(lists.value_lengths()))
    return row, np.asarray(lists.flatten()).astype(np.int64), (np.asarray(rows.column("label").combine_chunks()) > 0).astype(float)


def score_column(spark, size: int, model: object, scorer: Callable[[object, np.ndarray, np.ndarray, int], np.ndarray], body: Column) -> Column:
    """Double column: ``scorer(model, row, index, rows)`` over the hashed terms of each whole text."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        out = [scorer(shared.value, *hashed_terms(data, offsets, size), j - i) for i, j, data, offsets in pieces(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return F.arrow_udf(run, "double")(body)
