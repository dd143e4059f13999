"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII white space at both ends, ``A-Z``
lower-cased. Keys of at least ``min_chars`` code points that stand in at least
``min_docs`` documents are *repeated*: all their lines go, except in the largest
document id that holds the key. The state is three tables:

* ``postings(shard, digest, doc)``: which documents hold a key, exact;
* ``counts(shard, digest, n_docs, top_doc)``: its reference count;
* ``filters(shard, slots)``: a cuckoo filter of each shard's repeated keys.

``insert`` and ``delete`` take documents in and out and move only the keys that
cross the limit in or out of the filters, so lines dropped for documents that have
gone come back. ``judge_lines`` asks the filters inside the scan; only lines that
may be repeated are shuffled to their exact counts. Filters above
``FILTER_BYTES`` aren't broadcast: then all lines meet their counts in a join.

Keys are 128-bit digests. A null or empty text is one empty line. A null id is the
smallest id. Rows that repeat an id count as one document; each row gets its own
answer, so line numbers go with the id and a hash of the text. Empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SPACE_BYTES, U64, covered, lower_ascii, pieces
from .cuckoo import Cuckoo, CuckooFull, filled
from .tables import as_key, as_mark, packed, stored, unpacked

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 200_000  # repeated keys a shard is planned for
FILTER_BYTES = 64 << 20
COUNTS = "shard int, digest binary, n_docs bigint, top_doc bigint"
FILTERS = "shard int, slots binary"


@dataclass
class LineState:
    shards: int
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


class Lines:
    """Byte spans of the lines of several texts, and of their keys."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        breaks = np.flatnonzero(data == 0x0A)
        owner = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
        order = np.lexsort([np.concatenate([np.full(rows, -1), breaks]), owner])
        self.start = np.concatenate([offsets[:-1], breaks + 1])[order]
        self.row = owner[order]
        self.end = np.append(self.start[1:] - 1, 0)
        last = np.append(self.row[1:] != self.row[:-1], True) if len(self.row) else np.zeros(0, bool)
        self.end = np.where(last, offsets[1:][self.row], self.end[: len(self.row)])
        self.count = np.bincount(self.row, minlength=rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def keys(self, data: np.ndarray, min_chars: int) -> tuple[np.ndarray, list[bytes]]:
        """``(line, digest)`` of the lines whose key has ``min_chars`` code points."""
        white = np.zeros(256, bool)
        white[SPACE_BYTES] = True
        inner = np.flatnonzero(~white[data])
        begin, end = np.searchsorted(inner, self.start), np.searchsorted(inner, self.end)
        some = np.flatnonzero(begin < end)
        begin, end = inner[begin[some]], inner[end[some] - 1] + 1
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long = chars[end] - chars[begin] >= min_chars
        text = lower_ascii(data).tobytes()
        md5 = hashlib.md5
        return some[long], [md5(text[a:b], usedforsecurity=False).digest() for a, b in zip(begin[long].tolist(), end[long].tolist())]


def _digests(digest: list[bytes] | pa.Array) -> np.ndarray:
    joined = b"".join(digest) if isinstance(digest, list) else b"".join(digest.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(-1, 2)


def _shard(digest: np.ndarray, shards: int) -> np.ndarray:
    return ((digest[:, 0] >> U64(32)) % U64(shards)).astype(np.int32)


def _postings(min_chars: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            for i, j, data, offsets in pieces(batch.column("body")):
                lines = Lines(data, offsets)
                line, digest = lines.keys(data, min_chars)
                seen = dict.fromkeys(zip(lines.row[line].tolist(), digest))
                rows, found = np.array([r for r, _ in seen], np.int64), [d for _, d in seen]
                yield pa.RecordBatch.from_arrays([pa.array(_shard(_digests(found), shards)), pa.array(found, pa.binary()), pa.array(keys[i:j][rows])], names=["shard", "digest", "doc"])

    return run


def postings_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int, shards: int) -> DataFrame:
    texts = packed(docs, id_col, text_col).select("key", "body")
    return texts.mapInArrow(_postings(min_chars, shards), "shard int, digest binary, doc bigint").distinct()


def _changed(crossed: DataFrame, filters: DataFrame, add: bool) -> DataFrame:
    """Filters after the ``crossed`` keys went in (``add``) or out; shards without a change stay as they are."""

    def run(keys: pa.Table, old: pa.Table) -> pa.Table:
        shard = (keys if len(keys) else old).column("shard")[0].as_py()
        digest = _digests(keys.column("digest").combine_chunks())
        have = Cuckoo(slots=old.column("slots")[0].as_py()) if len(old) else Cuckoo(len(digest))
        if add:
            have.insert(digest)
        else:
            have.delete(digest)
        return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([have.to_bytes()], pa.binary())})

    return crossed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, FILTERS)


def _built(repeated: DataFrame) -> DataFrame:
    """Filters of all repeated keys anew. A shard holds about ``SHARD_KEYS`` keys."""

    def run(keys: pa.Table) -> pa.Table:
        slots = filled(_digests(keys.column("digest").combine_chunks())).to_bytes()
        return pa.table({"shard": keys.column("shard").combine_chunks()[:1], "slots": pa.array([slots], pa.binary())})

    return repeated.select("shard", "digest").groupBy("shard").applyInArrow(run, FILTERS)


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("shard", "digest").agg(F.count("*").alias("n_docs"), F.max("doc").alias("top_doc"))


def new_state(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> LineState:
    """State of a corpus. The number of shards follows its repeated keys unless given."""
    postings = stored(postings_of(docs, id_col, text_col, min_chars, shards or 1), "postings")
    counts = stored(_counted(postings), "counts")
    repeated = counts.filter(F.col("n_docs") >= min_docs)
    if shards is None:
        shards = max(1, -(-repeated.count() // SHARD_KEYS))
        if shards > 1:  # the shard is a function of the digest
            shard = F.arrow_udf(lambda d: pa.array(_shard(_digests(d), shards)), "int")
            postings, counts = (stored(t.withColumn("shard", shard("digest")), n) for t, n in ((postings, "postings"), (counts, "counts")))
            repeated = counts.filter(F.col("n_docs") >= min_docs)
    return LineState(shards, postings, counts, stored(_built(repeated), "filters"), min_chars, min_docs)


def insert(state: LineState, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineState:
    """The state with more documents. Lines that a known id already holds change nothing."""
    fresh = postings_of(docs, id_col, text_col, state.min_chars, state.shards)
    fresh = stored(fresh.join(state.postings, ["shard", "digest", "doc"], "left_anti"), "fresh")
    old = F.coalesce("n_docs", F.lit(0))
    moved = _counted(fresh).select("shard", "digest", F.col("n_docs").alias("more"), F.col("top_doc").alias("top")).join(state.counts, ["shard", "digest"], "left")
    moved = stored(moved.select("shard", "digest", old.alias("was"), (old + F.col("more")).alias("n_docs"), F.greatest("top_doc", "top").alias("top_doc")), "moved")
    return _after(state, state.postings.unionByName(fresh), moved)


def delete(state: LineState, ids: DataFrame, id_col: str = "doc_id") -> LineState:
    """The state without the documents whose ids are given, as if they had never come."""
    gone = ids.select(as_key(id_col).alias("doc")).distinct()
    left = stored(state.postings.join(gone, "doc", "left_anti").select("shard", "digest", "doc"), "postings")
    touched = stored(state.postings.join(gone, "doc", "left_semi").select("shard", "digest").distinct(), "touched")
    now = _counted(left.join(touched, ["shard", "digest"], "left_semi"))
    was = state.counts.select("shard", "digest", F.col("n_docs").alias("was"))
    moved = touched.join(was, ["shard", "digest"]).join(now, ["shard", "digest"], "left")
    moved = stored(moved.select("shard", "digest", "was", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "top_doc"), "moved")
    return _after(state, left, moved)


def _after(state: LineState, postings: DataFrame, moved: DataFrame) -> LineState:
    """``moved(shard, digest, was, n_docs, top_doc)`` are the keys whose counts changed."""
    least = F.lit(state.min_docs)
    counts = state.counts.join(moved, ["shard", "digest"], "left_anti").unionByName(moved.filter("n_docs > 0").drop("was"))
    counts = stored(counts, "counts")
    up = moved.filter((F.col("was") < least) & (F.col("n_docs") >= least)).select("shard", "digest")
    down = moved.filter((F.col("was") >= least) & (F.col("n_docs") < least)).select("shard", "digest")
    try:
        filters = stored(_changed(up, _changed(down, state.filters, False), True), "filters")
    except Exception as failure:  # raised on an executor
        if CuckooFull.__name__ not in str(failure):
            raise
        filters = stored(_built(counts.filter(F.col("n_docs") >= least)), "filters")
    return LineState(state.shards, stored(postings, "postings"), counts, filters, state.min_chars, state.min_docs)


def _maybe(min_chars: int, filters, shards: int):
    """``(key, mark, line, digest)`` of the lines that the filters don't rule out; all long lines without filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: Cuckoo(slots=b) for s, b in filters.value.items()} if filters else None
        for batch in batches:
            keys, marks = np.asarray(batch.column("key")), np.asarray(batch.column("mark"))
            for i, j, data, offsets in pieces(batch.column("body")):
                lines = Lines(data, offsets)
                line, digest = lines.keys(data, min_chars)
                if tables is not None:
                    d = _digests(digest)
                    shard, hit = _shard(d, shards), np.zeros(len(d), bool)
                    for s, t in tables.items():
                        own = np.flatnonzero(shard == s)
                        hit[own] = t.contains(d[own])
                    line, digest = line[hit], [x for x, h in zip(digest, hit) if h]
                row = lines.row[line]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i:j][row]), pa.array(marks[i:j][row]), pa.array(line - lines.first[row]), pa.array(digest, pa.binary())], names=["key", "mark", "line", "digest"]
                )

    return run


def _without_lines(body: pa.Array, gone: pa.Array) -> pa.Array:
    n_lines, kept = [], []
    for i, j, data, offsets in pieces(body):
        lines = Lines(data, offsets)
        part = gone.slice(i, j - i)
        lengths = np.asarray(part.value_lengths().fill_null(0))
        stay = np.ones(len(lines.start), bool)
        stay[np.asarray(part.flatten()) + np.repeat(lines.first[:-1], lengths)] = False
        stay = np.flatnonzero(stay)
        row = lines.row[stay]
        follows = np.zeros(len(stay), bool)
        follows[1:] = row[1:] == row[:-1]
        mask = covered(len(data), lines.start[stay], lines.end[stay])
        mask[lines.start[stay[follows]] - 1] = True  # the break in front of a line that isn't the first one left
        sizes = np.concatenate([[0], np.cumsum(mask)])[offsets]
        n_lines.append(lines.count)
        kept.append(pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[mask])).cast(pa.string()))
    if not kept:
        return pa.array([], pa.struct([("n_lines", pa.int64()), ("kept", pa.string())]))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(n_lines).astype(np.int64)), pa.concat_arrays(kept)], names=["n_lines", "kept"])


def judge_lines(docs: DataFrame, state: LineState, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, n_lines, n_dropped, kept)`` per document: the text without lines that the state calls repeated."""
    spark: SparkSession = docs.sparkSession
    texts = packed(docs, id_col, text_col).select("row", "key", as_mark(), "body")
    size = state.filters.agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0))).first()[0]
    filters = spark.sparkContext.broadcast({r.shard: bytes(r.slots) for r in state.filters.collect()}) if size <= FILTER_BYTES else None
    maybe = texts.select("key", "mark", "body").mapInArrow(_maybe(state.min_chars, filters, state.shards), "key bigint, mark bigint, line bigint, digest binary")
    repeated = stored(state.counts.filter(F.col("n_docs") >= state.min_docs).select("digest", "top_doc"), "repeated")
    gone = maybe.join(repeated, "digest").filter("key <> top_doc").select("key", "mark", "line").distinct()
    lists = gone.groupBy("key", "mark").agg(F.collect_list("line").alias("gone"))
    answer = F.arrow_udf(_without_lines, "struct<n_lines:bigint,kept:string>")("body", F.coalesce("gone", F.lit(None).cast("array<bigint>")))
    joined = texts.join(lists, ["key", "mark"], "left").select("row", answer.alias("r"), F.coalesce(F.size("gone"), F.lit(0)).alias("n"))
    return joined.select("row", "r.n_lines", F.greatest(F.col("n"), F.lit(0)).cast("long").alias("n_dropped"), "r.kept")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows without repeated lines, as one batch."""
    state = new_state(docs, id_col, text_col, **options)
    return unpacked(judge_lines(docs, state, id_col, text_col), **{text_col: F.col("kept")})
