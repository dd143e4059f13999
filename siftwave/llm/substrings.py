"""Substring dedup by De Bruijn compaction.

Edges are the token k-mers (windows of ``k`` words). Consecutive k-mers whose
smallest inner gram is the same occurrence form one *path piece*, so a text of n
words gives about 2n/17 pieces at k = 20 instead of n edges, and equal k-mers
always lie in pieces of the same gram.

1. Count the pieces by gram. A gram seen once has no repeated k-mer.
2. A gram whose pieces all have the same words is *nonbranching*: each of its
   paths enters and leaves alike, so the piece is compacted into one edge, and
   its smallest coordinate ``(id, text, start)`` is the source of all others.
3. Pieces of branching grams are opened into their k-mers, which meet by a
   128-bit hash, and again the smallest coordinate is the source.

Pieces and k-mers whose source lies earlier are repeated; consecutive ones with
the same source coordinates merge into long spans.

Words are runs of anything but ASCII white space, unchanged. Null and empty texts
have no words. A null id is the smallest id. Rows that repeat an id with the same
text are one document: both get the same answer. Different texts of one id are
documents of their own, in the order of a hash of the text (``mark``). Other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U64, Words, covered, mix, pieces, prefix_sums, space_words, span_hash, spread
from .tables import as_mark, packed, stored, unpacked

WINDOW = 20  # words
GRAM = 5  # words; each window of 20 words holds 16 grams
PIECE = "gram long, path long, key long, mark long, start long, windows int"
EDGE = "h1 long, h2 long, key long, mark long, start long"


def path_pieces(words: Words, k: int, m: int) -> tuple[np.ndarray, ...]:
    """``(gram, path, row, start, windows)``: runs of windows that share their smallest gram."""
    starts = words.window_starts(k)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = words.window_hash(m)
    low = U64(0xFFFFFFFF)
    least = (grams & ~low) | np.arange(len(grams), dtype=U64)  # ties: the first
    width, span = k - m + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first, anchor = starts[at], anchor[at]
    path = span_hash(prefix_sums(words.hash), first, first + count - 1 + k)
    path = mix(path ^ (anchor - first + 1).astype(U64))
    row = words.row[first]
    return grams[anchor].view(np.int64), path.view(np.int64), row, first - words.first[row], count


def _emit_pieces(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks = np.asarray(batch.column("key")), np.asarray(batch.column("mark"))
            for i, j, data, offsets in pieces(batch.column("body")):
                gram, path, row, start, count = path_pieces(Words(data, offsets, space_words()), k, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(path), pa.array(keys[i:j][row]), pa.array(marks[i:j][row]), pa.array(start), pa.array(count.astype(np.int32))],
                    names=["gram", "path", "key", "mark", "start", "windows"],
                )

    return run


def _emit_edges(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks, lists = np.asarray(batch.column("key")), np.asarray(batch.column("mark")), batch.column("open")
            for i, j, data, offsets in pieces(batch.column("body")):
                words = Words(data, offsets, space_words())
                part = lists.slice(i, j - i)
                row = np.repeat(np.arange(j - i), np.asarray(part.value_lengths()))
                flat = part.flatten()
                start, count = np.asarray(flat.field("start")), np.asarray(flat.field("windows")).astype(np.int64)
                at = spread(words.first[row] + start, count)
                row = np.repeat(row, count)
                h1 = span_hash(prefix_sums(words.hash), at, at + k)
                h2 = span_hash(prefix_sums(mix(words.hash ^ U64(k))), at, at + k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(keys[i:j][row]), pa.array(marks[i:j][row]), pa.array(at - words.first[row])],
                    names=["h1", "h2", "key", "mark", "start"],
                )

    return run


def _later(df: DataFrame, by: list[str], k: int, length: Column) -> DataFrame:
    """Rows behind the first row of their group, with that row's coordinates.

    The first rows are written before the join, so that Spark can split a hot group's rows.
    """
    first = df.groupBy(*by).agg(F.min(F.struct("key", "mark", "start")).alias("source"), F.count("*").alias("n")).filter("n > 1")
    first = stored(first.drop("n"), "first")
    joined = df.join(first, by).filter(F.struct("key", "mark", "start") > F.col("source"))
    source = [F.col(f"source.{c}").alias(f"source_{c}") for c in ("key", "mark", "start")]
    return joined.select("key", "mark", "start", length.alias("n_words"), *source)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = GRAM) -> DataFrame:
    """``(key, mark, start, n_words, source_key, source_mark, source_start)``: word runs whose words also stand at an earlier source.

    ``key`` is the id as long, ``mark`` a hash of the text. Runs may overlap; ``repeated_spans`` merges them.
    """
    texts = packed(docs, id_col, text_col).select("key", as_mark(), "body")
    found = texts.mapInArrow(_emit_pieces(k, m), PIECE)
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("path").alias("p"), F.max("path").alias("q")).filter("n > 1")
    grams = stored(grams.select("gram", (F.col("p") != F.col("q")).alias("branching")), "grams")
    shared = stored(found.select("gram", "key", "mark", "start", "windows").join(grams, "gram"), "pieces")
    whole = _later(shared.filter("not branching"), ["gram"], k, (F.col("windows") + F.lit(k - 1)).cast("long"))
    open_lists = shared.filter("branching").groupBy("key", "mark").agg(F.collect_list(F.struct("start", "windows")).alias("open"))
    edges = stored(texts.join(open_lists, ["key", "mark"]).mapInArrow(_emit_edges(k), EDGE), "edges")
    single = _later(edges, ["h1", "h2"], k, F.lit(k).cast("long"))
    return stored(whole.unionByName(single), "repeats")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """``(key, mark, start, n_words, source_key, source_mark, source_start)``: longest runs that follow one source word by word.

    A run grows only while the distance to its source stays the same, so its
    coordinates tie every word of it to one word of the source.
    """
    runs = repeats(docs, id_col, text_col, k).distinct()
    runs = runs.withColumn("shift", F.col("start") - F.col("source_start")).withColumn("end", F.col("start") + F.col("n_words"))
    path = Window.partitionBy("key", "mark", "source_key", "source_mark", "shift").orderBy("start")
    reach = F.max("end").over(path.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("span", F.sum("new").over(path))
    spans = marked.groupBy("key", "mark", "source_key", "source_mark", "shift", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.select("key", "mark", "start", (F.col("end") - F.col("start")).alias("n_words"), "source_key", "source_mark", (F.col("start") - F.col("shift")).alias("source_start"))


KEPT = "struct<n_words:bigint,n_removed:bigint,kept:string>"


def _without_runs(body: pa.Array, runs: pa.Array) -> pa.Array:
    n_words, n_removed, kept = [], [], []
    for i, j, data, offsets in pieces(body):
        words = Words(data, offsets, space_words())
        part = runs.slice(i, j - i)
        lengths = np.asarray(part.value_lengths().fill_null(0))
        flat = part.flatten()
        start = np.asarray(flat.field("start")) + np.repeat(words.first[:-1], lengths)
        gone = covered(len(words), start, start + np.asarray(flat.field("n_words")))
        n_words.append(words.count)
        n_removed.append(np.bincount(words.row[gone], minlength=j - i))
        stay = np.flatnonzero(~gone)
        row = words.row[stay]
        follows = np.zeros(len(stay), bool)
        follows[1:] = row[1:] == row[:-1]
        out = data.copy()
        glue = words.start[stay[follows]] - 1  # the white space before a word becomes its one space
        out[glue] = 0x20
        mask = covered(len(data), words.start[stay], words.end[stay])
        mask[glue] = True
        sizes = np.concatenate([[0], np.cumsum(mask)])[offsets]
        kept.append(pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(out[mask])).cast(pa.string()))
    if not kept:
        return pa.array([], pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))
    join = lambda parts: pa.array(np.concatenate(parts).astype(np.int64))
    return pa.StructArray.from_arrays([join(n_words), join(n_removed), pa.concat_arrays(kept)], names=["n_words", "n_removed", "kept"])


def judge_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """``(row, n_words, n_removed, kept)``: each input row as a struct and its text without repeated windows.

    The words left are joined by one space.
    """
    runs = repeats(docs, id_col, text_col, k)
    lists = runs.groupBy("key", "mark").agg(F.collect_list(F.struct("start", "n_words")).alias("runs"))
    none = F.lit(None).cast("array<struct<start:bigint,n_words:bigint>>")
    joined = packed(docs, id_col, text_col).select("row", "key", as_mark(), "body").join(lists, ["key", "mark"], "left")
    result = F.arrow_udf(_without_runs, KEPT)(F.col("body"), F.coalesce("runs", none)).alias("r")
    return joined.select("row", result).select("row", "r.n_words", "r.n_removed", "r.kept")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """The input rows with repeated windows taken out of their text."""
    return unpacked(judge_repeats(docs, id_col, text_col, k), **{text_col: F.col("kept")})
