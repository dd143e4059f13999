"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles. A run starts at a root that holds
all sets; a node hands a set on to the children named by the shingles that the set
*chooses* there, those whose hash under the node falls below
``1 / (SPLIT * size of the set)``: 1 / SPLIT shingles on average. Similar sets choose
shared shingles and meet in a child. Children with at most ``SMALL`` sets, and larger
ones whose sets are alike on average, are compared by brute force. The sets of the
other ones (one passage in very many texts makes them) are split on by paths of
several choices at once, each the set's smallest shingle under a hash that only this
step of this run uses; the paths are the longer the more sets there are. A pair's
chance to meet in one run is known for both steps and no two runs share a draw, so
the numbers of runs follow from the target recall at the threshold.

Brute force in a node compares short min-hash sketches and keeps a spanning forest
of what may be similar; within such a component all texts meet once, again in
blocks, and the exact Jaccard similarity of the whole sets decides every pair. So
no group gives all its pairs as rows, and no group is one task's work.

A document is an id with a text, told apart by the text's MD5 digest; so different
texts of one id, or without an id, are documents of their own, and rows that repeat
both are one. Documents with equal shingle sets are folded first and counted with
their number. Words are runs of anything but ASCII white space, ``A-Z`` lower-cased; a
text of one to four words has one shingle, all its words. Null, empty and blank texts
match nothing. A null id is the smallest id. An empty table gives an empty result.

Texts stay in their scans: sketches, nodes and answers are narrow rows, and only texts
that a rough component holds are shuffled, picked by a Bloom filter (``picking``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Words, lower_ascii, mix, pieces, prefix_sums, space_words, span_hash
from .blocks import compared, in_units
from .components import components
from .picking import in_filter, may_be_wanted, wanted_filter
from .tables import as_key, stored

SHINGLE = 5
JACCARD = 0.8
RECALL = 0.995
SPLIT = 0.6
SMALL = 512
BLOCK = 512
ALIKE = 0.5  # mean similarity from which a large node isn't split any more
UNLIKE = 0.43  # similarity of the sets that longer paths are to part
MATES = 1024
LONGEST = 16  # choices of a path
FIRST_SHARE = 0.75  # of the pairs that may be missed, at most so many in the first step
PLACES = 4  # of a sketch that are asked for a node's mean similarity
SKETCH = 64  # minima, one byte of each
DOUBT = 4.0  # standard deviations of a sketch below the threshold that are still compared exactly
UNIT_BYTES = 6 << 20  # text of a shard of exact comparisons
BLOCK_BYTES = 2 << 20  # text of a block of them, if it has more than one row


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the distinct shingles, sorted by row and hash."""
    size = np.minimum(words.count, k)[words.row]
    place = np.arange(len(words))
    start = np.flatnonzero(place + size <= words.first[1:][words.row])
    h = span_hash(prefix_sums(words.hash), start, start + size[start])
    row = words.row[start]
    order = np.lexsort([h, row])
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def runs_for(recall: float, meet: float) -> int:
    """Runs after which a pair that meets in one of them with chance ``meet`` has met with chance ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def first_meeting(jaccard: float, split: float = SPLIT) -> float:
    """Chance that two sets of one size at this similarity choose a shared shingle at a root."""
    return 1 - math.exp(-2 * jaccard / (1 + jaccard) / split)


def path_length(sets: int) -> int:
    """Choices after which about ``MATES`` of so many half-alike sets are still together."""
    return min(LONGEST, max(2, math.ceil(math.log(max(1.0, sets / MATES)) / math.log(1 / UNLIKE))))


def plan(jaccard: float, recall: float) -> tuple[int, float]:
    """``(runs of the first step, recall of the longer paths)``: a pair that has to pass both is found with chance ``recall``."""
    missed = 1 - recall
    meet = first_meeting(jaccard)
    runs = runs_for(1 - FIRST_SHARE * missed, meet)
    return runs, recall / (1 - (1 - meet) ** runs)


def first_nodes(h: np.ndarray, count: np.ndarray, runs: int, split: float = SPLIT) -> tuple[np.ndarray, np.ndarray]:
    """``(row, node)``: the children that each set is handed to from the roots of all runs."""
    row = np.repeat(np.arange(len(count)), count)
    limit = (2.0**64 / (split * np.maximum(count, 1 / split))).clip(max=2.0**64 - 2049).astype(U64)[row]
    rows, nodes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for root in mix(np.arange(1, runs + 1, dtype=U64)):
        drawn = mix(h ^ root)
        hit = drawn < limit
        rows.append(row[hit])
        nodes.append(mix(drawn[hit] + h[hit] * U64(5)))
    return np.concatenate(rows), np.concatenate(nodes)


def end_nodes(h: np.ndarray, count: np.ndarray, runs: int, length: int) -> Iterator[np.ndarray]:
    """For each run, the end node of every set's path (no set is empty). Every step of every run has its own hash."""
    starts = np.cumsum(count) - count
    for run in range(1, runs + 1):
        node = np.full(len(count), run, U64)
        for factor in mix(np.arange(run * length, (run + 1) * length, dtype=U64) * U64(131) + U64(1 << 32)) | U64(1):
            node = mix(node ^ mix(np.minimum.reduceat(h * factor, starts))) + U64(1)
        yield node


def sketches(row: np.ndarray, h: np.ndarray, count: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """``(rows, size)`` low bytes of min-hashes; rows without shingles are zero."""
    out = np.zeros((len(count), size), np.uint8)
    full = np.flatnonzero(count)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(count)])[:-1][full]
        for i, factor in enumerate(mix(np.arange(1, size + 1, dtype=U64) * U64(77)) | U64(1)):
            out[full, i] = (mix(np.minimum.reduceat(h * factor, starts)) & U64(0xFF)).astype(np.uint8)
    return out


SETS = "key long, mark binary, digest binary, size long, sketch binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in pieces(batch.column("body")):
            row, h = shingles(Words(lower_ascii(data), offsets, space_words()))
            count = np.bincount(row, minlength=j - i)
            some = np.flatnonzero(count)
            starts = (np.cumsum(count) - count)[some]
            sums = [np.add.reduceat(mix(h + U64(s)), starts) if len(some) else np.zeros(0, U64) for s in (1, 2)]
            digest = np.stack([*sums], axis=1)
            sketch = sketches(row, h, count)[some]
            fixed = lambda a, n: pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(a), [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())
            own = [batch.column(c).slice(i, j - i).take(pa.array(some)) for c in ("key", "mark")]
            yield pa.RecordBatch.from_arrays([*own, fixed(digest, 16), pa.array(count[some].astype(np.int64)), fixed(sketch, SKETCH)], names=["key", "mark", "digest", "size", "sketch"])


PLACED = "pick long, node long"
ROWS_AT_ONCE = 256  # of which the wanted ones are copied out of a batch


def _first(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picks = np.asarray(batch.column("pick"))
            for i, j, data, offsets in pieces(batch.column("body")):
                row, h = shingles(Words(lower_ascii(data), offsets, space_words()))
                row, node = first_nodes(h, np.bincount(row, minlength=j - i), runs)
                yield pa.RecordBatch.from_arrays([pa.array(picks[i:j][row]), pa.array(node.view(np.int64))], names=["pick", "node"])

    return run


def _deep(runs: int, length: int, shared: Broadcast):
    """Paths of the texts that pass the filter of the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                picks = np.asarray(part.column("pick"))
                maybe = np.flatnonzero(in_filter(shared.value, picks.view(U64)))
                if not len(maybe):
                    continue
                picks = picks[maybe]
                for i, j, data, offsets in pieces(part.column("body").take(pa.array(maybe))):
                    row, h = shingles(Words(lower_ascii(data), offsets, space_words()))
                    count = np.bincount(row, minlength=j - i)
                    some = np.flatnonzero(count)
                    if len(some):
                        own = pa.array(picks[i:j][some])
                        for node in end_nodes(h, count[some], runs, length):
                            yield pa.RecordBatch.from_arrays([own, pa.array(node.view(np.int64))], names=["pick", "node"])

    return run


def _may_be_near(threshold: float):
    least = threshold - DOUBT * math.sqrt(threshold * (1 - threshold) / SKETCH)

    def compare(rows: pa.Table):
        every = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)

        def links_of(own: np.ndarray) -> np.ndarray:
            s = every[own]
            if len(own) <= 32:
                return (s[:, None, :] == s[None, :, :]).sum(axis=2, dtype=np.uint8) >= least * SKETCH
            same = np.zeros((len(own), len(own)), np.uint8)
            for i in range(SKETCH):
                same += s[:, i][:, None] == s[:, i][None, :]
            return same >= least * SKETCH

        return links_of

    return compare


def _exactly_near(threshold: float):
    def compare(rows: pa.Table):
        found = [(i, *shingles(Words(lower_ascii(data), offsets, space_words()))) for i, _, data, offsets in pieces(rows.column("body").combine_chunks())]
        every = np.concatenate([h for _, _, h in found])
        ends = np.cumsum(np.bincount(np.concatenate([r + i for i, r, _ in found]), minlength=len(rows)))
        return lambda own: _near_sets([every[a:b] for a, b in zip(np.append(0, ends)[own], ends[own])], threshold)

    return compare


def _near_sets(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets reach the Jaccard similarity with each other."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    row, h = np.repeat(np.arange(n), size), np.concatenate(sets)
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    often = times[column] > 1
    row, column = row[often], column[often]
    column = np.unique(column, return_inverse=True)[1]
    shared = np.zeros((n, n), np.float32)  # counts below 2**24 are exact
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(columns, (1 << 22) // n))
    for low in range(0, columns, width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((n, width), np.float32)
        block[row[a:b], column[a:b] - low] = 1
        shared += block @ block.T
    union = size[:, None] + size[None, :] - shared
    return (shared >= threshold * union - 1e-6) & (union > 0)


def _mark(body: Column) -> Column:
    return F.unhex(F.md5(body.cast("binary")))


def _pick() -> Column:
    return F.xxhash64("key", "mark")


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """``(key, mark, rows, n_links, component, first)`` of every document with words.

    ``n_links`` counts the other documents at ``jaccard`` or above, ``component`` is the
    smallest id reachable by such links; one document of a component is its ``first``.
    ``rows`` is how many input rows the document has.
    """
    body = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(as_key(f"`{id_col}`").alias("key"), _mark(body).alias("mark"), body.alias("body")).filter("body IS NOT NULL")
    sets = texts.mapInArrow(_sets, SETS)
    ids = stored(sets.groupBy("key", "mark").agg(F.count("*").alias("rows"), F.max("digest").alias("digest"), F.max("sketch").alias("sketch")), "ids")
    head = F.min(F.struct("key", "mark")).alias("head")
    classes = ids.groupBy("digest").agg(head, F.count("*").alias("copies"), F.max("sketch").alias("sketch"))
    numbered = F.monotonically_increasing_id().alias("item")  # written once, so it stays
    heads = stored(classes.select(numbered, "digest", "copies", "sketch", "head.key", "head.mark"), "heads")
    pairs = _met(texts, heads, jaccard, recall)
    dealt = in_units(pairs.withColumn("one", F.lit(1)), "node", "size", "item", BLOCK, "one", 50_000).drop("one")
    dealt = dealt.join(heads.select("item", "sketch"), "item")
    maybe = compared(dealt, _may_be_near(jaccard), "item").filter("partner IS NOT NULL")
    rough = stored(components(maybe.select(F.col("node").alias("a"), F.col("partner").alias("b")).distinct()), "rough")
    found = _verified(texts, rough, heads, jaccard)
    direct = found.filter("partner IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("partner IS NOT NULL").select(F.col("node").alias("a"), F.col("partner").alias("b")))
    linked = stored(joined.join(heads.select(F.col("item").alias("id"), "key", "mark"), "id"), "linked")
    tops = stored(linked.groupBy("component").agg(F.min(F.struct("key", "mark")).alias("top")), "tops")
    links = linked.join(tops, "component").select(F.col("id").alias("item"), "top").join(direct.withColumnRenamed("node", "item"), "item", "left")
    own = F.struct("key", "mark")
    groups = heads.join(links, "item", "left").select("digest", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("top", own).alias("top"))
    told = ids.select("key", "mark", "rows", "digest").join(stored(groups, "groups"), "digest")
    return told.select("key", "mark", "rows", (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("top.key").alias("component"), (own == F.col("top")).alias("first"))


def _met(texts: DataFrame, heads: DataFrame, jaccard: float, recall: float) -> DataFrame:
    """``(item, node, size)`` of the nodes that are compared."""
    # two documents may share a pick by chance: that adds a candidate, which the exact check turns down
    known = heads.select(_pick().alias("pick"), "item")
    picked = texts.select(_pick().alias("pick"), "body")
    first_runs, deep_recall = plan(jaccard, recall)
    nodes = picked.mapInArrow(_first(first_runs), PLACED)
    nodes = stored(nodes.join(known, "pick").select("item", "node"), "nodes")
    sizes = stored(_sizes(nodes), "sizes")
    large = sizes.filter(F.col("size") > SMALL)
    inside = stored(nodes.join(large.select("node"), "node"), "inside")
    alike = stored(_alike(inside, heads), "alike")
    ready = sizes.filter(F.col("size") <= SMALL).unionByName(large.join(alike, "node", "left_semi"))
    met = nodes.join(ready, "node").select("item", "node", "size")
    split = inside.join(alike, "node", "left_anti").select("item").distinct()
    split = stored(split.join(known, "item"), "split")
    n = split.count()
    if n:
        length = path_length(n)
        runs = runs_for(deep_recall, jaccard**length)
        deep = picked.mapInArrow(_deep(runs, length, wanted_filter(split.select("pick"))), PLACED)
        deep = stored(deep.join(split, "pick").select("item", "node"), "paths")
        met = met.unionByName(deep.join(_sizes(deep), "node").select("item", "node", "size"))
    return stored(met, "met")


def _sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")


def _alike(inside: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes whose sets, drawn two at a time, agree in a sketch's places more often than ``ALIKE``."""
    few = heads.select("item", F.concat(*[F.substring("sketch", i + 1, 1) for i in range(0, SKETCH, SKETCH // PLACES)]).alias("few"))
    places = F.array(*[F.struct(F.lit(i).alias("place"), F.substring("few", i + 1, 1).alias("value")) for i in range(PLACES)])
    values = inside.join(few, "item").select("node", F.explode(places).alias("at")).groupBy("node", "at").agg(F.count("*").alias("n"))
    share = F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n") / F.lit(PLACES))
    return values.groupBy("node").agg(share.alias("share")).filter(F.col("share") >= ALIKE).select("node")


def _verified(texts: DataFrame, rough: DataFrame, heads: DataFrame, jaccard: float) -> DataFrame:
    """``compared`` rows of exact links; texts are picked by a filter of the documents in rough components."""
    members = stored(rough.join(heads.select(F.col("item").alias("id"), "copies", "key", "mark"), "id").withColumnRenamed("id", "item"), "members")
    shared = wanted_filter(members.select(_pick()))
    picked = texts.filter(may_be_wanted(shared, _pick()))
    # always a merge join, whatever the size: the plan measured on little data is the one that runs on much
    body = picked.join(members.hint("merge"), ["key", "mark"]).dropDuplicates(["item"])
    body = stored(body.select("item", "component", "copies", "body", F.octet_length("body").alias("bytes")), "bodies")
    sums = body.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("all_bytes"))
    # a block holds at most BLOCK rows, and about BLOCK_BYTES of text
    sizes = stored(sums.select("component", F.greatest("n", F.ceil(F.col("all_bytes") * F.lit(BLOCK / BLOCK_BYTES))).alias("size")), "sizes")
    dealt = in_units(body.join(sizes, "component"), "component", "size", "item", BLOCK, "bytes", UNIT_BYTES)
    return stored(compared(dealt, _exactly_near(jaccard), "item", "copies"), "links")


def judge_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, **options) -> DataFrame:
    """``(row, key, n_links, component, first)`` of every input row; ``row`` holds ``columns``, all by default.

    A text without words links with nothing. Wide rows meet their answers in a join, so
    ask for the columns that are needed only.
    """
    told = stored(near_texts(docs, id_col, text_col, **options), "near")
    row = F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row")
    rows = docs.select(row, as_key(f"`{id_col}`").alias("key"), _mark(F.col(f"`{text_col}`").cast("string")).alias("mark"))
    joined = rows.join(told, ["key", "mark"], "left")
    return joined.select("row", "key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "key").alias("component"), F.coalesce("first", F.lit(True)).alias("first"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; texts without words all stay.

    Only rows that go, or that repeat, meet their answers in a join; the others stay
    where they are read.
    """
    told = near_texts(docs, id_col, text_col, **options)
    special = stored(told.filter(~F.col("first") | (F.col("rows") > 1)).select("key", "mark", "first"), "special")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, as_key(f"`{id_col}`").alias("key"), F.coalesce(_mark(F.col(f"`{text_col}`").cast("string")), F.lit(b"")).alias("mark"))
    maybe = may_be_wanted(wanted_filter(special.select(_pick())), _pick())
    asked = rows.filter(maybe).join(special, ["key", "mark"], "left")
    repeated = asked.filter("first").groupBy("key", "mark").agg(F.any_value("row").alias("row"))
    kept = rows.filter(~maybe).select("row").unionByName(asked.filter("first IS NULL").select("row")).unionByName(repeated.select("row"))
    return kept.select("row.*")
