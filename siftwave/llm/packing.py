"""Packing by order-preserving dynamic programming.

The documents of a scan partition form one token stream in their stored order, in
stretches of some MB of text. A window cut may fall behind a document (free),
behind a sentence (a small penalty) or, so that text without sentences can be cut
too, behind every ``FILLER`` tokens of a longer sentence (a larger one). With
``f(j)`` the least cost of a stream cut at ``j``,

    f(j) = penalty(j) + min over i of f(i) + cost(j - i)

where a window of n tokens costs ``capacity - n`` padding, or none if n is a power
of two, and a constant. The padding is linear in ``i``, so the minimum over all
``i`` within reach is the head of a monotone queue; powers of two are looked up.

Every id lies in one piece, a window is a run of pieces, and nothing is shuffled.
Null and empty texts are their end id alone; null ids stay null; repeated rows are
packed each. A window's id is made of the partition and its number there, so a
retried task repeats it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import pieces
from .tokens import encoder

CAPACITY = 2048
END_ID = 1
SENTENCE_PENALTY = 1.0
FILLER_PENALTY = 4.0
WINDOW_COST = 8.0
SHORTEST = 256  # shorter windows are made at the end of a stretch only
FILLER = 64  # tokens
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_cuts(place: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Indices into the rising cut places (the first is the stream's begin, the last its end) of the cheapest cuts."""
    n = len(place)
    exact: dict[int, list[int]] = {}  # cut place -> begins of windows whose length is a power of two
    for k in range(capacity.bit_length()):
        ends = np.arange(n) if 1 << k >= SHORTEST else np.array([n - 1])  # very short windows only at the end
        begins = np.searchsorted(place, place[ends] - (1 << k))
        for i in np.flatnonzero(place[begins] == place[ends] - (1 << k)).tolist():
            exact.setdefault(int(ends[i]), []).append(int(begins[i]))
    where, extra = place.tolist(), (penalty + WINDOW_COST).tolist()
    cost, before = [0.0] * n, [0] * n
    line, value, head = [0], [0.0], 0  # the queue: rising places, rising cost + place
    for j in range(1, n):
        here = where[j]
        while where[line[head]] < here - capacity:
            head += 1
        best = line[head]
        least = value[head] + capacity - here
        if j in exact:
            for i in exact[j]:
                if cost[i] <= least:
                    best, least = i, cost[i]
        cost[j] = least = least + extra[j]
        before[j] = best
        least += here
        while len(value) > head and value[-1] >= least:
            value.pop()
            line.pop()
        value.append(least)
        line.append(j)
    path = [n - 1]
    while path[-1]:
        path.append(before[path[-1]])
    return np.array(path[::-1])


def cut_places(size: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, penalty, end of each document)``: where the token stream may be cut.

    ``size`` and the rest describe the encoder's text pieces; each document has one more id at its end.
    """
    stop = np.cumsum(size) + row  # stream place behind each text piece
    doc_end = np.cumsum(np.bincount(row, weights=size, minlength=rows).astype(np.int64) + 1)
    closes = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8)) if len(end) else np.zeros(0, bool)
    closes[:-1] |= (data[start[1:]] == 0x0A) & (row[1:] == row[:-1])
    soft = stop[closes]
    known = np.unique(np.concatenate([[0], soft, doc_end]))
    gap = np.diff(known)
    inside = np.maximum(0, (gap - 1) // FILLER)
    fill = np.repeat(known[:-1] - np.concatenate([[0], np.cumsum(inside * FILLER)[:-1]]), inside) + FILLER * np.arange(1, inside.sum() + 1)
    place = np.concatenate([known, fill])
    penalty = np.full(len(place), FILLER_PENALTY)
    penalty[: len(known)] = SENTENCE_PENALTY
    penalty[np.searchsorted(known, doc_end)] = 0
    order = np.argsort(place, kind="stable")
    return place[order], penalty[order], doc_end


def _pack(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch.column("doc_id")
            for i, j, data, offsets in pieces(batch.column("body")):
                ids, size, row, start, end = encode.encode(data, offsets)
                place, penalty, doc_end = cut_places(size, row, start, end, data, j - i)
                stream = np.full(int(doc_end[-1]), END_ID, "<u4")
                stream[np.arange(len(ids)) + np.repeat(row, size)] = ids
                cuts = place[best_cuts(place, penalty, capacity)]
                doc_start = np.concatenate([[0], doc_end[:-1]])
                begin = np.unique(np.concatenate([cuts[:-1], doc_start]))
                stop = np.append(begin[1:], doc_end[-1])
                doc = np.searchsorted(doc_start, begin, "right") - 1
                window = np.searchsorted(cuts, begin, "right") - 1
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, doc_end[-1]) * 4), pa.py_buffer(stream)])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(i, j - i).take(pa.array(doc)),
                        pa.array(begin - doc_start[doc]),
                        pa.array(stop - begin),
                        blob.cast(pa.binary()),
                        pa.array((doc_end - doc_start)[doc]),
                        pa.array(sequence + window),
                        pa.array(begin - cuts[window]),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
                sequence += len(cuts) - 1

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` of windows of at most ``capacity`` tokens.

    ``tokenizer`` is the path of a byte-level tokenizer file that every worker can
    read. ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    return texts.mapInArrow(_pack(tokenizer, capacity), PIECES)
