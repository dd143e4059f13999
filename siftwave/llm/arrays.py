"""Words and hashes of Arrow text columns, vectorised.

The kernels look at UTF-8 bytes. All separators asked for are ASCII, so bytes of
multi-byte characters are always inside words.

A span of values ``v[i..j)`` is hashed as a polynomial over the ring of 64-bit
integers with an odd base. Prefix sums give the hash of any span with two
look-ups, and the span's place cancels out through the base's inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20  # text handled at once: bounds the memory of one call, not the text that is read
BASE = 0x9E3779B97F4A7C15
SPACE_BYTES = [0x20, *range(0x09, 0x0E)]

_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads each input bit over all 64 bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers ``0..n`` of the base and of its inverse."""
    have = _tables.get("powers")
    if have is None or len(have) <= n:
        size = (int(n) // 65536 + 2) * 65536
        for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, U64)
            table[0] = 1
            _tables[name] = np.cumprod(table, dtype=U64)
    return _tables["powers"][: n + 1], _tables["inverse"][: n + 1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """``p`` with ``p[i]`` the polynomial of ``values[:i]``."""
    p = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0][: len(values)], dtype=U64, out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span ``[start, end)``; equal spans of one length hash alike wherever they stand."""
    h = (p[end] - p[start]) * powers(len(p))[1][start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``max_bytes`` text: ``(first row, end row, bytes, offsets)``. A row is never cut."""
    data, offsets = text_buffer(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def byte_values() -> np.ndarray:
    if "bytes" not in _tables:
        _tables["bytes"] = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
    return _tables["bytes"]


def space_words() -> np.ndarray:
    """Byte class of words between ASCII white space."""
    table = np.ones(256, bool)
    table[SPACE_BYTES] = False
    return table


def alnum_words() -> np.ndarray:
    """Byte class of words of ASCII digits, ASCII small letters and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]


class Words:
    """Words of several texts: byte spans, row of each word, hash, words per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, members: np.ndarray):
        self.data, self.offsets, rows = data, offsets, len(offsets) - 1
        inside = members[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]  # of the texts that aren't empty
        ends = offsets[1:][offsets[:-1] < offsets[1:]]
        before[starts] = False
        after[ends - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # first word of each row
        self.bytes = prefix_sums(byte_values()[data])
        self.hash = span_hash(self.bytes, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def window_hash(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; the last ``k - 1`` entries are missing."""
        n = max(0, len(self) - k + 1)
        i = np.arange(n)
        return span_hash(prefix_sums(self.hash), i, i + k)

    def window_starts(self, k: int) -> np.ndarray:
        """Words at which a window of ``k`` words of one row starts."""
        n = max(0, len(self) - k + 1)
        return np.flatnonzero(self.row[:n] == self.row[k - 1 :])


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the ``n`` places inside any span ``[start, end)``."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, start, 1)
    np.add.at(delta, end, -1)
    return np.cumsum(delta[:n]) > 0


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i] + 0, 1, … count[i] - 1`` for all ``i``, one after another."""
    total = int(count.sum())
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if total else np.zeros(0, np.int64)
    return np.arange(total) + shift
