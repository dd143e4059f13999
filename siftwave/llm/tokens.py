"""Token ids of many texts with a tokenizer file, each distinct piece of text encoded once.

A byte-level tokenizer never joins the end of a word with white space behind it,
so a text may be cut in front of white space that follows something else. The
distinct pieces are few against the text; they are encoded together and put back
in place by their hash. Every piece is compared with the bytes its hash stands for;
one of equal hash and other bytes is encoded on its own.
"""

from __future__ import annotations

import numpy as np

from .arrays import U64, byte_values, prefix_sums, span_hash, spread

KNOWN_PIECES = 500_000  # pieces a worker remembers before it starts afresh

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.byte_length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.byte_length[i] = len(token)  # one character stands for one byte
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        self.known, self.at, self.size, self.pool = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.bytes, self.bytes_at, self.bytes_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, ids of each piece, row, start, end of each piece)`` of all texts, in order."""
        start, end, row, alone = cut(data, offsets)
        h = span_hash(prefix_sums(byte_values()[data]), start, end)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            if len(self.known) + len(new) > KNOWN_PIECES:
                self._forget()
                new = np.arange(len(distinct))
            self._learn(data, start[first[new]], end[first[new]], alone[first[new]], distinct[new])
            at = np.searchsorted(self.known, distinct)
        place, size, pool = self.at[at], self.size[at], self.pool
        # known pieces whose bytes are others, and pieces that differ from the first of their hash
        wrong = _differ(data, start[first], end[first] - start[first], self.bytes, self.bytes_at[at], self.bytes_size[at])
        other = _differ(data, start, end - start, data, start[first][which], (end - start)[first][which]) | wrong[which]
        place, size = place[which], size[which]
        for i in np.flatnonzero(other):
            ids = np.array(self._ids(data[start[i] : end[i]].tobytes().decode()), np.int32)
            place[i], size[i] = len(pool), len(ids)
            pool = np.concatenate([pool, ids])
        return pool[spread(place, size)], size, row, start, end

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray, h: np.ndarray) -> None:
        ids, sizes = [], np.zeros(len(start), np.int64)
        together = np.flatnonzero(~alone)
        length = (end - start)[together]
        joined = data[spread(start[together], length)]
        closes = np.cumsum(length)
        order = [together]
        for a in range(0, len(together), 20_000):
            b = min(len(together), a + 20_000)
            low = closes[a - 1] if a else 0
            got = np.array(self._ids(joined[low : closes[b - 1]].tobytes().decode()), np.int32)
            ends = np.searchsorted(np.cumsum(self.byte_length[got]), closes[a:b] - low) + 1
            sizes[together[a:b]] = np.diff(ends, prepend=0)
            ids.append(got)
        single = np.flatnonzero(alone)
        order.append(single)
        for i in single:
            got = self._ids(data[start[i] : end[i]].tobytes().decode())
            sizes[i] = len(got)
            ids.append(np.array(got, np.int32))
        place = np.empty(len(start), np.int64)
        taken = np.concatenate(order)
        place[taken] = np.cumsum(sizes[taken]) - sizes[taken] + len(self.pool)
        self.pool = np.concatenate([self.pool, *ids])
        bytes_at = np.cumsum(end - start) - (end - start) + len(self.bytes)
        self.bytes = np.concatenate([self.bytes, data[spread(start, end - start)]])
        known = np.concatenate([self.known, h])
        order = np.argsort(known)
        self.bytes_at, self.bytes_size = np.concatenate([self.bytes_at, bytes_at])[order], np.concatenate([self.bytes_size, end - start])[order]
        self.known, self.at, self.size = known[order], np.concatenate([self.at, place])[order], np.concatenate([self.size, sizes])[order]


def _differ(data: np.ndarray, start: np.ndarray, size: np.ndarray, others: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which stretches of ``data`` aren't the stretches of ``others``."""
    out = size != sizes
    same = np.where(out, 0, size)
    unlike = np.concatenate([[0], np.cumsum(data[spread(start, same)] != others[spread(at, same)])])
    ends = np.cumsum(same)
    return out | (unlike[ends] > unlike[ends - same])


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row, alone)`` of the pieces. Pieces that might join their neighbours in a longer text are encoded alone."""
    n = len(data)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    white = space[data]
    wide = np.zeros(n + 1, bool)  # the byte before may end a white space character beyond ASCII
    wide[2:] = data[:-1] == 0xC2
    wide[3:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
    begins = np.zeros(n + 1, bool)
    begins[1:n] = white[1:] & ~white[:-1] & ~wide[1:n]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[full] = True
    start = np.flatnonzero(begins[:n])
    end = np.append(start[1:], n) if len(start) else start
    row = np.searchsorted(offsets, start, "right") - 1
    alone = ~white[start] | white[end - 1] | wide[end]
    return start, end, row, alone
