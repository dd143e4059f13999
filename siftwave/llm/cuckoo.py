"""Cuckoo filter over numpy arrays: a set of keys that may be asked, grown and shrunk.

A key has a fingerprint of 16 bits and two buckets of four slots; each bucket
follows from the other and the fingerprint, so that a fingerprint can move without
its key. A key that was inserted is always found; another is found by chance with
about 8 / 65536. Deleting is right for keys that were inserted, once each.
"""

from __future__ import annotations

import numpy as np

from .arrays import U64, mix

SLOTS = 4
LOAD = 0.75
KICKS = 500


class CuckooFull(Exception):
    """No free slot within reach."""


def split_digest(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket hash and fingerprint (never 0) of digests of 16 bytes given as ``(n, 2)`` numbers."""
    return digest[:, 0], (digest[:, 1] % U64(65535) + U64(1)).astype(np.uint16)


class Cuckoo:
    def __init__(self, keys: int = 0, slots: bytes | None = None):
        if slots is not None:
            self.slots = np.frombuffer(slots, "<u2").reshape(-1, SLOTS).copy()
        else:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys / (SLOTS * LOAD))))))
            self.slots = np.zeros((buckets, SLOTS), "<u2")

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _first(self, h: np.ndarray) -> np.ndarray:
        return (h & U64(len(self.slots) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(fingerprint.astype(U64)) & U64(len(self.slots) - 1)).astype(np.int64)

    def contains(self, digest: np.ndarray) -> np.ndarray:
        h, fingerprint = split_digest(digest)
        a = self._first(h)
        b = self._other(a, fingerprint)
        return ((self.slots[a] == fingerprint[:, None]) | (self.slots[b] == fingerprint[:, None])).any(axis=1)

    def insert(self, digest: np.ndarray) -> None:
        """Adds keys that aren't in yet. Raises CuckooFull, with the filter unusable, if they don't fit."""
        h, fingerprint = split_digest(digest)
        bucket = self._first(h)
        for _ in range(4):  # all at once into free slots of either bucket, then one by one
            order = np.argsort(bucket, kind="stable")
            bucket, fingerprint = bucket[order], fingerprint[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            free = np.argsort(self.slots[bucket] != 0, axis=1, kind="stable")  # free slots first
            fits = rank < (self.slots[bucket] == 0).sum(axis=1)
            self.slots[bucket[fits], free[fits, rank[fits]]] = fingerprint[fits]
            bucket, fingerprint = self._other(bucket[~fits], fingerprint[~fits]), fingerprint[~fits]
            if not len(bucket):
                return
        for b, f in zip(bucket.tolist(), fingerprint.tolist()):
            self._push(b, f)

    def _push(self, b: int, f: int) -> None:
        for kick in range(KICKS):
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = f
                return
            slot = (kick + f) % SLOTS
            f, self.slots[b, slot] = int(self.slots[b, slot]), f
            b = int(self._other(np.array([b]), np.array([f], np.uint16))[0])
        raise CuckooFull

    def delete(self, digest: np.ndarray) -> None:
        h, fingerprint = split_digest(digest)
        a = self._first(h)
        b = self._other(a, fingerprint)
        for x, y, f in zip(a.tolist(), b.tolist(), fingerprint.tolist()):
            for bucket in (x, y):
                hit = np.flatnonzero(self.slots[bucket] == f)
                if len(hit):
                    self.slots[bucket, hit[0]] = 0
                    break


def filled(digest: np.ndarray) -> Cuckoo:
    """A filter with these distinct keys, of the least size that holds them."""
    size = len(digest)
    while True:
        new = Cuckoo(size)
        try:
            new.insert(digest)
            return new
        except CuckooFull:
            size = size * 2 + 1
