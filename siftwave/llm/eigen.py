"""Spectra of symmetric matrices that grow by rank-one terms.

``Q diag(d) Q' + w v v'`` has the eigenvalues that solve the secular equation

    1 / w + sum of z_j^2 / (d_j - x) = 0,   z = Q'v

one between any two neighbouring ``d`` and one above the last. Entries of ``z`` that
are zero, and all but one of a group of equal ``d``, are deflated: their pairs stay
as they are. The eigenvectors come from the ``z`` for which the computed roots are
exact, so they stay orthogonal even where roots lie close to each other.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
STEPS = 60


def roots(d: np.ndarray, z2: np.ndarray, w: float) -> tuple[np.ndarray, np.ndarray]:
    """``(roots, gaps)`` with ``gaps[i, j] = roots[i] - d[j]``; ``d`` ascends strictly and no ``z2`` is zero."""
    k = len(d)
    top = d[-1] + w * z2.sum()
    upper = np.append(d[1:], top)
    width = upper - d
    # the half of the gap that holds a root gives its origin, so that the distance to the near pole keeps all digits
    middle = d + width / 2
    at_middle = 1 / w + (z2 / (d - middle[:, None])).sum(axis=1)
    right = at_middle < 0
    right[-1] = False
    origin = np.where(right, upper, d)
    delta = d - origin[:, None]
    low = np.where(right, -width / 2, np.where(at_middle < 0, width / 2, 0.0))
    high = np.where(right, 0.0, np.where(at_middle < 0, width, width / 2))
    left_pole, right_pole = np.where(right, -width, 0.0), np.where(right, 0.0, width)
    t = (low + high) / 2
    below = np.tri(k)
    for _ in range(STEPS):
        near = 1 / (delta - t[:, None])
        square = near * near
        total = near @ z2
        f = 1 / w + total
        size = 1 / w + total - 2 * ((near * below) @ z2)  # sum of the terms' sizes: those up to the root are negative
        done = np.abs(f) <= 4 * EPS * size
        if done.all():
            break
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        a, b = left_pole - t, right_pole - t
        steep = square @ z2
        before = (square * below) @ z2
        c = f - a * before - b * (steep - before)
        p = (a + b) * f - a * b * steep
        q = a * b * f
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step[-1] = a[-1] + a[-1] ** 2 * steep[-1] / c[-1]  # no pole above the last root
        new = t + step
        inside = (new > low) & (new < high)
        new = np.where(done | (new == t), t, np.where(inside, new, (low + high) / 2))
        if (new == t).all():
            break
        t = new
    return origin + t, t[:, None] - delta


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, w: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors (columns) of ``q diag(d) q' + w v v'`` for ``w > 0``; ``d`` ascends."""
    z = v @ q
    size = float(z @ z)
    if size * w == 0 or not np.isfinite(size):
        return d, q
    q = q.copy()
    small = 8 * EPS * max(abs(d[0]), abs(d[-1]), w * size)
    ends = np.append(np.flatnonzero(np.diff(d) > small), len(d) - 1)
    begin = 0
    for end in ends:
        if end > begin and np.any(z[begin : end + 1]):  # equal values: turn the basis so that one of them takes all of z
            part = z[begin : end + 1].copy()
            length = np.sqrt(part @ part)
            mirror = part.copy()
            mirror[-1] += length if part[-1] >= 0 else -length
            mirror /= np.sqrt(mirror @ mirror)
            q[:, begin : end + 1] -= 2 * np.outer(q[:, begin : end + 1] @ mirror, mirror)
            z[begin : end + 1] = 0
            z[end] = -length if part[-1] >= 0 else length
        begin = end + 1
    live = np.flatnonzero(w * np.sqrt(size) * np.abs(z) > small)
    if not len(live):
        return d, q
    own, pull = d[live], z[live]
    values, gaps = roots(own, pull * pull, w)
    k = len(live)
    # the weights for which these roots are exact
    poles = own[:, None] - own[None, :]
    divisor = np.ones((k, k))
    upper = np.tri(k, k, -1, bool).T  # i < j
    divisor[upper] = poles[upper]
    lower = np.tri(k, k, 0, bool)
    lower[-1] = False
    divisor[:-1][lower[:-1]] = poles[1:][lower[:-1]]
    exact = np.sqrt(np.abs(np.prod(gaps / divisor, axis=0)))
    turn = np.where(pull < 0, -exact, exact) / gaps  # row i: eigenvector of root i
    turn /= np.sqrt((turn * turn).sum(axis=1, keepdims=True))
    d = d.copy()
    d[live] = values
    q[:, live] = q[:, live] @ turn.T
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Mean and scatter matrix of vectors seen so far, the latter as eigenvalues and eigenvectors."""

    def __init__(self, dim: int, n: int = 0, mean: np.ndarray | None = None, d: np.ndarray | None = None, q: np.ndarray | None = None):
        self.n = n
        self.mean = np.zeros(dim) if mean is None else mean
        self.d = np.zeros(dim) if d is None else d
        self.q = np.eye(dim) if q is None else q

    def add(self, vectors: np.ndarray) -> None:
        for x in vectors:
            if self.n:
                away = x - self.mean
                self.d, self.q = rank_one(self.d, self.q, away, self.n / (self.n + 1))
                self.mean = self.mean + away / (self.n + 1)
            else:
                self.mean = x.astype(float)
            self.n += 1

    def merge(self, other: Spectrum) -> None:
        """Adds the other one's scatter by one update per eigenpair, and one for the distance of the means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.d, self.q = other.n, other.mean, other.d, other.q
            return
        for value, vector in zip(other.d, other.q.T):
            if value > 0:
                self.d, self.q = rank_one(self.d, self.q, vector, float(value))
        both = self.n + other.n
        away = other.mean - self.mean
        self.d, self.q = rank_one(self.d, self.q, away, self.n * other.n / both)
        self.mean = self.mean + away * (other.n / both)
        self.n = both
