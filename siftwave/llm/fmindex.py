"""FM-index over a delimited vocabulary, and search schemes with one error.

The text is all words, each followed by a delimiter that sorts first; suffixes end at
their delimiter and equal ones stand in the order of their words. ``keys`` holds
``character * N + row`` of the Burrows-Wheeler column, sorted, so the step from the
rows of ``X`` to those of ``cX`` is one binary search for each end.

A search starts at the delimiter rows, so it only ever grows in one direction: to the
left in the index of the words, to the right in that of the reversed words. With the
first ``exact`` characters read without error and one error in the rest, the two
indexes together find every word that differs in one place, since one error leaves
one half as it is. All patterns of a call advance together.
"""

from __future__ import annotations

import numpy as np

from .arrays import spread


class FmIndex:
    """Index of words given as code numbers above zero, ``codes[starts[i]:starts[i + 1]]`` each."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        lengths = np.diff(starts)
        words = len(lengths)
        n = len(codes) + words
        ends = starts[1:] + np.arange(words)  # of the delimiters in the text
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = codes
        end = np.repeat(ends, lengths + 1)
        suffixes = _sorted_suffixes(text, end, int(lengths.max(initial=0)))
        bwt = text[suffixes - 1]
        self.n, self.words, self.bwt = n, words, bwt
        self.keys = np.sort(bwt * n + np.arange(n))
        self.letters = np.unique(codes)
        first = np.full(n, -1, np.int64)
        first[ends - lengths] = np.arange(words)
        heads = first[suffixes]
        self.heads = heads[heads >= 0]  # words by the row of their first character
        self.before = np.concatenate([[0], np.cumsum(heads >= 0)])  # heads above each row

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``letter + X`` from the rows of ``X``."""
        base = letter * self.n
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(state, letter, low, high)`` of all letters that can stand before the rows of each state."""
        few = high - low <= 2 * len(self.letters)
        some = np.flatnonzero(few)
        size = high[some] - low[some]
        letters = self.bwt[spread(low[some], size)]
        pair = np.unique(np.repeat(some, size) * (int(self.letters[-1]) + 1 if len(self.letters) else 1) + letters)
        base = int(self.letters[-1]) + 1 if len(self.letters) else 1
        wide = np.flatnonzero(~few)
        state = np.concatenate([pair // base, np.repeat(wide, len(self.letters))])
        letter = np.concatenate([pair % base, np.tile(self.letters, len(wide))])
        real = letter > 0
        state, letter = state[real], letter[real]
        a, b = self.step(letter, low[state], high[state])
        there = a < b
        return state[there], letter[there], a[there], b[there]

    def one_error(self, codes: np.ndarray, starts: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(pattern, word)`` pairs that differ by one inserted, deleted or replaced character behind the first ``exact``.

        Patterns are read in the order of their codes, beginning at the delimiter.
        """
        length = np.diff(starts)
        states = np.arange(len(length))  # patterns still without an error
        low, high = np.zeros(len(states), np.int64), np.full(len(states), self.words, np.int64)
        none = np.zeros(0, np.int64)
        late = (none, none, none)  # one error made: (pattern, low, high), as many characters read as the loop says
        found = [(none, none)]
        for at in range(int(length.max(initial=-1)) + 1):
            free = np.flatnonzero(exact[states] <= at)
            state, letter, a, b = self.branches(low[free], high[free])
            of = states[free[state]]
            late = tuple(np.concatenate([x, y]) for x, y in zip(late, (of, a, b)))  # inserted before this character
            whole = length[late[0]] == at
            found.append((late[0][whole], self._heads(late[1][whole], late[2][whole])))
            late = tuple(x[~whole] for x in late)
            a1, b1 = self.step(codes[starts[late[0]] + at], late[1], late[2])
            more = length[of] > at
            other = np.flatnonzero(more)[letter[more] != codes[starts[of[more]] + at]]
            gone = free[length[states[free]] > at]  # this character isn't in the word
            late = tuple(np.concatenate(x) for x in ((late[0], of[other], states[gone]), (a1, a[other], low[gone]), (b1, b[other], high[gone])))
            alive = late[1] < late[2]
            late = tuple(x[alive] for x in late)
            on = length[states] > at
            states, low, high = states[on], low[on], high[on]
            low, high = self.step(codes[starts[states] + at], low, high)
            on = low < high
            states, low, high = states[on], low[on], high[on]
            if not len(states) and not len(late[0]):
                break
        pattern = np.concatenate([np.repeat(p, h[:, 1] - h[:, 0]) if len(p) else none for p, h in found])
        word = np.concatenate([self.heads[spread(h[:, 0], h[:, 1] - h[:, 0])] if len(p) else none for p, h in found])
        pair = np.unique(pattern * max(1, self.words) + word)
        return pair // max(1, self.words), pair % max(1, self.words)

    def _heads(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Stretches of ``heads`` in the rows: the words that begin there."""
        return np.stack([self.before[low], self.before[high]], axis=1)


def _sorted_suffixes(text: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Places of all suffixes in order; each ends at its delimiter, ``end``; equal ones keep their order."""
    n = len(text)
    place = np.arange(n)
    rank, step = text.copy(), 1
    while step <= longest:
        behind = place + step
        second = np.where(behind < end, rank[np.minimum(behind, n - 1)], 0)  # a delimiter has rank 0
        both = rank * (int(rank.max(initial=0)) + 1) + second
        _, rank = np.unique(both, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable")
