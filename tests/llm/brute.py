"""Slow answers on driver rows, written from the rules alone."""

import re
from collections import defaultdict

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text, pattern=SPACE):
    return re.findall(pattern, text or "")


def without_repeats(docs: list[tuple], k: int = 20) -> dict:
    """``{id: (n_words, n_removed, kept)}`` of ``(id, text)``."""
    first = {}
    split = {i: words(t) for i, t in docs}
    for i in sorted(split):
        for s in range(len(split[i]) - k + 1):
            first.setdefault(tuple(split[i][s : s + k]), (i, s))
    out = {}
    for i, w in split.items():
        gone = {p for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < (i, s) for p in range(s, s + k)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def line_key(line: str) -> str:
    return lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def without_lines(docs: list[tuple], min_chars: int = 20, min_docs: int = 3) -> dict:
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(i)
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        bad = lambda x: len(line_key(x)) >= min_chars and len(holders[line_key(x)]) >= min_docs and max(holders[line_key(x)]) != i
        out[i] = (len(every), sum(map(bad, every)), "\n".join(x for x in every if not bad(x)))
    return out


def contamination(docs: list[tuple], items: list[tuple], k: int = 13) -> dict:
    """``{id: (n_words, n_hit, items)}``."""
    windows = defaultdict(set)
    for item, t in items:
        w = words(lower(t or ""), ALNUM)
        n = min(k, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(item))
    out = {}
    for i, t in docs:
        w, hit, found = words(lower(t or ""), ALNUM), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    found |= windows[tuple(w[s : s + n])]
                    hit |= set(range(s, s + n))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def shingle_set(text, k: int = 5) -> frozenset:
    w = words(lower(text or ""))
    n = min(k, len(w))
    return frozenset(tuple(w[s : s + n]) for s in range(len(w) - n + 1)) if n else frozenset()


def groups(ids, linked) -> dict:
    """``{id: (n_links, component)}`` of a symmetric relation."""
    ids = sorted(ids)
    near = {a: [b for b in ids if b != a and linked(a, b)] for a in ids}
    out = {}
    for a in ids:
        seen, front = {a}, [a]
        while front:
            for b in near[front.pop()]:
                if b not in seen:
                    seen.add(b)
                    front.append(b)
        out[a] = (len(near[a]), min(seen))
    return out


def jaccard_groups(docs: list[tuple], least: float = 0.8) -> dict:
    sets = {i: shingle_set(t) for i, t in docs}
    return groups(sets, lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9)
