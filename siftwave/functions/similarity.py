"""Tokens, shingles and set measures as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import beyond_latin, is_ascii, let, nfc


def tokens(c: Column) -> Column:
    """Placeholders as they are, other letter and digit runs in lower case."""

    def found(x: Column) -> Column:
        runs = F.regexp_extract_all(nfc(x), F.lit(fv.TOKEN), F.lit(1))
        return F.transform(runs, lambda t: F.when(t.startswith("<"), t).otherwise(F.lower(t)))

    def plain(x: Column, token: str) -> Column:
        return F.regexp_extract_all(F.lower(x), F.lit(token), F.lit(0))

    # Latin text without placeholders needs neither NFC nor the classes of Unicode; only the dotted capital I becomes two characters
    return let(c, lambda x: F.when(is_ascii(x) & ~x.contains("<"), plain(x, "[a-z0-9]+")).when(
        ~x.contains("<") & ~x.contains("\u0130") & ~beyond_latin(x), plain(x, r"[\p{L}0-9]+")
    ).otherwise(found(x)))


def shingles(c: Column) -> Column:
    """Distinct word trigrams; shorter texts give one shingle, empty ones none."""
    k = fv.SHINGLE_SIZE

    def build(words: Column) -> Column:
        n = F.size(words)
        windows = F.transform(
            F.sequence(F.lit(1), n - (k - 1)),
            lambda i: F.concat(*[part for j in range(k) for part in (F.lit(" "), F.element_at(words, i + j))][1:]),
        )
        return (
            F.when(n >= k, F.array_distinct(windows))
            .when(n > 0, F.array(F.array_join(words, " ")))
            .otherwise(F.array().cast("array<string>"))
        )

    return let(tokens(c), build)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two shingle arrays; two empty sets have none."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def coverage(template: Column, message: Column) -> Column:
    """Share of the template's shingles found in the message."""
    size = F.size(template)
    return F.when(size > 0, F.size(F.array_intersect(template, message)) / size).otherwise(F.lit(0.0))


def fingerprint(c: Column) -> Column:
    """Sorted distinct short hashes of the shingles."""
    return fingerprint_of(shingles(c))


def fingerprint_of(shingle_array: Column) -> Column:
    short = F.transform(shingle_array, lambda s: F.substring(F.sha2(s, 256), 1, fv.FINGERPRINT_HEX))
    return F.sort_array(F.array_distinct(short))
