"""Join helpers: size-checked broadcast, salting, domain-or-parent lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import suffixes
from ..session import cut

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
SALTS = 32


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the table has at most ``max_rows`` rows and ``max_bytes`` bytes; the probe stops at the rows."""
    size = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(f"`{name}`"), F.lit(0))
        elif kind in ("array<bigint>", "array<int>", "array<double>"):
            size = size + 8 * F.greatest(F.size(f"`{name}`"), F.lit(0))
        elif kind.startswith("array"):
            size = size + F.coalesce(F.octet_length(F.to_json(f"`{name}`")), F.lit(0))
    rows = df.select(size.alias("size")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return rows["n"] <= max_rows and rows["size"] <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table with a lookup table that has few rows per key.

    Up to ``max_rows`` lookup rows are broadcast. Beyond that both sides are
    shuffled with a salt: a key that holds a third of the left rows is spread
    over ``salts`` tasks, and the lookup rows are repeated once per salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how} cannot repeat the right side")
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), keys, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(left)]), F.lit(salts)))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def join_groups(left: DataFrame, groups: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join rows with an aggregate of themselves, ``count`` being the rows per group.

    The aggregate is written first. The join then reads two plain shuffles, whose
    partitions Spark splits at run time where a group is hot, whatever the number of
    such groups.
    """
    return left.join(cut(groups), keys, how)


def _hashable(df: DataFrame) -> list[str]:
    """Columns that can be hashed for a salt."""
    return [name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def domain_set(domains: DataFrame, column: str = "domain") -> DataFrame:
    """Distinct clean domains of a list table; empty rows are dropped."""
    clean = F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))
    return domains.select(clean.alias("domain")).filter(F.col("domain") != "").distinct()


def suffix_join(
    df: DataFrame,
    host: str,
    domains: DataFrame,
    key: list[str],
    include_tld: bool = False,
    how: str = "left_semi",
) -> DataFrame:
    """Rows whose host, or a parent of it, is listed (``left_semi``) or is not (``left_anti``).

    The theta condition becomes an equi-join on exploded parents. Only the key
    columns take part in it, so no wide row is repeated.
    """
    if how not in ("left_semi", "left_anti"):
        raise ValueError("suffix_join filters rows: left_semi or left_anti")
    hit = listed_keys(df.select(*key, F.col(host).alias("_host")), "_host", domains, key, include_tld)
    return df.join(hit, key, how)


def listed_keys(
    df: DataFrame, host: str, domains: DataFrame, key: list[str], include_tld: bool = False
) -> DataFrame:
    """Distinct keys of the rows whose host or parent is in the domain list."""
    exploded = df.select(*key, F.explode(suffixes(F.col(host), include_tld)).alias("_parent"))
    listed = domain_set(domains).withColumnRenamed("domain", "_parent")
    return lookup_join(exploded, listed, ["_parent"], "left_semi").select(*key).distinct()


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order.

    ``min_by`` merges inside each task before the shuffle, so a key that holds a
    third of all rows sends one row per task, not all of them.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
