"""Embedding near-dedup by Euclidean p-stable hashing.

For unit vectors a cosine of at least ``cosine`` is a distance of at most
``sqrt(2 - 2 cosine)``. A hash is ``floor((a . v + b) / width)`` with normal ``a``;
a table's bucket is ``K`` such hashes together. The number of tables follows from the
recall asked for at the threshold itself. Width, ``K`` and with them the number of
unrelated vectors that share a bucket are those of least estimated cost: a row for
every vector and table, and a product for every two vectors of a bucket. In a bucket
all pairs are compared by their exact cosine in double precision, in blocks, so a
bucket of any size is many tasks' work. A link found in several tables counts in the
first of them.

A vector's row is an id with a vector. Different vectors of one id, or without an id,
are rows of their own; rows that repeat both are one. Equal vectors are folded first.
Vectors of each length are hashed on their own, and link only with their like. Null,
empty and zero vectors, and vectors that hold null or non-finite components, link with
nothing. A null id is the smallest id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, mix
from .blocks import compared, in_units
from .components import components
from .tables import as_key, stored
from .whitening import by_length

COSINE = 0.9
RECALL = 0.999
WIDTHS = (1.0, 1.5, 2.0, 3.0, 4.0)
MATES = (8, 32, 128, 256, 512, 1024)  # unrelated vectors in a bucket that are tried
ROW_COST = 20_000  # of a vector's row in a table, in multiplications
BLOCK = 1024


def collision(distance: float, width: float) -> float:
    """Chance that one hash is equal for two points at this distance."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


@dataclass(frozen=True)
class Plan:
    hashes: int
    tables: int
    width: float


def plan(n: int, cosine: float, recall: float, dim: int) -> Plan:
    """Hashes of a table, tables and width for ``n`` vectors of a length."""
    best = None
    for width in WIDTHS:
        near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
        for mates in MATES:
            k = max(1, math.ceil(math.log(max(2.0, n / mates)) / -math.log(far)))
            tables = math.ceil(math.log(1 - recall) / math.log(1 - near**k))
            cost = tables * (ROW_COST + dim * k + dim * max(1.0, n * far**k))
            if best is None or cost < best[0]:
                best = cost, Plan(k, tables, width)
    return best[1]


class Tables:
    """The projections of all tables; made anew from the seed wherever they are needed."""

    def __init__(self, dim: int, of: Plan, seed: int = 11):
        tables, hashes, width = of.tables, of.hashes, of.width
        random = np.random.default_rng(seed)
        self.a = random.normal(0, 1, (dim, tables * hashes)) / width
        self.b = random.random(tables * hashes)
        self.shape = (tables, hashes)

    def buckets(self, unit: np.ndarray, tables: int | None = None) -> np.ndarray:
        """``(n, tables)`` bucket keys, of the first ``tables`` only if given."""
        tables = tables or self.shape[0]
        wide = tables * self.shape[1]
        cells = np.floor(unit @ self.a[:, :wide] + self.b[:wide]).astype(np.int64).view(U64).reshape(len(unit), tables, self.shape[1])
        key = np.broadcast_to(mix(np.arange(1, tables + 1, dtype=U64)), cells.shape[:2])
        for i in range(self.shape[1]):
            key = mix(key ^ cells[:, :, i]) + U64(i)
        return key


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows or vanishes; exact but for the tiniest entries."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, columns: list[str] | None = None) -> DataFrame:
    """``(row, key, n_links, component, first)`` per input row: links at ``cosine`` or above, smallest id reachable by links.

    ``row`` holds ``columns``, all by default. One vector of a component is its ``first``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in columns or vectors.columns]).alias("row")
    given = vectors.select(row, as_key(f"`{id_col}`").alias("key"), F.col(f"`{vector_col}`").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    digest = F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)  # + 0: minus zero is zero
    ids = given.filter(sound).select("key", digest.alias("digest"), "v")
    ids = stored(ids.groupBy("key", "digest").agg(F.any_value("v").alias("v")), "vectors")
    head = F.min("key").alias("key")
    classes = ids.groupBy("digest").agg(head, F.count("*").alias("copies"), F.any_value("v").alias("v"))
    numbered = F.monotonically_increasing_id().alias("node")  # written once, so it stays
    heads = stored(classes.select(numbered, "digest", "key", "copies", "v"), "heads")
    counts = heads.groupBy(F.size("v").alias("dim")).count().collect()  # one row per vector length
    plans = {r["dim"]: plan(r["count"], cosine, recall, r["dim"]) for r in counts if r["count"] > 1}
    placed = stored(heads.select("node", "v").mapInArrow(_place(plans), "node long, nth int, bucket long"), "placed")
    sizes = stored(placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    shared = stored(placed.join(sizes, "bucket"), "shared")
    rows = _dealt(shared, heads.select("node", "copies", "v"))
    found = stored(compared(rows, _compare(plans, cosine), "node", "copies"), "found")
    direct = found.filter("partner IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("partner IS NOT NULL").select(F.col("node").alias("a"), F.col("partner").alias("b")))
    linked = stored(joined.join(heads.select(F.col("node").alias("id"), "key", "digest"), "id"), "linked")
    tops = stored(linked.groupBy("component").agg(F.min(F.struct("key", "digest")).alias("top")), "tops")
    links = linked.join(tops, "component").select(F.col("id").alias("node"), "top").join(direct, "node", "left")
    groups = heads.select("node", "digest", "key", "copies").join(links, "node", "left").select(
        "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("top", F.struct("key", "digest")).alias("top")
    )
    answers = given.filter(sound).select("row", "key", digest.alias("digest")).join(stored(groups, "groups"), "digest")
    first = (F.col("key") == F.col("top.key")) & (F.col("digest") == F.col("top.digest"))
    told = answers.select("row", "key", "n_links", F.col("top.key").alias("component"), first.alias("first"))
    alone = given.filter(~sound).select("row", "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"), F.lit(True).alias("first"))
    return told.unionByName(alone)


def _place(plans: dict[int, Plan]):
    """Bucket of every vector in every table of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            nodes = np.asarray(batch.column("node"))
            for dim, at, v in by_length(batch.column("v")):
                if dim not in plans:
                    continue
                of = made.setdefault(dim, Tables(dim, plans[dim]))
                tables = plans[dim].tables
                for i in range(0, len(at), 2048):
                    keys = mix(of.buckets(unit(v[i : i + 2048].astype(float))) + U64(dim))
                    own = np.repeat(nodes[at[i : i + 2048]], tables)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(keys))), pa.array(keys.ravel().view(np.int64))], names=["node", "nth", "bucket"])

    return run


def _compare(plans: dict[int, Plan], cosine: float):
    def compare(rows: pa.Table):
        lists = rows.column("v").combine_chunks()
        values, starts = np.asarray(lists.flatten()).astype(float), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        nths = np.asarray(rows.column("nth").combine_chunks())
        made: dict[int, Tables] = {}

        def links_of(own: np.ndarray) -> np.ndarray:
            dim = int(starts[own[0] + 1] - starts[own[0]])
            if (starts[own + 1] - starts[own] != dim).any():  # buckets of two lengths that share a hash by chance
                lengths = starts[own + 1] - starts[own]
                linked = np.zeros((len(own), len(own)), bool)
                for each in np.unique(lengths):
                    some = np.flatnonzero(lengths == each)
                    linked[np.ix_(some, some)] = links_of(own[some])
                return linked
            v, nth = scaled(values[starts[own][:, None] + np.arange(dim)]), int(nths[own[0]])
            length = np.sqrt((v * v).sum(axis=1))
            linked = (v @ v.T) / (length[:, None] * length[None, :]) >= cosine
            np.fill_diagonal(linked, False)
            some = np.flatnonzero(linked.any(axis=1))
            if len(some) and nth:  # links of an earlier table were counted there
                if dim not in made:
                    made[dim] = Tables(dim, plans[dim])
                keys = made[dim].buckets(unit(v[some]), nth)
                fresh = linked[np.ix_(some, some)]
                for t in range(nth):
                    fresh &= keys[:, t][:, None] != keys[:, t][None, :]
                linked[np.ix_(some, some)] = fresh
            return linked

        return links_of

    return compare


def _dealt(shared: DataFrame, heads: DataFrame) -> DataFrame:
    dealt = in_units(shared.withColumn("one", F.lit(1)), "bucket", "size", "node", BLOCK, "one", 20_000)
    return dealt.drop("one").join(heads, "node")


def keep_one(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """The rows of the first vector of each component, that with the smallest id."""
    return near_vectors(vectors, id_col, **options).filter("first").select("row.*")
