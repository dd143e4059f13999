"""Comparing the rows of groups of any size, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINKS = "node long, partner long, links long"


def in_units(rows: DataFrame, group: str, size: str, node: str, block: int, weight: str, shard_weight: float) -> DataFrame:
    """Rows dealt to ``(shard, unit, block, low, high)``.

    A group of ``size`` rows is cut into blocks of about ``block`` rows by a hash of
    the node, and every pair of blocks is a unit, so no group meets in one task. A
    shard gathers many units, to about ``shard_weight`` of the rows' ``weight``.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(node, F.lit(3)), blocks).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with")).drop("with")
    total = rows.agg(F.coalesce(F.sum(F.col(weight) * blocks), F.lit(0))).first()[0]
    shards = max(1, int(total / shard_weight) + 1)
    unit = F.xxhash64(group, "low", "high")
    return dealt.withColumn("unit", unit).withColumn("shard", F.pmod("unit", F.lit(shards)))


Compare = Callable[[pa.Table], Callable[[np.ndarray], np.ndarray]]  # rows of a shard -> numbers of a unit's rows -> square matrix of links


def compared(dealt: DataFrame, compare: Compare, node: str, count: str | None = None) -> DataFrame:
    """``(node, partner, links)``: what ``compare`` finds in all units of ``in_units`` rows.

    Rows with a null ``partner`` add ``links``, the summed ``count`` of the linked
    rows, to a node. The others are edges of a spanning forest of the unit's links,
    so a group where all are linked gives two rows a member, not all pairs.
    """

    def run(rows: pa.Table) -> pa.Table:
        unit = np.asarray(rows.column("unit").combine_chunks())
        order = np.argsort(unit, kind="stable")
        ends = np.append(np.flatnonzero(unit[order][1:] != unit[order][:-1]) + 1, len(order))
        block, low, high, ids = (np.asarray(rows.column(c).combine_chunks()) for c in ("block", "low", "high", node))
        weights = np.asarray(rows.column(count).combine_chunks()) if count else np.ones(len(ids), np.int64)
        nodes, partners, links = [], [], []
        links_of, begin = compare(rows), 0
        for end in ends:
            own, begin = order[begin:end], end
            if len(own) < 2:
                continue
            linked = links_of(own)
            if low[own[0]] != high[own[0]]:  # two blocks: only what lies between them
                side = block[own] == low[own[0]]
                linked &= side[:, None] != side[None, :]
            np.fill_diagonal(linked, False)
            linked &= ids[own][:, None] != ids[own][None, :]
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            inner = linked[np.ix_(some, some)]
            names = ids[own[some]]
            nodes.append(names)
            partners.append(np.full(len(names), -1))
            links.append(inner @ weights[own[some]])
            for a, b in spanning(inner):
                nodes.append(names[a : a + 1])
                partners.append(names[b : b + 1])
                links.append(np.zeros(1, np.int64))
        cat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        partner, added = cat(partners), cat(links)
        return pa.table({"node": pa.array(cat(nodes)), "partner": pa.array(partner, mask=added > 0), "links": pa.array(added)})

    return dealt.groupBy("shard").applyInArrow(run, LINKS)


def spanning(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    n = len(linked)
    unseen = np.ones(n, bool)
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root] = False
        front = [root]
        while front:
            a = front.pop()
            near = np.flatnonzero(linked[a] & unseen)
            unseen[near] = False
            for b in near.tolist():
                yield a, b
            front += near.tolist()
