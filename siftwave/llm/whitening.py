"""Embedding whitening by incremental eigendecomposition.

Each partition keeps mean, eigenvalues and eigenvectors of the vectors it has seen
and turns every further vector into a centred rank-one update (secular equation with
deflation, see ``eigen``). Spectra of partitions are combined, some at a time, by one
update per eigenpair. One more pass projects the centred vectors on the combined
eigenvectors; the small projected matrix gives the final pairs (Rayleigh-Ritz), so
their error doesn't depend on how rows were dealt. A last pass measures how far the
covariance of the whitened vectors is from the identity.

Entries are quantised first: ``x = floor(scale * c) + shift`` as long. The fit counts
each distinct ``x`` once, so copies of a vector, however many, change nothing; they
fold before the shuffle. Vectors of one length are fitted on their own, so each
length has its own ``n``, sums and components. Rows whose vector is null or empty, or
holds an entry that is null, not finite or too large for a long, are dropped. A
component without variance (``n`` of 1, or fewer distinct vectors than entries) can't
be scaled and isn't given. Rows that repeat an id each get their answer; ids aren't
looked at. An empty table gives an empty result.

Memory: a spectrum is a square matrix of the vector length, some of which a task
holds. Matrices go to the tasks with their code, up to ``MODEL_BYTES`` of them for
one pass; more vector lengths are served in several passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eigen import EPS, Spectrum
from .tables import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
ROWS = 4096  # distinct vectors of a task's share of the fit
FAN = 8  # partial results that are combined at once
MODEL_BYTES = 64 << 20
LARGE = float(2**56)
SAFE = float(2**62)

SPECTRUM = "dim int, n long, sums array<decimal(38,0)>, mean array<double>, d array<double>, q array<double>"
MATRIX = "dim int, h array<double>"


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums of a long matrix, as Python numbers where a long could overflow."""
    if len(x) * float(np.abs(x.astype(float)).max(initial=0)) < SAFE:
        return x.sum(axis=0)
    return x.astype(object).sum(axis=0)


def away(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - sums``, exact: long where that is safe, else Python numbers."""
    if n * float(np.abs(x.astype(float)).max(initial=0)) < SAFE and all(abs(int(s)) < SAFE for s in sums):
        return n * x - np.array([int(s) for s in sums], np.int64)
    return n * x.astype(object) - np.array([int(s) for s in sums], object)


def deviations(y: np.ndarray) -> list[int]:
    """Exact sums of squares of each row."""
    if y.dtype != object and y.shape[1] * float(np.abs(y).max(initial=0)) ** 2 < SAFE:
        return (y * y).sum(axis=1).tolist()
    y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, matrix)`` for each length of the lists in a column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        part = column if len(rows) == len(lengths) else column.take(pa.array(rows))
        yield int(dim), rows, np.asarray(part.flatten()).reshape(len(rows), int(dim))


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[Spectrum, np.ndarray]] = {}
    for batch in batches:
        for dim, _, x in by_length(batch.column("x")):
            if dim not in held and sum(8 * k * k for k in [*held, dim]) > MODEL_BYTES:
                yield from map(_spectrum_row, held.values())
                held = {}
            spectrum, sums = held.get(dim) or (Spectrum(dim), np.zeros(dim, object))
            spectrum.add(x)
            held[dim] = spectrum, sums + exact_sums(x)
    yield from map(_spectrum_row, held.values())


def _spectrum_row(of: tuple[Spectrum, np.ndarray]) -> pa.RecordBatch:
    s, sums = of
    lists = lambda v, kind: pa.array([v], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([len(s.d)], pa.int32()), pa.array([s.n]), lists([int(v) for v in sums], pa.decimal128(38)), *(lists(v, pa.float64()) for v in (s.mean, s.d, s.q.ravel()))],
        names=["dim", "n", "sums", "mean", "d", "q"],
    )


def _spectrum_of(row: dict) -> tuple[Spectrum, np.ndarray]:
    dim = row["dim"]
    return Spectrum(dim, row["n"], np.array(row["mean"]), np.array(row["d"]), np.array(row["q"]).reshape(dim, dim)), np.array([int(v) for v in row["sums"]], object)


def _merged(rows: pa.Table) -> pa.Table:
    every = [_spectrum_of(rows.slice(i, 1).to_pylist()[0]) for i in range(len(rows))]
    every.sort(key=lambda s: (s[0].n, s[0].d.tolist()))  # whatever order the rows came in
    for s, _ in every[1:]:
        every[0][0].merge(s)
    return pa.Table.from_batches([_spectrum_row((every[0][0], sum(sums for _, sums in every)))])


def _summed(rows: pa.Table) -> pa.Table:
    h = np.stack([np.array(v) for v in rows.column("h").to_pylist()])
    return pa.table({"dim": rows.column("dim").slice(0, 1), "h": pa.array([h.sum(axis=0)], pa.list_(pa.float64()))})


def folded(parts: DataFrame, combine: Callable[[pa.Table], pa.Table], schema: str, name: str) -> DataFrame:
    """One row per ``dim``: the rows of ``parts`` combined about ``FAN`` at a time, in rounds whose number is a logarithm."""
    parts = stored(parts, name)
    while True:
        most = parts.groupBy("dim").count().agg(F.max("count")).first()[0] or 1
        if most == 1:
            return parts
        groups = -(-most // FAN)
        dealt = parts.withColumn("part", F.pmod(F.xxhash64(F.struct(*parts.columns)), F.lit(groups)))
        parts = stored(dealt.groupBy("dim", "part").applyInArrow(lambda rows: combine(rows.drop_columns(["part"])), schema), name)


@dataclass
class Model:
    """What whitening needs of one vector length."""

    n: int
    sums: np.ndarray  # exact
    basis: np.ndarray  # components as columns
    values: np.ndarray  # eigenvalues of the components
    total: float  # trace of the covariance
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return away(x, self.n, self.sums).astype(float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.basis / np.sqrt(self.values)


def quantised(vector_col: str, scale: int = SCALE, shift: int = SHIFT):
    """``x`` of a vector column; null where the row is to be dropped."""
    large = lambda c: F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(LARGE)
    sound = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & F.coalesce(large(c), F.lit(False)))
    return F.when(sound & (F.size(vector_col) > 0), F.transform(vector_col, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long") + F.lit(shift)))


def _passes(lengths: list[int]) -> Iterator[list[int]]:
    """Lengths whose matrices together have at most ``MODEL_BYTES``, or a single one."""
    now: list[int] = []
    for dim in lengths:
        if now and sum(8 * k * k for k in [*now, dim]) > MODEL_BYTES:
            yield now
            now = []
        now.append(dim)
    if now:
        yield now


def _products(models: dict[int, Model], of: Callable[[Model, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of ``y'y`` over the rows ``y`` that ``of`` makes of a partition's vectors, one row per length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in by_length(batch.column("x")):
                if dim in models:
                    for i in range(0, len(x), ROWS):
                        y = of(models[dim], x[i : i + ROWS])
                        sums[dim] = sums.get(dim, 0) + y.T @ y
        for dim, h in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([h.ravel()], pa.list_(pa.float64()))], names=["dim", "h"])

    return run


def _matrices(parts: DataFrame) -> dict[int, np.ndarray]:
    """One square matrix per length, fetched."""
    rows = folded(parts, _summed, MATRIX, "products").collect()  # at most MODEL_BYTES
    return {r.dim: np.array(r.h).reshape(int(len(r.h) ** 0.5), -1) for r in rows}


def fitted(fit: DataFrame, lengths: list[int], spectra: DataFrame, components: int) -> dict[int, Model]:
    """Models of some lengths: bases of the combined spectra, refined over all vectors of ``fit(x)``."""
    models = {}
    for row in spectra.filter(F.col("dim").isin(lengths)).collect():  # at most MODEL_BYTES, or one matrix
        spectrum, sums = _spectrum_of(row.asDict())
        models[row.dim] = Model(spectrum.n, sums, np.linalg.qr(spectrum.q)[0], spectrum.d, 0.0)
    rows = fit.filter(F.size("x").isin(lengths))
    projected = _matrices(rows.mapInArrow(_products(models, lambda m, x: m.centred(x) @ m.basis), MATRIX))
    for dim, m in models.items():
        h = projected[dim] / m.n
        values, turn = np.linalg.eigh((h + h.T) / 2)  # one small matrix per length
        order = np.argsort(-values, kind="stable")
        order = order[values[order] > max(0.0, values[order[0]] * 8 * dim * EPS)][:components]
        m.basis, m.values, m.total = m.basis @ turn[:, order], values[order], float(np.trace(h))
    spread = {dim: m for dim, m in models.items() if len(m.values)}
    with_one = lambda m, x: np.concatenate([m.whitened(x), np.ones((len(x), 1))], axis=1)
    for dim, g in _matrices(rows.mapInArrow(_products(spread, with_one), MATRIX)).items():
        mean = g[-1, :-1] / spread[dim].n
        covariance = g[:-1, :-1] / spread[dim].n - np.outer(mean, mean)
        spread[dim].identity_error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return models


ANSWER = "n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def _answers(models: dict[int, Model]) -> Callable[[pa.Array], pa.Array]:
    def run(column: pa.Array) -> pa.Array:
        out: list = [None] * len(column)
        for dim, rows, x in by_length(column):
            m = models[dim]
            for i in range(0, len(x), ROWS):
                y = away(x[i : i + ROWS], m.n, m.sums)
                white = y.astype(float) / m.n @ m.basis / np.sqrt(m.values)
                for at, deviation, w in zip(rows[i : i + ROWS], deviations(y), white.tolist()):
                    out[at] = {"n": m.n, "deviation": deviation if deviation < 10**38 else None, "whitened": w, "explained": (m.values / m.total).tolist() if m.total else [], "identity_error": m.identity_error}
        lists = pa.list_(pa.float64())
        return pa.array(out, pa.struct([("n", pa.int64()), ("deviation", pa.decimal128(38)), ("whitened", lists), ("explained", lists), ("identity_error", pa.float64())]))

    return run


def whiten(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(row, n, deviation, whitened, explained, identity_error)`` of the rows with a sound vector.

    ``deviation`` is the exact sum of ``(n x - sums)^2``, null where it has more than 38 digits; ``whitened`` and ``explained``
    hold one entry per component, by falling eigenvalue.
    """
    given = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"), quantised(f"`{vector_col}`", scale, shift).alias("x")).filter("x IS NOT NULL")
    fit = stored(given.select("x").distinct(), "vectors")
    sizes = fit.groupBy(F.size("x").alias("dim")).count().orderBy("dim").collect()  # one number pair per vector length
    lengths, n = [r["dim"] for r in sizes], sum(r["count"] for r in sizes)
    shares = fit.repartition(max(1, -(-n // ROWS)), F.xxhash64("x"))
    spectra = folded(shares.mapInArrow(_spectra, SPECTRUM), _merged, SPECTRUM, "spectra")
    judged = []
    for some in _passes(lengths):
        models = fitted(fit, some, spectra, components)
        answer = F.arrow_udf(_answers(models), "struct<" + ANSWER.replace(" ", ":").replace(",:", ",") + ">")
        judged.append(given.filter(F.size("x").isin(some)).withColumn("answer", answer("x")).select("row", "answer.*"))
    if not judged:
        nothing = F.from_json(F.lit(None).cast("string"), "struct<" + ANSWER.replace(" ", ":").replace(",:", ",") + ">")
        return given.withColumn("answer", nothing).select("row", "answer.*")
    return reduce(DataFrame.unionByName, judged)


def by_component(judged: DataFrame) -> DataFrame:
    """One row per input row and component, numbered from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained"))
    rows = judged.select("row", "n", "deviation", "identity_error", each.alias("at", "pair"))
    return rows.select("row", (F.col("at") + 1).alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error")
