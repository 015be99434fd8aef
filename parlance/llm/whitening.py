"""Operator 13, whitening of embeddings by a matrix-free block Lanczos method.

Entries c become whole numbers x = floor(256 c); the fit is over the distinct vectors of these. Their covariance V is
never formed: each step is a distributed pass that sends, from each task, its rows' part of (x - S/n)'((x - S/n) Q) for
a block Q of some vectors; parts are summed by dimension. New blocks are orthogonalised against all earlier ones twice; columns
that vanish (the block has found an invariant space) are replaced by random ones, orthogonal to all. Once the residuals
of the leading components are small the method starts again from a random block, orthogonal to all, and ends when they are
still small and the next component has settled too (equal eigenvalues can hide from one block), or when the blocks span
the whole space.

Counts, sums and deviations are exact (whole numbers of any size); the trace comes from the deviations' sum.
Only arrays of the size dimensions x basis vectors come to the driver or go into tasks.

Edge cases: vectors that are null or hold null or non-finite entries are dropped; shorter vectors are padded with zeros;
repeated rows and null vec_ids are rows of their own; components without variance (a single distinct vector, fewer
independent dimensions than components) are left out, so there may be no rows; an empty table gives an empty one; other columns are ignored.
A deviation that no long holds is null in the query (the operator's column is a decimal).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

_EXACT = pa.decimal128(38, 0)
_SAFE = 1 << 62


@dataclass(frozen=True)
class Lanczos:
    components: int = 4
    #: Vectors of a block.
    block: int = 16
    #: Residual of a component over the largest eigenvalue.
    residual: float = 1e-13
    #: The same for the component behind them, after a restart from a random block: none has been missed.
    next_residual: float = 1e-4
    #: A column that orthogonalisation leaves this part of has vanished.
    breakdown: float = 1e-10
    seed: int = 11


def whole_numbers(embedding: Column) -> Column:
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * 256).cast("bigint"))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vectors are whole and finite."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.filter(F.col("embedding").isNotNull()).filter(fine).select("vec_id", whole_numbers(F.col("embedding")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of whole numbers, padded to d."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lengths), d), dtype=np.int64)
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products along the last axis, exact; numbers of any size where 64 bits may not hold them."""
    size = lambda v: max(1, int(v.max(initial=0)), -int(v.min(initial=0)))
    most = size(a) * size(b) * max(1, a.shape[-1])
    return (a * b).sum(axis=-1) if most < _SAFE else (a.astype(object) * b.astype(object)).sum(axis=-1)


@dataclass(frozen=True)
class Fit:
    """n distinct vectors of d dimensions, their sums, and the exact sum of their deviations n**2 |x - S/n|**2."""

    n: int
    d: int
    sums: tuple[int, ...]
    deviations: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def trace(self) -> float:
        return self.deviations / self.n**3

    def deviation(self, x: np.ndarray) -> list[int]:
        """n**2 |x|**2 - 2 n x'S + |S|**2 of each row."""
        s = np.array(self.sums, dtype=np.int64 if all(abs(v) < _SAFE for v in self.sums) else object)
        square = sum(v * v for v in self.sums)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + square for a, b in zip(_dot(x, x), _dot(x, s[None, :]), strict=True)]


def moments(fit: DataFrame) -> Fit | None:
    """Exact sums of the fit list, from parts that tasks send; None if it is empty."""
    n, d = fit.agg(F.count("x"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not d:
        return None

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(d, dtype=object), 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if len(x):
                total = total + _dot(x.T, np.ones(len(x), dtype=np.int64)).astype(object)
                squares += int(_dot(x, x).astype(object).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), type=pa.int32()), pa.array([Decimal(v) for v in (squares, *map(int, total))], type=_EXACT)], ["dim", "v"])

    got = {r["dim"]: int(r["v"]) for r in fit.mapInArrow(parts, "dim int, v decimal(38,0)").groupBy("dim").agg(F.sum("v").alias("v")).collect()}
    sums = tuple(got[i] for i in range(d))
    return Fit(n, d, sums, n * (n * got[-1] - sum(v * v for v in sums)))


def _summed(fit: DataFrame, rows: int, columns: int, part) -> np.ndarray:  # noqa: ANN001
    """A rows x columns matrix summed over all batches of the fit list."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            if batch.num_rows:
                total += part(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), type=pa.int32()), *(pa.array(c) for c in total.T)], ["dim", *(f"c{j}" for j in range(columns))])

    names = [f"c{j}" for j in range(columns)]
    made = fit.mapInArrow(parts, "dim int, " + ", ".join(f"{c} double" for c in names)).groupBy("dim").agg(*(F.sum(c).alias(c) for c in names))
    out = np.zeros((rows, columns))
    for r in made.collect():
        out[r["dim"]] = [r[c] for c in names]
    return out


def covariance_times(fit: DataFrame, of: Fit, block: np.ndarray) -> np.ndarray:
    """V times a block of vectors, centred before multiplying."""
    mean, d = of.mean, of.d

    def part(column: pa.Array) -> np.ndarray:
        y = _matrix(column, d) - mean
        return y.T @ (y @ block)

    return _summed(fit, d, block.shape[1], part) / of.n


def _orthogonal(block: np.ndarray, basis: np.ndarray, how: Lanczos, rng: np.random.Generator) -> np.ndarray:
    """Unit columns spanning what the block adds to the basis; those that vanish are drawn anew while there is room."""
    d, out = len(block), basis
    width = min(block.shape[1], d - basis.shape[1])
    for j in range(width):
        v = block[:, j]
        while True:
            before = np.linalg.norm(v)
            for _ in range(3):
                v = v - out @ (out.T @ v)
            if before > 0 and np.linalg.norm(v) > how.breakdown * before:
                break
            v = rng.standard_normal(d)
        v = v / np.linalg.norm(v)
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def leading(fit: DataFrame, of: Fit, how: Lanczos = Lanczos()) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of V; those without variance are left out.

    An eigenvector's largest entry is positive."""
    rng, k, restarted = np.random.default_rng(how.seed), how.components, False
    basis, images = np.zeros((of.d, 0)), np.zeros((of.d, 0))
    block = rng.standard_normal((of.d, how.block))
    while True:
        q = _orthogonal(block, basis, how, rng)
        block = covariance_times(fit, of, q)
        basis, images = np.column_stack([basis, q]), np.column_stack([images, block])
        projected = basis.T @ images
        values, inner = np.linalg.eigh((projected + projected.T) / 2)
        values, inner = values[::-1][: k + 1], inner[:, ::-1][:, : k + 1]
        vectors = basis @ inner
        left = np.linalg.norm(images @ inner - vectors * values, axis=0) / max(values[0], np.finfo(float).tiny)
        if basis.shape[1] == of.d:
            break
        if len(values) > k and (left[:k] <= how.residual).all():
            if restarted and left[k] <= how.next_residual:
                break
            if not restarted:  # what has converged may be an invariant space that lacks some of the leading ones
                restarted, block = True, rng.standard_normal((of.d, how.block))
    values, vectors = values[:k], vectors[:, :k]
    real = values > of.trace * of.d * 2.0**-50
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors / np.linalg.norm(vectors, axis=0)


def identity_error(fit: DataFrame, of: Fit, project: np.ndarray) -> float:
    """The largest entry of the whitened fit list's covariance less the identity. Its mean follows from the sums."""
    mean, d, k = of.mean, of.d, project.shape[1]
    rest = np.array([float(s - of.n * m) for s, m in zip(of.sums, map(int, mean), strict=True)]) / of.n - (mean - np.trunc(mean))
    centre = rest @ project

    def part(column: pa.Array) -> np.ndarray:
        w = (_matrix(column, d) - mean) @ project - centre
        return w.T @ w

    return float(np.abs(_summed(fit, k, k, part) / of.n - np.eye(k)).max())


_OUT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, how: Lanczos = Lanczos()) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of all usable rows of (vec_id, embedding)."""
    rows = usable(embeddings)
    kind = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, {_OUT}"
    fit = written(rows.select("x").distinct())
    of = moments(fit)
    if of is not None and fit.filter(F.size("x") < of.d).limit(1).count():  # vectors that differ in padding only are one
        padded = written(fit.select(F.expr(f"concat(x, array_repeat(0L, {of.d} - size(x)))").alias("x")).distinct())
        discard(fit)
        fit, of = padded, moments(padded)
    values, vectors = leading(fit, of, how) if of is not None and of.deviations else (np.zeros(0), None)
    if not len(values):
        discard(fit)
        return embeddings.sparkSession.createDataFrame([], kind)
    project, k = vectors / np.sqrt(values), len(values)
    error = identity_error(fit, of, project)
    discard(fit)
    mean, explained = of.mean, values / of.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column(1), of.d), batch.num_rows
            if not m:
                continue
            deviation = [Decimal(v) if v < 10**38 else None for v in of.deviation(x)]
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, of.n)),
                pa.array(deviation, type=_EXACT).take(pa.array(np.repeat(np.arange(m), k))), pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in kind.split(", ")])

    return rows.mapInArrow(run, kind)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
