"""Whitening by the leading components of the covariance, found by Chebyshev-filtered subspace iteration.

A block of trial vectors Q is improved in rounds. Each application of the covariance is one distributed pass over
the centred rows, ``Xc' (Xc Q) / n``: a task adds up one row per dimension, and the rows are summed by dimension. A
round starts with a pass and Rayleigh-Ritz in the block. The smallest Ritz value bounds the unwanted spectrum from
above, and a Lanczos run, one more column in the first passes, from below. Further passes then follow the Chebyshev
recurrence on that interval, which damps what lies in it, and QR makes the block orthogonal again. Rounds end when each
wanted pair's residual, against the gap to the neighbouring eigenvalues, certifies its vector to about twelve
digits, or is at rounding level where eigenvalues are tied. Sums are taken over each distinct vector once, centred before multiplying.

The driver holds a few matrices of dimensions x block (24 columns), however many rows there are.

* Rows whose vector is null, empty, or holds null or non-finite entries are dropped; other columns are not read.
* Equal vectors count once in the fit, and each row gets its own output, repeated ids and rows too; null ids stay.
* Components of no variance are left out, so a table without two different vectors gives no rows, and neither does
  an empty one. Vectors of several lengths raise ``ValueError``.
* Tied eigenvalues: any orthonormal choice of their vectors, the same for all rows; a component's sign is arbitrary.
* ``deviation`` is exact, as ``decimal(38, 0)``; sums beyond 64 bits per dimension raise.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.llm.integer_vectors import integer_rows, matrix, one_length
from borehole.session import materialise, ship_package

#: Trial vectors beside the wanted ones.
GUARD = 20
#: Passes of one round at most, rounds at most, and steps of the Lanczos run.
DEGREE, ROUNDS, LANCZOS = 12, 60, 16
#: Wanted error of a component's direction, and the residual at rounding level, as a share of the largest eigenvalue.
PRECISION, ROUNDING = 1e-12, 64 * np.finfo(float).eps
BATCH = 1 << 20


class Spectrum:
    """Eigenvalues, vectors (columns), mean, number of rows and total variance of a fit."""

    def __init__(self, values, vectors, sums, n, trace, passes):
        self.values, self.vectors, self.sums, self.n, self.trace, self.passes = values, vectors, sums, n, trace, passes


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension."""

    def run(batches):
        n, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                if int(np.abs(x).max()) > (1 << 62) // (n + len(x)):
                    raise OverflowError("sums of vector components exceed 64 bits")
                n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.r_[n, total])], names=["i", "s"])

    found = fit.select("x").mapInArrow(run, "i long, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()
    by = {r["i"]: r["s"] for r in found}
    return by.get(-1, 0), [by.get(i, 0) for i in range(dims)]


def apply_covariance(fit: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> tuple[np.ndarray, float]:
    """One pass: the covariance times ``block``, and its trace."""
    dims, width = block.shape
    shared = fit.sparkSession.sparkContext.broadcast((mean, np.ascontiguousarray(block)))

    def run(batches):
        centre, q = shared.value
        out, squares = np.zeros((dims, width)), np.zeros(dims)
        for batch in batches:
            step = max(1, BATCH // dims)
            for at in range(0, batch.num_rows, step):
                x = matrix(batch.column(0).slice(at, step)) - centre
                out += x.T @ (x @ q)
                squares += np.einsum("ij,ij->j", x, x)
        columns = [pa.array(np.arange(dims)), pa.array(squares), *map(pa.array, np.ascontiguousarray(out.T))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "sq", *names])

    names = [f"v{j}" for j in range(width)]
    parts = fit.select("x").mapInArrow(run, "i long, sq double, " + ", ".join(f"{c} double" for c in names))
    summed = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("sq", *names)]).collect()
    shared.destroy()
    rows = np.array([[r[c] for c in ("sq", *names)] for r in sorted(summed, key=lambda r: r["i"])]) / n
    return rows[:, 1:], float(rows[:, 0].sum())


class _Lanczos:
    """A lower bound of the spectrum from products that come with the block's own passes."""

    def __init__(self, start: np.ndarray):
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []
        self.floor = 0.0

    @property
    def running(self) -> bool:
        return len(self.alpha) < min(LANCZOS, len(self.basis[0]))

    def add(self, product: np.ndarray) -> None:
        basis = np.stack(self.basis)
        self.alpha.append(float(basis[-1] @ product))
        rest = product
        for _ in range(2):
            rest = rest - basis.T @ (basis @ rest)
        size = float(np.linalg.norm(rest))
        t = np.diag(self.alpha) + np.diag(self.beta, 1) + np.diag(self.beta, -1)
        self.floor = max(0.0, float(np.linalg.eigvalsh(t)[0]) - size)
        self.beta.append(size)
        if size <= ROUNDING * max(abs(a) for a in self.alpha):
            self.alpha += [0.0] * LANCZOS  # an invariant space: nothing more to learn
        else:
            self.basis.append(rest / size)


def leading_components(fit: DataFrame, dims: int, wanted: int, guard: int = GUARD, seed: int = 20260203) -> Spectrum:
    """The ``wanted`` largest eigenpairs of the covariance of ``fit`` (column ``x``), fewer if its rank is lower."""
    n, sums = totals(fit, dims)
    if n < 2:
        return Spectrum(np.zeros(0), np.zeros((dims, 0)), sums, n, 0.0, 0)
    mean = np.array([s / n for s in sums])
    width = min(dims, wanted + guard)
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    lanczos = _Lanczos(rng.standard_normal(dims))
    passes = 0

    def product(columns: np.ndarray) -> tuple[np.ndarray, float]:
        nonlocal passes
        passes += 1
        if not lanczos.running:
            return apply_covariance(fit, mean, n, columns)
        out, trace = apply_covariance(fit, mean, n, np.c_[columns, lanczos.basis[-1]])
        lanczos.add(out[:, -1])
        return out[:, :-1], trace

    for _ in range(ROUNDS):
        image, trace = product(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        top = values[0]
        residual = np.linalg.norm(image - block * values, axis=0)
        found = int((values[:wanted] > max(top, 0) * dims * ROUNDING).sum())
        gaps = np.array([min([abs(values[j] - v) for i, v in enumerate(values) if i != j], default=top) for j in range(found)])
        if width == dims or (residual[:found] <= np.maximum(PRECISION * gaps, ROUNDING * top)).all():
            break
        low, high = lanczos.floor, values[-1]
        if high <= top * dims * ROUNDING:
            # fewer directions have variance than the block has columns: the image spans them all
            block = np.linalg.qr(image)[0]
            continue
        centre, half = (high + low) / 2, max((high - low) / 2, top * ROUNDING)
        # as many passes as the slowest pair still needs, at its growth per pass
        ahead = max((values[found - 1] - centre) / half, 1 + 1e-6)
        growth = np.log(ahead + np.sqrt(ahead**2 - 1))
        need = np.log(max(residual[:found].max(), ROUNDING * top) / (0.1 * max(PRECISION * gaps.min(), ROUNDING * top)))
        degree = int(np.clip(np.ceil(need / growth), 2, DEGREE))
        # Chebyshev recurrence, scaled by its own growth at the largest value so that nothing overflows
        scale = half / (top - centre)
        sigma = scale
        before, now = block, (image - centre * block) * (sigma / half)
        for _ in range(degree - 1):
            image, _ = product(now)
            after = 1 / (2 / scale - sigma)
            before, now = now, (image - centre * now) * (2 * after / half) - (sigma * after) * before
            sigma = after
        block = np.linalg.qr(now)[0]
    else:
        raise RuntimeError(f"components not certified after {passes} passes")
    return Spectrum(values[:found], block[:, :found], sums, n, trace, passes)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact ``sum((n * x - S) ** 2)`` of each row."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if x.shape[1] * largest**2 < 1 << 63:
        apart = n * x - np.array(sums, np.int64)
        return pa.array(np.einsum("ij,ij->i", apart, apart)).cast(pa.decimal128(38, 0))
    whole = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array(list(map(Decimal, whole)), pa.decimal128(38, 0))


def whiten(
    table: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", guard: int = GUARD
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per row and component."""
    ship_package(table.sparkSession)
    rows = materialise(integer_rows(table, id_col, vector_col), "integers")
    dims = one_length(rows)
    fit = materialise(rows.select("x").distinct(), "distinct")
    found = leading_components(fit, dims, min(components, dims), guard)
    k, n, sums = len(found.values), found.n, found.sums
    mean = np.array([s / n for s in sums]) if n else np.zeros(dims)
    turn = found.vectors / np.sqrt(found.values)
    error = 0.0
    if k:
        image, _ = apply_covariance(fit, mean, n, turn)
        error = float(np.abs(turn.T @ image - np.eye(k)).max())
    explained = found.values / found.trace if k else found.values

    def run(batches):
        for batch in batches:
            step = max(1, BATCH // max(dims, 1))
            for at in range(0, batch.num_rows if k else 0, step):
                part = batch.slice(at, step)
                x = matrix(part.column(1))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                made = [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)),
                    _deviations(x, n, sums).take(each),
                    pa.array(((x - mean) @ turn).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(made, names=names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return rows.select("vec_id", "x").mapInArrow(run, schema)
