"""Embedding whitening by QDWH spectral divide-and-conquer.

1. One pass sums every dimension, a second one sums the products of the rows, which are centred at the nearest whole
   number of the mean before anything is multiplied. All sums are exact integers; the remainder of the mean, less than
   one, is taken off in exact integers too. Only the d x d sums of a dimension d reach the driver.
2. The covariance is split there: the polar factor of ``V - sigma I``, by QR and Cholesky steps of the dynamically
   weighted Halley iteration, gives the projector on the eigenvalues above ``sigma``; its range and the complement are
   invariant subspaces, and each half of the matrix is split again until single components are left.
3. The d x 32 whitening matrix goes to every task. A pass over all rows measures the covariance of what comes out, the
   last one writes it.

Defined results: vectors that are null, empty or hold null or non-finite entries are left out, and so are those with an
entry of ``2**24`` or more in size; vectors of different dimension are whitened apart; a null id stays null; repeated
rows count and return as often as they occur; components whose variance is below 1e-10 of the largest have none that
could be told from rounding and are not returned, so equal vectors, a single vector and an empty table give no rows; a
``deviation`` beyond the range of a long is null. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_CELLS = 1 << 19
LARGEST = float(2**24)
NEGLIGIBLE = 1e-10


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH steps. Six reach double precision for every condition
    number that it can hold, as the weights follow the lower bound ``low`` of the singular values."""
    size = np.linalg.norm(a)
    if not size:
        return np.eye(len(a))
    x, low, unit = a / size, 1e-16, np.eye(len(a))
    for _ in range(12):
        square = low * low
        root = np.cbrt(4 * (1 - square) / square**2) if square < 1 else 0.0
        lift = np.sqrt(1 + root)
        p = lift + np.sqrt(8 - 4 * root + 8 * (2 - square) / (square * lift)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, unit]))
            after = q / r * x + (p - q / r) / np.sqrt(r) * both[: len(a)] @ both[len(a):].T
        else:
            after = q / r * x + (p - q / r) * np.linalg.solve(unit + r * x @ x, x)
        after = (after + after.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        moved, x = np.abs(after - x).max(), after
        if moved < 1e-14 and 1 - low < 1e-14:
            break
    return x


def _halves(a: np.ndarray, tolerance: float, draw: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the components above a shift, the others those below."""
    size = len(a)
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.eye(size) * diagonal.mean()) / np.sqrt(size)
    best: tuple[float, np.ndarray, int] | None = None
    shifts = [(diagonal[(size - 1) // 2] + diagonal[size // 2]) / 2, diagonal.mean()]
    for shift in [*shifts, *(diagonal.mean() + spread * t for t in (0.11, -0.11, 0.37, -0.37, 0.71, -0.71))]:
        above = (polar(a - shift * np.eye(size)) + np.eye(size)) / 2
        count = int(round(np.trace(above)))
        if not 0 < count < size:
            continue
        upper, lower = draw.normal(size=(size, count)), draw.normal(size=(size, size - count))
        for _ in range(2):  # the second round takes off what the first one's rounding left
            upper, lower = np.linalg.qr(above @ upper)[0], np.linalg.qr(lower - above @ lower)[0]
        basis = np.linalg.qr(np.hstack([upper, lower]))[0]
        apart = float(np.linalg.norm(basis[:, :count].T @ a @ basis[:, count:]))
        if best is None or apart < best[0]:
            best = apart, basis, count
        if apart <= tolerance:
            break
    return best and best[1:]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors, as columns, of a symmetric matrix."""
    size = len(v)
    draw = np.random.default_rng(size)
    whole = np.linalg.norm(v)
    tolerance = 8 * np.finfo(float).eps * whole
    basis = np.eye(size)
    open_ = [(0, size)]
    while open_:
        low, high = open_.pop()
        own = basis[:, low:high]
        block = own.T @ v @ own
        block = (block + block.T) / 2
        apart = np.linalg.norm(block - np.diag(np.diag(block)))
        if high - low == 1 or apart <= np.finfo(float).eps * whole:
            continue
        found = _halves(block, tolerance, draw)
        if found is None:
            continue  # the values of the block are one value to double precision
        turn, count = found
        basis[:, low:high] = own @ turn
        open_ += [(low, low + count), (low + count, high)]
    for _ in range(2):  # the many products have left the basis orthonormal to a few roundings; back to one
        basis = basis @ (3 * np.eye(size) - basis.T @ basis) / 2
    values = np.einsum("ij,ij->j", basis, v @ basis)
    order = np.argsort(-values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Fit:
    """What is known of the vectors of one dimension: ``centre`` are whole numbers, ``rest`` is n times the mean less
    n times ``centre``, exact."""
    n: int
    centre: np.ndarray
    rest: list[int]
    matrix: np.ndarray | None = None
    explained: np.ndarray | None = None
    error: float = 0.0

    def projected(self, d: np.ndarray) -> np.ndarray:
        return (d - np.array([r / self.n for r in self.rest])) @ self.matrix


def _pieces(batches, scale: int, offset: int, fits: dict[int, Fit] | None = None):
    """(ids, dimension, whole numbers less the centre) of bounded slices, one dimension at a time."""
    for batch in batches:
        column = batch.column("v")
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            if fits is not None and dim not in fits:
                continue
            at = np.flatnonzero(sizes == dim)
            for start in range(0, len(at), max(1, SLICE_CELLS // dim)):
                rows = pa.array(at[start:start + max(1, SLICE_CELLS // dim)])
                values = column.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = np.floor(scale * values).astype(np.int64) + offset
                yield batch.column("vec_id").take(rows), dim, x if fits is None else x - fits[dim].centre


def _sums(scale: int, offset: int):
    def sums(batches):
        held: dict[int, list] = {}
        for _, dim, x in _pieces(batches, scale, offset):
            n, s = held.get(dim, (0, 0))
            held[dim] = n + len(x), s + x.sum(axis=0)
        for dim, (n, s) in held.items():
            yield pa.RecordBatch.from_pydict({
                "dim": np.full(dim, dim, np.int32), "i": np.arange(dim, dtype=np.int32), "n": np.full(dim, n, np.int64), "s": s})
    return sums


def exact_products(d: np.ndarray):
    """Products d' d of whole numbers as one or more exact int64 parts."""
    largest = int(np.abs(d).max(initial=0)) ** 2
    if largest * len(d) < 2**53:
        yield (d.astype(np.float64).T @ d.astype(np.float64)).astype(np.int64)
        return
    step = max(1, 2**62 // max(largest, 1))
    for start in range(0, len(d), step):
        yield d[start:start + step].T @ d[start:start + step]


def _upper(dim: int, sums: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(sums))
    return pa.RecordBatch.from_pydict({"dim": np.full(len(i), dim, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "s": sums[i, j]})


def _products(scale: int, offset: int, fits: dict[int, Fit]):
    def products(batches):
        held: dict[int, tuple[np.ndarray, float]] = {}
        for _, dim, d in _pieces(batches, scale, offset, fits):
            for part in exact_products(d):
                size = float(np.abs(np.diag(part)).max())  # no product is larger than the largest square
                total, before = held.get(dim, (None, 0.0))
                if total is not None and before + size >= 2.0**62:
                    yield _upper(dim, total)
                    total, before = None, 0.0
                held[dim] = (part if total is None else total + part), before + size
        for dim, (total, _) in held.items():
            yield _upper(dim, total)
    return products


def _spread(scale: int, offset: int, fits: dict[int, Fit]):
    """Sums of the products of whitened rows; a column of ones beside them gives their sums."""
    def spread(batches):
        held: dict[int, np.ndarray] = {}
        for _, dim, d in _pieces(batches, scale, offset, fits):
            w = fits[dim].projected(d)
            w = np.hstack([w, np.ones((len(w), 1))])
            held[dim] = held.get(dim, 0) + w.T @ w
        for dim, sums in held.items():
            yield _upper(dim, sums)
    return spread


def deviations(d: np.ndarray, fit: Fit) -> pa.Array:
    """Sum of (n x - S)^2 of every row, exact."""
    rough = ((d.astype(float) * fit.n - np.array(fit.rest, float)) ** 2).sum(axis=1)
    if rough.max(initial=0) < 2.0**62:
        return pa.array(((d * fit.n - np.array(fit.rest, np.int64)) ** 2).sum(axis=1))
    exact = [sum((x * fit.n - r) ** 2 for x, r in zip(row, fit.rest)) for row in d.tolist()]
    return pa.array([e if e < 2**63 else None for e in exact], pa.int64())


def _whitened(scale: int, offset: int, fits: dict[int, Fit]):
    def whitened(batches):
        for ids, dim, d in _pieces(batches, scale, offset, fits):
            fit = fits[dim]
            count = len(fit.explained)
            rows = pa.array(np.repeat(np.arange(len(d)), count))
            yield pa.RecordBatch.from_arrays([
                ids.take(rows), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(d))),
                pa.array(np.full(len(rows), fit.n, np.int64)), deviations(d, fit).take(rows), pa.array(fit.projected(d).ravel()),
                pa.array(np.tile(fit.explained, len(d))), pa.array(np.full(len(rows), fit.error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return whitened


def _matrices(sums: DataFrame, kind: str) -> dict[int, dict[tuple[int, int], object]]:
    """Sums over all tasks, by dimension and cell: as many rows as the matrices have cells."""
    found: dict[int, dict] = {}
    for r in sums.groupBy("dim", "i", "j").agg(F.sum(F.col("s").cast(kind)).alias("s")).collect():
        found.setdefault(r["dim"], {})[r["i"], r["j"]] = r["s"]
    return found


def whiten(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 64, offset: int = 1000000,
           most: int = 32) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error. Every
    entry c of a vector counts as ``floor(scale * c) + offset``."""
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < LARGEST))
    rows = table.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))

    sums = rows.mapInArrow(_sums(scale, offset), "dim int, i int, n long, s long").groupBy("dim", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    fits: dict[int, Fit] = {}
    for dim, own in sums.orderBy("dim", "i").toPandas().groupby("dim"):
        n, total = int(own.n.iloc[0]), [int(s) for s in own.s]
        centre = [(2 * s + n) // (2 * n) for s in total]
        fits[int(dim)] = Fit(n, np.array(centre, np.int64), [s - n * c for s, c in zip(total, centre)])

    whole = "dim int, i int, j int, s long"
    for dim, cells in _matrices(rows.mapInArrow(_products(scale, offset, fits), whole), "decimal(38,0)").items():
        fit, v = fits[dim], np.zeros((dim, dim))
        for (i, j), s in cells.items():
            v[i, j] = v[j, i] = (fit.n * int(s) - fit.rest[i] * fit.rest[j]) / fit.n**2
        values, vectors = eigen(v)
        count = int((values[:most] > NEGLIGIBLE * max(values[0], 0)).sum())
        fit.matrix, fit.explained = vectors[:, :count] / np.sqrt(values[:count]), values[:count] / np.trace(v)
    fits = {dim: fit for dim, fit in fits.items() if fit.explained is not None and len(fit.explained)}

    for dim, cells in _matrices(rows.mapInArrow(_spread(scale, offset, fits), "dim int, i int, j int, s double"), "double").items():
        fit, last = fits[dim], len(fits[dim].explained)
        fit.error = float(max(abs(s / fit.n - cells[i, last] * cells[j, last] / fit.n**2 - (i == j))
                              for (i, j), s in cells.items() if j < last))
    return rows.mapInArrow(_whitened(scale, offset, fits),
                           "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
