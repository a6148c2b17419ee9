"""Embedding whitening with an exact covariance: integers, split into limbs, multiplied by float64 BLAS.

Every entry c becomes the integer x = floor(64 c) + 1000000. With n rows and sums S, the centred integers
n x - S are exact, so their products' sums are n**3 times the covariance, without any rounding. A task splits
them into limbs of LIMB bits: a product of two limbs, summed over at most ROWS rows, stays below 2**53, where float64
is exact, so each pair of limbs is one matrix product of BLAS. A task recombines what it gathered into integers, cut at
2**CARRY only to fit Spark's decimals; tasks merge by a Spark aggregation of dimensions**2 rows; the driver divides once, and
a Jacobi iteration in extended precision finishes the eigenvectors that LAPACK begins, so small eigenvalues
keep their leading digits beside large ones.

What the driver and every task hold grows with the square of the dimension, never with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LIMB, ROWS, CARRY = 20, 4096, 96
#: Entries of 64 c beyond this are taken as this, so that x fits a long.
FAR = float(1 << 62)
#: Eigenvalues below this share of the largest are rounding or rank-deficient, and have no component.
NOISE = 1e-15


def integers(vectors: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each length of vector (length, rows, x as int64), of the rows without null or non-finite entries."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64())
    sound = pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    held = np.maximum(sizes, 0)
    first = np.cumsum(held) - held
    bad = np.bincount(np.repeat(np.arange(len(sizes)), held), weights=~sound, minlength=len(sizes)) > 0
    out = []
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero((sizes == size) & ~bad)
        c = values[first[rows][:, None] + np.arange(size)]
        x = np.floor(np.clip(c * SCALE, -FAR, FAR)).astype(np.int64) + OFFSET
        out.append((int(size), rows, x))
    return sizes, out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, dim, n, high, low): sums of x, cut at 2**32 so that neither half overflows."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in _chunks(batches):
        for size, rows, x in integers(batch.column(0))[1]:
            n, s = total.get(size, (0, np.zeros((2, size), dtype=np.int64)))
            total[size] = n + len(rows), s + np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
    for size, (n, (high, low)) in total.items():
        yield pa.RecordBatch.from_pydict({"size": [size] * size, "dim": list(range(size)), "n": [n] * size, "high": high.tolist(), "low": low.tolist()}, schema=pa.schema([("size", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]))


@dataclass
class Centre:
    """n rows, their exact sums, and the sums by whole means and rests: S = n * mean + rest."""

    n: int
    sums: list[int]

    @property
    def size(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S: int64 where that is certain to fit, else Python's integers."""
        mean = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
        most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + int(np.abs(mean).max(initial=0))
        if most * self.n + self.n < 1 << 62:
            return self.n * (x - mean) - rest
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)


def limbs_of(d: np.ndarray) -> list[np.ndarray]:
    """Float64 matrices of limbs, the least first, each in [0, 2**LIMB) but for the signed last; d is their sum by powers of 2**LIMB."""
    out = []
    while True:
        if not d.size or (int(d.max()) < 1 << LIMB and int(d.min()) >= -(1 << LIMB)):
            out.append(d.astype(np.float64))
            return out
        out.append((d & ((1 << LIMB) - 1)).astype(np.float64))
        d = d >> LIMB


def exact_gram(d: np.ndarray) -> np.ndarray:
    """The exact d.T @ d as Python integers, for ROWS rows at most, by one float64 product a pair of limbs."""
    limbs = limbs_of(d)
    total = np.zeros((d.shape[1], d.shape[1]), dtype=object)
    for i, a in enumerate(limbs):
        for j in range(i, len(limbs)):
            product = (a.T @ limbs[j]).astype(np.int64).astype(object)
            total = total + ((product if i == j else product + product.T) << (LIMB * (i + j)))
    return total


def covariance_sums(rows: DataFrame, centre: Centre) -> np.ndarray:
    """The sums of (n x - S)_i (n x - S)_j over all rows, exact, as Python integers."""
    size = centre.size
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), dtype=object)
        for batch in _chunks(batches):
            for length, _, x in integers(batch.column(0))[1]:
                if length == size:
                    total = total + exact_gram(centre.deviations(x))
        values, part = total[upper], 0
        cell = np.arange(len(values), dtype=np.int32)
        while len(values):
            last = max(abs(int(v)) for v in values) < 1 << CARRY
            low = values if last else values & ((1 << CARRY) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array([part] * len(values), pa.int32()), pa.array([str(int(v)) for v in low])], names=["cell", "part", "value"])
            if last:
                return
            values, part = values >> CARRY, part + 1

    parts = rows.mapInArrow(run, "cell int, part int, value string")
    merged = parts.groupBy("cell", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out = np.zeros((size, size), dtype=object)
    for r in merged:
        out[upper[0][r["cell"]], upper[1][r["cell"]]] += int(r["value"]) << (CARRY * r["part"])
    return np.triu(out) + np.triu(out, 1).T


def _long(value: int, by: int) -> np.longdouble:
    """value / by, rounded to extended precision."""
    whole, rest = divmod(value, by)
    head = float(whole)
    return np.longdouble(head) + np.longdouble(float(whole - int(head))) + np.longdouble(rest / by)


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, vectors as columns) of a symmetric matrix in extended precision; each vector's largest entry is positive.

    LAPACK's vectors turn the matrix nearly diagonal; Jacobi rotations in extended precision remove what is left.
    """
    q = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(2):  # Gram-Schmidt in extended precision
        for i in range(len(q)):
            q[:, i] -= q[:, :i] @ (q[:, :i].T @ q[:, i])
            q[:, i] /= np.sqrt(q[:, i] @ q[:, i])
    b = q.T @ v @ q
    for _ in range(8):
        scale = np.sqrt(np.abs(np.diag(b)))
        rows, columns = np.nonzero(np.triu(np.abs(b) > 1e-18 * np.outer(scale, scale) + 1e-30 * np.abs(b).max(initial=0), 1))
        if not len(rows):
            break
        for i, j in zip(rows, columns, strict=True):
            if b[i, j] == 0:
                continue
            tau = (b[j, j] - b[i, i]) / (2 * b[i, j])
            t = (1 if tau >= 0 else -1) / (abs(tau) + np.sqrt(1 + tau * tau))
            c = 1 / np.sqrt(1 + t * t)
            turn = np.array([[c, t * c], [-t * c, c]], dtype=np.longdouble)
            b[:, [i, j]] = b[:, [i, j]] @ turn
            b[[i, j], :] = turn.T @ b[[i, j], :]
            q[:, [i, j]] = q[:, [i, j]] @ turn
    order = np.argsort(-np.diag(b), kind="stable")
    q = q[:, order]
    top = q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])]
    return np.diag(b)[order], q * np.where(top < 0, -1, 1)


@dataclass
class Whitening:
    """A fitted whitening: centre, kept components as columns scaled by 1/sqrt(e), and each one's share of the trace."""

    centre: Centre
    weights: np.ndarray
    explained: np.ndarray

    def apply(self, d: np.ndarray) -> np.ndarray:
        """Whitened rows of exact deviations n x - S."""
        return (d.astype(np.float64) / self.centre.n) @ self.weights


def _centre(rows: DataFrame) -> Centre | None:
    """Of the vectors of the commonest length (of equally common ones the longest); None where there are none."""
    sums = rows.mapInArrow(_sums, "size int, dim int, n bigint, high bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    found = sums.groupBy("size", "dim").agg(*wide).collect()
    if not found:
        return None
    _, size = max((r["n"], r["size"]) for r in found)
    of = sorted((r["dim"], int(r["n"]), (int(r["high"]) << 32) + int(r["low"])) for r in found if r["size"] == size)
    return Centre(of[0][1], [s for _, _, s in of])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (one column of vectors): two scans, of which the driver gets sums of the dimensions and of their pairs."""
    centre = _centre(rows)
    if centre is None:
        return None
    exact = covariance_sums(rows, centre)
    by = centre.n**3
    v = np.array([[_long(int(x), by) for x in row] for row in exact], dtype=np.longdouble)
    e, q = eigen(v)
    trace = _long(int(sum(exact[i, i] for i in range(centre.size))), by)
    kept = int((e[:components] > NOISE * max(e[0], 0)).sum()) if trace > 0 else 0
    weights = (q[:, :kept] / np.sqrt(e[:kept])).astype(np.float64)
    return Whitening(centre, weights, (e[:kept] / trace).astype(np.float64) if kept else np.zeros(0))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by a scan of its own.

    The rows are centred before they are multiplied: deviations are exact, and what their projections' rounding leaves as a
    mean is subtracted after the scan, where it is far below one part in 10**9.
    """
    size, kept = model.centre.size, model.weights.shape[1]
    upper = np.triu_indices(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, gram = np.zeros(kept), np.zeros((kept, kept))
        for batch in _chunks(batches):
            for length, _, x in integers(batch.column(0))[1]:
                if length == size:
                    w = model.apply(model.centre.deviations(x))
                    mean, gram = mean + w.sum(axis=0), gram + w.T @ w
        cell = np.arange(kept + len(upper[0]), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(mean, gram[upper]))], names=["cell", "value"])

    found = {r["cell"]: r["value"] / model.centre.n for r in rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    mean = np.array([found[i] for i in range(kept)])
    cov = np.zeros((kept, kept))
    cov[upper] = [found[kept + i] for i in range(len(upper[0]))]
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(kept)).max(initial=0.0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of embeddings (vec_id, embedding).

    Rows whose vector is null, empty, of another length than the commonest, or holds a null or non-finite entry are left
    out. Repeated rows and null ids count like any. A component needs variance: of fewer independent
    dimensions than components only those have rows, and rows that are all equal, like an empty table, give none. A deviation
    past a long's range is null. Entries beyond 2**56 count as 2**56. Other columns don't matter.
    """
    kind = dict(embeddings.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors = embeddings.select("embedding")
    model = fit(vectors, components)
    if model is None or not model.weights.shape[1]:
        return embeddings.sparkSession.createDataFrame([], schema)
    error, kept, n = identity_error(vectors, model), model.weights.shape[1], model.centre.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            for length, rows, x in integers(batch.column("embedding"))[1]:
                if length != model.centre.size or not len(rows):
                    continue
                d = model.centre.deviations(x)
                most = max(abs(int(d.max())), abs(int(d.min())))
                square = (d if most * most * length < 1 << 62 else d.astype(object)) ** 2
                deviation = pa.array([int(s) if s < 1 << 63 else None for s in square.sum(axis=1)], pa.int64())
                at = pa.array(np.repeat(np.arange(len(rows)), kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)).take(at), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(at), n)), deviation.take(at),
                        pa.array(model.apply(d).ravel()), pa.array(np.tile(model.explained, len(rows))), pa.array(np.full(len(at), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return embeddings.select("vec_id", "embedding").mapInArrow(run, schema)
