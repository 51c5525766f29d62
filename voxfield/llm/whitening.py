"""Embedding whitening: principal components of distinct vectors by MLlib's distributed SVD, and every row projected on them at unit variance.

Entries become whole numbers, floor(scale * c) + shift, and the fit list holds each distinct vector once; it is written once to the shared folder.
One aggregate gives its size n and the exact sums S of each dimension. With m = floor(S / n) and r = S - n * m an entry is centred as
(x - m) - r / n, which neither overflows nor loses digits to the shift. `computeSVD` of these rows gives right singular vectors and singular values s;
the eigenvalues of the covariance with divisor n are s * s / n. The SVD goes through the rows' Gram matrix, whose small eigenvalues drown in the
rounding of the large ones; so of one SVD only components whose eigenvalue is over FALL of its largest are taken, and for the rest the rows are
deflated (their projections on what was found are taken off) and decomposed again. On common data one SVD is enough.

A second pass over the fit list sums exact deviations, sum((n * x - S)^2) in whole numbers, whose total over n^3 is the trace (so `explained` doesn't
come from the singular values), and the whitened rows' products, from which `identity_error` comes. Only sums of (components x components) numbers
and matrices of (dimensions x dimensions) reach the driver, never rows.

Rows whose vector is null or empty or holds a null or non-finite entry are dropped; a null id is kept. Repeated vectors count once in the fit and each
row gets its components. Vectors of different lengths are fitted apart. Scaled entries beyond 2^52 count as 2^52. `deviation` is null where it needs
more than 63 bits. Components without variance have no rows: one distinct vector, or no rows, give an empty result. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import map_batches, store

FALL = 1e-4  # eigenvalues below this share of an SVD's largest are left to the next SVD
NONE = 1e-26  # eigenvalues below this share of the first are rounding
ROWS = 1 << 14
_LIMB = 1 << 60


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """The id and x array<bigint>, of the rows that take part."""
    c = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    most = 2.0**52
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col), F.transform(c, lambda y: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), y * scale))) + shift).alias("x"))


class Centre:
    """The fit list's size and sums, and what they make of vectors."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.mean, self.rest = n, np.array([s // n for s in sums], np.int64), [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as doubles."""
        return (x - self.mean) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n * x - S)^2) of each row, exact: n * n * sum(y * y) - 2 * n * sum(r * y) + sum(r * r) for y = x - m."""
        y = x - self.mean
        rest, dims = np.array(self.rest, np.int64), x.shape[1]
        top = int(np.abs(y).max(initial=0)) * max(int(np.abs(y).max(initial=0)), self.n) * dims
        if top >= 1 << 62:
            y, rest = y.astype(object), rest.astype(object)
        squares, crossed, last = (y * y).sum(1).tolist(), (y * rest).sum(1).tolist(), sum(r * r for r in self.rest)
        return [self.n * self.n * a - 2 * self.n * b + last for a, b in zip(squares, crossed, strict=True)]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _centre(fit: DataFrame, dims: int) -> Centre:
    row = fit.agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i].cast("decimal(19,0)")) for i in range(dims)]).alias("s")).first()
    return Centre(row["n"], [int(s) for s in row["s"]])


def components(fit: DataFrame, centre: Centre, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: `most` at most, those without variance left out."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    dims = len(centre.mean)
    values, found = np.zeros(0), np.zeros((dims, 0))
    while len(values) < min(most, dims):

        def centred(batches: Iterator[pa.RecordBatch], found: np.ndarray = found) -> Iterator[pa.RecordBatch]:
            for part, x in _matrices(batches):
                rows = centre.rows(x)
                rows -= (rows @ found) @ found.T
                flat = pa.array(rows.ravel())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, dims, dtype=np.int32)), flat)], ["v"])

        rows = map_batches(fit.select("x"), centred, "v array<double>").select(array_to_vector("v").alias("v"))
        svd = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v")).computeSVD(dims, rCond=1e-9)
        s = np.array(svd.s.toArray())
        e = s * s / centre.n
        taken = e >= FALL * e.max(initial=0)
        if len(values):
            taken &= e > NONE * values[0]
        if not taken.any() or e.max() <= 0:
            break
        v = np.array(svd.V.toArray())[:, : len(s)][:, taken]
        v -= found @ (found.T @ v)
        v, _ = np.linalg.qr(v) if len(values) else (v, None)
        values, found = np.append(values, e[taken]), np.hstack([found, v])
    order = np.argsort(-values, kind="stable")[:most]
    found = found[:, order]
    return values[order], found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1.0, 1.0) if found.size else found


def _moments(fit: DataFrame, centre: Centre, basis: np.ndarray) -> tuple[int, float]:
    """The total of the exact deviations, and the largest absolute entry of the whitened rows' covariance minus the identity."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, np.zeros(k + k * k)
        for _, x in _matrices(batches):
            total += sum(centre.deviations(x))
            w = centre.rows(x) @ basis
            sums += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([str(total // _LIMB)]), pa.array([total % _LIMB], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.float64()))], ["high", "low", "sums"])

    parts = map_batches(fit.select("x"), run, "high string, low bigint, sums array<double>")
    each = parts.select(F.posexplode("sums").alias("i", "s"), F.col("high").cast("decimal(38,0)").alias("high"), F.col("low").cast("decimal(38,0)").alias("low"))
    rows = each.groupBy("i").agg(F.sum("s").alias("s"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    sums = np.zeros(k + k * k)
    for r in rows:
        sums[r["i"]] = r["s"] / centre.n
    mean, products = sums[:k], sums[k:].reshape(k, k)
    return int(rows[0]["high"]) * _LIMB + int(rows[0]["low"]), float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error for each row that takes part and each of its first `most` components."""
    rows = whole_vectors(vectors, id_col, vector_col)
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = store(rows.select("x").distinct())
    out = vectors.sparkSession.createDataFrame([], schema)
    for dims in sorted(r[0] for r in fit.select(F.size("x")).distinct().collect()):
        same = fit.where(F.size("x") == dims)
        centre = _centre(same, dims)
        values, vectors_ = components(same, centre, most)
        if len(values):
            basis = vectors_ / np.sqrt(values)
            total, error = _moments(same, centre, basis)
            share = values / (total / centre.n**3)
            out = out.unionByName(_projected(rows.where(F.size("x") == dims), centre, basis, share, error, schema))
    return out


def _projected(rows: DataFrame, centre: Centre, basis: np.ndarray, share: np.ndarray, error: float, schema: str) -> DataFrame:
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches):
            many, deviation = part.num_rows * k, [d if d < 1 << 63 else None for d in centre.deviations(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                    pa.array(np.full(many, centre.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(part.num_rows), k))),
                    pa.array((centre.rows(x) @ basis).ravel()),
                    pa.array(np.tile(share, part.num_rows)),
                    pa.array(np.full(many, error)),
                ],
                names=[part.schema.names[0], "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_batches(rows, run, schema)
