"""Whiten vectors: a distributed centred scatter, and cyclic Jacobi rotations of it on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, release

#: Steps of the grid in a unit, and components that a row is projected on.
GRID = 256
COMPONENTS = 4
#: Dimensions at most: the driver holds one square matrix of doubles of that size (32 MB).
MOST_DIMENSIONS = 2048
#: Sweeps after which rotations that still don't end are an error; a dozen is usual.
SWEEPS = 60
#: Below this share of the trace an eigenvalue counts as zero: its direction holds rounding only.
ZERO = 1e-13

# ---------------------------------------------------------------- rotations


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    A sweep rotates every pair of rows once, in rounds of disjoint pairs that are rotated together; an
    entry has vanished when it is below rounding beside its two diagonal entries, so that small
    eigenvalues come out as accurate as their own scale allows. Each vector's largest entry is positive.
    """
    d = len(a)
    a, v = np.array(a, np.float64), np.eye(d)
    if d < 2:
        return np.diag(a).copy(), v
    eps, floor = np.finfo(np.float64).eps, np.finfo(np.float64).tiny * 2**60
    ring = list(range(d + d % 2))
    for _ in range(SWEEPS):
        rotated = 0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(min(x, y), max(x, y)) for x, y in zip(ring[:half], ring[:half - 1:-1], strict=True) if max(x, y) < d]
            p, q = np.array(pairs).T
            ring = [ring[0], ring[-1], *ring[1:-1]]
            off = a[p, q]
            turn = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(a[p, p] * a[q, q])), floor)
            if not turn.any():
                continue
            p, q, off = p[turn], q[turn], off[turn]
            rotated += len(p)
            t = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(t < 0, -1.0, 1.0) / (np.abs(t) + np.hypot(t, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            new_p, new_q = a[p, p] - t * off, a[q, q] + t * off
            for m in (a, a.T, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            a[p, p], a[q, q], a[p, q], a[q, p] = new_p, new_q, 0, 0
        if not rotated:
            break
    else:
        raise ArithmeticError(f"rotations of a {d} x {d} matrix didn't end in {SWEEPS} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    return np.diag(a)[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


# ---------------------------------------------------------------- vectors on the grid


def grid(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: rows that take part, their lengths, and all their entries as whole steps of the
    grid, one row after another. Null rows take no part, nor rows with an entry that is null, not finite
    or too large for a step to be a long."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    n = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        steps = np.floor(GRID * flat)
        good = np.abs(steps) < 2.0**63
    row = np.repeat(np.arange(len(n)), n)
    bad = np.bincount(row[~good], minlength=len(n)) > 0
    if col.null_count:
        bad |= col.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(~bad), n[~bad], steps[~bad[row]].astype(np.int64)


def pack(x: np.ndarray) -> list[bytes]:
    """Equal rows and only these get equal bytes: each in the narrowest of 1, 2, 4 and 8 bytes an entry."""
    low, high = (x.min(axis=1), x.max(axis=1)) if x.shape[1] else (np.zeros(len(x)), np.zeros(len(x)))
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), bool)
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        span = np.iinfo(kind)
        fits = np.flatnonzero(left & (low >= span.min) & (high <= span.max))
        for i, r in zip(fits, x[fits].astype(kind), strict=True):
            out[i] = r.tobytes()
        left[fits] = False
    return out


def unpack(packed: pa.Array, dim: int) -> np.ndarray:
    """Rows of what ``pack`` gave."""
    x = np.zeros((len(packed), dim), np.int64)
    raw = packed.to_pylist()
    width = np.array([len(b) // dim for b in raw], np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        x[at] = np.frombuffer(b"".join(raw[i] for i in at), f"<i{w}").reshape(-1, dim)
    return x


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns that don't wrap."""
    top = max(-int(x.min()), int(x.max()), 1) if x.size else 1
    if top * len(x) < 2**63:
        return [int(s) for s in x.sum(axis=0)]
    return [int(s) for s in x.astype(object).sum(axis=0)]


def _squares(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums over dimensions of (n x - sum)^2, exact."""
    top = n * max(-int(x.min()), int(x.max()), 1) + max(map(abs, sums), default=0) if x.size else 0
    if top * top * len(sums) < 2**63:
        z = n * x - np.array(sums, np.int64)
        return (z * z).sum(axis=1).tolist()
    z = n * x.astype(object) - np.array(sums, object)
    return [int(s) for s in (z * z).sum(axis=1)]


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """What rows are projected with. ``values`` are all eigenvalues, falling; ``vectors`` their columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    def used(self, most: int) -> int:
        """Components that have a spread at all, at most ``most``."""
        return int((self.values[:most] > ZERO * max(float(self.values.sum()), 0.0)).sum())

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: whole parts are taken off as whole numbers, where these don't wrap."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([float(Fraction(s - w * self.n, self.n)) for s, w in zip(self.sums, whole, strict=True)])
        if x.size and max(-int(x.min()), int(x.max())) >= 2**62:
            return x.astype(np.float64) - np.array(whole, np.float64) - rest
        return (x - np.array(whole, np.int64)).astype(np.float64) - rest

    def whiten(self, x: np.ndarray, most: int) -> np.ndarray:
        k = self.used(most)
        return self.centre(x) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def distinct(vectors: DataFrame, *, vec_col: str = "embedding") -> DataFrame:
    """The fit list: each distinct vector on the grid once, packed (``x``), with its number of entries (``dim``)."""

    def run(batches):
        for batch in batches:
            _, n, flat = grid(batch.column(0))
            start = np.cumsum(n) - n
            for dim in np.unique(n):
                at = np.flatnonzero(n == dim)
                x = flat[start[at][:, None] + np.arange(dim)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(pack(x), pa.binary())], ["dim", "x"])
        release()

    return vectors.select(F.col(f"`{vec_col}`").alias("v")).mapInArrow(run, "dim int, x binary").distinct()


def fit(vectors: DataFrame, *, vec_col: str = "embedding") -> tuple[Model, DataFrame] | None:
    """Sums, scatter and rotations over the distinct vectors of the usual length; None where there are none.

    Rows meet by their packed vector only to be made distinct, after each task has dropped its own
    repeats. Sums are exact. The scatter is centred before it is multiplied: a task adds up one matrix
    and hands on its rows, which meet by row number and are added as they come, so that nothing holds
    more than one square matrix.
    """
    work = Workspace(vectors.sparkSession, "whitening")
    fitted = work.keep(distinct(vectors, vec_col=vec_col), "distinct")
    usual = fitted.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None:
        return None
    dim = usual.dim
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"{dim} dimensions; the driver rotates matrices of at most {MOST_DIMENSIONS}")
    fitted = fitted.where(F.col("dim") == dim).select("x")

    def add(batches):
        n, sums = 0, [0] * dim
        for batch in batches:
            n += batch.num_rows
            sums = [a + b for a, b in zip(sums, _exact_sums(unpack(batch.column(0), dim)), strict=True)] if dim else []
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(map(str, sums), pa.string())], ["i", "s"])

    n = fitted.count()
    sums = {r.i: int(r.s) for r in fitted.mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    model = Model(n, [sums[i] for i in range(dim)], np.zeros(dim), np.eye(dim))

    def scatter(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            c = model.centre(unpack(batch.column(0), dim))
            total += c.T @ c
        yield _matrix_rows(np.arange(dim), total)
        release()

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, dim), strict=True):
                held[i] = held[i] + row if i in held else row
        if held:
            yield _matrix_rows(np.array(list(held)), np.array(list(held.values())))

    if dim:
        spec = "i int, row array<double>"
        parts = fitted.mapInArrow(scatter, spec).repartition("i").mapInArrow(merge, spec).collect()
        v = np.array([r.row for r in sorted(parts, key=lambda r: r.i)]) / n
        model.values, model.vectors = jacobi((v + v.T) / 2)
    return model, fitted


def _matrix_rows(at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    cut = pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)[: len(at) + 1])
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.ListArray.from_arrays(cut, pa.array(rows.ravel()))], ["i", "row"])


def identity_error(model: Model, fitted: DataFrame, most: int = COMPONENTS) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, measured by
    another pass; 0 without components."""
    k = model.used(most)
    if not k:
        return 0.0

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            w = model.whiten(unpack(batch.column(0), model.dim), most)
            total += w.T @ w
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "c"])

    cells = fitted.mapInArrow(run, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    return max(abs(r.c / model.n - (r.i == r.j)) for r in cells)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each vector on the leading components: vec_id, component, n, deviation, whitened, explained,
    identity_error; one row a vector and component.

    Vectors that are null or hold null or non-finite entries take no part, nor do entries beyond a long
    on the grid, nor vectors of another than the most frequent length (ties: the longer). Components
    without any spread (all vectors equal, fewer distinct vectors than dimensions) aren't numbered, so
    that a table of equal vectors, of empty ones or of none gives no rows. Repeated rows and null ids
    stay; equal eigenvalues keep the order that the rotations leave. ``deviation`` is a decimal of 38
    digits. What is broadcast is the model: a square matrix of at most MOST_DIMENSIONS.
    """
    spec = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    found = fit(vectors, vec_col=vec_col)
    if found is None:
        return spark.createDataFrame([], spec)
    model, fitted = found
    k, dim, error = model.used(components), model.dim, identity_error(model, fitted, components)
    share = model.values / model.values.sum() if k else model.values
    slim = spark.sparkContext.broadcast(Model(model.n, model.sums, model.values[:k], model.vectors[:, :k]))

    def run(batches):
        held = slim.value
        for batch in batches:
            at, n, flat = grid(batch.column(1))
            fits = n == dim
            at, x = at[fits], flat[np.repeat(fits, n)].reshape(-1, dim) if dim else np.zeros((0, 0), np.int64)
            if not k or not len(at):
                continue
            rows = np.repeat(np.arange(len(at)), k)
            far = pa.array(map(str, _squares(x, held.n, held.sums)), pa.string()).take(pa.array(rows))
            part = np.tile(np.arange(k), len(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)).take(pa.array(rows)), pa.array(part + 1, pa.int32()), pa.array(np.full(len(rows), held.n)), far,
                 pa.array((held.centre(x) @ (held.vectors / np.sqrt(held.values))).ravel()), pa.array(share[part]), pa.array(np.full(len(rows), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )
        release()

    out = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("v")).mapInArrow(run, spec.replace("decimal(38,0)", "string"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))
