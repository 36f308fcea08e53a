"""Whitening of integer vectors by an incremental eigendecomposition.

Each task goes through its vectors one by one and keeps the spectrum of their scatter: eigenvalues, eigenvectors, count and
mean. A further vector changes the scatter by one centred rank-one term, count / (count + 1) * d * d' with d its distance
from the mean, which moves each eigenvalue to the next root of a secular equation. Entries of d that are next to nothing in
the basis, and all but one of equal eigenvalues, are deflated: they stay as they are. New eigenvectors follow from roots and
poles alone, with weights recomputed from the roots (Gu and Eisenstat, 1994), which keeps them orthogonal.

Spectra of tasks are combined pairwise along a tree: the smaller one's eigenvectors, scaled, and the distance of the two
means are further rank-one terms for the larger one. Last comes one Rayleigh-Ritz step over all rows: the covariance in
the found basis, a matrix of (dimensions x dimensions) summed along the same kind of tree, is diagonalised, which takes
the rounding errors of all updates away. Sums of components are exact integers all the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import durable

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
MOST_DIMENSIONS = 4_096  # a basis of so many squared doubles, 134 MB, is shipped to the tasks; more is an error
FAN = 16  # spectra or matrices combined at a time
EPS = np.finfo(np.float64).eps
NO_VARIANCE = 1e-12  # share of all variance below which a component has none
ROWS = 4_096  # vectors multiplied at a time

STATE = "part long, n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"


def roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> np.ndarray:
    """Distances (poles, roots): each pole minus each root of 1 + rho * sum(weights**2 / (pole - x)) = 0.

    Poles ascend strictly, no weight is zero, rho is positive; root j lies between poles j and j + 1, the last one
    below the last pole + rho * |weights|**2. Steps fit two simple poles to the function; a step that leaves the known bounds
    is replaced by halving them.
    """
    k = len(poles)
    square = weights * weights
    if k == 1:
        return -np.array([[rho * square[0]]])
    reach = rho * square.sum()
    ends = np.append(poles[1:], poles[-1] + reach)
    gap = ends - poles
    middle = poles + gap / 2
    value = 1 / rho + (square[:, None] / (poles[:, None] - middle[None, :])).sum(axis=0)
    # measured from the nearer pole, so that no digits are lost; the last root from the last pole
    upper = (value < 0) & (np.arange(k) < k - 1)
    origin = np.where(upper, ends, poles)
    away = poles[:, None] - origin[None, :]
    low, high = np.where(upper, -gap / 2, 0.0), np.where(upper, 0.0, np.where(np.arange(k) < k - 1, gap / 2, gap))
    last_low = value[-1] < 0  # the last root may lie in the upper half, too
    if last_low:
        low[-1] = gap[-1] / 2
    elif k:
        high[-1] = gap[-1] / 2
    x = low + (high - low) / 2
    under = np.arange(k)[:, None] <= np.arange(k)[None, :]
    for _ in range(80):
        distance = away - x[None, :]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            parts = square[:, None] / distance
            slopes = parts / distance
            f = 1 / rho + parts.sum(axis=0)
            size = 1 / rho + np.abs(parts).sum(axis=0)
            low, high = np.where(f <= 0, x, low), np.where(f > 0, x, high)
            left = np.where(under, slopes, 0.0).sum(axis=0)
            right = slopes.sum(axis=0) - left
            near = np.diagonal(distance)
            far = np.append(np.diagonal(distance, -1), near[-1] + 2 * reach)
            c = f - near * left - far * right
            a = (near + far) * f - near * far * (left + right)
            b = near * far * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        if (np.abs(f) <= 8 * k * EPS * size).all() or (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))).all():
            break
        new = x + step
        bad = ~np.isfinite(new) | (new <= low) | (new >= high)
        new = np.where(bad, low + (high - low) / 2, new)
        x = np.where(np.abs(f) <= 2 * EPS * size, x, new)
    return away - x[None, :]


def updated(values: np.ndarray, vectors: np.ndarray, term: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending eigenvalues, eigenvectors in columns) after adding rho * term * term'."""
    z = term @ vectors
    length = np.sqrt(z @ z)
    if not rho > 0 or not length > 0:
        return values, vectors
    scale = max(abs(values[-1]), rho * length * length)
    close = 8 * EPS * scale
    z = z / length
    rho = rho * length * length
    # equal eigenvalues: turn their eigenvectors so that the term lies along the last one only
    starts = np.flatnonzero(np.append(True, np.diff(values) > close))
    if len(starts) < len(values):
        vectors = vectors.copy()
        for a, b in zip(starts, np.append(starts[1:], len(values)), strict=True):
            part = z[a:b]
            norm = np.sqrt(part @ part)
            if b - a > 1 and norm > 0:
                mirror = part.copy()
                sign = 1.0 if mirror[-1] >= 0 else -1.0
                mirror[-1] += sign * norm
                block = vectors[:, a:b]
                vectors[:, a:b] = block - np.outer(block @ mirror, mirror * (2 / (mirror @ mirror)))
                z[a:b] = 0.0
                z[b - 1] = -sign * norm
    moving = np.flatnonzero(rho * np.abs(z) > close)
    if not len(moving):
        return values, vectors
    poles = values[moving]
    distance = roots(poles, z[moving], rho)  # (poles, roots)
    # the weights for which the computed roots are exact
    k = len(poles)
    spread = poles[:, None] - poles[None, :]
    np.fill_diagonal(spread, 1.0)
    ratio = distance / spread
    np.fill_diagonal(ratio, -np.diagonal(distance))
    weights = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(z[moving])
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = weights[:, None] / distance
    exact = ~np.isfinite(inner).all(axis=0)  # a root that fell on its pole
    if exact.any():
        inner[:, exact] = 0.0
        inner[np.flatnonzero(exact), np.flatnonzero(exact)] = 1.0
    inner /= np.sqrt((inner * inner).sum(axis=0))
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[moving] = poles - np.diagonal(distance)
    new_vectors[:, moving] = vectors[:, moving] @ inner
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and scatter spectrum of some vectors."""

    def __init__(self, size: int):
        self.n, self.sums = 0, np.zeros(size, dtype=object)
        self.mean, self.values, self.vectors = np.zeros(size), np.zeros(size), np.eye(size)

    def add(self, rows: np.ndarray) -> None:
        """Take further vectors, a matrix of whole numbers. Equal ones among them are one term of that weight."""
        small = int(np.abs(rows).max(initial=0)) * max(1, len(rows)) < 1 << 62
        self.sums = self.sums + (rows.sum(axis=0) if small else rows.astype(object).sum(axis=0)).astype(object)
        distinct, times = np.unique(rows, axis=0, return_counts=True)
        for row, count in zip(distinct.astype(np.float64), times, strict=True):
            distance = row - self.mean
            if self.n:
                weight = self.n * count / (self.n + count)
                self.values, self.vectors = updated(self.values, self.vectors, distance, weight)
            self.mean = self.mean + distance * (count / (self.n + count))
            self.n += int(count)

    def merge(self, other: Spectrum) -> Spectrum:
        """The spectrum of both; successive rank-one terms of the smaller one go to the larger one."""
        big, small = (self, other) if self.n >= other.n else (other, self)
        if small.n:
            for value, vector in zip(small.values, small.vectors.T, strict=True):
                if value > 0:
                    big.values, big.vectors = updated(big.values, big.vectors, vector, float(value))
            distance, n = small.mean - big.mean, big.n + small.n
            big.values, big.vectors = updated(big.values, big.vectors, distance, big.n * small.n / n)
            big.mean = big.mean + distance * (small.n / n)
            big.sums, big.n = big.sums + small.sums, n
        return big

    def batch(self, part: int) -> pa.RecordBatch:
        one = {
            "part": [part], "n": [self.n], "sums": [[int(s) for s in self.sums]], "mean": [self.mean.tolist()],
            "values": [self.values.tolist()], "vectors": [self.vectors.reshape(-1).tolist()],
        }
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one.values(), types, strict=True)], names=list(one))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(SCALE * c) + SHIFT of every entry c, for rows whose vector is whole.

    Rows with a null or empty vector, or with a null, NaN or infinite entry, are left out. Entries beyond the range of
    long are an error.
    """
    whole = (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    entry = lambda c: (F.floor(c * SCALE) + SHIFT).cast("long")
    return rows.where(F.col("v").isNotNull() & whole).select("vec_id", F.transform("v", entry).alias("x"))


def _spectra(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(size)
        for batch in batches:
            if batch.num_rows:
                spectrum.add(_matrix(batch.column("x")))
        if spectrum.n:
            yield spectrum.batch(TaskContext.get().partitionId())

    return run


def _combined(states: pa.Table) -> pa.Table:
    states = states.sort_by("part")
    total = None
    for row in states.to_pylist():
        one = Spectrum(len(row["mean"]))
        one.n, one.sums, one.mean = row["n"], np.array(row["sums"], dtype=object), np.array(row["mean"])
        one.values, one.vectors = np.array(row["values"]), np.array(row["vectors"]).reshape(len(one.mean), -1)
        total = one if total is None else total.merge(one)
    return pa.Table.from_batches([total.batch(states["part"][0].as_py() // FAN)])


def _added(parts: pa.Table) -> pa.Table:
    """Matrices summed."""
    parts = parts.sort_by("part")
    total = _matrix(parts["matrix"].combine_chunks()).sum(axis=0)
    one = [pa.array([parts["part"][0].as_py() // FAN]), pa.array([total.tolist()], pa.list_(pa.float64()))]
    return pa.table(one, names=["part", "matrix"])


def _up_a_tree(states: DataFrame, combine, schema: str):
    """The one row that is left when rows (part, ...) are combined FAN at a time; None if there are none."""
    states = durable(states)
    most = states.agg(F.max("part")).first()[0]
    if most is None:
        return None
    while True:
        states = durable(states.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(
            lambda t: combine(t.drop_columns(["group"]) if "group" in t.column_names else t), schema
        ))
        most //= FAN
        if not most:
            return states.first()


def _products(basis: np.ndarray, sums: np.ndarray, n: int):
    """Sum over a task's vectors of the products of their centred coordinates in the basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                inner = centred(_matrix(batch.column("x").slice(at, ROWS)), sums, n) @ basis
                total += inner.T @ inner
        one = [pa.array([TaskContext.get().partitionId()]), pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(one, names=["part", "matrix"])

    return run


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """n * x - sums, exact: as 64-bit numbers if they are large enough, else as Python's."""
    most = max(int(np.abs(x).max(initial=0)) * n, max((abs(int(s)) for s in sums), default=0))
    if most < 1 << 61:
        return x.astype(np.int64) * np.int64(n) - np.array([int(s) for s in sums], dtype=np.int64)
    return x.astype(object) * n - sums


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - sums / n, rounded once."""
    return deviations(x, sums, n).astype(np.float64) / n


def exact_squares(d: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    most = int(np.abs(d).max(initial=0))
    if most * most * max(1, d.shape[1]) < 1 << 63:
        d = d.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in d]


def _whitened(axes: np.ndarray, sums: np.ndarray, n: int, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                d = deviations(_matrix(part.column("x")), sums, n)
                flat = (d.astype(np.float64) / n) @ axes
                width = axes.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * width, pa.int32()), pa.array(flat.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(exact_squares(d), pa.int64()), lists], names=schema_names
                )

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    ``vectors`` (vec_id, x) are whole numbers, as ``quantised`` gives them. Components are numbered from 1 by falling
    eigenvalue e of the covariance of all vectors. ``whitened`` is the centred vector along the component over sqrt(e),
    ``explained`` e over all variance, ``deviation`` the exact sum of (n * x - sum)**2 over dimensions, and
    ``identity_error`` the largest entry of the whitened vectors' covariance minus the identity. A component
    without variance (fewer vectors than dimensions, constant dimensions, one vector) has null ``whitened`` and takes no part
    in ``identity_error``. Repeated rows count as often as they occur; a row without vec_id takes part with a null id. No
    vectors give no rows. Vectors of different lengths, more than MOST_DIMENSIONS, and a deviation beyond long are errors.
    """
    spark = vectors.sparkSession
    rows = durable(vectors.select("vec_id", "x"))
    shortest, longest = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    out = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if shortest is None:
        return spark.createDataFrame([], out)
    if shortest != longest or longest > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {shortest} to {longest} entries")
    state = _up_a_tree(rows.select("x").mapInArrow(_spectra(longest), STATE), _combined, STATE)
    n, sums = state["n"], np.array(state["sums"], dtype=object)
    basis, _ = np.linalg.qr(np.array(state["vectors"]).reshape(longest, longest)[:, ::-1])

    def covariance(axes):
        matrix = _up_a_tree(rows.select("x").mapInArrow(_products(axes, sums, n), "part long, matrix array<double>"), _added, "part long, matrix array<double>")
        return np.array(matrix["matrix"]).reshape(axes.shape[1], -1) / n

    inside = covariance(basis)
    found, turn = np.linalg.eigh((inside + inside.T) / 2)
    found, turn = found[::-1], turn[:, ::-1]
    trace = float(np.trace(inside))
    listed = min(components, longest)
    real = int((found[:listed] > NO_VARIANCE * trace).sum()) if trace > 0 else 0
    axes = basis @ turn[:, :real] / np.sqrt(found[:real])
    error = float(np.abs(covariance(axes) - np.eye(real)).max()) if real else 0.0
    explained = [float(max(e, 0.0) / trace) if trace > 0 else 0.0 for e in found[:listed]]
    per_row = rows.mapInArrow(
        _whitened(axes, sums, n, ["vec_id", "deviation", "w"]), "vec_id long, deviation long, w array<double>"
    )
    shares = F.array(*[F.lit(e) for e in explained])
    each = per_row.select("vec_id", "deviation", "w", F.explode(F.sequence(F.lit(1), F.lit(listed))).alias("component"))
    return each.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation",
        F.get("w", F.col("component") - 1).alias("whitened"), F.element_at(shares, F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
