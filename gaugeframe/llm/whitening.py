"""Whitening of embeddings, its components found by FEAST contour integration.

Vectors are first put on an integer lattice (``x = floor(SCALE * c) + SHIFT``), so that equal vectors are equal exactly and counts and sums are
integers.  The fit list holds every distinct vector once: a distinct with map-side combine, so a vector that fills a third of the table leaves
each task once.  Spark sums the list into n, S and the scatter matrix, one matrix of dimension x dimension per task; only the total reaches the
driver.  Vectors are centred at the whole numbers next to the mean before they are multiplied, which keeps the sums exact integers, and the rest
of the mean, at most a half, is taken off as a rank-one term.

The components are the eigenvectors of the covariance V of the largest eigenvalues.  Bisection on inertia counts (signs of the pivots of a
symmetric factorisation of V - sigma I) finds an interval that holds exactly the wanted ones and cuts it into slices of at most ``SLICE``.  In each slice
a Gauss quadrature of complex shifted solves ``(z I - V)^-1 Y`` along a circle projects a block onto the slice's eigenvectors, Rayleigh-Ritz extracts them,
and this repeats until the residuals are at rounding level and as many Ritz values lie in the slice as the inertia counts say; else it is an error.

Defined results.  Rows whose vector is null or has a null or non-finite entry are left out, and so are those with an entry too large for the lattice
(``|SCALE * c| >= 2^62``).  The fit takes the commonest vector length (the longer of equally common ones); rows of another length, none included, come back
with null ``deviation`` and ``whitened``.  A component of zero variance cannot be whitened, so there are at most as many components as V has positive
eigenvalues; a list of one vector has none, and the result is empty, like that of an empty table.  Equal eigenvalues share a space, in which the
components are any orthogonal basis, the same one for all rows.  A ``deviation`` beyond 2^63 - 1 is null.  Rows with equal ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from gaugeframe.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
SLICE, NODES, ROUNDS = 8, 8, 60
_BIG = float(1 << 62)
_PIVOT = (1 + 17**0.5) / 8


# --- dense part: one symmetric matrix


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues below ``shift``: negative pivots of a factorisation with complete pivoting in blocks of one and two."""
    a = matrix - shift * np.eye(len(matrix))
    below = 0
    while len(a):
        d = np.abs(np.diagonal(a))
        i = int(d.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        r, s = divmod(int(off.argmax()), len(a))
        if max(d[i], off[r, s]) == 0:
            break
        block = [i] if d[i] >= _PIVOT * off[r, s] else [r, s]
        below += 1 if len(block) == 2 else int(a[i, i] < 0)  # a block of two has one eigenvalue of either sign
        rest = np.delete(np.arange(len(a)), block)
        side = a[np.ix_(rest, block)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(block, block)], side.T)
        a = (a + a.T) / 2
    return below


def _clear(matrix: np.ndarray, at: float, lo: float, hi: float) -> float:
    """A place near ``at`` inside (lo, hi) with no eigenvalue right beside it, if there is one."""
    slack = 1e-9 * (hi - lo)
    for step in range(9):
        x = at + (hi - lo) * 0.03 * ((step + 1) // 2) * (-1) ** step
        if lo < x < hi and inertia(matrix, x - slack) == inertia(matrix, x + slack):
            return x
    return at


def slices(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues in between) from the top, together holding the ``wanted`` largest (positive) eigenvalues, more only where some are equal."""
    d = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-12)
    if not top:
        return []
    floor = top * d * np.finfo(float).eps * 4
    above = {}

    def count(x: float) -> int:
        if x not in above:
            above[x] = d - inertia(matrix, x)
        return above[x]

    wanted = min(wanted, count(floor))
    lo, hi = floor, top * 1.01
    above[hi] = 0
    while count(lo) > wanted and hi - lo > 1e-13 * top:
        mid = _clear(matrix, (lo + hi) / 2, lo, hi)
        lo, hi = (mid, hi) if count(mid) >= wanted else (lo, mid)
    out, todo = [], [(lo, top * 1.01)]
    while todo:
        a, b = todo.pop()
        n = count(a) - count(b)
        if n > SLICE and b - a > 1e-9 * top:
            mid = _clear(matrix, (a + b) / 2, a, b)
            todo += [(a, mid), (mid, b)]
        elif n:
            out.append((a, b, n))
    return out


def feast(matrix: np.ndarray, low: float, high: float, held: int) -> np.ndarray:
    """Orthonormal eigenvectors of all ``held`` eigenvalues in (low, high), as columns."""
    d = len(matrix)
    block = np.random.default_rng(11).standard_normal((d, min(d, max(held + 6, 2 * held))))
    x, w = np.polynomial.legendre.leggauss(2 * NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    # the upper half circle; the lower one is its mirror image
    nodes = [(w[k] * radius * t / 2, centre + radius * t) for k, t in enumerate(np.exp(0.5j * np.pi * (1 + x)))]
    scale = np.abs(matrix).sum(axis=1).max()
    best = np.inf
    for _ in range(ROUNDS):
        projected = sum((weight * np.linalg.solve(z * np.eye(d) - matrix, block.astype(complex))).real for weight, z in nodes)
        basis, _ = np.linalg.qr(projected)
        values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ turned
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0).max(initial=0) / scale
        if inside.sum() == held and (residual < 1e-15 or (residual < 1e-12 and residual > best / 2)):  # no better by another round
            return block[:, inside]
        best = residual if inside.sum() == held else np.inf
    raise ArithmeticError(f"{int(inside.sum())} of {held} components found between {low} and {high}, residual {residual}")


def components(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit eigenvectors as columns."""
    parts = slices(matrix, wanted)
    if not parts:
        return np.zeros(0), np.zeros((len(matrix), 0))
    # vectors of neighbouring slices are made orthogonal to one another too
    basis, _ = np.linalg.qr(np.hstack([feast(matrix, *p) for p in parts]))
    values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], basis @ turned[:, order]


# --- distributed part


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: count, sums and centre of the fit list, covariance, and its largest eigenpairs."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None

    @property
    def centre(self) -> np.ndarray:
        """Whole numbers next to the mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """Mean less centre."""
        return np.array([float(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre)])

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(float) - self.rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
        away = [s - self.n * int(c) for s, c in zip(self.sums, self.centre)]
        near = x - self.centre
        if len(x) and (self.n * float(np.abs(near).max()) + max(map(abs, away))) ** 2 * len(away) < 2.0**62:
            return ((near * self.n - np.array(away)) ** 2).sum(axis=1).tolist()
        exact = [sum((int(v) * self.n - a) ** 2 for v, a in zip(row, away)) for row in near]
        return [v if v < 1 << 63 else None for v in exact]


def lattice(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows with a whole vector."""
    c = F.col(vector).cast("array<double>")
    fits = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < _BIG))
    x = F.transform(c, lambda v: F.floor(v * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long"))
    return rows.where(F.col(vector).isNotNull() & fits).select("vec_id", x.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _total(fit: DataFrame, d: int, centre: np.ndarray, project=None) -> tuple[np.ndarray, np.ndarray]:
    """Sum and scatter matrix of ``x - centre``, or of its projection, over the fit list: one small matrix a task, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = scatter = 0
        for x in _matrices(batches, d):
            y = project(x) if project else (x - centre).astype(float)
            first, scatter = first + y.sum(axis=0), scatter + y.T @ y
        if not np.isscalar(scatter):
            k = len(first)
            i, j = np.divmod(np.arange(k * (k + 1)), k)
            yield pa.record_batch([pa.array(i), pa.array(j), pa.array(np.vstack([scatter, first]).ravel())], names=["i", "j", "v"])

    cells = fit.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = max(r.j for r in cells) + 1
    out = np.zeros((k + 1, k))
    for r in cells:
        out[r.i, r.j] = r.v
    return out[k], out[:k]


def _sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Count and exact sums of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for x in _matrices(batches, d):
            wide = len(x) * float(np.abs(x).max()) >= _BIG
            part = x.astype(object).sum(axis=0) if wide else x.sum(axis=0)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, part)]
        yield pa.record_batch([pa.array(range(d + 1), pa.int64()), pa.array([Decimal(v) for v in (*total, n)], pa.decimal128(38, 0))], names=["i", "v"])

    rows = fit.mapInArrow(run, "i long, v decimal(38, 0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = {r.i: int(r.v) for r in rows}
    return found.get(d, 0), tuple(found.get(i, 0) for i in range(d))


def fit_whitening(placed: DataFrame, d: int, wanted: int = COMPONENTS) -> Whitening:
    """Fit on the distinct vectors of ``placed(x)``, all of length ``d``."""
    fit = stored(placed.select("x").distinct())
    n, sums = _sums(fit, d)
    plain = Whitening(n, sums, np.zeros((d, d)), np.zeros(0), np.zeros((d, 0)))
    scatter = _total(fit, d, plain.centre)[1]
    covariance = scatter / n - np.outer(plain.rest, plain.rest)
    covariance = (covariance + covariance.T) / 2
    values, vectors = components(covariance, wanted)
    model = Whitening(n, sums, covariance, values, vectors)
    if not len(values):
        return model
    first, second = _total(fit, d, plain.centre, model.project)
    error = np.abs(second / n - np.outer(first, first) / n**2 - np.eye(len(values))).max()
    return Whitening(n, sums, covariance, values, vectors, float(error))


def _length(placed: DataFrame) -> int | None:
    """The commonest vector length; the longer of equally common ones."""
    row = placed.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return row and row.d


def op11(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Deviation and whitened coordinates of every row with a whole vector, one result row a component."""
    placed = lattice(rows, vector)
    schema = StructType([
        rows.schema["vec_id"], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    d = _length(placed)
    model = fit_whitening(placed.where(F.size("x") == d), d) if d else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    k, explained = len(model.values), model.explained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = part["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                m = len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.record_batch([
                    part["vec_id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(each)), pa.array(model.project(x).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error))], names=schema.names)

    fitting = placed.where(F.size("x") == d).mapInArrow(run, schema)
    shares = F.array(*[F.lit(float(e)) for e in explained])
    other = placed.where(F.size("x") != d).select("vec_id", F.posexplode(shares).alias("component", "explained"))
    other = other.select(
        "vec_id", F.col("component") + 1, F.lit(model.n).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("double"), "explained",
        F.lit(model.identity_error)).toDF(*schema.names)
    return fitting.unionByName(other)
