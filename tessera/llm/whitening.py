"""Embedding whitening with principal components found by FEAST contour integration.

Every usable vector becomes a fixed-point vector x = floor(256 * c).  The fit
list holds each distinct x once.  Sums and the covariance V are added up by
Spark: a task sends one partial sum of d * d numbers, whatever its rows, so only
numbers bounded by the dimension d reach the driver.

Eigenpairs of V come from spectral slicing.  The inertia of V - s (the signs of
a symmetric pivoted elimination) counts the eigenvalues above any s; bisection
on that count cuts the top of the spectrum into intervals of a few eigenvalues.
For each interval FEAST projects a random subspace onto its invariant subspace:
a Gauss-Legendre quadrature of the circle through the interval's ends sums
solves with the complex shifted matrix z - V.  Rayleigh-Ritz on the projected
basis gives values and vectors, which start the next pass, until residuals are
at rounding level.  The solves of all intervals and quadrature points of a pass
are the rows of one Spark job.  An interval must give as many eigenvalues as its
inertia count, or the fit fails: none is missed and none is found twice.  A last
Rayleigh-Ritz over all found vectors makes them orthonormal across intervals.

Cases: null vectors, vectors with a null or non-finite entry, and vectors with
an entry of 2 ** 44 or more (whose fixed-point form is not exact) are dropped;
of vectors of different lengths those of the most frequent length are used (of
equally frequent ones the longest), empty vectors never; repeated rows are fitted once and whitened each;
null ids are kept; directions without variance (below 1e-12 of the trace) are no
components, so a single distinct vector, and an empty table, give no rows; equal
eigenvalues give any orthonormal basis of their space, the same for all rows;
deviation is null where the exact value exceeds a long; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, cut

SCALE = 256
_LIMIT = float(2 ** 44)


def fixed_point(rows: DataFrame, vec: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and x (array<long>, no nulls) of the usable rows."""
    c = F.col(vec).cast("array<double>")
    usable = F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(
        c, lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < _LIMIT), F.lit(False)))
    got = rows.where(usable).select(*keep, F.transform(c, lambda e: F.floor(e * SCALE)).alias("x"))
    sizes = got.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return got.where(F.size("x") == sizes.d) if sizes else got


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _totals(x: DataFrame, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of value(matrix of some rows): one partial sum a task, added up by Spark."""
    def run(batches: Iterator):
        total = None
        for batch in batches:
            if batch.num_rows:
                got = value(_matrix(batch.column(0)))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    got = x.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    return got.sort_values("i").v.to_numpy()


def _sums(x: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension."""
    def run(batches: Iterator):
        n, total = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # 1024 entries below 2 ** 52 add up in a long
                m = _matrix(batch.column(0).slice(at, 1024))
                part = [int(s) for s in m.sum(axis=0)]
                n, total = n + len(m), part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()),
                                              pa.array([str(s) for s in [n, *total]])], names=["i", "s"])

    got = x.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (int(got[0].s), [int(r.s) for r in got[1:]]) if got else (0, [])


# --- eigenpairs -------------------------------------------------------------


def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``v`` above ``shift``, by the inertia of v - shift.

    Symmetric elimination with complete pivoting: a pivot is the largest diagonal entry or, where an
    off-diagonal one is much larger, a two-by-two block, which has one eigenvalue of either sign.
    """
    a = v - shift * np.eye(len(v))
    above, bound = 0, (1 + 17 ** 0.5) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        i, j = np.unravel_index(np.abs(a - np.diag(np.diag(a))).argmax(), a.shape)
        if diagonal[p] >= bound * abs(a[i, j]):
            if diagonal[p] == 0:
                break  # the rest is zero: eigenvalues at the shift
            take = [p]
            above += a[p, p] > 0
        else:
            take = [int(i), int(j)]
            above += 1
        rest = np.delete(np.arange(len(a)), take)
        block = a[np.ix_(rest, take)]
        a = a[np.ix_(rest, rest)] - block @ np.linalg.solve(a[np.ix_(take, take)], block.T)
        a = (a + a.T) / 2
    return int(above)


@dataclass
class Interval:
    low: float
    high: float
    count: int


def intervals(v: np.ndarray, components: int, most: int = 6) -> list[Interval]:
    """Disjoint intervals, highest first, that hold at least the ``components`` largest eigenvalues,
    of at most ``most`` eigenvalues each unless these lie too close to be cut apart."""
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-12)
    bottom = -1e-12 * top  # v is positive semidefinite but for rounding
    tiny = 1e-10 * top
    if top == 0:
        return []
    out, todo = [], [(bottom, top, count_above(v, bottom), 0)]
    while todo:  # highest first: a range is cut until it is small enough, or not needed
        low, high, n_low, n_high = todo.pop()
        n = n_low - n_high
        if n == 0 or n_high >= components:
            continue
        if n <= most and low > 0 or high - low <= tiny:
            out.append(Interval(low, high, n))
            continue
        mid = (low + high) / 2
        n_mid = count_above(v, mid)
        todo += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]
    return out


def _solves(spark: SparkSession, v: np.ndarray, work: list[tuple[int, complex, complex, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sum of weight * (z - v)^-1 q over the quadrature points of each interval.  One Spark row a solve.

    What is sent is bounded by the dimension: v once, and d x m numbers a solve.
    """
    held = spark.sparkContext.broadcast((v, [(k, z, w, q) for k, z, w, q in work]))

    def run(batches: Iterator):
        a, tasks = held.value
        for batch in batches:
            for row in batch.column(0).to_pylist():
                _, z, w, q = tasks[row]
                y = (w * np.linalg.solve(z * np.eye(len(a)) - a, q.astype(complex))).real
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([y.tobytes()], pa.binary())],
                                                 names=["id", "y"])

    jobs = spark.range(0, len(work), 1, len(work))
    got = {r.id: r.y for r in jobs.mapInArrow(run, "id long, y binary").collect()}
    total: dict[int, np.ndarray] = {}
    for row in sorted(got):  # a fixed order of addition
        k, _, _, q = work[row]
        y = np.frombuffer(got[row]).reshape(q.shape)
        total[k] = total[k] + y if k in total else y
    held.unpersist()
    return total


def eigenpairs(spark: SparkSession, v: np.ndarray, components: int, points: int = 8, passes: int = 40,
               close: float = 2e-14) -> tuple[np.ndarray, np.ndarray]:
    """The ``components`` largest eigenvalues above rounding, falling, and their unit vectors (columns)."""
    norm = float(np.abs(v).sum(axis=1).max()) if len(v) else 0.0
    todo = dict(enumerate(intervals(v, components))) if norm else {}
    rng = np.random.default_rng(12)
    x, w = np.polynomial.legendre.leggauss(points)
    angle = np.pi * (1 - x) / 2  # the upper half of the circle; the lower half gives the conjugates
    basis = {k: rng.standard_normal((len(v), min(len(v), 2 * i.count + 6))) for k, i in todo.items()}
    values, vectors, last = [], [], dict.fromkeys(todo, np.inf)
    for _ in range(passes):
        if not todo:
            break
        work = []
        for k, i in todo.items():
            centre, radius = (i.low + i.high) / 2, (i.high - i.low) / 2
            for a, weight in zip(angle, w, strict=True):
                turn = radius * np.exp(1j * a)
                work.append((k, centre + turn, weight * turn / 2, basis[k]))
        for k, y in _solves(spark, v, work).items():
            i = todo[k]
            q, size, _ = np.linalg.svd(y, full_matrices=False)
            q = q[:, size > 1e-14 * size[0]]
            ritz, u = np.linalg.eigh(q.T @ v @ q)
            u = q @ u
            inside = (ritz > i.low) & (ritz <= i.high)
            worst = np.abs(v @ u[:, inside] - u[:, inside] * ritz[inside]).max(initial=0.0)
            settled = worst <= close * norm or worst > 0.5 * last[k] and worst <= 1e-11 * norm
            if inside.sum() == i.count and settled:
                values.append(ritz[inside])
                vectors.append(u[:, inside])
                del todo[k]
            else:
                last[k] = worst if inside.sum() == i.count else np.inf
                more = basis[k].shape[1] - u.shape[1]  # directions that the filter has emptied start anew
                basis[k] = np.hstack([u, rng.standard_normal((len(v), more))]) if more else u
    if todo:
        raise ArithmeticError(f"eigenvalues missed in {[vars(i) for i in todo.values()]}")
    if not values:
        return np.zeros(0), np.zeros((len(v), 0))
    q, _ = np.linalg.qr(np.hstack(vectors))
    e, u = np.linalg.eigh(q.T @ v @ q)
    order = [i for i in np.argsort(-e, kind="stable") if e[i] > 1e-12 * np.trace(v)][:components]
    u = q @ u[:, order]
    u = u / np.linalg.norm(u, axis=0)
    return e[order], u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)


# --- whitening --------------------------------------------------------------


@dataclass
class Whitener:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # d x components
    trace: float
    identity_error: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([s / self.n for s in self.sums])) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = 4) -> Whitener | None:
    """Fit on the distinct x of ``rows``; None without any."""
    listed = cut(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(listed)
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    d = len(sums)

    def products(x):
        c = x - mean
        return c.T @ c
    v = _totals(listed, products).reshape(d, d) / n
    v = (v + v.T) / 2
    values, vectors = eigenpairs(rows.sparkSession, v, components)
    made = Whitener(n, sums, values, vectors, float(np.trace(v)), 0.0)
    if len(values):
        k = len(values)
        centre = _totals(listed, lambda x: made.whiten(x).sum(axis=0)) / n

        def spread(x):
            c = made.whiten(x) - centre
            return c.T @ c
        made.identity_error = float(np.abs(_totals(listed, spread).reshape(k, k) / n - np.eye(k)).max())
    return made


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S) ** 2; None beyond a long."""
    most = int(np.abs(x).max()) * n + max(abs(s) for s in sums)
    if most * most * x.shape[1] < 1 << 63:
        return ((x * np.int64(n) - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * int(e) - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x)
    return [e if e < 1 << 63 else None for e in exact]


def whitened(rows: DataFrame, model: Whitener, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, deviation and w (array, one number a component) of every row with an x."""
    held = rows.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))
    kept = rows.select(*keep, "x")

    def run(batches: Iterator):
        m = Whitener(*held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.num_columns - 1))
            w = m.whiten(x)
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(deviations(x, m.n, m.sums), pa.int64()), lists],
                                             names=[*keep, "deviation", "w"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, deviation long, w array<double>")


def report(embeddings: DataFrame, vec: str = "embedding", components: int = 4) -> DataFrame:
    bounded_batches(embeddings.sparkSession)
    rows = fixed_point(embeddings, vec, ["vec_id"])
    model = fit(rows, components)
    kind = dict(embeddings.dtypes)["vec_id"]
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    got = whitened(rows, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode(F.arrays_zip(F.col("w"), explained.alias("e"))))
    return got.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                      F.col("col.w").alias("whitened"), F.col("col.e").alias("explained"),
                      F.lit(model.identity_error).alias("identity_error"))
