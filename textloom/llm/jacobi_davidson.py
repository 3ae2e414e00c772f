"""Operator 13, embedding whitening by the Jacobi-Davidson method.

The covariance matrix is never formed. A product of it with a few vectors is one Spark job: each task takes the mean from its rows, multiplies, and gives the sum of its part;
partial sums are added up by Spark and only the product, one row for each dimension, reaches the driver. There live a search space of at most ``SPACE`` vectors and their products.

Each round takes the Ritz pairs of the search space (Rayleigh-Ritz), locks the leading ones whose residuals have reached double precision, and widens the space by
the solutions of the others' correction equations, projected off the locked and the current vectors and solved roughly by MINRES. All open components are worked
on at once, so a step of MINRES costs one job for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vector_rows

COMPONENTS = 4
#: Components beyond those asked for that are worked on as well, steps of MINRES in a round, vectors of the search space, rounds at most.
GUARD, STEPS, SPACE, ROUNDS = 2, 5, 48, 60
#: A residual has reached double precision at this many units of rounding of the largest eigenvalue, times the root of the dimension.
ULPS = 4
#: Eigenvalues at or below this share of the variance count as none.
NOTHING = 1e-13

Product = Callable[[np.ndarray], np.ndarray]


class Fit:
    """The distinct vectors in blocks, written; their number and exact sums by dimension."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]) -> None:
        self.blocks, self.n, self.sums = blocks, n, sums

    @property
    def dimension(self) -> int:
        return len(self.sums)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exactly n * x - sums, as longs, or as integers of any size where longs may not hold them or their squares' sum."""
    most = n * vector_rows.largest(x) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def fit_list(vectors: DataFrame) -> Fit:
    """From x (arrays of longs): each distinct one once, shorter ones filled up with zeros."""
    d = vectors.agg(F.max(F.size("x")).alias("d")).first().d or 0
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
    once = vectors.select(padded.alias("x")).groupBy("x").agg(F.lit(1).alias("one"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in vector_rows.runs(batches, "x"):
            # Sums of the halves of each number: neither can overflow in a block.
            high, low = x >> 32, x & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([high.sum(0).tolist()], pa.list_(pa.int64())), pa.array([low.sum(0).tolist()], pa.list_(pa.int64())), pa.array([vector_rows.frozen(x)], pa.binary())], ["n", "high", "low", "x"])

    blocks = common.written(once.select("x").mapInArrow(pack, "n long, high array<long>, low array<long>, x binary"), "whiten-fit")
    n = blocks.agg(F.sum("n").alias("n")).first().n or 0
    halves = F.posexplode(F.arrays_zip("high", "low")).alias("i", "s")
    whole = blocks.select(halves).groupBy("i").agg(F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low"))
    sums = [0] * d
    for r in whole.collect():
        sums[r.i] = (int(r.high) << 32) + int(r.low)
    return Fit(blocks.select("x"), n, sums)


def _summed(fit: Fit, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all vectors of the fit list of what ``part`` gives for a block of x - mean: an array with ``width`` columns. Blocks of a task are added up there."""
    n, sums = fit.n, fit.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for data in (x for b in batches for x in b.column("x").to_pylist()):
            own = part(centred(vector_rows.thawed(data), n, sums).astype(np.float64) / n)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *[pa.array(total[:, k]) for k in range(width)]], ["i", *[f"c{k}" for k in range(width)]])

    found = fit.blocks.mapInArrow(run, ", ".join(["i int", *[f"c{k} double" for k in range(width)]]))
    rows = found.groupBy("i").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)]).collect()
    return np.array([list(r)[1:] for r in sorted(rows, key=lambda r: r.i)], np.float64).reshape(len(rows), width)


def products(fit: Fit) -> Product:
    """The covariance matrix as a function that multiplies it with the columns of an array, in one job."""

    def times(v: np.ndarray) -> np.ndarray:
        return _summed(fit, lambda c: c.T @ (c @ v), v.shape[1]) / fit.n

    return times


def variance(fit: Fit) -> float:
    """The trace of the covariance matrix."""
    return float(_summed(fit, lambda c: np.array([[np.square(c).sum()]]), 1)[0, 0]) / fit.n


def _off(space: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``v`` without its part in ``space``, an orthonormal basis; twice, since once leaves rounding behind."""
    for _ in range(2):
        v = v - space @ (space.T @ v)
    return v


def _added(space: np.ndarray, v: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``v`` add to ``space``."""
    out = np.zeros((len(v), 0))
    for k in range(v.shape[1]):
        length = np.linalg.norm(v[:, k])
        if length == 0 or not np.isfinite(length):
            continue
        own = _off(out, _off(space, v[:, k] / length)[:, None] if space.shape[1] else v[:, k : k + 1] / length)
        own = _off(space, own)
        left = np.linalg.norm(own)
        if left > 1e-10:
            out = np.hstack((out, own / left))
    return out


def minres(times: Product, shifts: np.ndarray, right: np.ndarray, space: np.ndarray, steps: int) -> np.ndarray:
    """Rough solutions t of P (A - shift) P t = right, a column for each shift, P projecting off ``space``: ``steps`` steps of MINRES for all columns at once, a product each."""
    b = _off(space, right)
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    open_ = beta > 0
    v_old, v = np.zeros_like(b), b / np.where(open_, beta, 1)
    d_old, d_older = np.zeros_like(b), np.zeros_like(b)
    c, s, c_old, s_old = np.ones(len(beta)), np.zeros(len(beta)), np.ones(len(beta)), np.zeros(len(beta))
    eta, beta_now = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        if not open_.any():
            break
        w = _off(space, times(v) - v * shifts) - v_old * beta_now
        alpha = (v * w).sum(0)
        w = w - v * alpha
        beta_next = np.linalg.norm(w, axis=0)
        # Rotations of the last two steps on the new column of the tridiagonal matrix, then a new one.
        far, near, here = s_old * beta_now, c * c_old * beta_now + s * alpha, c * alpha - s * c_old * beta_now
        rho = np.hypot(here, beta_next)
        good = open_ & (rho > 0)
        safe = np.where(good, rho, 1)
        c_old, s_old = c, s
        c, s = np.where(good, here / safe, 1), np.where(good, beta_next / safe, 0)
        d = np.where(good, (v - d_old * near - d_older * far) / safe, 0)
        x = x + d * np.where(good, c * eta, 0)
        eta = -s * eta
        d_older, d_old = d_old, d
        open_ = good & (beta_next > 1e-14 * np.maximum(beta, 1e-300))
        v_old, v, beta_now = v, np.where(open_, w / np.where(open_, beta_next, 1), 0), beta_next
    return _off(space, x)


def leading(times: Product, dimension: int, k: int = COMPONENTS, seed: int = 42, trace: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, residuals) of the ``k`` largest eigenvalues of a symmetric positive matrix given by its products, falling.

    At most ``dimension`` of them. Ends when every residual has reached double precision, or can't be lowered further: rounding of the products sets that limit.
    """
    k = min(k, dimension)
    at_once = min(k + GUARD, dimension)
    space_size = min(dimension, max(SPACE, 3 * at_once))
    rng = np.random.default_rng(seed)
    locked, values, left = np.zeros((dimension, 0)), [], []
    space = _added(locked, rng.standard_normal((dimension, at_once)))
    image = times(space)
    best, idle = math.inf, 0
    for _ in range(ROUNDS):
        # Rayleigh-Ritz in the search space, which stays orthogonal to what is locked.
        theta, y = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = space @ y, image @ y
        n = min(at_once, len(theta))
        residual = _off(locked, au[:, :n] - u[:, :n] * theta[:n])
        size = np.linalg.norm(residual, axis=0)
        scale = max([abs(v) for v in (*values, theta[0])], default=0.0)
        enough = ULPS * np.finfo(float).eps * max(scale, NOTHING * (trace or 0)) * math.sqrt(dimension)
        need = k - len(values)
        worst = float(size[: min(need, n)].max(initial=0))
        idle = idle + 1 if worst > 0.5 * best else 0
        best = min(best, worst)
        done = 0
        while done < min(need, n) and (size[done] <= enough or idle >= 4 and size[done] <= 1e4 * enough):
            done += 1
        if done:  # lock, and go on with the rest of the space
            locked = np.hstack((locked, _added(locked, u[:, :done])))
            values, left = values + theta[:done].tolist(), left + size[:done].tolist()
            best, idle = math.inf, 0
        if len(values) >= k:
            break
        u, au, theta, residual = u[:, done:], au[:, done:], theta[done:], residual[:, done:]
        room = space_size - len(values)
        if u.shape[1] + residual.shape[1] > room:  # restart with the best part of the space
            keep = max(2 * at_once, room // 2)
            u, au = u[:, :keep], au[:, :keep]
        t = residual.shape[1]
        if u.shape[1] >= dimension - len(values):  # the space is whole: its Ritz vectors are as good as its products; work them out anew
            space = _added(locked, u)
            image = times(space)
            continue
        ground = np.hstack((locked, u[:, :t]))
        step = minres(times, theta[:t], -residual, ground, min(STEPS, max(1, dimension - ground.shape[1]))) if t and ground.shape[1] < dimension else np.zeros((dimension, 0))
        own = _off(locked, u)
        space = np.linalg.qr(own)[0] if own.shape[1] else own
        image = _moved(own, au, space)
        new = _added(np.hstack((locked, space)), np.hstack((step, residual)) if step.size else residual)
        new = new[:, : max(1, min(at_once, dimension - len(values) - space.shape[1]))]
        if not new.shape[1]:
            new = _added(np.hstack((locked, space)), rng.standard_normal((dimension, 1)))
        if new.shape[1]:
            space, image = np.hstack((space, new)), np.hstack((image, times(new)))
    else:
        raise ArithmeticError(f"residuals {size} after {ROUNDS} rounds, {enough} wanted")
    # A last Rayleigh-Ritz step over all that is locked, on fresh products.
    image = times(locked)
    theta, y = np.linalg.eigh((locked.T @ image + image.T @ locked) / 2)
    theta, y = theta[::-1], y[:, ::-1]
    u = locked @ y
    u /= np.linalg.norm(u, axis=0)
    return theta, u, np.linalg.norm(image @ y - u * theta, axis=0)


def _moved(own: np.ndarray, image: np.ndarray, space: np.ndarray) -> np.ndarray:
    """The image of ``space``, a basis of the columns of ``own``, from theirs."""
    return np.linalg.solve((space.T @ own).T, image.T).T


def _projected(vectors: DataFrame, fit: Fit, directions: np.ndarray, values: np.ndarray) -> DataFrame:
    """(row, deviation, whitened: an array by component) of rows (row, x)."""
    n, sums, d = fit.n, fit.sums, fit.dimension
    kind = vectors.schema["row"].dataType.simpleString()
    root = np.sqrt(np.where(values > 0, values, np.nan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in vector_rows.runs(batches, "x"):
            c = centred(vector_rows.widened(x, d), n, sums)
            deviation = [min(int(s), (1 << 63) - 1) for s in np.square(c).sum(1)]
            w = (c.astype(np.float64) / n) @ directions / root
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(deviation, pa.int64()), pa.array([[None if math.isnan(v) else v for v in r] for r in w.tolist()], pa.list_(pa.float64()))], ["row", "deviation", "whitened"])

    return vectors.mapInArrow(run, f"row {kind}, deviation long, whitened array<double>")


def identity_error(fit: Fit, directions: np.ndarray, values: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance, centred before multiplying, minus the identity."""
    k = len(values)
    scaled = directions / np.sqrt(values)
    mean = _summed(fit, lambda c: (c @ scaled).sum(0)[None, :], k)[0] / fit.n

    def part(c: np.ndarray) -> np.ndarray:
        w = c @ scaled - mean
        return w.T @ w

    return float(np.abs(_summed(fit, part, k) / fit.n - np.eye(k)).max(initial=0))


def whitened(df: DataFrame, vector: str, k: int = COMPONENTS, unit: int = 256, seed: int = 42) -> DataFrame:
    """``row`` (all columns), component (from 1), n, deviation, whitened, explained, identity_error and residual of every usable row and each of the first ``k`` components.

    Rows whose vector is null or has an entry that is null or not finite are dropped; an empty vector is a row without entries. Entries become floor(unit * entry); a shorter vector counts as filled
    up with zeros; a deviation beyond a long is its largest value. Repeated vectors count once in the fit, each row gets its result. There are at most as many
    components as dimensions. One that explains nothing, as where all vectors are equal, has a null ``whitened`` and left out of identity_error (0 where none is left); explained is then 0.
    Extra columns, clashing names included, stay in ``row``. An empty table gives an empty table.
    """
    rows = df.where(vector_rows.usable(F.col(f"`{vector}`"))).select(F.struct("*").alias("row"), vector_rows.whole(F.col(f"`{vector}`"), unit).alias("x"))
    rows = common.written(rows, "whiten-rows")
    fit = fit_list(rows.select("x"))
    total = variance(fit) if fit.n and fit.dimension else 0.0
    if total > 0:
        values, directions, residuals = leading(products(fit), fit.dimension, k, seed, total)
    else:
        d = min(k, fit.dimension)
        values, directions, residuals = np.zeros(d), np.eye(fit.dimension, d), np.zeros(d)
    values = np.where(values > NOTHING * total, values, 0.0)
    some = values > 0
    error = identity_error(fit, directions[:, some], values[some]) if some.any() else 0.0
    facts = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.lit(float(values[c]) / total if total else 0.0).alias("explained"), F.lit(float(values[c])).alias("eigenvalue"), F.lit(float(residuals[c])).alias("residual")) for c in range(len(values))]) if len(values) else F.array().cast("array<struct<component: int, explained: double, eigenvalue: double, residual: double>>")
    each = _projected(rows, fit, directions, values).select("row", "deviation", F.explode(F.arrays_zip(facts.alias("f"), F.col("whitened").alias("w"))).alias("p"))
    return each.select("row", "p.f.component", F.lit(fit.n).cast("long").alias("n"), "deviation", F.col("p.w").alias("whitened"), "p.f.explained", F.lit(error).alias("identity_error"), "p.f.eigenvalue", "p.f.residual")


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id and the columns of ``whitened`` for every usable row of (vec_id, embedding); a null vec_id stays."""
    out = whitened(embeddings.select("vec_id", "embedding"), "embedding")
    return out.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue", "residual")
