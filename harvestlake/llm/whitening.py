"""Whitening of embeddings by their leading covariance components, found by the Jacobi-Davidson method.

The covariance is never formed.  Spark multiplies it with a few vectors at a time: every task centres
its vectors, projects them and adds up what comes back, and only sums of that small size travel.  On the driver, which
holds vectors of one embedding's dimension and never rows, a search space is kept.  Rayleigh-Ritz picks
its best approximations; those with residuals at double precision are locked (they stay as they are and get no corrections); for the others a
correction orthogonal to all of them is found from the projected correction equations by a few
steps of MINRES, all equations at once so that one pass over the data serves all; the corrections
extend the space.  Two components more than asked for are followed, loosely, so that none is passed over.

Rows are quantised first: ``x = floor(256 * c)``.  Each distinct vector is fitted once; every row is projected.

Defined cases: rows with a null vector, null or non-finite entries, or entries whose ``x`` exceeds a
long are dropped; a vector shorter than the longest lacks entries, so it is dropped too; repeated
rows get a row each and one vote; components without variance (fewer distinct vectors than components) give
no rows; null ids stay; an empty table gives an empty result; ``deviation`` is null where it exceeds a long,
``deviation_exact`` is it as a decimal; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlake.llm.common import stored
from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

SCALE = 256
#: Vectors that are multiplied at once, and stored in one row of the fit list.
BLOCK = 4096
#: Components followed beyond those asked for, and how exact they need to be relative to the first eigenvalue.
GUARDS, LOOSE = 2, 1e-6
#: Steps of MINRES on a correction equation, columns of the search space, and rounds after which the search has failed.
INNER, SPACE, ROUNDS = 8, 40, 200
EPS = np.finfo(np.float64).eps

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of ``apply(x) = b``, one system a column, all advanced by the same products."""
    x, v_old, w, w_old = (np.zeros_like(b) for _ in range(4))
    beta = np.linalg.norm(b, axis=0)
    alive = beta > 0
    v = b / np.where(alive, beta, 1)
    eta, c, c_old, s, s_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta_old = np.zeros_like(beta)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta_old * v_old
        beta = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta_old
        rho1 = np.sqrt(delta**2 + beta**2)
        rho2, rho3 = s * alpha + c_old * c * beta_old, s_old * beta_old
        alive &= rho1 > 0
        safe = np.where(alive, rho1, 1)
        c_old, c, s_old, s = c, np.where(alive, delta / safe, 1), s, np.where(alive, beta / safe, 0)
        w_old, w = w, np.where(alive, (v - rho3 * w_old - rho2 * w) / safe, 0)
        x = x + np.where(alive, c * eta, 0) * w
        eta = np.where(alive, -s * eta, 0)
        alive &= beta > EPS * np.abs(alpha)
        v_old, v, beta_old = v, p / np.where(beta > 0, beta, 1), beta
        if not alive.any():
            break
    return x


def _orthonormal(new: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Columns that extend ``space``, without those that hardly do."""
    out = np.empty((len(new), 0))
    for t in new.T:
        size = np.linalg.norm(t)
        for _ in range(3):
            t = t - space @ (space.T @ t)
            t = t - out @ (out.T @ t)
        if size > 0 and np.linalg.norm(t) > 1e-10 * size:
            out = np.column_stack([out, t / np.linalg.norm(t)])
    return out


def leading(product: Product, dim: int, count: int, tolerance: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, unit eigenvectors and residual norms of a symmetric positive matrix that is only multiplied."""
    tolerance = tolerance or dim * EPS
    count = min(count, dim)
    follow = min(dim, count + GUARDS)
    space = _orthonormal(np.random.default_rng(7).normal(size=(dim, min(dim, 2 * follow))), np.empty((dim, 0)))
    image = product(space)
    best, stuck = np.inf, 0
    for _ in range(ROUNDS):
        h = space.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        theta, u, au = values[:follow], space @ turn[:, :follow], image @ turn[:, :follow]
        residual = au - u * theta
        size = np.linalg.norm(residual, axis=0)
        top = max(theta[0], np.finfo(float).tiny)
        limit = np.where(np.arange(follow) < count, tolerance, LOOSE) * top
        open_ = np.flatnonzero(size > limit)
        if not len(open_):
            break
        # products are sums in any order: their own rounding ends the search where it hides what is left
        worst = (size / limit).max()
        best, stuck = (worst, 0) if worst < 0.7 * best else (best, stuck + 1)
        if stuck >= 5 and (size / limit < 50).all():
            break
        if space.shape[1] + len(open_) > min(SPACE, dim):
            keep = turn[:, : min(2 * follow, space.shape[1])]
            space, image = space @ keep, image @ keep
        shift = theta[open_]

        def outside(t: np.ndarray, u: np.ndarray = u) -> np.ndarray:
            return t - u @ (u.T @ t)

        step = minres(lambda t, shift=shift, outside=outside: outside(product(t) - t * shift), outside(-residual[:, open_]), INNER)
        more = _orthonormal(np.column_stack([step, residual[:, open_]]), space)[:, : max(0, min(SPACE, dim) - space.shape[1])]
        if not more.shape[1]:
            if (size / limit < 1000).all():
                break
            more = _orthonormal(np.random.default_rng(8).normal(size=(dim, 1)), space)
        space, image = np.column_stack([space, more]), np.column_stack([image, product(more)])
    else:
        raise RuntimeError(f"no convergence after {ROUNDS} rounds: residuals {size}")
    return theta[:count], u[:, :count], size[:count]


def quantised(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id`` and ``x`` (little-endian longs) of the rows that are kept, and the dimension."""
    entry = F.lit(float(1 << 63) / SCALE)
    sound = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (c.cast("double") >= -entry) & (c.cast("double") < entry), F.lit(False)))
    kept = rows.where(F.col(vector).isNotNull() & sound).select("vec_id", F.col(vector).cast("array<double>").alias("vector"))
    dim = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    kept = kept.where(F.size("vector") == dim)

    def run(batches):
        for batch in batches:
            c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            x = np.floor(SCALE * c).astype("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "x"])

    if not dim:
        return kept.limit(0).select("vec_id", F.lit(None).cast("binary").alias("x")), 0
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x binary"
    return kept.mapInArrow(run, schema), dim


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    raw = batch.column(batch.schema.get_field_index("x"))
    return np.frombuffer(b"".join(raw.to_pylist()), "<i8").reshape(-1, dim)


def _added(fit: DataFrame, dim: int, work, add, tasks: int):
    """``work`` over blocks of the fit list, added up in the tasks, then by some of them, then here: arrays of a fixed shape."""

    def part(batches):
        total = None
        for batch in batches:
            x = _vectors(batch, dim)
            for at in range(0, len(x), BLOCK):
                got = work(x[at : at + BLOCK])
                total = got if total is None else add(total, got)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def fold(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                got = np.frombuffer(raw, kind)
                total = got if total is None else add(total, got)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    kind = work(np.zeros((1, dim), np.int64)).dtype
    parts = fit.mapInArrow(part, "part binary")
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(fold, "part binary")
    total = None
    for r in parts.collect():
        got = np.frombuffer(r["part"], kind)
        total = got if total is None else add(total, got)
    return total


def _carried(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of whole numbers given as upper and lower halves, the lower below 2^32."""
    total = (a + b).reshape(-1, 2)
    return np.column_stack([total[:, 0] + (total[:, 1] >> 32), total[:, 1] & 0xFFFFFFFF]).ravel()


def _halves(x: np.ndarray) -> np.ndarray:
    rows = np.column_stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
    rows = np.vstack([rows, [[0, len(x)]]])
    return _carried(rows.ravel(), np.zeros(rows.size, np.int64))


def whiten(rows: DataFrame, count: int = 4, vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of every kept row and component, largest first."""
    kept, dim = quantised(rows, vector)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, deviation_exact string, whitened double, explained double, identity_error double"
    if not dim:
        return rows.sparkSession.createDataFrame([], schema)
    fit = stored(kept.select("x").distinct(), "fit-list")
    size = fit.count()
    tasks = 8 * dim * size // (64 << 20) + 1

    halves = _added(fit, dim, _halves, _carried, tasks).reshape(-1, 2)
    whole = [(int(hi) << 32) + int(lo) for hi, lo in halves]
    sums, n = whole[:-1], whole[-1]
    mean = np.array([s / n for s in sums])

    def product(t: np.ndarray) -> np.ndarray:
        def work(x):
            centred = x - mean
            return (centred.T @ (centred @ t)).ravel()

        return _added(fit, dim, work, np.add, tasks).reshape(dim, -1) / n

    values, vectors, _ = leading(product, dim, count)
    real = values > dim * EPS * max(values[0], np.finfo(float).tiny)
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    turn = vectors / np.sqrt(values)

    def moments(x):
        centred = x - mean
        w = centred @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0), [np.square(centred).sum()]])

    got = _added(fit, dim, moments, np.add, tasks) / n
    spread, middle, trace = got[: k * k].reshape(k, k), got[k * k : -1], float(got[-1])
    identity = float(np.abs(spread - np.outer(middle, middle) - np.eye(k)).max())
    explained = values / trace

    def project(batches):
        for batch in batches:
            x = _vectors(batch, dim)
            rows_ = len(x)
            if not rows_:
                continue
            exact = deviations(x, n, sums)
            long = [v if v < 1 << 63 else None for v in exact]
            w = (x - mean) @ turn
            each = pa.array(np.repeat(np.arange(rows_), k))
            cols = [
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * k, n, np.int64)),
                pa.array(long, pa.int64()).take(each), pa.array([str(v) for v in exact], pa.string()).take(each), pa.array(w.ravel()),
                pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * k, identity)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(project, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exact."""
    reach = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums))
    if reach * reach * x.shape[1] < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(sums, object)
    return (y * y).sum(axis=1).tolist()
