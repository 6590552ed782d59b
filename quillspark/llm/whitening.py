"""Whitening of embeddings from a compensated covariance.

Sums are kept in double-double: a pair of doubles whose sum is the value.
Outer products are formed in blocks by an error-free transformation: centred
blocks are cut into slices of few bits, whose products are exact in double
precision, and these are added with the exact error of each addition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, OFFSET = 1024, 100_000
#: Components of a vector must be below this in size, so that SCALE times them is a long.
LIMIT = 2.0**51
#: BLOCK rows times products of two slices of BITS bits stay below 2^53; SLICES of them hold a double-double.
BLOCK, BITS, SLICES = 1024, 21, 5
#: Partial sums are added up in so many tasks for each matrix row first.
FAN = 64
#: Components with a smaller share of the largest variance are rounding noise.
RANK = 1e-10

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Pair:
    """a + b and its exact rounding error."""
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def add(x: Pair, y: Pair) -> Pair:
    """Sum of two double-doubles."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(x: Pair) -> Pair:
    """Sum over the first axis, by halves."""
    hi, lo = x
    if not len(hi):
        return np.zeros(hi.shape[1:]), np.zeros(hi.shape[1:])
    while len(hi) > 1:
        half = len(hi) // 2
        rest = hi[2 * half :], lo[2 * half :]
        hi, lo = add((hi[:half], lo[:half]), (hi[half : 2 * half], lo[half : 2 * half]))
        hi, lo = np.concatenate([hi, rest[0]]), np.concatenate([lo, rest[1]])
    return hi[0], lo[0]


def pair(values: np.ndarray) -> Pair:
    """Longs or doubles as double-doubles, exactly."""
    hi = values.astype(np.float64)
    return hi, (values - hi.astype(np.int64)).astype(np.float64) if values.dtype == np.int64 else np.zeros_like(hi)


def mean_of(sums: list[int] | list[Fraction], n: int) -> Pair:
    """sums / n as double-doubles."""
    exact = [Fraction(s) / n for s in sums]
    hi = np.array([float(x) for x in exact])
    return hi, np.array([float(x - Fraction(h)) for x, h in zip(exact, hi.tolist(), strict=True)])


def centred(values: np.ndarray, mean: Pair) -> Pair:
    hi, lo = pair(values)
    return add((hi, lo), (-mean[0], -mean[1]))


def slices(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """Parts of BITS bits, most significant first, in units that depend on the column's largest entry."""
    _, exponent = np.frexp(np.abs(hi).max(axis=0))
    parts = []
    for k in range(1, SLICES + 1):
        anchor = np.ldexp(1.5, 52 + exponent - BITS * k)
        part = (hi + anchor) - anchor
        parts.append(part)
        hi, lo = two_sum(hi - part, lo)
    return parts


def outer_products(x: Pair) -> Pair:
    """Sum of the outer products of the rows, in double-double; pairs of slices that fall below it are left out."""
    width = x[0].shape[1]
    out = np.zeros((width, width)), np.zeros((width, width))
    for at in range(0, len(x[0]), BLOCK):
        parts = slices(x[0][at : at + BLOCK], x[1][at : at + BLOCK])
        for a in range(SLICES):
            for b in range(a, SLICES - a):
                product = parts[a].T @ parts[b]
                for exact in (product, product.T)[: 1 + (a != b)]:
                    out = add(out, (exact, np.zeros_like(exact)))
    return out


SUMS = "i int, part long, n long, hi array<double>, lo array<double>"


def sum_rows(i: list[int], part: list[int], n: list[int], x: Pair) -> pa.RecordBatch:
    lists = [pa.array(list(v), pa.list_(pa.float64())) for v in x]
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(part, pa.int64()), pa.array(n, pa.int64()), *lists], ["i", "part", "n", "hi", "lo"])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums sorted by (i, part) -> one for each, their high and low parts added."""
    own, n, held = None, 0, None
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(3)], *[batch.column(k) for k in (3, 4)], strict=True):
            its = (row[0], row[1])
            x = tuple(np.array(v.values.to_numpy()) for v in row[3:])
            if its == own:
                n, held = n + row[2], add(held, x)
                continue
            if own is not None:
                yield sum_rows([own[0]], [own[1]], [n], (held[0][None], held[1][None]))
            own, n, held = its, row[2], x
    if own is not None:
        yield sum_rows([own[0]], [own[1]], [n], (held[0][None], held[1][None]))


def merged(partial: DataFrame) -> tuple[int, Pair]:
    """Rows and sums of all tasks; partial sums are added up on the executors, in two steps, before one row for each i comes here."""
    task = F.col("part")
    some = partial.withColumn("task", task).withColumn("part", F.pmod(task, F.lit(FAN))).repartition("i", "part").sortWithinPartitions("i", "part", "task").drop("task").mapInArrow(add_up, SUMS)
    all_ = some.withColumn("task", task).withColumn("part", F.lit(0).cast("long")).repartition("i").sortWithinPartitions("i", "task").drop("task").mapInArrow(add_up, SUMS)
    rows = sorted(all_.collect(), key=lambda r: r.i)
    return (rows[0].n if rows else 0), (np.array([r.hi for r in rows]), np.array([r.lo for r in rows]))


def over_tasks(frame: DataFrame, read: Callable[[pa.Array], np.ndarray], block: Callable[[np.ndarray], Pair]) -> tuple[int, Pair]:
    """Sum of block(rows) over the vectors in the first column of ``frame``, in double-double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                values = read(batch.column(0).slice(at, BLOCK))
                x = block(values)
                n, held = n + len(values), x if held is None else add(held, x)
        if held is not None:
            task = TaskContext.get().partitionId()
            rows = held[0].reshape(-1, held[0].shape[-1]), held[1].reshape(-1, held[0].shape[-1])
            count = len(rows[0])
            yield sum_rows(list(range(count)), [task] * count, [n] * count, rows)

    return merged(frame.mapInArrow(run, SUMS))


def vectors(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), -1)


def scaled(column: pa.Array) -> np.ndarray:
    """floor(SCALE * c) + OFFSET as longs."""
    return np.floor(SCALE * vectors(column)).astype(np.int64) + OFFSET


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symmetric a = q t q' with t tridiagonal, by Householder reflections: diagonal, off-diagonal, q."""
    a, q = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        if not np.any(v[1:]):
            continue
        v /= np.abs(v).max()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z', d rising without ties, no z zero, rho positive.

    Each root lies between two poles and is found as its distance from the
    nearer, by bisection of all at once; the vectors come from the z that
    belongs to the roots as computed, so they are orthogonal.
    """
    k = len(d)
    gap = np.r_[d[1:] - d[:-1], rho * (z @ z)]
    middle = d + gap / 2
    right = 1 + rho * ((z * z)[:, None] / (d[:, None] - middle)).sum(axis=0) < 0
    right[-1] = False
    origin = np.arange(k) + right
    delta = d[:, None] - d[origin]
    sign = np.where(right, -1.0, 1.0)
    high = np.where(np.arange(k) == k - 1, gap, gap / 2)
    low = high * 1e-60
    for _ in range(100):
        mid = np.where(high > 4 * low, np.sqrt(low) * np.sqrt(high), (low + high) / 2)
        f = 1 + rho * ((z * z)[:, None] / (delta - sign * mid)).sum(axis=0)
        far = (f > 0) == (sign > 0)  # the root is nearer to the pole
        high, low = np.where(far, mid, high), np.where(far, low, mid)
    mu = sign * (low + high) / 2
    apart = delta - mu  # d[j] - root[i]
    poles = d[:, None] - d
    np.fill_diagonal(poles, -rho)
    own = np.sqrt(np.prod(apart / poles, axis=1)) * np.sign(z)
    found = own[:, None] / apart
    return d[origin] + mu, found / np.linalg.norm(found, axis=0)


def rank_one(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of q (diag(d) + rho z z') q', d rising; what the update hardly moves is deflated.

    The whole matrix has entries of up to 1, so what is below its rounding is
    deflated in small blocks, too.
    """
    d, z, q = d.copy(), z.copy(), q.copy()
    small = np.finfo(float).eps * max(0.25, 8 * np.abs(d).max(), 8 * rho * (z @ z))
    live: list[int] = []
    for i in range(len(d)):
        if rho * abs(z[i]) <= small:
            continue
        if live:
            j = live[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[i] / r, z[j] / r
            if abs(c * s * (d[i] - d[j])) <= small:
                z[i], z[j] = r, 0
                d[i], d[j] = s * s * d[j] + c * c * d[i], c * c * d[j] + s * s * d[i]
                q[:, i], q[:, j] = s * q[:, j] + c * q[:, i], c * q[:, j] - s * q[:, i]
                live[-1] = i
                continue
        live.append(i)
    if live:
        at = np.array(live)
        roots, turn = secular(d[at], z[at], rho)
        d[at], q[:, at] = roots, q[:, at] @ turn
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and the vectors of a tridiagonal matrix: halves, then a rank-one update."""
    if len(d) == 1:
        return d.copy(), np.ones((1, 1))
    m = len(d) // 2
    rho, sign = abs(e[m - 1]), np.copysign(1.0, e[m - 1])
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    (a, p), (b, q) = conquer(upper, e[: m - 1]), conquer(lower, e[m:])
    both = np.zeros((len(d), len(d)))
    both[:m, :m], both[m:, m:] = p, q
    order = np.argsort(np.r_[a, b], kind="stable")
    return rank_one(np.r_[a, b][order], np.r_[p[-1], sign * q[0]][order], rho, both[:, order])


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix."""
    if not len(a):
        return np.empty(0), np.empty((0, 0))
    scale = np.abs(a).max() or 1.0
    d, e, q = tridiagonal(a / scale)
    values, turn = conquer(d, e)
    return values[::-1] * scale, (q @ turn)[:, ::-1]


def covariance(frame: DataFrame, read: Callable[[pa.Array], np.ndarray], mean: Pair) -> np.ndarray:
    """Covariance (divisor n) of the vectors in the first column, centred before multiplying."""
    n, (hi, lo) = over_tasks(frame, read, lambda values: outer_products(centred(values, mean)))
    return np.array([[float((Fraction(h) + Fraction(x)) / n) for h, x in zip(a, b, strict=True)] for a, b in zip(hi.tolist(), lo.tolist(), strict=True)])


def whiten(rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = 8) -> tuple[DataFrame, np.ndarray, float, int, float]:
    """-> (``keep`` columns, deviation, whitened array; table in the shared folder), eigenvalues, trace, n, identity error.

    Vectors that are null, hold a null or non-finite entry or one of 2^51 or
    more in size, or are not of the most frequent length (the longest of
    these), are dropped.  The rest are the fit list; repeated rows count each
    time, and null ids stay.  At most ``components`` are returned: fewer if the
    vectors are shorter or their variance in other directions is nothing but
    rounding; none if all are equal or the table is empty.  The driver gets
    sums for each dimension, and solves for the eigenvectors of one matrix.
    """
    ok = F.size(vector).cast("int") > 0
    ok &= F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LIMIT))
    fit = rows.where(F.coalesce(ok, F.lit(False))).select(F.col(vector).alias("vector"), *[F.col(k) for k in keep])
    lengths = fit.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if lengths:
        fit = fit.where(F.size("vector") == lengths["size"])
    n, (hi, lo) = over_tasks(fit.select("vector"), scaled, lambda x: tuple(v[None] for v in total(pair(x))))
    sums = [int(h) + int(x) for h, x in zip(hi[0].tolist(), lo[0].tolist(), strict=True)] if n else []
    cov = covariance(fit.select("vector"), scaled, mean_of(sums, n)) if n else np.empty((0, 0))
    values, directions = eigen(cov)
    count = int((values[:components] > RANK * values[0]).sum()) if n and values[0] > 0 else 0
    values, turn = values[:count], directions[:, :count] / np.sqrt(values[:count]) if count else np.empty((len(cov), 0))
    own_sums = np.array(sums, object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(batch.column(0))
            most = max(map(abs, sums)) + n * int(np.abs(x).max(initial=0))
            if most**2 * len(sums) < 1 << 62:
                y = n * x - own_sums.astype(np.int64)
                deviation = pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                y = n * x.astype(object) - own_sums
                spread = (y * y).sum(axis=1).tolist() if len(y) else []
                deviation = pa.array([v if v < 10**38 else None for v in spread], pa.decimal128(38, 0))
            out = (y.astype(np.float64) / n) @ turn
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], deviation, pa.array(list(out), pa.list_(pa.float64()))], [*keep, "deviation", "whitened"])

    kinds = dict(rows.dtypes)
    projected = fit.mapInArrow(project, ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "deviation decimal(38,0)", "whitened array<double>"]))
    projected = materialise(projected.where(F.lit(count > 0)), "whitened")
    error = 0.0
    if count:
        w = projected.select("whitened")
        _, (hi, lo) = over_tasks(w, vectors, lambda x: tuple(v[None] for v in total(pair(x))))
        middle = mean_of([Fraction(h) + Fraction(x) for h, x in zip(hi[0].tolist(), lo[0].tolist(), strict=True)], n)
        error = float(np.abs(covariance(w, vectors, middle) - np.eye(count)).max())
    return projected, values, float(np.trace(cov)), n, error


def op11_whitening(rows: DataFrame) -> DataFrame:
    """The contract's result: a row for each vector of the fit list and component.

    Odd rows as in ``whiten``.  ``deviation`` is null where it exceeds a long.
    """
    projected, values, trace, n, error = whiten(rows.select("vec_id", "embedding"))
    share = F.array(*[F.lit(float(v / trace)) for v in values]) if len(values) else F.array().cast("array<double>")
    found = projected.select("vec_id", F.posexplode("whitened").alias("k", "whitened"), F.expr("try_cast(deviation AS long)").alias("deviation"))
    return found.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
