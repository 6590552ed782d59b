"""Whitening against exact fractions, hard negatives against brute force."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import negatives, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, row string, part int, n long, whitened int"
nan, inf = float("nan"), float("inf")


def vectors(count: int = 300, width: int = 12, seed: int = 3) -> list[tuple]:
    """Unequal spreads, ties, repeated rows and ids, and rows that take no part."""
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(count, width)) * np.linspace(0.2, 1, width), 2)
    x[40:60] = x[40]
    rows = [(k * 5, v.tolist(), int(draw.integers(0, 4))) for k, v in enumerate(x)]
    odd = [(7, None, 1), (8, [None] * width, 1), (50, [nan] * width, 1), (100, [0.1] * (width - 1) + [inf], 1), (9, [], 1), (11, [1.0, 2.0], 1), (None, x[3].tolist(), 2), (150, x[4].tolist(), None)]
    return [(*r, "x", 1, 1, 1) for r in rows + odd + rows[:7]]


def fit_list(rows, width=12):
    ok = lambda v: v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)
    return [r for r in rows if ok(r[1])]


# 11 ---------------------------------------------------------------------


def check_whitening(found, fit, components=8):
    """Against exact sums: n, deviations, projections on the eigenvectors of the exact covariance, shares."""
    x = np.array([[int(math.floor(1024 * float(np.float32(c)))) + 100_000 for c in r[1]] for r in fit], object)
    n, sums = len(x), x.sum(axis=0)
    y = n * x - sums
    exact = (y.T @ y)
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in exact])
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1], turn[:, ::-1]
    by_id: dict = {}
    for r in found:
        by_id.setdefault(r.vec_id, []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9 * r.explained
    count = max((r.component for r in found), default=0)
    assert len(found) == n * count
    sign = {}
    for k, row in enumerate(fit):
        want_deviation = int((y[k] * y[k]).sum())
        own = [r for r in by_id[row[0]] if r.deviation == want_deviation]
        assert {r.component for r in own} == set(range(1, count + 1))
        for c in range(1, count + 1):
            want = float(np.array([float(Fraction(int(v), n)) for v in y[k]]) @ turn[:, c - 1] / np.sqrt(values[c - 1]))
            near = min((r.whitened for r in own if r.component == c), key=lambda w: abs(abs(w) - abs(want)))
            if abs(want) > 1e-3:
                sign.setdefault(c, np.sign(near * want))
            assert abs(near * sign.get(c, 1) - want) < 1e-6


def test_whitening(spark):
    rows = vectors()
    found = whitening.op11_whitening(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    check_whitening(found, fit_list(rows))


def test_whitening_table(spark):
    found = whitening.op11_whitening(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check_whitening(found, fit_list(rows, 64))


def test_whitening_odd(spark):
    make = lambda rows: whitening.op11_whitening(spark.createDataFrame([(k, v, 1, "x", 1, 1, 1) for k, v in rows], VECTORS)).collect()
    assert make([]) == [] and make([(1, [1.0, 2.0])]) == [] and make([(k, [0.5, 0.5]) for k in range(9)]) == []
    line = make([(k, [float(k), -float(k), 1.0]) for k in range(10)])
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    wide = make([(k, [2.0**40 * k, 1.0 * k * k]) for k in range(50)])
    assert len(wide) == 50 and all(r.deviation is None for r in wide if r.vec_id == 0)


def test_offset_does_not_hurt():
    """The spread of a tenth of a unit on an offset of 1e9 is found to 1e-12."""
    draw = np.random.default_rng(5)
    x = draw.integers(0, 3, (5000, 6)).astype(np.int64) + 10**9
    mean = whitening.mean_of([int(s) for s in x.sum(axis=0)], len(x))
    hi, lo = whitening.outer_products(whitening.centred(x, mean))
    y = (len(x) * x.astype(object) - x.astype(object).sum(axis=0))
    for i, j in ((0, 0), (0, 1), (4, 5)):
        exact = Fraction(int((y[:, i] * y[:, j]).sum()), len(x) ** 2)
        assert abs((Fraction(hi[i, j]) + Fraction(lo[i, j])) / exact - 1) < Fraction(1, 10**25)


def test_sums_do_not_lose():
    values = np.array([[1e16], [1.0], [-1e16], [1e-8]] * 501)
    hi, lo = whitening.total(whitening.pair(values))
    assert abs(Fraction(hi[0]) + Fraction(lo[0]) - sum(Fraction(v) for v in values[:, 0])) < Fraction(1, 10**12)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 65])
def test_eigen(n):
    """Random, repeated, low-rank, graded and diagonal matrices: residual, orthogonality, order."""
    draw = np.random.default_rng(n)
    a = draw.normal(size=(n, n))
    low = draw.normal(size=(n, max(1, n // 3)))
    graded = np.diag(10.0 ** -np.arange(n) % 12)
    for m in (a + a.T, low @ low.T, np.eye(n) * 3, np.ones((n, n)), np.zeros((n, n)), graded + 1e-6 * np.ones((n, n)), np.diag(np.repeat(np.arange(n), 2)[:n].astype(float))):
        values, q = whitening.eigen(m)
        scale = max(np.abs(m).max(), 1e-300) * n
        assert np.all(np.diff(values) <= 1e-13 * scale)
        assert np.abs(values - np.linalg.eigvalsh(m)[::-1]).max() < 1e-13 * scale
        assert np.abs(q.T @ q - np.eye(n)).max() < 1e-13 * n and np.abs(m @ q - q * values).max() < 1e-13 * scale


# 13 ---------------------------------------------------------------------


def mined(rows: list[tuple], width: int) -> list[tuple]:
    rows = [r for r in fit_list(rows, width) if r[0] is not None and r[2] is not None]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in r[1]] for r in rows], np.int64).reshape(len(rows), width)
    label = [(r[2] + 1) % 10 if r[0] % 7 == 0 else r[2] for r in rows]
    out = []
    for a, anchor in enumerate(rows):
        if anchor[0] % 50:
            continue
        score = (x @ x[a]).tolist()
        order = sorted((k for k in range(len(rows)) if k != a), key=lambda k: (-score[k], rows[k][0]))
        for p in [k for k in order if label[k] == label[a]][:5]:
            fits = [k for k in order if label[k] != label[a] and 50 * score[p] <= 100 * score[k] <= 95 * score[p]][:3]
            out += [(anchor[0], rows[p][0], r + 1, rows[k][0], score[p], score[k]) for r, k in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE_ROWS", 100)
    rows = vectors(900, seed=seed)
    found = negatives.op13_hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want = mined(rows, 12)
    assert sorted(map(tuple, found)) == want and len(want) > 20


def test_negatives_split(spark, monkeypatch):
    """One vector has most rows, so its list is dealt over parts, and asks over cells."""
    monkeypatch.setattr(negatives, "ASKS", 7)
    draw = np.random.default_rng(8)
    rows = [(k * 5, ([1.0, 0.5, 0.25] if k % 3 else np.round(draw.normal(size=3), 1).tolist()), k % 2, "x", 1, 1, 1) for k in range(1500)]
    frame = spark.createDataFrame(rows, VECTORS)
    found, width = negatives.eligible(frame)
    _, lists = negatives.build(found, width)
    assert lists.splits.max() > 1 and (lists.first + lists.splits).max() > 3
    assert sorted(map(tuple, negatives.op13_hard_negatives(frame).collect())) == mined(rows, 3)


def test_negatives_large_components(spark):
    """Scores beyond what doubles hold exactly."""
    draw = np.random.default_rng(9)
    rows = [(k * 10, (draw.normal(size=4) * 60_000).tolist(), k % 3, "x", 1, 1, 1) for k in range(200)]
    assert sorted(map(tuple, negatives.op13_hard_negatives(spark.createDataFrame(rows, VECTORS)).collect())) == mined(rows, 4)


def test_negatives_empty(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert negatives.op13_hard_negatives(frame).count() == 0
    assert negatives.op13_hard_negatives(spark.createDataFrame([(50, [1.0], 1, "x", 1, 1, 1)], VECTORS)).count() == 0


def test_bounds_hold():
    """No row scores outside its list's bounds; radii are those of the rows."""
    draw = np.random.default_rng(2)
    x = draw.integers(-200, 200, (400, 5)).astype(float)
    centroids = negatives.fit_centroids(x, 9)
    near, far = negatives.nearest(x, centroids)
    lists = negatives.Lists(centroids, np.array([far[near == k].max(initial=0) for k in range(9)]), np.arange(9), np.ones(9, int))
    upper, lower = lists.bounds(x)
    score = x @ x.T
    assert np.all(score <= upper[:, near]) and np.all(score >= lower[:, near])


def test_lists_are_skipped(monkeypatch):
    """An anchor far from a list never meets its rows."""
    import pyarrow as pa

    seen = []
    own = negatives.Best.take
    monkeypatch.setattr(negatives.Best, "take", lambda b, s, v: (seen.extend(v.tolist()), own(b, s, v)))
    x = np.array([[100, 0]] * 6 + [[-100, 0]] * 6, np.int32)
    lists = negatives.Lists(np.array([[100.0, 0], [-100.0, 0]]), np.array([1e-6, 1e-6]), np.array([0, 0]), np.array([1, 1]))
    count = len(x)
    table = pa.table({"cell": pa.array([1] * (count + 1)), "side": pa.array([0] * count + [1], pa.int32()), "list": pa.array([0] * 6 + [1] * 6 + [0], pa.int32()), "row": pa.array(range(count + 1)), "vec_id": pa.array(range(count + 1)), "label": pa.array([1] * (count + 1)), "x": pa.array([v.tobytes() for v in x] + [np.array([90, 0], np.int32).tobytes()]), "low": pa.array([None] * count + [[-negatives.FAR]]), "high": pa.array([None] * count + [[negatives.FAR]]), "floor": pa.array([None] * count + [[-negatives.FAR]])})
    out = pa.Table.from_batches(negatives.visit(lists, 2, True, 3)(iter(table.to_batches())))
    assert out.column("score").to_pylist() == [9000] * 3 and set(seen) == set(range(6))


def test_read_columns_only(spark):
    """Extra columns of any name do no harm."""
    frame = spark.read.parquet(f"{SF}/embeddings.parquet").withColumns({c: F.lit("x") for c in ("list", "w", "score", "rank", "x", "cell", "seed")})
    plain = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert sorted(map(tuple, negatives.op13_hard_negatives(frame).collect())) == sorted(map(tuple, negatives.op13_hard_negatives(plain).collect()))
