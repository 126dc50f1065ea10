"""The search measures few pairs, gives k rows a task, and its bounds lose nothing on odd numbers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.operators import knn

METRICS = ("cityblock", "euclidean", "cosine", "sqeuclidean", "chebyshev", "hamming")


def _all_pairs(metric, x, q):
    with np.errstate(all="ignore"):
        return np.stack([knn._measured(metric, x, np.broadcast_to(a, x.shape)) for a in q])


def _vectors(n, width, seed):
    v = np.random.default_rng(seed).normal(size=(n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _searched(metric, x, q, k, tile):
    """Distances of the k nearest of each query, tile by tile, and the pairs that were measured."""
    bound, most, best = knn._Bound(metric, q), np.full(len(q), np.inf), [[] for _ in q]
    for lo in range(0, len(x), tile):
        part = x[lo : lo + tile]
        for col, row, d in knn._near(metric, bound, q, part, np.arange(len(part)), k, most, 9):
            for c, r, v in zip(col, row, d):
                best[c].append((np.inf if np.isnan(v) else v, lo + r, v))
        best = [sorted(b, key=lambda s: s[:2])[:k] for b in best]
        most = np.array([b[-1][0] if len(b) == k else np.inf for b in best])
    return [[s[1] for s in b] for b in best]


def _expected(metric, x, q, k):
    d = np.round(_all_pairs(metric, x, q), 9)
    return [np.lexsort((np.arange(len(x)), np.where(np.isnan(a), np.inf, a)))[:k].tolist() for a in d]


@pytest.mark.parametrize("metric", ["cityblock", "euclidean", "cosine"])
def test_few_pairs_are_measured(metric, monkeypatch):
    x, q, measured, original = _vectors(8000, 64, 1), _vectors(200, 64, 2), [], knn._measured
    monkeypatch.setattr(knn, "_measured", lambda m, a, b: measured.append(len(a)) or original(m, a, b))
    got = _searched(metric, x, q, 5, 2000)
    assert sum(measured) < 0.06 * len(x) * len(q)
    monkeypatch.undo()
    assert got == _expected(metric, x, q, 5)


def test_few_euclidean_pairs_are_measured_far_from_zero(monkeypatch):
    x, q, measured, original = 100 + _vectors(6000, 64, 11), 100 + _vectors(100, 64, 12), [], knn._measured
    monkeypatch.setattr(knn, "_measured", lambda m, a, b: measured.append(len(a)) or original(m, a, b))
    got = _searched("euclidean", x, q, 5, 2000)
    assert sum(measured) < 0.03 * len(x) * len(q)
    monkeypatch.undo()
    assert got == _expected("euclidean", x, q, 5)


def test_few_cosine_pairs_are_measured_whatever_the_lengths(monkeypatch):
    lengths = 10.0 ** np.random.default_rng(13).uniform(-6, 6, (6000, 1))
    x, q, measured, original = lengths * _vectors(6000, 64, 14), lengths[:100] * _vectors(100, 64, 15), [], knn._measured
    monkeypatch.setattr(knn, "_measured", lambda m, a, b: measured.append(len(a)) or original(m, a, b))
    got = _searched("cosine", x, q, 5, 2000)
    assert sum(measured) < 0.03 * len(x) * len(q)
    monkeypatch.undo()
    assert got == _expected("cosine", x, q, 5)


@pytest.mark.parametrize("metric", METRICS)
def test_odd_numbers(metric):
    rng = np.random.default_rng(4)
    if metric == "hamming":
        x = rng.integers(0, 2**63, (300, 2)).astype(np.uint64) << np.uint64(1)
        x[50:120] = x[3]
    else:
        x = np.concatenate([_vectors(150, 8, 5), 1000 + 1e-4 * _vectors(100, 8, 6), rng.integers(-2, 3, (50, 8)).astype(float)])
        x[10:40] = x[3]
        x[60], x[61] = 0, 0
        x[70, 2], x[71, 3], x[72, 0], x[73] = np.nan, np.inf, -np.inf, np.inf
        x[80], x[81], x[82], x[83] = 1e20, 1e25, 1e-200, 1e160
        x[84], x[85], x[86] = 3e38, -1e39, 1e-170
    with np.errstate(all="ignore"):
        for tile in (40, 300):
            assert _searched(metric, x, x, 4, tile) == _expected(metric, x, x, 4)
        assert _searched(metric, x[100:200], x[100:200], 4, 30) == _expected(metric, x[100:200], x[100:200], 4)
        assert _searched(metric, x[:3], x, 4, 2) == _expected(metric, x[:3], x, 4)


def test_equal_rows_are_few_at_a_time():
    x = np.ones((4000, 4))
    got = list(knn._near("cityblock", knn._Bound("cityblock", x), x, x, np.arange(4000), 5, np.full(4000, np.inf), 9))
    assert sum(len(a[0]) for a in got) < 20 * len(x)


def test_rows_of_a_task(spark):
    """k rows for each query and task, however small the batches; ids need not be numbers."""
    v = _vectors(400, 6, 8)
    rows = spark.createDataFrame([(f"r{i}" if i else None, a.tolist()) for i, a in enumerate(v)], "id string, v array<double>").repartition(2)
    asked = rows.where("id IS NOT NULL").select(F.col("id").alias("query_id"), F.col("v").alias("__q"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert knn._streamed(rows, asked, 3, "euclidean", 9).count() == 2 * 3 * 399
        got = knn.nearest(rows.withColumnRenamed("v", "vector"), asked.withColumnRenamed("__q", "vector"), 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    names = np.array([f"r{i}" if i else "" for i in range(400)])
    for r in got:
        d = np.linalg.norm(v - v[int(r.query_id[1:])], axis=1).round(9)
        assert (r.id or "") == names[np.lexsort((names, d))[r.rank - 1]]


def test_place_of_ids():
    assert knn._places(pa.array([5, None, 2])).tolist() == [2, 0, 1]
