"""Searches in blocks, sparse frames of chunked streams, and bands put together again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.functions import arrays as A
from sigloom.functions import transforms as X
from sigloom.functions.windows import oggvorbis
from sigloom.operators import adaptive, knn
from sigloom.plans import templates
from sigloom.scales import Band, Scale
from sigloom.streaming import stateful
from sigloom.units import frame_count


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "cityblock", "chebyshev", "sqeuclidean"])
def test_blocks_of_queries_give_the_rows_of_one(spark, monkeypatch, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6)).round(1)
    x[3] = x[50] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    one = {tuple(r) for r in knn.nearest(rows, asked, 4, metric).collect()}
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 2000)
    assert {tuple(r) for r in knn.nearest(rows, asked, 4, metric).collect()} == one
    by_expression = {tuple(r) for r in knn.nearest(rows, asked, 4, knn.METRICS[metric]).collect()}
    assert {(r[0], r[1], r[3]) for r in by_expression} == {(r[0], r[1], r[3]) for r in one} and len(one) == 360


def test_vectors_without_length(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([0.0, 0.0], [0.0, 0.0]), (None, [1.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(A.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, None, 0.0]


def test_what_is_no_number_comes_last(spark):
    rows = spark.createDataFrame([(i, [float("nan")] if i % 3 else [float(i)]) for i in range(12)], "id long, vector array<double>").coalesce(1)
    got = knn.nearest(rows, spark.createDataFrame([(0, [0.0])], "query_id long, vector array<double>"), 5).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 3, 6, 9, 1]


class _State:
    exists = False

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists = False


@pytest.mark.parametrize("window, step, before", [(3, 5, 0), (3, 5, 4), (2, 9, 0), (4, 2, 3), (4, 4, 0), (1, 7, 2)])
def test_chunked_frames_equal_those_of_the_whole(monkeypatch, window, step, before):
    held = {}

    class Frame:
        schema = []
        select = groupBy = lambda self, *a: self

        def applyInPandasWithState(self, run, *a):
            held["run"] = run

    monkeypatch.setattr(stateful, "_keys", lambda *a: "")
    stateful.framed(Frame(), ["k"], window, step, before)
    rng = np.random.default_rng(window * step)
    for n in (1, 4, 23, 40):
        x = np.arange(1.0, n + 1)
        for _ in range(6):
            cuts = np.sort(rng.integers(0, n + 1, 3))
            state, got = _State(), []
            chunks = [c for c in np.split(np.arange(n), cuts) if len(c)]
            for c in chunks:
                pdf = pd.DataFrame({"ix": c, "value": x[c], "last": c == n - 1})
                for out in held["run"](("s",), iter([pdf]), state):
                    got += [(f, list(s)) for f, s in zip(out.frame, out.samples)]
            whole = np.concatenate([np.zeros(before), x])
            k = frame_count(len(whole), window, step)
            whole = np.pad(whole, (0, k * step + window))
            assert got == [(i, whole[i * step : i * step + window].tolist()) for i in range(k)]


def test_a_signal_from_its_adaptive_bands(spark):
    """Whole signals, edges included, against numpy, for the transform with the FFT and the one with the DCT."""
    window, hop, n, rate = 32, 16, 100, 11025
    x = np.random.default_rng(3).normal(size=n)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, ix long, value double")
    scale = Scale([Band(0.0, 2500.0), Band(2000.0, 5600.0)])
    bins = X.linear_bins(rate, window)
    edges = [(lo, min(hi, len(bins))) for lo, hi in map(bins.bins, scale)]
    made = templates.frequency_adaptive(["k"], window, hop, rate, scale).compute(spark, "freq_adaptive", rows).withColumnRenamed("ix", "frame")
    count = frame_count(n, window, hop)
    padded = np.pad(x, (0, count * hop + window))
    win, fft, dct = oggvorbis(window), np.zeros(n + 2 * window), np.zeros(n + 2 * window)
    cut = [(0, 20), (12, 32)]
    m = X.dct2_matrix(window)
    for i in range(count):
        part = padded[i * hop : i * hop + window] * win
        z, back = np.fft.rfft(part, norm="ortho"), np.zeros(window // 2 + 1, complex)
        for lo, hi in edges:
            back[lo:hi] += np.fft.rfft(np.fft.irfft(z[lo:hi] * np.hanning(hi - lo), norm="ortho"), norm="ortho")
        fft[i * hop : i * hop + window] += np.fft.irfft(back, window, norm="ortho") * win
        c, back = m @ part, np.zeros(window)
        for lo, hi in cut:
            back[lo:hi] += c[lo:hi] * np.hanning(hi - lo)
        dct[i * hop : i * hop + window] += m.T @ back
    got = {r.ix: r.value for r in adaptive.from_fft_bands(made, ["k"], edges, window, hop).collect()}
    assert len(got) == (count - 1) * hop + window and all(abs(got[i] - fft[i]) < 1e-9 for i in got)
    frames = templates.framed(["k"], window, hop).compute(spark, "windowed", rows)
    banded = frames.select("k", F.col("ix").alias("frame"), adaptive.dct_bands(X.dct(F.col("coeffs"), window), cut).alias("bands"))
    got = {r.ix: r.value for r in adaptive.from_dct_bands(banded, ["k"], cut, window, hop).collect()}
    assert all(abs(got[i] - dct[i]) < 1e-9 for i in got)
