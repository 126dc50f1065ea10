"""Colours against numpy, onsets of a chunked stream against those of the whole, reductions and squeezing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigloom.functions import arrays as A
from sigloom.functions import transforms as X
from sigloom.operators import segment
from sigloom.streaming import stateful


def test_rainbowgram_against_numpy(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(12, 5)) + 1j * rng.normal(size=(12, 5))
    rows = spark.createDataFrame([(None, i, r.real.tolist(), r.imag.tolist()) for i, r in enumerate(z)], "k string, ix long, re array<double>, im array<double>")
    got = np.array([r.colors for r in segment.rainbowgram(rows, ["k"]).orderBy("ix").collect()]).reshape(12, 5, 3)
    unit = lambda x: (x - x.min()) / (x.max() - x.min())
    bright = unit(np.log1p(np.abs(z.real) * 1000))
    hue = np.minimum(np.floor(unit(np.gradient(np.unwrap(np.angle(z), axis=0))[0]) * 256), 255) / 255
    rgb = np.stack([np.abs(2 * hue - 0.5), np.sin(np.pi * hue), np.cos(np.pi * hue / 2)], -1)
    assert np.allclose(got, np.clip(rgb, 0, 1) * bright[..., None])


def test_rainbowgram_of_constant_and_empty_series(spark):
    schema = "k string, ix long, re array<double>, im array<double>"
    rows = spark.createDataFrame([("a", i, [1.0], [0.0]) for i in range(3)], schema)
    assert [r.colors for r in segment.rainbowgram(rows, ["k"]).collect()] == [[0.0, 0.0, 0.0]] * 3
    assert segment.rainbowgram(rows.limit(0), ["k"]).count() == 0


class _State:
    exists = False

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists = False


@pytest.mark.parametrize("window, before, how", [(11, 5, "mean"), (12, 4, "median"), (5, 0, "mean"), (6, 5, "median")])
def test_chunked_peaks_equal_those_of_the_whole(spark, window, before, how):
    held = {}

    class Frame:
        schema = []
        select = groupBy = lambda self, *a: self

        def applyInPandasWithState(self, run, *a):
            held["run"] = run

    stateful.peaks(Frame(), [], window, before, 1.1, how)
    rng = np.random.default_rng(7)
    for n in (1, 2, 9, 40):
        x = rng.random(n).round(2)
        rows = pd.DataFrame({"ix": np.arange(n), "value": x, "last": np.arange(n) == n - 1})
        whole = segment.peaks(spark.createDataFrame(rows).withColumn("k", F.lit(1)), ["k"], window, before, 1.1, how)
        expected = [(r.ix, r.peak) for r in whole.orderBy("ix").collect()]
        for cuts in ([], [n // 2], [1, n // 3, n // 3 + 1]):
            edges, state, got = sorted({0, n, *[c for c in cuts if 0 < c < n]}), _State(), []
            for a, b in zip(edges, edges[1:]):
                for out in held["run"]((), iter([rows[a:b]]), state):
                    got += [(int(i), bool(p)) for i, p in zip(out.ix, out.peak)]
            assert got == expected


def test_squeeze_and_short_correlograms(spark):
    row = spark.createDataFrame([([[1.0, 2.0]], [1.0, 2.0, 3.0])], "one array<array<double>>, v array<double>")
    assert row.select(A.squeeze(F.col("one"))).first()[0] == [1.0, 2.0]
    with pytest.raises(PySparkException, match="size 1"):
        row.select(A.squeeze(F.col("v"))).collect()
    assert row.select(X.auto_correlogram(F.col("v"), np.ones((2, 3)), 4)).first()[0] == []
