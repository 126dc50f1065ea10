"""Coefficients of the frequency-adaptive graph against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import transforms as X
from sigloom.functions.windows import hann, oggvorbis
from sigloom.plans import templates
from sigloom.scales import Band, GeometricScale, Scale


@pytest.mark.parametrize(
    "window, scale",
    [(64, GeometricScale(200, 4500, 0.4, 6)), (1024, Scale([Band(0.0, 1000.0), Band(900.0, 4600.0)]))],
)
def test_bands_are_inverse_real_ffts(spark, window, scale):
    rate, n = 11025, 2 * window
    x = np.random.default_rng(1).normal(size=n)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, ix long, value double")
    made = templates.frequency_adaptive(["k"], window, window, rate, scale).compute(spark, "freq_adaptive", rows)
    bins = X.linear_bins(rate, window)
    got = {r.ix: r.bands for r in made.collect()}
    for frame in (0, 1):
        spectrum = np.fft.rfft(x[frame * window : (frame + 1) * window] * oggvorbis(window), norm="ortho")
        assert len(got[frame]) == len(list(scale))
        for b, (lo, hi) in zip(got[frame], map(bins.bins, scale), strict=True):
            part = spectrum[lo:hi]
            expected = np.fft.irfft(part * np.hanning(len(part)), norm="ortho") if len(part) else []
            assert len(b.coeffs) == 2 * (len(part) - 1) and b.coeffs == pytest.approx(list(expected), abs=1e-9)


def test_long_inverse_equals_numpy(spark):
    z = np.random.default_rng(2).normal(size=(2, 200))
    rows = spark.createDataFrame([(z[0].tolist(), z[1].tolist())], "re array<double>, im array<double>")
    got = rows.select(X.irfft(F.struct("re", "im"), 398).alias("x")).first().x
    assert got == pytest.approx(list(np.fft.irfft(z[0] + 1j * z[1], norm="ortho")), abs=1e-9)


def test_a_band_of_one_coefficient_is_refused():
    with pytest.raises(ValueError):
        templates.frequency_adaptive(["k"], 64, 32, 11025, Scale([Band(1010.0, 1100.0)]), hann)
