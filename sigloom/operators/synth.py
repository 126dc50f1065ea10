"""Signals out of nothing, and out of transformed frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import transforms as X
from ..functions.arrays import times
from ..functions.windows import oggvorbis, periodic_hann
from .framing import overlap_add


def _base(spark: SparkSession, duration_ps: int, frequency: int) -> DataFrame:
    return spark.range(duration_ps // frequency).withColumnRenamed("id", "ix")


def sine(spark: SparkSession, duration_ps: int, samples_per_second: int, hertz: list[float]) -> DataFrame:
    """ix, value: the mean of sines."""
    t = 2 * np.pi / samples_per_second
    waves = sum((F.sin(F.col("ix") * F.lit(t * f)) for f in hertz), F.lit(0.0))
    return _base(spark, duration_ps, 10**12 // samples_per_second).withColumn("value", waves / len(hertz))


def silence(spark: SparkSession, duration_ps: int, samples_per_second: int) -> DataFrame:
    return _base(spark, duration_ps, 10**12 // samples_per_second).withColumn("value", F.lit(0.0))


def noise(spark: SparkSession, duration_ps: int, samples_per_second: int, seed: int = 0) -> DataFrame:
    """Uniform in [-1, 1), a function of the row number, so partitions don't matter."""
    unit = F.pmod(F.xxhash64("ix", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return _base(spark, duration_ps, 10**12 // samples_per_second).withColumn("value", unit * 2 - 1)


def ticks(spark: SparkSession, duration_ps: int, samples_per_second: int, every_ps: int, seed: int = 0) -> DataFrame:
    """A decaying burst of noise of a tenth of a second at every step."""
    one = 10**12 // samples_per_second
    step, size = every_ps // one, 10**11 // one
    at = F.pmod(F.col("ix"), F.lit(step))
    unit = F.pmod(F.xxhash64(at, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53) * 2 - 1
    return _base(spark, duration_ps, one).withColumn("value", F.when(at < size, unit * (1 - at / size)).otherwise(0.0))


def mono(left: Column, right: Column, scale: float = 0.25) -> Column:
    """The channels' sum times ``scale``; 0.25 is what the established behaviour gives, 0.5 the mean."""
    return (left + right) * scale


def mixed(signals: list[DataFrame], by: list[str]) -> DataFrame:
    """Sample by sample, the sum."""
    out = signals[0].select(*by, "ix", "value")
    for s in signals[1:]:
        out = out.unionByName(s.select(*by, "ix", "value"))
    return out.groupBy(*by, "ix").agg(F.sum("value").alias("value"))


def padded(df: DataFrame, by: list[str], extra: int) -> DataFrame:
    """Each series with rows of zeros after it."""
    ends = df.groupBy(*by).agg(F.max("ix").alias("__m"))
    more = ends.select(*by, F.explode(F.sequence(F.col("__m") + 1, F.col("__m") + extra)).alias("ix"), F.lit(0.0).alias("value"))
    return df.select(*by, "ix", "value").unionByName(more)


def from_frames(frames: DataFrame, by: list[str], hop: int, inverse: Column, window=None, size: int | None = None) -> DataFrame:
    """Inverse transform, window and overlap-add."""
    made = frames.withColumn("__s", inverse if window is None else times(inverse, window(size)))
    return overlap_add(made, by, hop, samples="__s")


def from_mdct(frames: DataFrame, by: list[str], n: int, coeffs: str = "coeffs") -> DataFrame:
    """Half-lapped MDCT frames of n coefficients; with the same window before, the inside comes back."""
    return from_frames(frames, by, n, X.imdct(F.col(coeffs), n), oggvorbis, 2 * n)


def from_dct(frames: DataFrame, by: list[str], n: int, hop: int, coeffs: str = "coeffs") -> DataFrame:
    return from_frames(frames, by, hop, X.idct(F.col(coeffs), n))


def from_dct4(frames: DataFrame, by: list[str], n: int, hop: int, coeffs: str = "coeffs") -> DataFrame:
    return from_frames(frames, by, hop, X.dct4(F.col(coeffs), n))


def from_fft(frames: DataFrame, by: list[str], n: int, hop: int, coeffs: str = "coeffs") -> DataFrame:
    return from_frames(frames, by, hop, X.irfft(F.col(coeffs), n), oggvorbis, n)


def stretched(x: np.ndarray, factor: float, hop: int, window: int) -> np.ndarray:
    """Phase vocoder: the same pitch in 1 / factor of the time."""
    count = 1 + max(0, -(-(len(x) - window) // hop))
    x = np.pad(np.asarray(x, float), (0, max(0, (count - 1) * hop + window - len(x))))
    win = periodic_hann(window)
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop][:count] * win
    z = np.concatenate([np.fft.rfft(frames, norm="ortho"), np.zeros((2, window // 2 + 1))])
    size, angle = np.abs(z), np.angle(z)
    at = np.arange(0, count, factor)
    i = at.astype(int)
    expected = np.linspace(0, np.pi * hop, window // 2 + 1)
    drift = angle[i + 1] - angle[i] - expected
    drift += expected - 2 * np.pi * np.round(drift / (2 * np.pi))
    turned = angle[0] + np.concatenate([np.zeros((1, len(expected))), np.cumsum(drift, axis=0)[:-1]])
    part = (at - i)[:, None]
    made = np.fft.irfft((size[i] * (1 - part) + size[i + 1] * part) * np.exp(1j * turned), window, norm="ortho") * win
    out = np.zeros(max(len(made) * hop + window, int(len(x) / factor)))
    for k, frame in enumerate(made):
        out[k * hop : k * hop + window] += frame
    return out


def time_stretch(df: DataFrame, by: list[str], factor: float, hop: int = 256, window: int = 1024) -> DataFrame:
    """by, ix, value: every series stretched; a series is one task's work."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix")
        y = stretched(pdf.value.to_numpy(float), factor, hop, window)[: int(len(pdf) / factor)]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, "ix": np.arange(len(y)), "value": y})

    return df.select(*by, "ix", "value").groupBy(*by).applyInPandas(run, f"{keys}, ix long, value double")


def pitch_shift(df: DataFrame, by: list[str], semitones: float, hop: int = 256, window: int = 1024) -> DataFrame:
    """by, ix, value: the same duration at another pitch."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    factor = 2.0 ** (-semitones / 12)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix")
        n = len(pdf)
        y = X.fft_resampled(stretched(pdf.value.to_numpy(float), factor, hop, window)[: max(1, int(n / factor))], n)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, "ix": np.arange(n), "value": y})

    return df.select(*by, "ix", "value").groupBy(*by).applyInPandas(run, f"{keys}, ix long, value double")


def resampled(df: DataFrame, by: list[str], ratio: float) -> DataFrame:
    """by, ix, value: round(n * ratio) samples of every series, band-limited; unchanged for a ratio of 1."""
    if ratio == 1:
        return df.select(*by, "ix", "value")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix")
        y = X.fft_resampled(pdf.value.to_numpy(float), max(1, round(len(pdf) * ratio)))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, "ix": np.arange(len(y)), "value": y})

    return df.select(*by, "ix", "value").groupBy(*by).applyInPandas(run, f"{keys}, ix long, value double")
