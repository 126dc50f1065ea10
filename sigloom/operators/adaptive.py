"""Bands of different widths, array<struct<band_ix, coeffs>>: cut out of frames or spectra, laid on a common grid, and put together again.

Every way back is linear, so it is one product of the bands' coefficients, end to
end, with a constant matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import transforms as X
from ..functions.transforms import fft_resampled, frames_udf
from ..functions.windows import hann, windowed
from . import synth


def banded(a: Column, edges: list[tuple[int, int]]) -> Column:
    """A flat frame as bands at fixed offsets."""
    return F.array(*[F.struct(F.lit(i).alias("band_ix"), A.band(a, lo, hi).alias("coeffs")) for i, (lo, hi) in enumerate(edges)])


def flat(bands: Column) -> Column:
    """The bands' coefficients one after another."""
    return F.flatten(F.transform(bands, lambda b: b["coeffs"]))


def bands(df: DataFrame, by: list[str], column: str = "bands") -> DataFrame:
    """by, ix, band_ix, coeffs: a row for each band."""
    return df.select(*by, "ix", F.explode(column).alias("__b")).select(*by, "ix", "__b.band_ix", "__b.coeffs")


def rasterized(df: DataFrame, by: list[str], n: int, column: str = "bands") -> DataFrame:
    """by, ix, band_ix, coeffs: every band resampled to n coefficients and scaled to keep its greatest magnitude."""
    made = bands(df, by, column).withColumn("__r", frames_udf(lambda x: fft_resampled(x, n))(F.col("coeffs")))
    scaled = A.let(F.struct(A.peak(F.col("coeffs")).alias("a"), A.peak(F.col("__r")).alias("b")), lambda p: F.transform("__r", lambda x: F.when(p["b"] > 0, x * p["a"] / p["b"]).otherwise(0.0)))
    return made.select(*by, "ix", "band_ix", scaled.alias("coeffs"))


def squared(df: DataFrame, by: list[str], n: int, hop: int | None = None, column: str = "bands") -> DataFrame:
    """by, band_ix, ix, value: rasterized bands in time, frames apart or, with a hop, overlap-added."""
    from .framing import overlap_add

    made = rasterized(df, by, n, column)
    return overlap_add(made, [*by, "band_ix"], hop or n, frame="ix", samples="coeffs")


Edges = list[tuple[int, int]]


def fft_bands(z: Column, edges: Edges, wfunc=hann) -> Column:
    """Bands of a complex spectrum, windowed, each by its own inverse real FFT: m coefficients give 2 (m - 1) in time."""
    if any(hi - lo == 1 for lo, hi in edges):
        raise ValueError("a band of one coefficient has no inverse real FFT")

    def band(lo: int, hi: int) -> Column:
        part = lambda x: windowed(A.band(z[x], lo, hi), hi - lo, wfunc).alias(x)
        return X.irfft(F.struct(part("re"), part("im")), 2 * (hi - lo - 1))

    return F.array(*[F.struct(F.lit(i).alias("band_ix"), band(lo, hi).alias("coeffs")) for i, (lo, hi) in enumerate(edges) if hi > lo])


def dct_bands(c: Column, edges: Edges, wfunc=hann) -> Column:
    """Bands of DCT coefficients, windowed, each by its own inverse DCT: m coefficients give m in time."""
    band = lambda lo, hi: X.idct(windowed(A.band(c, lo, hi), hi - lo, wfunc), hi - lo)
    return F.array(*[F.struct(F.lit(i).alias("band_ix"), band(lo, hi).alias("coeffs")) for i, (lo, hi) in enumerate(edges) if hi > lo])


def _placed(blocks: list[tuple[int, np.ndarray]], n: int) -> np.ndarray:
    """Blocks side by side, each with its rows from the given one on; rows that blocks share are added."""
    out = np.zeros((n, sum(b.shape[1] for _, b in blocks)))
    at = 0
    for lo, b in blocks:
        out[lo : lo + len(b), at : at + b.shape[1]] = b
        at += b.shape[1]
    return out


def fft_spectrum(bands: Column, edges: Edges, n: int) -> Column:
    """struct<re, im> of n coefficients from fft_bands(): where bands overlap they are added, where there is none it is 0."""
    parts = [[(lo, X.rfft_matrices(2 * (hi - lo - 1))[k]) for lo, hi in edges if hi > lo] for k in (0, 1)]
    re, im = (_placed(p, n) for p in parts)
    return F.struct(X.by_matrix(flat(bands), re).alias("re"), X.by_matrix(flat(bands), im).alias("im"))


def dct_spectrum(bands: Column, edges: Edges, n: int) -> Column:
    """n DCT coefficients from dct_bands(), added where bands overlap."""
    return X.by_matrix(flat(bands), _placed([(lo, X.dct2_matrix(hi - lo)) for lo, hi in edges if hi > lo], n))


def from_fft_bands(frames: DataFrame, by: list[str], edges: Edges, window: int, hop: int, column: str = "bands") -> DataFrame:
    """by, ix, value: the signal of frames with fft_bands() of a window's spectrum."""
    z = frames.withColumn("coeffs", fft_spectrum(F.col(column), edges, window // 2 + 1))
    return synth.from_fft(z, by, window, hop)


def from_dct_bands(frames: DataFrame, by: list[str], edges: Edges, window: int, hop: int, column: str = "bands") -> DataFrame:
    """by, ix, value: the signal of frames with dct_bands() of a window's DCT."""
    return synth.from_dct(frames.withColumn("coeffs", dct_spectrum(F.col(column), edges, window)), by, window, hop)


def from_decomposition(bands: Column, sizes: list[int], n: int, chosen: set[int] | None = None) -> Column:
    """n samples of a frame from its bands of rising size: all of them, or the chosen ones, brought to n samples and added."""
    ups = [fft_resampled(np.eye(m), n).T if chosen is None or i in chosen else np.zeros((n, m)) for i, m in enumerate(sorted(sizes))]
    return X.by_matrix(F.flatten(bands), np.concatenate(ups, axis=1))
