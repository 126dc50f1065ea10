"""Spectral transforms.

Small sizes are products with a constant matrix inside the JVM; larger ones go to
numpy in Arrow batches (``*_udf``).  Complex coefficients are a struct of two
arrays, ``re`` and ``im``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scales import ChromaScale, LinearScale, Scale, a_weighting
from .arrays import each, let, literal, matmul, times, total

#: Frames up to this size are transformed in the JVM.
JVM_SIZE = 256


def dct2_matrix(n: int, ortho: bool = True) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * k * (2 * i + 1) / (2 * n))
    if not ortho:
        return 2 * m
    m *= np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def dct4_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.sqrt(2 / n) * np.cos(np.pi / n * (i + 0.5) * (k + 0.5))


def mdct_matrix(n: int) -> np.ndarray:
    """n coefficients of 2 n samples."""
    k, i = np.arange(n)[:, None], np.arange(2 * n)[None, :]
    return np.sqrt(2 / n) * np.cos(np.pi / n * (k + 0.5) * (i + 0.5 + n / 2))


def rfft_matrices(n: int) -> tuple[np.ndarray, np.ndarray]:
    k, i = np.arange(n // 2 + 1)[:, None], np.arange(n)[None, :]
    at = 2 * np.pi * k * i / n
    return np.cos(at) / np.sqrt(n), -np.sin(at) / np.sqrt(n)


def by_matrix(a: Column, matrix: np.ndarray) -> Column:
    """matrix @ a, in the JVM or in Arrow batches by the matrix's size."""
    if max(matrix.shape) <= JVM_SIZE:
        return matmul(matrix, a)
    return frames_udf(lambda x: x @ matrix.T)(a)


#: Numbers that a frames_udf with known sizes returns at once.
AT_ONCE = 1 << 19


def frames_udf(f: Callable[[np.ndarray], np.ndarray], made: Callable[[int], int] | None = None):
    """An Arrow UDF from frames of one length (rows of a matrix) to frames; null frames stay null.

    ``made``, the size of the frame that one of a size becomes, is for frames that grow: batches are then cut to about ``AT_ONCE`` numbers.
    """

    def rows(a: pa.Array, n: int) -> pa.Array:
        if not n:
            return a.cast(pa.list_(pa.float64()))
        made = np.ascontiguousarray(f(np.asarray(a.flatten().to_numpy(zero_copy_only=False), float).reshape(len(a), n)), float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))

    def run(a: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(a).to_numpy(zero_copy_only=False)
        found = np.unique(sizes[~np.isnan(sizes)] if a.null_count else sizes)
        if len(found) == 1 and not a.null_count:
            return rows(a, int(found[0]))
        out, where = [pa.nulls(1, pa.list_(pa.float64()))], np.zeros(len(a), np.int64)
        for n in found:
            at = np.flatnonzero(sizes == n)
            where[at] = sum(map(len, out)) + np.arange(len(at))
            out.append(rows(a.take(pa.array(at)), int(n)))
        return pa.concat_arrays(out).take(pa.array(where))

    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            sizes = np.nan_to_num(pc.list_value_length(a).to_numpy(zero_copy_only=False))
            ends = np.cumsum([max(1, int(n), made(int(n))) for n in sizes])
            lo = 0
            while lo < len(a):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
                yield run(a.slice(lo, hi - lo))
                lo = hi
            if not len(a):
                yield run(a)

    if made:
        parts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(parts, "array<double>")
    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")


def dct(a: Column, n: int) -> Column:
    return by_matrix(a, dct2_matrix(n))


def idct(a: Column, n: int) -> Column:
    return by_matrix(a, dct2_matrix(n).T)


def dct4(a: Column, n: int) -> Column:
    """Its own inverse."""
    return by_matrix(a, dct4_matrix(n))


def mdct(a: Column, n: int) -> Column:
    return by_matrix(a, mdct_matrix(n))


def imdct(a: Column, n: int) -> Column:
    return by_matrix(a, mdct_matrix(n).T)


def rfft(a: Column, n: int) -> Column:
    """struct<re, im> of n // 2 + 1 coefficients, orthonormal."""
    if n <= JVM_SIZE:
        re, im = rfft_matrices(n)
        return F.struct(matmul(re, a).alias("re"), matmul(im, a).alias("im"))
    m = n // 2 + 1
    both = frames_udf(lambda x: np.concatenate([(z := np.fft.rfft(x, n, norm="ortho")).real, z.imag], axis=1))
    return let(both(a), lambda y: F.struct(F.slice(y, 1, m).alias("re"), F.slice(y, m + 1, m).alias("im")))


def irfft(z: Column, n: int) -> Column:
    """n samples of n // 2 + 1 coefficients, orthonormal."""
    m = n // 2 + 1
    if n > JVM_SIZE:
        return frames_udf(lambda x: np.fft.irfft(x[:, :m] + 1j * x[:, m:], n, norm="ortho"))(F.concat(z["re"], z["im"]))
    re, im = rfft_matrices(n)
    twice = np.full(m, 2.0)
    twice[0] = 1.0
    if n % 2 == 0:
        twice[-1] = 1.0
    return F.zip_with(matmul((re * twice[:, None]).T, z["re"]), matmul((im * twice[:, None]).T, z["im"]), lambda x, y: x + y)


def magnitude(z: Column) -> Column:
    return F.zip_with(z["re"], z["im"], lambda x, y: F.sqrt(x * x + y * y))


def phase(z: Column) -> Column:
    return F.zip_with(z["re"], z["im"], lambda x, y: F.atan2(y, x))


def power(z: Column) -> Column:
    return F.zip_with(z["re"], z["im"], lambda x, y: x * x + y * y)


def phase_shift(z: Column, samples: int, n: int, lo: int = 0, hi: int | None = None) -> Column:
    """The n coefficients from lo to hi turned by a delay of whole samples."""
    at = 2 * np.pi * np.arange(n) * samples / n
    at[:lo] = 0
    if hi is not None:
        at[hi:] = 0
    c, s = literal(np.cos(at)), literal(-np.sin(at))
    re, im = z["re"], z["im"]
    mul = lambda x, y: F.zip_with(x, y, lambda p, q: p * q)
    return F.struct(F.zip_with(mul(re, c), mul(im, s), lambda p, q: p - q).alias("re"), F.zip_with(mul(re, s), mul(im, c), lambda p, q: p + q).alias("im"))


def apply_scale(spectrum: Column, scale: Scale | ChromaScale, bins: Scale, window=None) -> Column:
    """Band sums of |spectrum|."""
    return by_matrix(each(F.abs)(spectrum), scale.basis(bins, window))


def chroma(spectrum: Column, scale: ChromaScale, bins: Scale, window=None) -> Column:
    return by_matrix(times(each(F.abs)(spectrum), a_weighting(bins)), scale.basis(bins, window))


def bfcc(bands: Column, n: int, coefficients: int = 13, exclude: int = 1) -> Column:
    """Cepstral coefficients: unnormalised DCT of the logarithm of |bands|."""
    logs = F.transform(bands, lambda x: F.log(F.abs(x) + 1e-12))
    return by_matrix(logs, dct2_matrix(n, ortho=False)[exclude : exclude + coefficients])


def dct_resample(a: Column, n: int, size: int) -> Column:
    """A frame of n samples as one of another size, by cutting or filling its DCT."""
    k = min(n, size)
    return by_matrix(a, (dct2_matrix(size)[:k].T @ dct2_matrix(n)[:k]) * np.sqrt(size / n))


def dct_band(a: Column, n: int, lo: int, hi: int) -> Column:
    """The part of a frame that its DCT coefficients lo to hi make."""
    d = dct2_matrix(n)[lo:hi]
    return by_matrix(a, d.T @ d)


def fft_resampled(x: np.ndarray, size: int) -> np.ndarray:
    """Rows of one length as rows of another, by cutting or filling their spectra."""
    n = x.shape[-1]
    z = np.fft.rfft(x)
    out = np.zeros((*x.shape[:-1], size // 2 + 1), complex)
    k = min(n, size) // 2 + 1
    out[..., :k] = z[..., :k]
    if min(n, size) % 2 == 0 and n != size:
        out[..., k - 1] *= 0.5 if size > n else 2.0
        if size < n:
            out[..., k - 1] = out[..., k - 1].real
    return np.fft.irfft(out, size) * (size / n)


def frequency_decomposition(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """A row as bands of rising size, each what the smaller ones leave."""
    left, out = np.array(x, float), []
    for size in sorted(sizes):
        b = left.copy() if size == len(x) else fft_resampled(left, size)
        out.append(b)
        left = left - (b if size == len(x) else fft_resampled(b, len(x)))
    return out


def morlet_bank(samples_per_second: int, taps: int, scale: Scale, scaling) -> np.ndarray:
    """Real Morlet kernels of unit norm at the bands' centres; scaling between 0 and 1 trades frequency for time resolution."""
    s = np.broadcast_to(np.asarray(scaling, float), (len(scale),)) if np.ndim(scaling) == 0 else np.asarray(scaling, float)
    if len(s) != len(scale):
        raise ValueError("one scaling factor for each band")
    out = np.zeros((len(scale), taps))
    for row, band, f in zip(out, scale, s):
        t = np.linspace(-f * 2 * np.pi, f * 2 * np.pi, taps)
        w = band.center * taps / (2 * f * samples_per_second)
        row[:] = (np.cos(w * t) - np.exp(-0.5 * w**2)) * np.exp(-0.5 * t**2) * np.pi**-0.25
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-8)


def fir_bank(scale: Scale, taps: int, samples_per_second: int, window=np.hanning, points: int = 32) -> np.ndarray:
    """Linear-phase FIR filters whose gain in each band is the window, by sampling the response."""
    nyquist = samples_per_second / 2
    grid = np.linspace(0, 1, 1 + (1 << max(9, int(taps).bit_length())))
    out = np.zeros((len(scale), taps))
    for row, band in zip(out, scale):
        lo, hi = max(0.0, band.start_hz) / nyquist, min(nyquist, band.stop_hz) / nyquist
        at = np.linspace(lo, hi, points, endpoint=False)
        gain = np.interp(grid, np.concatenate([[0], at, [1]]), np.concatenate([[0], window(points), [0]]))
        shift = np.exp(-1j * np.pi * grid * (taps - 1) / 2)
        row[:] = np.fft.irfft(gain * shift)[:taps] * np.hamming(taps)
    return out


def filtered(a: Column, bank: np.ndarray, pooled: int | None = None) -> Column:
    """Same-size convolution with each filter, rectified, as 20 log10(1 + x); averages of ``pooled`` samples if given.  array<double>, filter after filter."""

    def run(x: np.ndarray) -> np.ndarray:
        n, taps = x.shape[1], bank.shape[1]
        size = n + taps - 1
        z = np.fft.irfft(np.fft.rfft(x, size)[:, None] * np.fft.rfft(bank, size)[None], size)[..., (taps - 1) // 2 : (taps - 1) // 2 + n]
        z = 20 * np.log10(1 + np.maximum(z, 0))
        if pooled:
            z = z[..., : n // pooled * pooled].reshape(*z.shape[:2], -1, pooled).mean(-1)
        return z.reshape(len(x), -1)

    return frames_udf(run)(a)


def autocorrelation(a: Column) -> Column:
    """Of lags 0 to n - 1, by the zero-padded spectrum."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        return np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n)) ** 2, 2 * n)[:, :n]

    return frames_udf(run)(a)


def auto_correlogram(a: Column, bank: np.ndarray, width: int) -> Column:
    """Correlation of every window of ``width`` filtered samples with itself: window, lag from -width to width - 1, filter, flat.

    Filters are applied where they lie whole inside the frame, so a frame of n samples has
    n - taps - width + 2 windows; a shorter one has none.  A long series is framed first, in
    steps of k samples with windows of k + taps + width - 2.  Scaled by 1 / sqrt(2 width).

    Rows are worked on and handed back some at a time, so memory does not follow the size of
    Spark's batches.
    """

    def run(x: np.ndarray) -> np.ndarray:
        taps = bank.shape[1]
        if x.shape[1] < taps + width - 1:
            return np.zeros((len(x), 0))
        y = np.lib.stride_tricks.sliding_window_view(x, taps, axis=1) @ bank.T
        z = np.fft.fft(np.lib.stride_tricks.sliding_window_view(y, width, axis=1), 2 * width, norm="ortho")
        r = np.fft.ifft(np.abs(z) ** 2, norm="ortho").real
        return np.fft.fftshift(r, axes=-1).transpose(0, 1, 3, 2).reshape(len(x), -1)

    return frames_udf(run, lambda n: max(0, n - bank.shape[1] - width + 2) * 2 * width * len(bank))(a)


def linear_bins(samples_per_second: int, n: int) -> LinearScale:
    """The bins of an rfft of n samples."""
    return LinearScale.from_sample_rate(samples_per_second, n // 2 + 1)


def band_sums(values: Column, edges: list[tuple[int, int]]) -> Column:
    return F.array(*[total(F.slice(values, lo + 1, hi - lo)) if hi > lo else F.lit(0.0) for lo, hi in edges])
