"""Ready-made feature graphs over signals (by..., ix, value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import transforms as X
from ..functions.windows import hann, oggvorbis, windowed
from ..operators import adaptive, framing, segment, synth
from ..scales import Band, BarkScale, ChromaScale
from .graph import Graph


def resampled(by: list[str], ratio: float = 1.0) -> Graph:
    return Graph().add("samples", lambda df: df.select(*by, "ix", "value"), store=False).add("resampled", lambda df: synth.resampled(df, by, ratio), "samples", store=True, version=str(ratio))


def framed(by: list[str], window: int, step: int, ratio: float = 1.0, wfunc=oggvorbis) -> Graph:
    def make(df):
        return framing.sliding_window(df, by, window, step).select(*by, F.col("frame").alias("ix"), windowed(F.col("samples"), window, wfunc).alias("coeffs"))

    return resampled(by, ratio).add("windowed", make, "resampled", version=f"{window},{step},{getattr(wfunc, '__name__', '')}")


def stft(by: list[str], window: int, step: int, ratio: float = 1.0, store: bool = True) -> Graph:
    return framed(by, window, step, ratio).add("fft", lambda df: df.select(*by, "ix", X.rfft(F.col("coeffs"), window).alias("fft")), "windowed", store=store)


def audio(by: list[str], window: int, step: int, samples_per_second: int, bands: int = 32) -> Graph:
    """All frame features in one wide projection over the spectra."""
    g = stft(by, window, step)
    bins = X.linear_bins(samples_per_second, window)
    top = Band(0.0, samples_per_second / 2)
    bark, pitches = BarkScale(top, bands), ChromaScale(Band(20.0, samples_per_second / 2))
    mag = lambda df: df.withColumn("magnitude", X.magnitude(F.col("fft")))
    g.add("magnitude", lambda df: mag(df).select(*by, "ix", "magnitude"), "fft")
    g.add("dct", lambda df: df.select(*by, "ix", X.dct(F.col("coeffs"), window).alias("dct")), "windowed")
    g.add("bark", lambda df: df.select(*by, "ix", X.apply_scale(F.col("magnitude"), bark, bins, hann).alias("bark")), "magnitude")
    g.add("chroma", lambda df: df.select(*by, "ix", X.chroma(F.col("magnitude"), pitches, bins).alias("chroma")), "magnitude")
    g.add("bfcc", lambda df: df.select(*by, "ix", X.bfcc(F.col("bark"), bands).alias("bfcc")), "bark")
    g.add("centroid", lambda df: df.select(*by, "ix", A.centroid(F.col("magnitude")).alias("centroid"), A.flatness(F.col("magnitude")).alias("flatness")), "magnitude")
    return g


def with_onsets(by: list[str], window: int, step: int, frequency: int) -> Graph:
    """Segments between the peaks of the complex-domain onset function, by a median of 12 frames, 5 before."""
    g = stft(by, window, step)
    g.add("polar", lambda df: df.select(*by, "ix", X.magnitude(F.col("fft")).alias("magnitude"), X.phase(F.col("fft")).alias("phase")), "fft")
    g.add("complex_domain", lambda df: segment.complex_domain(df, by).select(*by, "ix", F.col("onset").alias("value")), "polar")
    g.add("peaks", lambda df: segment.peaks(df, by, 12, 5, 1.25, "median"), "complex_domain")
    return g.add("onsets", lambda df: segment.segments(df, by, frequency * step), "peaks", store=True)


def frequency_adaptive(by: list[str], window: int, step: int, samples_per_second: int, scale, wfunc=hann) -> Graph:
    """Bands of a long spectrum, windowed, each by its own inverse real FFT: m complex coefficients give 2 (m - 1) in time, few for low bands, many for high ones."""
    g = stft(by, window, step)
    bins = X.linear_bins(samples_per_second, window)
    edges = [(lo, min(hi, len(bins))) for lo, hi in map(bins.bins, scale)]
    bands = adaptive.fft_bands(F.col("fft"), edges, wfunc)
    return g.add("freq_adaptive", lambda df: df.select(*by, "ix", bands.alias("bands")), "fft")


def learning(by: list[str], key: list[str], n: int) -> Graph:
    """Frames of all documents, a shuffled sample of n of them."""
    from ..operators.sampling import reservoir

    return Graph().add("examples", lambda df: df).add("shuffled", lambda df: reservoir(df, n, key), "examples", store=True, version=str(n))
