"""Frequency bands and scales: small constant tables made on the driver."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True, order=True)
class Band:
    """Frequencies from start_hz up to stop_hz."""

    start_hz: float
    stop_hz: float

    def __post_init__(self) -> None:
        if not self.stop_hz > self.start_hz:
            raise ValueError(f"an empty band: {self.start_hz} to {self.stop_hz} Hz")

    @property
    def bandwidth(self) -> float:
        return self.stop_hz - self.start_hz

    @property
    def center(self) -> float:
        return self.start_hz + self.bandwidth / 2

    @staticmethod
    def from_start(start_hz: float, width: float) -> Band:
        return Band(start_hz, start_hz + width)

    @staticmethod
    def from_center(center: float, width: float) -> Band:
        return Band(center - width / 2, center + width / 2)

    @staticmethod
    def audible(nyquist: float) -> Band:
        return Band(20.0, nyquist)

    def intersect(self, other: Band) -> Band:
        return Band(max(self.start_hz, other.start_hz), min(self.stop_hz, other.stop_hz))

    def bandwidth_ratio(self, other: Band) -> float:
        return other.bandwidth / self.bandwidth

    def intersection_ratio(self, other: Band) -> float:
        return self.intersect(other).bandwidth / self.bandwidth


def hz_to_bark(hz: float) -> float:
    return 6 * math.asinh(hz / 600)


def bark_to_hz(bark: float) -> float:
    return 600 * math.sinh(bark / 6)


def hz_to_mel(hz: float) -> float:
    return 1127 * math.log1p(hz / 700)


def mel_to_hz(mel: float) -> float:
    return 700 * math.expm1(mel / 1127)


def erb(hz: float) -> float:
    """Equivalent rectangular bandwidth."""
    return 0.108 * hz + 24.7


class Scale:
    """Bands in order."""

    kind = "explicit"

    def __init__(self, bands: Iterable[Band], always_even: bool = False):
        self.bands, self.always_even = tuple(bands), always_even

    def __len__(self) -> int:
        return len(self.bands)

    def __iter__(self):
        return iter(self.bands)

    def __eq__(self, other) -> bool:
        return isinstance(other, Scale) and self.bands == other.bands

    def __hash__(self) -> int:
        return hash(self.bands)

    @property
    def starts(self) -> list[float]:
        return [b.start_hz for b in self.bands]

    @property
    def stops(self) -> list[float]:
        return [b.stop_hz for b in self.bands]

    @property
    def centers(self) -> list[float]:
        return [b.center for b in self.bands]

    @property
    def bandwidths(self) -> list[float]:
        return [b.bandwidth for b in self.bands]

    @property
    def q(self) -> list[float]:
        return [b.center / b.bandwidth for b in self.bands]

    def bins(self, band: Band) -> tuple[int, int]:
        """First bin that ends at or after the band's start, and first that begins at or after its stop."""
        lo, hi = bisect_left(self.stops, band.start_hz), bisect_left(self.starts, band.stop_hz)
        return lo, hi + (1 if self.always_even and (hi - lo) % 2 else 0)

    def between(self, start_hz: float | None = None, stop_hz: float | None = None) -> tuple[int, int]:
        """bins() by bounds, of which negative ones count from the top."""
        top = self.stops[-1]
        at = lambda x, default: default if x is None else top + x if x < 0 else x
        return self.bins(Band(at(start_hz, 0.0), at(stop_hz, top)))

    def part(self, band: Band) -> Scale:
        lo, hi = self.bins(band)
        return Scale(self.bands[lo:hi], self.always_even)

    def __getitem__(self, at: int | slice | Band) -> Band | Scale:
        if isinstance(at, Band):
            return self.part(at)
        return Scale(self.bands[at], self.always_even) if isinstance(at, slice) else self.bands[at]

    def ensure_overlap_ratio(self, ratio: float = 0.5) -> None:
        for a, b in zip(self.bands, self.bands[1:]):
            try:
                got = a.intersection_ratio(b)
            except ValueError:
                got = 0.0
            if got < ratio:
                raise AssertionError(f"neighbouring bands overlap by {got:.4f} of {ratio}")

    def basis(self, other: Scale, window: Callable[[int], np.ndarray] | None = None) -> np.ndarray:
        """Weights of the other scale's bins in each band."""
        out = np.zeros((len(self), len(other)))
        for row, band in zip(out, self.bands):
            lo, hi = other.bins(band)
            hi = min(hi, len(other))
            if hi > lo:
                row[lo:hi] = 1.0 if window is None else window(hi - lo)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """band_ix, start_hz, stop_hz."""
        return spark.createDataFrame([(i, float(b.start_hz), float(b.stop_hz)) for i, b in enumerate(self.bands)], "band_ix int, start_hz double, stop_hz double")

    @staticmethod
    def from_rows(rows: Sequence) -> Scale:
        return Scale(Band(r["start_hz"], r["stop_hz"]) for r in sorted(rows, key=lambda r: r["band_ix"]))

    def encoded(self) -> dict:
        return {"kind": self.kind, "bands": [[b.start_hz, b.stop_hz] for b in self.bands], "always_even": self.always_even}

    @staticmethod
    def decoded(d: dict) -> Scale:
        return Scale((Band(*x) for x in d["bands"]), d.get("always_even", False))


class LinearScale(Scale):
    kind = "linear"

    def __init__(self, band: Band, n: int, always_even: bool = False):
        self.band = band
        at = np.linspace(band.start_hz, band.stop_hz, n, endpoint=False)
        width = band.bandwidth / n
        super().__init__((Band.from_start(float(a), width) for a in at), always_even)

    @staticmethod
    def from_sample_rate(samples_per_second: int, n: int, always_even: bool = False) -> LinearScale:
        return LinearScale(Band(0.0, samples_per_second // 2), n, always_even)


class GeometricScale(Scale):
    kind = "geometric"

    def __init__(self, first: float, last: float, bandwidth_ratio: float, n: int, always_even: bool = False):
        super().__init__((Band.from_center(float(c), float(c * bandwidth_ratio)) for c in np.geomspace(first, last, n)), always_even)


def _warped(band: Band, n: int, there: Callable[[float], float], back: Callable[[float], float]) -> list[Band]:
    centers = [back(x) for x in np.linspace(there(band.start_hz), there(band.stop_hz), n)]
    return [Band.from_center(float(c), float(erb(c))) for c in centers]


class BarkScale(Scale):
    kind = "bark"

    def __init__(self, band: Band, n: int):
        super().__init__(_warped(band, n, hz_to_bark, bark_to_hz))


class MelScale(Scale):
    kind = "mel"

    def __init__(self, band: Band, n: int):
        super().__init__(_warped(band, n, hz_to_mel, mel_to_hz))


class ChromaScale:
    """Twelve pitch classes around a concert pitch of 440 Hz, over all octaves in a band."""

    def __init__(self, band: Band, concert: float = 440.0):
        self.band, self.concert = band, concert

    def __len__(self) -> int:
        return 12

    def hz(self, semitone: float) -> float:
        return self.concert * 2 ** (semitone / 12)

    def semitone(self, hz: float) -> float:
        return 12 * math.log2(hz / self.concert)

    def basis(self, other: Scale, window: Callable[[int], np.ndarray] | None = None) -> np.ndarray:
        out = np.zeros((12, len(other)))
        low, high = (round(self.semitone(x)) for x in (self.band.start_hz, self.band.stop_hz))
        for s in range(low - 1, high - 2):
            lo, hi = other.bins(Band(self.hz(s), self.hz(s + 2)))
            hi = min(hi, len(other))
            if hi > lo:
                out[s % 12, lo:hi] += 1.0 if window is None else window(hi - lo)
        return out


def a_weighting(scale: Scale) -> np.ndarray:
    """The A curve at the bands' centres, shifted so that its least value is 1."""
    f2 = np.array(scale.centers) ** 2
    gain = 12200.0**2 * f2**2 / ((f2 + 20.6**2) * (f2 + 12200.0**2) * np.sqrt((f2 + 107.7**2) * (f2 + 737.9**2)))
    db = 20 * np.log10(gain)
    return db - db.min() + 1
