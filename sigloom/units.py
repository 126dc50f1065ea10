"""Time axes in whole picoseconds.

Everything here is plain Python on the driver: it plans integer row ranges and
frame sizes, which the operators turn into Spark predicates.  A picosecond count
fits a BIGINT for 106 days, where Spark's own intervals would round to micros.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from fractions import Fraction

PS = 1
NS, US, MS, S = 10**3, 10**6, 10**9, 10**12
MINUTE, HOUR = 60 * S, 3600 * S

#: Hops and windows, in samples, of half-lapped frames at the known rates.
KNOWN_RATES = {96000: (4096, 2048), 48000: (2048, 1024), 44100: (2048, 1024), 22050: (1024, 512), 16000: (512, 256), 11025: (512, 256)}


def hours(n) -> int:
    return int(n) * HOUR


def minutes(n) -> int:
    return int(n) * MINUTE


def seconds(n) -> int:
    return int(n) * S


def milliseconds(n) -> int:
    return int(n) * MS


def microseconds(n) -> int:
    return int(n) * US


def nanoseconds(n) -> int:
    return int(n) * NS


def picoseconds(n) -> int:
    return int(n)


def half_even(numerator: int, denominator: int) -> Fraction:
    """A quotient rounded to hundredths, ties to even."""
    return Fraction(round(Fraction(numerator * 100, denominator)), 100)


@dataclass(frozen=True)
class Stride:
    """Step and width of a window in units of the axis below it."""

    frequency: int = 1
    duration: int = 1


@dataclass(frozen=True)
class SampleRate:
    """Distance and extent of samples in picoseconds."""

    frequency: int
    duration: int | None = None

    def __post_init__(self) -> None:
        if self.duration is None:
            object.__setattr__(self, "duration", self.frequency)
        if self.frequency <= 0 or self.duration <= 0:
            raise ValueError("frequency and duration are positive")

    @property
    def overlap(self) -> int:
        return self.duration - self.frequency

    @property
    def overlap_ratio(self) -> float:
        return self.overlap / self.duration

    @property
    def samples_per_second(self) -> int:
        return S // self.frequency

    @property
    def nyquist(self) -> int:
        return self.samples_per_second // 2

    def __mul__(self, by: Stride | tuple[int, ...] | int) -> SampleRate:
        """A window over this axis; a plain number is both its step and its width."""
        if isinstance(by, Stride):
            step, width = by.frequency, by.duration
        elif isinstance(by, tuple):
            step, width = by if len(by) == 2 else by * 2
        else:
            step = width = by
        return SampleRate(int(self.frequency * step), int(self.frequency * width) + self.overlap)

    def discrete_samples(self, axis: TimeDimension | SampleRate) -> tuple[int, int]:
        """Step and width in samples of another axis."""
        return round(self.frequency / axis.frequency), round(self.duration / axis.frequency)

    def resample(self, ratio: float) -> SampleRate:
        return SampleRate(int(self.frequency * ratio), int(self.duration * ratio))


def rate(samples_per_second: int) -> SampleRate:
    return SampleRate(S // samples_per_second)


SR96000, SR48000, SR44100, SR22050, SR16000, SR11025 = map(rate, KNOWN_RATES)


def audio_rate(samples_per_second: int) -> SampleRate:
    if samples_per_second not in KNOWN_RATES:
        raise ValueError(f"{samples_per_second} is not one of {sorted(KNOWN_RATES)}")
    return rate(samples_per_second)


def nearest_audio_rate(samples_per_second: float) -> SampleRate:
    return rate(min(KNOWN_RATES, key=lambda r: (abs(r - samples_per_second), r)))


def half_lapped(samples_per_second: int = 44100) -> SampleRate:
    """Windows of the rate's suggested size that overlap by half."""
    window, hop = KNOWN_RATES[samples_per_second]
    one = S // samples_per_second
    return SampleRate(one * hop, one * window)


@dataclass(frozen=True, order=False)
class TimeSlice:
    """A half-open interval; no duration means no end."""

    duration: int | None = None
    start: int = 0

    def __post_init__(self) -> None:
        for x in (self.duration, self.start):
            if x is not None and (isinstance(x, bool) or not isinstance(x, int)):
                raise ValueError("times are whole picoseconds")

    @property
    def end(self) -> int | None:
        return None if self.duration is None else self.start + self.duration

    def __add__(self, by: int) -> TimeSlice:
        return replace(self, start=self.start + by)

    def __and__(self, other: TimeSlice) -> TimeSlice:
        """The part in both, of duration 0 where they are apart; it keeps its start."""
        start = max(self.start, other.start)
        ends = [e for e in (self.end, other.end) if e is not None]
        return TimeSlice(max(0, min(ends) - start) if ends else None, start)

    def __contains__(self, other: int | TimeSlice) -> bool:
        """Strictly inside at both ends."""
        inside = lambda t: self.start < t and (self.end is None or t < self.end)
        if isinstance(other, TimeSlice):
            return inside(other.start) and (inside(other.end) if other.end is not None else self.end is None)
        if isinstance(other, int):
            return inside(other)
        raise ValueError("a time or a slice")

    def __lt__(self, other: TimeSlice | int) -> bool:
        return self.start < (other.start if isinstance(other, TimeSlice) else other)

    def __gt__(self, other: TimeSlice | int) -> bool:
        return self.start > (other.start if isinstance(other, TimeSlice) else other)

    @staticmethod
    def between(times: list[int]) -> list[TimeSlice]:
        """The intervals between sorted times, one fewer than these."""
        at = sorted(times)
        return [TimeSlice(b - a, a) for a, b in zip(at, at[1:])]


@dataclass(frozen=True)
class TimeDimension:
    """The row axis of a signal: row i covers [i * frequency, i * frequency + duration)."""

    frequency: int
    duration: int | None = None
    size: int | None = None

    def __post_init__(self) -> None:
        if self.duration is None:
            object.__setattr__(self, "duration", self.frequency)

    @property
    def overlap(self) -> int:
        """What a row shares with the next."""
        return self.duration - self.frequency

    @property
    def rate(self) -> SampleRate:
        """The axis without its size."""
        return SampleRate(frequency=self.frequency, duration=self.duration)

    @property
    def span(self) -> int:
        return self.size * self.frequency + self.overlap

    end = span

    @property
    def end_seconds(self) -> float:
        return self.end / S

    def resample(self, ratio: float) -> TimeDimension:
        r = self.rate.resample(ratio)
        return replace(self, frequency=r.frequency, duration=r.duration)

    def rows(self, part: TimeSlice) -> tuple[int, int | None]:
        """First row and the one after the last that a slice touches; an open slice ends at the size."""
        first = max(0, (part.start - self.overlap) // self.frequency)
        if part.end is None:
            return first, self.size
        return first, math.ceil(half_even(part.end, self.frequency))

    def between(self, start: int | None = None, stop: int | None = None) -> TimeSlice:
        """A slice from bounds of which negative ones count from the end."""
        at = lambda t: self.end + t if t is not None and t < 0 else t
        start, stop = at(start) or 0, at(stop)
        return TimeSlice(None if stop is None else stop - start, start)

    def windowed(self, window: int, step: int, n: int | None = None) -> tuple[TimeDimension, TimeDimension]:
        """Axes of frames: the frames' own and that of the samples inside one."""
        outer = self.rate * (step, window)
        return TimeDimension(outer.frequency, outer.duration, n), replace(self, size=window)

    def window_of(self, scheme: SampleRate) -> tuple[int, int]:
        """Window and step in rows of a scheme given in time, by the rule of rows()."""
        count = lambda t: math.ceil(half_even(t, self.frequency))
        return count(scheme.duration), count(scheme.frequency)

    def metadata(self) -> dict:
        return {"freq_ps": self.frequency, "dur_ps": self.duration} | ({} if self.size is None else {"size": self.size})

    @staticmethod
    def from_metadata(m: dict) -> TimeDimension:
        return TimeDimension(m["freq_ps"], m["dur_ps"], m.get("size"))


@dataclass(frozen=True)
class IdentityDimension:
    """An axis without a unit; it can only be windowed as a whole."""

    size: int | None = None

    def windowed(self, window: int, step: int) -> IdentityDimension:
        if self.size is not None and window < self.size:
            raise ValueError("a unit-less axis is windowed whole or not at all")
        return self


def padded_length(n: int, window: int, step: int) -> int:
    """Rows after zero padding; a result below n means that none are added."""
    if n <= window:
        return window
    if window > step:
        return n // step * step + window - step
    return -(-n // step) * step


def frame_count(n: int, window: int, step: int, pad: bool = True) -> int:
    """Frames over n rows; without padding a single, exactly full window is still withheld."""
    if window < 1 or step < 1:
        raise ValueError("window and step are at least 1")
    if pad:
        return 0 if n == 0 else 1 + (max(n, padded_length(n, window, step)) - window) // step
    return 0 if n <= window else 1 + (n - window) // step


def leftover_start(n: int, window: int, step: int) -> int:
    """First row that the frames without padding leave for the next chunk."""
    return frame_count(n, window, step, pad=False) * step
