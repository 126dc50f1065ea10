"""A signal: rows, the columns that name a series, and the units of its axes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import arrays as A
from .operators import framing
from .scales import Band, Scale
from .units import SampleRate, TimeDimension, TimeSlice


@dataclass(frozen=True)
class Signal:
    """df(by..., ix, value): value is a number, or a frame of coefficients over a scale."""

    df: DataFrame
    by: list[str]
    time: TimeDimension
    scale: Scale | None = None
    ix: str = "ix"
    value: str = "value"

    def __getitem__(self, at) -> Signal:
        """signal[time slice], signal[time slice, band]; a Python slice of picoseconds counts negative bounds from the end."""
        when, band = at if isinstance(at, tuple) else (at, None)
        out = self
        if when is not None and when != slice(None):
            part = when if isinstance(when, TimeSlice) else self.time.between(when.start, when.stop)
            out = replace(out, df=framing.time_rows(out.df, *out.time.rows(part), ix=out.ix))
        if band is not None:
            lo, hi = self.scale.bins(band) if isinstance(band, Band) else (band.start or 0, len(self.scale) if band.stop is None else band.stop)
            out = replace(out, df=out.df.withColumn(out.value, A.band(F.col(out.value), lo, hi)), scale=self.scale[lo:hi])
        return out

    def frames(self, scheme: SampleRate | tuple[int, int], pad: bool = True) -> Signal:
        """Lapped frames; the scheme is in time, or (window, step) in rows."""
        window, step = scheme if isinstance(scheme, tuple) else self.time.window_of(scheme)
        made = framing.sliding_window(self.df, self.by, window, step, pad, self.ix, self.value)
        outer, _ = self.time.windowed(window, step)
        return Signal(made.withColumnsRenamed({"frame": "ix", "samples": "value"}), self.by, outer)

    def map(self, f: Callable[[Column], Column], scale: Scale | None = None) -> Signal:
        return replace(self, df=self.df.withColumn(self.value, f(F.col(self.value))), scale=scale or self.scale)

    def reduced(self, axis: str, how: str = "sum") -> Signal | DataFrame:
        """Without one axis, "time" or "scale", by sum, max, min or mean.

        Over the scale a signal of numbers stays; over time a table of one value or
        frame (of equal sizes) a series.
        """
        if axis == "scale":
            f = {"sum": A.total, "max": F.array_max, "min": F.array_min, "mean": A.mean}[how]
            return replace(self, df=self.df.withColumn(self.value, f(F.col(self.value))), scale=None)
        if axis != "time":
            raise ValueError(f"no axis {axis}")
        f = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[how]
        if self.scale is None:
            return self.df.groupBy(*self.by).agg(f(self.value).alias(self.value))
        cells = self.df.select(*self.by, F.posexplode(self.value).alias("__bin", "__x")).groupBy(*self.by, "__bin").agg(f("__x").alias("__x"))
        return cells.groupBy(*self.by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__bin", "__x"))), lambda c: c["__x"]).alias(self.value))

    def slices(self) -> DataFrame:
        return framing.slices(self.df, self.time.frequency, self.time.duration, self.ix)

    def with_metadata(self) -> DataFrame:
        """The rows with the axes in the value's field metadata."""
        m = {"time": json.dumps(self.time.metadata())} | ({} if self.scale is None else {"scale": json.dumps(self.scale.encoded())})
        return self.df.withMetadata(self.value, m)

    @staticmethod
    def from_metadata(df: DataFrame, by: list[str], ix: str = "ix", value: str = "value") -> Signal:
        m = df.schema[value].metadata
        return Signal(df, by, TimeDimension.from_metadata(json.loads(m["time"])), Scale.decoded(json.loads(m["scale"])) if "scale" in m else None, ix, value)


def checked_size(a: Column, n: int) -> Column:
    """The frame, or a failure where its size is another."""
    return F.when(F.size(a) == n, a).otherwise(F.raise_error(F.lit(f"a frame has {n} coefficients")).cast("array<double>"))
