"""Chunked signals as streams.

Rows of a series arrive in order of ``ix``; a row with ``last`` set ends the
series and flushes what is held.  State is one small record a series: the tail
that no complete frame has used, the frame before, or the open segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..units import frame_count


def _sorted(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values("ix")


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)


def framed(df: DataFrame, by: list[str], window: int, step: int, before: int = 0) -> DataFrame:
    """by, frame, samples of a stream by..., ix, value, last; ``before`` zeros precede the first row.

    As in a batch: a frame that is exactly full waits until more rows come or the
    series ends, when the tail is filled with zeros.  Of windows further apart than
    they are long, the rows between are skipped, also across chunks.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(batches)
        tail, at, skip = state.get if state.exists else ([0.0] * before, 0, 0)
        held = np.concatenate([np.asarray(tail, float), pdf.value.to_numpy(float)])
        held, skip = held[skip:], max(0, skip - len(held))
        end = bool(pdf["last"].any())
        n = frame_count(at * step - skip + len(held), window, step) - at if end else frame_count(len(held), window, step, pad=False)
        if n:
            size = (n - 1) * step + window
            x = np.pad(held, (0, max(0, size - len(held))))
            frames = np.lib.stride_tricks.sliding_window_view(x, window)[::step][:n]
            yield pd.DataFrame({**{k: [v] * n for k, v in zip(by, key, strict=True)}, "frame": np.arange(at, at + n), "samples": list(frames)})
        if end:
            state.remove()
        else:
            state.update((held[n * step :].tolist(), at + n, skip + max(0, n * step - len(held))))

    return df.select(*by, "ix", "value", "last").groupBy(*by).applyInPandasWithState(run, f"{_keys(df, by)}, frame long, samples array<double>", "tail array<double>, at long, skip long", "append", GroupStateTimeout.NoTimeout)


def flux(df: DataFrame, by: list[str]) -> DataFrame:
    """by, ix, flux of a stream by..., ix, coeffs, last: the frame before is carried over."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(batches)
        x = np.stack([np.asarray(a, float) for a in pdf.coeffs])
        before = np.asarray(state.get[0], float) if state.exists else x[0]
        d = np.linalg.norm(np.diff(np.concatenate([before[None], x]), axis=0), axis=1)
        yield pd.DataFrame({**{k: [v] * len(d) for k, v in zip(by, key, strict=True)}, "ix": pdf.ix.to_numpy(), "flux": d})
        if pdf["last"].any():
            state.remove()
        else:
            state.update((x[-1].tolist(),))

    return df.select(*by, "ix", "coeffs", "last").groupBy(*by).applyInPandasWithState(run, f"{_keys(df, by)}, ix long, flux double", "before array<double>", "append", GroupStateTimeout.NoTimeout)


def peaks(df: DataFrame, by: list[str], window: int = 11, before: int = 5, threshold: float = 1.25, how: str = "mean") -> DataFrame:
    """by, ix, peak of a stream by..., ix, value, last, as segment.peaks finds them in the whole series.

    A row is judged when the rows after it that its frame needs are there, or the series
    ends.  State is the frame's tail and the position of the next row.
    """
    after, c = window - before - 1, window // 2
    if not 0 <= before < window or window < 5:
        raise ValueError("the frame has 5 rows or more and the judged one is among them")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(batches)
        tail, at = state.get if state.exists else ([0.0] * before, 0)
        end = bool(pdf["last"].any())
        held = np.concatenate([np.asarray(tail, float), pdf.value.to_numpy(float), np.zeros(after if end else 0)])
        n = max(0, len(held) - window + 1)
        if n:
            x = np.lib.stride_tricks.sliding_window_view(held, window)
            # summed in order and divided last, as in segment.peaks: a row at the threshold is decided by the last bit
            least = threshold * sum(x.T) / window if how == "mean" else threshold * np.median(x, axis=1)
            found = (x[:, c - 1] > x[:, c - 2]) & (x[:, c] < x[:, c - 1]) & (x[:, c] > least)
            yield pd.DataFrame({**{k: [v] * n for k, v in zip(by, key, strict=True)}, "ix": np.arange(at, at + n), "peak": found})
        if end:
            state.remove()
        else:
            state.update((held[n:].tolist(), at + n))

    return df.select(*by, "ix", "value", "last").groupBy(*by).applyInPandasWithState(run, f"{_keys(df, by)}, ix long, peak boolean", "tail array<double>, at long", "append", GroupStateTimeout.NoTimeout)


def segments(df: DataFrame, by: list[str], frequency: int) -> DataFrame:
    """by, start_ps, duration_ps of a stream by..., ix, peak, last: a segment is emitted when the next peak, or the end, closes it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(batches)
        start = state.get[0] if state.exists else 0
        cuts = [int(i) for i in pdf.ix[pdf.peak.astype(bool)] if int(i) > start]
        end = bool(pdf["last"].any())
        edges = [start, *cuts, *([int(pdf.ix.max()) + 1] if end else [])]
        rows = [(*key, a * frequency, (b - a) * frequency) for a, b in zip(edges, edges[1:])]
        if rows:
            yield pd.DataFrame(rows, columns=[*by, "start_ps", "duration_ps"])
        if end:
            state.remove()
        else:
            state.update((edges[-1],))

    return df.select(*by, "ix", "peak", "last").groupBy(*by).applyInPandasWithState(run, f"{_keys(df, by)}, start_ps long, duration_ps long", "start long", "append", GroupStateTimeout.NoTimeout)


def event_windows(df: DataFrame, at: str, value: str, watermark: str, width: str, slide: str | None = None, by: list[str] = ()) -> DataFrame:
    """Count, sum and greatest value of event-time windows; rows later than the watermark are dropped."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    made = df.withWatermark(at, watermark).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak"))
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total", "peak")


def merged(a: DataFrame, b: DataFrame, by: list[str], at: str, watermark: str) -> DataFrame:
    """Two streams of equal rate side by side on (series, ix), their state bounded by equal event times.

    A watermark starts at 1970, so rows of that moment or before are late from the start and go.
    """
    left = a.withWatermark(at, watermark).select(*by, "ix", F.col(at), F.col("coeffs").alias("__a"))
    right = b.withWatermark(at, watermark).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("ix").alias("__ix"), F.col(at).alias("__at"), F.col("coeffs").alias("__b"))
    on = (F.col("ix") == F.col("__ix")) & (F.col(at) == F.col("__at"))
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return left.join(right, on).select(*by, "ix", at, F.concat("__a", "__b").alias("coeffs"))
