"""Lapped frames over ordered rows, and back.

A signal is a DataFrame with keys that name a series (``by``), a row number from
0 inside it (``ix``) and a value.  Every operator is partitioned by the series'
keys, so nothing funnels into one task unless the input is one series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(df: DataFrame, by: list[str], order: list[str], ix: str = "ix") -> DataFrame:
    """Number the rows of each series from 0."""
    return df.withColumn(ix, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def frame_total(n: Column, window: int, step: int, pad: bool) -> Column:
    """Frames of a series of n rows."""
    if not pad:
        return F.when(n > window, 1 + F.floor((n - window) / step)).otherwise(0).cast("long")
    length = F.floor(n / step) * step + (window - step) if window > step else F.ceil(n / step) * step
    whole = F.when(n <= window, window).otherwise(F.greatest(n, length))
    return F.when(n > 0, 1 + F.floor((whole - window) / step)).otherwise(0).cast("long")


def sliding_window(df: DataFrame, by: list[str], window: int, step: int, pad: bool = True, ix: str = "ix", value: str = "value") -> DataFrame:
    """by, frame, samples: the frames of each series; with ``pad`` the last ones are filled with zeros.

    Each row goes to the frames that hold it and frames gather their rows: one
    shuffle by series for the counts, which the frames' grouping then refines.
    """
    if window < 1 or step < 1:
        raise ValueError("window and step are at least 1")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = df.select(*by, F.col(ix).cast("long").alias("__i"), F.col(value).alias("__v"), frame_total(n, window, step, pad).alias("__n"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("__i") - window + 1) / step)).cast("long")
    hi = F.least(F.col("__n") - 1, F.floor(F.col("__i") / step)).cast("long")
    spread = rows.where(lo <= hi).select(*by, F.explode(F.sequence(lo, hi)).alias("frame"), "__i", "__v")
    got = spread.groupBy(*by, "frame").agg(F.array_sort(F.collect_list(F.struct(F.col("__i"), F.col("__v")))).alias("__s"))
    values = F.transform("__s", lambda s: s["__v"])
    return got.select(*by, "frame", F.concat(values, F.array_repeat(F.lit(0.0), F.lit(window) - F.size(values))).alias("samples"))


def leftovers(df: DataFrame, by: list[str], window: int, step: int, ix: str = "ix") -> DataFrame:
    """The rows that the frames without padding leave for the next chunk."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("__first", frame_total(n, window, step, False) * step).where(F.col(ix) >= F.col("__first")).drop("__first")


def decimate(df: DataFrame, step: int, ix: str = "ix") -> DataFrame:
    return df.where(F.pmod(F.col(ix), F.lit(step)) == 0)


def chunks(df: DataFrame, by: list[str], size: int, ix: str = "ix", value: str = "value") -> DataFrame:
    """by, chunk, samples: tumbling chunks; the last may be short."""
    rows = df.select(*by, F.floor(F.col(ix) / size).cast("long").alias("chunk"), F.struct(F.col(ix).alias("i"), F.col(value).alias("v")).alias("s"))
    got = rows.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return got.select(*by, "chunk", F.transform("s", lambda s: s["v"]).alias("samples"))


def overlap_add(frames: DataFrame, by: list[str], hop: int, frame: str = "frame", samples: str = "samples") -> DataFrame:
    """by, ix, value: frames laid at their hops and summed."""
    rows = frames.select(*by, F.col(frame).alias("__f"), F.posexplode(samples).alias("__p", "__v"))
    return rows.groupBy(*by, (F.col("__f") * hop + F.col("__p")).cast("long").alias("ix")).agg(F.sum("__v").alias("value"))


def time_rows(df: DataFrame, first: int, stop: int | None, ix: str = "ix") -> DataFrame:
    """Rows of a slice planned by TimeDimension.rows()."""
    found = F.col(ix) >= first
    return df.where(found if stop is None else found & (F.col(ix) < stop))


def slices(df: DataFrame, frequency: int, duration: int, ix: str = "ix") -> DataFrame:
    """The interval of every row."""
    return df.withColumns({"start_ps": F.col(ix) * F.lit(frequency), "duration_ps": F.lit(duration).cast("long")})
