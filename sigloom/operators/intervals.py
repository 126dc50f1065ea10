"""Intervals (start_ps, duration_ps; a null duration has no end) and the joins that they drive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def end(start: Column, duration: Column) -> Column:
    return start + duration


def overlaps(start: Column, duration: Column, q_start: Column, q_duration: Column) -> Column:
    """The row ends after the query's start and begins before its end."""
    after = duration.isNull() | (start + duration > q_start)
    return after & (q_duration.isNull() | (start < q_start + q_duration))


def contains(start: Column, duration: Column, t: Column) -> Column:
    """Strictly inside."""
    return (t > start) & (duration.isNull() | (t < start + duration))


def intersection(a_start: Column, a_duration: Column, b_start: Column, b_duration: Column) -> Column:
    """struct<start_ps, duration_ps>; apart intervals have duration 0."""
    start = F.greatest(a_start, b_start)
    stop = F.least(a_start + a_duration, b_start + b_duration)
    return F.struct(start.alias("start_ps"), F.when(stop.isNotNull(), F.greatest(F.lit(0), stop - start)).alias("duration_ps"))


def between(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """start_ps, duration_ps between consecutive times of each series: one fewer than the times."""
    w = Window.partitionBy(*by).orderBy(at)
    return df.select(*by, F.col(at).alias("start_ps"), (F.lead(at).over(w) - F.col(at)).alias("duration_ps")).where("duration_ps IS NOT NULL")


def overlapping(df: DataFrame, queries: DataFrame, by: list[str]) -> DataFrame:
    """Rows of df that overlap a query slice of their series, each once."""
    q = queries.select(*[F.col(c).alias(f"__q_{c}") for c in by], F.col("start_ps").alias("__qs"), F.col("duration_ps").alias("__qd"))
    on = overlaps(F.col("start_ps"), F.col("duration_ps"), F.col("__qs"), F.col("__qd"))
    for c in by:
        on = on & (F.col(c) == F.col(f"__q_{c}"))
    return df.join(q, on, "left_semi")


def covered_rows(start: Column, duration: Column, frequency: int, row_duration: int) -> tuple[Column, Column]:
    """First row and the one after the last of an axis that an interval covers (the rule of TimeDimension.rows)."""
    lo = F.greatest(F.lit(0), F.floor((start - (row_duration - frequency)) / frequency))
    return lo.cast("long"), F.ceil(F.bround((start + duration) / frequency, 2)).cast("long")


def pooled(frames: DataFrame, slices: DataFrame, by: list[str], frequency: int, row_duration: int, how: Callable[[Column], Column], ix: str = "ix", value: str = "value") -> DataFrame:
    """slices with the aggregate of the rows that each covers; slices that cover none are dropped.

    An interval's rows are enumerated and met by equality on (series, row), so
    the join is hashed or merged, never a comparison of all with all.
    """
    lo, hi = covered_rows(F.col("start_ps"), F.col("duration_ps"), frequency, row_duration)
    cells = slices.withColumns({"__lo": lo, "__hi": hi}).where("__lo < __hi").withColumn("__ix", F.explode(F.sequence(F.col("__lo"), F.col("__hi") - 1)))
    rows = frames.select(*by, F.col(ix).cast("long").alias("__ix"), F.col(value).alias("__v"))
    return cells.join(rows, [*by, "__ix"]).groupBy(*slices.columns).agg(how(F.col("__v")).alias("pooled"))


def merge_streams(streams: list[DataFrame], by: list[str], ix: str = "ix", value: str = "coeffs") -> DataFrame:
    """Streams of equal rate side by side: rows that all have, their arrays joined."""
    if len(streams) < 2:
        raise ValueError("merging takes two streams or more")
    out = streams[0].select(*by, ix, F.col(value).alias("__0"))
    for i, s in enumerate(streams[1:], 1):
        out = out.join(s.select(*by, ix, F.col(value).alias(f"__{i}")), [*by, ix])
    return out.select(*by, ix, F.concat(*[F.col(f"__{i}") for i in range(len(streams))]).alias(value))


def concat_slices(*parts: DataFrame) -> DataFrame:
    """Variable-rate series one after another, in order of their starts."""
    out = parts[0]
    for p in parts[1:]:
        if [d for _, d in p.dtypes] != [d for _, d in out.dtypes]:
            raise ValueError("payloads of different shapes")
        out = out.unionByName(p)
    return out.orderBy("start_ps")


def concat_rows(a: DataFrame, b: DataFrame, by: list[str], ix: str = "ix") -> DataFrame:
    """b after a on the row axis of each series."""
    sizes = a.groupBy(*by).agg((F.max(ix) + 1).alias("__n"))
    moved = b.join(sizes, by, "left").withColumn(ix, F.col(ix) + F.coalesce(F.col("__n"), F.lit(0))).drop("__n")
    return a.unionByName(moved.select(*a.columns))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """left with the last value of right at or before its time: one sort of both sides together."""
    a = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(1))
    b = right.select(*by, at, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(f"as_of_{value}", F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").drop("__v", "__side")


def spans(df: DataFrame, by: list[str]) -> DataFrame:
    """First start, end of the last slice by start, and the span between."""
    last = F.max_by(F.col("start_ps") + F.col("duration_ps"), F.struct("start_ps", "duration_ps"))
    return df.groupBy(*by).agg(F.min("start_ps").alias("start_ps"), last.alias("end_ps")).withColumn("span_ps", F.col("end_ps") - F.col("start_ps"))


def new_only(items: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Items whose key is not stored yet."""
    return items.join(stored.select(key).distinct(), key, "left_anti")
