"""What a client asks for: a part of one document's feature, and results as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..signal import Signal
from ..units import S, TimeSlice


def slice_feature(signal: Signal, key: dict, start_s: float | None = None, stop_s: float | None = None) -> DataFrame:
    """Rows of one series (its keys' values in ``key``) between two times in seconds; the filters reach the scan."""
    df = signal.df
    for column, value in key.items():
        df = df.where(F.col(column) == F.lit(value))
    start = int((start_s or 0) * S)
    part = TimeSlice(None if stop_s is None else int(stop_s * S) - start, start)
    return Signal(df, signal.by, signal.time, signal.scale, signal.ix, signal.value)[part].df


def slices_json(start: Column, duration: Column) -> Column:
    """A segment as seconds."""
    return F.to_json(F.struct((start / S).alias("start"), (duration / S).alias("duration")))


def search_json(hits: DataFrame, query: Column) -> DataFrame:
    """One row: the query in base64 and the hits (id, distance) by distance."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("distance"), F.col("id"))))
    return hits.agg(rows.alias("hits")).select(F.to_json(F.struct(F.base64(query).alias("query"), F.col("hits"))).alias("result"))
