"""Queries of the streaming operators, and of the operators that need whole series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import FRAMES, SERIES, frames, query, r6, series, table
from .functions import arrays as A
from .functions import transforms as X
from .operators import framing, segment
from .queries_spectral import RATE, _product, _told, _told_sql
from .scales import Band, LinearScale
from .signal import Signal
from .storage import new_folder
from .streaming import sinks, stateful
from .units import TimeDimension


def _streamed(df: DataFrame) -> DataFrame:
    """A table as a stream of its files."""
    path = new_folder(df.sparkSession, "stream-source")
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _with_last(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("last", F.col("ix") == F.count(F.lit(1)).over(Window.partitionBy(by)) - 1)


def _labelled(spark, d) -> DataFrame:
    """Embeddings as one series of frames a label: label, ix, coeffs."""
    rows = framing.ordinal(frames(spark, d), ["label"], ["vec_id"])
    return rows.select("label", "ix", F.col("v").alias("coeffs"))


_LABELLED = f"{FRAMES}, labelled AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ix, v FROM frames)"


@query("streaming_flux", f"WITH {_LABELLED}, b AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY ix) AS u FROM labelled) SELECT label, ix, CASE WHEN u IS NULL THEN 0 ELSE round(list_distance(v, u), 6) + 0.0 END AS flux FROM b")
def streaming_flux(spark, d):
    """Distance from the frame before, which the state carries over."""
    made = stateful.flux(_streamed(_with_last(_labelled(spark, d), "label")), ["label"])
    return sinks.drained(made).select("label", "ix", r6(F.col("flux"), "flux"))


_PEAKS = f"""{SERIES}, f AS (SELECT user_id, ix, list_concat(list_resize([]::DOUBLE[], greatest(0, 5 - ix), 0), array_agg(value) OVER (PARTITION BY user_id ORDER BY ix ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) AS f FROM series),
p AS (SELECT user_id, ix, f[5] > f[4] AND f[6] < f[5] AND f[6] > 1.25 * list_sum(f) / 11 AS peak FROM f)"""


@query("streaming_peaks", f"WITH {_PEAKS} SELECT user_id, ix, peak FROM p")
def streaming_peaks(spark, d):
    """Onsets of a stream of samples; the state carries the frame's tail and the position."""
    return sinks.drained(stateful.peaks(_streamed(_with_last(series(spark, d), "user_id")), ["user_id"]))


@query("streaming_segments", f"""WITH {SERIES}, n AS (SELECT user_id, count(*) AS n FROM series GROUP BY user_id), cuts AS (SELECT user_id, ix FROM series WHERE ix = 0 OR value > 50)
SELECT user_id, ix * 1000 AS start_ps, (coalesce(lead(ix) OVER (PARTITION BY user_id ORDER BY ix), n) - ix) * 1000 AS duration_ps FROM cuts JOIN n USING (user_id)""")
def streaming_segments(spark, d):
    """Stretches between samples above 50; the open one is the state."""
    rows = _with_last(series(spark, d), "user_id").withColumn("peak", F.col("value") > 50)
    return sinks.drained(stateful.segments(_streamed(rows), ["user_id"], 1000))


@query("streaming_merge", f"WITH {SERIES} SELECT user_id, ix, 2::BIGINT AS n, round(3 * value, 6) + 0.0 AS total FROM series")
def streaming_merge(spark, d):
    """Two streams of equal rate side by side, one row a second from 2024 on."""
    rows = series(spark, d).withColumn("at", F.timestamp_seconds(F.col("ix") + 1704067200))
    a = _streamed(rows.select("user_id", "ix", "at", F.array("value").alias("coeffs")))
    b = _streamed(rows.select("user_id", "ix", "at", F.array(2 * F.col("value")).alias("coeffs")))
    made = sinks.drained(stateful.merged(a, b, ["user_id"], "at", "1 day"))
    return made.select("user_id", "ix", F.size("coeffs").cast("long").alias("n"), r6(A.total(F.col("coeffs")), "total"))


@query("streaming_index", "SELECT md5(vec_id::VARCHAR) AS index_id, label FROM embeddings")
def streaming_index(spark, d):
    """An index that follows a stream: started again it adds nothing, and entries that it has stay single."""
    entries = table(spark, d, "embeddings").select(F.md5(F.col("vec_id").cast("string")).alias("index_id"), "label")
    out, at = new_folder(spark, "index"), new_folder(spark, "offsets")
    stream = _streamed(entries)
    for offsets in (at, at, new_folder(spark, "offsets")):
        sinks.follow(stream, out, offsets).awaitTermination()
    return spark.read.parquet(out).select("index_id", "label")


# whole series
_FIR = X.fir_bank(LinearScale(Band(500.0, 4500.0), 4), 9, RATE)
_FIR_FRAME = X.fir_bank(LinearScale(Band(500.0, 4500.0), 4), 64, RATE)
_WIDTH = 16


@query("fir_filters", f"WITH {FRAMES} SELECT vec_id, {_told_sql(_product(_FIR_FRAME))} FROM frames")
def fir_filters(spark, d):
    """Every frame by a bank of four linear-phase filters."""
    return frames(spark, d).select("vec_id", _told(A.matmul(_FIR_FRAME, F.col("v"))))


@query("auto_correlogram", f"""WITH {FRAMES}, k AS (SELECT unnest(range(0, 4)) AS f, unnest({_FIR.tolist()}::DOUBLE[][]) AS w),
y AS (SELECT vec_id, f, t, list_inner_product(v[t + 1 : t + 9], w) AS y FROM frames, k, (SELECT unnest(range(0, 56)) AS t)),
r AS (SELECT a.vec_id, a.f, b.t - a.t AS lag, sum(a.y * b.y * greatest(0, least(40, a.t) - greatest(0, b.t - 15) + 1)) / sqrt(32) AS r FROM y a JOIN y b ON a.vec_id = b.vec_id AND a.f = b.f AND b.t BETWEEN a.t AND a.t + 15 GROUP BY ALL)
SELECT vec_id, f::INTEGER AS filter, lag::INTEGER AS lag, round(r, 6) + 0.0 AS total FROM r UNION ALL SELECT vec_id, f::INTEGER, -lag::INTEGER, round(r, 6) + 0.0 FROM r WHERE lag > 0
UNION ALL SELECT vec_id, f::INTEGER, -16, 0.0 FROM frames, k""")
def auto_correlogram(spark, d):
    """Sums over the windows of each frame's filtered autocorrelation."""
    made = frames(spark, d).select("vec_id", F.posexplode(X.auto_correlogram(F.col("v"), _FIR, _WIDTH)).alias("at", "x"))
    lag = (F.floor(F.col("at") / len(_FIR)) % (2 * _WIDTH) - _WIDTH).cast("int")
    return made.groupBy("vec_id", (F.col("at") % len(_FIR)).cast("int").alias("filter"), lag.alias("lag")).agg(r6(F.sum("x"), "total"))


@query("squeeze", f"WITH {FRAMES} SELECT vec_id, {_told_sql('v')} FROM frames")
def squeeze(spark, d):
    return frames(spark, d).select("vec_id", _told(A.squeeze(F.array("v"))))


@query("reduce_time", f"WITH {_LABELLED}, x AS (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM labelled), m AS (SELECT label, i, max(x) AS x FROM x GROUP BY label, i) SELECT label, round(sum(x * i), 6) + 0.0 AS told FROM m GROUP BY label")
def reduce_time(spark, d):
    """The greatest of each coefficient over a series: time goes, the scale stays."""
    s = Signal(_labelled(spark, d), ["label"], TimeDimension(10**12), LinearScale(Band(0.0, RATE / 2), 64), value="coeffs")
    return s.reduced("time", "max").select("label", _told(F.col("coeffs")))


@query("reduce_scale", f"WITH {_LABELLED} SELECT label, ix, round(list_avg(v), 6) + 0.0 AS mean FROM labelled")
def reduce_scale(spark, d):
    s = Signal(_labelled(spark, d), ["label"], TimeDimension(10**12), LinearScale(Band(0.0, RATE / 2), 64), value="coeffs")
    return s.reduced("scale", "mean").df.select("label", "ix", r6(F.col("coeffs"), "mean"))


@query("rainbowgram")
def rainbowgram(spark, d):
    """Colours of each label's frames, halves taken as real and imaginary parts."""
    rows = _labelled(spark, d).select("label", "ix", F.slice("coeffs", 1, 32).alias("re"), F.slice("coeffs", 33, 32).alias("im"))
    return segment.rainbowgram(rows, ["label"])
