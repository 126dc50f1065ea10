"""Samples that equal the threshold but for the last bit: 1.25 * sum / 11 decides, as in the SQL."""

from pyspark.sql import functions as F

from sigloom.operators import segment
from sigloom.queries_streaming import _streamed
from sigloom.streaming import sinks, stateful

#: 67.75 against 1.25 * sum / 11 = 67.74999999999999 and 1.25 * (sum / 11) = 67.75.
TIE = [38.44, 63.73, 32.99, 6.22, 158.2, 67.75, 74.76, 47.67, 5.28, 15.92, 85.24]


def _rows(spark):
    return spark.createDataFrame(list(enumerate(TIE)), "ix long, value double").withColumn("k", F.lit(1))


def test_peak_at_the_threshold(spark):
    assert 1.25 * sum(TIE) / 11 < TIE[5] <= 1.25 * (sum(TIE) / 11)
    assert segment.peaks(_rows(spark), ["k"]).where("peak AND ix = 5").count() == 1


def test_segment_begins_at_the_threshold(spark):
    cuts = segment.segments(segment.peaks(_rows(spark), ["k"]), ["k"], 1000).orderBy("start_ps").collect()
    assert 5000 in [r.start_ps for r in cuts] and sum(r.duration_ps for r in cuts) == 11000


def test_streamed_peak_at_the_threshold(spark):
    rows = _rows(spark).withColumn("last", F.col("ix") == len(TIE) - 1)
    found = sinks.drained(stateful.peaks(_streamed(rows), ["k"])).where("peak").collect()
    assert 5 in [r.ix for r in found]
