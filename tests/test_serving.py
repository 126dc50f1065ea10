import base64
import itertools
import json

from pyspark.sql import functions as F

from sigloom.operators import adaptive, sampling
from sigloom.plans import serving
from sigloom.signal import Signal
from sigloom.units import S, TimeDimension


def test_parts_of_one_document(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("doc"), F.floor(F.col("id") / 2).alias("ix"), F.col("id").cast("double").alias("value"))
    s = Signal(df, ["doc"], TimeDimension(S, S, 10))
    assert sorted(r.ix for r in serving.slice_feature(s, {"doc": 1}, 2, 5).collect()) == [2, 3, 4]
    assert serving.slice_feature(s, {"doc": 1}).count() == 10 and serving.slice_feature(s, {"doc": 1}, 8).count() == 2


def test_results_as_json(spark):
    hits = spark.createDataFrame([("b", 2), ("a", 1)], "id string, distance int")
    got = json.loads(serving.search_json(hits, F.lit(b"\x01\x02")).first().result)
    assert base64.b64decode(got["query"]) == b"\x01\x02" and [h["id"] for h in got["hits"]] == ["a", "b"]
    assert json.loads(spark.range(1).select(serving.slices_json(F.lit(3 * S), F.lit(S // 2)).alias("x")).first().x) == {"start": 3.0, "duration": 0.5}


def test_bands_on_a_grid(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, -2.0, 3.0, 0.0, 0.0, 0.0]), (1, 1, [1.0] * 6)], "k int, ix long, v array<double>").select("k", "ix", adaptive.banded(F.col("v"), [(0, 2), (2, 6)]).alias("bands"))
    assert [r.f for r in rows.select(adaptive.flat(F.col("bands")).alias("f")).collect()] == [[1.0, -2.0, 3.0, 0.0, 0.0, 0.0], [1.0] * 6]
    made = {(r.ix, r.band_ix): r.coeffs for r in adaptive.rasterized(rows, ["k"], 8).collect()}
    assert all(len(c) == 8 for c in made.values()) and abs(max(map(abs, made[0, 1])) - 3) < 1e-9 and all(abs(x - 1) < 1e-9 for x in made[1, 0])
    assert adaptive.squared(rows, ["k"], 8).count() == 2 * 16 and adaptive.squared(rows, ["k"], 8, hop=4).count() == 2 * 12


def test_epochs_differ(spark):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("g"))
    a, b = ({r.id for r in e.collect()} for e in itertools.islice(sampling.epochs(rows, ["g"], 30, ["id"]), 2))
    assert len(a) == len(b) == 30 and a != b
