import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import arrays as A
from sigloom.functions import scalars as S
from sigloom.functions import transforms as X
from sigloom.operators import framing, intervals, knn, learn, sampling, segment, synth
from sigloom.plans.graph import Graph
from sigloom.scales import Band, LinearScale
from sigloom.signal import Signal
from sigloom.storage import new_folder
from sigloom.units import S as SECOND
from sigloom.units import TimeDimension, TimeSlice


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalar_values(spark):
    f = lambda c: one(spark, c)
    assert f(S.mu_law(F.lit(0.5))) == pytest.approx(0.8757030686) and f(S.log_modulus(F.lit(-3.0))) == pytest.approx(-1.3862943611)
    assert f(S.inverse_mu_law(S.mu_law(F.lit(-0.3)))) == pytest.approx(-0.3) and f(S.decibel(F.lit(0.0))) is None
    assert [f(S.midi_to_note(F.lit(n))) for n in (0, 127, 33, 99)] == ["C0", "G10", "A2", "D#8"]
    assert [f(S.note_to_midi(F.lit(n))) for n in ("C0", "G10", "A#7", "nothing")] == [0, 127, 94, None]


def test_frame_values(spark):
    f = lambda c: one(spark, c)
    eye = np.eye(10)
    assert [f(A.inverse_one_hot(A.literal(r))) for r in eye] == pytest.approx([i / 5 - 1 for i in range(10)])
    zero, ramp = A.literal(np.zeros(4)), A.literal([0.0, 1.0, -2.0, 4.0])
    assert f(A.instance_scale(zero)) == [0] * 4 and f(A.unit_norm(zero)) == [0] * 4 and f(A.unit_scale(zero)) == [0] * 4
    assert max(map(abs, f(A.instance_scale(ramp)))) == pytest.approx(1, abs=1e-6) and f(A.flatness(zero)) == 0
    assert f(A.unband(A.band(ramp, 1, 3), 1, 4)) == [0, 1, -2, 0] and f(A.pad(ramp, 6))[-2:] == [0, 0]
    hot = f(A.categorical(ramp, 15))
    assert all(sum(r) == 1 for r in hot) and len(hot[0]) == 16
    assert len(f(A.inverse_categorical(A.categorical(ramp, 15), 15))) == 4
    bits = np.random.default_rng(0).integers(0, 2, 130)
    assert f(A.unpack_bits(A.pack_bits(A.literal(bits)), 130)) == bits.tolist()
    assert f(A.hamming(A.pack_bits(A.literal(bits)), A.pack_bits(A.literal(1 - bits)))) == 130
    assert f(A.sharpen(ramp, [1.0])) == [0, 1, 0, 4]


def test_windows_of_a_ramp(spark):
    df = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("ix"), F.col("id").cast("double").alias("value"))
    for (w, s), cut, padded in (((2, 1), 9, 10), ((2, 2), 4 + 1, 5), ((3, 2), 4, 5), ((3, 3), 3, 4)):
        got = {r.frame: r.samples for r in framing.sliding_window(df, ["k"], w, s).collect()}
        assert len(got) == padded and all(len(x) == w for x in got.values()) and got[1] == [float(s + i) for i in range(w)]
        assert framing.sliding_window(df, ["k"], w, s, pad=False).count() == cut
    assert [r.ix for r in framing.leftovers(df, ["k"], 3, 3).collect()] == [9]
    assert framing.sliding_window(df, ["k"], 1, 2).count() == 5 and framing.decimate(df, 2).count() == 5
    with pytest.raises(ValueError):
        framing.sliding_window(df, ["k"], 0, 1)


def test_signal_slices(spark):
    df = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("ix"), F.array(*[F.col("id") * 1.0 + i for i in range(5)]).alias("value"))
    s = Signal(df, ["k"], TimeDimension(SECOND, SECOND, 10), LinearScale(Band(0, 100), 5))
    assert s[slice(None, 7 * SECOND)].df.count() == 7 and s[slice(-7 * SECOND, None)].df.count() == 7 and s[TimeSlice(2 * SECOND, 2 * SECOND)].df.count() == 2
    part = s[TimeSlice(SECOND, 3 * SECOND), Band(25, 60)]
    assert part.df.first().value == [4.0, 5.0] and len(part.scale) == 2
    back = Signal.from_metadata(s.with_metadata(), ["k"])
    assert back.time == s.time and back.scale == s.scale


def test_intervals(spark):
    vrts = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 3, 1)], "k int, start_ps long, duration_ps long")
    q = lambda d: spark.createDataFrame([(1, 1, d)], "k int, start_ps long, duration_ps long")
    assert intervals.overlapping(vrts, q(2), ["k"]).count() == 1 and intervals.overlapping(vrts, q(None), ["k"]).count() == 2
    assert tuple(intervals.spans(vrts, ["k"]).first()) == (1, 0, 4, 4)
    with pytest.raises(ValueError):
        intervals.merge_streams([vrts], ["k"])
    with pytest.raises(ValueError):
        intervals.concat_slices(vrts, vrts.withColumn("duration_ps", F.lit("x")))


def test_onsets_of_ticks(spark):
    ticks = synth.ticks(spark, 4 * SECOND, 11025, SECOND, seed=3).withColumn("clip", F.lit("a"))
    frames = framing.sliding_window(ticks, ["clip"], 512, 256).select("clip", F.col("frame").alias("ix"), X.magnitude(X.rfft(F.col("samples"), 512)).alias("coeffs"))
    made = segment.transience(frames, ["clip"]).select("clip", "ix", F.least(F.col("transience"), F.lit(1e9)).alias("value"))
    energy = frames.select("clip", "ix", A.total(F.col("coeffs")).alias("value"))
    found = segment.segments(segment.peaks(energy, ["clip"], threshold=2.0), ["clip"], 256 * 90702947).orderBy("start_ps").collect()
    assert made.count() == frames.count() and {round(r.start_ps / SECOND) for r in found} == {0, 1, 2, 3} and len(found) <= 5
    for r in found:
        assert abs(r.start_ps - round(r.start_ps / SECOND) * SECOND) <= 2 * 256 * 90702947
    assert found[-1].start_ps + found[-1].duration_ps == 256 * 90702947 * frames.count()


def test_nearest_paths_agree(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8)).round(2)
    v[7] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, vector array<double>").repartition(3)
    asked = rows.where("id < 10").withColumnRenamed("id", "query_id")
    for metric in ("euclidean", "sqeuclidean", "cosine", "cityblock", "chebyshev"):
        a, b = (sorted(map(tuple, knn.nearest(rows, asked, 4, m).collect())) for m in (metric, knn.METRICS[metric]))
        assert a == b and len(a) == 40
    codes = rows.where("vector IS NOT NULL").withColumn("vector", A.pack_bits(A.binarize(F.col("vector"), 0.0)))
    assert sorted(map(tuple, knn.nearest(codes, codes.withColumnRenamed("id", "query_id"), 3, "hamming").collect())) == sorted(map(tuple, knn.nearest(codes, codes.withColumnRenamed("id", "query_id"), 3, knn.METRICS["hamming"]).collect()))
    assert knn.nearest(rows, asked.limit(0), 4).count() == 0 and knn.nearest(rows.limit(0), asked, 4).count() == 0
    assert knn.search(rows.where("vector IS NOT NULL"), A.literal(v[3]), 2, "euclidean", "vector").select("id").collect() == [(3,), (7,)]
    with pytest.raises(Exception, match="2 words"):
        knn.assert_code_size(codes, 2, "vector").collect()


def test_index_keeps_each_entry_once(spark):
    features = spark.createDataFrame([("d", 0, [1]), ("d", 1, [2])], "doc string, ix long, code array<long>")
    entries = knn.index_rows(features, "doc", "ix", "code", 10, 20, F.create_map(F.lit("k"), F.lit("v")))
    index = knn.add(knn.add(entries.limit(0), entries), entries.unionByName(entries))
    assert index.count() == 2 and {r.start_ps for r in index.collect()} == {0, 10}


def test_pipelines(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(2, 3, (50, 6)))], "id long, v array<double>")
    stages = [learn.unit_norm(), learn.log(), learn.MeanStd(), learn.mu_law(), learn.instance_scaling(2.0), learn.multiply(3.0), learn.weighted([1, 2, 3, 4, 5, 6]), learn.slicer(0, 6, 6), learn.reshape(3)]
    fitted = learn.fit(rows, "v", stages)
    back = fitted.inverse(fitted.transform(rows, "v"))
    for r in back.collect():
        assert r.restored == pytest.approx(r.v, abs=1e-9)
    assert fitted.version == learn.fit(rows, "v", stages).version and fitted[:2].version != fitted.version and len(fitted[[0, 2]]) == 2
    with pytest.raises(NotImplementedError):
        p = learn.fit(rows, "v", [learn.absolute()])
        p.inverse(p.transform(rows, "v"))
    mean, std = learn.moments(rows, "v")
    v = np.array([r.v for r in rows.collect()])
    assert mean == pytest.approx(v.mean(0)) and std == pytest.approx(v.std(0))
    planes = learn.hyperplanes(mean, std, 16, 1)
    bits = learn.Pipeline([learn.simhash(planes)]).transform(rows, "v").collect()
    assert [r.transformed for r in bits] == [list(map(int, planes @ np.array(r.v) > 0)) for r in bits]
    km = learn.fit(rows, "v", [learn.KMeans(3)])
    assert {sum(r.transformed) for r in km.transform(rows, "v").collect()} == {1.0} and km.inverse(km.transform(rows, "v")).count() == 50
    pca = learn.fit(rows, "v", [learn.Pca(6)])
    assert all(r.restored == pytest.approx(r.v, abs=1e-8) for r in pca.inverse(pca.transform(rows, "v")).collect())


def test_samples_are_reproducible(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    a = {r.id for r in sampling.reservoir(rows.repartition(7), 50, ["id"]).collect()}
    assert a == {r.id for r in sampling.reservoir(rows.coalesce(1), 50, ["id"]).collect()} and len(a) == 50 and a != {r.id for r in sampling.reservoir(rows, 50, ["id"], 1).collect()}
    assert 28 <= sampling.stratified(rows, ["g"], 30, ["id"]).count() <= 30
    assert sampling.percent_full(rows, 2000).first()[0] == 0.5 and all(r.positive != r.anchor for r in sampling.triplets(rows, "id", "g").collect())


def test_stretch_and_shift(spark):
    rows = synth.sine(spark, SECOND, 11025, [440.0]).withColumn("clip", F.lit(1))
    for factor in (0.5, 2.0):
        made = synth.time_stretch(rows, ["clip"], factor).orderBy("ix").toPandas().value.to_numpy()
        assert len(made) == int(rows.count() / factor) and abs(np.abs(np.fft.rfft(made)).argmax() * 11025 / len(made) - 440) < 10
    up = synth.pitch_shift(rows, ["clip"], 12).orderBy("ix").toPandas().value.to_numpy()
    assert len(up) == rows.count() and abs(np.abs(np.fft.rfft(up)).argmax() * 11025 / len(up) - 880) < 20
    assert synth.resampled(rows, ["clip"], 1).count() == rows.count()


def test_graph(spark):
    calls = []
    g = Graph().add("a", lambda df: calls.append("a") or df).add("b", lambda df: df.withColumn("x", F.col("id") + 1), "a", store=True).add("c", lambda a, b: a.join(b, "id"), ("a", "b"))
    path = new_folder(spark, "features")
    assert g.compute(spark, "c", spark.range(5), path).count() == 5 and g.roots() == ["a"]
    calls.clear()
    assert g.compute(spark, "b", spark.range(5), path).count() == 5 and not calls
    with pytest.raises(ValueError):
        g.add("d", lambda df: df, "missing")
