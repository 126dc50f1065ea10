"""Queries of the scalar, frame, learning and search operators."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from .catalogue import FRAMES, frames, query, r6, table
from .functions import arrays as A
from .functions import scalars as S
from .operators import knn, learn, sampling

# scalars
_VALUES = "SELECT event_id, value AS x FROM events"
_SCALARS = {
    "log_modulus": (S.log_modulus, "sign(x) * ln(abs(x) + 1)"),
    "inverse_log_modulus": (lambda x: S.inverse_log_modulus(x / 100), "sign(x / 100) * (exp(abs(x / 100)) - 1)"),
    "decibel": (S.decibel, "CASE WHEN x > 0 THEN 20 * log10(x) END"),
    "mu_law": (lambda x: S.mu_law(x / 400), "sign(x / 400) * ln(1 + 255 * abs(x / 400)) / ln(256.0::DOUBLE)"),
    "inverse_mu_law": (lambda x: S.inverse_mu_law(x / 400), "sign(x / 400) * (exp(abs(x / 400) * ln(256.0::DOUBLE)) - 1) / 255"),
    "safe_log": (S.safe_log, "ln(x + 1e-12)"),
    "hz_to_bark": (S.hz_to_bark, "6 * ln(x / 600 + sqrt((x / 600) * (x / 600) + 1))"),
    "bark_to_hz": (lambda x: S.bark_to_hz(x / 20), "300 * (exp(x / 120) - exp(-x / 120))"),
    "hz_to_mel": (S.hz_to_mel, "1127 * ln(1 + x / 700)"),
    "mel_to_hz": (S.mel_to_hz, "700 * (exp(x / 1127) - 1)"),
    "erb": (S.erb, "0.108::DOUBLE * x + 24.7::DOUBLE"),
    "semitones": (lambda x: S.semitones(x + 1), "12 * log2((x + 1) / 440)"),
}
for _name, (_f, _sql) in _SCALARS.items():
    query(f"scalar_{_name}", f"SELECT event_id, round({_sql}, 6) + 0.0 AS y FROM ({_VALUES})")(lambda spark, d, f=_f: table(spark, d, "events").select("event_id", r6(f(F.col("value")), "y")))


@query("midi_notes", "SELECT n, string_split('C C# D D# E F F# G G# A A# B', ' ')[n % 12 + 1] || (n // 12)::VARCHAR AS note, n AS back FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part)")
def midi_notes(spark, d):
    made = table(spark, d, "part").select(F.col("p_size").cast("long").alias("n")).distinct().withColumn("note", S.midi_to_note(F.col("n")))
    return made.withColumn("back", S.note_to_midi(F.col("note")))


@query("feature_map_size", "SELECT p_partkey, ((p_size + 64 - 7 + 2 * 3) // 2 + 1)::BIGINT AS size FROM part")
def feature_map_size(spark, d):
    return table(spark, d, "part").select("p_partkey", S.feature_map_size(F.col("p_size") + 64, 7, 2, 3).cast("long").alias("size"))


@query("content_ranges", "SELECT doc_id, printf('bytes %d-%d/%d', 0, n_chars // 2, n_chars) AS header FROM documents")
def content_ranges(spark, d):
    return table(spark, d, "documents").select("doc_id", S.content_range("bytes", F.lit(0), F.floor(F.col("n_chars") / 2), F.col("n_chars")).alias("header"))


# frames to frames: the result's weighted sum tells every position
def _told(a):
    return r6(F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), "told")


def _sql_told(a: str) -> str:
    return f"round(list_sum(list_transform({a}, lambda x, i: x::DOUBLE * i)), 6) + 0.0 AS told"


_N = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"
_PEAK = "list_max(list_transform(v, lambda x: abs(x)))"
_ARRAYS = {
    "unit_norm": (A.unit_norm, f"list_transform(v, lambda x: CASE WHEN {_N} > 0 THEN x / {_N} ELSE 0 END)"),
    "batchwise_unit_norm": (A.batchwise_unit_norm, f"list_transform(v, lambda x: x / ({_N} + 1e-8))"),
    "sample_norm": (A.sample_norm, "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)) / len(v) + 1e-7))"),
    "instance_scale": (A.instance_scale, f"list_transform(v, lambda x: x / ({_PEAK} + 1e-8))"),
    "unit_scale": (A.unit_scale, "list_transform(v, lambda x: CASE WHEN list_max(v) > list_min(v) THEN (x - list_min(v)) / (list_max(v) - list_min(v)) ELSE 0 END)"),
    "z_score": (A.z_score, "list_transform(v, lambda x: (x - list_avg(v)) / list_stddev_samp(v))"),
    "absolute": (A.each(F.abs), "list_transform(v, lambda x: abs(x))"),
    "multiply": (A.each(lambda x: x * 3.5), "list_transform(v, lambda x: x * 3.5)"),
    "binarize": (lambda a: A.binarize(a, 0.05), "list_transform(v, lambda x: CASE WHEN x > 0.05 THEN 1 ELSE 0 END)"),
    "log_modulus": (A.each(S.log_modulus), "list_transform(v, lambda x: sign(x) * ln(abs(x) + 1))"),
    "mu_law": (A.each(S.mu_law), "list_transform(v, lambda x: sign(x) * ln(1 + 255 * abs(x)) / ln(256.0::DOUBLE))"),
    "category": (A.category, f"list_transform(v, lambda x: floor((sign(x / {_PEAK}) * ln(1 + 255 * abs(x / {_PEAK})) / ln(256.0::DOUBLE) + 1) * 0.5 * 255))"),
    "slice_band": (lambda a: A.band(a, 8, 24), "v[9:24]"),
    "unslice_band": (lambda a: A.unband(A.band(a, 8, 24), 8, 64), "list_transform(v, lambda x, i: CASE WHEN i > 8 AND i <= 24 THEN x ELSE 0 END)"),
    "assign_band": (lambda a: A.assign_band(a, 8, 24, F.lit(1.0)), "list_transform(v, lambda x, i: CASE WHEN i > 8 AND i <= 24 THEN 1 ELSE x END)"),
    "pad": (lambda a: A.pad(a, 80), "list_concat(v, list_transform(range(16), lambda i: 0.0::DOUBLE))"),
    "sharpen": (lambda a: A.sharpen(a, [-1.0, 3.0, -1.0]), "list_transform(v, lambda x, i: greatest(0, 3 * x - coalesce(v[i + 1], 0) - CASE WHEN i > 1 THEN v[i - 1] ELSE 0 END))"),
    "reshape": (lambda a: F.flatten(A.reshape(a, 8)), "v"),
    "weighted": (lambda a: A.times(a, np.arange(64) / 8), "list_transform(v, lambda x, i: x * (i - 1) / 8)"),
}
for _name, (_f, _sql) in _ARRAYS.items():
    query(f"array_{_name}", f"WITH {FRAMES} SELECT vec_id, {_sql_told('y')} FROM (SELECT vec_id, {_sql} AS y FROM frames)")(lambda spark, d, f=_f: frames(spark, d).select("vec_id", _told(f(F.col("v")))))

_REDUCED = {
    "sum": (A.total, "list_sum(v)"),
    "max": (F.array_max, "list_max(v)"),
    "centroid": (A.centroid, "list_sum(list_transform(v, lambda x, i: abs(x) * i)) / (len(v) * (len(v) + 1) / 2)"),
    "flatness": (A.flatness, "CASE WHEN list_min(list_transform(v, lambda x: abs(x))) > 0 THEN exp(list_avg(list_transform(v, lambda x: ln(greatest(abs(x), 1e-300))))) / list_avg(list_transform(v, lambda x: abs(x))) ELSE 0 END"),
    "energy": (A.energy, "list_sum(list_transform(v, lambda x, i: CASE WHEN i >= 3 THEN x * x ELSE 0 END))"),
    "high_frequency_content": (A.high_frequency_content, "list_sum(list_transform(v, lambda x, i: CASE WHEN i >= 3 THEN x * x * i ELSE 0 END))"),
    "inverse_one_hot": (A.inverse_one_hot, "((list_position(v, list_max(v)) - 1) / len(v) - 0.5) * 2"),
    "dot": (lambda a: A.dot(a, F.reverse(a)), "list_sum(list_transform(v, lambda x, i: x * v[len(v) + 1 - i]))"),
}
for _name, (_f, _sql) in _REDUCED.items():
    query(f"frame_{_name}", f"WITH {FRAMES} SELECT vec_id, round({_sql}, 6) + 0.0 AS y FROM frames")(lambda spark, d, f=_f: frames(spark, d).select("vec_id", r6(f(F.col("v")), "y")))


@query("array_transpose", f"WITH {FRAMES} SELECT (i - 1)::INTEGER AS position, round(sum(v[i]), 6) + 0.0 AS total, count(*) AS n FROM frames, (SELECT unnest(range(1, 65)) AS i) GROUP BY i")
def array_transpose(spark, d):
    return frames(spark, d).select(F.posexplode("v").alias("position", "x")).groupBy("position").agg(r6(F.sum("x"), "total"), F.count(F.lit(1)).alias("n"))


# bits and codes
@query("pack_bits", f"WITH {FRAMES} SELECT vec_id, (SELECT sum(CASE WHEN v[i] > 0 THEN (1::HUGEINT << (64 - i)) ELSE 0 END) FROM (SELECT unnest(range(1, 65)) AS i))::HUGEINT::VARCHAR AS code FROM frames")
def pack_bits(spark, d):
    word = F.element_at(A.pack_bits(A.binarize(F.col("v"), 0.0)), 1)
    return frames(spark, d).select("vec_id", F.when(word < 0, word.cast("decimal(38,0)") + F.lit(str(2**64)).cast("decimal(38,0)")).otherwise(word.cast("decimal(38,0)")).cast("string").alias("code"))


@query("unpack_bits", f"WITH {FRAMES} SELECT vec_id, list_sum(list_transform(v, lambda x, i: CASE WHEN x > 0 THEN i ELSE 0 END))::BIGINT AS told FROM frames")
def unpack_bits(spark, d):
    bits = A.unpack_bits(A.pack_bits(A.binarize(F.col("v"), 0.0)), 64)
    return frames(spark, d).select("vec_id", F.aggregate(F.transform(bits, lambda b, i: b.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("told"))


_PLANES = np.random.default_rng(5).integers(-9, 10, (64, 64)).astype(float)
_SQL_PLANES = json.dumps(_PLANES.tolist()) + "::DOUBLE[][]"


@query("simhash_bits", f"WITH {FRAMES} SELECT vec_id, list_sum(list_transform({_SQL_PLANES}, lambda p, i: CASE WHEN list_inner_product(p, v) > 0 THEN i ELSE 0 END))::BIGINT AS told FROM frames")
def simhash_bits(spark, d):
    bits = A.simhash(F.col("v"), _PLANES)
    return frames(spark, d).select("vec_id", F.aggregate(F.transform(bits, lambda b, i: b.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("told"))


def _codes(spark, d):
    return frames(spark, d).select(F.col("vec_id").alias("id"), A.pack_bits(A.simhash(F.col("v"), _PLANES)).alias("vector"))


_SQL_BITS = f"bits AS (SELECT vec_id AS id, list_transform({_SQL_PLANES}, lambda p: CASE WHEN list_inner_product(p, v) > 0 THEN 1 ELSE 0 END) AS b FROM frames)"
_HAMMING = "list_sum(list_transform(a.b, lambda x, i: abs(x - q.b[i])))::INTEGER"


@query(
    "hamming_knn",
    f"""WITH {FRAMES}, {_SQL_BITS}, scored AS (SELECT q.id AS query_id, a.id, {_HAMMING} AS distance FROM bits a, bits q)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM scored) WHERE rank <= 5""",
)
def hamming_knn(spark, d):
    """Every code is a query."""
    codes = _codes(spark, d)
    return knn.nearest(codes, codes.withColumnRenamed("id", "query_id"), 5, "hamming")


_KNN = """WITH {frames}, scored AS (SELECT q.vec_id AS query_id, a.vec_id AS id, {distance} AS distance FROM frames a, frames q)
SELECT query_id, id, round(distance, 6) + 0.0 AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM scored) WHERE rank <= 5"""
for _metric, _sql in {
    "euclidean": "round(sqrt(list_sum(list_transform(a.v, lambda x, i: (x - q.v[i]) * (x - q.v[i])))), 9)",
    "cosine": f"round(1 - list_inner_product(a.v, q.v) / ({_N.replace('(v', '(a.v')} * {_N.replace('(v', '(q.v')}), 9)",
    "cityblock": "round(list_sum(list_transform(a.v, lambda x, i: abs(x - q.v[i]))), 9)",
}.items():

    def _run(spark, d, metric=_metric):
        rows = frames(spark, d)
        got = knn.nearest(rows, rows.select(F.col("vec_id").alias("query_id"), "v"), 5, metric, "vec_id", "v")
        return got.select("query_id", "id", r6(F.col("distance"), "distance"), "rank")

    query(f"{_metric}_knn", _KNN.format(frames=FRAMES, distance=_sql))(_run)


_TARGET = [float(x) for x in np.random.default_rng(2).integers(-9, 10, 64)]


@query("hamming_search", f"WITH {FRAMES}, {_SQL_BITS}, target AS (SELECT list_transform({_SQL_PLANES}, lambda p: CASE WHEN list_inner_product(p, {json.dumps(_TARGET)}::DOUBLE[]) > 0 THEN 1 ELSE 0 END) AS b) SELECT a.id, {_HAMMING} AS distance FROM bits a, target q ORDER BY distance, a.id LIMIT 10")
def hamming_search(spark, d):
    """The ten codes nearest to a given frame's: a top-k."""
    return knn.search(_codes(spark, d), A.pack_bits(A.simhash(A.literal(_TARGET), _PLANES)), 10, vector="vector").select("id", "distance")


@query("index_entries", "SELECT count(*) AS n, count(DISTINCT md5(vec_id::VARCHAR || '|0')) AS keys, min(md5(vec_id::VARCHAR || '|0')) AS first FROM embeddings")
def index_entries(spark, d):
    entries = knn.index_rows(_codes(spark, d).withColumn("ix", F.lit(0)), "id", "ix", "vector", 10**12, 10**12)
    twice = knn.add(knn.add(entries.limit(0), entries), entries)
    return twice.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("index_id").alias("keys"), F.min("index_id").alias("first"))


@query(
    "trigram_codes",
    r"""WITH g AS (SELECT DISTINCT item_id, md5(substr(t, i, 3)) AS h FROM (SELECT item_id, lower(text) AS t, unnest(range(1, len(text) - 1)) AS i FROM benchmark)),
    b AS (SELECT item_id, ('0x' || substr(h, 1, 2))::INTEGER % 64 AS bit FROM g)
    SELECT item_id, count(DISTINCT bit)::BIGINT AS bits, sum(DISTINCT bit)::BIGINT AS told FROM b GROUP BY item_id""",
)
def trigram_codes(spark, d):
    """A 64-bit code of each text: one bit for each of its trigrams."""
    rows = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("t"))
    grams = rows.select("item_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substr("t", i, F.lit(3))))).alias("g"))
    bits = grams.select("item_id", (F.conv(F.substr(F.md5("g"), F.lit(1), F.lit(2)), 16, 10).cast("long") % 64).alias("bit")).distinct()
    return bits.groupBy("item_id").agg(F.count(F.lit(1)).alias("bits"), F.sum("bit").alias("told"))


# learning
_POS = f"WITH {FRAMES}, pos AS (SELECT vec_id, (unnest(range(1, 65)) - 1)::INTEGER AS i, unnest(v) AS x FROM frames)"


@query("mean_std_fit", f"{_POS} SELECT i AS position, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std FROM pos GROUP BY i")
def mean_std_fit(spark, d):
    return frames(spark, d).select(F.posexplode("v").alias("position", "x")).groupBy("position").agg(r6(F.avg("x"), "mean"), r6(F.stddev_pop("x"), "std"))


@query("mean_std_apply", f"{_POS}, m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM pos GROUP BY i) SELECT vec_id, round(sum((x - m) / s * (i + 1)), 6) + 0.0 AS told FROM pos JOIN m USING (i) GROUP BY vec_id")
def mean_std_apply(spark, d):
    rows = frames(spark, d)
    fitted = learn.MeanStd().fit(rows, "v")
    return rows.select("vec_id", _told(fitted.forward(F.col("v"))))


@query("pipeline_round_trip", f"WITH {FRAMES} SELECT vec_id, {_sql_told('v')} FROM frames")
def pipeline_round_trip(spark, d):
    """Unit norm, log modulus, mean and deviation, scaling: forward and back again."""
    rows = frames(spark, d)
    fitted = learn.fit(rows, "v", [learn.unit_norm(), learn.log(), learn.MeanStd(), learn.instance_scaling(), learn.multiply(7.0)])
    return fitted.inverse(fitted.transform(rows, "v")).select("vec_id", _told(F.col("restored")))


_CENTROIDS = np.random.default_rng(9).normal(0, 0.2, (12, 64)).round(3)
_SQL_CENTROIDS = json.dumps(_CENTROIDS.tolist()) + "::DOUBLE[][]"


@query("kmeans_assign", f"""WITH {FRAMES}, d AS (SELECT vec_id, list_transform({_SQL_CENTROIDS}, lambda c: list_sum(list_transform(c, lambda x, i: (x - v[i]) * (x - v[i])))) AS s FROM frames)
SELECT vec_id, list_position(s, list_min(s))::BIGINT - 1 AS centroid FROM d""")
def kmeans_assign(spark, d):
    return frames(spark, d).select("vec_id", learn.nearest_centroid(F.col("v"), _CENTROIDS).cast("long").alias("centroid"))


@query("kmeans_fit")
def kmeans_fit(spark, d):
    """Sizes of the clusters of a seeded fit."""
    rows = frames(spark, d)
    fitted = learn.KMeans(8, seed=3).fit(rows, "v")
    return rows.select(A.argmax(fitted.forward(F.col("v"))).alias("centroid")).groupBy("centroid").count()


@query("pca_fit")
def pca_fit(spark, d):
    rows = frames(spark, d)
    fitted = learn.Pca(4).fit(rows, "v")
    return rows.select("vec_id", F.posexplode(fitted.forward(F.col("v"))).alias("component", "x"))


# sampling
@query("sample_reservoir", "SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || '|0'), doc_id LIMIT 50")
def sample_reservoir(spark, d):
    """A sampling operator: 50 rows."""
    return sampling.reservoir(table(spark, d, "documents").select("doc_id", "source"), 50, ["doc_id"])


@query(
    "sample_stratified",
    """WITH n AS (SELECT source, greatest(1, floor(100 * count(*) / (SELECT count(*) FROM documents)))::BIGINT AS quota FROM documents GROUP BY source),
    r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '|0'), doc_id) AS k FROM documents)
    SELECT source, doc_id FROM r JOIN n USING (source) WHERE k <= quota""",
)
def sample_stratified(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("source", "doc_id"), ["source"], 100, ["doc_id"])


@query("sample_shuffled", "SELECT item_id, row_number() OVER (ORDER BY md5(item_id::VARCHAR || '|7'), item_id) AS place FROM benchmark")
def sample_shuffled(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "benchmark").select("item_id", F.row_number().over(Window.orderBy(sampling.order(["item_id"], 7), "item_id")).cast("long").alias("place"))


@query("sample_percent_full", "SELECT least(1.0::DOUBLE, count(*) / 1000000.0::DOUBLE) AS percent_full FROM events")
def sample_percent_full(spark, d):
    return sampling.percent_full(table(spark, d, "events"), 1_000_000)


@query("random_search")
def random_search(spark, d):
    return knn.random_search(_codes(spark, d), 10, seed=1, vector="vector")
