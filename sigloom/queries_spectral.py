"""Queries of the spectral transforms, scales, synthesis and feature graphs."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from .catalogue import FRAMES, SERIES, frames, query, r6, series, table
from .functions import arrays as A
from .functions import transforms as X
from .functions.windows import hann, oggvorbis
from .operators import adaptive, framing, synth
from .plans import templates
from .scales import Band, BarkScale, ChromaScale, GeometricScale, LinearScale, MelScale, a_weighting
from .sources import wav

RATE = 11025
_BINS = X.linear_bins(RATE, 64)
_TOP = Band(0.0, RATE / 2)
_BARK, _PITCH = BarkScale(_TOP, 16), ChromaScale(Band(20.0, RATE / 2))


def _sql(m) -> str:
    a = np.asarray(m, float)
    return "(" + json.dumps(a.tolist()) + "::DOUBLE" + "[]" * a.ndim + ")"


def _product(matrix, v: str = "v") -> str:
    return f"list_transform({_sql(matrix)}, lambda row: list_inner_product(row, {v}))"


def _told_sql(a: str) -> str:
    return f"round(list_sum(list_transform({a}, lambda x, i: x * i)), 6) + 0.0 AS told"


def _told(a):
    return r6(F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), "told")


_MATRICES = {
    "dct2": X.dct2_matrix(64),
    "dct2_inverse": X.dct2_matrix(64).T,
    "dct2_unnormalised": X.dct2_matrix(64, ortho=False),
    "dct4": X.dct4_matrix(64),
    "mdct": X.mdct_matrix(32),
    "rfft_real": X.rfft_matrices(64)[0],
    "rfft_imaginary": X.rfft_matrices(64)[1],
}
for _name, _m in _MATRICES.items():
    query(f"transform_{_name}", f"WITH {FRAMES} SELECT vec_id, {_told_sql('y')} FROM (SELECT vec_id, {_product(_m)} AS y FROM frames)")(lambda spark, d, m=_m: frames(spark, d).select("vec_id", _told(X.by_matrix(F.col("v"), m))))

query("transform_imdct", f"WITH {FRAMES} SELECT vec_id, {_told_sql('y')} FROM (SELECT vec_id, {_product(X.mdct_matrix(64).T)} AS y FROM frames)")(lambda spark, d: frames(spark, d).select("vec_id", _told(X.imdct(F.col("v"), 64))))

_RE, _IM = X.rfft_matrices(64)
_Z = f"z AS (SELECT vec_id, {_product(_RE)} AS re, {_product(_IM)} AS im FROM frames)"


@query("rfft_power", f"WITH {FRAMES}, {_Z} SELECT vec_id, {_told_sql('list_transform(re, lambda x, i: x * x + im[i] * im[i])')} FROM z")
def rfft_power(spark, d):
    return frames(spark, d).select("vec_id", A.let(X.rfft(F.col("v"), 64), X.power).alias("p")).select("vec_id", _told(F.col("p")))


@query("irfft_round_trip", f"WITH {FRAMES} SELECT vec_id, {_told_sql('v')} FROM frames")
def irfft_round_trip(spark, d):
    return frames(spark, d).withColumn("z", X.rfft(F.col("v"), 64)).select("vec_id", _told(X.irfft(F.col("z"), 64)))


_TURN = 2 * np.pi * np.arange(33) * 3 / 33


@query("phase_shift", f"WITH {FRAMES}, {_Z} SELECT vec_id, {_told_sql(f'list_transform(re, lambda x, i: x * {_sql(np.cos(_TURN))}[i] + im[i] * {_sql(np.sin(_TURN))}[i])')} FROM z")
def phase_shift(spark, d):
    return frames(spark, d).withColumn("z", X.rfft(F.col("v"), 64)).withColumn("y", X.phase_shift(F.col("z"), 3, 33)).select("vec_id", _told(F.col("y.re")))


@query("phase_angles", f"WITH {FRAMES}, {_Z} SELECT vec_id, {_told_sql('list_transform(re, lambda x, i: CASE WHEN i BETWEEN 2 AND 32 THEN cos(atan2(im[i], x)) ELSE 0 END)')} FROM z")
def phase_angles(spark, d):
    """The cosines of the inner coefficients' phases; the outer ones are real."""
    z = frames(spark, d).withColumn("z", X.rfft(F.col("v"), 64)).withColumn("p", X.phase(F.col("z")))
    return z.select("vec_id", _told(F.transform("p", lambda x, i: F.when((i >= 1) & (i <= 31), F.cos(x)).otherwise(0.0))))


_MAG = "list_transform(re, lambda x, i: sqrt(x * x + im[i] * im[i]))"
_BARK_BASIS = _BARK.basis(_BINS, hann)
_CHROMA_BASIS = _PITCH.basis(_BINS) * a_weighting(LinearScale.from_sample_rate(RATE, 33))[None, :]


def _magnitudes(spark, d):
    return frames(spark, d).withColumn("z", X.rfft(F.col("v"), 64)).withColumn("m", X.magnitude(F.col("z")))


@query("bark_bands", f"WITH {FRAMES}, {_Z} SELECT vec_id, {_told_sql(_product(_BARK_BASIS, 'm'))} FROM (SELECT vec_id, {_MAG} AS m FROM z)")
def bark_bands(spark, d):
    return _magnitudes(spark, d).select("vec_id", _told(X.apply_scale(F.col("m"), _BARK, _BINS, hann)))


@query("chroma", f"WITH {FRAMES}, {_Z} SELECT vec_id, {_told_sql(_product(_CHROMA_BASIS, 'm'))} FROM (SELECT vec_id, {_MAG} AS m FROM z)")
def chroma(spark, d):
    return _magnitudes(spark, d).select("vec_id", _told(X.chroma(F.col("m"), _PITCH, _BINS)))


@query("bfcc", f"WITH {FRAMES}, {_Z}, b AS (SELECT vec_id, {_product(_BARK.basis(_BINS), 'm')} AS b FROM (SELECT vec_id, {_MAG} AS m FROM z)) SELECT vec_id, {_told_sql(_product(X.dct2_matrix(16, ortho=False)[1:14], 'list_transform(b, lambda x: ln(abs(x) + 1e-12))'))} FROM b")
def bfcc(spark, d):
    b = _magnitudes(spark, d).withColumn("b", X.apply_scale(F.col("m"), _BARK, _BINS))
    return b.select("vec_id", _told(X.bfcc(F.col("b"), 16)))


@query("a_weighted", f"WITH {FRAMES} SELECT vec_id, {_told_sql(f'list_transform(v, lambda x, i: x * {_sql(a_weighting(LinearScale.from_sample_rate(RATE, 64)))}[i])')} FROM frames")
def a_weighted(spark, d):
    return frames(spark, d).select("vec_id", _told(A.times(F.col("v"), a_weighting(LinearScale.from_sample_rate(RATE, 64)))))


@query("a_weighting_removed", f"WITH {FRAMES} SELECT vec_id, {_told_sql(f'list_transform(v, lambda x, i: x / {_sql(a_weighting(LinearScale.from_sample_rate(RATE, 64)))}[i])')} FROM frames")
def a_weighting_removed(spark, d):
    return frames(spark, d).select("vec_id", _told(A.divided(F.col("v"), a_weighting(LinearScale.from_sample_rate(RATE, 64)))))


@query("dct_resample", f"WITH {FRAMES} SELECT vec_id, {_told_sql(_product(X.dct2_matrix(48)[:48].T @ X.dct2_matrix(64)[:48] * np.sqrt(48 / 64)))} FROM frames")
def dct_resample(spark, d):
    return frames(spark, d).select("vec_id", _told(X.dct_resample(F.col("v"), 64, 48)))


@query("dct_band", f"WITH {FRAMES} SELECT vec_id, {_told_sql(_product(X.dct2_matrix(64)[8:16].T @ X.dct2_matrix(64)[8:16]))} FROM frames")
def dct_band(spark, d):
    return frames(spark, d).select("vec_id", _told(X.dct_band(F.col("v"), 64, 8, 16)))


@query("autocorrelation", f"WITH {FRAMES} SELECT vec_id, round(list_inner_product(v, v), 6) + 0.0 AS lag0, round(list_inner_product(v[1:63], v[2:64]), 6) + 0.0 AS lag1, round(list_inner_product(v[1:54], v[11:64]), 6) + 0.0 AS lag10 FROM frames")
def autocorrelation(spark, d):
    a = frames(spark, d).withColumn("a", X.autocorrelation(F.col("v")))
    return a.select("vec_id", *[r6(F.get("a", F.lit(k)), f"lag{k}") for k in (0, 1, 10)])


_SCALES = {
    "linear": (LinearScale(Band(20.0, 5020.0), 10), "(20 + 500 * i)::DOUBLE", "(520 + 500 * i)::DOUBLE"),
    "geometric": (GeometricScale(300, 3040, 0.1, 10), "c * 0.95", "c * 1.05"),
    "bark": (BarkScale(Band(300.0, 3040.0), 10), "b - (0.108 * b + 24.7) / 2", "b + (0.108 * b + 24.7) / 2"),
    "mel": (MelScale(Band(300.0, 3040.0), 10), "m - (0.108 * m + 24.7) / 2", "m + (0.108 * m + 24.7) / 2"),
}
for _name, (_scale, _lo, _hi) in _SCALES.items():
    _made = """WITH i AS (SELECT unnest(range(0, 10))::DOUBLE AS i), w AS (SELECT 6 * ln(0.5 + sqrt(1.25)) AS b0, 6 * ln(3040 / 600.0 + sqrt(1 + (3040 / 600.0) ** 2)) AS b1, 1127 * ln(1 + 3 / 7.0) AS m0, 1127 * ln(1 + 3040 / 700.0) AS m1),
    c AS (SELECT i, 300 * (3040 / 300.0) ** (i / 9) AS c, 300 * (exp((b0 + (b1 - b0) * i / 9) / 6) - exp(-(b0 + (b1 - b0) * i / 9) / 6)) AS b, 700 * (exp((m0 + (m1 - m0) * i / 9) / 1127) - 1) AS m FROM i, w)"""
    query(f"scale_{_name}", f"{_made} SELECT i::INTEGER AS band_ix, round({_lo}, 6) + 0.0 AS start_hz, round({_hi}, 6) + 0.0 AS stop_hz FROM c")(lambda spark, d, s=_scale: s.table(spark).select("band_ix", r6(F.col("start_hz"), "start_hz"), r6(F.col("stop_hz"), "stop_hz")))


@query("band_join", f"WITH {FRAMES}, bins AS (SELECT vec_id, i, v[i + 1] AS x, i * 86.1328125 AS lo, (i + 1) * 86.1328125 AS hi FROM frames, (SELECT unnest(range(0, 64)) AS i)), bands AS (SELECT unnest([0, 500, 1000, 2000]) AS lo, unnest([600, 1200, 2400, 5000]) AS hi) SELECT vec_id, bands.lo::DOUBLE AS start_hz, round(sum(abs(x)), 6) + 0.0 AS total FROM bins JOIN bands ON bins.hi >= bands.lo AND bins.lo < bands.hi GROUP BY vec_id, bands.lo")
def band_join(spark, d):
    """Sums of the bins that each of four bands covers, by the planned bin ranges."""
    bins = LinearScale(Band(0.0, 64 * 86.1328125), 64)
    bands = [Band(0.0, 600.0), Band(500.0, 1200.0), Band(1000.0, 2400.0), Band(2000.0, 5000.0)]
    sums = X.band_sums(A.each(F.abs)(F.col("v")), [bins.bins(b) for b in bands])
    made = frames(spark, d).select("vec_id", F.posexplode(sums).alias("k", "total"))
    starts = F.element_at(F.array(*[F.lit(b.start_hz) for b in bands]), F.col("k") + 1)
    return made.select("vec_id", starts.alias("start_hz"), r6(F.col("total"), "total"))


# synthesis
@query("synth_sine", "SELECT i::BIGINT AS ix, round((sin(i * 2 * pi() * 440 / 11025) + sin(i * 2 * pi() * 660 / 11025)) / 2, 6) + 0.0 AS value FROM (SELECT unnest(range(0, 1000000000000 // 90702947)) AS i)")
def synth_sine(spark, d):
    return synth.sine(spark, 10**12, RATE, [440.0, 660.0]).select("ix", r6(F.col("value"), "value"))


@query("synth_silence", "SELECT i::BIGINT AS ix, 0.0::DOUBLE AS value FROM (SELECT unnest(range(0, 1000000000000 // 90702947)) AS i)")
def synth_silence(spark, d):
    return synth.silence(spark, 10**12, RATE)


@query("synth_noise")
def synth_noise(spark, d):
    return synth.noise(spark, 10**12, RATE, 1)


@query("synth_ticks")
def synth_ticks(spark, d):
    return synth.ticks(spark, 4 * 10**12, RATE, 10**12)


@query("pad_with_silence", f"WITH {SERIES}, n AS (SELECT user_id, max(ix) AS m FROM series GROUP BY user_id) SELECT user_id, ix, round(value, 6) + 0.0 AS value FROM series UNION ALL SELECT user_id, m + unnest(range(1, 11)), 0 FROM n")
def pad_with_silence(spark, d):
    return synth.padded(series(spark, d), ["user_id"], 10).select("user_id", "ix", r6(F.col("value"), "value"))


def _lapped(spark, d):
    made = framing.sliding_window(series(spark, d), ["user_id"], 16, 8)
    return made.select("user_id", "frame", F.col("samples").alias("s"))


_W2 = oggvorbis(16) ** 2
_INSIDE = f"""WITH {SERIES}, n AS (SELECT user_id, count(*) AS n FROM series GROUP BY user_id)
SELECT user_id, ix, round(value * ({_sql(_W2)}[ix % 8 + 1] + {_sql(_W2)}[ix % 8 + 9]), 6) + 0.0 AS value FROM series JOIN n USING (user_id) WHERE ix >= 8 AND ix < n // 8 * 8"""


@query("mdct_round_trip", _INSIDE)
def mdct_round_trip(spark, d):
    """Windowed MDCT of half-lapped frames and back: the inside of every series, times what the two windows sum to."""
    coded = _lapped(spark, d).withColumn("coeffs", X.mdct(A.times(F.col("s"), oggvorbis(16)), 8))
    back = synth.from_mdct(coded, ["user_id"], 8)
    sizes = series(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return back.join(sizes, "user_id").where("ix >= 8 AND ix < floor(n / 8) * 8").select("user_id", "ix", r6(F.col("value"), "value"))


for _name, _f in {
    "dct": (lambda f: (X.dct(F.col("s"), 16), lambda c: synth.from_dct(c, ["user_id"], 16, 8))),
    "dct4": (lambda f: (X.dct4(F.col("s"), 16), lambda c: synth.from_dct4(c, ["user_id"], 16, 8))),
}.items():

    def _run(spark, d, f=_f):
        coeffs, back = f(None)
        made = back(_lapped(spark, d).withColumn("coeffs", coeffs))
        sizes = series(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        return made.join(sizes, "user_id").where("ix >= 8 AND ix < floor(n / 8) * 8").select("user_id", "ix", r6(F.col("value"), "value"))

    query(f"{_name}_round_trip", f"WITH {SERIES}, n AS (SELECT user_id, count(*) AS n FROM series GROUP BY user_id) SELECT user_id, ix, round(2 * value, 6) + 0.0 AS value FROM series JOIN n USING (user_id) WHERE ix >= 8 AND ix < n // 8 * 8")(_run)


@query("fft_synthesis", f"WITH {SERIES}, n AS (SELECT user_id, count(*) AS n FROM series GROUP BY user_id) SELECT user_id, ix, round(value * ({_sql(oggvorbis(16))}[ix % 8 + 1] + {_sql(oggvorbis(16))}[ix % 8 + 9]), 6) + 0.0 AS value FROM series JOIN n USING (user_id) WHERE ix >= 8 AND ix < n // 8 * 8")
def fft_synthesis(spark, d):
    made = synth.from_fft(_lapped(spark, d).withColumn("coeffs", X.rfft(F.col("s"), 16)), ["user_id"], 16, 8)
    sizes = series(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return made.join(sizes, "user_id").where("ix >= 8 AND ix < floor(n / 8) * 8").select("user_id", "ix", r6(F.col("value"), "value"))


@query("time_stretch")
def time_stretch(spark, d):
    return synth.time_stretch(series(spark, d), ["user_id"], 0.8, 8, 32)


@query("pitch_shift")
def pitch_shift(spark, d):
    return synth.pitch_shift(series(spark, d), ["user_id"], 2.0, 8, 32)


@query("resample", f"WITH {SERIES} SELECT user_id, round(count(*) / 2.0)::BIGINT AS n, round(avg(value) + 3.3e-8, 6) + 0.0 AS mean FROM series GROUP BY user_id HAVING count(*) % 2 = 0 UNION ALL SELECT user_id, (count(*) // 2 + CASE WHEN count(*) // 2 % 2 = 0 THEN 0 ELSE 1 END)::BIGINT, round(avg(value) + 3.3e-8, 6) + 0.0 FROM series GROUP BY user_id HAVING count(*) % 2 = 1")
def resample(spark, d):
    """Half the rate: the number of samples (ties to even) and their mean, which a band-limited conversion keeps."""
    made = synth.resampled(series(spark, d), ["user_id"], 0.5)
    return made.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value") + 3.3e-8, "mean"))  # off the ties of exact halves


@query("frequency_decomposition", f"WITH {FRAMES} SELECT vec_id, 3::INTEGER AS bands, round(list_avg(v), 6) + 0.0 AS mean FROM frames")
def frequency_decomposition(spark, d):
    """Bands of 16, 32 and 64 samples; the lowest keeps the mean and the others have none."""

    def means(x):
        return np.array([[b.mean() for b in X.frequency_decomposition(row, [16, 32, 64])] for row in x])

    made = frames(spark, d).withColumn("m", X.frames_udf(means)(F.col("v")))
    return made.select("vec_id", F.size("m").alias("bands"), r6(A.total(F.col("m")), "mean"))


_EDGES = [(0, 9), (6, 20), (17, 33)]
_DCT_EDGES = [(0, 20), (16, 44), (40, 64)]


def _fft_map(v: np.ndarray) -> list[np.ndarray]:
    """A frame's bands by numpy's own transforms."""
    z = np.fft.rfft(v, norm="ortho")
    return [np.fft.irfft(z[lo:hi] * np.hanning(hi - lo), norm="ortho") for lo, hi in _EDGES]


def _fft_back(bands: list[np.ndarray]) -> np.ndarray:
    z = np.zeros(33, complex)
    for (lo, hi), b in zip(_EDGES, bands, strict=True):
        z[lo:hi] += np.fft.rfft(b, norm="ortho")
    return np.fft.irfft(z, 64, norm="ortho")


def _dct_map(v: np.ndarray) -> list[np.ndarray]:
    c = X.dct2_matrix(64) @ v
    return [X.dct2_matrix(hi - lo).T @ (c[lo:hi] * np.hanning(hi - lo)) for lo, hi in _DCT_EDGES]


def _dct_back(bands: list[np.ndarray]) -> np.ndarray:
    c = np.zeros(64)
    for (lo, hi), b in zip(_DCT_EDGES, bands, strict=True):
        c[lo:hi] += X.dct2_matrix(hi - lo) @ b
    return X.dct2_matrix(64).T @ c


def _as_matrix(f) -> np.ndarray:
    return np.stack([f(e) for e in np.eye(64)], axis=1)


_MAPS = {"adaptive_fft_bands": lambda v: np.concatenate(_fft_map(v)), "adaptive_fft_synthesis": lambda v: _fft_back(_fft_map(v)), "adaptive_dct_bands": lambda v: np.concatenate(_dct_map(v)), "adaptive_dct_synthesis": lambda v: _dct_back(_dct_map(v))}
_MADE = {
    "adaptive_fft_bands": lambda v: adaptive.flat(adaptive.fft_bands(X.rfft(v, 64), _EDGES)),
    "adaptive_fft_synthesis": lambda v: X.irfft(adaptive.fft_spectrum(adaptive.fft_bands(X.rfft(v, 64), _EDGES), _EDGES, 33), 64),
    "adaptive_dct_bands": lambda v: adaptive.flat(adaptive.dct_bands(X.dct(v, 64), _DCT_EDGES)),
    "adaptive_dct_synthesis": lambda v: X.idct(adaptive.dct_spectrum(adaptive.dct_bands(X.dct(v, 64), _DCT_EDGES), _DCT_EDGES, 64), 64),
}
for _name, _f in _MAPS.items():
    query(_name, f"WITH {FRAMES} SELECT vec_id, {_told_sql('y')} FROM (SELECT vec_id, {_product(_as_matrix(_f))} AS y FROM frames)")(lambda spark, d, made=_MADE[_name]: frames(spark, d).select("vec_id", _told(made(F.col("v")))))


@query("decomposition_synthesis", f"WITH {FRAMES} SELECT vec_id, {_told_sql('v')} FROM frames")
def decomposition_synthesis(spark, d):
    """The bands of a frame, each brought to its length and added, are the frame."""
    sizes = [16, 32, 64]
    bands = X.frames_udf(lambda x: np.stack([np.concatenate(X.frequency_decomposition(row, sizes)) for row in x]))(F.col("v"))
    parts = F.array(*[F.slice("b", 1 + sum(sizes[:i]), n) for i, n in enumerate(sizes)])
    return frames(spark, d).withColumn("b", bands).select("vec_id", _told(adaptive.from_decomposition(parts, sizes, 64)))


@query("decomposition_lowest", f"WITH {FRAMES} SELECT vec_id, {_told_sql('y')} FROM (SELECT vec_id, {_product(X.fft_resampled(X.fft_resampled(np.eye(64), 16), 64).T)} AS y FROM frames)")
def decomposition_lowest(spark, d):
    """Only the lowest band, at the frame's length."""
    bands = X.frames_udf(lambda x: np.stack([np.concatenate(X.frequency_decomposition(row, [16, 64])) for row in x]))(F.col("v"))
    parts = F.array(F.slice("b", 1, 16), F.slice("b", 17, 64))
    return frames(spark, d).withColumn("b", bands).select("vec_id", _told(adaptive.from_decomposition(parts, [16, 64], 64, {0})))


@query("filter_bank")
def filter_bank(spark, d):
    """Rectified Morlet band levels, pooled over 16 samples."""
    bank = X.morlet_bank(RATE, 32, GeometricScale(300, 4000, 0.2, 6), 0.5)
    return frames(spark, d).select("vec_id", F.posexplode(X.filtered(F.col("v"), bank, 16)).alias("cell", "level"))


@query("stft_large")
def stft_large(spark, d):
    """Spectra of 512-sample lapped frames of daily revenue, in Arrow batches."""
    daily = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("clip"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("value"))
    rows = framing.ordinal(daily, ["clip"], ["day"]).select("clip", "ix", "value")
    made = templates.stft(["clip"], 512, 256, store=False).compute(spark, "fft", rows)
    return made.select("clip", "ix", F.posexplode(X.power(F.col("fft"))).alias("bin", "power"))


@query("audio_graph")
def audio_graph(spark, d):
    """Bark bands, cepstrum, pitch classes and centroid of every user's frames in one graph."""
    g = templates.audio(["user_id"], 32, 16, RATE, 12)
    rows, made = series(spark, d), {}
    out = g.compute(spark, "centroid", rows, _made=made)
    for name in ("bark", "bfcc", "chroma", "dct"):
        out = out.join(g.compute(spark, name, rows, _made=made), ["user_id", "ix"])
    return out


@query("onset_graph")
def onset_graph(spark, d):
    return templates.with_onsets(["user_id"], 8, 4, 10**9).compute(spark, "onsets", series(spark, d))


@query("frequency_adaptive")
def frequency_adaptive(spark, d):
    made = templates.frequency_adaptive(["user_id"], 64, 32, RATE, GeometricScale(200, 4500, 0.4, 6)).compute(spark, "freq_adaptive", series(spark, d))
    return made.select("user_id", "ix", F.explode("bands").alias("b")).select("user_id", "ix", "b.band_ix", F.size("b.coeffs").alias("n"), r6(A.total(F.col("b.coeffs")), "total"))


@query("wav_round_trip", f"WITH {SERIES}, p AS (SELECT user_id, max(value) AS p FROM series GROUP BY user_id) SELECT user_id, ix, round(round_even(value / p * 32767, 0) / 32768, 6) + 0.0 AS value FROM series JOIN p USING (user_id)")
def wav_round_trip(spark, d):
    """Every user's series, scaled to its peak, as a 16-bit WAV file and decoded again."""
    rows = series(spark, d)
    peaks = rows.groupBy("user_id").agg(F.max("value").alias("p"))
    files = wav.encoded(rows.join(peaks, "user_id").withColumn("value", F.col("value") / F.col("p")), ["user_id"], RATE)
    made = wav.long_form(wav.samples(files.select(F.col("user_id").cast("string").alias("path"), "content")))
    return made.select(F.col("clip").cast("long").alias("user_id"), "ix", r6(F.col("value"), "value"))


@query("wav_metadata", "SELECT user_id::VARCHAR AS uri, 11025::INTEGER AS samplerate, 1::INTEGER AS channels, 16::INTEGER AS bits, count(*) AS samples FROM events GROUP BY user_id")
def wav_metadata(spark, d):
    files = wav.encoded(series(spark, d).withColumn("value", F.lit(0.5)), ["user_id"], RATE)
    return wav.metadata(files.select(F.col("user_id").cast("string").alias("path"), "content"))
