"""Queries of framing, intervals, segments, sources and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import FRAMES, SERIES, VARIABLE, frames, query, r6, series, table, variable
from .functions import arrays as A
from .functions.windows import hann, windowed
from .operators import framing, intervals, segment
from .sources import catalogs
from .units import TimeDimension, TimeSlice, frame_count, leftover_start

# framing
_COUNTED = "counted AS (SELECT user_id, ix, value, count(*) OVER (PARTITION BY user_id) AS n FROM series)"


def _frames_sql(window: int, step: int, pad: bool) -> str:
    length = f"(n // {step}) * {step} + {window - step}" if window > step else f"-((-n) // {step}) * {step}" if window == step else f"CASE WHEN n % {step} = 0 THEN n ELSE (n // {step} + 1) * {step} END"
    if window == step:
        length = f"CASE WHEN n % {step} = 0 THEN n ELSE (n // {step} + 1) * {step} END"
    total = f"1 + (CASE WHEN n <= {window} THEN {window} ELSE greatest(n, {length}) END - {window}) // {step}" if pad else f"CASE WHEN n > {window} THEN 1 + (n - {window}) // {step} ELSE 0 END"
    return f"""{SERIES}, {_COUNTED}, numbered AS (SELECT *, {total} AS total FROM counted),
    framed AS (SELECT user_id, frame, ix - frame * {step} AS p, value FROM (SELECT *, unnest(range(0, total)) AS frame FROM numbered) WHERE ix >= frame * {step} AND ix < frame * {step} + {window})"""


_SCHEMES = {"lapped": (8, 4, True), "odd_lapped": (7, 3, True), "tumbling": (10, 10, True), "sparse": (3, 5, True), "unpadded": (8, 4, False), "wide": (64, 32, True)}
for _name, (_w, _s, _pad) in _SCHEMES.items():

    def _run(spark, d, w=_w, s=_s, pad=_pad):
        made = framing.sliding_window(series(spark, d), ["user_id"], w, s, pad)
        weights = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
        return made.select("user_id", "frame", r6(weights, "told"))

    query(f"sliding_window_{_name}", f"WITH {_frames_sql(_w, _s, _pad)} SELECT user_id, frame::BIGINT AS frame, round(sum(value * (p + 1)), 6) + 0.0 AS told FROM framed GROUP BY user_id, frame")(_run)


@query("window_leftovers", f"WITH {SERIES}, {_COUNTED} SELECT user_id, ix, round(value, 6) + 0.0 AS value FROM counted WHERE ix >= CASE WHEN n > 8 THEN 1 + (n - 8) // 4 ELSE 0 END * 4")
def window_leftovers(spark, d):
    return framing.leftovers(series(spark, d), ["user_id"], 8, 4).select("user_id", "ix", r6(F.col("value"), "value"))


@query("decimate", f"WITH {SERIES} SELECT user_id, ix, round(value, 6) + 0.0 AS value FROM series WHERE ix % 3 = 0")
def decimate(spark, d):
    """Every third sample: the operator itself."""
    return framing.decimate(series(spark, d), 3).select("user_id", "ix", r6(F.col("value"), "value"))


@query("tumbling_chunks", f"WITH {SERIES} SELECT user_id, ix // 16 AS chunk, count(*) AS n, round(max(value), 6) + 0.0 AS peak FROM series GROUP BY user_id, ix // 16")
def tumbling_chunks(spark, d):
    return framing.chunks(series(spark, d), ["user_id"], 16).select("user_id", "chunk", F.size("samples").cast("long").alias("n"), r6(F.array_max("samples"), "peak"))


_HANN8 = "[" + ", ".join(repr(float(x)) for x in hann(8)) + "]"


@query("windowed_energy", f"WITH {_frames_sql(8, 4, True)} SELECT user_id, frame::BIGINT AS frame, round(sum(value * {_HANN8}[p + 1] * value * {_HANN8}[p + 1]), 6) + 0.0 AS energy FROM framed GROUP BY user_id, frame")
def windowed_energy(spark, d):
    """Hann-weighted lapped frames and their energy."""
    made = framing.sliding_window(series(spark, d), ["user_id"], 8, 4).withColumn("w", windowed(F.col("samples"), 8, hann))
    return made.select("user_id", "frame", r6(A.dot(F.col("w"), F.col("w")), "energy"))


@query("overlap_add", f"WITH {_frames_sql(8, 4, True)} SELECT user_id, (frame * 4 + p)::BIGINT AS ix, round(sum(value), 6) + 0.0 AS value FROM (SELECT f.user_id, f.frame, t.p, coalesce(x.value, 0) AS value FROM (SELECT DISTINCT user_id, frame FROM framed) f CROSS JOIN (SELECT unnest(range(0, 8)) AS p) t LEFT JOIN framed x ON x.user_id = f.user_id AND x.frame = f.frame AND x.p = t.p) GROUP BY user_id, frame * 4 + p")
def overlap_add(spark, d):
    made = framing.overlap_add(framing.sliding_window(series(spark, d), ["user_id"], 8, 4), ["user_id"], 4)
    return made.select("user_id", "ix", r6(F.col("value"), "value"))


@query("time_slice", f"WITH {SERIES} SELECT user_id, ix, round(value, 6) + 0.0 AS value FROM series WHERE ix >= 1 AND ix < 7")
def time_slice(spark, d):
    """From 2.25 s for 4.1 s of an axis of 1 s steps and 2 s rows."""
    first, stop = TimeDimension(10**12, 2 * 10**12).rows(TimeSlice(4_100_000_000_000, 2_250_000_000_000))
    return framing.time_rows(series(spark, d), first, stop).select("user_id", "ix", r6(F.col("value"), "value"))


@query("row_intervals", f"WITH {SERIES} SELECT user_id, ix, (ix * 22675736)::BIGINT AS start_ps, 45351472::BIGINT AS duration_ps FROM series")
def row_intervals(spark, d):
    return framing.slices(series(spark, d).select("user_id", "ix"), 22675736, 45351472)


@query("frame_counts", "SELECT user_id, (1 + (CASE WHEN n <= 7 THEN 7 ELSE greatest(n, (n // 3) * 3 + 4) END - 7) // 3)::BIGINT AS padded, (CASE WHEN n > 7 THEN 1 + (n - 7) // 3 ELSE 0 END)::BIGINT AS whole, (CASE WHEN n > 7 THEN 1 + (n - 7) // 3 ELSE 0 END * 3)::BIGINT AS leftover FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def frame_counts(spark, d):
    n = F.col("n")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    whole = framing.frame_total(n, 7, 3, False)
    assert frame_count(103, 10, 7) == 14 and leftover_start(103, 10, 7) == 98
    return rows.select("user_id", framing.frame_total(n, 7, 3, True).alias("padded"), whole.alias("whole"), (whole * 3).cast("long").alias("leftover"))


# intervals
@query("slices_between", "SELECT user_id, ps AS start_ps, nxt - ps AS duration_ps FROM (SELECT user_id, ps, lead(ps) OVER (PARTITION BY user_id ORDER BY ps) AS nxt FROM (SELECT user_id, (epoch_us(ts) - 1704067200000000) * 1000000 AS ps FROM events)) WHERE nxt IS NOT NULL")
def slices_between(spark, d):
    return intervals.between(variable(spark, d).select("user_id", "start_ps"), ["user_id"], "start_ps")


_Q = "864000000000000000 AS qs, 432000000000000000 AS qd"


@query("vrts_overlap", f"WITH {VARIABLE} SELECT user_id, event_id, start_ps FROM variable, (SELECT {_Q}) WHERE (duration_ps IS NULL OR start_ps + duration_ps > qs) AND start_ps < qs + qd")
def vrts_overlap(spark, d):
    """Slices that overlap five days from day 10 on."""
    on = intervals.overlaps(F.col("start_ps"), F.col("duration_ps"), F.lit(864000000000000000), F.lit(432000000000000000))
    return variable(spark, d).where(on).select("user_id", "event_id", "start_ps")


@query("vrts_overlap_join", f"WITH {VARIABLE}, q AS (SELECT * FROM variable WHERE value > 100) SELECT a.user_id, a.event_id FROM variable a WHERE EXISTS (SELECT 1 FROM q WHERE q.user_id = a.user_id AND (a.duration_ps IS NULL OR a.start_ps + a.duration_ps > q.start_ps) AND (q.duration_ps IS NULL OR a.start_ps < q.start_ps + q.duration_ps))")
def vrts_overlap_join(spark, d):
    rows = variable(spark, d)
    return intervals.overlapping(rows, rows.where("value > 100"), ["user_id"]).select("user_id", "event_id")


@query("slice_contains", f"WITH {VARIABLE} SELECT event_id, (864000000000000000 > start_ps AND (duration_ps IS NULL OR 864000000000000000 < start_ps + duration_ps)) AS inside FROM variable")
def slice_contains(spark, d):
    return variable(spark, d).select("event_id", intervals.contains(F.col("start_ps"), F.col("duration_ps"), F.lit(864000000000000000)).alias("inside"))


@query("slice_intersection", f"WITH {VARIABLE} SELECT event_id, greatest(start_ps, 864000000000000000) AS start_ps, greatest(0, least(start_ps + duration_ps, 1296000000000000000) - greatest(start_ps, 864000000000000000)) AS duration_ps FROM variable WHERE duration_ps IS NOT NULL")
def slice_intersection(spark, d):
    x = intervals.intersection(F.col("start_ps"), F.col("duration_ps"), F.lit(864000000000000000), F.lit(432000000000000000))
    return variable(spark, d).where("duration_ps IS NOT NULL").select("event_id", x.alias("x")).select("event_id", "x.start_ps", "x.duration_ps")


@query("slice_order", f"WITH {VARIABLE} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ps DESC, event_id)::INTEGER AS place FROM variable")
def slice_order(spark, d):
    return variable(spark, d).select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("start_ps"), "event_id")).alias("place"))


@query("vrts_span", f"WITH {VARIABLE} SELECT user_id, min(start_ps) AS start_ps, max(start_ps + duration_ps) AS end_ps, max(start_ps + duration_ps) - min(start_ps) AS span_ps FROM variable WHERE duration_ps IS NOT NULL GROUP BY user_id")
def vrts_span(spark, d):
    return intervals.spans(variable(spark, d).where("duration_ps IS NOT NULL"), ["user_id"])


@query("vrts_concat", f"WITH {VARIABLE} SELECT user_id, start_ps, duration_ps, round(value, 6) + 0.0 AS value FROM variable WHERE duration_ps IS NOT NULL UNION ALL SELECT user_id, start_ps + 1000000, duration_ps, round(value, 6) + 0.0 FROM variable WHERE duration_ps IS NOT NULL")
def vrts_concat(spark, d):
    rows = variable(spark, d).where("duration_ps IS NOT NULL").select("user_id", "start_ps", "duration_ps", r6(F.col("value"), "value"))
    return intervals.concat_slices(rows, rows.withColumn("start_ps", F.col("start_ps") + 1000000))


_POOL_SLICES = f"{VARIABLE}, {SERIES}, slices AS (SELECT user_id, event_id, (start_ps // 86400000000000000) * 1000000000000 AS start_ps, 3500000000000 AS duration_ps FROM variable)"


def _pool(spark, d, how):
    slices = variable(spark, d).select("user_id", "event_id", (F.floor(F.col("start_ps") / 86400000000000000) * 1000000000000).cast("long").alias("start_ps"), F.lit(3500000000000).alias("duration_ps"))
    return intervals.pooled(series(spark, d), slices, ["user_id"], 10**12, 2 * 10**12, how).select("user_id", "event_id", r6(F.col("pooled"), "pooled"))


for _how, _f in {"max": F.max, "avg": F.avg, "sum": F.sum, "min": F.min}.items():
    # rows of 1 s steps and 2 s extent: from (start - 1 s) on, to the end rounded up
    query(f"pooled_{_how}", f"WITH {_POOL_SLICES} SELECT s.user_id, s.event_id, round({_how}(x.value), 6) + 0.0 AS pooled FROM slices s JOIN series x ON x.user_id = s.user_id AND x.ix >= greatest(0, s.start_ps // 1000000000000 - 1) AND x.ix < s.start_ps // 1000000000000 + 4 GROUP BY s.user_id, s.event_id")(lambda spark, d, f=_f: _pool(spark, d, f))


@query("merge_streams", f"WITH {SERIES} SELECT a.user_id, a.ix, round(a.value + 2 * b.value, 6) + 0.0 AS told FROM series a JOIN (SELECT user_id, ix - 2 AS ix, value FROM series WHERE ix >= 2) b USING (user_id, ix)")
def merge_streams(spark, d):
    a = series(spark, d).select("user_id", "ix", F.array("value").alias("coeffs"))
    b = a.where("ix >= 2").withColumn("ix", F.col("ix") - 2)
    return intervals.merge_streams([a, b], ["user_id"]).select("user_id", "ix", r6(F.get("coeffs", F.lit(0)) + 2 * F.get("coeffs", F.lit(1)), "told"))


@query("concat_rows", f"WITH {SERIES}, n AS (SELECT user_id, count(*) AS n FROM series GROUP BY user_id) SELECT user_id, ix, round(value, 6) + 0.0 AS value FROM series UNION ALL SELECT user_id, ix + n, round(value, 6) + 0.0 FROM series JOIN n USING (user_id)")
def concat_rows(spark, d):
    rows = series(spark, d)
    return intervals.concat_rows(rows, rows, ["user_id"]).select("user_id", "ix", r6(F.col("value"), "value"))


@query("as_of_join", "SELECT o.o_orderkey, round(p.total, 6) + 0.0 AS as_of_total FROM orders o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate + INTERVAL 30 DAY AS at, max(o_totalprice) AS total FROM orders GROUP BY ALL) p ON o.o_custkey = p.o_custkey AND o.o_orderdate >= p.at")
def as_of_join(spark, d):
    """Each order with the customer's last order total as it was known 30 days later."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("total"))
    late = orders.groupBy("o_custkey", (F.col("at") + F.expr("INTERVAL 30 DAYS")).alias("at")).agg(F.max("total").alias("total"))
    return intervals.as_of(orders.drop("total"), late, ["o_custkey"], "at", "total").select("o_orderkey", r6(F.col("as_of_total"), "as_of_total"))


@query("skip_if_exists", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def skip_if_exists(spark, d):
    """Orders of which no line was returned."""
    stored = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return intervals.new_only(table(spark, d, "orders").select("o_orderkey"), stored, "o_orderkey")


# segments
_VEC = f"{FRAMES}, f AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ix, v FROM frames)"


def _clips(spark, d):
    return framing.ordinal(frames(spark, d).select(F.col("label").alias("clip"), "vec_id", F.col("v").alias("coeffs")), ["clip"], ["vec_id"]).drop("vec_id")


@query("flux", f"WITH {_VEC}, g AS (SELECT clip, ix, v, coalesce(lag(v) OVER (PARTITION BY clip ORDER BY ix), v) AS b FROM f) SELECT clip, ix, round(sqrt(list_sum(list_transform(v, lambda x, i: (x - b[i]) * (x - b[i])))), 6) + 0.0 AS flux FROM g")
def flux(spark, d):
    return segment.flux(_clips(spark, d), ["clip"]).select("clip", "ix", r6(F.col("flux"), "flux"))


@query("transience", f"WITH {_VEC}, g AS (SELECT clip, ix, list_sum(list_transform(v, lambda x, i: CASE WHEN i >= 3 THEN x * x ELSE 0 END)) AS e, list_sum(list_transform(v, lambda x, i: CASE WHEN i >= 3 THEN x * x * i ELSE 0 END)) AS h FROM f) SELECT clip, ix, round(h / coalesce(lag(h) OVER (PARTITION BY clip ORDER BY ix), h) * (h / e), 6) + 0.0 AS transience FROM g")
def transience(spark, d):
    return segment.transience(_clips(spark, d), ["clip"]).select("clip", "ix", r6(F.col("transience"), "transience"))


@query(
    "complex_domain",
    f"""WITH {_VEC}, p AS (SELECT clip, ix, list_transform(v, lambda x: abs(x)) AS m, list_transform(v, lambda x: 10 * x) AS a FROM f),
    g AS (SELECT *, lag(m) OVER w AS m1, lag(a) OVER w AS a1, lag(a, 2) OVER w AS a2 FROM p WINDOW w AS (PARTITION BY clip ORDER BY ix))
    SELECT clip, ix, CASE WHEN a2 IS NULL THEN 0 ELSE round(list_sum(list_transform(m, lambda x, i: sqrt(greatest(0, x * x + m1[i] * m1[i] - 2 * x * m1[i] * cos(a[i] - 2 * a1[i] + a2[i]))))), 6) + 0.0 END AS onset FROM g""",
)
def complex_domain(spark, d):
    rows = _clips(spark, d).withColumns({"magnitude": A.each(F.abs)(F.col("coeffs")), "phase": A.each(lambda x: x * 10)(F.col("coeffs"))})
    return segment.complex_domain(rows, ["clip"]).select("clip", "ix", r6(F.col("onset"), "onset"))


def _peaks_sql(w: int, p: int, how: str) -> str:
    cells = ", ".join(f"coalesce({f'lag(value, {-o})' if o < 0 else f'lead(value, {o})'} OVER w, 0)" for o in range(-p, w - p))
    c = w // 2
    base = f"list_sum(f) / {w}" if how == "mean" else "list_median(f)"
    return f"""{SERIES}, cells AS (SELECT user_id, ix, [{cells}] AS f FROM series WINDOW w AS (PARTITION BY user_id ORDER BY ix)),
    peaks AS (SELECT user_id, ix, f[{c}] - f[{c - 1}] > 0 AND f[{c + 1}] - f[{c}] < 0 AND f[{c + 1}] > 1.25 * {base} AS peak FROM cells)"""


for _w, _p, _how in ((11, 5, "mean"), (11, 5, "median"), (12, 5, "median")):
    query(f"peak_pick_{_w}_{_how}", f"WITH {_peaks_sql(_w, _p, _how)} SELECT user_id, ix FROM peaks WHERE peak")(lambda spark, d, w=_w, p=_p, how=_how: segment.peaks(series(spark, d), ["user_id"], w, p, 1.25, how).where("peak").select("user_id", "ix"))


@query(
    "onset_segments",
    f"""WITH {_peaks_sql(11, 5, "mean")}, cuts AS (SELECT user_id, ix FROM peaks WHERE peak UNION SELECT DISTINCT user_id, 0 FROM series), n AS (SELECT user_id, count(*) AS n FROM series GROUP BY user_id)
    SELECT user_id, ix * 1000 AS start_ps, (coalesce(lead(ix) OVER (PARTITION BY user_id ORDER BY ix), n) - ix) * 1000 AS duration_ps FROM cuts JOIN n USING (user_id)""",
)
def onset_segments(spark, d):
    rows = segment.peaks(series(spark, d), ["user_id"])
    return segment.segments(rows, ["user_id"], 1000)


@query("phase_accumulate", f"WITH {SERIES} SELECT user_id, ix, round(sum(value) OVER (PARTITION BY user_id ORDER BY ix), 6) + 0.0 AS phase FROM series")
def phase_accumulate(spark, d):
    return segment.phase_accumulated(series(spark, d), ["user_id"]).select("user_id", "ix", r6(F.col("phase"), "phase"))


@query(
    "phase_unwrap",
    f"""WITH {SERIES}, p AS (SELECT user_id, ix, value % 6 - 3 AS x FROM series), k AS (SELECT *, -round((x - coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY ix), x)) / 6.283185307179586) AS k FROM p),
    u AS (SELECT user_id, ix, x + 6.283185307179586 * sum(k) OVER (PARTITION BY user_id ORDER BY ix) AS u FROM k)
    SELECT user_id, ix, round(u, 6) + 0.0 AS unwrapped, round(CASE WHEN lag(u) OVER w IS NULL THEN lead(u) OVER w - u WHEN lead(u) OVER w IS NULL THEN u - lag(u) OVER w ELSE (lead(u) OVER w - lag(u) OVER w) / 2 END, 6) + 0.0 AS gradient FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ix)""",
)
def phase_unwrap(spark, d):
    rows = series(spark, d).withColumn("phase", F.col("value") % 6 - 3)
    return segment.unwrapped(rows, ["user_id"]).select("user_id", "ix", r6(F.col("unwrapped"), "unwrapped"), r6(F.col("gradient"), "gradient"))


# sources, metadata, set operations
@query("link_extract", """SELECT page_id, (i - 1)::INTEGER AS position, l[i] AS url FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l, unnest(range(1, len(l) + 1)) AS i FROM pages)""")
def link_extract(spark, d):
    return catalogs.links(table(spark, d, "pages"))


@query("metadata_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def metadata_lookup(spark, d):
    nations = table(spark, d, "nation").withColumnRenamed("n_nationkey", "key")
    regions = table(spark, d, "region").withColumnRenamed("r_regionkey", "region")
    rows = catalogs.looked_up(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "key"), nations, "key")
    return catalogs.looked_up(rows.withColumnRenamed("n_regionkey", "region"), regions, "region").select("s_suppkey", "n_name", "r_name")


@query("metadata_json", """SELECT page_id, '{"uri":"' || url || '","samplerate":44100,"extra":{"page":"' || page_id || '"}}' AS meta FROM pages""")
def metadata_json(spark, d):
    rows = catalogs.metadata(table(spark, d, "pages"), "url", samplerate=F.lit(44100), page=F.col("page_id"))
    return rows.select("page_id", catalogs.encoded(F.col("meta")).alias("meta"))


@query("cache_keys", "SELECT page_id, md5(url) AS key FROM pages")
def cache_keys(spark, d):
    return table(spark, d, "pages").select("page_id", catalogs.cache_key(F.col("url")).alias("key"))


@query("composite_union", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::DOUBLE AS size FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT p_partkey, p_name, NULL, p_size::DOUBLE FROM part")
def composite_union(spark, d):
    t = lambda source, **c: table(spark, d, source).select(*[(F.col(v).cast("double") if k == "size" else F.col(v)).alias(k) for k, v in c.items()])
    return catalogs.composite(t("customer", id="c_custkey", name="c_name", balance="c_acctbal"), t("supplier", id="s_suppkey", name="s_name", balance="s_acctbal"), t("part", id="p_partkey", name="p_name", size="p_size"))


@query("range_requests", "SELECT doc_id, 'bytes' AS unit, n_chars // 4 * 1.0::DOUBLE AS start, CASE WHEN n_chars % 2 = 0 THEN n_chars * 1.0::DOUBLE END AS stop FROM documents")
def range_requests(spark, d):
    header = F.concat(F.lit("bytes="), F.floor(F.col("n_chars") / 4), F.lit("-"), F.when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("string")).otherwise(""))
    return table(spark, d, "documents").select("doc_id", catalogs.range_request(header).alias("r")).select("doc_id", "r.unit", "r.start", "r.stop")


@query("chunk_bytes", "SELECT p_partkey, (p_size * 1000000000000 // 22675736 * 2 * 2)::BIGINT AS bytes FROM part")
def chunk_bytes(spark, d):
    from .sources.wav import chunk_bytes as size

    return table(spark, d, "part").select("p_partkey", size(F.col("p_size") * F.lit(10**12), 22675736, 16, 2).cast("long").alias("bytes"))


@query("mix_signals", f"WITH {SERIES} SELECT ix, round(sum(value), 6) + 0.0 AS value FROM series GROUP BY ix")
def mix_signals(spark, d):
    from .operators.synth import mixed

    rows = series(spark, d).withColumn("one", F.lit(1))
    return mixed([rows], ["one"]).select("ix", r6(F.col("value"), "value"))


@query("mono_downmix", "SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) * 0.25, 6) + 0.0 AS mono FROM lineitem")
def mono_downmix(spark, d):
    from .operators.synth import mono

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(mono(F.col("l_discount"), F.col("l_tax")), "mono"))


@query("turn_lengths", "SELECT conv_id, turn, len(text)::INTEGER AS n, (len(text) - coalesce(lag(len(text)) OVER (PARTITION BY conv_id ORDER BY turn), len(text)))::INTEGER AS change FROM conversations")
def turn_lengths(spark, d):
    """Ordered series of conversations: what each turn adds to the one before."""
    n = F.length("text")
    return table(spark, d, "conversations").select("conv_id", "turn", n.alias("n"), (n - F.coalesce(F.lag(n).over(Window.partitionBy("conv_id").orderBy("turn")), n)).alias("change"))


@query("daily_revenue_frames", """WITH daily AS (SELECT l_returnflag AS channel, l_shipdate::DATE AS day, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY day) - 1 AS ix FROM daily)
SELECT channel, (ix // 7)::BIGINT AS frame, round(sum(value), 4) + 0.0 AS total FROM n GROUP BY channel, ix // 7""")
def daily_revenue_frames(spark, d):
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value")
    daily = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("channel"), F.to_date("l_shipdate").alias("day")).agg(revenue)
    made = framing.sliding_window(framing.ordinal(daily, ["channel"], ["day"]), ["channel"], 7, 7)
    return made.select("channel", "frame", (F.round(A.total(F.col("samples")), 4) + 0.0).alias("total"))


@query("streaming_event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total, round(max(value), 6) + 0.0 AS peak FROM events GROUP BY ALL")
def streaming_event_windows(spark, d):
    """Daily event-time windows of the events read as a stream, drained."""
    from .streaming import sinks, stateful

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    made = sinks.drained(stateful.event_windows(stream, "ts", "value", "40 days", "1 day", by=["event_type"]), "complete")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", r6(F.col("total"), "total"), r6(F.col("peak"), "peak"))


@query("streaming_frames", f"WITH {_frames_sql(8, 4, True)} SELECT user_id, frame::BIGINT AS frame, round(sum(value * (p + 1)), 6) + 0.0 AS told FROM framed GROUP BY user_id, frame")
def streaming_frames(spark, d):
    """Lapped frames by keyed state over a stream of samples."""
    from .storage import new_folder
    from .streaming import sinks, stateful

    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    rows = series(spark, d).withColumn("last", F.col("ix") == n - 1)
    path = new_folder(spark, "samples")
    rows.write.parquet(path)
    made = sinks.drained(stateful.framed(spark.readStream.schema(rows.schema).parquet(path), ["user_id"], 8, 4))
    return made.select("user_id", "frame", r6(F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), "told"))


# serving and bands of different widths
@query("slice_feature", f"WITH {SERIES} SELECT user_id, ix, round(value, 6) + 0.0 AS value FROM series WHERE ix >= 2 AND ix < 9")
def slice_feature(spark, d):
    """Seconds 2.5 to 8.2 of every document's feature: what range requests ask for."""
    from .plans import serving
    from .signal import Signal

    s = Signal(series(spark, d), ["user_id"], TimeDimension(10**12))
    return serving.slice_feature(s, {}, 2.5, 8.2).select("user_id", "ix", r6(F.col("value"), "value"))


@query("segments_json", f"""WITH {VARIABLE} SELECT event_id, '{{"start":' || (start_ps // 1000000000000)::DOUBLE || ',"duration":' || 2.0::DOUBLE || '}}' AS segment FROM variable""")
def segments_json(spark, d):
    """Starts in whole seconds as JSON."""
    from .plans.serving import slices_json

    whole = F.floor(F.col("start_ps") / 10**12) * F.lit(10**12)
    return variable(spark, d).select("event_id", slices_json(whole, F.lit(2 * 10**12)).alias("segment"))


@query("adaptive_bands", f"WITH {FRAMES} SELECT vec_id, b::INTEGER AS band_ix, round(list_sum(v[lo:hi]), 6) + 0.0 AS total FROM frames, (SELECT unnest([0, 1, 2]) AS b, unnest([1, 5, 17]) AS lo, unnest([4, 16, 64]) AS hi)")
def adaptive_bands(spark, d):
    """Frames cut into bands of 4, 12 and 48 coefficients."""
    from .operators import adaptive

    rows = frames(spark, d).select("vec_id", F.lit(0).alias("ix"), adaptive.banded(F.col("v"), [(0, 4), (4, 16), (16, 64)]).alias("bands"))
    return adaptive.bands(rows, ["vec_id"]).select("vec_id", "band_ix", r6(A.total(F.col("coeffs")), "total"))


@query("adaptive_rasterized", f"WITH {FRAMES} SELECT vec_id, b::INTEGER AS band_ix, 24::INTEGER AS n, round(list_max(list_transform(v[lo:hi], lambda x: abs(x))), 6) + 0.0 AS peak FROM frames, (SELECT unnest([0, 1, 2]) AS b, unnest([1, 5, 17]) AS lo, unnest([4, 16, 64]) AS hi)")
def adaptive_rasterized(spark, d):
    """The bands on a grid of 24: each keeps its greatest magnitude."""
    from .operators import adaptive

    rows = frames(spark, d).select("vec_id", F.lit(0).alias("ix"), adaptive.banded(F.col("v"), [(0, 4), (4, 16), (16, 64)]).alias("bands"))
    return adaptive.rasterized(rows, ["vec_id"], 24).select("vec_id", "band_ix", F.size("coeffs").alias("n"), r6(A.peak(F.col("coeffs")), "peak"))
