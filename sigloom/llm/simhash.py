"""Near-duplicate groups by SimHash and multi-index hashing.

A document's fingerprint has ``BITS`` bits; each is the sign of a vote of its
distinct words, a word that occurs c times having the weight 1 + ln c.  Two
documents are near copies if their fingerprints differ in at most ``radius``
bits.  Of ``SEGMENTS`` segments, radius // SEGMENTS differences or fewer must fall in
one, so each distinct fingerprint is entered under the keys of the Hamming ball
of half that size around each of its segments, equal keys meet in one
self-join, and the complete distance is verified there.  The search is exact:
no pair within the radius is missed, and no list of candidates is cut.

Equal fingerprints are collapsed before the search, so the thousands of exact
copies of a page cost one entry.  A pair that meets under several keys is
emitted once, for its first close segment only.  Groups are the connected
components of the pairs, found by alternating large and small stars; each round
is a table in the shared folder.  The search and the groups collect and broadcast
nothing: every join there is told to merge, as Spark's own choice goes by a size
estimate that counts neither the entries of a fingerprint nor what Parquet saves.

Defined results: null and empty texts and texts without a word have no
fingerprint, are never copies and all stay; rows repeated with the same id are
copies of each other; exactly one row of a group is kept, that with the least id
(null ids last, then the least hash; of equal rows any one); empty tables give
no rows; extra columns are ignored by ``near_duplicates`` and kept, whatever
their names, by ``drop_near_duplicates``; a long text is read in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, fresh, same_columns, written
from .textkernel import Hashed, by_block, mix

BITS = 128
#: Widths of the segments, low bits first; none crosses the two 64-bit halves.
SEGMENTS = ((0, 22), (22, 21), (43, 21), (64, 22), (86, 21), (107, 21))
RADIUS = 17
_SALT = (np.uint64(0), np.uint64(0x9E3779B97F4A7C15))
#: Hashes voted on at a time.
_ROWS = 1 << 13
#: Keys of lost rows up to this number are broadcast (some 100 bytes each); more are joined by a shuffle, with the same rows.
BROADCAST_KEYS = 400_000


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints, and which texts have a word."""
    words = Hashed(texts)
    out = np.zeros((words.n, 2), np.uint64)
    if not len(words):
        return out, np.zeros(words.n, bool)
    if words.n == 1:
        h, d = np.sort(words.hash), words.doc
    else:
        order = np.lexsort((words.hash, words.doc))
        h, d = words.hash[order], words.doc[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    times = np.diff(np.append(at, len(h)))
    h, d = h[at], d[at]
    weight = np.rint(16 * (1 + np.log(times))).astype(np.int32)
    votes, total = np.zeros((words.n, BITS), np.int64), np.zeros(words.n, np.int64)
    for lo in range(0, len(h), _ROWS):
        part = slice(lo, lo + _ROWS)
        begin = np.flatnonzero(np.concatenate([[True], d[part][1:] != d[part][:-1]]))
        who, w = d[part][begin], weight[part]
        total[who] += np.add.reduceat(w, begin)
        for half in (0, 1):
            bits = np.unpackbits(mix(h[part] + _SALT[half]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[who, 64 * half : 64 * half + 64] += np.add.reduceat(bits * w[:, None], begin, axis=0)
    signs = 2 * votes > total[:, None]
    out[:] = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
    return out, words.count > 0


def _keyed(docs: DataFrame) -> DataFrame:
    """Two columns that identify a row by its id and text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def prints(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, lo, hi of every document with a word."""

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        codes, has = fingerprints(texts)
        keep = pa.array(has)
        cols = [batch.column(i) for i in range(3)] + [pa.array(codes[:, i].view(np.int64)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], names=["k1", "k2", "doc_id", "lo", "hi"])

    return _keyed(docs).mapInArrow(lambda it: by_block(it, "text", work), "k1 long, k2 int, doc_id long, lo long, hi long")


def _segment(lo: Column, hi: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(hi if at >= 64 else lo, at % 64).bitwiseAND(F.lit((1 << width) - 1))


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pairs(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of distinct fingerprints (a < b) within the radius, each once."""
    n = len(SEGMENTS)
    ball = radius // n
    if ball > 2:
        raise ValueError(f"the radius is at most {3 * n - 1}")
    masks = [(s, 0 if f < 0 else 1 << f) for s, (_, width) in enumerate(SEGMENTS) for f in range(-1, width if ball else 0)]
    entry = F.explode(F.expr("array(" + ",".join(f"struct({s} AS s, {m}L AS m)" for s, m in masks) + ")")).alias("e")
    part = F.array(*[_segment(F.col("lo"), F.col("hi"), *x) for x in SEGMENTS])
    rows = codes.select("lo", "hi", part.alias("part"), entry)
    key = F.element_at("part", F.col("e.s") + 1).bitwiseXOR(F.col("e.m")).bitwiseOR(F.shiftleft(F.col("e.s").cast("long"), 32))
    rows = rows.select(key.alias("key"), "lo", "hi", F.col("e.m").alias("m"))
    # the same columns on both sides, so that one exchange serves both; a broadcast would send all entries through the driver
    a, b = rows.alias("a"), rows.alias("b").hint("merge")
    alo, ahi, blo, bhi = map(F.col, ("a.lo", "a.hi", "b.lo", "b.hi"))
    apart = [_near(_segment(alo, ahi, *x), _segment(blo, bhi, *x)) for x in SEGMENTS]
    first = F.lit(n)
    for s in reversed(range(n)):
        first = F.when(apart[s] <= ball, s).otherwise(first)
    # of the keys that two balls share, one counts: a's own at a distance of 0 and 1, the one where a flips the lower bit at 2
    am, bm = F.col("a.m"), F.col("b.m")
    once = (am == 0) | ((bm != 0) & (am < bm))
    return (
        a.join(b, F.col("a.key") == F.col("b.key"))
        .where((ahi < bhi) | ((ahi == bhi) & (alo < blo)))
        .where(once & (_near(alo, blo) + _near(ahi, bhi) <= radius))
        .where(F.shiftright(F.col("a.key"), 32) == first)
        .select(F.struct(ahi.alias("hi"), alo.alias("lo")).alias("a"), F.struct(bhi.alias("hi"), blo.alias("lo")).alias("b"))
    )


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of edges (a, b)."""
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        after = written(small.select(F.col("b").alias("a"), F.col("a").alias("b")), "edges")
        size = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same = size(after) == size(now)
        drop(now)
        now = after
        if same:
            return now.select(F.col("b").alias("node"), F.col("a").alias("label"))


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every fingerprinted row (k1, k2, doc_id) with its group's first row (g_id) and size, and whether it is that row."""
    # the row's number tells equal rows apart; the written table holds it fast
    all_prints = written(prints(same_columns(docs, "doc_id", "text")).withColumn("row", F.monotonically_increasing_id()), "prints")
    found = components(pairs(all_prints.select("lo", "hi").distinct(), radius))
    labels = found.select(F.col("node.hi").alias("hi"), F.col("node.lo").alias("lo"), F.col("label.hi").alias("lhi"), F.col("label.lo").alias("llo"))
    rows = all_prints.join(labels.hint("merge"), ["hi", "lo"], "left").withColumns({"lhi": F.coalesce("lhi", "hi"), "llo": F.coalesce("llo", "lo")})
    rank = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "k1", "k2", "row")
    heads = rows.groupBy("lhi", "llo").agg(F.min(rank).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(heads.hint("merge"), ["lhi", "llo"]).select("k1", "k2", "doc_id", F.col("head.doc_id").alias("g_id"), "n", (F.col("row") == F.col("head.row")).alias("keep"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Documents that have copies: doc_id, group_id (the kept document), group_size, keep."""
    return groups(docs, radius).select("doc_id", F.col("g_id").alias("group_id"), F.col("n").alias("group_size"), "keep")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs, all columns, without the rows that are copies of a kept one.

    Texts stay where they are: the keys of lost rows go to them, by broadcast if
    they are few.  Only a kept row that is itself repeated is shuffled.
    """
    found = written(groups(docs, radius).select("k1", "k2", "keep"), "groups")
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    judged = found.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.max("keep").alias("kept"), F.count(F.lit(1)).alias("rows"))
    gone = written(judged.where("NOT kept OR rows > 1"), "lost")
    lost, repeated = gone.select(k1, k2), gone.where("kept").select(k1, k2)
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df.hint("merge")
    keyed = docs.withColumns({k1: F.xxhash64(docs["doc_id"].cast("long"), docs["text"]), k2: F.hash(docs["text"], docs["doc_id"].cast("long"))})
    left = keyed.join(few(lost), [k1, k2], "left_anti")
    if not repeated.isEmpty():
        left = left.unionByName(keyed.join(few(repeated), [k1, k2], "left_semi").dropDuplicates([k1, k2]))
    return left.drop(k1, k2)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
