"""Benchmark decontamination by winnowing.

Both sides are cut into hashed runs of ``k`` words; of every ``window``
consecutive runs the one with the least hash is kept as a fingerprint (the
rightmost of equals).  Two texts that share ``k + window - 1`` words in a row
share a whole window and so the same fingerprint, which makes the search exact:
every shared span of at least that many words is found.  Each hit is then
extended along its diagonal to the maximal spans.

Work per document is one pass of the vectorised kernel where the text already
is, in parts if the text is long.  The benchmark's index is broadcast while its
texts have at most ``broadcast_bytes`` bytes (they are measured first); a larger
benchmark takes the shuffled path, which joins the two fingerprint tables and
sends only the texts of candidate pairs on.  Both give the same rows.

Defined results: a null or empty text on either side has no spans; texts shorter
than ``k + window - 1`` words never match; a null id is carried; equal rows of
the same id give one row of ``find_spans``, while ``drop_contaminated`` judges
each row by its own text and keeps all clean ones, repeated or not; empty tables
give no rows; other columns are ignored by ``find_spans`` and kept, whatever
their names, by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import fresh, same_columns
from .textkernel import Hashed, by_block, grams

SPANS = StructType([StructField(n, LongType()) for n in ("doc_id", "item_id", "doc_word", "item_word", "n_words")])
KEYED_SPANS = StructType([*SPANS, StructField("doc_key", LongType())])
_SPANS, _KEYED_SPANS = (pa.schema([(f.name, pa.int64()) for f in x]) for x in (SPANS, KEYED_SPANS))
_BITS = 22
#: Words that are winnowed at a time.
_SLICE = 1 << 18


@dataclass(frozen=True)
class Winnowing:
    """k words a run, window runs a window: spans of k + window - 1 words are certain to be found, shorter ones not reported."""

    k: int = 8
    window: int = 6
    broadcast_bytes: int = 32 << 20

    @property
    def span(self) -> int:
        return self.k + self.window - 1


def _winnow(hashes: np.ndarray, doc: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    h, at = grams(hashes, doc, k)
    size = len(h) - window + 1
    if size <= 0:
        return h[:0], at[:0]
    least, where = h[:size].copy(), np.zeros(size, np.int64)
    for j in range(1, window):
        other = h[j : j + size]
        lower = other <= least
        np.copyto(least, other, where=lower)
        where[lower] = j
    whole = doc[at[:size]] == doc[at[window - 1 :]]
    chosen = np.unique((where + np.arange(size))[whole])
    return h[chosen], at[chosen]


def winnow(words: Hashed, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a block: hash and first word, each position once."""
    found, reach = [], k + window - 2
    for lo in range(0, max(1, len(words) - reach), _SLICE):
        part = slice(lo, lo + _SLICE + reach)  # all windows that begin in the slice
        h, at = _winnow(words.hash[part], words.doc[part], k, window)
        found.append((h, at + lo))
    if len(found) == 1:
        return found[0]
    h, at = (np.concatenate(x) for x in zip(*found, strict=True))
    at, once = np.unique(at, return_index=True)
    return h[once], at


def _runs(a: np.ndarray, b: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Start and length of the maximal runs of equal elements."""
    same = np.concatenate([[False], a == b, [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    for lo, hi in zip(edge[0::2], edge[1::2], strict=True):
        if hi - lo >= least:
            yield int(lo), int(hi - lo)


def extend(doc: np.ndarray, item: np.ndarray, shift: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Maximal shared spans with doc position - item position = shift."""
    lo = max(0, shift)
    hi = min(len(doc), len(item) + shift)
    for at, n in _runs(doc[lo:hi], item[lo - shift : hi - shift], least):
        yield lo + at, lo + at - shift, n


class Index:
    """The benchmark's fingerprints in hash order, with its words for extension."""

    def __init__(self, items: list[tuple[int | None, str | None]], how: Winnowing):
        self.ids = [i for i, _ in items]
        words = Hashed([t or "" for _, t in items])
        h, at = winnow(words, how.k, how.window)
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], at[order]
        self.item = words.doc[self.at]
        self.first, self.words = words.first, words.hash
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position in h, position in the index) with equal hashes."""
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        lo = np.searchsorted(self.hash, h[maybe], "left")
        n = np.searchsorted(self.hash, h[maybe], "right") - lo
        total = int(n.sum())
        return np.repeat(maybe, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(total)

    def spans(self, texts: list[str], how: Winnowing) -> list[tuple[int, int, int, int, int]]:
        """(document, item, document word, item word, words) of a block, once each."""
        words = Hashed(texts)
        h, at = winnow(words, how.k, how.window)
        here, there = self.hits(h)
        d, i = words.doc[at[here]], self.item[there]
        shift = (at[here] - words.first[d]) - (self.at[there] - self.first[i])
        out = []
        for doc, item, by in np.unique(np.stack([d, i, shift], 1), axis=0) if len(d) else ():
            a = words.hash[words.first[doc] : words.first[doc + 1]]
            b = self.words[self.first[item] : self.first[item + 1]]
            out += [(int(doc), int(item), *x) for x in extend(a, b, int(by), how.span)]
        return out


def small_index(tests: DataFrame, how: Winnowing) -> Index | None:
    """The index if the benchmark is small enough to broadcast, else None."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    if (tests.agg(F.sum(size)).first()[0] or 0) > how.broadcast_bytes:
        return None
    return Index([(r[0], r[1]) for r in tests.select("item_id", "text").collect()], how)


def find_spans(docs: DataFrame, tests: DataFrame, how: Winnowing = Winnowing()) -> DataFrame:
    """Maximal shared spans of ``docs(doc_id, text)`` and ``tests(item_id, text)``: doc_id, item_id, first word in each, words."""
    docs, tests = same_columns(docs, "doc_id", "text"), same_columns(tests, "item_id", "text")
    index = small_index(tests, how)
    if index is None:
        return _shuffled(docs, tests, how).select(SPANS.names).distinct()
    held = docs.sparkSession.sparkContext.broadcast(index)

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch | None:
        index = held.value
        rows = index.spans(texts, how)
        if not rows:
            return None
        doc, item, *rest = map(list, zip(*rows, strict=True))
        ids = batch.column(0).cast(pa.int64()).take(pa.array(doc, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array([index.ids[i] for i in item], pa.int64()), *[pa.array(x, pa.int64()) for x in rest]], schema=_SPANS)

    return docs.mapInArrow(lambda it: by_block(it, "text", work), SPANS).distinct()


def _shuffled(docs: DataFrame, tests: DataFrame, how: Winnowing) -> DataFrame:
    """The same rows when the benchmark is too large to broadcast, each with doc_key, the hash of its document's text."""

    def prints(name: str):
        def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            words = Hashed(texts)
            h, at = winnow(words, how.k, how.window)
            d = words.doc[at]
            keys = [batch.column(i).take(pa.array(d, pa.int64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([keys[0].cast(pa.int64()), keys[1], pa.array(h.view(np.int64)), pa.array(at - words.first[d], pa.int64())], names=[f"{name}_id", f"{name}_key", "print", f"{name}_at"])

        return lambda it: by_block(it, "text", work)

    keyed = lambda df, i: df.select(F.col(i), F.xxhash64("text").alias("key"), "text")
    docs, tests = keyed(docs, "doc_id"), keyed(tests, "item_id")
    left = docs.mapInArrow(prints("doc"), "doc_id long, doc_key long, print long, doc_at long")
    right = tests.mapInArrow(prints("item"), "item_id long, item_key long, print long, item_at long")
    pairs = left.join(right, "print").groupBy("doc_id", "doc_key", "item_id", "item_key").agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("shifts"))
    d = docs.select(F.col("doc_id").alias("d"), F.col("key").alias("dk"), F.col("text").alias("doc_text")).distinct()
    t = tests.select(F.col("item_id").alias("i"), F.col("key").alias("ik"), F.col("text").alias("item_text")).distinct()
    both = pairs.join(t, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_key") == F.col("ik"))).join(d, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_key") == F.col("dk")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, b = Hashed([r["doc_text"]]).hash, Hashed([r["item_text"]]).hash
                rows += [(r["doc_id"], r["item_id"], *x, r["doc_key"]) for by in r["shifts"] for x in extend(a, b, by, how.span)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_KEYED_SPANS)

    return both.select("doc_id", "doc_key", "item_id", "shifts", "doc_text", "item_text").mapInArrow(work, KEYED_SPANS).distinct()


def drop_contaminated(docs: DataFrame, tests: DataFrame, how: Winnowing = Winnowing()) -> DataFrame:
    """The rows of docs, all columns, that share no span with tests.

    Each row is judged by its own text: where it is read with a broadcast index,
    otherwise by joining the contaminated pairs of id and text away.
    """
    index = small_index(same_columns(tests, "item_id", "text"), how)
    if index is None:
        i, k = fresh(docs, "bad_id"), fresh(docs, "bad_key")
        bad = _shuffled(same_columns(docs, "doc_id", "text"), same_columns(tests, "item_id", "text"), how).select(F.col("doc_id").alias(i), F.col("doc_key").alias(k)).distinct()
        return docs.join(bad, docs["doc_id"].eqNullSafe(bad[i]) & (F.xxhash64(docs["text"]) == bad[k]), "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(index)

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        keep = np.ones(len(texts), bool)
        keep[[r[0] for r in held.value.spans(texts, how)]] = False
        return batch.filter(pa.array(keep))

    return docs.mapInArrow(lambda it: by_block(it, "text", work), docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Spans by brute force: every run of 13 words of either side, joined on its text, islands of consecutive hits.
OP1_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
dg AS (SELECT doc_id, p AS doc_word, array_to_string(w[p + 1 : p + 13], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS p FROM d WHERE len(w) >= 13)),
bg AS (SELECT item_id, p AS item_word, array_to_string(w[p + 1 : p + 13], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(0, len(w) - 12)) AS p FROM b WHERE len(w) >= 13)),
hit AS (SELECT DISTINCT doc_id, item_id, doc_word, item_word FROM dg JOIN bg USING (g)),
isle AS (SELECT *, doc_word - row_number() OVER (PARTITION BY doc_id, item_id, doc_word - item_word ORDER BY doc_word) AS run FROM hit)
SELECT doc_id, item_id, min(doc_word)::BIGINT AS doc_word, min(item_word)::BIGINT AS item_word, (count(*) + 12)::BIGINT AS n_words
FROM isle GROUP BY doc_id, item_id, doc_word - item_word, run
"""
