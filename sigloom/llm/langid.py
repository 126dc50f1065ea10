"""Language identification by rank-order n-gram profiles.

The profile of a language is its ``size`` most frequent 1- to 3-grams, taken
inside words that have a space put on either side.  A document's own most
frequent n-grams are compared with each profile by the out-of-place measure: the
sum of the rank differences, an n-gram that the profile lacks counting ``size``.
The language is the one with the least sum (of equals the first by name).

A text is rejected if it has no word, or if its sum is above
``max_distance`` percent of the greatest possible one: it then resembles no
profile.  Profiles are fitted on a bounded sample: of each declared language the
``train_docs`` documents whose md5 of the id is least.  Equal counts are ordered
by the n-gram's code points, so everything is exact integer arithmetic.

Texts are read twice, by the sample's scan and by the decision's, and never
shuffled; profiles hold ``size`` rows a language and travel with the tasks.

Defined results: null and empty texts have no language (null) and are rejected;
rows without an id or declared language are judged but not learned from;
repeated rows are judged each; without any profile all rows are rejected; a long
text is read in parts, whose counts are added; extra columns are ignored by
``identify`` and kept by ``drop_unknown``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import same_columns
from .textkernel import Words, by_block, fold, is_long, parts


@dataclass(frozen=True)
class Profiles:
    size: int = 300
    train_docs: int = 400
    max_distance: int = 80
    #: Sampled ids up to this number are broadcast to the sample's scan.
    broadcast_ids: int = 200_000


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, n-gram as three 21-bit code points (0 after its end), count; by document and n-gram."""
    words = Words(texts)
    empty = np.zeros(0, np.int64)
    if not len(words):
        return empty, empty.astype(np.uint64), empty
    # every word with a space before it, and one after the last word of a document
    size = words.end - words.start
    last = np.zeros(len(words), bool)
    last[words.first[1:][words.count > 0] - 1] = True
    step = size + 1 + last
    total = int(step.sum())
    place = np.cumsum(step) - step
    chars = np.full(total, 32, np.uint32)
    inside = np.ones(total, bool)
    inside[place] = False
    inside[(place + step - 1)[last]] = False
    chars[inside] = words.folded[words.folded != 0]
    doc = np.repeat(words.doc, step)
    letters, small = np.unique(chars, return_inverse=True)
    small = small.astype(np.int64) + 1
    width = int(len(letters) + 1).bit_length()
    space = chars == 32
    room = 3 * width
    if room + int(words.n).bit_length() > 63:
        raise ValueError("too many characters and documents in one block")
    keys = []
    one = small << (2 * width)
    at = np.flatnonzero(~space)
    keys.append((doc[at] << room) | one[at])
    same = doc[:-1] == doc[1:]
    two = one[:-1] | (small[1:] << width)
    at = np.flatnonzero(same)
    keys.append((doc[at] << room) | two[at])
    at = np.flatnonzero((doc[:-2] == doc[2:]) & ~space[1:-1])
    keys.append((doc[at] << room) | two[at] | small[at + 2])
    keys = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    mask = (1 << width) - 1
    wide = np.concatenate([[0], letters]).astype(np.uint64)
    code = np.zeros(len(keys), np.uint64)
    for k in (2, 1, 0):
        code = (code << np.uint64(21)) | wide[(keys >> (k * width)) & mask]
    return keys >> room, code, count


def _spaced(text: str) -> Iterator[np.ndarray]:
    """A long text in parts, folded, with one space before each word and after the last."""
    open_word, last = False, None
    for cps in parts(text):
        chars = fold(cps)
        inside = chars != 0
        before = np.concatenate([[open_word], inside[:-1]])
        # the first character outside a word stands for the space after it, and is dropped until the next word is sure
        keep = inside | before
        out = np.where(inside, chars, 32).astype(np.uint32)[keep]
        if last is None and len(out):
            out = np.concatenate([np.array([32], np.uint32), out])
        if len(out):
            last = out[-1]
            yield out
        open_word = bool(inside[-1]) if len(inside) else open_word
    if last is not None and last != 32:
        yield np.array([32], np.uint32)


def _long_counts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram_counts of one long text."""
    code, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held = np.zeros(0, np.uint32)
    wide = lambda x, by: x.astype(np.uint64) << np.uint64(by)
    for new in _spaced(text):
        c, m = np.concatenate([held, new]), len(held)  # n-grams that end in the new part
        grams = [wide(c[m:][c[m:] != 32], 42)]
        a, b = c[max(m - 1, 0) : -1], c[max(m - 1, 0) + 1 :]
        grams.append(wide(a, 42) | wide(b, 21))
        at = max(m - 2, 0)
        a, b, e = c[at:-2], c[at + 1 : -1], c[at + 2 :]
        inner = b != 32
        grams.append((wide(a, 42) | wide(b, 21) | e.astype(np.uint64))[inner])
        found, n = np.unique(np.concatenate(grams), return_counts=True)
        both, back = np.unique(np.concatenate([code, found]), return_inverse=True)
        code, count = both, np.bincount(back, weights=np.concatenate([count, n]), minlength=len(both)).astype(np.int64)
        held = c[-2:]
    return np.zeros(len(code), np.int64), code, count


def _blocks(texts: list[str]):
    """gram_counts, in parts if the characters of a block are too many to be coded together."""
    if is_long(texts):
        return [(0, *_long_counts(texts[0]))]
    try:
        return [(0, *gram_counts(texts))]
    except ValueError:
        if len(texts) == 1:
            raise
        half = len(texts) // 2
        return _blocks(texts[:half]) + [(at + half, *rest) for at, *rest in _blocks(texts[half:])]


def top_grams(doc: np.ndarray, code: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, n-gram and rank from 0 of the size most frequent of each document."""
    order = np.argsort((doc << 32) - count, kind="stable")
    doc, code = doc[order], code[order]
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    rank = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
    top = rank < size
    return doc[top], code[top], rank[top]


def spelled(code: int) -> str:
    return "".join(chr(c) for c in ((code >> 42) & 0x1FFFFF, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF) if c)


def coded(gram: str) -> int:
    return sum(ord(c) << (42 - 21 * i) for i, c in enumerate(gram))


def sample(docs: DataFrame, how: Profiles) -> DataFrame:
    """lang and text of the documents that the profiles are fitted on."""
    labelled = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL")
    by = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")))
    ids = labelled.select("lang", "doc_id").withColumn("r", F.rank().over(by)).where(F.col("r") <= how.train_docs).select("lang", "doc_id").distinct()
    few = ids.limit(how.broadcast_ids + 1).collect()
    if len(few) <= how.broadcast_ids:
        ids = F.broadcast(docs.sparkSession.createDataFrame(few, ids.schema))
    return labelled.join(ids, ["lang", "doc_id"], "left_semi").select("lang", "text")


def fit(docs: DataFrame, how: Profiles = Profiles()) -> DataFrame:
    """lang, gram, rank: the profile of each declared language of docs(doc_id, text, lang)."""

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch | None:
        langs, out = batch.column(0).to_pylist(), []
        for at, doc, code, count in _blocks(texts):
            for lang in set(langs[at : at + len(texts)]):
                mine = np.array([x == lang for x in langs])[at + doc] if len(doc) else np.zeros(0, bool)
                grams, back = np.unique(code[mine], return_inverse=True)
                n = np.bincount(back, weights=count[mine], minlength=len(grams)).astype(np.int64)
                out += [(lang, spelled(int(g)), int(k)) for g, k in zip(grams, n, strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "gram", "n"])

    counts = sample(same_columns(docs, "doc_id", "text", "lang"), how).mapInArrow(lambda it: by_block(it, "text", work), "lang string, gram string, n long")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best) - 1)
    return ranked.where(F.col("rank") < how.size).select("lang", "gram", "rank")


class Judge:
    """All profiles as one table from n-gram to rank by language."""

    def __init__(self, rows: list[tuple[str, str, int]], how: Profiles):
        self.how = how
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.array(sorted({coded(r[1]) for r in rows}), np.uint64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.codes, np.uint64(coded(gram))), self.langs.index(lang)] = rank

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place sums (documents x languages) and the number of n-grams compared."""
        out, n = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64)
        for at, doc, code, count in _blocks(texts):
            doc, code, rank = top_grams(doc, code, count, self.how.size)
            if not len(doc) or not len(self.codes):
                continue
            where = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            where[self.codes[where] != code] = len(self.codes)
            known = self.ranks[where]
            off = np.where(known < 0, self.how.size, np.abs(known - rank[:, None]))
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[at + doc[begin]] = np.add.reduceat(off, begin, axis=0)
            n[at + doc[begin]] = np.diff(np.append(begin, len(doc)))
        return out, n

    def decide(self, texts: list[str]) -> tuple[list, list, list, np.ndarray]:
        """Language, its sum, n-grams compared and acceptance of each text."""
        sums, n = self.distances(texts)
        if not self.langs:
            return [None] * len(texts), [None] * len(texts), n.tolist(), np.zeros(len(texts), bool)
        best = sums.argmin(1)
        least = sums[np.arange(len(texts)), best]
        keep = (n > 0) & (100 * least <= self.how.max_distance * self.how.size * n)
        found = n > 0
        return [self.langs[b] if f else None for b, f in zip(best, found, strict=True)], [int(x) if f else None for x, f in zip(least, found, strict=True)], n.tolist(), keep


def judge(docs: DataFrame, how: Profiles) -> Judge:
    return Judge([tuple(r) for r in fit(docs, how).collect()], how)


def identify(docs: DataFrame, how: Profiles = Profiles()) -> DataFrame:
    """doc_id, detected language, distance, n_grams, keep of every row of docs(doc_id, text, lang)."""
    held = docs.sparkSession.sparkContext.broadcast(judge(docs, how))

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        lang, least, n, keep = held.value.decide(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(least, pa.int64()), pa.array(n, pa.int64()), pa.array(keep)], names=["doc_id", "detected", "distance", "n_grams", "keep"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(lambda it: by_block(it, "text", work), "doc_id long, detected string, distance long, n_grams long, keep boolean")


def drop_unknown(docs: DataFrame, how: Profiles = Profiles()) -> DataFrame:
    """docs, all columns, without the rows whose language is not recognised."""
    held = docs.sparkSession.sparkContext.broadcast(judge(docs, how))

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return batch.filter(pa.array(held.value.decide(texts)[3]))

    return docs.mapInArrow(lambda it: by_block(it, "text", work), docs.schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Parameters: the source of documents and the columns that the last SELECT has.
LANGUAGE_CTES = r"""
sampled AS (SELECT lang, text FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) AS r FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL) WHERE r <= 400),
lw AS (SELECT lang, ' ' || unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) || ' ' AS w FROM sampled),
lg AS (SELECT lang, substr(w, i, n) AS g FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lw, (VALUES (1), (2), (3)) AS t(n)) WHERE substr(w, i, n) <> ' '),
profile AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, g) - 1 AS r FROM lg GROUP BY lang, g) WHERE r < 300),
rows_ AS (SELECT row_number() OVER () AS row_, doc_id, text FROM documents),
dw AS (SELECT row_, ' ' || unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) || ' ' AS w FROM rows_),
dwc AS (SELECT row_, w, count(*) AS c FROM dw GROUP BY row_, w),
dg AS (SELECT row_, substr(w, i, n) AS g, sum(c) AS c FROM (SELECT row_, w, c, n, unnest(range(1, len(w) - n + 2)) AS i FROM dwc, (VALUES (1), (2), (3)) AS t(n)) WHERE substr(w, i, n) <> ' ' GROUP BY row_, substr(w, i, n)),
top AS (SELECT * FROM (SELECT row_, g, row_number() OVER (PARTITION BY row_ ORDER BY c DESC, g) - 1 AS r FROM dg) WHERE r < 300),
langs AS (SELECT DISTINCT lang FROM profile),
sums AS (SELECT t.row_, l.lang, sum(CASE WHEN p.r IS NULL THEN 300 ELSE abs(t.r - p.r) END) AS s, count(*) AS n FROM top t CROSS JOIN langs l LEFT JOIN profile p ON p.lang = l.lang AND p.g = t.g GROUP BY t.row_, l.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_ ORDER BY s, lang) AS k FROM sums) WHERE k = 1)"""

OP9_SQL = f"""
WITH {LANGUAGE_CTES}
SELECT doc_id, b.lang AS detected, b.s::BIGINT AS distance, coalesce(b.n, 0)::BIGINT AS n_grams, coalesce(100 * b.s <= 80 * 300 * b.n, false) AS keep
FROM rows_ LEFT JOIN best b USING (row_)
"""
