"""Quality classifier learned from positive and unlabelled documents.

Trusted positives are documents labelled good; everything else about quality is
unknown, so the classifier is fitted against plain unlabelled text by the
non-negative unbiased risk

    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0))

with the sigmoid loss and, where the bracket is below zero, a step that undoes
the overfit.  The prior (the share of good documents) is estimated first: a
logistic model of positive against unlabelled orders the held-out halves, and
the least ratio of the two upper tails, each with its Hoeffding margin, is the
estimate.  Labels of bad documents are never used.

Features are shares and repetitions of character and word classes, and the
frequencies of pairs of neighbouring character classes; they do not depend on
the language's words.  They are made once and kept as a table.  Means, scales and
the tails that give the prior come from all documents; of the trusted positives
at most ``positives`` (least md5 of the id) are learned from.  Both models are
fitted by few passes over the table's rows, each one distributed sum of gradients
(and, for the convex model, curvatures).  A pass takes one of ``passes`` parts of
the rows, or all of them while they are fewer than ``batch``, so every document
takes part and the work is a read or two of the table whatever its size.  What
comes to the driver are sums as long as the features and the positives' features.

Defined results: null and empty texts score 0 and are not kept; repeated rows
are scored each, and of a positive id with several texts one is learned from; a
null id is carried; without positives there is no model, the scores are null and
every text that is not empty is kept; an empty table gives no rows; a long text is
read in parts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import chosen
from .shared import same_columns, written
from .textkernel import Hashed, Words, by_block, fold, grams, is_long, mix, parts


@dataclass(frozen=True)
class Pu:
    positives: int = 6000
    batch: int = 1 << 16
    passes: int = 6
    decay: float = 1e-2
    delta: float = 0.1


#: Character classes: small and capital letters, digits, space, line end, sentence signs, quotes and brackets, exclamation, bar, other signs, others.
_NAMES = ("lower", "upper", "digit", "space", "newline", "sentence", "quote", "shout", "bar", "sign", "other")
_K = len(_NAMES)


def _class_table() -> np.ndarray:
    out = np.full(65536, _K - 1, np.int64)
    for cp in range(65536):
        ch = chr(cp)
        if ch.isalpha():
            out[cp] = 1 if ch.isupper() else 0
        elif ch.isdigit():
            out[cp] = 2
        elif ch == "\n":
            out[cp] = 4
        elif ch.isspace():
            out[cp] = 3
    for k, chars in ((5, ".,;:?-"), (6, "\"'()[]“”‘’«»"), (7, "!"), (8, "|"), (9, "#$%&*+/<=>@\\^_`{}~")):
        for ch in chars:
            out[ord(ch)] = k
    return out


_TABLE: list[np.ndarray] = []
#: Characters a word and line ends a word count up to this number.
_MOST = 50
_WIDTH = _K + _K * _K + 8


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Share of repeated values of each document."""
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d, weights=again, minlength=n) / np.maximum(1, np.bincount(d, minlength=n))


def _kinds(cps: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    return _TABLE[0][np.minimum(cps, 65535)]


def _vectors(size: np.ndarray, kinds: np.ndarray, pairs: np.ndarray, words: np.ndarray, inside: np.ndarray, capitals: np.ndarray, again: list[np.ndarray]) -> np.ndarray:
    """Features from the counts of each text: characters, their classes, pairs of classes, words, characters in words, words with a capital; and shares of repeated runs of 1, 2 and 4 words."""
    n, count, size = len(words), np.maximum(1, words), np.maximum(1, size)
    share = kinds.reshape(n, _K) / size[:, None]
    stats = [np.log1p(words) / 5, np.minimum(inside / count, _MOST) / 10, again[0] / np.sqrt(count), *again, capitals / count, np.minimum(share[:, 4] * size / count, _MOST)]
    return np.concatenate([share, np.sqrt(pairs.reshape(n, _K * _K) / size[:, None]), np.stack(stats, 1)], axis=1).astype(np.float32)


def features(texts: list[str]) -> np.ndarray:
    """One row a text; a text without a character is a row of zeros."""
    if is_long(texts):
        return _long_features(texts[0])
    words = Words(texts)
    n = words.n
    kinds = _kinds(words.cps)
    doc = np.repeat(np.arange(n), words.lens + 1)[: len(kinds)]
    inside = np.ones(len(kinds), bool)
    inside[(words.origin + words.lens)[:-1]] = False  # the ends between texts
    first = _kinds(words.cps[words.start]) == 1
    doc, kinds = doc[inside], kinds[inside]
    same = doc[1:] == doc[:-1]
    pair = (doc[1:] * _K + kinds[:-1]) * _K + kinds[1:]
    two, at2 = grams(words.hash, words.doc, 2)
    four, at4 = grams(words.hash, words.doc, 4)
    return _vectors(
        words.lens,
        np.bincount(doc * _K + kinds, minlength=n * _K),
        np.bincount(pair[same], minlength=n * _K * _K),
        words.count,
        np.bincount(words.doc, weights=words.end - words.start, minlength=n),
        np.bincount(words.doc, weights=first, minlength=n),
        [_repeats(words.doc, words.hash, n), _repeats(words.doc[at2], two, n), _repeats(words.doc[at4], four, n)],
    )


def _long_features(text: str) -> np.ndarray:
    kinds, pairs = np.zeros(_K, np.int64), np.zeros(_K * _K, np.int64)
    inside = capitals = 0
    last, open_word = np.zeros(0, np.int64), False
    for cps in parts(text):
        k, word = _kinds(cps), fold(cps) != 0
        start = word & ~np.concatenate([[open_word], word[:-1]])
        kinds += np.bincount(k, minlength=_K)
        inside += int(word.sum())
        capitals += int((k[start] == 1).sum())
        k = np.concatenate([last, k])
        pairs += np.bincount(k[:-1] * _K + k[1:], minlength=_K * _K)
        last, open_word = k[-1:], bool(word[-1])
    h = Hashed([text]).hash
    again = []
    for n in (1, 2, 4):
        size = max(0, len(h) - n + 1)
        run = h[:size].copy()
        for lo in range(0, size, 1 << 18):  # the hashes of grams()
            part = run[lo : lo + (1 << 18)]
            if n > 1:
                for j in range(1, n):
                    part *= np.uint64(0x9FB21C651E98DF25)
                    part += h[lo + j : lo + j + len(part)]
                part[:] = mix(part)
        run.sort()
        again.append(np.array([(run[1:] == run[:-1]).sum() / max(1, size)]))
    one = lambda x: np.array([x])
    return _vectors(one(len(text)), kinds, pairs, one(len(h)), one(inside), one(capitals), again)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -35, 35)))


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, some (whether there is a text), h (a hash of the row), x (the features' bytes) of every row."""

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        x = [row.tobytes() for row in features(texts)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bool(t) for t in texts]), batch.column(2), pa.array(x, pa.binary())], names=["doc_id", "some", "h", "x"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)))
    return rows.mapInArrow(lambda it: by_block(it, "text", work), "doc_id long, some boolean, h long, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, _WIDTH).astype(float)


def _total(table: DataFrame, width: int, add) -> np.ndarray:
    """The sum of add(matrix) over the table's features: per task, then by some tasks, then here."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                total += add(_matrix(b.column(0).slice(at, 4096)))
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]}, schema=_SUM)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            for v in b.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]}, schema=_SUM)

    some = max(1, int(len(table.inputFiles()) ** 0.5))
    rows = table.select("x").mapInArrow(work, "v binary").repartition(some).mapInArrow(joined, "v binary").collect()
    return np.sum([np.frombuffer(r[0]) for r in rows], axis=0) if rows else np.zeros(width)


_SUM = pa.schema([("v", pa.binary())])


@dataclass
class _Scaled:
    """Standardised features with a last column of ones."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([((x - self.mean) / self.scale).clip(-8, 8), np.ones((len(x), 1))], 1)


_BINS, _SPAN = 4096, 16.0


def _bin(z: np.ndarray) -> np.ndarray:
    return np.clip((z + _SPAN) * (_BINS / (2 * _SPAN)), 0, _BINS - 1).astype(np.int64)


def prior_of(p: np.ndarray, u: np.ndarray, delta: float) -> float:
    """Share of positives in the unlabelled, from histograms of both by score."""
    if not p.sum() or not u.sum():
        return 1.0
    tail = lambda x: x[::-1].cumsum()[::-1] / x.sum()
    tail_p, tail_u = tail(p), tail(u)
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(p.sum()) + 1 / np.sqrt(u.sum()))
    ok = tail_p > 2 * margin
    if not ok.any():
        return 0.99
    best = ((tail_u[ok] + margin) / tail_p[ok]).argmin()
    return float(np.clip(tail_u[ok][best] / tail_p[ok][best], 0.01, 0.99))


def _ordering(p: np.ndarray, part, scaled: _Scaled, how: Pu) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the logistic model of positive against unlabelled by Newton's steps, a pass each, and the last curvature."""
    d = _WIDTH + 1

    def sums(z: np.ndarray, w: np.ndarray, sign: float) -> np.ndarray:
        s = _sigmoid(z @ w)
        slope = s if sign > 0 else s - 1
        return np.concatenate([[len(z)], slope @ z, ((z * (s * (1 - s))[:, None]).T @ z).ravel()])

    w, curvature = np.zeros(d), np.eye(d)
    for i in range(how.passes):
        u = _total(part(i, 0), 1 + d + d * d, lambda x, w=w: sums(scaled(x), w, 1))
        a, b = sums(p, w, -1), u
        a, b = a / max(1, a[0]), b / max(1, b[0])
        g = (a + b)[1 : d + 1] / 2 + how.decay * w
        curvature = (a + b)[d + 1 :].reshape(d, d) / 2 + how.decay * np.eye(d)
        step = np.linalg.solve(curvature, g)
        w = w - step * min(1.0, 8 / max(1e-9, np.abs(p @ step).mean()))
    return w, curvature


def _risk(p: np.ndarray, part, scaled: _Scaled, w: np.ndarray, curvature: np.ndarray, prior: float, how: Pu) -> np.ndarray:
    """Weights that lessen the non-negative risk: of some steps along a direction the best is taken, a pass each."""
    d, rungs = _WIDTH + 1, np.array([0, 0.0625, 0.25, 1.0, 4.0, 16.0])

    def sums(z: np.ndarray, tried: np.ndarray) -> np.ndarray:
        s = _sigmoid(z @ tried)
        return np.concatenate([[len(z)], s.sum(0), (z.T @ (s * (1 - s))).ravel()])

    def read(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        total = total / max(1, total[0])
        return total[1 : k + 1], total[k + 1 :].reshape(d, k)

    tried, reach = w[:, None] * np.array([0.5, 1, 2, 4]), 1.0
    for i in range(how.passes):
        k = tried.shape[1]
        sa, ga = read(sums(p, tried), k)
        sb, gb = read(_total(part(i, None), 1 + k + d * k, lambda x, t=tried: sums(scaled(x), t)), k)
        bracket = sb - prior * sa
        best = int((prior * (1 - sa) + np.abs(bracket)).argmin())
        w = tried[:, best]
        if i and not best:
            reach /= 32
        negative = gb[:, best] - prior * ga[:, best]
        g = (negative - prior * ga[:, best] if bracket[best] >= 0 else -negative) + how.decay * 0.1 * w
        tried = w[:, None] - reach * np.linalg.solve(curvature, g)[:, None] * rungs
    return w


def learn(table: DataFrame, labels: DataFrame, how: Pu = Pu()) -> Model | None:
    """The model from the table of encoded()."""
    ids = chosen(labels, "quality", how.positives, F.col("label") == 1).select("doc_id")
    mine = table.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("r")).orderBy("doc_id").collect()
    if not mine:
        return None
    p, half = np.stack([np.frombuffer(r.r.x, np.float32) for r in mine]).astype(float), np.array([r.r.h % 2 for r in mine])
    sums = _total(table, 1 + 2 * _WIDTH, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    n, mean = sums[0], sums[1 : _WIDTH + 1] / sums[0]
    scaled = _Scaled(mean, np.sqrt(np.maximum(0, sums[_WIDTH + 1 :] / n - mean * mean)) + 1e-3)
    shards = int(np.clip(n // (2 * how.batch), 1, how.passes))

    def part(i: int, half: int | None) -> DataFrame:
        rows = table if half is None else table.where(F.pmod("h", F.lit(2)) == half)
        return rows if shards == 1 else rows.where(F.pmod(F.floor(F.col("h") / 2), F.lit(shards)) == i % shards)

    p = scaled(p)
    w, curvature = _ordering(p[half == 0], part, scaled, how)
    u = _total(table.where(F.pmod("h", F.lit(2)) == 1), _BINS, lambda x: np.bincount(_bin(scaled(x) @ w), minlength=_BINS).astype(float))
    prior = prior_of(np.bincount(_bin(p[half == 1] @ w), minlength=_BINS), u, how.delta)
    w[-1] += np.log(2 * prior)  # the logistic margin is that of equal shares
    w = _risk(p, part, scaled, w, curvature, prior, how)
    return Model(scaled.mean, scaled.scale, w[:-1], float(w[-1]), prior)


def fit(docs: DataFrame, labels: DataFrame, how: Pu = Pu()) -> Model | None:
    """docs(doc_id, text), labels(doc_id, quality)."""
    return learn(written(encoded(docs), "features"), labels, how)


def judged(table: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, keep of every row of the table of encoded()."""
    held = table.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if held.value is None:
                p, keep = pa.nulls(batch.num_rows, pa.float64()), some
            else:
                value = held.value.score(_matrix(batch.column(3))) * some
                p, keep = pa.array(value), value >= 0.5
            yield pa.RecordBatch.from_arrays([batch.column(0), p, pa.array(keep)], names=["doc_id", "score", "keep"])

    return table.mapInArrow(work, "doc_id long, score double, keep boolean")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, keep of every row."""
    return judged(encoded(docs), model)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = written(encoded(same_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")), "features")
    return judged(table, learn(table, spark.read.parquet(f"{sf_dir}/labels.parquet")))
