"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct words, word pairs and skip-pairs (one word between) of
a text, hashed to ``2 ** bits`` buckets; each counts once, however long the text.
Training goes over a bounded sample of ``train_docs`` labelled documents (least
md5 of the id), ``epochs`` times, with a learning rate of its own for each
coordinate; the L1 term keeps a coordinate at exactly zero until its evidence
exceeds ``l1``, so the model is a short list of buckets and weights.  A fifth of
the sample is held out, and the cutoff is the one with the best F1 on it.

Features are made where the texts are; the sample meets in one task, and the
weights travel with the scoring tasks, which read the documents once.

Defined results: null and empty texts have the intercept's score and are not
toxic; repeated rows are scored each; a null id is carried; if the labels lack
either class there is no model: scores are null and nothing is toxic; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .samples import labelled
from .shared import same_columns
from .textkernel import Hashed, by_block, mix


@dataclass(frozen=True)
class Ftrl:
    bits: int = 22
    train_docs: int = 8000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1


_PAIR = np.uint64(0x9FB21C651E98DF25)
_SKIP = np.uint64(0xD6E8FEB86659FD93)


#: Words whose features are made at a time.
_SLICE = 1 << 18


def features(words: Hashed, bits: int, known: np.ndarray | None = None) -> np.ndarray:
    """Document << bits | bucket, once each, of every word, pair and skip-pair; only of the known buckets if they are given."""
    shift, out = np.uint64(64 - bits), [np.zeros(0, np.int64)]
    for lo in range(0, len(words), _SLICE):
        h, d = words.hash[lo : lo + _SLICE + 2], words.doc[lo : lo + _SLICE + 2]
        for step, by in ((0, None), (1, _PAIR), (2, _SKIP)):
            n = min(_SLICE, len(h) - step)
            if n <= 0:
                continue
            at = np.flatnonzero(d[:n] == d[step : n + step])
            bucket = ((mix(h[at]) if by is None else mix(h[at] * by + h[at + step])) >> shift).astype(np.int64)
            if known is not None:
                has = known[bucket]
                at, bucket = at[has], bucket[has]
            out.append(np.unique((d[at] << bits) | bucket))
    return np.unique(np.concatenate(out))


class Model:
    """Intercept, the buckets that have a weight, their weights and the cutoff."""

    def __init__(self, how: Ftrl, bias: float = 0.0, buckets: np.ndarray | None = None, weights: np.ndarray | None = None, cutoff: float | None = None):
        self.how, self.bias, self.cutoff = how, bias, cutoff
        self.buckets = np.zeros(0, np.int64) if buckets is None else buckets
        self.weights = np.zeros(0) if weights is None else weights
        self._has: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_has": None}

    def score(self, texts: list[str]) -> np.ndarray:
        words = Hashed(texts)
        if self._has is None:
            self._has = np.zeros(1 << self.how.bits, bool)
            self._has[self.buckets] = True
        pair = features(words, self.how.bits, self._has)
        weight = self.weights[np.searchsorted(self.buckets, pair & ((1 << self.how.bits) - 1))]
        total = self.bias + np.bincount(pair >> self.how.bits, weights=weight, minlength=words.n)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(rows: list[tuple[np.ndarray, int]], how: Ftrl) -> Model:
    """FTRL-proximal over (distinct buckets, label), in the given order and then reshuffled by a fixed seed."""
    if len({y for _, y in rows}) < 2:
        return Model(how)
    held, fit = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    if len({y for _, y in fit}) < 2:
        fit = rows
    z, n = np.zeros((1 << how.bits) + 1), np.zeros((1 << how.bits) + 1)
    bias = np.array([1 << how.bits])
    l1 = np.full(len(z), how.l1)
    l1[-1] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, -(zi - np.sign(zi) * l1[i]) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2))

    order = np.arange(len(fit))
    rng = np.random.default_rng(7)
    for epoch in range(how.epochs):
        if epoch:
            rng.shuffle(order)
        for k in order:
            x, y = fit[k]
            i = np.concatenate([x, bias])
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha * w
            n[i] += g * g
    used = np.flatnonzero(n[:-1])
    w = weights(used)
    model = Model(how, float(weights(bias)[0]), used[w != 0], w[w != 0], 0.5)
    dense = np.zeros(1 << how.bits)
    dense[model.buckets] = model.weights
    p = np.array([1 / (1 + np.exp(-np.clip(model.bias + dense[x].sum(), -35, 35))) for x, _ in held])
    y = np.array([y for _, y in held])
    best = 0.0
    for cut in np.arange(0.1, 0.95, 0.05):
        hit = (p >= cut) & (y == 1)
        f1 = 2 * hit.sum() / max(1, (p >= cut).sum() + (y == 1).sum())
        if f1 > best or (f1 == best and abs(cut - 0.5) < abs(model.cutoff - 0.5)):
            best, model.cutoff = f1, float(round(cut, 2))
    return model


def fit(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl()) -> Model:
    def encode(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        pair = features(Hashed(texts), how.bits)
        cuts = np.searchsorted(pair >> how.bits, np.arange(len(texts) + 1))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(pair & ((1 << how.bits) - 1), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["doc_id", "label", "buckets"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(d, y, np.array(x.values)) for b in batches for d, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)]
        rows.sort(key=lambda r: (int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]), r[1], len(r[2]), r[2].tobytes()))
        model = train([(x.astype(np.int64), y) for _, y, x in rows], how)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.cutoff], pa.float64()), pa.array([model.buckets]), pa.array([model.weights])], names=["bias", "cutoff", "buckets", "weights"])

    rows = labelled(docs, labels, "toxic", how.train_docs).mapInArrow(lambda it: by_block(it, "text", encode), "doc_id long, label int, buckets array<int>")
    r = rows.repartition(1).mapInArrow(learn, "bias double, cutoff double, buckets array<long>, weights array<double>").first()
    return Model(how) if r is None else Model(how, r[0], np.array(r[2], np.int64), np.array(r[3], float), r[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, toxic of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        model = held.value
        if model.cutoff is None:
            p, toxic = pa.nulls(len(texts), pa.float64()), np.zeros(len(texts), bool)
        else:
            p = model.score(texts)
            toxic = (p >= model.cutoff) & np.array([bool(t) for t in texts])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(toxic)], names=["doc_id", "score", "toxic"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(lambda it: by_block(it, "text", work), "doc_id long, score double, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = same_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
