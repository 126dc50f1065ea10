"""Reversible preprocessing of frames: fit on a DataFrame, apply as expressions.

A fitted stage is two expression builders and its parameters; what an inverse
needs of each row (norms, maxima) travels in columns of its own.  Versions are
digests of names and parameters, so derived tables can be keyed by them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S

Expression = Callable[[Column], Column]


@dataclass
class Fitted:
    """One stage: what it does to a frame, what it must remember of it, and how it is undone."""

    name: str
    forward: Expression
    inverse: Callable[[Column, Column | None], Column] | None = None
    remember: Expression | None = None
    params: dict = field(default_factory=dict)

    @property
    def version(self) -> str:
        return hashlib.md5(json.dumps([self.name, self.params], sort_keys=True, default=lambda x: np.asarray(x).tolist()).encode()).hexdigest()


class Stage:
    """Something to be fitted."""

    def fit(self, df: DataFrame, column: str) -> Fitted:
        raise NotImplementedError


class _Fixed(Stage):
    def __init__(self, fitted: Fitted):
        self.fitted = fitted

    def fit(self, df: DataFrame, column: str) -> Fitted:
        return self.fitted


def unit_norm() -> Stage:
    return _Fixed(Fitted("unit_norm", A.unit_norm, lambda y, n: F.transform(y, lambda x: x * n), A.norm))


def instance_scaling(to: float = 1.0) -> Stage:
    scaled = lambda a: A.let(A.peak(a), lambda p: F.transform(a, lambda x: F.when(p > 0, to * x / p).otherwise(0.0)))
    return _Fixed(Fitted("instance_scaling", scaled, lambda y, p: F.transform(y, lambda x: x * p / to), A.peak, {"to": to}))


def log() -> Stage:
    return _Fixed(Fitted("log", A.each(S.log_modulus), lambda y, _: A.each(S.inverse_log_modulus)(y)))


def mu_law(mu: float = 255.0) -> Stage:
    return _Fixed(Fitted("mu_law", A.each(lambda x: S.mu_law(x, mu)), lambda y, _: A.each(lambda x: S.inverse_mu_law(x, mu))(y), params={"mu": mu}))


def multiply(by: float) -> Stage:
    return _Fixed(Fitted("multiply", A.each(lambda x: x * by), lambda y, _: A.each(lambda x: x / by)(y), params={"by": by}))


def weighted(weights: Sequence[float]) -> Stage:
    return _Fixed(Fitted("weighted", lambda a: A.times(a, weights), lambda y, _: A.divided(y, weights), params={"weights": list(weights)}))


def absolute() -> Stage:
    return _Fixed(Fitted("absolute", A.each(F.abs)))


def binarize(threshold: float = 0.5) -> Stage:
    return _Fixed(Fitted("binarize", lambda a: A.binarize(a, threshold), params={"threshold": threshold}))


def sharpen(kernel: Sequence[float]) -> Stage:
    return _Fixed(Fitted("sharpen", lambda a: A.sharpen(a, kernel), params={"kernel": list(kernel)}))


def slicer(lo: int, hi: int, size: int) -> Stage:
    """Coefficients lo to hi; the inverse puts zeros around."""
    return _Fixed(Fitted("slicer", lambda a: A.band(a, lo, hi), lambda y, _: A.unband(y, lo, size), params={"lo": lo, "hi": hi, "size": size}))


def reshape(width: int) -> Stage:
    return _Fixed(Fitted("reshape", lambda a: A.reshape(a, width), lambda y, _: F.flatten(y), params={"width": width}))


def function(name: str, forward: Expression, backward: Expression | None = None) -> Stage:
    """A user's pair of expressions."""
    return _Fixed(Fitted(name, forward, None if backward is None else lambda y, _: backward(y)))


def moments(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each position: one aggregate, as many rows as a frame has positions."""
    rows = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x"), F.stddev_pop("x")).collect()
    at = {r[0]: (r[1], r[2]) for r in rows}
    return np.array([at[i][0] for i in range(len(at))]), np.array([at[i][1] for i in range(len(at))])


class MeanStd(Stage):
    def fit(self, df: DataFrame, column: str) -> Fitted:
        return mean_std(*moments(df, column))


def mean_std(mean, std) -> Fitted:
    mean, std = np.asarray(mean, float), np.asarray(std, float)
    forward = lambda a: A.divided(F.zip_with(a, A.literal(mean), lambda x, m: x - m), std)
    back = lambda y, _: F.zip_with(A.times(y, std), A.literal(mean), lambda x, m: x + m)
    return Fitted("mean_std", forward, back, params={"mean": mean.tolist(), "std": std.tolist()})


def hyperplanes(mean, std, bits: int, seed: int = 0) -> np.ndarray:
    """Differences of two draws around the features' distribution."""
    rng = np.random.default_rng(seed)
    mean, std = np.asarray(mean, float), np.asarray(std, float)
    return rng.normal(mean, std, (bits, len(mean))) - rng.normal(mean, std, (bits, len(mean)))


class SimHash(Stage):
    def __init__(self, bits: int = 64, packed: bool = False, seed: int = 0):
        self.bits, self.packed, self.seed = bits, packed, seed

    def fit(self, df: DataFrame, column: str) -> Fitted:
        return simhash(hyperplanes(*moments(df, column), self.bits, self.seed), self.packed)


def simhash(planes, packed: bool = False) -> Fitted:
    bits = lambda a: A.simhash(a, planes)
    return Fitted("simhash", (lambda a: A.pack_bits(bits(a))) if packed else bits, params={"planes": np.asarray(planes).tolist(), "packed": packed})


def nearest_centroid(a: Column, centroids) -> Column:
    """Number of the nearest centroid; of equals the first."""
    c = np.asarray(centroids, float)
    d = F.transform(A.literal(c), lambda row: A.total(F.zip_with(row, a, lambda x, y: (x - y) * (x - y))))
    return F.array_position(d, F.array_min(d)) - 1


def k_means(centroids) -> Fitted:
    """One-hot assignment; the inverse is the centroid."""
    c = np.asarray(centroids, float)
    return Fitted("k_means", lambda a: A.one_hot(nearest_centroid(a, c), len(c)), lambda y, _: F.element_at(A.literal(c), A.argmax(y).cast("int") + 1), params={"centroids": c.tolist()})


class KMeans(Stage):
    """Spark's own k-means over all rows; it can return fewer centroids than asked for."""

    def __init__(self, k: int, seed: int = 0, iterations: int = 20):
        self.k, self.seed, self.iterations = k, seed, iterations

    def fit(self, df: DataFrame, column: str) -> Fitted:
        from pyspark.ml.clustering import KMeans as Ml
        from pyspark.ml.functions import array_to_vector

        rows = df.select(array_to_vector(column).alias("features"))
        model = Ml(k=self.k, seed=self.seed, maxIter=self.iterations).fit(rows)
        return k_means([list(map(float, c)) for c in model.clusterCenters()])


class Pca(Stage):
    """Projection on the first components; the inverse multiplies by them."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, df: DataFrame, column: str) -> Fitted:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector

        model = PCA(k=self.k, inputCol="features", outputCol="out").fit(df.select(array_to_vector(column).alias("features")))
        m = model.pc.toArray()
        return components(m.T)


def components(matrix) -> Fitted:
    m = np.asarray(matrix, float)
    return Fitted("components", lambda a: A.matmul(m, a), lambda y, _: A.matmul(m.T, y), params={"matrix": m.tolist()})


@dataclass
class Pipeline:
    """Fitted stages in order."""

    stages: list[Fitted]

    def __getitem__(self, at: int | slice | list[int]) -> Pipeline:
        if isinstance(at, list):
            return Pipeline([self.stages[i] for i in at])
        return Pipeline(self.stages[at] if isinstance(at, slice) else [self.stages[at]])

    def __len__(self) -> int:
        return len(self.stages)

    @property
    def version(self) -> str:
        return hashlib.md5("".join(s.version for s in self.stages).encode()).hexdigest()

    def transform(self, df: DataFrame, column: str, out: str = "transformed") -> DataFrame:
        """df with the result and, for each stage that needs it, ``<out>_<stage's number>``."""
        now = df.withColumn(out, A.doubles(F.col(column)))
        for i, s in enumerate(self.stages):
            if s.remember is not None:
                now = now.withColumn(f"{out}_{i}", s.remember(F.col(out)))
            now = now.withColumn(out, s.forward(F.col(out)))
        return now

    def inverse(self, df: DataFrame, column: str = "transformed", out: str = "restored") -> DataFrame:
        now = df.withColumn(out, F.col(column))
        for i, s in reversed(list(enumerate(self.stages))):
            if s.inverse is None:
                raise NotImplementedError(f"{s.name} has no inverse")
            now = now.withColumn(out, s.inverse(F.col(out), F.col(f"{column}_{i}") if s.remember is not None else None))
        return now


def fit(df: DataFrame, column: str, stages: list[Stage]) -> Pipeline:
    """Fit each stage on what the ones before it make."""
    done: list[Fitted] = []
    for s in stages:
        done.append(s.fit(Pipeline(done).transform(df, column, "__x"), "__x"))
    return Pipeline(done)
