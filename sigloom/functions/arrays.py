"""Frame functions on array<double> columns, as higher-order functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values) -> Column:
    """A constant array or matrix, folded once at planning time."""
    a = np.asarray(values, dtype=float)
    return F.from_json(F.lit(json.dumps(a.tolist())), "array<double>" if a.ndim == 1 else "array<array<double>>")


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def each(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A scalar function over every element."""
    return lambda a: F.transform(a, lambda x: f(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; inside a lambda it would be computed for every element."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def matmul(matrix, a: Column) -> Column:
    """matrix @ a with a constant matrix."""
    return let(a, lambda x: F.transform(literal(matrix), lambda row: dot(row, x)))


def times(a: Column, weights: Sequence[float]) -> Column:
    return F.zip_with(a, literal(weights), lambda x, w: x * w)


def divided(a: Column, weights: Sequence[float]) -> Column:
    return F.zip_with(a, literal(weights), lambda x, w: F.when(w != 0, x / w).otherwise(0.0))


def unit_norm(a: Column) -> Column:
    """L2 norm 1; a zero frame stays zero."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def batchwise_unit_norm(a: Column) -> Column:
    return let(norm(a) + 1e-8, lambda n: F.transform(a, lambda x: x / n))


def sample_norm(a: Column) -> Column:
    return let(F.sqrt(dot(a, a) / F.size(a) + 1e-7), lambda d: F.transform(a, lambda x: x / d))


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def instance_scale(a: Column, to: float = 1.0) -> Column:
    return let(peak(a), lambda p: F.transform(a, lambda x: to * x / (p + 1e-8)))


def unit_scale(a: Column) -> Column:
    """To [0, 1]; a constant frame is zero."""
    made = lambda r: F.transform(a, lambda x: F.when(r["high"] > r["low"], (x - r["low"]) / (r["high"] - r["low"])).otherwise(0.0))
    return let(F.struct(F.array_min(a).alias("low"), F.array_max(a).alias("high")), made)


def z_score(a: Column) -> Column:
    """By the frame's mean and sample standard deviation."""

    def centred(m: Column) -> Column:
        sd = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(a) - 1))
        return let(sd, lambda d: F.transform(a, lambda x: F.when(d > 0, (x - m) / d).otherwise(0.0)))

    return let(mean(a), centred)


def argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)) - 1


def one_hot(at: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def inverse_one_hot(a: Column) -> Column:
    return (argmax(a) / F.size(a) - 0.5) * 2


def category(a: Column, mu: int = 255) -> Column:
    """Index of every sample of a frame after peak scaling and mu-law companding."""
    from .scalars import mu_law

    return let(peak(a), lambda p: F.transform(a, lambda x: F.floor((mu_law(F.when(p > 0, x / p).otherwise(0.0), mu) + 1) * 0.5 * mu)))


def categorical(a: Column, mu: int = 255) -> Column:
    return F.transform(category(a, mu), lambda i: one_hot(i, mu + 1))


def inverse_categorical(frames: Column, mu: int = 255) -> Column:
    from .scalars import inverse_mu_law

    return F.transform(frames, lambda a: inverse_mu_law((argmax(a) / float(mu) - 0.5) * 2, mu))


def binarize(a: Column, threshold: float = 0.5) -> Column:
    return F.transform(a, lambda x: (x > threshold).cast("tinyint"))


def band(a: Column, lo: int, hi: int) -> Column:
    return F.slice(a, lo + 1, hi - lo)


def unband(a: Column, lo: int, size: int) -> Column:
    """The inverse of band(): zeros around."""
    return F.concat(F.array_repeat(F.lit(0.0), lo), a, F.array_repeat(F.lit(0.0), F.lit(size - lo) - F.size(a)))


def assign_band(a: Column, lo: int, hi: int, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when((i >= lo) & (i < hi), value).otherwise(x))


def pad(a: Column, size: int) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(a), F.lit(0))))


def reshape(a: Column, width: int) -> Column:
    """A flat frame as rows of the given width."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / width).cast("int") - 1), lambda i: F.slice(a, i * width + 1, width))


def squeeze(a: Column) -> Column:
    """The one element of an axis of size 1; an axis of another size is an error, a null stays null."""
    return F.when(F.size(a) == 1, F.element_at(a, 1)).when(a.isNotNull(), F.raise_error(F.lit("only an axis of size 1 can be squeezed")))


def sharpen(a: Column, kernel: Sequence[float]) -> Column:
    """Convolution of the same size, negative results cut off."""
    k = list(reversed([float(x) for x in kernel]))
    before = len(k) - 1 - (len(k) - 1) // 2
    wide = F.concat(F.array_repeat(F.lit(0.0), before), a, F.array_repeat(F.lit(0.0), len(k) - 1 - before))
    return let(wide, lambda w: F.transform(a, lambda x, i: F.greatest(dot(F.slice(w, i + 1, len(k)), literal(k)), F.lit(0.0))))


def centroid(a: Column) -> Column:
    """Sum of |x| times the bin's number from 1, by the sum of these numbers."""
    n = F.size(a)
    return total(F.transform(a, lambda x, i: F.abs(x) * (i + 1))) / (n * (n + 1) / 2)


def flatness(a: Column) -> Column:
    """Geometric over arithmetic mean of |x|; a frame with a zero is 0."""
    m = mean(F.transform(a, F.abs))
    g = F.exp(mean(F.transform(a, lambda x: F.log(F.greatest(F.abs(x), F.lit(1e-300))))))
    return F.when((m > 0) & (F.array_min(F.transform(a, F.abs)) > 0), g / m).otherwise(0.0)


def energy(a: Column, first: int = 3) -> Column:
    """Sum of squares of the bins from number first on; zero counts as 1e-12."""
    e = total(F.transform(a, lambda x, i: F.when(i + 1 >= first, x * x).otherwise(0.0)))
    return F.when(e == 0, 1e-12).otherwise(e)


def high_frequency_content(a: Column, first: int = 3) -> Column:
    e = total(F.transform(a, lambda x, i: F.when(i + 1 >= first, x * x * (i + 1)).otherwise(0.0)))
    return F.when(e == 0, 1e-12).otherwise(e)


def pack_bits(bits: Column) -> Column:
    """Words of 64 bits, the first bit highest; the last word is filled with zeros."""

    def packed(b: Column) -> Column:
        bit = lambda w, i: F.coalesce(F.get(b, w * 64 + i - 1), F.lit(0)).cast("long")
        word = lambda w: F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, 1).bitwiseOR(bit(w, i)))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(b) / 64).cast("int") - 1), lambda w: word(w))

    return let(bits, packed)


def unpack_bits(words: Column, n: int) -> Column:
    bit = lambda w, i: F.getbit(F.get(w, F.floor(i / 64).cast("int")), F.lit(63) - F.pmod(i, F.lit(64))).cast("tinyint")
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: bit(w, i)))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two packed codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def simhash(a: Column, planes) -> Column:
    """1 where a frame lies on the positive side of a hyperplane."""
    return F.transform(matmul(planes, a), lambda x: (x > 0).cast("tinyint"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where either has no length."""
    return F.coalesce(1 - F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), 1.0))
