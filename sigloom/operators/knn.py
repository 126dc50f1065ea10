"""Exact nearest neighbours on packed codes and on vectors.

Each query's neighbours are a top-k by (distance, id).  Queries travel to the index
in blocks of at most ``BROADCAST_BYTES`` (they are measured): every task streams its
part of the index past a block in numpy and gives its own k best, so the shuffle
carries k rows for each query and task, whatever the index's size, and no pair is
made outside numpy.  More queries are more blocks, by a hash of their id, with the
same rows.  A distance given as an expression takes Spark's cross join, which also
keeps k rows a task before it shuffles.

All pairs meet in a matrix product of single precision, which gives a bound that
their distance does not fall below (see ``_Bound``).  Only pairs whose bound is
within the k best so far, with room for the product's rounding, are measured, in
double precision; the rest cannot be among the nearest.

The cosine distance of a vector without length is 1.  A distance that is not a
number comes after all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import arrays as A
from ..storage import new_folder

BROADCAST_BYTES = 32 << 20
#: Numbers in a block of differences, which stays in a core's cache, and in one of bounds.
_BLOCK = 1 << 17
_BOUNDS = 1 << 22
#: Rows of the index that are compared at once, the first time (when little is known of the k best) and later.
_TILES = 4096, 8192
#: Pieces that each coefficient's range is cut into for the bound of the city block distance: at quantiles, so much further out from the median (the outer pieces lose most).
_PIECES, _OUT = 4, 1.6

Distance = Callable[[Column, Column], Column]
METRICS: dict[str, Distance] = {
    "hamming": A.hamming,
    "euclidean": A.euclidean,
    "sqeuclidean": lambda a, b: A.total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))),
    "cosine": A.cosine_distance,
    "cityblock": lambda a, b: A.total(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
    "chebyshev": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
}


def _measured(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of x and q, pair by pair."""
    if metric == "hamming":
        return np.bitwise_count(x ^ q).sum(1).astype(np.int64)
    if metric == "cosine":
        lengths = np.linalg.norm(x, axis=1) * np.linalg.norm(q, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(lengths == 0, 1.0, 1 - np.einsum("ij,ij->i", x, q) / lengths)
    d = x - q
    if metric == "cityblock":
        return np.abs(d).sum(1)
    if metric == "chebyshev":
        return np.abs(d).max(1)
    square = np.einsum("ij,ij->i", d, d)
    return np.sqrt(square) if metric == "euclidean" else square


class _Bound:
    """Lower bounds of the distances to a block of queries: ``right`` of rows and ``left`` of queries, whose product is at most ``limit`` where the distance is.

    For the euclidean distances it is |x|^2 - 2 q x, for cosine - q x of unit vectors, for
    codes - q x of signs.  For city blocks each coefficient's |x - q| is bounded by a
    function of x that is linear on every piece of the range: |x - q| itself but on
    the piece of q, and there the line through q with the slope of the longer side.
    Rows without a bound have NaN, and nothing excludes them.
    """

    def __init__(self, metric: str, q: np.ndarray):
        self.metric, self.width = metric, q.shape[1]
        if metric == "hamming":
            self.left = -self._signs(q)
            return
        if metric == "cosine":
            self.left = -self._unit(q)
            return
        with np.errstate(invalid="ignore", over="ignore"):
            middle = q.mean(0)
            self.middle = np.where(np.isfinite(middle), middle, 0.0)
            q = q - self.middle
            if metric != "cityblock":
                self.size = np.linalg.norm(q, axis=1)
                self.left = np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1).astype(np.float32)
                return
            self.size = np.abs(q).sum(1)
            cuts = np.quantile(q[:: 1 + len(q) // 4096], [0.5, *np.arange(1, _PIECES) / _PIECES], axis=0)
            self.cuts = np.sort(np.nan_to_num(cuts[0] + _OUT * (cuts[1:] - cuts[0])), axis=0)
            edges = np.concatenate([np.full((1, q.shape[1]), -np.inf), self.cuts, np.full((1, q.shape[1]), np.inf)])
            slopes = []
            for low, high in zip(edges, edges[1:]):
                slopes.append(np.where((q >= high) | (q >= low) & (high - q < q - low), np.float32(-1), np.float32(1)))
            steps = [b - a for a, b in zip(slopes, slopes[1:])]
            self.left = np.concatenate([slopes[0], *steps, *[-t * q for t in steps]], axis=1).astype(np.float32)
            self.constant = -(slopes[0] * q).sum(1)

    @staticmethod
    def _signs(x: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1)
        return bits.astype(np.float32) * 2 - 1

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            n = np.linalg.norm(x, axis=1, keepdims=True)
            unit = np.where(n == 0, 0.0, x / n)
            # where the product of two lengths leaves the range of numbers, the distance isn't that of the unit vectors
            return np.where((n == 0) & ~x.any(1, keepdims=True) | (n > 1e-150) & (n < 1e150), unit, np.nan).astype(np.float32)

    def right(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Of rows, and the greatest of their sizes; rows that single precision cannot hold have none and NaN for a bound."""
        if self.metric == "hamming":
            return self._signs(x), 0.0
        if self.metric == "cosine":
            return self._unit(x), 1.0
        with np.errstate(invalid="ignore", over="ignore"):
            x = x - self.middle
            if self.metric != "cityblock":
                square = np.einsum("ij,ij->i", x, x)
                made, sizes = np.concatenate([x, square[:, None]], axis=1).astype(np.float32), np.sqrt(square)
            else:
                above = [x >= c for c in self.cuts]
                made, sizes = np.concatenate([x, *[np.where(a, x, 0.0) for a in above], *above], axis=1).astype(np.float32), np.abs(x).sum(1)
        held = sizes < 1e15
        made[~held] = np.nan
        return made, float(sizes[held].max(initial=0.0))

    def limit(self, at: slice, most: np.ndarray, size: float, digits: int) -> np.ndarray:
        """What the product is at most for rows up to ``size`` whose rounded distance is at most ``most``; infinite where nothing can be said."""
        if self.metric == "hamming":
            return (2 * most - 64 * self.width + 0.5).astype(np.float32)
        # a sum of n products of numbers, all rounded, is off by less than n + 4 halves of the last bit of the sum of their absolutes
        rough = (self.left.shape[1] + 8) * 2.0**-23
        near = (most + 10.0**-digits) * (1 + 1e-9)
        with np.errstate(invalid="ignore", over="ignore"):
            if self.metric == "cosine":
                found = near - 1 + 2 * rough
            elif self.metric == "cityblock":
                found = near - self.constant[at] + 4 * rough * (self.size[at] + size)
            else:
                square = near if self.metric == "sqeuclidean" else near**2 * (self.width if self.metric == "chebyshev" else 1)
                found = square - self.size[at] ** 2 + 2 * rough * (self.size[at] + size) ** 2
            safe = np.isfinite(found) & (np.abs(found) < 1e30)
            return np.where(safe, np.nextafter(found.astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def _matrix(column: pa.Array, metric: str) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False)
    # bits are counted of unsigned words; of signed ones numpy counts those of the absolute value
    return (flat.astype(np.int64).view(np.uint64) if metric == "hamming" else flat.astype(float)).reshape(len(column), width)


def nearest(index: DataFrame, queries: DataFrame, k: int, metric: str | Distance = "euclidean", id: str = "id", vector: str = "vector", query_id: str = "query_id", digits: int = 9) -> DataFrame:
    """query_id, id, distance, rank from 1 of the k nearest rows of the index to every query.

    Distances are rounded to ``digits`` decimals, so that rounding noise doesn't
    order equal neighbours.  Rows without a vector are nobody's neighbour.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("__q")).where("__q IS NOT NULL")
    rows = index.select(F.col(id).alias("id"), F.col(vector).alias("__v")).where("__v IS NOT NULL")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    if isinstance(metric, str):
        size = q.agg(F.sum(F.size("__q").cast("long") * 8 + 16)).first()[0] or 0
        blocks = max(1, -(-size // BROADCAST_BYTES))
        if blocks > 1:  # both sides are read block by block, but made once
            stored = _stored(q.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "queries", ["__block"])
            rows = _stored(rows, "index")
        parts = [q if blocks == 1 else stored.where(F.col("__block") == i).drop("__block") for i in range(blocks)]
        scored = reduce(DataFrame.unionByName, [_streamed(rows, part, k, metric, digits) for part in parts])
    else:
        scored = rows.crossJoin(q).select("query_id", "id", metric(F.col("__v"), F.col("__q")).alias("distance"))
        if dict(scored.dtypes)["distance"] == "double":
            scored = scored.withColumn("distance", F.round("distance", digits))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _stored(df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _streamed(rows: DataFrame, queries: DataFrame, k: int, metric: str, digits: int) -> DataFrame:
    """query_id, id, distance: of every task's rows the k nearest to each query."""
    asked = queries.toArrow()
    kind = IntegerType() if metric == "hamming" else DoubleType()
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", rows.schema["id"].dataType), StructField("distance", kind)])
    if not asked.num_rows:
        return rows.sparkSession.createDataFrame([], schema)
    ids, matrix = asked.column("query_id").combine_chunks(), _matrix(asked.column("__q").combine_chunks(), metric)
    held = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        bound = _Bound(metric, q)
        best = None
        most = np.full(len(q), np.inf)
        for own, x in _tiles(batches, metric):
            col, row, d = (np.concatenate(a) for a in zip(*_near(metric, bound, q, x, _places(own), k, most, digits)))
            pool = own.take(pa.array(row))
            if best:
                col, d, pool = np.concatenate([best[0], col]), np.concatenate([best[1], d]), pa.concat_arrays([best[2], pool])
            order, nth = _top(col, d, _places(pool), k)
            col, d = col[order], d[order]
            best = (col, d, pool.take(pa.array(order)))
            full = nth == k - 1
            most[col[full]] = np.where(np.isnan(d[full]), np.inf, d[full])
        for lo in range(0, len(best[0]) if best else 0, 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best[0][part])), best[2][part], pa.array(best[1][part])], names=["query_id", "id", "distance"])

    return rows.mapInArrow(work, schema)


def _tiles(batches: Iterator[pa.RecordBatch], metric: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and vectors, a few thousand rows at a time."""
    held, n, sizes = [], 0, iter(_TILES)
    size = next(sizes)
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == size:
                yield _tile(held, metric)
                held, n, size = [], 0, next(sizes, size)
    if held:
        yield _tile(held, metric)


def _tile(held: list[pa.RecordBatch], metric: str) -> tuple[pa.Array, np.ndarray]:
    return pa.concat_arrays([b.column(0) for b in held]), _matrix(pa.concat_arrays([b.column(1) for b in held]), metric)


def _places(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order."""
    place = np.empty(len(ids), np.int64)
    place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return place


def _top(query: np.ndarray, d: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k least by (distance, place) of each query are, query by query, and their ranks from 0."""
    order = np.lexsort((place, np.where(np.isnan(d), np.inf, d), query))
    col = query[order]
    first = np.concatenate([[True], col[1:] != col[:-1]])[: len(col)]
    nth = np.arange(len(col)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return order[nth < k], nth[nth < k]


def _near(metric: str, bound: _Bound, q: np.ndarray, x: np.ndarray, place: np.ndarray, k: int, most: np.ndarray, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """query, row, rounded distance of all pairs that may be among the k best, where those so far reach to ``most``."""
    right, size = bound.right(x)
    right = np.ascontiguousarray(right.T)

    def rounded(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        d = _measured(metric, x[row], q[col])
        return d.astype(np.int32) if metric == "hamming" else np.round(d, digits) + 0.0

    step, pairs = max(1, _BOUNDS // len(x)), max(1, _BLOCK // max(1, x.shape[1]))
    yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32 if metric == "hamming" else np.float64)
    for lo in range(0, len(q), step):
        at = slice(lo, lo + step)
        product = bound.left[at] @ right
        reach = most[at]
        if len(x) > k and np.isinf(reach).any():
            # k rows of small bounds, measured, limit the rest
            first = np.argpartition(product[:, : max(1024, k + 1)], k - 1, axis=1)[:, :k]
            d = rounded(first.ravel(), lo + np.repeat(np.arange(len(first)), k)).reshape(first.shape).max(1)
            reach = np.minimum(reach, np.where(np.isnan(d), np.inf, d))
        near = np.flatnonzero(~(product > bound.limit(at, reach, size, digits)[:, None]))
        for some in range(0, len(near), pairs):
            col, row = np.divmod(near[some : some + pairs], len(x))
            d = rounded(row, col + lo)
            fine = np.flatnonzero(~(d > reach[col]))
            if len(fine) > k * (col[-1] - col[0] + 1):  # many are equally far
                fine = fine[_top(col[fine], d[fine], place[row[fine]], k)[0]]
            yield col[fine] + lo, row[fine], d[fine]


def search(index: DataFrame, query: Column, k: int, metric: str | Distance = "hamming", vector: str = "code", id: str = "id") -> DataFrame:
    """The k rows of the index nearest to one query, all columns, with their distance; a top-k without a sort of the whole."""
    measure = METRICS[metric] if isinstance(metric, str) else metric
    return index.withColumn("distance", measure(F.col(vector), query)).orderBy("distance", id).limit(k)


def random_search(index: DataFrame, k: int, seed: int = 0, metric: str | Distance = "hamming", vector: str = "code", id: str = "id") -> DataFrame:
    """Neighbours of a row chosen by the seed."""
    chosen = index.orderBy(F.xxhash64(F.col(id), F.lit(seed)), id).limit(1).select(F.col(vector).alias("__q"))
    measure = METRICS[metric] if isinstance(metric, str) else metric
    return index.crossJoin(F.broadcast(chosen)).withColumn("distance", measure(F.col(vector), F.col("__q"))).drop("__q").orderBy("distance", id).limit(k)


def assert_code_size(index: DataFrame, words: int, code: str = "code") -> DataFrame:
    """Fails where a code has another size."""
    fine = F.size(code) == words
    return index.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit(f"a code has {words} words")).isNull()))


def index_rows(features: DataFrame, doc_id: str, ix: str, code: str, frequency: int, duration: int, extra: Column | None = None) -> DataFrame:
    """Entries (index_id, code, doc_id, start_ps, duration_ps, extra); the id is the key (document, start), so adding twice adds nothing."""
    start = (F.col(ix) * frequency).cast("long")
    return features.select(
        F.md5(F.concat_ws("|", F.col(doc_id).cast("string"), start.cast("string"))).alias("index_id"),
        F.col(code).alias("code"),
        F.col(doc_id).alias("doc_id"),
        start.alias("start_ps"),
        F.lit(duration).cast("long").alias("duration_ps"),
        (extra if extra is not None else F.lit(None).cast("map<string,string>")).alias("extra"),
    )


def add(index: DataFrame, entries: DataFrame) -> DataFrame:
    """The index with the entries that it lacks."""
    return index.unionByName(entries.dropDuplicates(["index_id"]).join(index.select("index_id"), "index_id", "left_anti"))
