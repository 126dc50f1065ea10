"""Reproducible samples: the order of a seeded hash stands in for randomness, so a rerun or a lost task changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(key: list[str], seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def reservoir(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """A uniform sample of n rows, or all: each task keeps its n first, no global sort."""
    return df.orderBy(order(key, seed), *key).limit(n)


def shuffled(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    return df.orderBy(order(key, seed), *key)


def quotas(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, quota: a share of n in proportion to each group, one at least."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select(*by, F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("size") / F.col("total"))).cast("long").alias("quota"))


def stratified(df: DataFrame, by: list[str], n: int, key: list[str], seed: int = 0) -> DataFrame:
    """About n rows, each group by its quota."""
    w = Window.partitionBy(*by).orderBy(order(key, seed), *key)
    ranked = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return ranked.join(quotas(df, by, n), by).where(F.col("__r") <= F.col("quota")).drop("__r", "quota")


def percent_full(df: DataFrame, n: int) -> DataFrame:
    return df.agg(F.least(F.lit(1.0), F.count(F.lit(1)) / n).alias("percent_full"))


def triplets(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """anchor, positive, negative: the next row of the same label and the next of another, in the order of the hash."""
    made = df.withColumn("__o", order([key], seed))
    same = Window.partitionBy(label).orderBy("__o", key)
    first = made.withColumn("positive", F.lead(key).over(same)).where("positive IS NOT NULL")
    heads = made.groupBy(label).agg(F.min_by(key, "__o").alias("head"))
    others = heads.select(F.col(label).alias("__l"), F.col("head"))
    pairs = first.join(others, F.col(label) != F.col("__l")).groupBy(F.col(key).alias("anchor"), "positive").agg(F.min("head").alias("negative"))
    return pairs.select("anchor", "positive", "negative")


def epochs(df: DataFrame, by: list[str], n: int, key: list[str], first: int = 0) -> Iterator[DataFrame]:
    """Stratified samples without end, each by its own seed."""
    seed = first
    while True:
        yield stratified(df, by, n, key, seed)
        seed += 1
