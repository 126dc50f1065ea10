"""Every operator as a query over the supplied tables, with its SQL.

A query takes (spark, directory) and reads whole tables; its SQL is what DuckDB
runs on the same tables for the same rows.  Both round to six decimals and add
0.0, which removes negative zeros.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(x: Column, name: str) -> Column:
    return (F.round(x, 6) + 0.0).alias(name)


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as frames: vec_id, v, label."""
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def series(spark: SparkSession, d: str) -> DataFrame:
    """Events as one constant-rate series a user: user_id, ix, value."""
    from .operators.framing import ordinal

    return ordinal(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "ix", "value")


def variable(spark: SparkSession, d: str) -> DataFrame:
    """Events as a variable-rate series: user_id, start_ps (since 2024), duration_ps (to the next event; the last has none), value."""
    from pyspark.sql import Window

    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) * F.lit(1000000)
    w = Window.partitionBy("user_id").orderBy("start_ps", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", "value", at.alias("start_ps")).withColumn("duration_ps", F.lead("start_ps").over(w) - F.col("start_ps"))


#: The same views in DuckDB.
FRAMES = "frames AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
SERIES = "series AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix, value FROM events)"
VARIABLE = """variable AS (SELECT user_id, event_id, value, start_ps, lead(start_ps) OVER (PARTITION BY user_id ORDER BY start_ps, event_id) - start_ps AS duration_ps
  FROM (SELECT user_id, event_id, value, (epoch_us(ts) - 1704067200000000) * 1000000 AS start_ps FROM events))"""


def load() -> None:
    """Register all queries."""
    from . import queries_core, queries_spectral, queries_streaming, queries_tables  # noqa: F401
