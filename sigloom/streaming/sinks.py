"""Streams that drain, and indexes that follow a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..storage import new_folder


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, processed and returned as a table."""
    spark = df.sparkSession
    out, at = new_folder(spark, "stream"), new_folder(spark, "offsets")
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    else:
        query = df.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def follow(entries: DataFrame, path: str, checkpoint: str, key: str = "index_id", once: bool = True) -> StreamingQuery:
    """Keep the index at a path up to date with a stream of entries.

    A batch is written to a folder of its own number, so a batch that is run
    again replaces itself; entries whose key an earlier batch has are left out.
    Offsets are in the checkpoint, so a restart resumes where it was.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        stored = stored_before(batch.sparkSession, path, number)
        if stored is not None:
            fresh = fresh.join(stored.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = entries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_before(spark, path: str, number: int) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    from pyspark.sql import functions as F

    return spark.read.parquet(path).where(F.col("batch") < number)
