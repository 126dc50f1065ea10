"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least(ids: DataFrame, n: int) -> DataFrame:
    """The n rows of ids(doc_id, ...) whose md5 of the id is least, few enough to be broadcast; null ids are left out."""
    order = F.md5(F.col("doc_id").cast("string"))
    rows = ids.where("doc_id IS NOT NULL").withColumn("__order", order).orderBy("__order", *[c for c in ids.columns]).limit(n).drop("__order").collect()
    return ids.sparkSession.createDataFrame(rows, ids.schema)


def chosen(labels: DataFrame, label: str, n: int, where: Column | None = None) -> DataFrame:
    """doc_id and label (0 or 1) of at most n labelled ids.  An id that is labelled twice counts by its greatest label."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return least(known if where is None else known.where(where), n)


def labelled(docs: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """doc_id, text, label of at most n labelled documents; of an id with several texts that with the least hash is taken."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    mine = texts.join(F.broadcast(chosen(labels, label, n)), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    return mine.select("doc_id", F.col("r.text").alias("text"), "label")
