"""Metadata, links and archives: what surrounds the signals."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import new_only

CORE = ("uri", "samplerate", "channels", "licensing", "description", "tags")


def metadata(df: DataFrame, uri: str, **columns: Column) -> DataFrame:
    """df with ``meta``: the six core fields (null where they aren't given) and a map of all others; a row without a URI fails."""
    types = {"samplerate": "int", "channels": "int", "tags": "array<string>"}
    core = {c: columns.pop(c).cast(types.get(c, "string")) if c in columns else F.lit(None).cast(types.get(c, "string")) for c in CORE if c != "uri"}
    checked = F.when(F.col(uri).isNull(), F.raise_error(F.lit("metadata needs a URI"))).otherwise(F.col(uri))
    extra = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))]) if columns else F.lit(None).cast("map<string,string>")
    return df.withColumn("meta", F.struct(checked.alias("uri"), *[v.alias(k) for k, v in core.items()], extra.alias("extra")))


def encoded(meta: Column) -> Column:
    return F.to_json(meta)


def links(pages: DataFrame, pattern: str = r'href="([^"]+)"', html: str = "html") -> DataFrame:
    """All other columns of pages, with position and url of every link."""
    rest = [c for c in pages.columns if c not in (html, "url")]
    return pages.select(*rest, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("position", "url"))


def predownload(df: DataFrame, url: str, content: str) -> DataFrame:
    """df with struct ``download``; a missing URL fails."""
    checked = F.when(F.col(url).isNull(), F.raise_error(F.lit("a download needs a URL"))).otherwise(F.col(url))
    return df.withColumn("download", F.struct(checked.alias("url"), F.col(content).alias("content")))


def cache_key(url: Column) -> Column:
    return F.md5(url)


def composite(*parts: DataFrame) -> DataFrame:
    """Datasets one after another, columns that some lack null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def looked_up(audio: DataFrame, csv: DataFrame, key: str) -> DataFrame:
    """Files with their rows of a metadata table; Spark broadcasts the table if its size allows."""
    return audio.join(csv, key)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def archive(binary: DataFrame) -> DataFrame:
    """stem, meta (JSON), name, content of each .wav member of tar archives, joined to the JSON entry of the same stem; an archive is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                notes, sounds = {}, []
                with tarfile.open(fileobj=io.BytesIO(bytes(content))) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(".json"):
                            notes |= json.load(tar.extractfile(m))
                        elif m.isfile() and m.name.endswith(".wav"):
                            stem = m.name.rsplit("/", 1)[-1][:-4]
                            sounds.append((stem, m.name, tar.extractfile(m).read()))
                rows = [(stem, json.dumps(notes.get(stem), sort_keys=True) if stem in notes else None, name, data) for stem, name, data in sounds]
                if rows:
                    yield pd.DataFrame(rows, columns=["stem", "meta", "name", "content"])

    return binary.select("content").mapInPandas(run, "stem string, meta string, name string, content binary")


def ingest(items: DataFrame, path: str, key: str, skip_existing: bool = True) -> DataFrame:
    """Append the items to the table at a path, those whose key is there left out; what was written."""
    spark = items.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    fresh = new_only(items, spark.read.parquet(path), key) if skip_existing and exists else items
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def range_request(header: Column) -> Column:
    """struct<unit, start, stop> of ``bytes=a-b`` or ``seconds=a-b``; other units fail, what isn't a range is null (the whole)."""
    unit = F.regexp_extract(header, r"^(\w+)=", 1)
    start, stop = (F.regexp_extract(header, r"^\w+=([\d.]+)-([\d.]*)$", i) for i in (1, 2))
    number = lambda x: F.when(x != "", x.cast("double"))
    known = F.when(~unit.isin("", "bytes", "seconds"), F.raise_error(F.lit("unsupported range unit"))).otherwise(unit)
    return F.when(known.isin("bytes", "seconds") & (start != ""), F.struct(known.alias("unit"), number(start).alias("start"), number(stop).alias("stop")))
