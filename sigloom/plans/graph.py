"""Feature graphs: named columns or tables of a document, each made from others.

A feature is a function of DataFrames to a DataFrame.  Nothing runs until a
feature is asked for; stored features are written once, under a key of name and
version, and read back afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Feature:
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    store: bool = False
    version: str = ""


@dataclass
class Graph:
    features: dict[str, Feature] = field(default_factory=dict)

    def add(self, name: str, make: Callable[..., DataFrame], needs: tuple[str, ...] | str = (), store: bool = False, version: str = "") -> Graph:
        needs = (needs,) if isinstance(needs, str) else tuple(needs)
        missing = [n for n in needs if n not in self.features]
        if missing:
            raise ValueError(f"{name} needs {missing}, which are not there")
        self.features[name] = Feature(make, needs, store, version)
        return self

    def key(self, name: str) -> str:
        """Name and a digest of the versions that it depends on."""
        f = self.features[name]
        return f"{name}-{hashlib.md5('|'.join([name, f.version, *map(self.key, f.needs)]).encode()).hexdigest()[:12]}"

    def roots(self) -> list[str]:
        return [n for n, f in self.features.items() if not f.needs]

    def compute(self, spark: SparkSession, name: str, source: DataFrame, path: str | None = None, _made: dict | None = None) -> DataFrame:
        """A feature of the documents in ``source``, which the roots take."""
        made = {} if _made is None else _made
        if name not in made:
            f = self.features[name]
            at = f"{path}/{self.key(name)}" if path and f.store else None
            if at and _exists(spark, at):
                made[name] = spark.read.parquet(at)
            else:
                inputs = [self.compute(spark, n, source, path, made) for n in f.needs] or [source]
                made[name] = f.make(*inputs)
                if at:
                    made[name].write.parquet(at)
                    made[name] = spark.read.parquet(at)
        return made[name]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
