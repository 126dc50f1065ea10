"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the session's spark.checkpoint.dir names; only where it names none (tests), in one of this machine's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="sigloom-")
        _OWN[app] = base
    return f"{base.rstrip('/')}/sigloom/{name}-{uuid.uuid4().hex}"
