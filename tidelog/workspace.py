"""Folders of their own for what a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; only a local
    session without it (a test) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # without a scheme, it's in the default file system
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path. It stays until the shared folder is cleared, as results are read from it lazily."""
    return f"{shared_root(spark)}/tidelog/{label}-{uuid.uuid4().hex[:12]}"
