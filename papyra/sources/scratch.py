"""Intermediate tables that cut a lineage, in a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex


def working_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a local one if driver and executors are one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="papyra-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/papyra-work/{_RUN}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once, as a Parquet table: it survives lost executors."""
    path = working_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes the tables that this driver process has stored here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/papyra-work/{_RUN}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
