"""Folders that the driver and all executors share, and tables cut there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession, name: str = "landed") -> str:
    """A new folder under spark.checkpoint.dir. Where that is not set, only a session inside one
    process has a temporary one; elsewhere executors would write to disks of their own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        conf = _OWN[0]
    return f"{conf}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what is made of it neither computes nor
    plans it again, and lost executors cost no more than their own tasks."""
    path = folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
