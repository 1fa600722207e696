"""Files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new folder's name in spark.checkpoint.dir; only on a local master may that be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/weftline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from Parquet files in a new shared folder; lineage ends there."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved.written_at = path
    return saved


def remove(*saved: DataFrame) -> None:
    """Remove the files of ``written`` rows that nothing reads any more."""
    for df in saved:
        uri = df.written_at
        fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "/", 1))
        fs.delete_dir(path)
