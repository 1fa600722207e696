"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one is made, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, on storage all executors share.

    The shuffles behind ``df`` are removed once it is written. ``done``: earlier
    checkpoints that nothing needs any more; their files go.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    free(*done)
    saved = spark.read.schema(df.schema).parquet(path)
    saved.checkpointed_at = path
    for made in _scopes:
        made.append(saved)
    return saved


_scopes: list[list[DataFrame]] = []


@contextmanager
def only_kept() -> Iterator[list[DataFrame]]:
    """Removes the checkpoints made within at the end, but those that are in the list it gives."""
    made, kept = [], []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.remove(made)
        stay = {df.checkpointed_at for df in kept}
        free(*[df for df in made if df.checkpointed_at not in stay])


def free(*done: DataFrame) -> None:
    """Remove the files of checkpoints; those that are gone already are left out."""
    for old in done:
        fs, path = file_system(old.checkpointed_at)
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI that pyarrow knows (local, hdfs, s3, gs), and the path within it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "/", 1))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/weftline-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))
