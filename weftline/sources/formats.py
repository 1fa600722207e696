"""Files of tables: sinks that write them and readers with a known schema.

Readers are given the schema, so that no file is read to guess it. Text formats keep
nulls apart from empty strings, and what they write is read back as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CSV = {"header": True, "nullValue": "\\N", "escape": '"', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "multiLine": True}
JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet in a folder for each value of ``by``. Rows are rebalanced by them first, so that each folder gets few files and a frequent value several."""
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV, emptyValue='""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV, emptyValue="").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.options(**JSON).option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**JSON).json(path)


def write_orc(df: DataFrame, path: str) -> None:
    df.write.orc(path)


def read_orc(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).orc(path)
