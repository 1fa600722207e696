"""The registered queries of the library and their SQL, and the tables as views for SQL of one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import analytics, flows, relational  # noqa: F401  (analytics and flows register theirs as they are loaded)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def queries() -> dict:
    return {**relational.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**relational.SQL}


def sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A Spark SQL statement over the tables of a folder, by their names."""
    for name in TABLES:
        relational.table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(statement)
