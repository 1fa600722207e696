"""Mergeable sketches as stored aggregates: one state for each day and group, merged again over any range of days.

A state is bounded whatever the day's rows: distinct items by HyperLogLog (standard
error 1.04 / sqrt(2 ** LG_HLL), 1.6 %) and by a theta sketch (1 / sqrt(2 ** LG_THETA),
1.6 %), which intersects too, and quantiles by KLL (rank error about 1.65 % at K).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LG_HLL = 12
LG_THETA = 12
K = 200


def daily_states(rows: DataFrame, time: str, by: list[str], item: str, value: str) -> DataFrame:
    """day, by, n, hll, theta (of item), kll (of value): a row for each day and group. Null items, values and times count in none of the sketches; rows without a time have no day."""
    known = rows.where(F.col(time).isNotNull())
    return known.groupBy(F.to_date(time).alias("day"), *by).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(item, LG_HLL).alias("hll"),
        F.theta_sketch_agg(item, LG_THETA).alias("theta"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("kll"),
    )


def write_states(states: DataFrame, path: str) -> None:
    """Append states to a folder for each day; a day written twice is merged twice, which changes no distinct count but n and kll."""
    states.write.mode("append").partitionBy("day").parquet(path)


def read_states(spark: SparkSession, path: str, schema: StructType, first: str | None = None, last: str | None = None) -> DataFrame:
    """The states of the days from first to last; other days' folders are not read."""
    states = spark.read.schema(schema).parquet(path)
    if first is not None:
        states = states.where(F.col("day") >= F.lit(first).cast("date"))
    return states if last is None else states.where(F.col("day") <= F.lit(last).cast("date"))


def merged(states: DataFrame, *by: str) -> DataFrame:
    """by, n, hll, theta, kll: one state for each group, merged before the shuffle and after it."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta"), F.kll_merge_agg_double("kll").alias("kll"))


def estimated(states: DataFrame, *quantiles: float) -> DataFrame:
    """The columns of states that are no sketch, items and items_theta (estimated distinct items) and q0, q1, .. (values at the quantiles; null without values)."""
    plain = [c for c in states.columns if c not in ("hll", "theta", "kll")]
    some = F.kll_sketch_get_n_double("kll") > 0
    found = [F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(q))).alias(f"q{k}") for k, q in enumerate(quantiles)]
    return states.select(*plain, F.hll_sketch_estimate("hll").alias("items"), F.theta_sketch_estimate("theta").alias("items_theta"), *found)


def in_both(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """by, both: estimated items that two tables of states have in common, by group."""
    other = b.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("theta").alias("_theta"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, same).select(*by, F.theta_sketch_estimate(F.theta_intersection("theta", "_theta")).alias("both"))
