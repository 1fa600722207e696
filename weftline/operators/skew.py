"""Equi joins with frequent keys: found in one pass of bounded memory, split by their counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from weftline.sources.shared import written

COUNTERS = 1_000  # of keys that a task holds; no key of more than rows / COUNTERS is missed


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Misra-Gries summary of a task's keys: COUNTERS at most, each at most rows / COUNTERS below its count."""
    held: dict = {}
    kind = None
    for batch in batches:
        keys = batch.column(0)
        kind = keys.type
        for item in pc.value_counts(keys):
            key = item["values"].as_py()
            held[key] = held.get(key, 0) + item["counts"].as_py()
        if len(held) > COUNTERS:
            least = sorted(held.values(), reverse=True)[COUNTERS]
            held = {k: n - least for k, n in held.items() if n > least}
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array(list(held.values()), pa.int64())], ["key", "n"])


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """key, n of the keys that may have ``share`` of the rows with a key or more (n at most rows / COUNTERS too low, never too high), few more than 1 / share of them.

    Reads the key alone. Null is no key. ``share`` is to be well above 1 / COUNTERS.
    """
    if share <= 1 / COUNTERS:
        raise ValueError(f"a share above {1 / COUNTERS} is needed")
    keys = df.select(F.col(key).alias("key")).where("key is not null")
    parts = keys.mapInArrow(_counted, StructType([*keys.schema.fields, StructField("n", LongType())])).groupBy("key").agg(F.sum("n").alias("n"))
    rows = keys.count()
    return parts.where(F.col("n") >= (share - 1 / COUNTERS) * rows)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", pieces: int | None = None) -> DataFrame:
    """left joined with right on ``key`` (``how``: inner or left), frequent keys dealt out over several tasks.

    A task's fair share is rows / ``pieces`` (by default the shuffle partitions). A key of
    more rows than that on the left is split into as many parts as it has shares, and
    right's rows of it are repeated for each; for inner joins right's frequent keys are
    split likewise. Other keys go as they are. Left's rows with a null key meet nothing and are not shuffled;
    columns other than the key have different names on the two sides. The rows of keys
    that are split are written first and dealt out by their place in these files, so
    that a task that is run again deals them out as before; the files stay in the shared folder.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    spark = left.sparkSession
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1 / pieces, 2 / COUNTERS)

    def parts(df: DataFrame) -> dict:
        found = heavy_keys(df, key, share).collect()  # below 1 / (share - 1 / COUNTERS) keys: at most COUNTERS
        fair = max(1, df.where(F.col(key).isNotNull()).count() * share) if found else 1
        return {r["key"]: math.ceil(r["n"] / fair) for r in found}

    ours, theirs = parts(left), parts(right) if how == "inner" else {}
    split = [(k, ours.get(k, 1), theirs.get(k, 1)) for k in {**ours, **theirs}]
    split = [x for x in split if x[1] * x[2] > 1]
    known = left.where(F.col(key).isNotNull())
    if not split:
        found = known.join(right, key, how)
    else:
        sizes = spark.createDataFrame(split, StructType([StructField("_heavy", left.schema[key].dataType), StructField("_l", IntegerType()), StructField("_r", IntegerType())]))  # a row for each frequent key

        def dealt(df: DataFrame, own: str, other: str, cut: bool) -> DataFrame:
            marked = df.join(F.broadcast(sizes), F.col(key) == F.col("_heavy"), "left").drop("_heavy")
            whole = marked.where(F.coalesce(own, F.lit(1)) == 1).withColumn(own, F.lit(0).cast("long"))
            if cut:
                rows = written(marked.where(F.col(own) > 1))
                whole = whole.unionByName(rows.withColumn(own, F.pmod(F.monotonically_increasing_id(), F.col(own))))
            return whole.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce(other, F.lit(1)) - 1).cast("long"))))

        found = dealt(known, "_l", "_r", any(x[1] > 1 for x in split)).join(dealt(right, "_r", "_l", any(x[2] > 1 for x in split)), [key, "_l", "_r"], how).drop("_l", "_r")
    if how == "left":
        more = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c != key]
        found = found.select(*left.columns, *[c for c in right.columns if c != key]).unionByName(left.where(F.col(key).isNull()).select("*", *more))
    return found
