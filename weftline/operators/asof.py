"""As-of join: each left row with the last right row at or before its time, by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str, bucket=None) -> DataFrame:
    """Left's rows with ``out``: right's ``value`` at the latest ``time`` up to the row's own (the greatest value on ties); null if there is none.

    The right rows are laid between the left ones in time order within buckets of
    time, and the last seen value is carried on; a bucket begins with the last value
    of the key's earlier buckets. So a key of very many rows is sorted in parts.
    ``bucket`` turns a time column into an ascending bucket (by default days for
    timestamps, one bucket else). Rows with a null key or time find nothing and
    are not shuffled by it. An empty side gives no rows, or no values.
    """
    if bucket is None:
        stamped = isinstance(left.schema[time].dataType, (TimestampType, TimestampNTZType))
        bucket = (lambda t: F.date_trunc("day", t)) if stamped else (lambda t: F.lit(0))
    columns = left.columns
    found_type = right.schema[value].dataType

    def keyed(df: DataFrame, side: int, v: Column, row: Column) -> DataFrame:
        return df.select(F.col(key).alias("_k"), F.col(time).alias("_t"), bucket(F.col(time)).alias("_b"), F.lit(side).alias("_side"), v.alias("_v"), row.alias("_row"))

    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    row = F.struct(*columns)
    ours = keyed(left.where(known), 1, F.lit(None).cast(found_type), row)
    theirs = right.where(known).groupBy(key, time).agg(F.max(value).alias(value))
    last = theirs.groupBy(F.col(key).alias("_k"), bucket(F.col(time)).alias("_b")).agg(F.max_by(value, time).alias("_last"))
    marks = last.unionByName(ours.select("_k", "_b", F.lit(None).cast(found_type).alias("_last")).distinct()).groupBy("_k", "_b").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("_k", "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    theirs = keyed(theirs, 0, F.col(value), F.lit(None).cast(ours.schema["_row"].dataType))
    upto = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = ours.unionByName(theirs).withColumn("_seen", F.last("_v", ignorenulls=True).over(upto)).where("_side = 1")
    found = both.join(carried, ["_k", "_b"]).select("_row.*", F.coalesce("_seen", "_carried").alias(out))
    return found.unionByName(left.where(~known).select(*columns, F.lit(None).cast(found_type).alias(out)))
