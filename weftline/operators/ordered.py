"""Windows over a whole table, or over groups of any size, without one task that sees all rows of a group.

Rows are dealt out by ranges of their order and sorted within each part. What a part
adds to the ones after it (rows, sums, the keys it begins and ends with) is one row
for each part and group; a prefix scan over these rows gives every part its start.
Rows that tie are split between parts too, by a number of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from weftline.sources.shared import remove, written

PART_BITS = 33  # monotonically_increasing_id has the partition above these bits


def _laid_out(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` in files by ranges of ``by`` and ``order``, with _part and _at, a row's number within its part.

    Rows are written before they are dealt out: their own numbers, which part ties, are
    then the same each time a lost task is run again.
    """
    saved = written(df)
    keys = [*map(F.col, by), *order, F.col("_own")]
    ranged = saved.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_own")
    found = ranged.withColumn("_id", F.monotonically_increasing_id())
    found = written(found.select(*df.columns, F.shiftright("_id", PART_BITS).cast("int").alias("_part"), F.col("_id").bitwiseAND((1 << PART_BITS) - 1).alias("_at")))
    remove(saved)
    return found


def numbered(df: DataFrame, by: list[str], order: list[Column], place: str = "place", many: str = "many") -> DataFrame:
    """``df`` with ``place``, each row's number (from 0) within its group ``by`` in the given order, and ``many``, the rows of that group.

    Nulls of ``by`` are a group; ties are numbered in some order. An empty list of
    ``by`` makes the table one group. An empty table gives no rows.
    """
    laid = _laid_out(df, by, order)
    parts = laid.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row for each part, not the table's rows
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], (before - F.col("_from")).alias("_shift"), F.sum("_n").over(group).alias("_many"))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return laid.join(starts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(place), F.col("_many").alias(many))


def ranked(df: DataFrame, order: dict[str, bool], total: str | None = None, tiles: int | None = None) -> DataFrame:
    """``df`` with place (row_number), rank, dense, share (percent_rank), upto (cume_dist), and, if asked for, tile (ntile) and running (a sum of ``total``), over the whole table.

    ``order`` maps columns to whether they ascend (nulls first, else last). ``running``
    adds the rows up to each one, in the order of place; rows that tie have the places
    between them in some order. Nulls of ``total`` add nothing. An empty table gives no rows.
    """
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in order.items()]
    laid = _laid_out(df, [], keys).withColumn("_key", F.struct(*order))
    added = [F.sum(total).alias("_sum")] if total else []
    ties = laid.groupBy("_part", "_key").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"), *added)  # one row for each key of a part
    parts = ties.groupBy("_part").agg(
        F.sum("_n").alias("_n"),
        F.count("*").alias("_keys"),
        F.min_by("_key", "_from").alias("_first"),
        F.max_by("_key", "_from").alias("_last"),
        F.max("_from").alias("_last_from"),
        F.min_by("_n", "_from").alias("_first_n"),
        *([F.sum("_sum").alias("_sum")] if total else []),
    )
    scan = Window.partitionBy(F.lit(0)).orderBy("_part")  # over one row for each part, as below
    earlier, later = scan.rowsBetween(Window.unboundedPreceding, -1), scan.rowsBetween(1, Window.unboundedFollowing)
    joined = F.lag("_last").over(scan).eqNullSafe(F.col("_first")) & F.lag("_part").over(scan).isNotNull()
    parts = parts.withColumn("_joined", joined).withColumn("_rows", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    parts = parts.withColumn("_dense", F.sum(F.col("_keys") - F.col("_joined").cast("int")).over(scan) - F.col("_keys"))
    parts = parts.withColumn("_opened", F.when(~F.col("_joined") | (F.col("_keys") > 1), F.col("_rows") + F.col("_last_from")))  # where the last key of a part began, if it began there
    parts = parts.withColumn("_carried", F.last("_opened", ignorenulls=True).over(earlier))
    parts = parts.withColumn("_closed", F.when(F.lead("_joined").over(scan).eqNullSafe(True) & (F.col("_keys") == 1), None).otherwise(F.col("_rows") + F.col("_first_n")))  # where the first key of a part ended, if it ended there
    parts = parts.withColumn("_ends", F.first("_closed", ignorenulls=True).over(later)).withColumn("_goes_on", F.lead("_joined").over(scan).eqNullSafe(True))
    parts = parts.withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(0))))
    if total:
        parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    within = Window.partitionBy("_part").orderBy("_at")
    rows = laid.withColumn("_start", F.min("_at").over(Window.partitionBy("_part", "_key"))).withColumn("_tied", F.count("*").over(Window.partitionBy("_part", "_key")))
    rows = rows.withColumn("_nth", F.dense_rank().over(Window.partitionBy("_part").orderBy("_start")))
    if total:
        rows = rows.withColumn("_upto", F.coalesce(F.sum(total).over(within.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    rows = rows.join(parts, "_part")
    first, last = rows["_start"] == 0, rows["_key"].eqNullSafe(rows["_last"])
    began = F.when(first & rows["_joined"], rows["_carried"]).otherwise(rows["_rows"] + rows["_start"])
    ended = F.when(last & rows["_goes_on"], rows["_ends"]).otherwise(rows["_rows"] + rows["_start"] + rows["_tied"])
    place, size = rows["_rows"] + rows["_at"], rows["_all"]
    made = {"place": place + 1, "rank": began + 1, "dense": rows["_dense"] + rows["_nth"], "share": F.when(size > 1, began / (size - 1)).otherwise(0.0), "upto": ended / size}
    if tiles:
        small, longer = F.floor(size / tiles), size % tiles  # the first ``longer`` tiles have one row more
        head = longer * (small + 1)
        made["tile"] = F.when(place < head, F.floor(place / (small + 1))).otherwise(longer + F.floor((place - head) / F.greatest(small, F.lit(1)))) + 1
    if total:
        made["running"] = rows["_before"] + rows["_upto"]
    return rows.select(*[rows[c] for c in df.columns], *[v.alias(k) for k, v in made.items()])


def counted_up_to(df: DataFrame, order: list[Column], kept: list[str], counted: dict[str, str]) -> DataFrame:
    """The columns ``kept`` with _place, each row's number (from 1) in the given order over the whole table, and for each of ``counted`` (a name, a boolean column) how many of its rows come up to this one.

    Rows are read once: they are counted within each part as they are written, and a
    part's start is added when they are read back. Rows that tie are in some order.
    """
    names = ["_place", *counted]
    flags = [F.lit(1).cast("byte").alias("_flag0"), *[F.col(c).cast("byte").alias(f"_flag{k}") for k, c in enumerate(counted.values(), 1)]]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept, *flags, F.spark_partition_id().alias("_part"))
    schema = StructType([ranged.schema[c] for c in kept]).add("_part", IntegerType())
    for c in names:
        schema = schema.add(c, LongType())

    def add(batches):
        before = [0] * len(names)
        for b in batches:
            if not b.num_rows:
                continue
            sums = [np.cumsum(b.column(f"_flag{k}").to_numpy(), dtype=np.int64) + n for k, n in enumerate(before)]
            before = [int(x[-1]) for x in sums]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*kept, "_part"]), *map(pa.array, sums)], [*kept, "_part", *names])

    laid = written(ranged.mapInArrow(add, schema))
    parts = laid.groupBy("_part").agg(*[F.max(c).alias(c) for c in names])  # one row for each part
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_start{c}") for c in names])
    joined = laid.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return joined.select(*kept, *[(F.col(c) + F.col(f"_start{c}")).alias(c) for c in names])
