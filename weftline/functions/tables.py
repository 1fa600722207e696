"""Table functions over a TABLE argument: partitioned and ordered by the call, with state over a partition."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import SkipRestOfInputTableException, udtf
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class Visits:
    """The visits of a partition's rows in the order of time: its key, number, start, stop and rows of each; a pause of more than ``minutes`` ends a visit.

    The key's type and the time's are those of the table's first two columns. Rows
    without a time come last (see ``visits``) and end the partition's reading. A task holds one
    visit at a time, whatever its partition's size.
    """

    def __init__(self):
        self.key = self.start = self.stop = None
        self.rows = self.number = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, minutes: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or len(table.dataType.fields) < 2:
            raise ValueError("a table of a key and a time is needed")
        key, time = table.dataType.fields[:2]
        if not isinstance(time.dataType, (TimestampType, TimestampNTZType)):
            raise ValueError(f"{time.name} is no timestamp")
        if not minutes.isConstantExpression or minutes.value is None or minutes.value <= 0:
            raise ValueError("minutes is a number above 0")
        number = [StructField(c, LongType()) for c in ("number", "n")]
        return AnalyzeResult(StructType([StructField("key", key.dataType), number[0], StructField("start", time.dataType), StructField("stop", time.dataType), number[1]]))

    def eval(self, row, minutes: int) -> Iterator[tuple]:
        if row[1] is None:
            raise SkipRestOfInputTableException
        if self.rows and row[1] - self.stop > datetime.timedelta(minutes=minutes):
            yield self._visit()
            self.rows = 0
        if not self.rows:
            self.key, self.start = row[0], row[1]
            self.number += 1
        self.stop = row[1]
        self.rows += 1

    def _visit(self) -> tuple:
        return self.key, self.number, self.start, self.stop, self.rows

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield self._visit()


def visits(rows: DataFrame, key: str, time: str, minutes: int) -> DataFrame:
    """key, number (from 1), start, stop, n: the visits of each key. Rows without a time belong to none; null is a key of its own."""
    narrow = rows.select(key, time)
    return Visits(narrow.asTable().partitionBy(key).orderBy(F.col(time).asc_nulls_last()), F.lit(minutes))
