"""Joins of two streams by key and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed_by(first: DataFrame, then: DataFrame, key: str, time: str, within: str, late: str, how: str = "left_outer") -> DataFrame:
    """Rows of ``first`` with those of ``then`` of the same key that come 0 to ``within`` later, as columns a_* and b_*; nulls for those that nothing follows.

    Both sides are held until the watermark, ``late`` behind the latest time of the
    slower side, shows that no match can come any more: ``first``'s rows as long as
    ``within`` lasts, ``then``'s until no earlier row can come. Rows with a null key
    or time match nothing; those of ``first`` come out with nulls. What is behind the watermark of the batch before is dropped.
    For tables the result is that of the streams once all is read and nothing is held back.
    """
    a = first.select(*[F.col(c).alias(f"a_{c}") for c in first.columns]).withWatermark(f"a_{time}", late)
    b = then.select(*[F.col(c).alias(f"b_{c}") for c in then.columns]).withWatermark(f"b_{time}", late)
    near = F.col(f"b_{time}").between(F.col(f"a_{time}"), F.col(f"a_{time}") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(f"a_{key}") == F.col(f"b_{key}")) & near, how)
