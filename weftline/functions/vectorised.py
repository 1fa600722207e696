"""A scalar function and a table function in Python, on batches where Spark has them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


@pandas_udf(DoubleType())
def compound(price: pd.Series, rate: pd.Series, years: pd.Series) -> pd.Series:
    """price * (1 + rate) ** years; null where any of them is."""
    return price * (1 + rate) ** years


@udtf(returnType=StructType([StructField("number", IntegerType()), StructField("amount", DoubleType())]))
class Instalments:
    """A price in equal parts: a row for each. No rows for nulls, or without parts."""

    def eval(self, price: float, parts: int) -> Iterator[tuple[int, float]]:
        if price is not None and parts:
            for k in range(parts):
                yield k + 1, price / parts
