"""JSON as VARIANT: parsed once, read by typed paths, arrays opened to rows, bad text told apart from none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, out: str = "parsed", bad: str = "bad") -> DataFrame:
    """``df`` with ``out``, the variant of a JSON text (null for null or bad text), and ``bad``, whether there is text that is no JSON."""
    found = df.withColumn(out, F.try_parse_json(column))
    return found.withColumn(bad, F.col(column).isNotNull() & F.col(out).isNull())


def shredded(column: Column, paths: dict[str, tuple[str, str]]) -> list[Column]:
    """A typed column for each name: its path in a variant and its type. Null where the path is absent, a JSON null, or of a value that the type can't hold."""
    return [F.try_variant_get(column, path, kind).alias(name) for name, (path, kind) in paths.items()]


def opened(df: DataFrame, column: Column, path: str, paths: dict[str, tuple[str, str]], *keep: str, at: str = "at") -> DataFrame:
    """``keep``, ``at`` (from 0) and the typed ``paths`` of each element of the array at ``path``; rows without such an array have none."""
    each = df.select(*keep, F.posexplode(F.try_variant_get(column, path, "array<variant>")).alias(at, "_element"))
    return each.select(*keep, at, *shredded(F.col("_element"), paths))
