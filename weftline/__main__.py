"""python -m weftline FOLDER QUERY [OUT]: run a registered query, or a SQL statement, over the tables of a folder; show it, or write it as Parquet."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from weftline import catalog


def main(folder: str, query: str, out: str | None = None) -> None:
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    found = catalog.queries().get(query)
    rows = found(spark, folder) if found else catalog.sql(spark, folder, query)
    if out:
        rows.write.parquet(out)
    else:
        rows.show(truncate=False)


if __name__ == "__main__":
    if not 3 <= len(sys.argv) <= 4:
        sys.exit(__doc__)
    main(*sys.argv[1:])
