import math
import sys
import tempfile
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weftline import catalog
from weftline.operators.asof import asof_join
from weftline.streaming.windows import event_stream, tumbling_counts



@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame):
    def one(v):
        if pd.isna(v):
            return None
        return round(float(v), 4) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", catalog.queries())
def test_same_as_sql(spark, sf, duck, name):
    got, want = plain(catalog.queries()[name](spark, sf).toPandas()), plain(duck.execute(catalog.oracle_sql()[name]).df())
    assert len(got) == len(want) and want
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 0, "b"), (None, 5, "c"), (2, None, "d")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, 6, "z"), (None, 1, "n"), (2, 1, "m")], "k int, t int, v string")
    assert sorted(tuple(r)[2:] for r in asof_join(left, right, "k", "t", "v", "found").collect()) == [("a", "y"), ("b", None), ("c", None), ("d", None)]


def test_stream_gives_the_table_counts(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events.repartition(4).write.mode("append").parquet(folder)
    q = tumbling_counts(event_stream(spark, folder, events.schema)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = tumbling_counts(events.withColumn("ts", events.ts.cast("timestamp")))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sql_over_the_tables(spark, sf, capsys, tmp_path):
    from weftline.__main__ import main

    assert catalog.sql(spark, sf, "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name").count() == 5
    main(sf, "top_orders")
    main(sf, "SELECT max(o_orderkey) AS k FROM orders", str(tmp_path / "out"))
    assert "o_totalprice" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "out")).columns == ["k"]
