import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import ordered


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def parts(spark):
    """Many small parts, so that ties span several."""
    keep = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made(spark, n, seed=1):
    rng = random.Random(seed)
    at = [(rng.choice([None, 1, 1, 1, 1, 1, 2, 3]) if k % 3 else rng.randrange(100), k, rng.choice([None, rng.randrange(1000)]), rng.choice(["a", None, "b"])) for k in range(n)]
    return spark.createDataFrame(at, "x int, id int, v int, g string")


@pytest.mark.parametrize("n", [0, 1, 2, 200])
@pytest.mark.parametrize("up", [True, False])
def test_ranks_against_one_window(spark, parts, n, up):
    df = made(spark, n)
    w = Window.orderBy(F.col("x").asc() if up else F.col("x").desc())
    want = df.select("id", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.percent_rank().over(w).alias("share"), F.cume_dist().over(w).alias("upto"))
    got = ordered.ranked(df, {"x": up})
    assert rows(got.select("id", "rank", "dense", "share", "upto")) == rows(want)
    assert sorted(r.place for r in got.collect()) == list(range(1, n + 1))


@pytest.mark.parametrize("n", [0, 3, 200])
@pytest.mark.parametrize("tiles", [1, 7, 300])
def test_tiles_and_running_sums_against_one_window(spark, parts, n, tiles):
    df = made(spark, n, 2)
    w = Window.orderBy(F.col("x").desc(), "id")
    want = df.select("id", F.row_number().over(w), F.ntile(tiles).over(w), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    got = ordered.ranked(df, {"x": False, "id": True}, total="v", tiles=tiles)
    assert rows(got.select("id", "place", "tile", "running")) == rows(want)


def test_one_key_in_all_parts(spark, parts):
    df = spark.range(500).select(F.lit(1).alias("x"), "id")
    laid = ordered._laid_out(df, [], [F.col("x").asc()])
    assert laid.select("_part").distinct().count() > 5  # ties are split
    assert {(r["rank"], r.dense, r.share, r.upto) for r in ordered.ranked(df, {"x": True}).collect()} == {(1, 1, 0.0, 1.0)}


def test_numbers_within_groups(spark, parts):
    df = made(spark, 300, 3)
    got = ordered.numbered(df, ["g"], [F.col("id").asc()])
    w = Window.partitionBy("g").orderBy("id")
    want = df.select(*df.columns, (F.row_number().over(w) - 1).alias("place"), F.count("*").over(Window.partitionBy("g")).alias("many"))
    assert rows(got) == rows(want)
    assert rows(ordered.numbered(df, [], [F.col("id").desc()]).select("id", "place", "many")) == sorted(((k, 299 - k, 300) for k in range(300)), key=repr)


def test_one_task_sees_a_row_for_each_part_at_most(spark, parts):
    df = made(spark, 50)
    plan = ordered.ranked(df, {"x": True}, total="v", tiles=3)._jdf.queryExecution().executedPlan().toString().split("\n")
    for k, line in enumerate(plan):
        if "SinglePartition" in line:
            assert "HashAggregate(keys=[_part" in plan[k + 1] or "SortAggregate(key=[_part" in plan[k + 1], plan[k + 1]
