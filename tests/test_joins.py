import datetime
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from weftline.operators import skew
from weftline.operators.interval import _covered, _points, in_bands, overlap_counts, overlap_summary, overlapping, within


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bands_of_any_width(spark):
    rng = random.Random(5)
    inf = math.inf
    points = [(k, rng.choice([None, math.nan, rng.uniform(-5, 50), 10 ** rng.uniform(-3, 9)])) for k in range(200)] + [(900, 10.0), (901, 20.0), (902, 0.0), (903, -inf), (904, inf)]
    bands = [(k, a, a + rng.choice([rng.uniform(-1, 12), 10 ** rng.uniform(-9, 9)])) for k, a in enumerate(rng.uniform(-5, 40) for _ in range(60))]
    bands += [(100, 10.0, 20.0), (101, None, 3.0), (102, 7.0, 7.0), (103, 0.0, 1e9), (104, -inf, 5.0), (105, 5.0, inf), (106, -inf, inf), (107, math.nan, 3.0), (108, 1.0, math.nan)]
    p, b = spark.createDataFrame(points, "p int, v double"), spark.createDataFrame(bands, "b int, lo double, hi double")
    want = sorted((i, j) for i, v in points for j, lo, hi in bands if None not in (v, lo, hi) and not math.isnan(lo + hi if abs(lo + hi) != inf and lo != -inf else 0) and lo <= v < hi)
    assert sorted(tuple(x) for x in in_bands(p, "v", b, "lo", "hi").select("p", "b").collect()) == want
    assert in_bands(p.limit(0), "v", b, "lo", "hi").count() == 0 and in_bands(p, "v", b.limit(0), "lo", "hi").count() == 0


def test_wide_intervals_cover_few_cells(spark):
    wide = spark.createDataFrame([(0, 10**9), (5, 6), (-(10**15), 10**15), (3, 10**9 + 7)], "lo long, hi long")
    cells = _covered(wide, "lo", "hi")
    assert max(r["count"] for r in cells.groupBy("lo").count().collect()) <= 18
    levels = [r["_level"] for r in cells.select("_level").distinct().collect()]
    assert _points(spark.range(10).toDF("x"), "x", levels).count() == 10 * len(levels) == 30


@pytest.mark.parametrize("kind", ["long", "double", "timestamp", "date"])
def test_overlaps_against_brute_force(spark, kind):
    rng = random.Random(kind)
    start = datetime.datetime(2024, 1, 1)

    def at(x):
        return {"long": x, "double": x / 3, "timestamp": start + datetime.timedelta(minutes=x), "date": datetime.date(2024, 1, 1) + datetime.timedelta(x)}[kind] if x is not None else None

    def side(n):
        made = [(k, rng.choice([1, 1, 1, 2, None]), rng.randrange(-300, 300), rng.choice([None, 0, 1, 3, 50, 400])) for k in range(n)]
        return [(k, g, at(a), at(a + w) if w is not None else None) for k, g, a, w in made] + [(n, 1, at(None), at(3)), (n + 1, 1, at(5), at(-5)), (n + 2, 1, at(7), at(8)), (n + 2, 1, at(7), at(8))]

    left, right = side(60), side(40)
    l, r = (spark.createDataFrame(x, f"k int, g int, a {kind}, b {kind}") for x in (left, right))
    hit = lambda x, y: None not in (*x[2:], *y[2:]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    want = sorted((x[0], y[0]) for x in left for y in right if hit(x, y))
    assert len(want) > 100 and sorted(tuple(x) for x in overlapping(l, r, "a", "b").select("l_k", "r_k").collect()) == want
    want = sorted((x[0], y[0]) for x in left for y in right if hit(x, y) and x[1] is not None and x[1] == y[1])
    assert want and sorted(tuple(x) for x in overlapping(l, r, "a", "b", "g").select("l_k", "r_k").collect()) == want


@pytest.fixture
def parts(spark):
    """Many small parts, so that intervals span several."""
    keep = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def spans_of(rng, n, nan):
    ends = lambda: rng.choice([None, nan, -0.0, 0.0, *(rng.randrange(-20, 20) / 2 for _ in range(40))])
    made = [(rng.choice([None, *range(n)]), rng.choice(["a", "a", "b", None]), ends(), rng.choice([None, nan, 0.0, 0.5, 3.0, 3.0, 17.0])) for _ in range(n)]
    return [(k, g, a, a + w if None not in (a, w) else w) for k, g, a, w in made] + [(1, "a", 3.0, 5.0), (1, "a", 3.0, 5.0), (2, "a", 0.0, 100.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_summaries_of_overlaps_against_pairs(spark, parts, seed):
    left, right = (spark.createDataFrame(spans_of(random.Random(seed + 10 * n), n, math.nan), "k int, g string, a double, b double") for n in (60, 90))
    numbers = lambda df: df.where("not isnan(a) and not isnan(b)")  # the others overlap nothing
    pairs = overlapping(numbers(left), numbers(right), "a", "b").groupBy("l_k").agg(F.count("*"), F.min("r_k"))
    want = rows(pairs)
    assert len(want) > 20 and rows(overlap_summary(left, right, "a", "b", "k", "k")) == want
    assert overlap_summary(left, right.limit(0), "a", "b", "k", "k").count() == 0 and overlap_summary(left.limit(0), right, "a", "b", "k", "k").count() == 0
    pairs = overlapping(numbers(right), numbers(right), "a", "b", "g").groupBy("l_k").agg(F.count("*"))
    assert rows(overlap_counts(right, "a", "b", "k", "g").select("k", "n")) == rows(pairs)


def test_many_overlaps_make_no_pairs(spark):
    """Forty thousand intervals that all overlap: 1.6 billion pairs."""
    df = spark.range(40_000).select("id", F.lit(1).alias("g"), F.col("id").alias("a"), (F.col("id") + 100_000).alias("b"))
    assert overlap_counts(df, "a", "b", "id", "g").where("n <> 40000 or rows <> 1").count() == 0
    got = overlap_summary(df, df.withColumn("id", -F.col("id")), "a", "b", "id", "id")
    assert got.where("n <> 40000 or least <> -39999").count() == 0 and got.count() == 40_000


def test_an_order_in_several_rows_is_no_other_of_itself(spark):
    from weftline.plans.analytics import orders_open_together

    t = datetime.datetime(2024, 1, 1)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    made = [(59, 1, t), (59, 1, t), (59, 2, t), (119, 1, t), (60, 1, t), (179, 2, t), (None, 1, t), (239, None, t), (299, 3, t), (299, 3, t)]
    spark.createDataFrame(made, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    assert rows(orders_open_together(spark, folder)) == [(119, 3), (179, 1), (59, 5), (60, 3)]


def test_within_no_time_at_all(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, 1), (1, t, 2), (1, t + datetime.timedelta(microseconds=1), 3)], "k int, t timestamp, id int")
    assert sorted(map(tuple, within(df, df, "k", "t", 0).select("l_id", "r_id").collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_heavy_keys_are_found(spark, monkeypatch):
    monkeypatch.setattr(skew, "COUNTERS", 20)
    rng = random.Random(1)
    keys = ["hot"] * 3000 + ["warm"] * 1000 + [f"k{rng.randrange(3000)}" for _ in range(6000)] + [None] * 500
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    found = {r["key"]: r["n"] for r in skew.heavy_keys(df, "k", 0.08).collect()}
    assert {"hot", "warm"} <= set(found) and len(found) < 1 / (0.08 - 0.05)
    assert 2500 <= found["hot"] <= 3000 and 500 <= found["warm"] <= 1000
    assert skew.heavy_keys(df.limit(0), "k", 0.1).count() == 0
    with pytest.raises(ValueError):
        skew.heavy_keys(df, "k", 0.01)


def table(spark, n, hot, name):
    key = F.when(F.col("id") % 10 < hot, F.lit(7)).when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.col("id") % 50)
    return spark.range(n).select(key.cast("int").alias("k"), F.col("id").alias(name))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_gives_the_rows_of_a_join(spark, how):
    left, right = table(spark, 4000, 9, "a"), table(spark, 200, 3, "b").where("k is null or k % 3 < 2")
    got = skew.skew_join(left, right, "k", how, 16)
    assert rows(got.select("k", "a", "b")) == rows(left.join(right, "k", how).select("k", "a", "b"))
    assert skew.skew_join(left.limit(0), right, "k", how).count() == 0
    assert skew.skew_join(left, right.limit(0), "k", how).count() == (4000 if how == "left" else 0)
    spread = table(spark, 300, 0, "a")
    assert rows(skew.skew_join(spread, right, "k", how, 4).select("k", "a", "b")) == rows(spread.join(right, "k", how).select("k", "a", "b"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_of_frequent_keys_are_read_from_files(spark, how):
    """So that a task that is run again deals them out as before, whatever order its input then has."""
    left, right = table(spark, 2000, 9, "a").repartition(3), table(spark, 60, 3, "b").repartition(3)
    left = left.select("k", F.lit(1).alias("a")).unionByName(left)  # equal rows too
    got = skew.skew_join(left, right, "k", how, 16)
    assert any("weftline-" in f for f in got.inputFiles())
    assert rows(got.select("k", "a", "b")) == rows(left.join(right, "k", how).select("k", "a", "b"))
    spread = skew.skew_join(left.where("k <> 7"), right.where("k <> 7"), "k", how, 2)
    assert not spread.inputFiles()


def test_no_task_gets_much_more_than_the_others(spark):
    keep = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        left, right = table(spark, 100_000, 9, "a"), spark.range(50).select(F.col("id").cast("int").alias("k"), F.col("id").alias("b"))  # one key has 90 % of the rows
        sizes = lambda df: sorted((r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()), reverse=True)
        plain, dealt = sizes(left.join(right, "k", "left")), sizes(skew.skew_join(left, right, "k", "left", 256))
        assert plain[0] >= 90_000 and dealt[0] < 3 * sum(dealt) / 32, dealt[:5]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
