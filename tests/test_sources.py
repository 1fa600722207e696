import datetime
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from weftline.functions.tables import Visits, visits
from weftline.sources import blocks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def source(spark):
    spark.dataSource.register(blocks.Blocks)
    before = spark.conf.get(blocks.PUSHDOWN)
    spark.conf.set(blocks.PUSHDOWN, "true")
    yield
    spark.conf.set(blocks.PUSHDOWN, before)


def new():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"


def test_blocks_give_back_what_was_written(spark, source):
    path = new()
    df = spark.createDataFrame([(k, None if k % 3 else f"é{k}", [k, None], datetime.datetime(2024, 1, 1)) for k in range(100)], "k long, s string, a array<int>, t timestamp")
    write = lambda x: x.repartition(3).write.format("blocks").options(path=path, key="k", rows=7).mode("append").save()
    write(df)
    read = lambda: spark.read.format("blocks").options(path=path, key="k").load()
    assert rows(read()) == rows(df) and read().schema == df.schema
    write(df.limit(0))
    write(df.where("k < 5").withColumn("k", F.lit(None).cast("long")))
    assert read().count() == 105 and read().where("k is null").count() == 5 and read().where("k = 50").count() == 1


def test_filters_reach_the_index(spark, source):
    path = new()
    spark.range(1000).toDF("k").repartitionByRange(4, "k").sortWithinPartitions("k").write.format("blocks").options(path=path, key="k", rows=50).mode("append").save()
    reader = blocks.BlocksReader({"path": path, "key": "k"})
    pushed = [GreaterThan(("k",), 120), LessThanOrEqual(("k",), 130), EqualTo(("other",), 1)]
    assert list(reader.pushFilters(pushed)) == pushed
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column(0).to_pylist()]
    assert {121, 130} <= set(got) and len(got) <= 100  # two of twenty blocks
    assert rows(spark.read.format("blocks").options(path=path, key="k").load().where("k > 120 and k <= 123 or k = 7")) == [(121,), (122,), (123,), (7,)]


def test_not_a_number_is_above_all_numbers(spark, source):
    path, nan = new(), float("nan")
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, nan, None, 7.0, 8.0, nan, nan)], "k double").coalesce(1)
    df.write.format("blocks").options(path=path, key="k", rows=3).mode("append").save()
    for bound in ("k > 5", "k >= 8", "k < 3", "k = 'NaN'", "k in (2, double('NaN'))", "k is null"):
        assert repr(rows(spark.read.format("blocks").options(path=path, key="k").load().where(bound))) == repr(rows(df.where(bound))), bound


def test_a_failed_task_leaves_no_rows(spark, source):
    path = new()
    spark.range(10).write.format("blocks").options(path=path, key="id").mode("append").save()
    bad = spark.range(0, 1000, 1, 4).withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception):
        bad.write.format("blocks").options(path=path, key="id").mode("append").save()
    assert rows(spark.read.format("blocks").options(path=path).load()) == [(k,) for k in range(10)]


def test_streams_of_blocks(spark, source):
    path, out, state = new(), new(), new()
    write = lambda a, b: spark.range(a, b).write.format("blocks").options(path=path, key="id").mode("append").save()

    def follow():
        q = spark.readStream.format("blocks").options(path=path).load().writeStream.format("blocks").options(path=out, key="id", checkpointLocation=state).trigger(availableNow=True).start()
        q.awaitTermination(120)

    write(0, 10)
    write(10, 12)
    follow()
    write(20, 25)
    follow()
    follow()
    got = [r.id for r in spark.read.format("blocks").options(path=out).load().collect()]
    assert sorted(got) == [*range(12), *range(20, 25)]
    files = blocks._commits(out)
    tag = files[-1].partition("-")[2].removesuffix(".json")
    blocks._commit(out, ["data/none"], tag, None)  # a batch that is committed again
    assert blocks._commits(out) == files


def test_visits_against_brute_force(spark):
    start = datetime.datetime(2024, 1, 1)
    minutes = {"a": [0, 10, 41, 42, 200], "b": [5], None: [0, 31]}
    made = [(k, start + datetime.timedelta(minutes=m), 1) for k, ms in minutes.items() for m in ms] + [("a", None, 2), ("c", None, 3)]
    df = spark.createDataFrame(made, "user string, ts timestamp, x int").repartition(3)
    got = rows(visits(df, "user", "ts", 30).select("key", "number", F.minute("start") + 60 * F.hour("start"), F.minute("stop") + 60 * F.hour("stop"), "n"))
    assert got == sorted([("a", 1, 0, 10, 2), ("a", 2, 41, 42, 2), ("a", 3, 200, 200, 1), ("b", 1, 5, 5, 1), (None, 1, 0, 0, 1), (None, 2, 31, 31, 1)], key=repr)
    assert visits(df.limit(0), "user", "ts", 30).count() == 0
    assert visits(df.select(F.length("user").alias("n"), "ts"), "n", "ts", 30).schema["key"].dataType.simpleString() == "int"
    spark.udtf.register("visits", Visits)
    df.createOrReplaceTempView("seen")
    assert spark.sql("SELECT count(*) FROM visits(TABLE(SELECT user, ts FROM seen WHERE ts IS NOT NULL) PARTITION BY user ORDER BY (ts), 30)").first()[0] == 6
    for bad in ("visits(TABLE(SELECT user, x FROM seen) PARTITION BY user, 30)", "visits(TABLE(SELECT user, ts FROM seen) PARTITION BY user, 0)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {bad}").collect()
