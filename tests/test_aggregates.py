import datetime
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from weftline.functions import aggregates, variant
from weftline.operators import sketches
from weftline.streaming.upsert import Table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def visits(spark, n):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    at = [(start + datetime.timedelta(hours=rng.randrange(240)) if k % 50 else None, rng.choice(["a", "b", None]), rng.choice([None, "hot"]) if k % 3 == 0 else f"u{rng.randrange(3000)}", rng.choice([None, float(rng.randrange(1000))])) for k in range(n)]
    return spark.createDataFrame(at, "ts timestamp, kind string, user string, v double")


def test_sketches_merged_over_ranges_of_days(spark):
    df, path = visits(spark, 12_000), tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/s"
    states = sketches.daily_states(df, "ts", ["kind"], "user", "v")
    sketches.write_states(states, path)
    for first, last in (("2024-01-01", "2024-01-10"), ("2024-01-03", "2024-01-05"), (None, None)):
        stored = sketches.read_states(spark, path, states.schema, first, last)
        got = {r.kind: r for r in sketches.estimated(sketches.merged(stored, "kind"), 0.1, 0.5, 0.9).collect()}
        inside = df.where("ts is not null").where(f"to_date(ts) between '{first}' and '{last}'" if first else "true")
        want = {r.kind: r for r in inside.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"), F.sort_array(F.collect_list("v")).alias("v")).collect()}
        assert set(got) == set(want) == {"a", "b", None}
        for kind, w in want.items():
            g = got[kind]
            assert g.n == w.n and abs(g["items"] / w.users - 1) < 0.06 and abs(g.items_theta / w.users - 1) < 0.06
            for q, v in ((0.1, g.q0), (0.5, g.q1), (0.9, g.q2)):
                assert sum(x < v for x in w.v) / len(w.v) - 0.05 <= q <= sum(x <= v for x in w.v) / len(w.v) + 0.05
    plan = sketches.read_states(spark, path, states.schema, "2024-01-03", "2024-01-05")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert sketches.merged(sketches.daily_states(df.limit(0), "ts", ["kind"], "user", "v"), "kind").count() == 0


def test_items_of_two_ranges_in_common(spark):
    df = visits(spark, 12_000)
    states = sketches.daily_states(df, "ts", ["kind"], "user", "v")
    early, late = (sketches.merged(states.where(f"day {x} '2024-01-05'"), "kind") for x in ("<=", ">"))
    got = {r.kind: r.both for r in sketches.in_both(early, late, "kind").collect()}
    users = lambda x: df.where(f"to_date(ts) {x} '2024-01-05' and user is not null").select("kind", "user").distinct()
    want = {r.kind: r.n for r in users("<=").intersect(users(">")).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(got) == set(want) and all(abs(got[k] / n - 1) < 0.12 for k, n in want.items())


def test_aggregates_shuffle_a_state_for_each_group_and_task(spark):
    df = spark.range(40_000, numPartitions=5).select((F.col("id") % 10 < 9).cast("int").alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 100).alias("v"), (F.col("id") % 3).alias("w"))
    agg = aggregates.weighted_mean("v", "w")
    assert aggregates.partial_states(df, ["g"], ["v", "w"], agg).count() <= 2 * 5
    got = {r.g: r.m for r in aggregates.aggregated(df, ["g"], ["v", "w"], agg, "m").collect()}
    want = {r.g: r.m for r in df.where("v is not null").groupBy("g").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m")).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want)


def test_aggregates_of_nulls_and_many_groups(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, 1.0), (1, 2.0, None), (2, 4.0, 0.0), (None, 8.0, 2.0), (None, 2.0, 1.0), (3, -1.0, 1.0)], "g int, v double, w double")
    assert rows(aggregates.aggregated(df, ["g"], ["v", "w"], aggregates.weighted_mean("v", "w"), "m")) == sorted([(1, None), (2, None), (None, 6.0), (3, -1.0)], key=repr)
    got = dict(rows(aggregates.aggregated(df, ["g"], ["v"], aggregates.geometric_mean("v"), "m")))
    assert math.isclose(got[None], 4.0) and math.isclose(got[1], 2.0) and got[3] is None
    assert aggregates.aggregated(df.limit(0), ["g"], ["v"], aggregates.geometric_mean("v"), "m").count() == 0
    many = spark.range(5000).select((F.col("id") % 1700).alias("g"), F.lit(2.0).alias("v"))
    monkeypatch.setattr(aggregates, "HELD_GROUPS", 100)
    found = aggregates.aggregated(many, ["g"], ["v"], aggregates.geometric_mean("v"), "m").collect()
    assert len(found) == 1700 and all(math.isclose(r.m, 2.0) for r in found)


def test_variants(spark):
    text = ['{"id": 1, "at": {"x": 2.5, "tags": ["a", null, 3]}, "lines": [{"n": 1}, {"n": "two"}, {"m": 3}, null]}', '{"id": "7", "lines": []}', '{"id": 1.5, "lines": {"n": 1}}', "[1, 2]", "null", "{broken", "", None, '{"id": 99999999999999999999}']
    df = variant.parsed(spark.createDataFrame([(k, t) for k, t in enumerate(text)], "k int, t string"), "t")
    assert [r.k for r in df.where("bad").orderBy("k").collect()] == [5, 6]
    got = rows(df.select("k", *variant.shredded(F.col("parsed"), {"id": ("$.id", "long"), "x": ("$.at.x", "double"), "tag": ("$.at.tags[0]", "string"), "none": ("$.at.tags[1]", "string")})))
    assert got[0] == (0, 1, 2.5, "a", None) and got[1][1] == 7 and got[2][1] in (1, None) and [r[1:] for r in got[3:]] == [(None,) * 4] * 6
    lines = variant.opened(df, F.col("parsed"), "$.lines", {"n": ("$.n", "long")}, "k")
    assert rows(lines) == [(0, 0, 1), (0, 1, None), (0, 2, None), (0, 3, None)]


CHANGES = "k int, version int, v string, gone boolean"


def upserts(spark, buckets=4):
    schema = spark.createDataFrame([], CHANGES).drop("gone").schema
    return Table(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t", schema, "k", "version", buckets)


def test_upserts_by_key_and_version(spark):
    t = upserts(spark)
    assert t.read().count() == 0
    batch = lambda *r: spark.createDataFrame(list(r), CHANGES)
    t.merge(batch((1, 1, "a", False), (2, 1, "b", False), (3, 1, "c", None), (None, 1, "x", False), (4, None, "y", False)), 0, "gone")
    t.merge(batch((1, 3, "a3", False), (2, 2, None, True), (5, 1, "e", False)), 1, "gone")
    t.merge(batch((1, 2, "late", False), (2, 1, "late", False), (3, 1, "d", False)), 2, "gone")
    want = [(1, 3, "a3"), (3, 1, "d"), (5, 1, "e")]
    assert rows(t.read()) == want
    t.merge(batch((1, 9, "again", False)), 2, "gone")  # a batch that comes again
    assert rows(t.read()) == want
    t.merge(batch((2, 3, "back", False)), 3, "gone")
    assert rows(t.read()) == [want[0], (2, 3, "back"), *want[1:]]
    t.merge(batch(), 4, "gone")
    assert t.read().count() == 4


def test_a_batch_that_was_not_committed_is_written_anew(spark):
    t = upserts(spark)
    t.merge(spark.createDataFrame([(k, 1, "a", False) for k in range(20)], CHANGES), 0, "gone")
    before = rows(t.read())
    second = spark.createDataFrame([(k, 2, "b", False) for k in range(5)], CHANGES)
    last = t.fs

    class Failing:
        def __getattr__(self, name):
            if name == "open_output_stream":
                raise OSError("lost")
            return getattr(last, name)
    t.fs = Failing()
    with pytest.raises(OSError):
        t.merge(second, 1, "gone")
    t.fs = last
    assert rows(t.read()) == before  # files of the batch are there, but no commit
    t.merge(second, 1, "gone")
    assert rows(t.read()) == sorted([(k, 2, "b") for k in range(5)] + [r for r in before if r[0] >= 5], key=repr)


def test_only_touched_buckets_are_rewritten(spark):
    t = upserts(spark, 64)
    t.merge(spark.createDataFrame([(k, 1, "a", False) for k in range(300)], CHANGES), 0, "gone")
    t.merge(spark.createDataFrame([(7, 2, "b", False)], CHANGES), 1, "gone")
    folders = t._folders()
    assert sorted(folders.values()).count("batch=1") == 1 and len(folders) > 50 and t.read().count() == 300


def test_buckets_that_no_commit_names_are_removed(spark):
    t = upserts(spark)
    changes = lambda version, *ks: spark.createDataFrame([(k, version, "a", False) for k in ks], CHANGES)
    assert t.clean() == 0
    t.merge(changes(0, *range(50)), 0, "gone")
    t.merge(changes(1, *range(50)), 1, "gone")
    old = t.read()
    t.merge(changes(2, 3), 2, "gone")
    changes(3, 4).selectExpr("*", "0 as _bucket").write.partitionBy("_bucket").parquet(f"{t.path}/data/batch=3")  # of a batch that is not committed yet
    assert t.clean(keep=2) == 4 and old.count() == 50  # batch 0
    assert t.clean() == 1 and t.clean() == 0  # the bucket that batch 2 wrote anew
    assert {r.version for r in t.read().collect()} == {1, 2} and t.read().count() == 50
    assert spark.read.parquet(f"{t.path}/data/batch=3").count() == 1
    t.merge(changes(0, *range(50)), 0, "gone")  # comes again after its files are gone
    assert t.read().count() == 50
    with pytest.raises(ValueError):
        t.clean(0)


def test_large_buckets_get_runs_that_are_merged_by_and_by(spark, monkeypatch):
    from weftline.streaming import upsert

    monkeypatch.setattr(upsert, "SMALL", 40)
    monkeypatch.setattr(upsert, "RUNS", 3)
    t, rng, best, batches, size = upserts(spark, 2), random.Random(4), {}, 12, 60
    for batch in range(batches):
        made = [(rng.randrange(300), rng.randrange(20), rng.choice(["a", "b", None]), rng.random() < 0.2) for _ in range(size)]
        t.merge(spark.createDataFrame(made, CHANGES), batch, "gone")
        for k, version, v, gone in made:
            best[k] = max(best.get(k, (-1,)), (version, gone, v is not None, v))
        if batch % 4 == 3:
            assert rows(t.read()) == sorted(((k, x[0], x[3]) for k, x in best.items() if not x[1]), key=repr)
            assert t.clean() >= 0 and t.read().count() == sum(not x[1] for x in best.values())
    assert max(map(len, t._runs().values())) <= 6


def test_rows_are_not_written_anew_with_each_batch():
    runs, written = [], 0
    for batch in range(200):
        merged = Table._merged(runs, 1_000_000)
        runs = [*runs[: len(runs) - len(merged)], [f"batch={batch}", 1_000_000 + sum(n for _, n in merged)]]
        written += runs[-1][1]
        assert len(runs) < 20
    assert sum(n for _, n in runs) == 200_000_000 and written < 5 * 200_000_000  # 100 times as much if a bucket is rewritten by each


def test_a_stream_of_changes(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    t = upserts(spark)
    for k in range(3):
        spark.createDataFrame([(x, k, f"v{k}", k == 2 and x == 0) for x in range(4)], CHANGES).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.createDataFrame([], CHANGES).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):  # started again, it goes on where it was
        t.follow(stream, f"{folder}-state", "gone")
    assert rows(t.read()) == [(x, 2, "v2") for x in (1, 2, 3)]
