import datetime
import random
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from weftline.operators.asof import asof_join
from weftline.operators.interval import in_bands, within
from weftline.sources import formats
from weftline.streaming import joins, ordered, windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_asof_in_buckets_against_brute_force(spark):
    rng = random.Random(1)
    left = [(rng.choice([1, 2, None]), rng.choice([rng.randrange(100), None]), k) for k in range(80)]
    right = [(rng.choice([1, 2, None]), rng.choice([rng.randrange(100), None]), str(k)) for k in range(40)]
    l, r = spark.createDataFrame(left, "k int, t int, id int"), spark.createDataFrame(right, "k int, t int, v string")

    def best(k, t):
        if k is None or t is None:
            return None
        return max(((y, v) for x, y, v in right if x == k and y is not None and y <= t), default=(0, None))[1]

    want = sorted(((k, t, i, best(k, t)) for k, t, i in left), key=repr)
    for bucket in (None, lambda t: F.floor(t / 7), lambda t: F.floor(t / 1000)):
        assert rows(asof_join(l, r, "k", "t", "v", "found", bucket)) == want
    assert rows(asof_join(l, r.limit(0), "k", "t", "v", "found")) == sorted(((*x, None) for x in left), key=repr)
    assert asof_join(l.limit(0), r, "k", "t", "v", "found").count() == 0


def test_within_and_bands_against_brute_force(spark):
    rng = random.Random(2)
    at = lambda: rng.choice([None, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(400))])
    left, right = ([(rng.choice([1, 2, None]), at(), k) for k in range(60)] for _ in range(2))
    l, r = (spark.createDataFrame(x, "k int, t timestamp, id int") for x in (left, right))
    want = sorted((a[2], b[2]) for a in left for b in right if a[0] is not None and a[0] == b[0] and a[1] and b[1] and 0 <= (b[1] - a[1]).total_seconds() <= 30)
    assert want and sorted(tuple(x) for x in within(l, r, "k", "t", 30).select("l_id", "r_id").collect()) == want
    points = [(k, rng.choice([None, rng.uniform(-5, 50)])) for k in range(60)] + [(99, 10.0), (98, 20.0)]
    bands = [(k, a, a + rng.uniform(-1, 12)) for k, a in enumerate(rng.uniform(-5, 40) for _ in range(20))] + [(50, 10.0, 20.0), (51, None, 3.0), (52, 7.0, 7.0)]
    p, b = spark.createDataFrame(points, "p int, v double"), spark.createDataFrame(bands, "b int, lo double, hi double")
    want = sorted((i, j) for i, v in points for j, lo, hi in bands if None not in (v, lo, hi) and lo <= v < hi)
    assert sorted(tuple(x) for x in in_bands(p, "v", b, "lo", "hi").select("p", "b").collect()) == want


def test_formats_keep_nulls_quotes_and_line_feeds(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", None), (3, 'a "b", \\N c\nd', 1e300), (None, "é,;\\", -0.1)], "id long, s string, x double")
    for write, read in ((formats.write_csv, formats.read_csv), (formats.write_json, formats.read_json), (formats.write_orc, formats.read_orc)):
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
        write(df, path)
        assert rows(read(spark, path, df.schema)) == rows(df), write
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    formats.write_partitioned(df, path, "id")
    back = formats.read_partitioned(spark, path, df.schema)
    assert rows(back.select(df.columns)) == rows(df)
    assert "PartitionFilters: [isnotnull(id" in back.where("id = 2")._jdf.queryExecution().toString()


def in_turn(spark, files, schema):
    """A folder with a file for each list of rows, which a stream takes one by one, oldest first."""
    import os
    import time

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k, part in enumerate(files):
        path = f"{folder}/part-{k}.parquet"
        pq.write_table(spark.createDataFrame(part, schema).toArrow(), path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (time.time() - 1000 + 10 * k,) * 2)
    return folder


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event(k, hour, kind="click", user=1):
    return (k, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour), user, kind, 1.0, "{}")


def test_late_events_are_dropped_once_their_window_is_out(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    files = [[event(1, 1), event(2, 2)], [event(3, 30)], [event(5, 29)], [event(4, 3)], [event(6, 80)], [event(7, 130)]]  # 5 is late but in time; 4 comes after its day was put out
    stream = windows.event_stream(spark, in_turn(spark, files, schema), schema, files_per_trigger=1)
    got = {str(r.start)[:10]: r.n for r in windows.run(windows.tumbling_counts(stream)).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 2, "2024-01-04": 1}


def state(files, spark, late="2 hours"):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = windows.event_stream(spark, in_turn(spark, files, schema), schema, files_per_trigger=1)
    return rows(windows.run(ordered.counts_between(stream, "user_id", "ts", "event_id", "event_type", "click", "purchase", late)).select("id", "n", "nth"))


def test_counts_do_not_follow_the_order_of_files(spark):
    events = [event(1, 1), event(2, 2), event(3, 2.5, "purchase"), event(4, 3.5), event(5, 4, "purchase"), event(6, 5), event(7, 5, "purchase"), event(8, 2, user=2), event(9, 6, "purchase", 2), event(10, 3, "view"), event(11, 4, "purchase", None)]
    want = [(3, 2, 1), (5, 1, 2), (7, 1, 3), (9, 1, 1)]
    end = [[event(90, 50)]]
    assert state([events, *end], spark) == want
    swapped = [[events[k] for k in part] for part in ((3, 0), (2, 1, 7, 10), (6, 4, 9), (8, 5))]  # no row is three hours behind an earlier one
    assert state([*swapped, *end], spark, "3 hours") == want


class Handle:
    """One key's state and timers; each call to them is counted."""

    def __init__(self):
        self.calls, self.timers, self.kept, self.map = 0, set(), {}, {}

    getListState = getMapState = getValueState = lambda self, name, *_: Part(self, name)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)

    def listTimers(self):
        self.calls += 1 + len(self.timers)
        return [(t,) for t in sorted(self.timers)]


class Part:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _set(self, x):
        self.handle.calls += 1
        self.handle.kept[self.name] = x

    def get(self):
        self.handle.calls += 1
        return self.handle.kept.get(self.name, [])

    def appendList(self, rows):
        self._set([*self.get(), *rows])

    put = update = _set

    def exists(self):
        return self.name in self.handle.kept

    def clear(self):
        self.handle.kept.pop(self.name, None)

    def containsKey(self, k):
        self.handle.calls += 1
        return k in self.handle.map

    def getValue(self, k):
        return self.handle.map[k]

    def updateValue(self, k, v):
        self.handle.map[k] = v


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_a_key_has_one_timer_and_few_calls_however_many_rows_it_has():
    import pandas as pd

    n, handle, made = 500, Handle(), ordered.InOrder("click", "purchase")
    made.init(handle)
    part = pd.DataFrame({"at": [k * 60_000_000 for k in range(n)], "id": range(n), "kind": ["purchase" if k % 5 == 4 else "click" for k in range(n)]})
    list(made.handleInputRows((1,), iter([part]), Now(0)))
    assert len(handle.timers) == 1
    got = []
    for ms in (60_000 * 250, 60_000 * 1000):
        for due in sorted(t for t in handle.timers if t <= ms):
            handle.timers.discard(due)
            got += [tuple(r) for x in made.handleExpiredTimer((1,), Now(ms), Now(due)) for r in x.itertuples(index=False)]
        assert len(handle.timers) == 1  # for the next row, or for the key's end
    assert got == [(1, k, 4, k // 5 + 1) for k in range(4, n, 5)]
    assert handle.calls < 30
    list(made.handleExpiredTimer((1,), Now(ordered.IDLE_MS * 2), Now(max(handle.timers))))
    assert not handle.kept


def test_rows_behind_the_watermark_do_not_count(spark):
    files = [[event(1, 1)], [event(2, 10)], [event(3, 3)], [event(4, 11, "purchase")], [event(5, 30)], [event(6, 40)]]
    assert state(files, spark) == [(4, 2, 1)]


def test_clicks_followed_by_purchases_over_triggers(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    files = [[event(1, 1), event(2, 1.5, user=2)], [event(3, 2, "purchase"), event(4, 2.5)], [event(5, 2.2, "purchase"), event(6, 9), event(7, 9, "purchase", 3)], [event(20, 9, "view")], [event(8, 2.3, "purchase", 2)], [event(9, 30), event(10, 30, "purchase")], [event(11, 60), event(12, 60, "purchase", 4)]]
    stream = lambda kind: windows.event_stream(spark, in_turn(spark, files, schema), schema, files_per_trigger=1).where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    found = windows.run(joins.followed_by(stream("click"), stream("purchase"), "user_id", "ts", "2 hours", "1 hour"))
    # 8 is in time for 2, but came when the watermark had passed both for a batch; 4 and 6 have none; 11 is still held
    assert rows(found.select("a_event_id", "b_event_id")) == [(1, 3), (1, 5), (2, None), (4, None), (6, None), (9, 10)]


def test_first_of_day_is_one_row_for_each_day(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    files = [[event(1, 5), event(2, 4)], [event(3, 4.5), event(4, 3, "view")], [event(5, 30)], [event(6, 100)]]
    stream = windows.event_stream(spark, in_turn(spark, files, schema), schema, files_per_trigger=1)
    found = [(r.event_type, r.day.day, r.ts.day, r.ts.hour) for r in windows.run(windows.first_of_day(stream)).collect()]
    assert sorted(found) == [("click", 1, 1, 4), ("click", 2, 2, 6), ("view", 1, 1, 3)]
