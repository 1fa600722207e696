"""Queries over streams, files and Python functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import aggregates, variant
from weftline.functions.tables import visits
from weftline.functions.vectorised import Instalments, compound
from weftline.operators import sketches
from weftline.plans.relational import query, table
from weftline.sources import blocks, formats
from weftline.sources.shared import new_folder
from weftline.streaming import joins, ordered, upsert, windows


def _events(spark, sf_dir):
    return windows.event_stream(spark, f"{sf_dir}/events.parque*", table(spark, sf_dir, "events").schema)  # a pattern: the table may be one file, which streams do not take


def _plain(df, *times):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query("""
SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events
GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_tumbling_counts(spark, sf_dir):
    return _plain(windows.run(windows.tumbling_counts(_events(spark, sf_dir))), "start")


@query("""
WITH w AS (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start, event_type FROM events)
SELECT start, event_type, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY ALL HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_sliding_counts(spark, sf_dir):
    return _plain(windows.run(windows.sliding_counts(_events(spark, sf_dir))), "start")


@query("""
WITH g AS (SELECT user_id, ts, coalesce(CAST(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE AS INTEGER), 1) AS new FROM events WHERE user_id IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, CAST(count(*) AS BIGINT) AS n FROM s
GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_session_counts(spark, sf_dir):
    return _plain(windows.run(windows.session_counts(_events(spark, sf_dir))), "start", "stop")


@query("SELECT event_id, c_mktsegment AS segment, value FROM events JOIN customer ON user_id = c_custkey")
def stream_with_customers(spark, sf_dir):
    return windows.run(windows.with_customers(_events(spark, sf_dir), table(spark, sf_dir, "customer")))


@query("""
SELECT user_id, event_type, date_trunc('day', ts) AS day, min(ts) AS ts FROM events
GROUP BY user_id, event_type, date_trunc('day', ts) HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_first_of_day(spark, sf_dir):
    return _plain(windows.run(windows.first_of_day(_events(spark, sf_dir))), "day", "ts")


@query("""
WITH own AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase') AND user_id IS NOT NULL),
p AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM own)
SELECT max(event_id) FILTER (WHERE event_type = 'purchase') AS event_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, CAST(k + 1 AS BIGINT) AS nth
FROM p GROUP BY user_id, k
HAVING max(ts) FILTER (WHERE event_type = 'purchase') < (SELECT date_trunc('minute', max(ts) - INTERVAL 1 HOUR) FROM own)
""")
def stream_clicks_before_purchases(spark, sf_dir):
    found = windows.run(ordered.counts_between(_events(spark, sf_dir), "user_id", "ts", "event_id", "event_type", "click", "purchase", windows.LATE))
    return found.select(F.col("id").alias("event_id"), F.col("n").alias("clicks"), "nth")


@query("""
WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 1 HOUR AS mark)
SELECT c.event_id AS click, p.event_id AS purchase FROM c JOIN p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR
UNION ALL
SELECT event_id, NULL FROM c, w WHERE ts + INTERVAL 6 HOUR < mark AND NOT EXISTS (SELECT 1 FROM p WHERE c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR)
""")
def stream_purchases_after_clicks(spark, sf_dir):
    clicks, purchases = (_events(spark, sf_dir).where(F.col("event_type") == kind).select("event_id", "user_id", "ts") for kind in ("click", "purchase"))
    found = windows.run(joins.followed_by(clicks, purchases, "user_id", "ts", "6 hours", windows.LATE))
    return found.select(F.col("a_event_id").alias("click"), F.col("b_event_id").alias("purchase"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(value) AS most FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type")
def events_by_partition(spark, sf_dir):
    events, path = table(spark, sf_dir, "events"), new_folder(spark)
    formats.write_partitioned(events, path, "event_type")
    back = formats.read_partitioned(spark, path, events.schema)
    return back.where("event_type in ('click', 'purchase')").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def orders_by_csv(spark, sf_dir):
    orders, path = table(spark, sf_dir, "orders"), new_folder(spark)
    formats.write_csv(orders, path)
    return formats.read_csv(spark, path, orders.schema)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def events_by_json(spark, sf_dir):
    events, path = table(spark, sf_dir, "events"), new_folder(spark)
    formats.write_json(events, path)
    return formats.read_json(spark, path, events.schema)


@query("SELECT p_brand, CAST(count(*) AS BIGINT) AS n, min(p_size) AS smallest FROM part GROUP BY p_brand")
def brands_by_orc(spark, sf_dir):
    parts, path = table(spark, sf_dir, "part"), new_folder(spark)
    formats.write_orc(parts, path)
    return formats.read_orc(spark, path, parts.schema).groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_size").alias("smallest"))


@query("SELECT p_partkey, p_retailprice * pow(1.05, p_size % 10) AS later FROM part")
def future_prices(spark, sf_dir):
    later = compound(F.col("p_retailprice"), F.lit(0.05), F.col("p_size") % 10)
    return table(spark, sf_dir, "part").select("p_partkey", later.alias("later"))


@query("SELECT l_suppkey, sum(sqrt(l_extendedprice) * l_quantity) / sum(l_quantity) AS mean FROM lineitem GROUP BY l_suppkey")
def mean_price_roots(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.sqrt("l_extendedprice").alias("root"), "l_quantity")
    return aggregates.aggregated(lines, ["l_suppkey"], ["root", "l_quantity"], aggregates.weighted_mean("root", "l_quantity"), "mean")


@query("SELECT l_returnflag, exp(avg(ln(l_extendedprice))) AS mean FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_returnflag")
def geometric_mean_prices(spark, sf_dir):
    return aggregates.aggregated(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_extendedprice"], aggregates.geometric_mean("l_extendedprice"), "mean")


@query("""
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, true AS users_close, true AS users_theta_close, true AS median_close
FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY event_type
""")
def users_of_two_weeks_by_sketches(spark, sf_dir):
    events, path = table(spark, sf_dir, "events"), new_folder(spark)
    states = sketches.daily_states(events, "ts", ["event_type"], "user_id", "value")
    sketches.write_states(states, path)
    stored = sketches.read_states(spark, path, states.schema, "2024-01-08", "2024-01-21")
    guess = sketches.estimated(sketches.merged(stored, "event_type"), 0.5).select(F.col("event_type").alias("kind"), "n", "items", "items_theta", F.col("q0").alias("median"))
    inside = events.where(F.to_date("ts").between("2024-01-08", "2024-01-21")).join(guess, F.col("event_type") == F.col("kind"))
    exact = inside.groupBy("event_type", "n", "items", "items_theta").agg(F.count_distinct("user_id").alias("users"), (F.count_if(F.col("value") <= F.col("median")) / F.count("*")).alias("upto"))
    near = lambda c: F.abs(F.col(c) / F.col("users") - 1) < 0.06  # noqa: E731  below four standard errors
    return exact.select("event_type", "n", "users", near("items").alias("users_close"), near("items_theta").alias("users_theta_close"), F.abs(F.col("upto") - 0.5).__lt__(0.04).alias("median_close"))


@query("""
SELECT l_suppkey AS supplier, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS quantity, CAST(count(*) FILTER (WHERE l_discount = 0) AS BIGINT) AS undiscounted
FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY l_suppkey
UNION ALL SELECT NULL, CAST(count(*) AS BIGINT), NULL, NULL FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 10 = 3)
""")
def lines_from_nested_json(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_suppkey").alias("by"), F.struct(F.col("l_quantity").alias("q")).alias("of"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("off")).alias("line"))
    orders = lines.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list("line").alias("lines"))).alias("text"))  # an order's lines
    orders = orders.withColumn("text", F.when(F.col("l_orderkey") % 10 == 3, F.substring("text", 1, 9)).otherwise(F.col("text")))  # a tenth is cut off
    read = variant.parsed(orders, "text")
    each = variant.opened(read, F.col("parsed"), "$.lines", {"supplier": ("$.by", "long"), "quantity": ("$.of.q", "double"), "off": ("$.off", "double")})
    found = each.groupBy("supplier").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.count_if(F.col("off").isNull()).alias("undiscounted"))
    return found.unionByName(read.where("bad").agg(F.count("*").alias("n")), allowMissingColumns=True)


@query("""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price
FROM orders WHERE o_orderkey % 7 <> 0
""")
def orders_after_changes(spark, sf_dir):
    orders, folder = table(spark, sf_dir, "orders"), new_folder(spark)
    made = orders.select(F.col("o_orderkey").alias("k"), F.lit(1).alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(False).alias("gone"))
    changed = made.where("k % 3 = 0").withColumns({"version": F.lit(2), "status": F.lit("X")})
    gone = made.where("k % 7 = 0").withColumns({"version": F.lit(3), "gone": F.lit(True)})
    for part in (gone, made, changed):  # deletions come first, the changes they delete later
        part.write.mode("append").parquet(f"{folder}/changes")
    kept = upsert.Table(spark, f"{folder}/orders", made.drop("gone").schema, "k", "version")
    kept.follow(spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/changes"), f"{folder}/state", "gone")
    return kept.read()


@query("SELECT o_orderkey, CAST(k AS INTEGER) AS number, o_totalprice / (1 + o_orderkey % 4) AS amount FROM (SELECT *, unnest(range(1, 2 + o_orderkey % 4)) AS k FROM orders)")
def order_instalments(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = (1 + F.col("o_orderkey") % 4).cast("int")
    return orders.lateralJoin(Instalments(F.col("o_totalprice").outer(), parts.outer())).select("o_orderkey", "number", "amount")


@query("SELECT event_id, ts, user_id, value FROM events WHERE event_id > 300 AND event_id <= 420 AND value > 1")
def events_by_blocks(spark, sf_dir):
    path = new_folder(spark)
    blocks.write_blocks(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value"), path, "event_id", rows=500)
    return blocks.read_blocks(spark, path, "event_id").where("event_id > 300 and event_id <= 420 and value > 1")


@query("""
WITH g AS (SELECT user_id, ts, coalesce(CAST(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 90 MINUTE AS INTEGER), 1) AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS number FROM g)
SELECT user_id, CAST(number AS BIGINT) AS number, min(ts) AS start, max(ts) AS stop, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, number
""")
def user_visits(spark, sf_dir):
    return visits(table(spark, sf_dir, "events"), "user_id", "ts", 90).withColumnRenamed("key", "user_id")
