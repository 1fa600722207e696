"""Relational queries over the sales tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
       sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, avg(l_quantity) AS avg_qty, CAST(count(*) AS BIGINT) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.sum("l_extendedprice").alias("sum_base_price"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"),
            F.avg("l_quantity").alias("avg_qty"),
            F.count("*").alias("count_order"),
        )
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""
SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name
""")
def local_supplier_revenue(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    lines = lines.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return lines.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def customers_with_large_orders(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""
SELECT s_suppkey, CAST(count(l_orderkey) AS BIGINT) AS lines, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts
FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey
""")
def lines_and_parts_by_supplier(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("l_orderkey").alias("lines"), F.count_distinct("l_partkey").alias("parts"))
    both = table(spark, sf_dir, "supplier").join(each, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return both.select("s_suppkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "parts")])


@query("""
SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) + 2 * GROUPING(l_linestatus) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def line_status_cube(spark, sf_dir):
    level = F.grouping("l_returnflag").cast("long") + 2 * F.grouping("l_linestatus").cast("long")
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(level.alias("level"), F.count("*").alias("n"))


@query("""
SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS place, o_totalprice - lag(o_totalprice) OVER w AS change,
       sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def customer_order_history(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.row_number().over(w).cast("long").alias("place"),
        (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("change"),
        F.sum("o_totalprice").over(w.rowsBetween(-2, 0)).alias("last_three"),
    )


@query("SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def urgent_and_rich(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey"))
    return urgent.intersect(table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey"))


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def never_large(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).subtract(large)


@query("""
SELECT p_partkey, upper(p_brand) AS brand, CAST(length(p_name) AS BIGINT) AS name_length, concat_ws('/', p_brand, p_type) AS label,
       CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, greatest(p_retailprice, 1000.0) AS price
FROM part
""")
def part_labels(spark, sf_dir):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper("p_brand").alias("brand"),
        F.length("p_name").cast("long").alias("name_length"),
        F.concat_ws("/", "p_brand", "p_type").alias("label"),
        size.alias("size_class"),
        F.greatest("p_retailprice", F.lit(1000.0)).alias("price"),
    )


@query("""
SELECT event_type, date_trunc('day', ts) AS day, CAST(count(*) AS BIGINT) AS n, sum(value) AS total FROM events GROUP BY ALL
""")
def events_by_day(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")
    return table(spark, sf_dir, "events").groupBy("event_type", day).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'")
def click_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
SELECT c.event_id AS event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts
""")
def clicks_with_last_purchase(spark, sf_dir):
    from weftline.operators.asof import asof_join

    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    clicks, bought = (events.where(F.col("event_type") == kind).drop("event_type") for kind in ("click", "purchase"))
    return asof_join(clicks, bought, "user_id", "ts", "value", "last_purchase").select("event_id", "last_purchase")
