"""Set operations, rankings, frames, grouping sets, range joins and nested values, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators.interval import in_bands, overlap_counts, overlap_summary, within
from weftline.operators.ordered import ranked
from weftline.operators.skew import skew_join
from weftline.plans.relational import query, table
from weftline.sources.shared import written


def _nations(spark, sf_dir):
    return (table(spark, sf_dir, n).select(F.col(f"{n[0]}_nationkey").alias("nationkey")) for n in ("customer", "supplier"))


@query("SELECT nationkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nationkey")
def partners_by_nation(spark, sf_dir):
    customers, suppliers = _nations(spark, sf_dir)
    return customers.unionByName(suppliers).groupBy("nationkey").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def nations_with_partners(spark, sf_dir):
    customers, suppliers = _nations(spark, sf_dir)
    return customers.distinct().unionByName(suppliers.distinct()).distinct()


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def matched_partners(spark, sf_dir):
    customers, suppliers = _nations(spark, sf_dir)
    return customers.intersectAll(suppliers)


@query("SELECT c_nationkey AS nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def customers_beyond_suppliers(spark, sf_dir):
    customers, suppliers = _nations(spark, sf_dir)
    return customers.exceptAll(suppliers)


@query("""
SELECT o_orderkey, CAST(rank() OVER d AS BIGINT) AS place, CAST(dense_rank() OVER d AS BIGINT) AS dense, percent_rank() OVER d AS share,
       cume_dist() OVER d AS upto, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS quarter
FROM orders WINDOW d AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def order_ranks(spark, sf_dir):
    d = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.rank().over(d).cast("long").alias("place"),
        F.dense_rank().over(d).cast("long").alias("dense"),
        F.percent_rank().over(d).alias("share"),
        F.cume_dist().over(d).alias("upto"),
        F.ntile(4).over(price).cast("long").alias("quarter"),
    )


@query("""
SELECT o_orderkey, lead(o_orderkey, 1) OVER w AS following, lead(o_orderkey, 2, -1) OVER w AS after_next,
       first_value(o_totalprice) OVER a AS first_price, last_value(o_totalprice) OVER a AS last_price, nth_value(o_orderkey, 2) OVER a AS second
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
a AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def order_neighbours(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    a = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lead("o_orderkey").over(w).alias("following"),
        F.lead("o_orderkey", 2, -1).over(w).alias("after_next"),
        F.first("o_totalprice").over(a).alias("first_price"),
        F.last("o_totalprice").over(a).alias("last_price"),
        F.nth_value("o_orderkey", 2).over(a).alias("second"),
    )


@query("""
SELECT o_orderkey, CAST(count(*) OVER r AS BIGINT) AS recent, max(o_totalprice) OVER r AS dearest FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders)
WINDOW r AS (PARTITION BY o_custkey ORDER BY s RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW)
""")
def orders_of_a_quarter(spark, sf_dir):
    r = Window.partitionBy("o_custkey").orderBy("s").rangeBetween(-7_776_000, 0)
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").cast("long").alias("s"))
    return own.select("o_orderkey", F.count("*").over(r).alias("recent"), F.max("o_totalprice").over(r).alias("dearest"))


@query("""
SELECT c_mktsegment, c_nationkey, CAST(GROUPING(c_mktsegment, c_nationkey) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, max(c_acctbal) AS most
FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)
""")
def segment_rollup(spark, sf_dir):
    return table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.max("c_acctbal").alias("most"))


@query("""
SELECT p_brand, p_type, p_size, CAST(GROUPING(p_brand, p_type, p_size) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n
FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_size), ())
""")
def part_grouping_sets(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    sets = parts.groupingSets([[F.col("p_brand"), F.col("p_type")], [F.col("p_size")], []], "p_brand", "p_type", "p_size")
    return sets.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


@query("""
SELECT r_name, CAST(count(*) AS BIGINT) AS dearer, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands
FROM region JOIN part ON p_retailprice > 905 + 20 * r_regionkey AND p_size <> r_regionkey GROUP BY r_name
""")
def parts_dearer_than_a_step(spark, sf_dir):
    steps = F.broadcast(table(spark, sf_dir, "region"))  # the regions of the world: a table of fixed size
    parts = table(spark, sf_dir, "part").groupBy("p_retailprice", "p_size", "p_brand").agg(F.count("*").alias("n"))
    both = parts.join(steps, (F.col("p_retailprice") > 905 + 20 * F.col("r_regionkey")) & (F.col("p_size") != F.col("r_regionkey")))
    return both.groupBy("r_name").agg(F.sum("n").alias("dearer"), F.count_distinct("p_brand").alias("brands"))


@query("""
WITH bands AS (SELECT s_suppkey, 900 + s_suppkey % 50 * 2 AS low, 900 + s_suppkey % 50 * 2 + 3 AS high FROM supplier)
SELECT s_suppkey, CAST(count(*) AS BIGINT) AS n, min(p_retailprice) AS cheapest FROM bands JOIN part ON p_retailprice >= low AND p_retailprice < high GROUP BY s_suppkey
""")
def parts_in_price_bands(spark, sf_dir):
    low = 900 + F.col("s_suppkey") % 50 * 2
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", low.alias("low"), (low + 3).alias("high"))
    prices = table(spark, sf_dir, "part").groupBy("p_retailprice").agg(F.count("*").alias("many"))
    found = in_bands(prices, "p_retailprice", bands, "low", "high")
    return found.groupBy("s_suppkey").agg(F.sum("many").alias("n"), F.min("p_retailprice").alias("cheapest"))


@query("""
SELECT a.event_id AS purchase, CAST(count(*) AS BIGINT) AS followers, min(b.event_id) AS first FROM events a
JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR AND b.event_id <> a.event_id WHERE a.event_type = 'purchase' GROUP BY a.event_id
""")
def events_after_purchases(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    pairs = within(events.where("event_type = 'purchase'").drop("event_type"), events.drop("event_type"), "user_id", "ts", 7200).where("l_event_id != r_event_id")
    return pairs.groupBy(F.col("l_event_id").alias("purchase")).agg(F.count("*").alias("followers"), F.min("r_event_id").alias("first"))


@query("""
SELECT o_orderkey, array_to_string(parts, ',') AS parts, CAST(len(parts) AS BIGINT) AS n, array_to_string(list_filter(parts, lambda x: x % 2 = 0), ',') AS even,
       CAST(coalesce(list_sum(list_transform(parts, lambda x: x % 10)), 0) AS BIGINT) AS digits, list_contains(parts, 7) AS seventh
FROM (SELECT l_orderkey AS o_orderkey, list_sort(list(DISTINCT l_partkey)) AS parts FROM lineitem GROUP BY l_orderkey)
""")
def order_part_arrays(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    p = F.col("parts")
    return parts.select(
        "o_orderkey",
        joined(p).alias("parts"),
        F.size("parts").cast("long").alias("n"),
        joined(F.filter("parts", lambda x: x % 2 == 0)).alias("even"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x % 10).alias("digits"),
        F.array_contains("parts", 7).alias("seventh"),
    )


@query("""
SELECT l_suppkey, string_agg(concat(l_returnflag, ':', n), ';' ORDER BY l_returnflag) AS flags, CAST(sum(n) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS returned
FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey
""")
def flags_by_supplier(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    maps = each.groupBy("l_suppkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", "n")))).alias("m"))
    shown = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")
    return maps.select("l_suppkey", shown.alias("flags"), F.try_element_at("m", F.lit("R")).alias("returned"))


@query("""
SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS k FROM part) GROUP BY k
""")
def words_of_part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS age, CAST(year(o_orderdate) AS BIGINT) AS year,
       CAST(quarter(o_orderdate) AS BIGINT) AS quarter, CAST(isodow(o_orderdate) AS BIGINT) AS weekday, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
       strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS due, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month
FROM orders
""")
def order_dates(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_diff(F.lit("2002-01-01").cast("date"), d).cast("long").alias("age"),
        F.year(d).cast("long").alias("year"),
        F.quarter(d).cast("long").alias("quarter"),
        (F.weekday(d) + 1).cast("long").alias("weekday"),
        shown(F.last_day(d)).alias("month_end"),
        shown(F.date_add(d, 45)).alias("due"),
        shown(F.add_months(d, 1)).alias("next_month"),
    )


@query("""
SELECT p_partkey, sqrt(p_retailprice) AS root, ln(p_retailprice) AS log, CAST(floor(p_retailprice / 7) AS BIGINT) AS sevenths, CAST(p_partkey % 13 AS BIGINT) AS rest,
       pow(p_size, 2) AS square, CAST(sign(p_size - 25) AS BIGINT) AS side, abs(p_size - 25.0) AS away, CAST(bit_count(p_partkey) AS BIGINT) AS bits,
       lower(substr(p_brand, 1, 3)) AS start, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, replace(p_type, ' ', '_') AS snake, reverse(p_name) AS backwards, CAST(instr(p_name, 'e') AS BIGINT) AS at
FROM part
""")
def part_scalars(spark, sf_dir):
    size, price, key = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.sqrt(price).alias("root"),
        F.log(price).alias("log"),
        F.floor(price / 7).alias("sevenths"),
        (key % 13).alias("rest"),
        F.pow(size, F.lit(2)).alias("square"),
        F.signum(size - 25).cast("long").alias("side"),
        F.abs(size - 25.0).alias("away"),
        F.bit_count(key).cast("long").alias("bits"),
        F.lower(F.substring("p_brand", 1, 3)).alias("start"),
        F.lpad(size.cast("string"), 4, "0").alias("padded"),
        F.replace("p_type", F.lit(" "), F.lit("_")).alias("snake"),
        F.reverse("p_name").alias("backwards"),
        F.instr("p_name", "e").cast("long").alias("at"),
    )


@query("""
SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
       count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY o_orderstatus
""")
def priorities_by_status(spark, sf_dir):
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    wide = table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", list(names)).agg(F.count(F.lit(1))).where("`1-URGENT` is not null or `2-HIGH` is not null or `5-LOW` is not null")
    return wide.select("o_orderstatus", *[F.coalesce(k, F.lit(0)).alias(v) for k, v in names.items()])


@query("""
SELECT l_linestatus, measure, sum(value) AS total FROM (
  UNPIVOT (SELECT l_linestatus, l_quantity AS quantity, l_extendedprice AS price FROM lineitem) ON quantity, price INTO NAME measure VALUE value) GROUP BY ALL
""")
def line_measures(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"))
    return sums.unpivot("l_linestatus", ["quantity", "price"], "measure", "total")


@query("""
SELECT c_custkey, c_acctbal FROM customer a WHERE c_acctbal > 1.5 * (SELECT avg(c_acctbal) FROM customer b WHERE b.c_nationkey = a.c_nationkey)
""")
def customers_far_above_their_nation(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    means = customers.groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("mean"))
    return customers.join(means, F.col("c_nationkey") == F.col("nation")).where(F.col("c_acctbal") > 1.5 * F.col("mean")).select("c_custkey", "c_acctbal")


@query("""
SELECT p_type, quantile_cont(p_retailprice, 0.5) AS middle, quantile_cont(p_retailprice, 0.9) AS high, max(p_retailprice) - min(p_retailprice) AS spread,
       CAST(arg_max(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS BIGINT) AS dearest FROM part GROUP BY p_type
""")
def price_quantiles(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").groupBy("p_type").agg(
        F.percentile(price, 0.5).alias("middle"),
        F.percentile(price, 0.9).alias("high"),
        (F.max(price) - F.min(price)).alias("spread"),
        F.max_by("p_partkey", F.struct(price, "p_partkey")).alias("dearest"),
    )


@query("""
WITH RECURSIVE steps AS (SELECT 0 AS depth, CAST(10 AS BIGINT) AS most UNION ALL SELECT depth + 1, most * 2 FROM steps WHERE depth < 5)
SELECT depth, CAST(count(*) AS BIGINT) AS nations FROM steps JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON n <= most GROUP BY depth
""")
def nations_by_size_steps(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("weftline_customer")
    return spark.sql("""
        WITH RECURSIVE steps(depth, most) AS (SELECT 0, CAST(10 AS BIGINT) UNION ALL SELECT depth + 1, most * 2 FROM steps WHERE depth < 5)
        SELECT depth, count(*) AS nations FROM (SELECT c_nationkey, count(*) AS n FROM weftline_customer GROUP BY c_nationkey) JOIN steps ON n <= most GROUP BY depth
    """)


@query("""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS plain,
       CAST(len(string_split(html, '<p')) - 1 AS BIGINT) AS paragraphs FROM pages
""")
def page_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"),
        F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("plain"),
        (F.size(F.split("html", "<p")) - 1).cast("long").alias("paragraphs"),
    )


@query("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, arg_min(role, turn) AS opener, arg_max(role, turn) AS closer, CAST(max(length(text)) AS BIGINT) AS longest,
       CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS asked FROM conversations GROUP BY conv_id
""")
def conversation_shapes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.min_by("role", "turn").alias("opener"),
        F.max_by("role", "turn").alias("closer"),
        F.max(F.length("text")).cast("long").alias("longest"),
        F.count_if(F.col("role") == "user").alias("asked"),
    )


@query("""
SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS place, CAST(dense_rank() OVER w AS BIGINT) AS dense, percent_rank() OVER w AS share, cume_dist() OVER w AS upto
FROM orders WINDOW w AS (ORDER BY o_orderpriority, year(o_orderdate) DESC)
""")
def orders_ranked_overall(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("year"))
    found = ranked(orders, {"o_orderpriority": True, "year": False})  # few values: each tie spans many parts
    return found.select("o_orderkey", F.col("rank").alias("place"), "dense", "share", "upto")


@query("""
SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS place, CAST(ntile(100) OVER w AS BIGINT) AS percentile,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cents_so_far
FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey)
""")
def order_totals_so_far(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    found = ranked(orders, {"o_totalprice": False, "o_orderkey": True}, total="cents", tiles=100)
    return found.select("o_orderkey", "place", F.col("tile").alias("percentile"), F.col("running").alias("cents_so_far"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_acctbal AS low, c_acctbal + c_custkey % 20 AS high FROM customer),
s AS (SELECT s_suppkey AS k, s_acctbal - 10 AS low, s_acctbal + 5 * (s_suppkey % 40) AS high FROM supplier)
SELECT s.k AS supplier, CAST(count(*) AS BIGINT) AS n, min(c.k) AS first FROM s JOIN c ON s.low < c.high AND c.low < s.high AND c.low < c.high GROUP BY s.k
""")
def overlapping_credit_bands(spark, sf_dir):
    c, s = F.col("c_acctbal"), F.col("s_acctbal")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), c.alias("low"), (c + F.col("c_custkey") % 20).alias("high"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (s - 10).alias("low"), (s + 5 * (F.col("s_suppkey") % 40)).alias("high"))
    found = overlap_summary(suppliers, customers, "low", "high", "k", "k")
    return found.select(F.col("k").alias("supplier"), "n", F.col("least").alias("first"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS a, o_orderdate + to_days(CAST(1 + o_orderkey % 60 AS INTEGER)) AS b FROM orders)
SELECT x.k AS k, CAST(count(*) AS BIGINT) AS others FROM o x JOIN o y ON x.c = y.c AND x.a < y.b AND y.a < x.b AND x.k <> y.k GROUP BY x.k
""")
def orders_open_together(spark, sf_dir):
    stop = F.col("o_orderdate") + F.make_dt_interval((1 + F.col("o_orderkey") % 60).cast("int"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("a"), stop.alias("b"))
    orders = orders.where("k is not null")
    found = written(overlap_counts(orders, "a", "b", "k", "c"))
    others = found.where("rows = 1").select("k", (F.col("n") - 1).alias("others"))
    again = found.where("rows > 1").select("k", "n")
    if not again.isEmpty():  # an order's rows are not others of each other
        own = overlap_counts(orders.join(again.select("k"), "k", "left_semi"), "a", "b", "k", "c", "k")
        others = others.unionByName(again.join(own.select("k", F.col("n").alias("own")), "k").select("k", (F.col("n") - F.col("own")).alias("others")))
    return others.where("others > 0")


@query("""
WITH y AS (SELECT DISTINCT l_returnflag AS flag, year(l_shipdate) AS upto FROM lineitem)
SELECT flag, CAST(upto AS INTEGER) AS upto, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN y ON l_returnflag = flag AND year(l_shipdate) <= upto GROUP BY flag, upto
""")
def quantities_up_to_each_year(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("year"), "l_quantity")
    found = skew_join(lines, lines.select("flag", F.col("year").alias("upto")).distinct(), "flag")  # three keys hold all rows
    return found.where("year <= upto").groupBy("flag", "upto").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
