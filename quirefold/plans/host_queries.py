"""Ordinary relational queries around the page operators: joins, groupings, windows, sets, JSON, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.operators.joins import as_of_join, overlap_join
from quirefold.session import table
from quirefold.streaming.windows import sessions, tumbling_counts


def host_join_inner(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    joined = line.select("l_orderkey", "l_quantity").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return joined.groupBy("c_mktsegment").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count(F.lit(1)).alias("n"))


def host_join_left(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def host_join_semi(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


def host_join_anti(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


def host_join_full(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, "k", "full").select("k", "suppliers", "customers")


def host_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last view of the user before each purchase."""
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_ts"), F.col("event_id").alias("seen_id"))
    return as_of_join(bought, seen, ["user_id"], "ts", "seen_ts", ["seen_ts", "seen_id"]).select("event_id", "seen_id")


def host_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of panels of a page that overlap."""
    p = table(spark, d, "pages").where("panels is not null").groupBy("page_id").agg(F.max_by("panels", "page_id").alias("panels"))
    b = p.select("page_id", F.posexplode("panels").alias("k", "b")).select("page_id", "k", F.col("b.top").alias("start"), F.col("b.bottom").alias("stop"))
    other = b.select("page_id", F.col("k").alias("k2"), F.col("start").alias("start2"), F.col("stop").alias("stop2"))
    return overlap_join(b, other, ["page_id"], 1024).where("k < k2").select("page_id", "k", "k2")


def host_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.grouping_id().alias("level"))


def host_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def host_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def host_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.max("l_shipdate").alias("last"))


def host_ranking(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.rank().over(by).alias("rank"), F.dense_rank().over(by).alias("dense"), F.ntile(4).over(by).alias("quarter"), F.lag("s_suppkey").over(by).alias("before"))


def host_frames(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return o.select("o_orderkey", F.sum("cents").over(by.rowsBetween(-2, 0)).alias("last_three"), F.count(F.lit(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.first("o_orderkey").over(by).alias("first_order"))


def host_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The three largest orders of each priority."""
    by = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(by)).where("r <= 3").select("o_orderpriority", "r", "o_orderkey")


def host_sets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return s.intersect(c).withColumn("op", F.lit("both")).unionByName(n.exceptAll(s.distinct()).withColumn("op", F.lit("without"))).unionByName(s.union(c).distinct().withColumn("op", F.lit("either")))


def host_json(spark: SparkSession, d: str) -> DataFrame:
    keys = F.explode(F.json_object_keys("props")).alias("key")
    return table(spark, d, "events").where("props is not null").select(keys).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def host_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("finished"), F.coalesce("O", F.lit(0)).alias("open"))


def _cents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))


def host_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = tumbling_counts(_cents(spark, d), ["event_type"], "1 hour", value="cents")
    return w.select(F.unix_seconds("window_start").alias("start"), "event_type", "n", "total")


def host_sliding(spark: SparkSession, d: str) -> DataFrame:
    w = tumbling_counts(_cents(spark, d), [], "1 day", "12 hours", value="cents")
    return w.select(F.unix_seconds("window_start").alias("start"), "n", "total")


def host_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(_cents(spark, d), ["user_id"], "30 minutes").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def host_star(spark: SparkSession, d: str) -> DataFrame:
    """Orders by region and year over the star schema."""
    orders = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return orders.join(customer, "o_custkey").join(nation, "n_nationkey").join(table(spark, d, "region"), "r_regionkey").groupBy("r_name", "year").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {name: query for name, query in dict(globals()).items() if name.startswith("host_")}

ORACLE = {
    "host_join_inner": "SELECT c_mktsegment, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "host_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "host_join_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)",
    "host_join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "host_join_full": "SELECT k, suppliers, customers FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) USING (k)",
    "host_as_of": "SELECT b.event_id, max(s.event_id) AS seen_id FROM (SELECT b.event_id, b.user_id, max(s.ts) AS t FROM events b LEFT JOIN events s ON s.user_id = b.user_id AND s.ts <= b.ts AND s.event_type = 'view' WHERE b.event_type = 'purchase' GROUP BY b.event_id, b.user_id) b LEFT JOIN events s ON s.user_id = b.user_id AND s.ts = b.t AND s.event_type = 'view' GROUP BY b.event_id",
    "host_overlap": "WITH p AS (SELECT page_id, any_value(panels) AS panels FROM pages WHERE panels IS NOT NULL GROUP BY page_id), b AS (SELECT page_id, unnest(range(len(panels))) AS k, unnest(panels) AS u FROM p) SELECT x.page_id, CAST(x.k AS INT) AS k, CAST(y.k AS INT) AS k2 FROM b x JOIN b y ON x.page_id = y.page_id AND x.k < y.k AND x.u.top < y.u.bottom AND y.u.top < x.u.bottom AND x.u.top < x.u.bottom AND y.u.top < y.u.bottom",
    "host_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "host_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "host_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "host_distinct_counts": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag",
    "host_ranking": "SELECT s_suppkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER w AS quarter, lag(s_suppkey) OVER w AS before FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)",
    "host_frames": "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING) AS BIGINT) AS last_three, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS so_far, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order FROM orders",
    "host_top_k": "SELECT o_orderpriority, r, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
    "host_sets": "SELECT k, 'both' AS op FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL SELECT k, 'without' FROM (SELECT n_nationkey AS k FROM nation EXCEPT ALL SELECT DISTINCT s_nationkey FROM supplier) UNION ALL SELECT k, 'either' FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer)",
    "host_json": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) GROUP BY key",
    "host_pivot": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS finished, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY l_returnflag",
    "host_tumbling": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2",
    "host_sliding": "SELECT start, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT CAST(floor(epoch(ts) / 43200) * 43200 AS BIGINT) - 43200 * i AS start, CAST(round(value * 100) AS BIGINT) AS cents FROM events, (VALUES (0), (1)) v(i)) GROUP BY start",
    "host_sessions": "WITH m AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id",
    "host_star": "SELECT r_name, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}
