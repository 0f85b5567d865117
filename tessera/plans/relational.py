"""Joins, windows, sorts, set operations, subqueries and scalar functions, by Spark SQL and the DataFrame API."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import Registry, table

R = Registry()

R.sql("j1_inner", "customer orders", "SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F'")
R.sql("j2_three_way", "customer orders nation", "SELECT n.n_name, c.c_custkey, o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2")
R.sql("j3_left_is_null", "customer orders", "SELECT c.c_custkey, c.c_name FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
R.sql("j4_join_group_order", "customer orders nation", "SELECT n.n_name, count(*) AS orders, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name ORDER BY total DESC")
for kind in ("RIGHT", "FULL"):
    R.sql(f"j5_{kind.lower()}", "customer orders", f"SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) c {kind} JOIN (SELECT * FROM orders WHERE o_orderkey % 5 = 0) o ON c.c_custkey = o.o_custkey")
    # both sides whole; rows without a partner come from the price
    R.sql(f"j5_{kind.lower()}_whole", "customer orders", f"SELECT c.c_custkey, o.o_orderkey FROM customer c {kind} JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
R.sql("j5_cross", "region nation", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
R.sql("j5_semi", "customer orders", "SELECT c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 400000)")
R.sql("j5_anti", "customer orders", "SELECT c_custkey FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 200000)")
R.sql("j5_theta", "supplier nation", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND s.s_acctbal > n.n_nationkey * 300")
R.sql("j5_using", "orders lineitem", "SELECT o_orderkey, l_linenumber, l_quantity FROM (SELECT o_orderkey, o_orderstatus FROM orders) JOIN (SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity FROM lineitem) USING (o_orderkey) WHERE o_orderstatus = 'P'")
R.sql("j5_natural", "nation region", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")


@R.add("SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j6_lookup_semi_join(spark, d):
    keys = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


_W = "PARTITION BY user_id ORDER BY event_id"
R.sql(
    "w1_window_functions",
    "events",
    f"""SELECT event_id, user_id, CAST(row_number() OVER ({_W}) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS rk,
 CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS dr, CAST(ntile(4) OVER ({_W}) AS BIGINT) AS nt,
 lag(event_id) OVER ({_W}) AS prev, lead(event_id, 2) OVER ({_W}) AS next2,
 first_value(event_id) OVER ({_W}) AS first_id, nth_value(event_id, 2) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id,
 last_value(event_id) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM events""",
)
R.sql("w1_frames", "events", f"SELECT event_id, count(*) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n4, max(event_id) OVER ({_W} RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) - min(event_id) OVER ({_W} RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS span FROM events")

R.sql("t1_order_by", "customer", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey")
R.sql("t2_limit", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey < 100 ORDER BY o_orderkey LIMIT 7")
R.sql("t3_offset", "events", "SELECT event_id, ts FROM events ORDER BY ts DESC LIMIT 20 OFFSET 30")
R.sql("t4_topk_desc", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
R.sql("t4_topk_after_equality", "conversations", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7 ORDER BY turn DESC LIMIT 2")

R.sql("u1_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
R.sql("u1_union_all", "customer supplier", "SELECT c_nationkey AS k, 'c' AS t FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
R.sql("u2_intersect", "customer orders", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
R.sql("u2_intersect_all", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
R.sql("u2_except", "customer orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
R.sql("u2_except_all", "customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
R.sql("u3_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
R.sql("u4_cte", "orders", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT b.o_custkey, b.n FROM big b JOIN top t ON b.n >= t.m - 3")
R.sql("u4_recursive_cte", "nation", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT r.n, nation.n_name FROM r JOIN nation ON nation.n_nationkey = r.n")
R.sql("u4_scalar_subquery", "customer orders", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c")
R.sql("u4_in_exists", "customer orders nation", "SELECT c_custkey FROM customer c WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
R.sql("u5_values", "nation", "SELECT v.k, v.label, n.n_name FROM (VALUES (1, 'one'), (2, 'two'), (99, 'none')) AS v(k, label) LEFT JOIN nation n ON n.n_nationkey = v.k")


@R.add("SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 1 AND 40 OR o_custkey BETWEEN 30 AND 60")
def u7_multi_range_dedup(spark, d):
    """Overlapping ranges, each row once."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return rows.filter("o_custkey BETWEEN 1 AND 40").union(rows.filter("o_custkey BETWEEN 30 AND 60")).dropDuplicates(["o_orderkey"])


@R.add("SELECT event_id, event_id * 3 + user_id - 7 AS a, event_id / 4 AS q, CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_id / (user_id % 5) END AS safe FROM events")
def f1_f2_arithmetic(spark, d):
    from ..functions.scalars import arithmetic as op

    e, u = F.col("event_id"), F.col("user_id")
    a = op("-", op("+", op("*", e, F.lit(3)), u), F.lit(7))
    return table(spark, d, "events").select("event_id", a.alias("a"), op("/", e, F.lit(4)).alias("q"), op("/", e, u % 5, lenient=True).alias("safe"))


R.sql("f3_lower", "documents", "SELECT doc_id, lower(text) AS low FROM documents")


@R.add("SELECT event_id, date_trunc('day', ts - INTERVAL 55 YEAR) AS day, CAST(ts AS DATE) AS same FROM events")
def f4_date_trunc(spark, d):
    from ..functions.scalars import day

    rows = table(spark, d, "events").withColumn("old", F.expr("ts - INTERVAL 55 YEAR")).withColumn("dd", F.col("ts").cast("date"))
    return rows.select("event_id", day(F.col("old"), "timestamp").alias("day"), day(F.col("dd"), "date32").alias("same"))


R.sql("f5_cast", "lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS STRING) AS s, TRY_CAST(l_returnflag AS INT) AS bad FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS VARCHAR) AS s, TRY_CAST(l_returnflag AS INT) AS bad FROM lineitem")
R.sql("f6_case", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS code, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS class FROM orders")
R.sql(
    "f7_functions",
    "customer events pages",
    "SELECT c_custkey, upper(c_mktsegment) AS u, substr(c_name, 10) AS tail, abs(c_acctbal) AS a, coalesce(nullif(c_nationkey, 3), -1) AS k, concat(c_mktsegment, '-', c_name) AS cc, regexp_replace(c_name, '[0-9]', '#') AS rr, floor(c_acctbal) AS fl FROM customer",
    "SELECT c_custkey, upper(c_mktsegment) AS u, substr(c_name, 10) AS tail, abs(c_acctbal) AS a, coalesce(nullif(c_nationkey, 3), -1) AS k, concat(c_mktsegment, '-', c_name) AS cc, regexp_replace(c_name, '[0-9]', '#', 'g') AS rr, CAST(floor(c_acctbal) AS BIGINT) AS fl FROM customer",
)
R.sql("f7_json", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
