"""Aggregations and grouped reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.reduce import Reducer, ReduceSpec, histogram, percentile_bounds, run, u64_sum
from .common import Registry, table

R = Registry()

FLAGSHIP = """
SELECT c.c_mktsegment AS segment, COUNT(*) AS order_count,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price,
       COUNT(CASE WHEN o.o_orderpriority IS NOT NULL THEN 1 END) AS with_priority
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus = 'O' AND o.o_totalprice BETWEEN 1000 AND 400000
GROUP BY c.c_mktsegment"""
R.sql("m0_flagship", "orders customer", FLAGSHIP)
_DEC = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

R.sql("a1_count", "lineitem", "SELECT count(*) AS n, count(1) AS one FROM lineitem")
R.sql("a2_count_expr", "documents labels", "SELECT count(l.quality) AS labelled, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
R.sql("a3_sum", "lineitem", f"SELECT CAST(sum(l_linenumber) AS BIGINT) AS i, {_DEC.format('l_extendedprice')} AS p FROM lineitem")


@R.add("SELECT CAST(sum(CAST(event_id AS HUGEINT) * 1000000007) AS BIGINT) AS s FROM events")
def a3_sum_u64(spark, d):
    """An exact unsigned 64-bit sum."""
    big = (F.col("event_id").cast("decimal(20,0)") * F.lit(1000000007)).cast("decimal(20,0)")
    return table(spark, d, "events").agg(u64_sum(big).cast("long").alias("s"))


R.sql("a4_min_max", "events", "SELECT min(event_id) AS a, max(event_id) AS b, min(ts) AS c, max(ts) AS d, min(event_type) AS e, max(event_type) AS f, min(value) AS g, max(value) AS h FROM events")
R.sql("a5_avg", "orders", "SELECT o_orderstatus, round(avg(o_custkey), 6) AS m, count(*) AS n FROM orders GROUP BY o_orderstatus")
R.sql("a6_filter", "events", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, max(event_id) FILTER (WHERE event_type = 'purchase') AS last FROM events GROUP BY user_id")
R.sql("a7_case_multi_when", "orders", "SELECT o_custkey, count(CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'P' THEN 1 END) AS open, CAST(sum(CASE o_orderstatus WHEN 'F' THEN o_orderkey END) AS BIGINT) AS f FROM orders GROUP BY o_custkey")
R.sql("a8_sum_case_one", "orders", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT) AS p, CAST(sum(CASE WHEN o_orderstatus = 'X' THEN 1 END) AS BIGINT) AS none FROM orders GROUP BY o_orderpriority")
R.sql("a9_group_by", "lineitem", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_DEC.format('l_quantity')} AS q, {_DEC.format('l_extendedprice')} AS p FROM lineitem GROUP BY l_returnflag, l_linestatus")
_DAY = "SELECT lower(event_type) AS kind, {0} AS day, count(*) AS n FROM events GROUP BY lower(event_type), {0}"
R.sql("a10_lower_day", "events", _DAY.format("CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ)"), _DAY.format("date_trunc('day', ts)"))
R.sql("a10_computed_keys", "lineitem", "SELECT CAST(l_quantity AS BIGINT) % 10 AS k, l_linenumber * 2 + 1 AS odd, count(*) AS n FROM lineitem GROUP BY CAST(l_quantity AS BIGINT) % 10, l_linenumber * 2 + 1")


@R.add("SELECT CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN 'NaN'::DOUBLE ELSE 0.0::DOUBLE END AS k, count(*) AS n FROM events GROUP BY 1")
def a11_float_keys(spark, d):
    """0.0 and -0.0 are one group, all NaN one, null one."""
    k = F.expr("CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN -0.0D ELSE 0.0D END")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.col("k") + 0.0)


R.sql("a12_group_seed", "events", "SELECT event_type, count(*) FILTER (WHERE value > 1000000) AS none FROM events GROUP BY event_type")
R.sql("a13_empty_global", "events", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s, max(ts) AS m, avg(value) AS a FROM events WHERE event_id < 0")


@R.add("SELECT lower(event_type) AS kind, count(*) AS n, count(value) AS v, min(event_id) AS lo, max(event_id) AS hi, round(avg(user_id), 6) AS mean, count(*) FILTER (event_id % 2 = 0) AS even FROM events WHERE event_id BETWEEN 100 AND 5000 GROUP BY 1")
def a15_reduce(spark, d):
    return _reduce(table(spark, d, "events"), F.col("event_id").between(100, 5000))


@R.add("SELECT lower(event_type) AS kind, count(*) AS n, count(value) AS v, min(event_id) AS lo, max(event_id) AS hi, round(avg(user_id), 6) AS mean, count(*) FILTER (event_id % 2 = 0) AS even FROM events GROUP BY 1")
def a15_reduce_whole(spark, d):
    """Over every id."""
    return _reduce(table(spark, d, "events"), None)


def _reduce(events, where):
    e = F.col("event_id")
    spec = ReduceSpec(
        (Reducer("count_all", "n"), Reducer("count", "v", F.col("value")), Reducer("min", "lo", e), Reducer("max", "hi", e), Reducer("avg", "mean", F.col("user_id")), Reducer("count_all", "even", where=e % 2 == 0)),
        (("kind", F.lower("event_type")),),
        where,
    )
    return run(events, spec).withColumn("mean", F.round("mean", 6))


@R.add("SELECT count(*) AS n, CAST(sum(event_id // (user_id % 5)) AS BIGINT) AS s FROM events WHERE user_id % 5 <> 0")
def a15_reduce_lenient(spark, d):
    """Rows whose expression fails (here a division by zero) are dropped."""
    from ..functions.scalars import arithmetic

    q = arithmetic("/", F.col("event_id"), F.col("user_id") % 5, lenient=True)
    return run(table(spark, d, "events"), ReduceSpec((Reducer("count_all", "n"), Reducer("sum", "s", F.floor(q))), lenient=True, needs=(q,)))


@R.add("SELECT DISTINCT user_id % 10 AS g, event_type FROM events")
def a16_distinct_groups(spark, d):
    return run(table(spark, d, "events"), ReduceSpec(group_by=(("g", F.col("user_id") % 10), ("event_type", F.col("event_type")))))


R.sql("a17_count_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")


@R.add("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM events WHERE event_id <= 800 GROUP BY user_id")
def a17_ordered_aggregate(spark, d):
    return _ordered(table(spark, d, "events").filter("event_id <= 800"))


@R.add("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM events GROUP BY user_id")
def a17_ordered_aggregate_whole(spark, d):
    """All events, not those of the first ids."""
    return _ordered(table(spark, d, "events"))


def _ordered(events):
    rows = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("s"))
    return rows.select("user_id", F.array_join(F.transform("s", lambda x: x["event_type"]), ",").alias("kinds"))


_G = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, {} AS g FROM orders GROUP BY {}"
_GID = "CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS INT)"
R.sql("a18_rollup", "orders", _G.format(_GID, "ROLLUP (o_orderstatus, o_orderpriority)"))
R.sql("a18_cube", "orders", _G.format(_GID, "CUBE (o_orderstatus, o_orderpriority)"))
R.sql("a18_grouping_sets", "orders", _G.format(_GID, "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
R.sql("a18_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
R.sql("a18_statistics", "orders", "SELECT o_orderstatus, round(stddev_samp(o_custkey), 4) AS sd, round(var_pop(o_custkey), 2) AS vp, round(corr(o_custkey, o_orderkey), 6) AS r FROM orders GROUP BY o_orderstatus")


@R.add("SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
def a18_approximate(spark, d):
    """Approximate distinct counts and medians lie near the exact ones."""
    rows = table(spark, d, "lineitem")
    # a sketch a flag: beside a distinct count there would be one of each flag and part
    near = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.percentile_approx("l_quantity", 0.5, 10000).alias("m"))
    parts = rows.select(F.col("l_returnflag").alias("f"), "l_partkey").distinct().groupBy("f").agg(F.count("l_partkey").alias("e"))
    counts = rows.groupBy(F.col("l_returnflag").alias("g"), "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    middles = counts.groupBy("g").agg(F.percentile("l_quantity", 0.5, F.col("n")).alias("x"))
    out = near.join(parts, F.col("l_returnflag").eqNullSafe(F.col("f"))).join(middles, F.col("l_returnflag").eqNullSafe(F.col("g")))
    return out.select("l_returnflag", ((F.abs(F.col("a") / F.col("e") - 1) < 0.1) & (F.abs(F.col("m") - F.col("x")) <= 1)).alias("close"))


_B = [10.0, 20.0, 50.0, 100.0]


@R.add("SELECT CASE WHEN value <= 10 THEN 10 WHEN value <= 20 THEN 20 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 END::DOUBLE AS bound, count(*) AS n FROM events GROUP BY 1")
def a19_histogram(spark, d):
    return histogram(table(spark, d, "events"), "value", _B)


@R.add(
    """WITH h AS (SELECT CASE WHEN value <= 10 THEN 10 WHEN value <= 20 THEN 20 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 END::DOUBLE AS b, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT b, sum(n) OVER (ORDER BY b NULLS LAST) AS run, sum(n) OVER () AS total FROM h)
SELECT s AS share, arg_min(b, run) AS bound FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE)) t(s) WHERE run >= s * total GROUP BY s"""
)
def a19_percentile_bounds(spark, d):
    return percentile_bounds(table(spark, d, "events"), "value", _B, [0.25, 0.5])
