"""Scans, ranges, predicates and index paths over the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.scalars import int_key, morton, text_key, unmorton
from ..operators.predicates import Constraint, Nanos, composite_key, conjunction, disjunction
from ..session import Engine
from ..sources.kv import KvStore
from ..sources.tables import by_ranges, shared_dir
from ..spec import ColumnSpec, IndexSpec, TableSpec
from .common import Registry, table

R = Registry()

ORDERS = TableSpec(
    "orders",
    (ColumnSpec("o_orderkey", "int64"), ColumnSpec("o_custkey", "int64"), ColumnSpec("o_orderstatus", "utf8"), ColumnSpec("o_totalprice", "float64"), ColumnSpec("o_orderdate", "timestamp"), ColumnSpec("o_orderpriority", "utf8")),
    ("o_orderkey",),
    (IndexSpec("status_cust", ("o_orderstatus", "o_custkey"), ("o_totalprice",)), IndexSpec("cust", ("o_custkey",)), IndexSpec("cust_price_z", ("o_custkey", "o_totalprice"), ("o_orderpriority",), "z_order")),
)


@R.add("SELECT * FROM orders WHERE o_orderkey = 42")
def s1_point_get(spark, d):
    return table(spark, d, "orders").filter(Constraint("o_orderkey", "=", 42).to_column())


@R.add("SELECT k.key::BIGINT AS o_orderkey, o.o_custkey, o.o_orderkey IS NOT NULL AS found FROM (VALUES (1), (7), (-5), (42), (999999999)) k(key) LEFT JOIN orders o ON o.o_orderkey = k.key")
def s2_get_many_with_missing(spark, d):
    """Keys in order-preserving bytes; the asked ones with their values, null where they are absent."""
    as_key = lambda c: F.concat(F.lit(bytearray(b"o")), int_key(F.col(c)))
    s = KvStore(spark, shared_dir(spark))
    s.put_frame(table(spark, d, "orders").select(as_key("o_orderkey").alias("key"), F.encode(F.col("o_custkey").cast("string"), "UTF-8").alias("value")))
    asked = spark.createDataFrame([(k,) for k in (1, 7, -5, 42, 999999999)], "o_orderkey long").withColumn("key", as_key("o_orderkey"))
    got = s.get_many(asked)
    return got.select("o_orderkey", F.decode("value", "UTF-8").cast("long").alias("o_custkey"), F.col("value").isNotNull().alias("found"))


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 ORDER BY o_orderkey LIMIT 50")
def s3_range_forward(spark, d):
    rows = table(spark, d, "orders").filter(Constraint("o_orderkey", "between", (100, 900)).to_column())
    return rows.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(50)


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 ORDER BY o_orderkey DESC LIMIT 50")
def s4_range_reverse_limit(spark, d):
    rows = table(spark, d, "orders").filter(Constraint("o_orderkey", "between", (100, 900)).to_column())
    return rows.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_orderkey")).limit(50)


@R.add("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')")
def s5_prefix_scan(spark, d):
    return table(spark, d, "pages").filter(Constraint("url", "prefix", "https://").to_column()).select("page_id", "url")


@R.add("SELECT conv_id, turn, role FROM conversations WHERE conv_id >= 5 AND conv_id <= 40 AND role <> 'system'")
def s9_pk_scan(spark, d):
    where = composite_key(["conv_id", "turn"], [], 5, 40) & Constraint("role", "<>", "system").to_column()
    return table(spark, d, "conversations").filter(where).select("conv_id", "turn", "role")


_engines: dict[tuple, Engine] = {}


def _engine(spark, d, index: str) -> Engine:
    """The table with this index, which is built once an application and folder."""
    key = (spark.sparkContext.applicationId, d, index)
    if key not in _engines:
        e = Engine(spark, shared_dir(spark))
        e.register(ORDERS, table(spark, d, "orders"))
        e.backfill("orders", only=index)
        _engines[key] = e
    return _engines[key]


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_custkey BETWEEN 10 AND 60 AND o_totalprice >= 1000")
def s10_covering_index(spark, d):
    cs = [Constraint("o_orderstatus", "=", "O"), Constraint("o_custkey", "between", (10, 60)), Constraint("o_totalprice", ">=", 1000.0)]
    e = _engine(spark, d, "status_cust")
    assert e.explain_access_path("orders", cs, ["o_orderkey", "o_totalprice"]).mode == "covering"
    return e.scan("orders", cs, ["o_orderkey", "o_totalprice"])


@R.add("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_custkey IN (3, 33, 77)")
def s11_index_lookup(spark, d):
    cs = [Constraint("o_custkey", "in", [3, 33, 77, 33, None])]
    e = _engine(spark, d, "cust")
    assert e.explain_access_path("orders", cs).mode == "lookup"
    return e.scan("orders", cs, ["o_orderkey", "o_orderpriority", "o_orderdate"])


@R.add("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey BETWEEN 20 AND 90 AND o_totalprice BETWEEN 50000 AND 150000")
def s12_z_order_box(spark, d):
    cs = [Constraint("o_custkey", "between", (20, 90)), Constraint("o_totalprice", "between", (50000.0, 150000.0))]
    e = _engine(spark, d, "cust_price_z")
    assert e.explain_access_path("orders", cs, ["o_orderkey", "o_orderpriority"]).path == "cust_price_z"
    return e.scan("orders", cs, ["o_orderkey", "o_orderpriority"])


@R.add("SELECT o_orderkey FROM orders WHERE o_custkey > 10 AND o_custkey < 5")
def s13_contradiction(spark, d):
    return table(spark, d, "orders").filter(conjunction([Constraint("o_custkey", ">", 10), Constraint("o_custkey", "<", 5)])).select("o_orderkey")


@R.add("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey <= 300 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def s14_insert_overwrites(spark, d):
    """Two batches; rows of the second replace those with the same key."""
    e = Engine(spark, shared_dir(spark))
    e.register(TableSpec("orders", ORDERS.columns, ORDERS.primary_key))
    rows = table(spark, d, "orders")
    e.insert({"orders": rows})
    e.insert({"orders": rows.filter("o_orderkey <= 300").withColumn("o_orderstatus", F.lit("Z"))})
    return e.sql("SELECT * FROM orders")


@R.add("SELECT 1::BIGINT AS seq, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderkey % 2 <> 0")
def s21_log_batches(spark, d):
    """Each batch of the log by its number."""
    e = Engine(spark, shared_dir(spark))
    e.register(TableSpec("orders", ORDERS.columns, ORDERS.primary_key))
    rows = table(spark, d, "orders")
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 <> 0"):
        e.insert({"orders": rows.filter(part)})
    got = e.log.get(1, "orders").unionByName(e.log.get(2, "orders"))
    return got.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT event_id, value FROM events WHERE value > 50 AND event_id <> 17 AND event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def p2_compare_each_type(spark, d):
    at = lambda day: dt.datetime(2024, 1, day)
    cs = [Constraint("value", ">", 50.0, True), Constraint("event_id", "<>", 17), Constraint("event_type", "=", "purchase"), Constraint("ts", ">=", at(10)), Constraint("ts", "<", at(20))]
    return table(spark, d, "events").filter(conjunction(cs)).select("event_id", "value")


@R.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 2, 3, 5, 8, 13, 21)")
def p5_in_dedup_null(spark, d):
    cs = [Constraint("o_orderstatus", "in", ["F", None, "P", "F"]), Constraint("o_custkey", "in", [1, 2, 3, 5, 8, 13, 21, 21])]
    return table(spark, d, "orders").filter(conjunction(cs)).select("o_orderkey", "o_orderstatus")


@R.add("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '5-LOW'")
def p6_or_to_in(spark, d):
    cs = [Constraint("o_orderpriority", "=", v) for v in ("1-URGENT", "5-LOW")]
    return table(spark, d, "orders").filter(disjunction(cs)).select("o_orderkey")


R.sql("p7_is_null", "documents labels", "SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.toxic IS NOT NULL")


@R.add("SELECT o_orderkey FROM orders WHERE o_custkey = NULL")
def p8_equals_null(spark, d):
    return table(spark, d, "orders").filter(Constraint("o_custkey", "=", None).to_column()).select("o_orderkey")


_NAN = "CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"


@R.add(f"SELECT event_id FROM (SELECT event_id, {_NAN} AS v FROM events) t WHERE v > 20 AND NOT isnan(v)")
def p12_nan_guard(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_NAN).alias("v"))
    return rows.filter(Constraint("v", ">", 20.0, True).to_column()).select("event_id")


@R.add("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def p11_nanosecond_literal(spark, d):
    """A bound half a microsecond before midnight: the first whole microsecond after it is midnight, excluded below."""
    half = int(dt.datetime(2024, 1, 15, tzinfo=dt.timezone.utc).timestamp()) * 10**9 + 500
    return table(spark, d, "events").filter(Constraint("ts", ">", Nanos(half)).to_column()).select("event_id", "ts")


@R.add("SELECT p_partkey FROM part WHERE substr(sha256(p_name), 1, 2) = '1f' OR encode(p_brand) = encode('Brand#23')")
def p13_binary_literal(spark, d):
    rows = table(spark, d, "part").withColumn("b", F.encode("p_brand", "UTF-8")).withColumn("h", F.substring(F.unhex(F.sha2("p_name", 256)), 1, 1))
    return rows.filter(Constraint("h", "=", bytearray(b"\x1f")).to_column() | Constraint("b", "=", bytearray(b"Brand#23")).to_column()).select("p_partkey")


@R.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount BETWEEN 0.02 AND 0.04")
def p14_between(spark, d):
    cs = [Constraint("l_quantity", "between", (10.0, 12.0), True), Constraint("l_discount", "between", (0.02, 0.04), True)]
    return table(spark, d, "lineitem").filter(conjunction(cs)).select("l_orderkey", "l_linenumber", "l_quantity")


R.sql("p15_residual_filter", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000 AND length(l_returnflag || l_linestatus) = 2 AND l_shipdate IS NOT NULL")


@R.add("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 11 AND turn BETWEEN 1 AND 3")
def p16_composite_prefix(spark, d):
    return table(spark, d, "conversations").filter(composite_key(["conv_id", "turn"], [11], 1, 3)).select("conv_id", "turn", "role")


@R.add("SELECT page_id FROM pages WHERE starts_with(url, 'http') AND regexp_matches(url, '/(en|de)/[0-9]+')")
def p18_selector(spark, d):
    """Keys by prefix and a pattern on the rest of their bytes."""
    from ..operators.predicates import Selector

    rows = table(spark, d, "pages").withColumn("key", F.encode("url", "UTF-8"))
    return rows.filter(Selector(b"http", r"(?s-u)/(en|de)/[0-9]+").to_column()).select("page_id")


@R.add("SELECT event_id FROM events WHERE props = '{\"k\": 7}' OR starts_with(props, '{\"k\": 1') OR regexp_matches(props, '9\\}$')")
def p19_value_filters(spark, d):
    from ..operators.predicates import Selector, ValueFilter, stream_filter

    rows = table(spark, d, "events").select("event_id", F.encode("event_type", "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("value"))
    values = [ValueFilter("exact", b'{"k": 7}'), ValueFilter("prefix", b'{"k": 1'), ValueFilter("regex", r"9\}$")]
    return rows.filter(stream_filter([Selector(b"")], values)).select("event_id")


@R.add("SELECT p_partkey, p_size, (p_partkey % 1024)::BIGINT AS a, p_size::BIGINT AS b FROM part")
def f8_morton_round_trip(spark, d):
    """Interleaved and taken apart again."""
    code = morton([F.col("p_partkey") % 1024, F.col("p_size")], 10)
    a, b = unmorton(F.col("z"), 2, 10)
    return table(spark, d, "part").withColumn("z", code).select("p_partkey", "p_size", a.alias("a"), b.alias("b"))


@R.add("SELECT p_partkey, (row_number() OVER (ORDER BY p_name, p_partkey))::BIGINT AS rn FROM part WHERE p_size < 20")
def f9_key_codec_order(spark, d):
    """Rows numbered by the bytes of (name, key) are in the order of the values."""
    return _by_key(table(spark, d, "part").filter("p_size < 20"))


@R.add("SELECT p_partkey, (row_number() OVER (ORDER BY p_name, p_partkey))::BIGINT AS rn FROM part")
def f9_key_codec_order_whole(spark, d):
    """All parts, of any size."""
    return _by_key(table(spark, d, "part"))


def _by_key(part):
    """Numbered inside ranges of the keys, on top of the ranges before."""
    from pyspark.sql import Window

    rows = part.select("p_partkey", F.concat(text_key(F.col("p_name")), int_key(F.col("p_partkey"))).alias("k"))
    dealt, order = by_ranges(rows, "k", label="by_key"), Window.orderBy("_p")  # a row a range
    sums = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select(F.col("_p").alias("_q"), (F.sum("_n").over(order) - F.col("_n")).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("k"))
    numbered = dealt.withColumn("_i", own).join(F.broadcast(sums), F.col("_p") == F.col("_q"))
    return numbered.select("p_partkey", (F.col("_base") + F.col("_i")).cast("long").alias("rn"))


@R.add("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS host FROM pages")
def f10_capture(spark, d):
    from ..functions.scalars import capture

    rows = table(spark, d, "pages")
    return rows.select("page_id", F.decode(capture(F.encode("url", "UTF-8"), r"^[a-z]+://([^/]+)/", 1), "UTF-8").alias("host"))
