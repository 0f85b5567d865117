"""Versions, operation logs, pruning and live batches over the tables."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from ..artifacts import Artifacts
from ..operators.oplog import OpLog, OpLogError, contiguous_frontier
from ..operators.predicates import Selector, ValueFilter
from ..operators.prune import PrunePolicy, Retain, UpdatePolicy, apply, keep_latest_versions
from ..operators.versioned import exact, keep_latest, latest_at
from ..session import Engine
from ..sources.kv import KvStore
from ..sources.tables import shared_dir
from ..spec import ColumnSpec, TableSpec
from ..streaming.subscribe import subscribe_log
from .common import Registry, table

R = Registry()


def log(spark, d) -> OpLog:
    """events as a log: location event_id, key user_id, value (null where an error deletes), batches of 100."""
    e = table(spark, d, "events")
    ops = e.select(F.col("event_id").alias("location"), F.col("user_id").alias("key"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return OpLog(ops, batches=ops.groupBy(F.floor(F.col("location") / 100)).agg(F.max("location").alias("location")))


_LATEST = """SELECT user_id AS key, event_id AS location, CASE WHEN event_type <> 'error' THEN value END AS value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id <= {}) t WHERE rn = 1"""


@R.add("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 9 AND turn <= 2 ORDER BY turn DESC LIMIT 1")
def t5_latest_leq(spark, d):
    return table(spark, d, "conversations").filter("conv_id = 9 AND turn <= 2").select("conv_id", "turn", "role").orderBy(F.desc("turn")).limit(1)


@R.add("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE turn <= 2) t WHERE rn = 1")
def j8_latest_leq_all(spark, d):
    """The latest version not above 2 of every key."""
    return latest_at(table(spark, d, "conversations"), ["conv_id"], "turn", 2)


@R.add("SELECT * FROM conversations WHERE conv_id = 4 AND turn = 1")
def v1_exact_version(spark, d):
    return exact(table(spark, d, "conversations"), {"conv_id": 4}, "turn", 1)


@R.add("SELECT event_type, max(event_id) AS event_id FROM events GROUP BY event_type")
def t6_latest_record(spark, d):
    return latest_at(table(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id")


@R.add("SELECT max(event_id) AS location FROM events")
def q1_watermark(spark, d):
    return spark.createDataFrame([(log(spark, d).watermark(),)], "location long")


@R.add(f"SELECT k.key::BIGINT AS key, l.location, l.value FROM (VALUES (1), (2), (3), (10), (50), (100000)) k(key) LEFT JOIN ({_LATEST.format(700)}) l ON l.key = k.key")
def q2_query_many_at(spark, d):
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 10, 50, 100000)], "key long")
    return log(spark, d).get_many_at(keys, 700)


@R.add("SELECT event_id AS location, user_id AS key, CASE WHEN event_type <> 'error' THEN value END AS value FROM events WHERE event_id = 321")
def q3_keyless_get(spark, d):
    return log(spark, d).operations(321, 1)


@R.add("SELECT event_id AS location, user_id AS key, CASE WHEN event_type <> 'error' THEN value END AS value FROM events WHERE event_id >= 200 AND event_id < 260")
def q4_operation_range(spark, d):
    return log(spark, d).operations(200, 60)


@R.add(f"SELECT * FROM ({_LATEST.format(900)}) t WHERE value IS NOT NULL")
def q5_active_state(spark, d):
    return log(spark, d).active(900)


@R.add(f"SELECT * FROM ({_LATEST.format(900)}) t WHERE value IS NOT NULL AND location >= 400")
def q5_active_above_floor(spark, d):
    return log(spark, d).active(900, floor=400)


@R.add(f"SELECT *, true AS has_more FROM ({_LATEST.format(900)}) t WHERE value IS NOT NULL AND key >= 20 AND key < 90 ORDER BY key LIMIT 10")
def q6_key_range(spark, d):
    entries, more, _ = log(spark, d).key_range(900, 20, 90, 10)
    return entries.withColumn("has_more", F.lit(more))


@R.add(f"SELECT r.pos, r.key::BIGINT AS key, l.value IS NOT NULL AS hit, l.value FROM (VALUES (0, 5), (1, 2), (2, 77777), (3, 9)) r(pos, key) LEFT JOIN ({_LATEST.format(900)}) l ON l.key = r.key AND l.value IS NOT NULL")
def q7_multi_key_lookup(spark, d):
    """In the order of the request; a request that names a key twice is refused."""
    one = log(spark, d)
    try:
        one.lookup(spark.createDataFrame([(0, 5), (1, 5)], "pos int, key long"), 900)
        raise AssertionError("a key was asked for twice")
    except OpLogError:
        return one.lookup(spark.createDataFrame([(0, 5), (1, 2), (2, 77777), (3, 9)], "pos int, key long"), 900)


@R.add("SELECT b.location FROM (SELECT max(event_id) AS location FROM events GROUP BY event_id // 100) b WHERE b.location BETWEEN 150 AND 900")
def q8_boundaries(spark, d):
    """Ends of batches; a question at another location is refused."""
    one = log(spark, d)
    one.require(899, boundary=True)
    try:
        one.require(898, boundary=True)
        raise AssertionError("898 ends no batch")
    except OpLogError:
        return one.boundaries(150, 900)


@R.add("SELECT * FROM conversations WHERE turn >= 2")
def q11_keep_positions_gte(spark, d):
    return UpdatePolicy("keep_positions_gte", 2).apply(table(spark, d, "conversations"), "conv_id", "turn")


@R.add("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn <= 2")
def q11_keep_latest_updates(spark, d):
    return UpdatePolicy("keep_latest_updates", 2).apply(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id")


_KEYS = f"WITH a AS (SELECT key FROM ({_LATEST.format(900)}) t WHERE value IS NOT NULL), l AS (SELECT key, coalesce(lead(key) OVER (ORDER BY key), (SELECT min(key) FROM a)) AS next_key FROM a)"


@R.add(f"{_KEYS} SELECT key, next_key FROM l WHERE (key >= 20 AND key < 40) OR (key < 20 AND 20 < next_key) OR (next_key <= key AND (20 > key OR 20 < next_key))")
def q6_range_evidence(spark, d):
    """The links that show which keys of a range are active, and that no other is."""
    return log(spark, d).links(900, 20, 40)


@R.add("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn <= 3")
def w2_keep_latest_n(spark, d):
    return keep_latest(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], "event_id", 3)


@R.add(_LATEST.format(5000))
def w3_latest_row_at(spark, d):
    return latest_at(log(spark, d).ops, ["key"], "location", 5000).select("key", "location", "value")


@R.add(f"WITH a AS (SELECT key FROM ({_LATEST.format(900)}) t WHERE value IS NOT NULL) SELECT key, coalesce(lead(key) OVER (ORDER BY key), (SELECT min(key) FROM a)) AS next_key FROM a")
def w4_cyclic_successor(spark, d):
    return log(spark, d).successors(900)


_NOW = _LATEST.format("(SELECT max(event_id) FROM events)")


@R.add(_NOW)
def w3_latest_row_now(spark, d):
    """Over the whole log: at its own watermark, as are the next two."""
    at = log(spark, d)
    return latest_at(at.ops, ["key"], "location", at.watermark()).select("key", "location", "value")


@R.add(f"WITH a AS (SELECT key FROM ({_NOW}) t WHERE value IS NOT NULL) SELECT key, coalesce(lead(key) OVER (ORDER BY key), (SELECT min(key) FROM a)) AS next_key FROM a")
def w4_cyclic_successor_now(spark, d):
    at = log(spark, d)
    return at.successors(at.watermark())


@R.add(f"SELECT * FROM ({_NOW}) t WHERE value IS NOT NULL")
def q5_active_state_now(spark, d):
    at = log(spark, d)
    return at.active(at.watermark())


@R.add("WITH s AS (SELECT event_id AS s, event_id + 1 + event_id % 3 AS e FROM events WHERE event_id % 50 < 48 OR event_id < 300), r AS (SELECT *, greatest(0, coalesce(max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach FROM s) SELECT coalesce((SELECT min(reach) FROM r WHERE s > reach), (SELECT max(e) FROM s))::BIGINT AS frontier")
def w5_contiguous_frontier(spark, d):
    acks = table(spark, d, "events").filter("event_id % 50 < 48 OR event_id < 300").selectExpr("event_id AS start", "event_id + 1 + event_id % 3 AS end")
    return contiguous_frontier(acks)


def _state(spark, d):
    """events as versioned keys: 'e', user, ':', version in eight bytes; 'x' keys of another form between them."""
    user, ver = F.format_string("e%d:", F.col("user_id")), F.lpad(F.hex("event_id"), 16, "0")
    key = F.when(F.col("event_type") == "signup", F.encode(F.format_string("x%d", F.col("event_id")), "UTF-8")).otherwise(F.concat(F.encode(user, "UTF-8"), F.unhex(ver)))
    return table(spark, d, "events").select("event_id", key.alias("key"))


_REGEX = r"(?s-u)^(?P<user>[0-9]+):(?P<version>.{8})$"


@R.add("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type = 'signup', user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE event_type = 'signup' OR rn <= 2")
def m2_keep_latest_n(spark, d):
    """The two latest versions of each entity; keys that do not match the pattern stay (m4)."""
    p = PrunePolicy(b"e", _REGEX, Retain("keep_latest", 2), ("user",), ("version", "u64_be"))
    return apply(_state(spark, d), [p]).select("event_id")


@R.add("SELECT event_id FROM events WHERE event_type = 'signup' OR event_id > 400")
def m2_threshold_gt(spark, d):
    return apply(_state(spark, d), [PrunePolicy(b"e", _REGEX, Retain("greater_than", 400), ("user",), ("version", "u64_be"))]).select("event_id")


@R.add("SELECT event_id FROM events WHERE event_type = 'signup' OR event_id >= 400")
def m2_threshold_gte(spark, d):
    return apply(_state(spark, d), [PrunePolicy(b"e", _REGEX, Retain("at_least", 400), ("user",), ("version", "u64_be"))]).select("event_id")


@R.add("SELECT event_id FROM events WHERE event_type = 'signup'")
def m4_nonmatching_retained(spark, d):
    return apply(_state(spark, d), [PrunePolicy(b"e", _REGEX, Retain("drop_all"))]).select("event_id")


@R.add("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) t WHERE rn <= 2")
def m6_keep_latest_versions(spark, d):
    return keep_latest_versions(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 2)


def _store(spark, d) -> KvStore:
    """events in three batches: key is the type and eight bytes of id, value the properties."""
    s = KvStore(spark, shared_dir(spark))
    rows = table(spark, d, "events").select("event_id", F.concat(F.encode(F.concat("event_type", F.lit(":")), "UTF-8"), F.unhex(F.lpad(F.hex("event_id"), 16, "0"))).alias("key"), F.encode("props", "UTF-8").alias("value"))
    for part in range(3):
        s.put_frame(rows.filter(F.col("event_id") % 3 == part).select(F.col("event_id").alias("ord"), "key", "value"))
    return s


@R.add("SELECT event_id::BIGINT AS event_id FROM events WHERE event_type = 'purchase' AND event_id BETWEEN 200 AND 700")
def s3_kv_range(spark, d):
    """A range of raw keys, both ends inclusive."""
    at = lambda i: b"purchase:" + struct.pack(">Q", i)
    got = _store(spark, d).range(at(200), at(700))
    return got.select(F.conv(F.hex(F.substr("key", F.lit(10))), 16, 10).cast("long").alias("event_id"))


@R.add("SELECT event_id % 3 + 1 AS seq, count(*) AS n FROM events WHERE event_type = 'click' AND regexp_matches(props, '[13579]\\}$') GROUP BY 1")
def r1_log_filter(spark, d):
    """What a subscription from the first batch on is sent: key prefix and value pattern."""
    s = _store(spark, d)
    selectors, values = [Selector(b"click:")], [ValueFilter("regex", r"[13579]\}$")]
    out = f"{s.root}/frames"
    frame = lambda seq, df: df.write.mode("overwrite").parquet(f"{out}/frame={seq}")
    subscribe_log(spark, s.root, selectors, frame, f"{s.root}/checkpoint", values, since=1, once=True).awaitTermination()
    return spark.read.parquet(out).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


EVENTS = TableSpec("events", (ColumnSpec("event_id", "int64"), ColumnSpec("user_id", "int64"), ColumnSpec("event_type", "utf8"), ColumnSpec("value", "float64")), ("event_id",))


@R.add("SELECT event_id % 3 + 1 AS seq, event_id, user_id, event_type, value FROM events WHERE value > 60 AND event_type <> 'view' AND event_id % 3 >= 1")
def r6_sql_subscribe(spark, d):
    """Three batches, replayed from the second by a streaming query with a SQL predicate, a frame a batch."""
    root = shared_dir(spark)
    e = Engine(spark, root)
    e.register(EVENTS)
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for part in range(3):
        e.insert({"events": rows.filter(F.col("event_id") % 3 == part)})
    out = f"{root}/frames"
    q = e.subscribe("events", "value > 60 AND event_type <> 'view'", lambda seq, df: df.write.mode("overwrite").parquet(f"{out}/frame={seq}"), f"{root}/checkpoint", since=2, once=True)
    q.awaitTermination()
    return spark.read.parquet(out).select("seq", "event_id", "user_id", "event_type", "value")


@R.add("SELECT event_id FROM events WHERE event_id % 3 >= 1")
def r10_retention(spark, d):
    """The log keeps its last two batches; the state keeps everything."""
    s = _store(spark, d)
    s.retain("keep_latest", 2)
    left = s.log.read("kv").select(F.col("ord").alias("event_id"))
    total = s.state().count()
    return left.filter(F.lit(total) > 0)


@R.add("SELECT user_id AS digest_of, count(*) AS certificates FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def x3_certificate_join(spark, d):
    """Certificates joined to the header whose digest they name; one that names none is refused."""
    e, digest = table(spark, d, "events"), F.unhex(F.sha2(F.col("user_id").cast("string"), 256)).alias("digest")
    a = Artifacts(spark, shared_dir(spark))
    a.put({"header": e.select("user_id").distinct().select(digest, F.encode(F.col("user_id").cast("string"), "UTF-8").alias("payload"))})
    certs = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("position"), digest, F.encode("props", "UTF-8").alias("payload"))
    try:
        a.put({"notarized": certs.limit(1).withColumn("digest", F.encode(F.lit("none"), "UTF-8"))})
        raise AssertionError("no header has this digest")
    except ValueError:
        a.put({"notarized": certs})
    return a.certified("notarized").groupBy(F.decode("header", "UTF-8").cast("long").alias("digest_of")).agg(F.count(F.lit(1)).alias("certificates"))


@R.add("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, s")
def r11_sessions(spark, d):
    """Sessions by gaps of two hours (a pass-through of session_window)."""
    by = F.session_window(F.col("ts").cast("timestamp"), "2 hours")
    return table(spark, d, "events").groupBy("user_id", by.alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("w")


