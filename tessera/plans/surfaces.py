"""The engine's surfaces over the tables: stores, sessions, writers, indexes that follow, subscriptions, proofs.

Where an operator answers with a refusal, the query returns the code of the refusal as a row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from ..artifacts import Artifacts
from ..functions.scalars import int_key
from ..operators import proofs
from ..operators.oplog import OpLog
from ..operators.predicates import Constraint, Selector, ValueFilter
from ..operators.prune import PolicyError, PrunePolicy, Retain
from ..session import BatchWriter, Engine
from ..sources import files
from ..sources.kv import KvStore, WriteBatch
from ..sources.log import LogError
from ..sources.tables import materialize, shared_dir
from ..sources.upload import OpLogWriter, Poisoned, verify_batches
from ..spec import ColumnSpec, SpecError, TableSpec
from ..streaming.subscribe import stream, subscribe_operations, subscribe_records
from .common import Registry, table
from .scans import ORDERS
from .versions import _LATEST, _REGEX, EVENTS, _state, _store, log

R = Registry()
UPLOAD = 5000  # operations of an uploaded batch
TOGETHER = 500  # uploaded batches that a micro-batch takes


def refusal(f, *errors) -> str:
    """What ``f`` is refused with, or ``ok``."""
    try:
        f()
    except errors or (LogError, ValueError) as e:
        return getattr(e, "code", type(e).__name__)
    return "ok"


def rows_of(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


# stores


@R.add("SELECT 'range' AS asked, (rn - 1) // 100 AS page, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) AS rn FROM events WHERE event_type = 'purchase') t GROUP BY 2 UNION ALL SELECT 'nothing', 0, 0")
def s6_frames(spark, d):
    """A range in pages of 100 keys; a range without keys is one empty page."""
    s = _store(spark, d)
    asked = {"range": s.prefix(b"purchase:"), "nothing": s.prefix(b"zz")}
    out = None
    for name, rows in asked.items():
        found = s.pages(rows, 100).groupBy("page").agg(F.count(F.lit(1)).alias("n"))
        first = spark.range(1).select(F.lit(name).alias("asked"), F.col("id").alias("page"))  # there is always one
        got = found.withColumn("asked", F.lit(name)).join(first, ["asked", "page"], "full")
        got = got.select("asked", "page", F.coalesce("n", F.lit(0)).alias("n"))
        out = got if out is None else out.unionByName(got)
    return out


@R.add("SELECT * FROM (VALUES (1::BIGINT, 'ok'), (3, 'ok'), (4, 'CONSISTENCY_NOT_READY')) t(min_seq, outcome)")
def s7_freshness(spark, d):
    s = _store(spark, d)
    return rows_of(spark, [(n, refusal(lambda n=n: s.get(b"none", min_seq=n))) for n in (1, 3, 4)], "min_seq long, outcome string")


@R.add("SELECT event_id FROM events WHERE event_id % 3 <= 1")
def s8_session_after_retention(spark, d):
    """A session keeps the snapshot of its first read, whatever is written and trimmed after it."""
    s = KvStore(spark, shared_dir(spark))
    rows = table(spark, d, "events").select("event_id", int_key(F.col("event_id")).alias("key"), F.encode("props", "UTF-8").alias("value"))
    for part in (0, 1):
        s.put_frame(rows.filter(F.col("event_id") % 3 == part).select("key", "value"))
    session = s.session()
    session.get(b"none")
    s.put_frame(rows.withColumn("value", F.encode(F.lit("new"), "UTF-8")).select("key", "value"))
    s.retain("keep_latest", 1)
    return session.range().join(rows, ["key", "value"]).select("event_id")


@R.add("SELECT 'before the base' AS snapshot, 'BATCH_EVICTED' AS outcome UNION ALL SELECT 'now', 'ok'")
def s8_snapshot_of_reclaimed_batches(spark, d):
    """What a compacted and trimmed log cannot give any more is refused."""
    s = _store(spark, d)
    s.retain("keep_latest", 1)
    s.compact()
    got = [(name, refusal(lambda at=at: s.state(at).count())) for name, at in (("before the base", 1), ("now", None))]
    return rows_of(spark, got, "snapshot string, outcome string")


@R.add("SELECT * FROM (VALUES ('a key of 254 bytes', 'ok'), ('a key of 255 bytes', 'ValueError'), ('nothing', 'ValueError')) t(entry, outcome)")
def s17_put(spark, d):
    s = KvStore(spark, shared_dir(spark))
    puts = {"a key of 254 bytes": [(b"x" * 254, b"")], "a key of 255 bytes": [(b"x" * 255, b"")], "nothing": []}
    return rows_of(spark, [(name, refusal(lambda kvs=kvs: s.put(kvs))) for name, kvs in puts.items()], "entry string, outcome string")


@R.add("SELECT ns, r_name AS name, 1::BIGINT AS seq FROM region, (VALUES ('a'), ('b')) t(ns)")
def s18_cross_namespace(spark, d):
    """Entries of two namespaces in one batch, under one number."""
    s, batch = KvStore(spark, shared_dir(spark)), WriteBatch()
    for r in table(spark, d, "region").toLocalIterator():
        for ns in (b"a", b"b"):
            batch.push(s.namespace(ns), str(r.r_regionkey).encode(), r.r_name.encode())
    batch.commit()
    return s.state().select(F.decode(F.substr("key", F.lit(1), F.lit(1)), "UTF-8").alias("ns"), F.decode("value", "UTF-8").alias("name"), "seq")


# writers

NATIONS = TableSpec("nations", (ColumnSpec("n_nationkey", "int64"), ColumnSpec("n_name", "utf8")), ("n_nationkey",))


def _nations(spark, d) -> tuple[BatchWriter, list[tuple]]:
    e = Engine(spark, shared_dir(spark))
    e.register(NATIONS)
    return BatchWriter(e), [(r.n_nationkey, r.n_name) for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]


@R.add("SELECT CASE WHEN n_nationkey < 10 THEN 1 ELSE 2 END::BIGINT AS seq, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def s15_batch_writer(spark, d):
    """A batch that failed is published first by the next flush, under a number of its own."""
    w, rows = _nations(spark, d)
    for r in rows[:10]:
        w.insert("nations", r)
    w.mark_failed(w.stage(w.prepare()))
    for r in rows[10:]:
        w.insert("nations", r)
    w.flush()
    return w.engine.log.read("nations").select("seq", "n_nationkey", "n_name")


@R.add("SELECT 'staged' AS step, 0::BIGINT AS n UNION ALL SELECT 'published', count(*) FROM nation")
def s19_staged_publication(spark, d):
    """prepare, stage, commit, mark: staged rows are seen by nobody, published ones by all."""
    w, rows = _nations(spark, d)
    for r in rows:
        w.insert("nations", r)
    batch, seen = w.stage(w.prepare()), {}
    seen["staged"] = w.engine.sql("SELECT * FROM nations").count()
    w.mark_persisted(batch, w.commit(batch))
    seen["published"] = w.engine.sql("SELECT * FROM nations").count()
    return rows_of(spark, list(seen.items()), "step string, n long")


# indexes

_followed: dict[tuple, Engine] = {}


def _after_backfill(spark, d) -> Engine:
    """orders: the even ones are indexed, then the odd ones are written and rows up to 300 replaced; once an
    application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _followed:
        e = Engine(spark, shared_dir(spark))
        e.register(ORDERS)
        rows = table(spark, d, "orders")
        e.insert({"orders": rows.filter("o_orderkey % 2 = 0")})
        events = []

        def stop(event):
            events.append(event)
            if event.get("next") == 500:
                raise InterruptedError

        try:  # broken off, and gone on with
            e.backfill("orders", stop, only="status_cust", chunk_bounds=[500, 1000])
        except InterruptedError:
            e.backfill("orders", only="status_cust", chunk_bounds=[500, 1000], start_from=events[-1]["next"])
        e.backfill("orders")
        e.insert({"orders": rows.filter("o_orderkey % 2 <> 0")})
        moved = rows.filter("o_orderkey <= 300").withColumns({"o_orderstatus": F.lit("Z"), "o_custkey": F.col("o_custkey") + 1, "o_totalprice": F.col("o_totalprice") + 1000})
        e.insert({"orders": moved})
        # another engine of the same folder finds the projections
        again = Engine(spark, e.root)
        again.register(ORDERS)
        _followed[key] = again
    return _followed[key]


_MOVED = "(SELECT o_orderkey, CASE WHEN o_orderkey <= 300 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey <= 300 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey <= 300 THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders) m"


def _followed_scan(spark, d, cs, columns, path, mode):
    e = _after_backfill(spark, d)
    found = e.explain_access_path("orders", cs, columns)
    assert (found.path, found.mode) == (path, mode), str(found)
    return e.scan("orders", cs, columns)


@R.add(f"SELECT o_orderkey, o_custkey, o_totalprice FROM {_MOVED} WHERE o_orderstatus = 'Z' AND o_custkey >= 3")
def s10_covering_index_follows(spark, d):
    return _followed_scan(spark, d, [Constraint("o_orderstatus", "=", "Z"), Constraint("o_custkey", ">=", 3)], ["o_orderkey", "o_custkey", "o_totalprice"], "status_cust", "covering")


@R.add(f"SELECT o_orderkey, o_custkey FROM {_MOVED} WHERE o_orderstatus IN ('F', 'O')")
def s20_backfill_resumed(spark, d):
    """The index that was broken off and resumed, with what was written since."""
    return _followed_scan(spark, d, [Constraint("o_orderstatus", "in", ["F", "O"])], ["o_orderkey", "o_custkey"], "status_cust", "covering")


@R.add(f"SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate FROM {_MOVED} WHERE o_custkey IN (3, 33, 77, 78)")
def s11_index_lookup_follows(spark, d):
    return _followed_scan(spark, d, [Constraint("o_custkey", "in", [3, 33, 77, 78])], ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"], "cust", "lookup")


@R.add(f"SELECT o_orderkey, o_orderpriority FROM {_MOVED} WHERE o_custkey BETWEEN 20 AND 90 AND o_totalprice BETWEEN 50000 AND 150000")
def s12_z_order_box_follows(spark, d):
    return _followed_scan(spark, d, [Constraint("o_custkey", "between", (20, 90)), Constraint("o_totalprice", "between", (50000.0, 150000.0))], ["o_orderkey", "o_orderpriority"], "cust_price_z", "covering")


@R.add(f"SELECT 'covering' AS mode, 'status_cust' AS path, true AS files_read, count(*) AS n FROM {_MOVED} WHERE o_orderstatus = 'Z' AND o_custkey >= 3")
def u6_explain_analyze(spark, d):
    """A scan's path, and what it read and gave."""
    e = _after_backfill(spark, d)
    got = e.explain_analyze("orders", [Constraint("o_orderstatus", "=", "Z"), Constraint("o_custkey", ">=", 3)], ["o_orderkey", "o_custkey", "o_totalprice"])
    read = bool(got["scans"]) and all(s["files"] > 0 for s in got["scans"])
    return rows_of(spark, [(got["path"].mode, got["path"].path, read, got["rows"])], "mode string, path string, files_read boolean, n long")


# files and declarations


@R.add("SELECT f AS format, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, min(o_orderdate) AS first FROM orders, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) t(f) GROUP BY f")
def s22_files(spark, d):
    """A table written and read back in each format, with its declared schema."""
    root, out = shared_dir(spark), None
    for form in ("parquet", "orc", "json", "csv"):
        options = {"header": True} if form == "csv" else {}
        files.write(table(spark, d, "orders").select(*[c.name for c in ORDERS.columns]), f"{root}/{form}", form, sort_by=["o_orderkey"], **options)
        got = files.read(spark, ORDERS, f"{root}/{form}", form).agg(F.lit(form).alias("format"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.min("o_orderdate").alias("first"))
        out = got if out is None else out.unionByName(got)
    return out


@R.add("SELECT * FROM (VALUES ('o_orderkey', 'int64', true), ('o_custkey', 'int64', false), ('o_orderstatus', 'utf8', false), ('o_totalprice', 'float64', false), ('o_orderdate', 'timestamp', false), ('o_orderpriority', 'utf8', false)) t(name, type, key)")
def s23_tables(spark, d):
    """What a client is told of a declared table."""
    e = Engine(spark, shared_dir(spark))
    e.register(ORDERS)
    (t,) = e.tables()
    return rows_of(spark, [(c["name"], c["type"], c["name"] in t["primary_key"]) for c in t["columns"]], "name string, type string, key boolean")


@R.add("SELECT p_partkey, p_size * 2 + 1 AS twice, n.n::BIGINT AS n FROM (SELECT p_partkey, p_size::BIGINT AS p_size FROM part) p, (VALUES (0), (1), (2)) n(n) WHERE n.n < p_size % 3")
def udf_functions(spark, d):
    """A pandas function and a table function that a client registers, used in SQL."""

    @pandas_udf("long")
    def twice_and_one(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    @udtf(returnType="n: bigint")
    class UpTo:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    e = Engine(spark, shared_dir(spark))
    e.register_function("twice_and_one", twice_and_one)
    e.register_function("up_to", UpTo)
    table(spark, d, "part").createOrReplaceTempView("part")
    return e.sql("SELECT p_partkey, twice_and_one(CAST(p_size AS BIGINT)) AS twice, n FROM part, LATERAL up_to(CAST(p_size % 3 AS INT))")


# subscriptions


def _parts(spark, d, n: int) -> tuple[Engine, str]:
    """events in ``n`` batches of a typed table."""
    root = shared_dir(spark)
    e = Engine(spark, root)
    e.register(EVENTS)
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for part in range(n):
        e.insert({"events": rows.filter(F.col("event_id") % n == part)})
    return e, root


def _frames(folder: str):
    return lambda seq, df: df.write.mode("overwrite").parquet(f"{folder}/frame={seq}")


@R.add("SELECT event_id % 3 + 1 AS seq, event_id FROM events WHERE value > 60 AND event_id % 3 >= 1 UNION ALL SELECT 4, event_id FROM events WHERE value > 60 AND event_id % 3 = 0")
def r2_replay_then_live(spark, d):
    """From the second batch on, and then what is written while the subscription runs."""
    e, root = _parts(spark, d, 3)
    q = e.subscribe("events", "value > 60", _frames(f"{root}/frames"), f"{root}/checkpoint", since=2)
    q.processAllAvailable()
    e.insert({"events": table(spark, d, "events").filter("event_id % 3 = 0").select("event_id", "user_id", "event_type", "value")})
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{root}/frames").select("seq", "event_id")


@R.add("SELECT * FROM (VALUES ('evicted', 'BATCH_EVICTED'), ('retained', 'ok'), ('beyond the frontier', 'ok'), ('a bad predicate', 'refused')) t(since, outcome)")
def r3_eviction(spark, d):
    """An evicted start fails; one beyond the frontier is live only (R4); a bad predicate ends the stream (R7)."""
    e, root = _parts(spark, d, 3)
    e.log.retain("keep_latest", 2)
    out = []
    for name, since, where in (("evicted", 1, "true"), ("retained", 2, "true"), ("beyond the frontier", 9, "true"), ("a bad predicate", 2, "nothing > 1")):
        try:
            e.subscribe("events", where, lambda seq, df: None, f"{root}/{name.replace(' ', '-')}", since, once=True).awaitTermination()
            out.append((name, "ok"))
        except Exception as error:
            out.append((name, "BATCH_EVICTED" if "BATCH_EVICTED" in str(error) else "refused"))
    return rows_of(spark, out, "since string, outcome string")


@R.add("SELECT 0::BIGINT AS micro_batch, seq::BIGINT AS seq FROM (VALUES (1), (2)) t(seq) UNION ALL SELECT 1, seq FROM (VALUES (3), (4)) t(seq) UNION ALL SELECT 2, 5")
def r5_admission(spark, d):
    """A replay of five batches comes two at a time, also after a restart."""
    e, root = _parts(spark, d, 5)
    seen = []

    def run(until: int) -> None:
        rows = stream(spark, root, "events", EVENTS.schema, since=1, max_batches=2, checkpoint=f"{root}/checkpoint", until=until)
        q = rows.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(lambda df, n: seen.extend((n, r.seq) for r in df.select("seq").distinct().collect())).start()
        q.processAllAvailable()
        q.stop()

    run(2)
    run(5)
    return rows_of(spark, seen, "micro_batch long, seq long")


def _uploaded(spark, d) -> OpLogWriter:
    """events as operations in order, in batches that tasks write; an error deletes its user's key."""
    w = OpLogWriter(spark, shared_dir(spark))
    rows = table(spark, d, "events").select("event_id", int_key(F.col("user_id")).alias("key"), F.when(F.col("event_type") != "error", F.encode("props", "UTF-8")).alias("value"))
    w.append_frame(rows, "event_id", UPLOAD)
    w.flush()
    return w


@R.add(f"SELECT event_id // {UPLOAD} + 1 AS seq, event_id AS location, true AS proven FROM events WHERE event_type <> 'error' AND starts_with(props, '{{\"k\": 1')")
def r8_operation_subscription(spark, d):
    """Operations by key and value filters, each batch with a proof against its head; many batches a micro-batch."""
    w = _uploaded(spark, d)
    root, out = w.log.root, f"{w.log.root}/frames"
    heads = materialize(w.log.history("watermark").select("first", "head"), "heads")

    def handle(number, rows, found):
        verify_batches(heads, rows, found).write.mode("overwrite").parquet(f"{out}/frame={number}")

    q = subscribe_operations(spark, root, handle, f"{root}/checkpoint", since=1, once=True, max_batches=TOGETHER, selectors=[Selector(b"")], values=[ValueFilter("prefix", b'{"k": 1')], prove=True, together=True)
    q.awaitTermination()
    return spark.read.parquet(out).select("seq", "location", "proven")


@R.add("SELECT CASE WHEN event_id % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS seq, event_id AS position FROM events WHERE event_type = 'purchase'")
def r9_record_subscription(spark, d):
    """Certificates as they are uploaded: headers first, then two batches."""
    root, digest = shared_dir(spark), F.unhex(F.sha2("event_type", 256)).alias("digest")
    e, a = table(spark, d, "events").filter("event_type = 'purchase'"), Artifacts(spark, root)
    a.put({"header": e.select(digest).distinct().withColumn("payload", F.lit(bytearray(b"head")))})
    for part in (0, 1):
        a.put({"notarized": e.filter(F.col("event_id") % 2 == part).select(F.col("event_id").alias("position"), digest, F.encode("props", "UTF-8").alias("payload"))})
    subscribe_records(spark, root, "notarized", _frames(f"{root}/frames"), f"{root}/checkpoint", since=1, once=True).awaitTermination()
    return spark.read.parquet(f"{root}/frames").select("seq", "position")


# retention


@R.add("SELECT event_id, user_id, event_type, value FROM events")
def r10_table_after_retention(spark, d):
    """Trimming the log takes nothing from a typed table, before and after its batches are folded into a base."""
    e, _ = _parts(spark, d, 3)
    e.log.retain("keep_latest", 1)
    before = e.sql("SELECT * FROM events").count()
    e.compact()
    after = e.sql("SELECT * FROM events")
    assert before == after.count()
    return after


@R.add("SELECT 4::BIGINT AS seq UNION ALL SELECT 5")
def r10_standing_retention(spark, d):
    """A policy that acts after each batch."""
    e, _ = _parts(spark, d, 2)
    e.log.set_retention("keep_latest", 2)
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for _ in range(3):
        e.insert({"events": rows})
    return rows_of(spark, [(s,) for s in e.log.sequences()], "seq long")


# operation logs


@R.add(f"SELECT key, location FROM ({_LATEST.format('(SELECT max(event_id) FROM events)')}) t WHERE value IS NOT NULL")
def q9_upload(spark, d):
    """Batches written ahead and published in order; a writer that failed is poisoned, the next one goes on."""
    w = _uploaded(spark, d)
    w.waiting.append((w.next, w.next + 1, w.pool.submit(lambda: 1 / 0)))
    assert refusal(w.flush, ZeroDivisionError) == "ZeroDivisionError" and refusal(lambda: w.append([(b"k", b"")]), Poisoned) == "Poisoned"
    w = OpLogWriter(spark, w.log.root)
    one = OpLog(w.operations(), watermarks=w.watermarks())
    alive = one.active(one.watermark())
    users = table(spark, d, "events").select("user_id").distinct().select(F.col("user_id").alias("user"), int_key(F.col("user_id")).alias("key"))
    return alive.join(users, "key").select(F.col("user").alias("key"), "location")


@R.add(f"SELECT key FROM ({_LATEST.format(900)}) t WHERE value IS NOT NULL AND key >= 20 AND key < 40")
def q10_proven_range(spark, d):
    """The active keys of a range, all of them, proven against a root; a key that is not there is proven absent."""
    act = log(spark, d).active(900)
    keyed = materialize(act.select(F.col("key").alias("user"), int_key(F.col("key")).alias("key"), F.encode(F.col("value").cast("string"), "UTF-8").alias("value")), "active")
    tree = proofs.KeyTree(keyed)
    users = {bytes(r.k): r.user for r in spark.range(19, 41).select(F.col("id").alias("user"), int_key(F.col("id")).alias("k")).collect()}
    of = {user: key for key, user in users.items()}
    root, found = tree.root(), tree.prove_range(of[20], of[40])
    inside = proofs.verify_range(root, found, of[20], of[40])
    for user in range(20, 40):
        if of[user] in inside:
            assert proofs.verify_keys(root, tree.prove([of[user]]))[of[user]] == inside[of[user]]
        else:
            proofs.verify_absent(root, tree.prove_absent(of[user]), of[user])
    assert proofs.frontier(tree.tree).root() == root
    return rows_of(spark, [(users[k],) for k in inside], "key long")


# artifacts


@R.add("SELECT r_regionkey::BIGINT AS position, 'header' AS kind, r_name AS payload FROM region UNION ALL SELECT r_regionkey, k, k || ' ' || r_name FROM region, (VALUES ('notarized'), ('finalized_by_view'), ('finalized_by_height')) t(k) UNION ALL SELECT max(r_regionkey) + 100, 'latest', 'finalized_by_height ' || max_by(r_name, r_regionkey) FROM region")
def x2_artifacts(spark, d):
    """Headers, and certificates by view and by height, uploaded in batches and asked for one by one."""
    a, out = Artifacts(spark, shared_dir(spark)), []
    regions = table(spark, d, "region").orderBy("r_regionkey").collect()
    digest = lambda r: b"%032d" % r.r_regionkey
    a.upload(headers=[(digest(r), r.r_name.encode()) for r in regions])
    kinds = {r: (f"notarized {r.r_name}".encode(), f"finalized_by_view {r.r_name}".encode(), f"finalized_by_height {r.r_name}".encode()) for r in regions}
    a.upload(notarized=[(r.r_regionkey, digest(r), kinds[r][0]) for r in regions])
    a.put({"finalized_by_view": rows_of(spark, [(r.r_regionkey, bytearray(digest(r)), bytearray(kinds[r][1])) for r in regions], "position long, digest binary, payload binary"), "finalized_by_height": rows_of(spark, [(r.r_regionkey + 100, bytearray(digest(r)), bytearray(kinds[r][2])) for r in regions], "position long, digest binary, payload binary")})
    for r in regions:
        out.append((r.r_regionkey, "header", a.by_digest("header", digest(r)).decode()))
        out += [(r.r_regionkey, k, a.by_position(k, r.r_regionkey + (100 if k == "finalized_by_height" else 0)).decode()) for k in ("notarized", "finalized_by_view", "finalized_by_height")]
    position, payload = a.latest_finalized()
    return rows_of(spark, [*out, (position, "latest", payload.decode())], "position long, kind string, payload string")


@R.add("SELECT * FROM (VALUES ('a block', 'ok'), ('a certificate of a header that is there', 'ok'), ('a certificate of no header', 'ValueError')) t(upload, outcome)")
def x1_upload(spark, d):
    a = Artifacts(spark, shared_dir(spark))
    tries = {
        "a block": lambda: a.upload(headers=[(b"h", b"head")], blocks=[(b"b", b"block")]),
        "a certificate of a header that is there": lambda: a.upload(finalized=[(7, 3, b"h", b"f3")]),
        "a certificate of no header": lambda: a.upload(notarized=[(1, b"none", b"")]),
    }
    return rows_of(spark, [(name, refusal(f)) for name, f in tries.items()], "upload string, outcome string")


# pruning


@R.add("SELECT * FROM (VALUES ('fine', 'ok'), ('no order', 'PolicyError'), ('none kept', 'PolicyError'), ('unknown capture', 'PolicyError'), ('threshold on bytes', 'PolicyError'), ('version 1', 'PolicyError'), ('overlap', 'PolicyError')) t(policy, outcome)")
def m3_validation(spark, d):
    order, latest = ("version", "u64_be"), Retain("keep_latest", 2)
    tries = {
        "fine": [PrunePolicy(b"e", _REGEX, latest, ("user",), order)],
        "no order": [PrunePolicy(b"e", _REGEX, latest, ("user",))],
        "none kept": [PrunePolicy(b"e", _REGEX, Retain("keep_latest", 0), ("user",), order)],
        "unknown capture": [PrunePolicy(b"e", _REGEX, latest, ("owner",), order)],
        "threshold on bytes": [PrunePolicy(b"e", _REGEX, Retain("at_least", 2), (), ("version", "bytes"))],
        "version 1": [PrunePolicy(b"e", _REGEX, latest, ("user",), order, 1)],
        "overlap": [PrunePolicy(b"e", _REGEX, Retain("drop_all")), PrunePolicy(b"ex", _REGEX, Retain("drop_all"))],
    }
    s = KvStore(spark, shared_dir(spark))
    s.put([(b"k", b"")])
    return rows_of(spark, [(name, refusal(lambda p=p: s.prune(p), PolicyError)) for name, p in tries.items()], "policy string, outcome string")


@R.add("SELECT event_id, 1::BIGINT AS seq FROM (SELECT *, row_number() OVER (PARTITION BY event_type = 'signup', user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE event_type = 'signup' OR rn <= 2")
def m5_prune_is_durable(spark, d):
    """Pruned twice, trimmed, and opened again: the same rows, and the log's number has not moved."""
    s = KvStore(spark, shared_dir(spark))
    s.put_frame(_state(spark, d).select("key", F.encode(F.col("event_id").cast("string"), "UTF-8").alias("value")))
    policy = PrunePolicy(b"e", _REGEX, Retain("keep_latest", 2), ("user",), ("version", "u64_be"))
    s.prune([policy])
    s.prune([policy])
    s.retain("keep_latest", 1)
    again = KvStore(spark, s.root)
    return again.state().select(F.decode("value", "UTF-8").cast("long").alias("event_id"), F.lit(again.log.current()).cast("long").alias("seq"))


@R.add("SELECT * FROM (VALUES ('twice', 'SpecError'), ('no key', 'SpecError'), ('fine', 'ok')) t(declared, outcome)")
def s14_declarations(spark, d):
    """Declarations that break a rule are refused."""
    tries = {
        "twice": lambda: TableSpec("t", (ColumnSpec("a", "int64"), ColumnSpec("a", "int64")), ("a",)),
        "no key": lambda: TableSpec("t", (ColumnSpec("a", "int64"),), ()),
        "fine": lambda: TableSpec("t", (ColumnSpec("a", "int64"),), ("a",)),
    }
    return rows_of(spark, [(name, refusal(f, SpecError)) for name, f in tries.items()], "declared string, outcome string")
