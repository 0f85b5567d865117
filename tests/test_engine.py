"""Declared tables, batches, indexes, subscriptions."""

import datetime as dt

import pytest

from tessera.artifacts import Artifacts
from tessera.operators.oplog import OpLog, OpLogError, contiguous_frontier
from tessera.operators.predicates import Constraint, Nanos, micros
from tessera.session import BatchWriter, Engine
from tessera.sources.log import LogError
from tessera.spec import ColumnSpec, IndexSpec, SpecError, TableSpec

ORDERS = TableSpec(
    "orders_kv",
    (ColumnSpec("region", "utf8"), ColumnSpec("customer_id", "int64"), ColumnSpec("order_id", "int64"), ColumnSpec("amount_cents", "int64"), ColumnSpec("status", "utf8")),
    ("order_id",),
    (IndexSpec("region_customer", ("region", "customer_id")),),
)
ROWS = [("us-east", 10, 1, 2999, "paid"), ("us-east", 11, 2, 2799, "open"), ("us-west", 10, 3, 500, "open"), ("eu", 12, 4, 100, "paid"), ("eu", 12, 5, 900, "open")]


@pytest.fixture
def engine(spark, root):
    e = Engine(spark, root)
    e.register(ORDERS)
    return e


def test_insert_query_overwrite(spark, engine):
    w = BatchWriter(engine)
    for r in ROWS:
        w.insert("orders_kv", r)
    assert w.flush() == 1
    q = "SELECT region, count(*) n, sum(amount_cents) s FROM orders_kv GROUP BY region"
    assert {tuple(r) for r in engine.sql(q).collect()} == {("us-east", 2, 5798), ("us-west", 1, 500), ("eu", 2, 1000)}
    assert engine.insert_sql("orders_kv", "VALUES ('eu', 12, 5, 1, 'paid')") == 1
    assert engine.sql("SELECT amount_cents FROM orders_kv WHERE order_id = 5").collect()[0][0] == 1
    assert engine.sql("SELECT amount_cents FROM orders_kv WHERE order_id = 5", at=1).collect()[0][0] == 900
    with pytest.raises(LogError):
        engine.sql("SELECT 1", min_seq=9)


def test_backfill_in_chunks_and_resumed(spark, engine):
    engine.insert({"orders_kv": spark.createDataFrame(ROWS, [c.name for c in ORDERS.columns])})
    events = []

    def stop_after_first(event):
        events.append(event)
        if event.get("next") == 2:
            raise InterruptedError

    with pytest.raises(InterruptedError):
        engine.backfill("orders_kv", stop_after_first, chunk_bounds=[2, 4])
    assert engine.backfill("orders_kv", events.append, chunk_bounds=[2, 4], start_from=events[-1]["next"]) == ["region_customer"]
    assert [e["event"] for e in events] == ["started", "progress", "started", "progress", "completed"] and events[-1]["rows"] == 5
    assert engine.scan("orders_kv", [Constraint("region", "=", "eu")], ["order_id"]).count() == 2


def test_rejected_rows(spark, engine):
    w = BatchWriter(engine)
    with pytest.raises(SpecError):
        w.insert("orders_kv", (1, 2))
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, [c.name for c in ORDERS.columns])
    with pytest.raises(SpecError):
        engine.insert({"orders_kv": rows.withColumn("status", F.lit(None).cast("string"))})
    with pytest.raises(ValueError):
        engine.insert({"orders_kv": rows.filter("order_id < 0")})
    assert engine.log.current() == 0


def test_index_paths(spark, engine):
    engine.insert({"orders_kv": spark.createDataFrame(ROWS, [c.name for c in ORDERS.columns])})
    engine.evolve("orders_kv", [*ORDERS.indexes, IndexSpec("z", ("customer_id", "amount_cents"), ("status",), "z_order")])
    events = []
    assert engine.backfill("orders_kv", events.append) == ["region_customer", "z"]
    assert engine.backfill("orders_kv") == [] and [e["event"] for e in events] == ["started", "completed"] * 2
    cases = [
        ([Constraint("region", "=", "eu")], ["order_id", "customer_id"], "covering", {(4, 12), (5, 12)}),
        ([Constraint("region", "=", "eu"), Constraint("status", "=", "open")], ["order_id", "amount_cents"], "lookup", {(5, 900)}),
        ([Constraint("customer_id", "between", (10, 11)), Constraint("amount_cents", ">", 600)], ["order_id", "status"], "covering", {(1, "paid"), (2, "open")}),
        ([Constraint("order_id", "=", 3)], ["order_id", "region"], "primary", {(3, "us-west")}),
        ([Constraint("region", "=", None)], ["order_id", "region"], "empty", set()),
    ]
    for cs, cols, mode, want in cases:
        assert engine.explain_access_path("orders_kv", cs, cols).mode == mode
        assert {tuple(r) for r in engine.scan("orders_kv", cs, cols).collect()} == want
    with pytest.raises(SpecError):
        engine.evolve("orders_kv", [])
    assert engine.tables()[0]["indexes"][1]["layout"] == "z_order"


@pytest.mark.parametrize(
    "make",
    [
        lambda: TableSpec("t", (), ("a",)),
        lambda: TableSpec("t", (ColumnSpec("a", "int64"),), ()),
        lambda: TableSpec("t", (ColumnSpec("a", "float64"),), ("a",)),
        lambda: TableSpec("t", (ColumnSpec("a", "int64"), ColumnSpec("a", "int64")), ("a",)),
        lambda: TableSpec("t", (ColumnSpec("a", "map"),), ("a",)),
        lambda: TableSpec("t", (ColumnSpec("a", "utf8"),), ("a",), (IndexSpec("i", ("a",), layout="z_order"),)),
        lambda: TableSpec("t", (ColumnSpec("a", "int64"), ColumnSpec("b", "int64", True)), ("a",), (IndexSpec("i", ("b",)),)),
        lambda: TableSpec("t", (ColumnSpec("a", "int64"),), ("a",), (IndexSpec("i", ("a",), ("a",)),)),
        lambda: TableSpec("t", (ColumnSpec("a", "decimal(40,2)"),), ("a",)),
    ],
)
def test_spec_rules(make):
    with pytest.raises(SpecError):
        make()


def test_subscription_replays_resumes_and_fails(spark, root, engine):
    rows = spark.createDataFrame(ROWS, [c.name for c in ORDERS.columns])
    for i in (1, 2, 3):
        engine.insert({"orders_kv": rows.filter(f"order_id = {i}")})
    seen = []

    def run(since, where="amount_cents > 600", cp="cp"):
        q = engine.subscribe("orders_kv", where, lambda s, df: seen.append((s, sorted(r.order_id for r in df.collect()))), f"{root}/{cp}", since, once=True)
        q.awaitTermination()
        return q

    run(1)
    assert seen == [(1, [1]), (2, [2])]
    engine.insert({"orders_kv": rows.filter("order_id >= 4")})
    run(1)
    assert seen[2:] == [(4, [5])]
    run(None, cp="live")
    assert len(seen) == 3
    engine.log.retain("keep_latest", 1)
    with pytest.raises(Exception, match="EVICTED|evicted"):
        run(1, cp="late")
    with pytest.raises(Exception, match="nothing"):
        run(4, "nothing > 1", cp="bad")


def test_oplog(spark):
    ops = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", None), (3, "c", 4), (4, "a", 5)], "location long, key string, value int")
    log = OpLog(ops, batches=spark.createDataFrame([(1,), (4,)], "location long"))
    assert {(r.key, r.value) for r in log.active(2).collect()} == {("b", 2)}
    assert {(r.key, r.next_key) for r in log.successors(4).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    entries, more, after = log.key_range(4, "a", "z", 2)
    assert ([r.key for r in entries.collect()], more, after) == (["a", "b"], True, "c")
    with pytest.raises(OpLogError):
        log.key_range(4, limit=0)
    with pytest.raises(OpLogError):
        log.require(5)
    with pytest.raises(OpLogError):
        log.require(3, boundary=True)
    log.require(4, boundary=True)
    with pytest.raises(OpLogError):
        log.get_many_at(spark.createDataFrame([("a",), ("a",)], "key string"), 3)
    gap = OpLog(ops.filter("location <> 1"))
    with pytest.raises(OpLogError):
        gap.operations(0, 3)


@pytest.mark.parametrize("spans,want", [([], 0), ([(0, 3), (3, 5), (7, 9)], 5), ([(1, 4)], 0), ([(0, 9), (2, 3), (9, 10)], 10)])
def test_frontier(spark, spans, want):
    assert contiguous_frontier(spark.createDataFrame(spans, "start long, end long")).first().frontier == want


def test_predicates(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 1.0), (2, nan), (3, None), (4, inf), (5, -0.0)], "i int, v double")
    ids = lambda c: {r.i for r in df.filter(c.to_column()).collect()}
    assert ids(Constraint("v", ">", 0.5)) == {1, 4}
    assert ids(Constraint("v", "<=", nan)) == set()
    assert ids(Constraint("v", "=", 0.0)) == {5}
    assert ids(Constraint("v", "in", [None])) == set()
    assert ids(Constraint("v", "in", [1.0, None, 1.0])) == {1}
    assert ids(Constraint("v", "is_null")) == {3}
    base = dt.datetime(1970, 1, 1)
    us = lambda n: base + dt.timedelta(microseconds=n)
    assert micros("<", Nanos(1500)) == ("<=", us(1)) and micros(">=", Nanos(1500)) == (">=", us(2))
    assert micros("=", Nanos(1500)) == ("=", None) and micros("=", Nanos(2000)) == ("=", us(2)) and micros(">", Nanos(-500)) == (">=", us(0))


def test_codecs(spark):
    from pyspark.sql import functions as F

    from tessera.functions.scalars import float_key, int_key, text_key, u64_key

    ints = [-(2**63), -1, 0, 1, 2**63 - 1]
    floats = [float("-inf"), -1.5, -0.0, 0.0, 2.0, float("inf")]
    texts = ["", "\x00", "\x00a", "a", "a\x00", "aa", "é"]
    from decimal import Decimal

    u64 = [Decimal(x) for x in (0, 1, 2**32, 2**63, 2**64 - 1)]
    for values, kind, f in ((ints, "long", int_key), (floats, "double", float_key), (texts, "string", text_key), (u64, "decimal(20,0)", u64_key)):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        keys = [bytes(r.k) for r in df.select("i", f(F.col("v")).alias("k")).orderBy("i").collect()]
        assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_artifacts(spark, root):
    a = Artifacts(spark, root)
    h, b = b"\x01" * 32, b"\x02" * 32
    a.upload(headers=[(h, b"head")], blocks=[(b, b"block")])
    a.upload(notarized=[(7, h, b"n7")], finalized=[(7, 3, h, b"f3")])
    a.upload(headers=[(b, b"head2")], finalized=[(9, 4, b, b"f4")])
    assert (a.by_digest("header", h), a.by_digest("block", h), a.by_digest("block", b)) == (b"head", None, b"block")
    assert (a.by_position("notarized", 7), a.by_position("finalized_by_view", 9), a.by_position("finalized_by_height", 3)) == (b"n7", b"f4", b"f3")
    assert a.latest_finalized() == (4, b"f4") and a.mismatched("notarized").count() == 0
    with pytest.raises(ValueError):
        a.upload(notarized=[(1, b"\x09", b"")])


def test_workload(spark, root):
    from tessera import workload
    from tessera.sources.kv import KvStore

    e = workload.entries(spark, 200)
    s = KvStore(spark, root)
    s.put_frame(e.select("key", "value"))
    assert workload.differences(s.state(), e).count() == 0
    assert workload.differences(s.state(), e.filter("id < 150")).filter("kind = 'unexpected'").count() == 50
    ops = workload.operations(spark, 5000, 100, "balanced")
    share = {r.op: r["count"] / 5000 for r in ops.groupBy("op").count().collect()}
    assert all(abs(share[k] - v) < 0.03 for k, v in zip(("read", "write", "scan"), workload.MIXES["balanced"], strict=True))


def test_indexes_follow_the_table(spark, engine):
    names = [c.name for c in ORDERS.columns]
    engine.evolve("orders_kv", [IndexSpec("region_customer", ("region", "customer_id"), ()), IndexSpec("by_region", ("region",), ("amount_cents",)), IndexSpec("z", ("customer_id", "amount_cents"), (), "z_order")])
    engine.insert({"orders_kv": spark.createDataFrame(ROWS, names)})
    engine.backfill("orders_kv")
    engine.insert({"orders_kv": spark.createDataFrame([("us-east", 11, 4, 150, "paid"), ("eu", 13, 6, 700, "open")], names)})
    asked = [([Constraint("region", "=", "eu")], ["order_id", "amount_cents"]), ([Constraint("region", "=", "eu")], ["order_id", "status"]), ([Constraint("customer_id", ">=", 11), Constraint("amount_cents", "<", 800)], ["order_id"])]

    def check(e, at=None):
        for cs, columns in asked:
            where = " AND ".join(f"{c.column} {c.op} '{c.value}'" if isinstance(c.value, str) else f"{c.column} {c.op} {c.value}" for c in cs)
            want = {tuple(r) for r in e.sql(f"SELECT {', '.join(columns)} FROM orders_kv WHERE {where}", at=at).collect()}
            assert {tuple(r) for r in e.scan("orders_kv", cs, columns, at=at).collect()} == want

    check(engine)
    check(engine, at=1)
    again = Engine(spark, engine.root)
    again.register(engine.specs["orders_kv"])
    assert again.explain_access_path("orders_kv", *asked[0]).mode == "covering"
    check(again)
    again.reindex("orders_kv")
    again.insert({"orders_kv": spark.createDataFrame([("eu", 20, 1, 1, "open")], names)})
    check(again)
    check(again, at=2)  # before the projections: read from the table
    again.log.retain("drop_all")
    again.compact()
    check(again)
    assert again.sql("SELECT * FROM orders_kv").count() == 6


def test_admission_and_one_scan_a_batch(spark, root, engine):
    rows = spark.createDataFrame(ROWS, [c.name for c in ORDERS.columns])
    for i in range(1, 6):
        engine.insert({"orders_kv": rows.filter(f"order_id = {i}")})
    seen = []

    def handle(seq, df):
        seen.append((int(df.inputFiles()[0].split("/frames/")[1].split("/")[0]), seq))  # the micro-batch, and the batch
        assert [r.order_id for r in df.collect()] == [seq]

    q = engine.subscribe("orders_kv", "true", handle, f"{root}/two", since=1, once=True, max_batches=2)
    q.awaitTermination()
    assert seen == [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)]
    engine.insert({"orders_kv": rows.filter("order_id = 1").replace(1, 6, ["order_id"])})
    engine.insert({"orders_kv": rows.filter("order_id = 1").replace(1, 7, ["order_id"])})
    engine.insert({"orders_kv": rows.filter("order_id = 1").replace(1, 8, ["order_id"])})
    seen.clear()
    engine.subscribe("orders_kv", "true", handle, f"{root}/two", since=1, once=True, max_batches=2).awaitTermination()
    assert seen == [(3, 6), (3, 7), (4, 8)]


def test_batches_are_prepared_staged_and_marked(spark, engine):
    w = BatchWriter(engine)
    assert w.prepare() is None and w.flush() is None
    w.insert("orders_kv", ROWS[0])
    batch = w.stage(w.prepare())
    assert engine.log.current() == 0
    with pytest.raises(ValueError):
        w.stage(batch)
    w.mark_failed(batch)
    with pytest.raises(ValueError):
        w.commit(batch)
    w.insert("orders_kv", ROWS[1])
    publish, engine.log.publish = engine.log.publish, lambda staged: 1 / 0
    with pytest.raises(ZeroDivisionError):
        w.flush()
    engine.log.publish = publish
    assert len(w.failed) == 2 and w.flush() == 2 and not w.failed
    assert [(r.seq, r.order_id) for r in engine.log.read("orders_kv").orderBy("seq").collect()] == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        w.mark_failed(w.mark_persisted(batch, None) or batch)


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as N

    from tessera.sources import tables

    conf = N(get=lambda *a: None)
    cluster = N(conf=conf, sparkContext=N(master="spark://host:7077", getConf=lambda: conf, applicationId="a"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(cluster)


def test_written_tables_are_forgotten(spark):
    from tessera.sources.tables import forget, materialize

    df = materialize(spark.range(5), "some")
    path = df.inputFiles()[0].removeprefix("file://")
    import os

    assert os.path.exists(path)
    forget(df)
    assert not os.path.exists(path)


def test_policies_in_one_pass(spark):
    from tessera.operators.prune import PrunePolicy, Retain, apply

    keys = [b"a" + bytes([i, j]) for i in range(3) for j in range(4)] + [b"b" + (v & (1 << 64) - 1).to_bytes(8, "big") for v in (-5, -1, 3, 9)] + [b"c" + v.to_bytes(8, "big") for v in (1, 2, 3)] + [b"d1", b"e", b"a"]
    state = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    rx = r"(?s-u)^(?P<v>.{8})$"
    policies = [PrunePolicy(b"a", r"(?s-u)^(?P<g>.)(?P<v>.)$", Retain("keep_latest", 2), ("g",), ("v", "bytes")), PrunePolicy(b"b", rx, Retain("keep_latest", 1), (), ("v", "i64_be")), PrunePolicy(b"c", rx, Retain("at_least", 2), (), ("v", "u64_be")), PrunePolicy(b"d", ".*", Retain("drop_all"))]
    got = sorted(bytes(r.key) for r in apply(state, policies).collect())
    assert got == sorted([b"a" + bytes([i, j]) for i in range(3) for j in (2, 3)] + [b"b" + (9).to_bytes(8, "big")] + [b"c" + v.to_bytes(8, "big") for v in (2, 3)] + [b"e", b"a"])


def test_covering_scan_sorts_only_keys_it_found(spark, engine):
    """Rows written since that meet no constraint in any version are not folded; those that leave or enter are."""
    from pyspark.sql import functions as F

    spec = TableSpec("t", (ColumnSpec("id", "int64"), ColumnSpec("a", "int64"), ColumnSpec("b", "int64")), ("id",), (IndexSpec("by_a", ("a",), ("b",), "z_order"),))
    engine.register(spec)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, a long, b long")
    engine.insert({"t": rows((1, 5, 0), (2, 5, 0), (3, 9, 0))})
    engine.backfill("t")
    engine.insert({"t": rows((2, 9, 1), (3, 5, 1), (4, 5, 1), (5, 9, 1))})
    engine.insert({"t": rows((4, 9, 2), (6, 5, 2))})
    got = engine.scan("t", [Constraint("a", "=", 5)], ["id", "b"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0), (3, 1), (6, 2)]
    folded = engine._latest("t", 1, where=F.col("a") == 5)
    assert sorted(r.id for r in folded.collect()) == [3, 4, 6]
