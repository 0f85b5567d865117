"""The key-value store against a dictionary, and its contracts."""

import random

import pytest

from tessera.operators.predicates import Selector, ValueFilter
from tessera.operators.prune import PolicyError, PrunePolicy, Retain
from tessera.operators.reduce import Reducer, ReduceError, ReduceSpec
from tessera.sources.kv import KvStore, WriteBatch, prefix_bounds
from tessera.sources.log import LogError


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def test_bounds_limit_and_order(spark, root):
    s = KvStore(spark, root)
    s.put([(b"a", b"1"), (b"b", b"2"), (b"c", b"3")])
    assert pairs(s.range(b"a", b"c")) == [(b"a", b"1"), (b"b", b"2"), (b"c", b"3")]
    assert pairs(s.range(b"b")) == [(b"b", b"2"), (b"c", b"3")]
    assert pairs(s.range(b"a", b"b", reverse=True)) == [(b"b", b"2"), (b"a", b"1")]
    assert pairs(s.range(limit=0)) == []
    assert pairs(s.range(reverse=True, limit=1)) == [(b"c", b"3")]
    assert list(s.frames(s.range(b"x"))) == [[]]
    assert [len(p) for p in s.frames(s.range(), 2)] == [2, 1]


def test_last_write_wins_and_snapshots(spark, root):
    s = KvStore(spark, root)
    assert s.put([(b"k", b"1"), (b"k", b"2")]) == 1
    session = s.session()
    assert session.get(b"k") == b"2"
    assert s.put([(b"k", b"3"), (b"\xff\x00", b"z")]) == 2
    assert (s.get(b"k"), session.get(b"k"), s.get(b"none")) == (b"3", b"2", None)
    got = {bytes(r.key): r.value and bytes(r.value) for r in s.get_many([b"k", b"no", b"\xff\x00"]).collect()}
    assert got == {b"k": b"3", b"no": None, b"\xff\x00": b"z"}
    with pytest.raises(LogError) as e:
        s.get(b"k", min_seq=3)
    assert e.value.code == "CONSISTENCY_NOT_READY"


def test_limits(spark, root):
    s = KvStore(spark, root)
    with pytest.raises(ValueError):
        s.put([])
    with pytest.raises(ValueError):
        s.put([(b"x" * 255, b"")])
    s.put([(b"x" * 254, b"")])
    with pytest.raises(ValueError):
        s.namespace(b"y").put([(b"x" * 254, b"")])
    assert s.get(b"x" * 254) == b""


def test_namespaces_and_atomic_batch(spark, root):
    s = KvStore(spark, root)
    a, b = s.namespace(b"a/"), s.namespace(b"b/")
    seq = WriteBatch().push(a, b"1", b"x").push(b, b"1", b"y").commit()
    assert (seq, a.get(b"1"), b.get(b"1")) == (1, b"x", b"y")
    assert pairs(a.range()) == [(b"1", b"x")]
    assert pairs(s.prefix(b"b/")) == [(b"b/1", b"y")]
    assert prefix_bounds(b"q")[1] == b"q" + b"\xff" * 253


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_dictionary(spark, root, seed):
    rng, model, s = random.Random(seed), {}, KvStore(spark, root)
    key = lambda: bytes(rng.choice([0, 1, 127, 128, 255]) for _ in range(rng.randint(0, 3)))
    for step in range(5):
        batch = [(key(), bytes([rng.randrange(256)])) for _ in range(12)]
        s.put(batch)
        model.update(batch)
        if step == 2:
            s.prune([PrunePolicy(b"\xff", "(?s-u).*", Retain("drop_all"))])
            model = {k: v for k, v in model.items() if not k.startswith(b"\xff")}
        if step == 3:
            s.retain("keep_latest", 1)
        lo, hi = sorted((key(), key()))
        assert pairs(s.range(lo, hi)) == sorted((k, v) for k, v in model.items() if k >= lo and (not hi or k <= hi))
    assert pairs(s.range()) == sorted(model.items())


def test_log_get_retention_and_eviction(spark, root):
    s = KvStore(spark, root)
    for i in range(4):
        s.put([(b"k%d" % i, b"v")])
    assert [bytes(r.key) for r in s.batch(2).collect()] == [b"k1"]
    with pytest.raises(LogError) as e:
        s.batch(9)
    assert e.value.code == "NOT_FOUND"
    assert s.retain("greater_than", 2) == 3
    assert s.retain("at_least", 1) == 3
    with pytest.raises(LogError) as e:
        s.batch(2)
    assert (e.value.code, e.value.oldest) == ("BATCH_EVICTED", 3)
    assert s.state().count() == 4
    assert s.retain("drop_all") == 5 and s.put([(b"n", b"")]) == 5


def test_prune_policies(spark, root):
    s = KvStore(spark, root)
    at = lambda e, v: b"d" + e + v.to_bytes(8, "big")
    s.put([(at(e, v), b"x") for e in (b"A", b"B") for v in (1, 2, 300)] + [(b"dshort", b""), (b"other", b"")])
    rx = r"(?s-u)^(?P<entity>.)(?P<version>.{8})$"
    policy = PrunePolicy(b"d", rx, Retain("keep_latest", 1), ("entity",), ("version", "u64_be"))
    s.prune([policy])
    want = sorted([at(b"A", 300), at(b"B", 300), b"dshort", b"other"])
    assert [k for k, _ in pairs(s.range())] == want
    s.prune([policy])
    assert [k for k, _ in pairs(s.range())] == want and s.log.current() == 1
    s.prune([PrunePolicy(b"d", rx, Retain("at_least", 300), order_by=("version", "u64_be"))])
    assert [k for k, _ in pairs(s.range())] == want
    s.prune([PrunePolicy(b"d", rx, Retain("greater_than", 300), order_by=("version", "u64_be"))])
    assert [k for k, _ in pairs(s.range())] == [b"dshort", b"other"]


@pytest.mark.parametrize(
    "bad",
    [
        [PrunePolicy(b"a", "(?P<x>.)", Retain("keep_latest", 0), (), ("x", "bytes"))],
        [PrunePolicy(b"a", "(?P<x>.)", Retain("keep_latest", 1))],
        [PrunePolicy(b"a", "(?P<x>.)", Retain("greater_than", 1), (), ("x", "bytes"))],
        [PrunePolicy(b"a", ".", Retain("drop_all"), ("y",))],
        [PrunePolicy(b"a", ".", Retain("drop_all"), version=1)],
        [PrunePolicy(b"a", ".", Retain("drop_all")), PrunePolicy(b"ab", ".", Retain("drop_all"))],
    ],
)
def test_policies_are_validated(spark, root, bad):
    s = KvStore(spark, root)
    s.put([(b"a", b"")])
    with pytest.raises(PolicyError):
        s.prune(bad)


def test_matching_and_reduce(spark, root):
    from pyspark.sql import functions as F

    s = KvStore(spark, root)
    s.put([(b"a1", b"x"), (b"b1", b"yy")])
    s.put([(b"a2", b"\x00\xff")])
    got = s.matching([Selector(b"a", "[0-9]$")], [ValueFilter("exact", b"x"), ValueFilter("regex", r"(?s-u)\xff$")], since=1)
    assert [(r.seq, bytes(r.key)) for r in got.orderBy("seq").collect()] == [(1, b"a1"), (2, b"a2")]
    spec = ReduceSpec((Reducer("count_all", "n"), Reducer("sum", "bytes", F.length("value"))))
    assert tuple(s.reduce(spec, b"a", b"a9").first()) == (2, 3)
    assert tuple(s.reduce(spec, b"q").first()) == (0, None)
    with pytest.raises(ReduceError):
        s.reduce(ReduceSpec())
    with pytest.raises(ValueError):
        s.matching([])


def test_snapshots_after_retention(spark, root):
    s = KvStore(spark, root)
    for i in range(4):
        s.put([(b"k%d" % i, b"v"), (b"k", b"%d" % i)])
    session = s.session()
    assert session.get(b"k") == b"3"
    s.put([(b"k", b"new")])
    s.retain("keep_latest", 1)
    assert len(pairs(session.range())) == 5 and session.get(b"k") == b"3" and s.get(b"k") == b"new"
    assert pairs(s.range(at=2)) == [(b"k", b"1"), (b"k0", b"v"), (b"k1", b"v")]
    s.compact()  # what bases hold is deleted
    assert s.state().count() == 5 and s.get(b"k") == b"new" and s.log.store.names("evicted") == []
    with pytest.raises(LogError) as e:
        session.get(b"k")
    assert e.value.code == "BATCH_EVICTED"
    s.put([(b"z", b"1")])
    assert s.get(b"z") == b"1" and s.state().count() == 6 and s.log.sequences() == [5, 6]


def test_reclaim_waits_for_every_table(spark, root):
    from tessera.sources.log import CommitLog

    log = CommitLog(spark, root)
    rows = spark.createDataFrame([(1,)], "x long")
    log.commit({"a": rows, "b": rows})
    log.commit({"a": rows})
    log.retain("drop_all")
    log.write_base("a", rows, 2)
    assert log.reclaim() == 0 and log.history("b").count() == 1
    log.write_base("b", rows, 1)
    assert log.reclaim() == 2 and log.history("b", after=2) is None
    with pytest.raises(LogError):
        log.history("b")


def test_standing_retention_and_bundles(spark, root, monkeypatch):
    from tessera.sources import log as logs

    monkeypatch.setattr(logs, "BUNDLE", 3)
    log = logs.CommitLog(spark, root)
    rows = spark.createDataFrame([(1,)], "x long")
    for _ in range(4):
        log.commit({"a": rows})
    assert log.store.names("bundle") == ["3.json"]
    fresh = logs.CommitLog(spark, root)
    assert [r.seq for r in fresh.read("a").orderBy("seq").collect()] == [1, 2, 3, 4] and fresh._bundles == {3}
    assert log.set_retention("keep_latest", 2) == 3
    log.commit({"a": rows})
    assert log.sequences() == [4, 5] and logs.CommitLog(spark, root).retention() == ("keep_latest", 2)
    log.set_retention(None)
    log.commit({"a": rows})
    assert log.sequences() == [4, 5, 6] and log.history("a").count() == 6
    with pytest.raises(ValueError):
        log.set_retention("some", 1)


def test_points_are_read_from_few_row_groups(spark, root):
    from tessera import workload

    s = KvStore(spark, root)
    s.put_frame(workload.entries(spark, 3000).select("key", "value"))
    s.compact()
    path = s.log.base("kv")["path"]
    files = spark.read.parquet(path).selectExpr("_metadata.file_path AS f", "key").groupBy("f").agg({"key": "min"}).count()
    key = bytes(s.state().first().key)
    assert s.get(key) is not None and files >= 1
    plan = s._own().filter("key = X'00'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key" in plan


def test_pages_are_numbered_by_tasks(spark, root, sf_dir, monkeypatch):
    from pyspark.sql import DataFrame

    from tessera.plans import registry

    s = KvStore(spark, root)
    s.put([(b"%03d" % i, b"v") for i in range(25)])
    want = {bytes(r.key): n for n, page in enumerate(s.frames(s.range(), 10)) for r in page}
    assert {bytes(r.key): r.page for r in s.pages(s.range(), 10).collect()} == want and s.pages(s.range(b"x"), 10).count() == 0
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)  # the query draws no rows
    got = registry.queries()["s6_frames"](spark, sf_dir).collect()
    assert [r.n for r in got if r.asked == "nothing"] == [0] and sum(r.n for r in got) == 202
