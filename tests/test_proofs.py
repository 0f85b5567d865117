"""Hash trees, uploads, files."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from tessera.operators import proofs
from tessera.operators.oplog import OpLog
from tessera.operators.predicates import Selector, ValueFilter
from tessera.sources import files
from tessera.sources.upload import OpLogWriter, Poisoned
from tessera.spec import ColumnSpec, TableSpec
from tessera.streaming.subscribe import subscribe_operations


def plain_root(hashes):
    while len(hashes) > 1:
        hashes = [hashlib.sha256(b"\x01" + hashes[i] + hashes[i + 1]).digest() if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0]


@pytest.mark.parametrize("n", [1, 2, 7, 16])
def test_tree(spark, n):
    ops = [(i, b"k%d" % i, None if i % 3 == 2 else b"v%d" % i) for i in range(n)]
    df = spark.createDataFrame([(i, bytearray(k), None if v is None else bytearray(v)) for i, k, v in ops], "location long, key binary, value binary")
    tree = proofs.HashTree(df)
    contents = {i: proofs.leaf_bytes(i, k, v) for i, k, v in ops}
    assert tree.root() == plain_root([proofs.hash_leaf(contents[i]) for i in range(n)])
    for some in ([0], [n - 1], list(range(n)), [0, n // 2]):
        p = tree.prove(some)
        proofs.verify(tree.root(), p, {i: contents[i] for i in some})
        with pytest.raises(proofs.ProofError):
            proofs.verify(tree.root(), p, {i: contents[i] + b"x" for i in some})
    with pytest.raises(proofs.ProofError):
        tree.prove([n])
    with pytest.raises(proofs.ProofError):
        proofs.HashTree(df.filter("location > 0").unionByName(df.filter("location = 0").selectExpr("99L AS location", "key", "value")))


def test_small_trees_are_the_large_ones(spark):
    for n in (1, 2, 7, 16):
        hashes = [proofs.hash_leaf(b"%d" % i) for i in range(n)]
        assert proofs.tree_root(hashes) == plain_root(hashes)
        for some in ([0], [n - 1], list(range(n))):
            p = proofs.prove_leaves(hashes, some)
            proofs.verify(proofs.tree_root(hashes), p, {i: b"%d" % i for i in some})
        f = proofs.Frontier()
        for k, h in enumerate(hashes):
            f.append(h)
            assert f.root() == plain_root(hashes[: k + 1]) and f.size == k + 1
    with pytest.raises(proofs.ProofError):
        proofs.prove_leaves(hashes, [16])


def test_frontier_of_a_tree_goes_on(spark):
    ops = spark.createDataFrame([(i, bytearray(b"k%d" % i), bytearray(b"v")) for i in range(11)], "location long, key binary, value binary")
    whole, part = proofs.HashTree(ops), proofs.HashTree(ops.filter("location < 6"))
    f = proofs.frontier(part)
    assert f == proofs.frontier(whole, 6) and f.root() == part.root()
    for i in range(6, 11):
        f.append(proofs.hash_leaf(proofs.leaf_bytes(i, b"k%d" % i, b"v")))
    assert f.root() == whole.root() and proofs.frontier(whole, 0).root() == proofs.Frontier().root()


def test_keys_absence_and_ranges(spark):
    from dataclasses import replace

    names = [b"b", b"d", b"f", b"h", b"j"]
    active = spark.createDataFrame([(bytearray(k), bytearray(b"v" + k)) for k in names], "key binary, value binary")
    tree = proofs.KeyTree(active)
    root = tree.root()
    assert proofs.verify_keys(root, tree.prove([b"d", b"j"])) == {b"d": b"vd", b"j": b"vj"}
    for key in (b"a", b"c", b"i", b"z"):
        proofs.verify_absent(root, tree.prove_absent(key), key)
    for key in names:
        with pytest.raises(proofs.ProofError):
            tree.prove_absent(key)
        with pytest.raises(proofs.ProofError):
            proofs.verify_absent(root, tree.prove_absent(b"c"), key)
    with pytest.raises(proofs.ProofError):
        tree.prove([b"c"])
    for start, end in itertools.product([b"a", b"b", b"c", b"h", b"i", b"j", b"k"], [b"aa", b"b", b"e", b"j", b"z"]):
        if start < end:
            got = proofs.verify_range(root, tree.prove_range(start, end), start, end)
            assert got == {k: b"v" + k for k in names if start <= k < end}
    whole = tree.prove_range(b"c", b"i")
    for k in range(len(whole.entries)):  # a range from which an entry is taken proves nothing
        rest = [e for i, e in enumerate(whole.entries) if i != k]
        less = proofs.KeyProof(tuple(rest), tree.tree.prove([e.place for e in rest]))
        with pytest.raises(proofs.ProofError):
            proofs.verify_range(root, less, b"c", b"i")
    with pytest.raises(proofs.ProofError):
        proofs.verify_range(root, tree.prove_range(b"c", b"e"), b"c", b"i")
    forged = proofs.KeyProof((replace(whole.entries[0], value=b"x"), *whole.entries[1:]), whole.proof)
    with pytest.raises(proofs.ProofError):
        proofs.verify_keys(root, forged)
    one = proofs.KeyTree(active.filter(F.col("key") == F.lit(bytearray(b"d"))))
    proofs.verify_absent(one.root(), one.prove_absent(b"a"), b"a")
    assert proofs.verify_range(one.root(), one.prove_range(b"a", b"z"), b"a", b"z") == {b"d": b"vd"}


def test_upload_publishes_in_order_and_poisons(spark, root):
    w = OpLogWriter(spark, root)
    w.append([(b"a", b"1"), (b"b", b"2")]).result()
    assert w.acknowledged() == 2 and w.published == 0 and w.log.current() == 0
    assert w.log.store.names("log")  # staging has written files that no manifest names
    w.append([(b"a", None)])
    assert w.flush() == 3
    seen = []
    q = subscribe_operations(spark, root, lambda s, df: seen.append((s, df.count())), f"{root}/cp", since=1, once=True)
    q.awaitTermination()
    assert seen == [(1, 2), (2, 1)]
    log = OpLog(w.operations(), watermarks=w.watermarks())
    assert log.watermark() == 2 and [bytes(r.key) for r in log.active(2).collect()] == [b"b"]
    w.append([(b"c", b"3")]).result()
    w.waiting.insert(0, (3, 4, w.pool.submit(lambda: 1 / 0)))
    with pytest.raises(ZeroDivisionError):
        w.flush()
    with pytest.raises(Poisoned):
        w.append([(b"d", b"")])
    again = OpLogWriter(spark, root)
    assert again.next == 3 and again.head == w.head
    w.log.retain("drop_all")
    assert OpLogWriter(spark, root).next == 3 and again.operations().count() == 3


def test_operations_by_filters_with_proofs(spark, root):
    w = OpLogWriter(spark, root)
    w.append([(b"a1", b"x"), (b"b1", b"y"), (b"a2", None)])
    w.append([(b"a3", b"xz"), (b"a4", b"q")])
    w.flush()
    heads = [bytes(m.head) for m in w.log.history("watermark").orderBy("location").collect()]
    seen = []

    def handle(seq, rows, proof):
        got = {r.location: proofs.leaf_bytes(r.location, bytes(r.key), bytes(r.value)) for r in rows.collect()}
        proofs.verify_batch(heads[seq - 1], proof, got)
        for bad in ({k: v + b"x" for k, v in got.items()}, {}):
            with pytest.raises(proofs.ProofError):
                proofs.verify_batch(heads[seq - 1], proof, bad)
        with pytest.raises(proofs.ProofError):
            proofs.verify_batch(heads[seq % 2], proof, got)
        seen.append((seq, sorted(got)))

    q = subscribe_operations(spark, root, handle, f"{root}/cp", since=1, once=True, selectors=[Selector(b"a")], values=[ValueFilter("prefix", b"x")], prove=True)
    q.awaitTermination()
    assert seen == [(1, [0]), (2, [3])]


def test_files(spark, tmp_path):
    spec = TableSpec("t", (ColumnSpec("id", "int64"), ColumnSpec("name", "utf8", True)), ("id",))
    df = spark.createDataFrame([(1, "a", 9), (2, None, 9)], "id long, name string, more int")
    for f in ("parquet", "json", "orc", "csv"):
        path = str(tmp_path / f)
        files.write(df.drop("more") if f == "csv" else df, path, f, sort_by=["id"], **({"header": True} if f == "csv" else {}))
        assert {tuple(r) for r in files.read(spark, spec, path, f).collect()} == {(1, "a"), (2, None)}


def test_frames_are_uploaded_and_proven_by_tasks(spark, root, monkeypatch):
    from pyspark.sql import DataFrame

    from tessera.sources.upload import prove_batches, verify_batches

    one, many = OpLogWriter(spark, f"{root}/one"), OpLogWriter(spark, f"{root}/many")
    ops = [(b"k%d" % (i % 5), None if i % 4 == 3 else b"v%d" % i) for i in range(23)]
    for first in (0, 10, 20):
        one.append(ops[first : first + 10])
    one.flush()
    df = spark.createDataFrame([(100 - i, bytearray(k), None if v is None else bytearray(v)) for i, (k, v) in enumerate(ops)], "o long, key binary, value binary")
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toLocalIterator", None)
        assert many.append_frame(df.withColumn("o", -F.col("o")), "o", 10) == 3
        assert many.flush() == 23
    plain = lambda w, t: sorted(map(repr, w.log.history(t).select("seq", *(c for c in w.log.history(t).columns if c != "seq")).collect()))
    assert plain(many, "ops") == plain(one, "ops") and plain(many, "watermark") == plain(one, "watermark") and many.head == one.head
    assert OpLogWriter(spark, f"{root}/many").next == 23
    heads, got = many.log.history("watermark"), []

    def handle(number, rows, found):
        got.append(sorted((r.seq, r.location) for r in verify_batches(heads, rows, found).collect()))
        for bad in (rows.withColumn("value", F.lit(bytearray(b"x"))), rows.filter("location NOT IN (10, 20)")):
            with pytest.raises(Exception, match="ProofError"):
                verify_batches(heads, bad, found).collect()

    q = subscribe_operations(spark, many.log.root, handle, f"{root}/cp", since=1, once=True, max_batches=2, values=[ValueFilter("prefix", b"v")], prove=True, together=True)
    q.awaitTermination()
    want = [(i // 10 + 1, i) for i in range(23) if i % 4 != 3]
    assert got == [[x for x in want if x[0] < 3], [x for x in want if x[0] == 3]]
    with pytest.raises(ValueError):
        many.append_frame(df.filter("o > 1000"), "o", 10)
    # a batch that will not be published takes nothing from those written with it
    many.append_frame(df, "o", 10)
    many.waiting[1] = (*many.waiting[1][:2], many.pool.submit(lambda: 1 / 0))
    with pytest.raises(ZeroDivisionError):
        many.flush()
    assert many.published == 33 and OpLogWriter(spark, f"{root}/many").operations().count() == 33
    assert prove_batches(many.log, many.operations().filter("seq = 4")).count() == 1
