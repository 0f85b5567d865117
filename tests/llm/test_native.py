"""Mixing, chat formatting and sharding: brute force, round trips, edge cases."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, hilbert, mix, queries

from ..conftest import same

DOC = "doc_id long, text string, source string, size long, taken string"  # two names clash with outputs


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLE[name])
    same(got, want.fetchall(), [d[0] for d in want.description])


def mixed(spark, rows, **options):
    return mix.mix(spark.createDataFrame(rows, DOC), **options)


def test_targets_share_the_excess(spark):
    rows = [(i, "w " * 10, s, 0, "x") for i, s in enumerate(["a"] * 2 + ["b"] * 20 + ["c"] * 40)]
    got = {r.source: r for r in mixed(spark, rows).groupBy("source").agg(F.max("target").alias("t"), F.sum("size").alias("s"), F.sum("taken").alias("k"), F.max("copies").alias("c")).collect()}
    assert got["a"].t == 40  # stops at twice its size
    assert got["b"].t == 400 and got["c"].t == 930 - 440
    assert all(abs(r.k - r.t) <= 10 and r.c <= 2 for r in got.values())


def test_mix_edges(spark):
    same_row = [(None, "a b c", None, 9, "x")] * 31
    rows = same_row + [(1, None, "s", 1, "x"), (2, "", "s", 1, "x"), (3, "a b \x0b c", "s", 1, "x"), (4, None, "empty", 1, "x")]
    out = mixed(spark, rows)
    assert sorted(out.columns) == sorted(["doc_id", "text", "source", "size", "source_size", "target", "taken", "copies"])
    got = out.collect()
    assert len(got) == 35
    one = [r for r in got if r.source is None]
    assert abs(sum(r.taken for r in one) - one[0].target) <= 3 and {r.size for r in one} == {3}
    assert {r.doc_id: r.size for r in got if r.source == "s"} == {1: 0, 2: 0, 3: 2}
    assert [r.target for r in got if r.source == "empty"] == [0.0]
    assert sorted(map(tuple, mixed(spark, rows).select("doc_id", "taken").collect()), key=repr) == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    assert mix.repeat(out).count() == sum(r.copies for r in got)
    assert mixed(spark, []).count() == 0


def brute_chat(turns):
    esc = lambda t: t.replace("<\\", "<\0").replace("<|", "<\\|").replace("<\0", "<\\\\")
    out, last = "", None
    for role, text in turns:
        r = esc(role).replace("%", "%25").replace("\n", "%0A")
        out += chat.SEP + esc(text) if role == last else (chat.END if last is not None else "") + chat.START + r + "\n" + esc(text)
        last = role
    return out + chat.END


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["<", "|", "\\", "<|im_end|>", "<|im_start|>user\n", "<|im_sep|>", "é🙂", "\n", "", "a%0A", "<\\|"]
    convs = {c: [(rng.choice(["user", "assistant", "a\nb%", "<|im_sep|>"]), "".join(rng.choices(bits, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 7))] for c in range(40)}
    rows = [(c, t, r, x, 1) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, n_turns int")
    out = chat.format_chat(df)
    formatted = {r.conv_id: r for r in out.collect()}
    for c, turns in convs.items():
        assert formatted[c].formatted == brute_chat(turns)
        assert formatted[c].n_blocks == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
    for r in chat.read_chat(out).collect():
        assert [tuple(t) for t in r.turns] == convs[r.conv_id]
        assert r.loss_texts == [x for role, x in convs[r.conv_id] if role == "assistant"]


@pytest.mark.parametrize("n", [1, 255, 256, 257, 3000])
def test_spans_of_long_conversations(spark, n):
    turns = [("assistant" if i % 3 else "user", f"text {i} <|") for i in range(n)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id int, turn int, role string, text string")
    (back,) = chat.read_chat(chat.format_chat(df)).collect()
    assert [tuple(t) for t in back.turns] == turns and back.loss_texts == [t for r, t in turns if r == "assistant"]


def test_chat_edges(spark):
    schema = "conv_id int, turn int, role string, text string"
    rows = [(None, 1, None, None), (None, None, "assistant", "x"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_chat(chat.format_chat(spark.createDataFrame(rows, schema))).collect()}
    assert back == {None: [("assistant", "x"), ("", "")], 1: [("user", "a"), ("user", "a"), ("user", "b")]}
    assert chat.format_chat(spark.createDataFrame([], schema)).count() == 0


def test_hilbert_curve_is_one(spark):
    cells = spark.range(1 << 9).select(*[F.expr(f"cast((id >> {3 * i}) & 7 as int)").alias(f"x{i}") for i in range(3)])
    rows = sorted(cells.withColumn("h", hilbert.hilbert_index([F.col(f"x{i}") for i in range(3)], 3)).collect(), key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(512))
    assert all(sum(abs(a[i] - b[i]) for i in range(3)) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("n", [0, 1, 5, 24, 100, 997])
def test_shards(spark, n, monkeypatch):
    import zlib

    monkeypatch.setattr(hilbert, "GROUP_ROWS", 16)
    rng = random.Random(n)
    rows = [(rng.choice([None, i, 7]), rng.choice([None, "", "same", f"é{i}" * rng.randint(1, 50)]), rng.choice(["a", "hot", "hot", None]), rng.choice(["en", None]), "x") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string, shard string")
    got = hilbert.shard(df).collect()
    assert collections.Counter((r.doc_id, r.text_crc32, r.size) for r in got) == collections.Counter((d, None if t is None else zlib.crc32(t.encode()), len((t or "").encode()) + 8) for d, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_op9_whole_table(spark, sf_dir):
    got = queries.QUERIES["op9_shard"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.count() == docs.count() and got.select("shard").distinct().count() == 24


def test_shard_files_hold_each_row_in_its_slot(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i // 4, f"text {i % 40}", "s", "en") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    hilbert.write_shards(df, str(tmp_path / "out"), n_shards=6)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((d or -1, t) for d, t, _, _ in rows)
    assert sorted((r.shard, r.slot) for r in got) == [(k, j) for k in range(6) for j in range(20)]


def test_shard_files_with_clashing_columns_are_pruned_in_every_dimension(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "x" * 2 ** rng.randint(1, 9), f"s{rng.randrange(16):02}", f"l{rng.randrange(16):02}", i, "y", "z") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard int, slot string, _row string")
    hilbert.write_shards(df, str(tmp_path / "out"), n_shards=40)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.columns) == sorted(df.columns) and got.filter("_row <> 'z'").count() == 0
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {100}
    for dim in ("source", "lang", "length(text)"):
        spans = got.groupBy("shard").agg(F.expr(f"min({dim})").alias("lo"), F.expr(f"max({dim})").alias("hi")).collect()
        middle = sorted(r[0] for r in got.selectExpr(dim).collect())[2000]
        assert sum(r.lo <= middle <= r.hi for r in spans) < 24  # the others' statistics leave them out


def test_one_row_very_many_times(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "GROUP_ROWS", 16)
    rows = [(1, "same", "s", "en")] * 700 + [(None, "same", "s", "en")] * 300 + [(i, f"t{i}", "s", "en") for i in range(2, 40)]
    got = hilbert.shard(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in counts.items())


def test_very_long_texts(spark):
    long = "word, " * 400_000
    got = {r.doc_id: r for r in mixed(spark, [(1, long, "s", 0, "x"), (2, "a b", "s", 0, "x")]).collect()}
    assert got[1].size == 400_000 and got[2].size == 2
    turns = spark.createDataFrame([(1, t, r, long) for t, r in enumerate(["user", "assistant", "assistant"])], "conv_id int, turn int, role string, text string")
    (back,) = chat.read_chat(chat.format_chat(turns)).collect()
    assert [t.text for t in back.turns] == [long] * 3 and back.loss_texts == [long] * 2


def test_many_values_are_ranked_by_ranges(spark, monkeypatch):
    values = spark.createDataFrame([(v,) for v in [None, *(f"h{i * 37 % 500:03}" for i in range(500))]], "host string")
    want = {v: i for i, v in enumerate([None, *(f"h{i:03}" for i in range(500))])}
    for limit in (1000, 10):
        monkeypatch.setattr(hilbert, "BROADCAST_ROWS", limit)
        assert {r._v: r._r for r in hilbert._ranked(values, "host").collect()} == want
