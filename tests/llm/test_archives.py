"""WARC archives and nearest neighbours: round trips, brute force, edge cases; the pipeline."""

import base64
import collections
import hashlib
import io
import random

import numpy as np
import pytest

from tessera.llm import imi, queries, warc

PAGE = "page_id long, url string, html string, payload string"


def test_warc_round_trip(spark):
    rng = random.Random(2)
    words = [f"<p>word{i}</p>" for i in range(50)]
    rows = [(i, f"http://h/{i}?q=é\r\n", "".join(rng.choices(words, k=rng.randint(0, 4000))), "x") for i in range(300)]
    rows += [(1000, None, None, "x"), (1001, "u", "", "x"), (None, "u", "dup", "x"), (7000, "u", "dup", "x"), (6999, "u", "dup", "x"), (7000, "u", "dup", "x"), (None, None, None, "x")]
    got = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, PAGE).repartition(3))).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == collections.Counter((p, len(h or ""), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for p, _, h, _ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.payload_digest].append(r)
    for group in by.values():
        (first,) = [r for r in group if r.record_type == "response"]
        assert first.page_id == max((r.page_id for r in group if r.page_id is not None), default=None)
        assert all(r.refers_to == first.page_id and r.payload is None for r in group if r.record_type == "revisit")
    texts = {(p, h or "") for p, _, h, _ in rows}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in got if r.payload is not None)
    assert {r.url for r in got if r.page_id == 3} == {"http://h/3?q=é\r\n"}
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], PAGE))).count() == 0


def shard(records):
    out = io.BytesIO()
    out.close = lambda: None
    w = warc.ShardWriter(out)
    for r in records:
        w.add(r)
    w.close()
    return out.getvalue()


def test_dictionary_leads_and_frames_are_records():
    rng = random.Random(1)
    records = [warc.make_record(i, i, "u", " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=900)).encode(), None) for i in range(400)]
    data = shard(records)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    for chunk in (7, 1 << 20):
        assert list(warc.read_shard(io.BytesIO(data), chunk)) == records
    assert list(warc.read_shard(io.BytesIO(shard(records[:2])))) == records[:2]
    with pytest.raises(warc.BadRecord):
        list(warc.read_shard(io.BytesIO(data[:-5])))


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 5", b"Content-Length: 6"), (b"hello", b"jello"), (b"WARC-Date", b"X-Date"), (b"WARC-Type: response", b"WARC-Type: other"), (b"Content-Length: ", b"Content-Length: \xc2\xb2"), (b"WARC-Date:", b"WARC-Date\xff:"), (b"HTTP/1.1 200 OK", b"nothing"), (b"\r\n\r\nhello\r\n", b"\r\n\r\nhello")])
def test_bad_records_are_refused(change):
    good = warc.make_record(1, 0, "u", b"hello", None)
    assert warc.parse_record(good)["payload"] == b"hello"
    assert good.count(change[0])
    with pytest.raises(warc.BadRecord):
        warc.parse_record(good.replace(*change))


def foreign(kind, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:12345678-1234-1234-1234-123456789012>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in more.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers():
    got = warc.parse_record(foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"))
    assert (got["record_type"], got["page_id"], got["payload"], got["payload_bytes"]) == ("warcinfo", None, b"software: x\r\n", 13)
    assert got["record_id"].startswith("<urn:uuid:")
    block = b"HTTP/1.1 200 OK\r\nbroken header\r\nServer:x\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    got = warc.parse_record(foreign("response", block, Content_Type="application/http; msgtype=response", WARC_Target_URI="<http://h/%C3%A9>"))
    assert got["payload"].startswith(b"5\r\nhello") and got["url"] == "http://h/é" and got["payload_digest"] == warc.digest(got["payload"])
    for kind in ("request", "metadata", "resource", "conversion"):
        assert warc.parse_record(foreign(kind, b"GET / HTTP/1.1\r\n\r\n"))["payload"] == b"GET / HTTP/1.1\r\n\r\n"
    got = warc.parse_record(foreign("revisit", b"", WARC_Profile="http://x/other", WARC_Refers_To="<urn:uuid:1>"))
    assert (got["refers_to"], got["refers_to_id"], got["payload"], got["payload_bytes"]) == (None, "<urn:uuid:1>", None, None)
    folded = foreign("metadata", b"x").replace(b"WARC-Date: 2020", b"X-Long: a\r\n b\r\nWARC-Date: 2020")
    assert warc.parse_record(folded)["date"] == "2020-01-01T00:00:00Z"
    bad = [b"", b"\r\n\r\n", b"WARC/1.0\r\n\r\n", foreign("revisit", b""), foreign("response", b"x", Content_Type="application/http"), foreign("metadata", b"x", WARC_Block_Digest="sha1:AAAA"), foreign("metadata", b"x")[:-1]]
    for data in bad:
        with pytest.raises(warc.BadRecord):
            warc.parse_record(data)


def test_very_long_pages(spark):
    pages = [(i, "u", ("<p>%d</p>" % (i % 2)) * 300_000, "x") for i in range(4)]
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(spark.createDataFrame(pages, PAGE))).collect()}
    assert {i: r.record_type for i, r in got.items()} == {0: "revisit", 1: "revisit", 2: "response", 3: "response"}
    assert all(r.payload_bytes == len(pages[i][2]) and r.refers_to == (i + 2 if i < 2 else None) for i, r in got.items())


# neighbours

VEC = "vec_id long, embedding array<float>, score string"


def brute(rows, every=100, k=10):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    return {q: sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in ok if i != q)[:k] for q, v in ok if q % every == 0}


def run(spark, rows, **options):
    out = collections.defaultdict(list)
    for r in imi.search(spark.createDataFrame([(*r, "x") for r in rows], VEC), **options).collect():
        out[r.query_id].append((r.rank, r.score, r.vec_id))
    return {q: [(s, i) for _, s, i in sorted(v)] for q, v in out.items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x[1000:2400] = x[1000] + rng.normal(scale=1e-3, size=(1400, 16))  # a hot cell
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows, every=50), brute(rows, 50)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    exact = dict(rows)
    for q, found in got.items():
        assert found == sorted(found)
        for s, i in found:
            assert s == pytest.approx(np.sqrt(((np.float32(exact[q]).astype(float) - np.float32(exact[i]).astype(float)) ** 2).sum()), abs=1e-12)


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [None, 1.0, 1.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, []), (None, [1.0, 1.0, 1.0]), (100, [2.0, 0.0, 0.0]), (9, [3.0, 0.0, 4.0])]
    assert {q: [(round(s, 9), i) for s, i in v] for q, v in run(spark, rows).items()} == {q: [(round(s, 9), i) for s, i in v] for q, v in brute(rows).items()}
    assert run(spark, [*rows, (10, [1.0, 2.0])]).keys() == {0, 100}
    twice = run(spark, [*rows, (1, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0])])
    assert [i for _, i in twice[0]].count(1) == 1 and 0 not in [i for _, i in twice[0]]
    assert run(spark, []) == {} and run(spark, [(0, [1.0])]) == {}


def test_share_is_measured():
    rng = np.random.default_rng(2)
    loose = rng.normal(size=(3000, 32))
    tight = rng.normal(size=(60, 32))[rng.integers(0, 60, 3000)] + rng.normal(scale=0.05, size=(3000, 32))
    share = {}
    for name, x in (("loose", loose), ("tight", tight)):
        ca, cb = (imi.kmeans(h, 24) for h in imi.halves(x))
        share[name] = imi.needed_share(x, ca, cb, 10)
    assert share["tight"] < 0.1 < 0.3 < share["loose"] <= 1
    assert imi.needed_share(loose[:15], ca, cb, 10) == 1.0


def test_one_vector_on_very_many_rows(spark):
    rows = [(7, [1.0, 2.0])] * 3000 + [(i, [1.0, float(i)]) for i in range(100, 130)]
    got = run(spark, rows, every=100)
    assert got == brute(dict(rows).items(), 100)


def test_doubles_keep_their_precision(spark):
    rows = [(i, [1.0 + i * 1e-12, 0.5]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in imi.search(df, every=100).orderBy("rank").collect()]
    assert [i for i, _ in got] == list(range(1, 11)) and all(s == rows[i][1][0] - 1.0 for i, s in got)


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    da, db = rng.uniform(size=7), rng.uniform(size=9)
    count = {c: 1 for c in range(63) if c % 3}
    cells = imi.walk(da, db, count, 10**9, 1)
    cost = [da[c // 9] + db[c % 9] for c in cells]
    assert sorted(cells) == sorted(count) and cost == sorted(cost)
    assert len(imi.walk(da, db, count, 5, 1)) == 5


def test_pipeline_against_its_parts(spark, sf_dir):
    import corpus_pipeline as p
    from tessera.llm import decontam

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        kept = p.materialize(stage(spark, kept, sf_dir), name)
        assert kept.columns == docs.columns
        if name == "near_duplicates":
            from .test_text import brute_classes

            want = set(brute_classes([(r.doc_id, r.text) for r in docs.collect()]).values())
            assert {r.doc_id for r in kept.collect()} == want
            before = want
        if name == "decontamination":
            bad = {r.doc_id for r in decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in kept.collect()} == before - bad
    got = p.run(spark, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in kept.collect())
    assert len(p.STAGES) == 5 and queries.QUERIES


def test_pipeline_keeps_clashing_columns(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    names = ["score", "lang_pred", "size", "target", "taken", "copies", "source_size", "node", "_bad", "_dd_n", "shard", "comp"]
    docs = p.materialize(docs.selectExpr("*", *[f"concat(doc_id, '{n}') AS `{n}`" for n in names]), "clash")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        kept = p.materialize(stage(spark, kept, sf_dir), name)
        assert kept.columns == docs.columns and kept.count()
    assert all(r[n] == f"{r.doc_id}{n}" for r in kept.collect() for n in names)
    assert p.STAGES[-1][1](spark, kept, sf_dir).count() == kept.count()
    nothing = docs.limit(0)
    for name, stage in p.STAGES:
        nothing = p.materialize(stage(spark, nothing, sf_dir), name)
        assert nothing.count() == 0
