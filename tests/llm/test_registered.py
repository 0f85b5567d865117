"""The registered queries over whole tables, against the library or brute force."""

import itertools
import zlib

import numpy as np
import pytest

from tessera.llm import decontam, queries, tokenbin

from .test_archives import brute
from .test_text import brute_classes


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenbin.default_tokenizer())
    return {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in docs}


def test_op2(spark, sf_dir, ids):
    got = sorted(queries.QUERIES["op2_token_files"](spark, sf_dir).collect(), key=lambda r: r.doc_id)
    whole = {i: [*x, 2] for i, x in sorted(ids.items())}
    starts = [0, *itertools.accumulate(map(len, whole.values()))]
    assert [tuple(r) for r in got] == [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, x), s in zip(whole.items(), starts, strict=False)]


def test_op3(spark, sf_dir, docs):
    assert {r.doc_id: r.class_id for r in queries.QUERIES["op3_near_dup"](spark, sf_dir).collect()} == brute_classes(docs)


def test_op6(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows), {}
    for r in queries.QUERIES["op6_neighbours"](spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want) and all(sorted(r for r, _, _ in v) == list(range(1, 11)) for v in got.values())
    hits = [len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    at = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v}
    assert all(s == pytest.approx(np.linalg.norm(at[q] - at[i]), abs=1e-9) for q, v in got.items() for _, i, s in v)


def test_op8(spark, sf_dir, docs, ids):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op8_token_counts"](spark, sf_dir).collect()}
    assert got == {i: (len((t or "").encode()), len(ids[i]), len(ids[i]) > 2048) for i, t in docs}


def test_op10(spark, sf_dir, docs):
    items = [(r.item_id, decontam.words_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    number, want = {}, {}
    code = lambda words: np.array([number.setdefault(w, len(number)) for w in words])
    runs = {i: set(decontam.grams_of(w)) for i, w in items}
    coded = {i: code(w) for i, w in items}
    for doc, text in docs:
        words = decontam.words_of(text)
        own, nums = set(decontam.grams_of(words)), code(words)
        for i, w in items:
            if own & runs[i] and (s := decontam.align(coded[i], nums)[0] / (2 * len(w))) >= decontam.SCORE:
                want[doc, i] = s
    got = {(r.doc_id, r.item_id): r.score for r in queries.QUERIES["op10_decontamination"](spark, sf_dir).collect()}
    assert got == {k: pytest.approx(s) for k, s in want.items()} and want
