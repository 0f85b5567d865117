"""Token files, token counts, near-duplicates, language, decontamination: brute force and edge cases."""

import collections
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, neardup, queries, tokenbin, tokencount
from tessera.llm.bpe import Encoder

ODD = ["I'll've don't're  it's 'r 're 'rex''s don'", "<|endoftext|> a <|endoftext|>b", "<|ENDOFTEXT|>", "İstanbul Σας ΣΑΣ. ß é café　x中文字 \x1c q", "", "  \n ", "ab\x85cd\xa0ef", "½²x9９", "naïve—“q”…", "🙂🙂 a‍b", "a" * 300, "Word, WORD word; x.y!! 12,000"]


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenbin.default_tokenizer())


def ids(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


PLAIN = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028)]]
SCRIPTS = ["Привет, МИР!", "J\u030c ǰ ＡＢＣ ﬁ", "नमस्ते दुनिया", "\u1100\u1161\u11a8 각", "สวัสดี", "中文字符", "e\u0323\u0301x", "=\u0338 <\u0338", " \u0301", "a<|endoftext|>b re's<|endofte", "🙂" * 40]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    anything = [chr(c) for c in range(0x3000)]
    close = ["e", "a", "J", "=", "<", " ", "\u3000", "!", "'", "s", "r", *map(chr, range(0x300, 0x330))]
    return ["".join(rng.choices(some, k=40)) for some in (PLAIN, anything, close) for _ in range(n)]


def test_encoder_is_the_library(spark, lib, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ODD + SCRIPTS + odd_texts(200) + [c + "x " + c + c for c in PLAIN]
    got = []
    for tokens, lens in Encoder(tokenbin.default_tokenizer()).encode(pa.array(texts)):
        got += [x.tolist() for x in np.split(np.concatenate(tokens), np.cumsum(lens)[:-1])]
    assert got == [ids(lib, t) for t in texts]


def test_encoder_with_small_tables(lib, monkeypatch):
    # tables that start anew, words and chunks that are not kept, several pieces
    for name, n in (("KEEP", 20), ("KEEP_WORDS", 20), ("LONG", 5), ("PIECE_BYTES", 200), ("STEP", 7), ("TOGETHER", 3)):
        monkeypatch.setattr(bpe, name, n)
    texts = ODD + SCRIPTS + odd_texts(20) + ["the cat sat on the mat, verylongword. " * 9] * 3
    enc = Encoder(tokenbin.default_tokenizer())
    for _ in range(2):
        got = [x.tolist() for a, b in bpe.pieces(pa.array(texts), 200) for tokens, lens in enc.encode(pa.array(texts[a:b]), 2) for x in np.split(np.concatenate(tokens), np.cumsum(lens)[:-1])]
        assert got == [[*ids(lib, t), 2] for t in texts]


def test_token_files(spark, lib):
    rng = random.Random(3)
    texts = ODD + [None, None] + [" ".join(rng.choices(["the", "cat", "sat", "on"], k=rng.randint(0, 40))) for _ in range(60)]
    rows = [(None if i % 17 == 0 else i // 2, t, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    manifest = tokenbin.write_tokens(spark.createDataFrame(rows, "doc_id int, text string, start string").repartition(5), tokenbin.default_tokenizer())
    got = sorted(tokenbin.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(-1 if r[0] is None else r[0] for r in rows)
    want = collections.Counter((d, len(x := [*ids(lib, t), 2]), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    m = manifest.collect()[0]
    tokens, ends, _, _ = tokenbin.shard_arrays(m.folder, m.name, m.width, m.n_docs)
    assert isinstance(tokens.base, np.memmap) or isinstance(tokens, np.memmap)
    assert len(tokens) == m.n_tokens == ends[-1]
    empty = tokenbin.write_tokens(spark.createDataFrame([], "doc_id long, text string"), tokenbin.default_tokenizer())
    assert tokenbin.read_tokens(empty).count() == 0


def test_prefix_counts(spark, lib, sf_dir):
    pre = tokencount.Prefixes(tokenbin.default_tokenizer())
    texts = ODD + SCRIPTS + odd_texts(25) + [r.text[:400] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(25).collect()]
    texts += ["e\u0301" * 90, "\u1112\u1161\u11ab" * 80, "x" * 90 + "'re", "!" * 80 + "=\u0338", "ab" * 60 + "e\u0323\u0301z"]
    assert pre.totals(pa.array(texts)).tolist() == [len(ids(lib, t)) for t in texts]
    for text in texts:
        assert pre.table(text).tolist() == [len(ids(lib, text[:p])) for p in range(len(text) + 1)]
    table = pre.table("the cat sat on the mat")
    assert tokencount.fits(table, 3) == len("the cat sat ") and tokencount.fits(table, 0) == 0


def test_pairs_that_fit_are_what_merging_gives():
    pre, rng = tokencount.Prefixes(tokenbin.default_tokenizer()), random.Random(8)
    inner, final = ([t for t, k in sorted(pre.kinds.items()) if k & kind and pre._parts(t + mark)] for kind, mark in ((1, ""), (2, pre.end)))
    short = [t for t in inner if len(t) < 3]
    for _ in range(20_000):
        a, end = rng.choice(rng.choice((short, inner))), rng.random() < 0.5
        b = rng.choice(final if end else [*rng.choices(inner, k=2), a, a[0], a[-1]])
        letters = [*a, *b[:-1], b[-1] + pre.end] if end else [*a, *b]
        assert pre._fit(a, b, end) == (pre._merge(letters) == [a, b + pre.end if end else b])


@pytest.mark.parametrize("text", ["'" * 100_000, "a" * 1_000_000, "中文字符漢字" * 20_000, "Привет" * 20_000, "🙂" * 30_000, "\u1100\u1161\u11a8" * 20_000, "สวัสดี" * 20_000], ids=["apostrophes", "letters", "cjk", "cyrillic", "emoji", "jamo", "thai"])
def test_long_chunks_take_linear_time(lib, text):
    began, pre = time.time(), tokencount.Prefixes(tokenbin.default_tokenizer())
    table = pre.table(text)
    assert time.time() - began < 60 and len(table) == len(text) + 1
    assert table[-1] == pre.totals(pa.array([text]))[0]
    some = text[:3000]
    assert table[3000] == len(ids(lib, some))


def test_token_counts(spark, lib):
    long = "word " * 3000
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*ODD, None, long, long])], "doc_id int, text string, n_tokens int")
    got = {r.doc_id: r for r in tokencount.count_tokens(df, tokenbin.default_tokenizer()).collect()}
    for r in df.collect():
        n = len(ids(lib, r.text))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 2048)
    tables = tokencount.count_tokens(df.limit(3), tokenbin.default_tokenizer(), tables=True).collect()
    assert all(r.prefix_tokens[-1] == r.n_tokens for r in tables)
    assert tokencount.count_tokens(df.limit(0), tokenbin.default_tokenizer()).count() == 0


# near-duplicates


def weighted(text, n=5):
    w = re.findall(r"\w+", text.lower())
    return collections.Counter(zip(*[w[i:] for i in range(n)])) if len(w) >= n else collections.Counter([tuple(w)] if w else [])


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def brute_classes(rows):
    """doc_id -> class for rows with distinct ids."""
    sets = {i: weighted(t) for i, t in rows if t is not None}
    text, parent = dict(rows), {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if text[a] == text[b] or jaccard(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 160))]
        texts += [" ".join(base)] * rng.randint(1, 3)
        texts += [" ".join(edited(rng, base, rng.randint(1, 4))) for _ in range(6)]
    passage = " ".join(word() for _ in range(50))
    texts += [passage + " " + " ".join(word() for _ in range(90)) for _ in range(30)]
    texts += ["short text", "short text", "Short, text!", "", "", "?!", "?!", None, None, "tiny"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df)[0].collect()}
    assert got == brute_classes(rows)
    kept = {r.doc_id for r in neardup.dedup(df).collect()}
    assert kept == set(got.values()) and neardup.dedup(df).columns == df.columns


def test_blocks_of_any_size_give_the_same_classes(spark, monkeypatch):
    # one crowd that shares bands but not classes, of many sizes; tiny blocks, so that many of them meet
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[: rng.randint(60, 400)] + [f"own{k}x{j}" for j in range(rng.randint(0, 60))]) for k in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    for block, elements, columns in ((128, 1 << 18, 1 << 13), (3, 900, 50)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "ELEMENTS", elements)
        assert {r.doc_id: r.class_id for r in neardup.classes(df)[0].collect()} == want
    sets = [np.unique(np.array(rng.choices(range(500), k=rng.randint(1, 300)), dtype=np.uint64)) for _ in range(20)]
    for step in (7, 1000):
        got = neardup.shared_counts(sets[:8], sets[8:], step)
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]


def test_very_long_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 3000))), (3, " ".join(reversed(words))), (4, " ".join(words[:150_000]))]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicate_edges(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "A b c d e f."), (5, "A b c d e f."), (6, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(df)[0].collect()), key=repr)
    assert got == sorted([(None, 5), (None, 5), (5, 5), (5, 5), (6, 6), (None, None)], key=repr)
    assert sorted(map(tuple, neardup.dedup(df).collect()), key=repr) == sorted([(5, "A b c d e f."), (6, None), (None, None)], key=repr)
    assert neardup.classes(df.limit(0))[0].count() == 0 and neardup.dedup(df.limit(0)).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    darts = neardup.Darts(240)
    for size in (3, 60, 2000):
        x = rng.integers(0, 2**63, size, dtype=np.uint64)
        a, b = rng.uniform(0.2, 9, size), rng.uniform(0.2, 9, size)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        got = np.mean([(d.signature(x + np.uint64(s), a) == d.signature(x + np.uint64(s), b)).mean() for s in range(8) for d in [darts]])
        assert abs(got - want) < 0.06
    assert neardup.similarity(x[:2], x[:0]) == 0
    cut = neardup.Shingles()
    a, b = "a b c d e f g " * 3, "a b c d e f h " * 3
    assert neardup.similarity(cut.expanded(a), cut.expanded(b)) == pytest.approx(jaccard(weighted(a), weighted(b)))


# language


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op7_language"](spark, sf_dir.replace("0.001", "0.01")).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_letters_of_every_plane():
    make = langid.Features()
    assert make("\U00030000\U000323af") is not None and make("\U0001f642 12") is None


def test_language_edges(spark):
    rows = [(i, t, x, "z") for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("el gato y el perro", "es"), ("xx yy", "qq")] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df)
    assert langid.family("en") == langid.family("de") != langid.family("fr") and len(model.families) == 3
    asked = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 ?!", "a"), (4, "die katze", None), (4, "die katze", None), (5, "the dog " * 30000, "b")], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(asked, model).orderBy("doc_id").collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en")]
    assert langid.fit(df.limit(0)) is None and langid.fit(df.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.predict(asked, None).collect()} == {"und"}
    assert langid.predict(asked.limit(0), model).count() == 0


def test_every_language_is_learnt(spark):
    # more labels than any fixed number of them; the last ones are the rarest
    texts = {f"q{k}": " ".join(chr(0x4E00 + 40 * k + j) * 2 for j in range(20)) for k in range(230)}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for k, (lang, t) in enumerate(texts.items()) for _ in range(3 if k < 200 else 2))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(texts)
    asked = spark.createDataFrame(list(texts.items()), "lang string, text string")
    got = {r.lang: r.lang_pred for r in langid.predict(asked, model).collect()}
    assert got == {lang: lang for lang in texts}


# decontamination


def slow_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_against_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 14))] for _ in range(2))
        score, start, stop = decontam.align(np.array(a), np.array(b))
        assert score == slow_align(a, b)
        if score:
            assert slow_align(a, b[start:stop]) == score


def test_contaminated_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(20, 50)))) for i in range(8)] + [(8, "two words"), (9, None), (10, "!!")]
    texts = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 120))]
        if i % 2:
            item = items[rng.randrange(9)][1].split()
            body[len(body) // 2 : len(body) // 2] = edited(rng, item, min(len(item) // 2, rng.randint(0, 6)))
        texts.append(" ".join(body))
    texts += [None, "", "two, WORDS", items[0][1].upper().replace(" ", " - "), " ".join(["pad"] * 3000) + " " + items[1][1]]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id int, text string, score double")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()}
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    score = lambda x, t: slow_align(words(x), words(t)) / (2 * len(words(x)))
    # items of fewer words than a seed has are found whole only
    want = {(d, i): s for d, t in enumerate(texts) for i, x in items if words(x) and (s := score(x, t)) >= (decontam.SCORE if len(words(x)) > 2 else 1)}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    clean = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in want}
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_batch_words_are_those_of_each_text():
    texts = ["Déjà-vu, ÉTÉ_1 — “x”½ 12", "", " plain ASCII, only; _a_ ", "Привет,МИР", "中文 字符!", "\x00a\tb\u2028c", "e\u0301a"]
    words, counts = decontam.batch_words(pa.array(["skipped", *texts]).slice(1))
    split = np.split(np.array(words.to_pylist(), dtype=object), np.cumsum(counts)[:-1])
    assert [x.tolist() for x in split] == [re.findall(r"\w+", t.lower()) for t in texts]
    assert [decontam.words_of(t) for t in texts] == [x.tolist() for x in split] and decontam.words_of(None) == []


@pytest.mark.parametrize("every", [3, 4, 5, 7])
def test_every_copy_with_a_run_of_three_words_is_found(spark, every):
    # copies of many items, each edited in every part, beside whole ones and noise of the items' own words
    rng = random.Random(every)
    items = [(k, [f"w{rng.randrange(300)}" for _ in range(rng.randint(12, 60))]) for k in range(12)]
    texts = []
    for _, words in items:
        for start in range(every):
            texts.append([f"x{i}" if i % every == start else w for i, w in enumerate(words)])
        texts.append(words)
        texts.append(rng.sample([w for _, ws in items for w in ws], 40))
    rng.shuffle(texts)
    docs = docs_of(spark, [" ".join(t) for t in texts])
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()}
    runs = lambda w: set(zip(w, w[1:], w[2:], strict=False))
    want = {(d, k): s for d, t in enumerate(texts) for k, w in items if runs(t) & runs(w) and (s := slow_align(w, t) / (2 * len(w))) >= decontam.SCORE}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(want) > 12 * (every > 3)


def test_seeds_cover_every_window():
    grams = [str(i) for i in range(30)]
    count = {g: int(g) * 7 % 11 for g in grams}
    seeds = decontam.seeds_of(grams, count)
    assert all(set(grams[i : i + decontam.WINDOW]) & seeds for i in range(31 - decontam.WINDOW)) and decontam.seeds_of([], {}) == set()


@pytest.mark.parametrize("whole", [0, 1])
@pytest.mark.parametrize("every", [4, 5, 6])
def test_copies_edited_in_every_part_are_found(spark, every, whole):
    # an edited copy as the only one, and beside a whole one, whose runs that the edits cut are then the rarest
    item = [f"w{i}" for i in range(40)]
    copy = " ".join(f"x{i}" if i % every == every - 1 else w for i, w in enumerate(item))
    docs = docs_of(spark, [copy, "nothing of it"] + [" ".join(item)] * whole)
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {0, *range(2, 2 + whole)}
    assert got[0] == pytest.approx(slow_align(item, copy.split()) / 80)
