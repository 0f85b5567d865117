"""Token counts of every prefix, by dynamic programming over byte-pair tokens.

A sequence of tokens is what byte-pair merging gives if and only if every two neighbours are what merging
gives for their joined text.  So the last token of each prefix follows from the last tokens of shorter
prefixes: among the tokens that end the prefix, exactly one fits its predecessor.  The count at a prefix is
one more than at its predecessor.  A prefix of a word ends the word, so its last token is sought among those
that carry the end-of-word mark, the ones before it among those that do not.

The program runs once for each new word; counts at every character are kept by word and by white-space chunk.
A text's table is its chunks' counts on top of the running sum at their starts.  It answers how many tokens any
prefix has, and how much text fits a budget, without encoding again.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import KEEP_WORDS, LONG, Chunks, Pool, pieces
from .shared import lean_batches
from .worker import tool

KEEP_FITS = 600_000
COUNT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def joining() -> frozenset[str]:
    """Characters that may change or be changed by those before them in the composed normal form."""
    marks = {chr(c) for c in range(0x300, 0x110000) if unicodedata.combining(chr(c))}
    second = set()
    for c in map(chr, range(0xA0, 0x110000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", "".join(chr(int(p, 16)) for p in parts)) == c:
            second.add(chr(int(parts[1], 16)))
    return frozenset(marks | second | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))


class Prefixes(Chunks):
    """Counts at every prefix, for a vocabulary file with byte-level BPE and an end-of-word mark."""

    kind = "<i4"

    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        if not self.chunked or not self.end:
            raise ValueError(f"{path} is no byte-level vocabulary with an end-of-word mark")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.kinds: dict[str, int] = {}  # of a token without its mark: 1 if it may be inside a word, 2 at its end, 3 both
        for t in model["vocab"]:
            t, kind = (t[: -len(self.end)], 2) if t.endswith(self.end) else (t, 1)
            self.kinds[t] = self.kinds.get(t, 0) | kind
        self.most = max(map(len, self.kinds))
        self.tails: set[str] | None = None
        self.fits: dict[bool, dict[tuple[str, str], bool]] = {False: {}, True: {}}
        self.made: dict[str, tuple[str, str, int] | None] = {}
        self.words = Pool(self.kind)
        self.joins: frozenset[str] | None = None
        self.size_of: dict[str, int] = {}

    def _merge(self, parts: list[str], until: int = 1) -> list[str]:
        """Byte-pair merging of a few letters: the lowest rank first, the leftmost of equal ones."""
        get, never = self.rank.get, 1 << 60
        while len(parts) > until:
            ranks = [get(p, never) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == never:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _parts(self, token: str) -> tuple[str, str, int] | None:
        """The two tokens that merging makes ``token`` of last, and that merge's rank (-1: it is a letter).

        None if merging its letters gives something else.  The mark is part of the last letter.
        """
        if token not in self.made:
            body = token.removesuffix(self.end)
            letters = [*body[:-1], body[-1] + token[len(body) :]]
            self.made[token] = ("", "", -1) if len(letters) == 1 else None
            if len(letters) > 1 and len(halves := self._merge(letters, 2)) == 2 and (rank := self.rank.get(tuple(halves))) is not None:
                self.made[token] = (*halves, rank)
        return self.made[token]

    def _fit(self, a: str, b: str, ends: bool) -> bool:
        """Whether merging gives a, b for their joined text (b alone if a is empty), at the end of a word or not.

        ``a`` is what merging gives for its own text.  The merges of both are undone, the latest first; between
        the two undone halves that then meet no merge may come before the one undone (of equal ranks the left
        one comes first).
        """
        if len(self.fits[ends]) > KEEP_FITS:
            self.fits[ends].clear()
        left, right = a, b + self.end if ends else b
        ok, before = self._parts(right) is not None, 1 << 60
        while a and ok:
            ok = self.rank.get((left, right), before) >= before
            (_, inner, last), (outer, _, first) = self._parts(left), self._parts(right)
            if last < 0 and first < 0:
                break
            left, right, before = (inner, right, last) if last > first else (left, outer, first + 1)
        self.fits[ends][a, b] = ok
        return ok

    def _run(self, s: str, last: list[str], count: list[int], start: int = 0) -> list[int]:
        """Counts of the prefixes of lengths start + 1 to len(s) of a word in byte letters, each taken as a whole word.

        ``last`` and ``count`` are the last token and the number of tokens of each prefix that does not end the
        word; entries up to ``start`` are given, the others are filled in.
        """
        n, out, most, tails = len(s), [], self.most, None
        kinds, fit = self.kinds.get, self._fit
        fits_inner, fits_final = self.fits[False].get, self.fits[True].get
        if n > LONG:  # only what some token ends with is looked at
            if self.tails is None:
                self.tails = {t[i:] for t in self.kinds for i in range(len(t))}
            tails = self.tails
        for j in range(start + 1, n + 1):
            sought = 3 if j < n else 2  # kinds of last tokens that are still sought
            at = j - most if j > most else 0
            if tails is not None:
                low = j - 1
                while low > at and s[low - 1 : j] in tails:
                    low -= 1
                at = low
            for i in range(at, j):
                t = s[i:j]
                kind = kinds(t, 0) & sought
                if not kind:
                    continue
                a = last[i]
                if kind & 2:
                    ok = fits_final((a, t))
                    if ok or ok is None and fit(a, t, True):
                        out.append(count[i] + 1)
                        sought &= 1
                        if not sought:
                            break
                if kind & 1:
                    ok = fits_inner((a, t))
                    if ok or ok is None and fit(a, t, False):
                        last[j], count[j] = t, count[i] + 1
                        sought &= 2
                        if not sought:
                            break
            if sought:
                raise ValueError(f"no token ends {s[:j]!r}")
        return out

    def _bytes(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode()])

    def word(self, word: str) -> list[int]:
        """Counts at each character of a word (a piece of the split pattern)."""
        return self.many([word])[0]

    def many(self, words: list[str]) -> list[list[int]]:
        """word() of each of sorted words; what one has in common with the word before it is not done again."""
        done, before, last, count, out = [], "", [""], [0], []
        for word in words:
            s = word if word.isascii() and word.isprintable() else self._bytes(word)
            same = 0
            for x, y in zip(s, before, strict=False):
                if x != y:
                    break
                same += 1
            # at its own end, the word before has no token that goes on
            same = min(same, max(0, len(before) - 1))
            last, count = last[: same + 1] + [""] * (len(s) - same), count[: same + 1] + [0] * (len(s) - same)
            out = out[:same] + self._run(s, last, count, same)
            before, counts = s, out
            if len(s) != len(word):
                at, counts = -1, []
                for c in word:
                    at += len(c.encode())
                    counts.append(out[at])
            if len(word) > 1 and word[0] == "'" and word[1].isalpha():
                # a prefix that cuts a contraction is two words: the mark, and the letters so far
                mark = self.word("'")[0]
                counts = [mark, *(mark + self.word(word[1:j])[-1] for j in range(2, len(word))), out[-1]]
            done.append(counts)
        return done

    def learn(self, chunks: list[str]) -> None:
        import numpy as np

        if len(self.words.index) > KEEP_WORDS:
            self.words = Pool(self.kind)
        cut = list(map(self.cut, chunks))
        flat = list(chain.from_iterable(cut))
        new = set(flat).difference(self.words.index)
        long = [w for w in new if len(w) > LONG]
        for some in (sorted(new.difference(long)), sorted(long)):
            kept = self.words.n
            for at in range(0, len(some), 10_000):
                group = some[at : at + 10_000]
                counts = self.many(group)
                self.words.add(group, np.fromiter(chain.from_iterable(counts), dtype=np.int64), list(map(len, counts)))
        at = np.fromiter(map(self.words.index.__getitem__, flat), dtype=np.int64, count=len(flat))
        many = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        lens, stops = self.words.lens(at), np.cumsum(many)
        run = np.concatenate([[0], np.cumsum(self.words.last(at), dtype=np.int64)])
        # on top of the chunk's words before
        base = run[:-1] - np.repeat(run[stops - many], many)
        ends = np.concatenate([[0], np.cumsum(lens)])
        self.pool.add(chunks, self.words.take(at) + np.repeat(base, lens), ends[stops] - ends[stops - many])
        self.words.cut(kept, long)

    def learn_whole(self, texts: list[str]) -> None:
        """Texts with special tokens, which are one token each: the sum of what lies between them."""
        totals = []
        for text in texts:
            found = self.special.findall(text)
            totals.append(sum(self._count(self.normal(x)) for x in self.special.split(text)) + len(found))
        self.pool.add([None] * len(texts), totals, [1] * len(texts))

    def _count(self, normal: str) -> int:
        return sum(self.word(w)[-1] for c in normal.split(" ") for w in self.cut(c))

    def totals(self, texts):
        """The last value of the table of each text of an Arrow array: the running sum at the end of its chunks."""
        import numpy as np

        out = [np.zeros(0, dtype=np.int64)]
        for a, b in pieces(texts):
            numbers, counts = self.number(texts.slice(a, b - a))
            run = np.concatenate([[0], np.cumsum(self.pool.last(numbers), dtype=np.int64)])
            stops = np.cumsum(counts)
            out.append(run[stops] - run[stops - counts])
            self.release()
        return np.concatenate(out)

    # tables

    def table(self, text: str):
        """int64 array a: a[p] is the number of tokens of text[:p], for every p from 0 to len(text)."""
        import numpy as np

        parts, base, at = [np.zeros(1, dtype=np.int64)], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            # until its last character, a special token is plain text after what is before it
            piece = self._table(text[at : m.end() - 1])
            parts.append(base + piece[1:])
            base += int(piece[m.start() - at]) + 1
            parts.append(np.array([base]))
            at = m.end()
        parts.append(base + self._table(text[at:])[1:])
        return np.concatenate(parts)

    def _table(self, text: str):
        """As table(), for a text without special tokens: at the ends of its segments first, then inside them."""
        import numpy as np

        if not text:
            return np.zeros(1, dtype=np.int64)
        low = self.normal(text)
        numbers = self.number_normal(low)
        counts = self.pool.take(numbers).astype(np.int64)
        ends = self.pool.last(numbers).astype(np.int64)
        counts += np.repeat(np.cumsum(ends) - ends, self.pool.lens(numbers))
        self.release()
        code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        normal = np.zeros(len(low) + 1, dtype=np.int64)
        normal[1:][code != 32] = counts
        # white space keeps the count before it
        at = np.where(np.concatenate([[True], code != 32]), np.arange(len(normal)), 0)
        normal = normal[np.maximum.accumulate(at)]
        starts, sizes = self._segments(text)
        if sizes.sum() != len(low):
            raise ValueError("the normal form is not that of the segments in a row")
        stops = np.append(starts[1:], len(text))
        out = np.zeros(len(text) + 1, dtype=np.int64)
        run = np.cumsum(sizes)
        out[stops] = normal[run]
        inside = np.flatnonzero(stops - starts > 1)
        if len(inside):
            tail = Tails(self, low, normal)
            for k in inside.tolist():
                b, nb = int(starts[k]), int(run[k] - sizes[k])
                for p in range(b + 1, int(stops[k])):
                    out[p] = tail.count(nb, self.normal(text[b:p]))
        return out

    def _segments(self, text: str):
        """(starts, sizes): runs of characters whose normal form does not depend on others, and its length.

        A run of white space is one space, which its first character is counted with.
        """
        import numpy as np

        if self.joins is None:
            self.joins = joining()
        joins, known, normal = self.joins, self.size_of, self.normal
        starts = np.array([i for i, c in enumerate(text) if not i or c not in joins], dtype=np.int64)
        sizes, space = [], False
        if len(known) > KEEP_FITS:
            known.clear()
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(text)], strict=True):
            segment = text[a:b]
            size = known.get(segment)
            if size is None:
                form = normal(segment)
                # negative: it starts with white space
                size = known[segment] = -len(form) if form[:1] == " " else len(form)
            sizes.append(abs(size) - (size < 0 and space))
            space = size == -1
        return starts, np.array(sizes, dtype=np.int64)


class Tails:
    """Counts of prefixes of a normal text with a few other characters after them."""

    def __init__(self, pre: Prefixes, low: str, normal):
        self.pre, self.low, self.normal = pre, low, normal
        self.chunk = (0, -1, [])  # start, stop and the starts of its words, of the chunk seen last
        self.run: tuple[int, str, list, list] | None = None  # of a long word: start, letters, last tokens and counts

    def _word_start(self, at: int) -> int:
        """Start of the word that holds the character before ``at``."""
        if not self.chunk[0] < at <= self.chunk[1]:
            start, stop = self.low.rfind(" ", 0, at) + 1, self.low.find(" ", at)
            stop = len(self.low) if stop < 0 else stop
            self.chunk = (start, stop, [start + a for _, (a, _) in self.pre.split_any(self.low[start:stop])])
        starts = self.chunk[2]
        return starts[bisect.bisect_left(starts, at) - 1]

    def count(self, at: int, tail: str) -> int:
        pre = self.pre
        if tail[:1] == " " or not at or self.low[at - 1] == " ":
            return int(self.normal[at]) + pre._count(tail)
        start = self._word_start(at)
        before = int(self.normal[start])
        if at - start <= LONG:
            return before + pre._count(self.low[start:at] + tail)
        # a long word is a run of letters or of marks: a stand-in of its kind shows how much of the tail it takes
        kind = "a" if len(pre.split_any("!" + self.low[at - 1])) == 2 else "!"
        chunk, space, rest = tail.partition(" ")
        first, *others = pre.cut(kind + chunk)
        total = before + sum(pre.word(w)[-1] for w in others) + (pre._count(rest) if space else 0)
        if len(first) == 1:
            return total + int(self.normal[at]) - before
        if self.run is None or self.run[0] != start:
            s = pre._bytes(next(w for w, _ in pre.split_any(self.low[start : self.chunk[1]])))
            last, count = [""] * (len(s) + 2), [0] * (len(s) + 2)
            pre._run(s + "a", last, count)  # a letter more, so that no place in it ends the word
            self.run = (start, s, last, count)
        _, s, last, count = self.run
        n = len(self.low[start:at].encode())
        off = max(0, n - pre.most)
        more = pre._bytes(first[1:])
        pad = [""] * len(more), [0] * len(more)
        return total + pre._run(s[off:n] + more, last[off : n + 1] + pad[0], count[off : n + 1] + pad[1], n - off)[-1]


def prefixes(path: str) -> Prefixes:
    return tool(("prefixes", path), lambda: Prefixes(path))


def fits(table, budget: int) -> int:
    """Length of the longest prefix with at most ``budget`` tokens."""
    import numpy as np

    return int(np.flatnonzero(table <= budget)[-1])


def _counter(tokenizer: str, limit: int, tables: bool):
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        pre = prefixes(tokenizer)
        names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            sizes = pc.binary_length(texts).cast(pa.int64())
            if not tables:
                totals = pa.array(pre.totals(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, sizes, totals, pc.greater(totals, limit)], names=names)
                continue
            for a, b in pieces(texts, 1 << 20):
                found = [pre.table(t.as_py()) for t in texts.slice(a, b - a)]
                totals = pa.array([int(t[-1]) for t in found], pa.int64())
                columns = [ids.slice(a, b - a), sizes.slice(a, b - a), totals, pc.greater(totals, limit), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "prefix_tokens"])

    return count


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", tables: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; with ``tables`` also prefix_tokens, the count at every prefix.

    No shuffle: one pass, in time linear in the texts.  Null and empty texts have 0 tokens and the table [0];
    repeated rows and null ids stay as they are; an empty table gives an empty result; extra columns are dropped.
    A table has 8 bytes a character, in one row.
    """
    lean_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_counter(tokenizer, limit, tables), COUNT + (", prefix_tokens array<long>" if tables else ""))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenbin import default_tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, default_tokenizer())
