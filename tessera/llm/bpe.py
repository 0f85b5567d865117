"""Texts as numbered white-space chunks, and ids of them by a tokenizers file, for workers.

White space never joins two tokens of this family of tokenizers (white space is dropped, the split pattern
has none), so a text's ids are those of its white-space chunks in a row, and a chunk's those of the words
into which the split pattern cuts it.  Both repeat: a batch of texts is cut and numbered by Arrow, a new chunk
is looked at once, and what is known of chunks lies in one array, from which batches are gathered.

Plain characters (below) are lower-cased one by one and nothing composes; all other texts pass the library's
own normaliser first.  Texts that hold a special token of the file are treated as wholes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

from .worker import tool

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: What is not plain: characters from U+0250 on but for general punctuation, controls, no-break space, dotted capital I.
NOT_PLAIN = "[^\t\n\r\x20-\x7e\xa1-įı-ɏ‐-‧]"
ODD, MARKS = re.compile(NOT_PLAIN).search, frozenset(".,;:!?")
KEEP = 600_000  # chunks kept; the table starts anew when full
KEEP_WORDS = 800_000  # words (pieces of chunks) kept
LONG = 64  # characters beyond which neither is kept
TOGETHER = 100  # new words that the library sees as one text
PIECE_BYTES = 8 << 20  # of the texts that are numbered together
STEP = 1 << 20  # chunks gathered at once


class Pool:
    """Arrays of numbers for names, one after another in one array."""

    def __init__(self, kind: str):
        import numpy as np

        self.np, self.index, self.n = np, {}, 0
        self.values, self.ends = np.zeros(1 << 16, dtype=kind), np.zeros(1 << 12, dtype=np.int64)

    def add(self, names: list, values, lens) -> None:
        """``names`` (all None: reached by number only) with ``lens[i]`` of the ``values`` each."""
        np, k = self.np, len(names)
        if not k:
            return
        ends = self.ends[self.n] + np.cumsum(lens)
        while len(self.ends) <= self.n + k:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.values) < ends[-1]:
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.ends[self.n] : ends[-1]] = values
        self.ends[self.n + 1 : self.n + k + 1] = ends
        if names[0] is not None:
            self.index.update(zip(names, range(self.n, self.n + k), strict=True))
        self.n += k

    def cut(self, n: int, names: list) -> None:
        """Forget all from number ``n`` on, of which ``names`` are the names."""
        for name in names:
            del self.index[name]
        self.n = n

    def lens(self, at):
        return self.ends[at + 1] - self.ends[at]

    def last(self, at):
        """The last value of each; 0 of those without any."""
        np = self.np
        return np.where(self.lens(at) > 0, self.values[np.maximum(self.ends[at + 1] - 1, 0)], 0)

    def take(self, at):
        """Their values in a row."""
        np = self.np
        lens = self.lens(at)
        before = np.cumsum(lens) - lens
        return self.values[np.repeat(self.ends[at] - before, lens) + np.arange(lens.sum())]


def pieces(texts, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts that have about ``most`` bytes; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    run = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(run):
        stop = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


class Chunks:
    """Numbers the chunks of texts; a subclass says what is kept of a chunk."""

    kind = "<i8"

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path) as f:
            self.spec = json.load(f)
        steps = [x["type"] for x in (self.spec.get("normalizer") or {}).get("normalizers", [])]
        self.chunked = steps == ["NFC", "Replace", "Lowercase"]
        self.normal = self.lib.normalizer.normalize_str if self.chunked else None
        added = [t["content"] for t in self.spec.get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pool = Pool(self.kind)
        if self.chunked:
            import regex

            pattern = self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.split = regex.compile(pattern).findall
            # the library's own, whose tables of letters may be of another version of Unicode
            self.split_any = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
            # for words, which are normal: what is normal may change if it is made normal again
            self.bare = Tokenizer.from_file(path)
            self.bare.no_truncation()
            self.bare.no_padding()
            self.bare.normalizer = normalizers.Sequence([])

    def learn(self, chunks: list[str]) -> None:
        """Put what is kept of new normal chunks into the pool, in order."""
        raise NotImplementedError

    def learn_whole(self, texts: list[str]) -> None:
        """The same for whole texts that cannot be cut to chunks, without names."""
        raise NotImplementedError

    def cut(self, chunk: str) -> list[str]:
        """The split pattern's words; letters, and letters before one mark, need no pattern."""
        if not chunk.isascii() and ODD(chunk):
            return [word for word, _ in self.split_any(chunk)]
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.split(chunk)

    def number(self, texts) -> tuple:
        """(numbers of the chunks of all ``texts`` in order, how many each text has); release() must follow."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self._begin()
        odd = np.asarray(pc.match_substring_regex(texts, NOT_PLAIN)) if self.chunked else np.ones(len(texts), dtype=bool)
        special = np.zeros(len(texts), dtype=bool)
        if not self.chunked:
            special[:] = True
        elif self.special is not None:
            special = np.asarray(pc.match_substring_regex(texts, self.special.pattern))
        if not (odd | special).any():
            lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
            return self._known(lists.flatten()), np.asarray(pc.list_value_length(lists), dtype=np.int64)
        parts, counts = [], np.zeros(len(texts), dtype=np.int64)
        rows = np.flatnonzero(~odd & ~special)
        if len(rows):
            lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.take(pa.array(rows))))
            counts[rows] = np.asarray(pc.list_value_length(lists))
            parts.append((rows, self._known(lists.flatten())))
        rows = np.flatnonzero(odd & ~special)
        if len(rows):
            lists = pc.split_pattern(pa.array([self.normal(texts[int(i)].as_py()) for i in rows], texts.type), " ")
            counts[rows] = np.asarray(pc.list_value_length(lists))
            parts.append((rows, self._known(lists.flatten())))
        rows = np.flatnonzero(special)
        if len(rows):
            counts[rows] = 1
            first = self.pool.n
            self.learn_whole([texts[int(i)].as_py() for i in rows])
            parts.append((rows, np.arange(first, self.pool.n)))
        out, start = np.zeros(counts.sum(), dtype=np.int64), np.cumsum(counts) - counts
        for rows, numbers in parts:
            n = counts[rows]
            out[np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(len(numbers))] = numbers
        return out, counts

    def number_normal(self, text: str):
        """As number(), of one text in normal form, in which nothing is special any more."""
        import pyarrow as pa
        import pyarrow.compute as pc

        self._begin()
        return self._known(pc.split_pattern(pa.array([text]), " ").flatten())

    def _begin(self) -> None:
        if len(self.pool.index) > KEEP:
            self.pool = Pool(self.kind)
        self.kept, self.brief = self.pool.n, []

    def _known(self, flat):
        """The number of each chunk of a flat array; new ones are learnt, long ones last."""
        import numpy as np

        coded = flat.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        own = np.fromiter(map(self.pool.index.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(own < 0)
        if len(new):
            long = np.fromiter(map(len, names[new]), dtype=np.int64, count=len(new)) > LONG
            # once long ones are there, what comes after them goes with them
            groups = (new[~long], new[long]) if not self.brief else (new[:0], new)
            for some, keep in zip(groups, (True, False), strict=True):
                chunks = names[some].tolist()
                own[some] = np.arange(self.pool.n, self.pool.n + len(some))
                self.learn(chunks)
                if keep and not self.brief:
                    self.kept = self.pool.n
                elif not keep:
                    self.brief += chunks
        return own[np.asarray(coded.indices)] if len(names) else own

    def release(self) -> None:
        """Forget what is not kept, once the numbers are used."""
        self.pool.cut(self.kept, self.brief)
        self.brief = []


class Encoder(Chunks):
    """ids of whole texts, exactly as the library gives them."""

    def __init__(self, path: str, width: int = 2):
        import numpy as np

        self.kind = {2: "<u2", 4: "<u4"}[width]
        super().__init__(path)
        self.words = Pool(self.kind)
        end = (self.spec["model"].get("end_of_word_suffix") or "") if self.chunked else ""
        if self.chunked and not end:
            self.chunked = False
        vocabulary = self.lib.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if self.chunked:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(end)]] = True

    def _words(self, words: list[str]) -> None:
        """New words, many in a text: each word's last id, and no other, carries the end-of-word mark."""
        import numpy as np

        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, got in zip(groups, self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(got.ids, dtype=self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group) or stops[-1] != len(ids):  # a word of which the library makes several
                each = [np.asarray(e.ids, dtype=self.kind) for e in self.bare.encode_batch_fast(group, add_special_tokens=False)]
                ids, lens = np.concatenate(each), np.array([len(e) for e in each])
            else:
                lens = np.diff(stops, prepend=0)
            self.words.add(group, ids, lens)

    def learn(self, chunks: list[str]) -> None:
        import numpy as np

        if len(self.words.index) > KEEP_WORDS:
            self.words = Pool(self.kind)
        cut = list(map(self.cut, chunks))
        flat = list(chain.from_iterable(cut))
        new = set(flat).difference(self.words.index)
        long = [w for w in new if len(w) > LONG]
        self._words(list(new.difference(long)))
        kept = self.words.n
        self._words(long)
        at = np.fromiter(map(self.words.index.__getitem__, flat), dtype=np.int64, count=len(flat))
        many = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        run = np.concatenate([[0], np.cumsum(self.words.lens(at))])
        stops = np.cumsum(many)
        self.pool.add(chunks, self.words.take(at), run[stops] - run[stops - many])
        self.words.cut(kept, long)

    def learn_whole(self, texts: list[str]) -> None:
        import numpy as np

        got = [np.asarray(e.ids, dtype=self.kind) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        self.pool.add([None] * len(texts), np.concatenate(got), [len(g) for g in got])

    def encode(self, texts, end_id: int | None = None) -> Iterator[tuple]:
        """(ids, number of ids of each text) for runs of an Arrow array of texts, each followed by ``end_id``.

        The ids of a run come as a list of arrays.
        """
        import numpy as np

        for a, b in pieces(texts):
            numbers, counts = self.number(texts.slice(a, b - a))
            if end_id is not None:
                end = self.pool.n
                self.pool.add([None], [end_id], [1])
                numbers = np.insert(numbers, np.cumsum(counts), end)
                counts = counts + 1
            run = np.concatenate([[0], np.cumsum(self.pool.lens(numbers))])
            stops = np.cumsum(counts)
            yield [self.pool.take(numbers[i : i + STEP]) for i in range(0, len(numbers), STEP)], run[stops] - run[stops - counts]
            self.release()


def encoder(path: str, width: int = 2) -> Encoder:
    return tool(("encoder", path, width), lambda: Encoder(path, width))
