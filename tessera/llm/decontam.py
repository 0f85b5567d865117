"""Benchmark decontamination: rare n-gram seeds find places, Smith-Waterman alignment scores them.

Pass one counts every three-word run of the items over all documents.  The seeds are, of every four
neighbouring runs of an item, the one that the corpus has least often of those that it has: each part of an
item keeps a seed, however common the passage is, and the seeds are as rare as they can be.  Pass two joins
passages to items by these seeds, as numbers, and aligns each item with the words around its seeds.
An edited copy beside a whole one may hold only runs that are not the rarest, so places where a document has
other runs of an item are aligned too, unless they have too few of its words for the least score.  The score is the
best local alignment's (match 2, mismatch and gap -1) as a share of the item's own; edited and paraphrased
copies lose a little for each edit.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import pieces
from .shared import lean_batches, materialize

GRAM, WINDOW, SCORE = 3, 4, 0.4
BLOCK_CHARS = 4_000_000  # of item texts searched for at once; larger sets go in blocks
FOUND = "doc_id long, item_id long, score double, start_word long, stop_word long"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    import pyarrow as pa

    words, _ = batch_words(pa.array([text or ""]))
    return words.to_pylist()


def batch_words(texts) -> tuple:
    """(words of all texts of an Arrow array in a row, how many each text has)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = np.full(256, 32, dtype=np.uint8)
    table[128:] = np.arange(128, 256)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
        table[c] = table[ord(chr(c).upper())] = c
    table[ord("_")] = ord("_")
    # beyond ASCII only letters that are in lower case, and digits: whole buffers are mapped byte by byte
    odd = pc.match_substring_regex(texts, r"[^\x00-\x7f\p{Ll}\p{Lo}\p{Lm}\pN]")
    if pc.any(odd, min_count=0).as_py():
        texts = pc.replace_with_mask(texts, odd, pc.replace_substring_regex(pc.utf8_lower(texts.filter(odd)), r"[^\pL\pN_]+", " "))
    _, ends, data = texts.buffers()
    if data is not None:
        mapped = pa.py_buffer(table[np.frombuffer(data, dtype=np.uint8)])
        texts = type(texts).from_buffers(len(texts), ends, mapped, offset=texts.offset)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    solid = np.asarray(pc.greater(pc.binary_length(flat), 0))
    run = np.concatenate([[0], np.cumsum(solid)])
    stops = np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))
    counts = np.diff(run[np.concatenate([[0], stops])])
    return (flat if solid.all() else flat.filter(pa.array(solid))), counts


def grams_of(words: list[str], n: int = GRAM) -> list[str]:
    """Runs of n words in order; fewer words are one run, no word is none."""
    if len(words) < n:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def seeds_of(grams: list[str], count: dict[str, int], window: int = WINDOW) -> set[str]:
    """The rarest run (first in order of letters if equal) of those that occur in every ``window`` neighbouring runs."""
    key = lambda g: (count[g], g)
    near = ([g for g in grams[i : i + window] if count.get(g, 0)] for i in range(max(1, len(grams) - window + 1)))
    return {min(on, key=key) for on in near if on}


def align(item, passage, least: float = 1) -> tuple[int, int, int]:
    """(score, start, stop): best local alignment of two arrays of word numbers; the place is in ``passage``.

    A score below ``least`` is given as 0, without a place.

    Row by row; a gap in the passage's direction is a running maximum, so each row is a few array steps.
    """
    import numpy as np

    def best(a, b):
        n = len(b)
        row, at = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
        top, end, used = 0, 0, 0
        for i, w in enumerate(a):
            new = np.maximum(row - 1, 0)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == w, 2, -1))
            new = np.maximum.accumulate(new + at) - at
            row = new
            k = int(row.argmax())
            if row[k] > top:
                top, end, used = int(row[k]), k, i + 1
        return top, end, used

    top, stop, used = best(item, passage)
    if top < max(least, 1):
        return 0, 0, 0
    _, back, _ = best(item[:used][::-1], passage[:stop][::-1])
    return top, stop - back, stop


class Runs:
    """Known runs of words, as numbers: each place of a text where one stands is found by array steps."""

    def __init__(self, grams: list[str]):
        import numpy as np
        import pyarrow as pa

        words = sorted({w for g in grams for w in g.split(" ")})
        self.words, self.n = pa.array(words, pa.string()), len(words)
        self.number = {w: i for i, w in enumerate(words)}
        self.by_length = []
        for length in sorted({g.count(" ") + 1 for g in grams}):
            own = [(self._code([self.number[w] for w in g.split(" ")]), i) for i, g in enumerate(grams) if g.count(" ") + 1 == length]
            codes, at = zip(*sorted(own), strict=True)
            self.by_length.append((length, np.array(codes, dtype=np.int64), np.array(at, dtype=np.int64)))

    def _code(self, numbers):
        code = numbers[0]
        for x in numbers[1:]:
            code = code * self.n + x
        return code

    def numbers(self, texts) -> tuple:
        """(number of each word of all texts, -1 if it is in no run; which text it is of; how many each text has)."""
        import numpy as np
        import pyarrow.compute as pc

        words, counts = batch_words(texts)
        value_set = self.words.cast(words.type)
        numbers = np.asarray(pc.fill_null(pc.index_in(words, value_set=value_set), -1), dtype=np.int64)
        return numbers, np.repeat(np.arange(len(counts)), counts), counts

    def find(self, numbers, of) -> tuple:
        """(place of the first word, words, number of the run) of each run that stands in a text."""
        import numpy as np

        out = [(np.zeros(0, dtype=np.int64),) * 3]
        for length, codes, at in self.by_length:
            known = numbers >= 0
            here = known[: len(numbers) - length + 1].copy()
            for k in range(1, length):
                here &= known[k : len(numbers) - length + 1 + k]
            place = np.flatnonzero(here)
            place = place[of[place] == of[place + length - 1]]
            code = self._code([numbers[place + k] for k in range(length)])
            i = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[i] == code
            out.append((place[hit], np.full(hit.sum(), length), at[i[hit]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _counter(grams: list[str]):
    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        runs, total = Runs(grams), np.zeros(len(grams), dtype=np.int64)
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                numbers, of, _ = runs.numbers(batch.column(0).slice(a, b - a))
                total += np.bincount(runs.find(numbers, of)[2], minlength=len(grams))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on], pa.int64())], names=["gram", "n"])

    return count


def _finder(items: list[tuple[int, list[str]]], grams: list[str], owners: list[list[tuple[int, bool]]], least: float):
    """``owners``: of each run, the items that have it, and if it is a seed of the item."""

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        runs = Runs(grams)
        # words that are in no run that occurs count as words that stand nowhere
        coded = [np.array([runs.number.get(w, -2) for w in ws]) for _, ws in items]
        many = np.array([len(o) for o in owners], dtype=np.int64)
        first = np.cumsum(many) - many
        owner = np.array([i for o in owners for i, _ in o], dtype=np.int64)
        seeds = np.array([s for o in owners for _, s in o], dtype=bool)
        near = np.zeros(runs.n + 2, dtype=bool)  # the last two are for words without a number
        for batch in batches:
            out = []
            ids = batch.column(0)
            for a, b in pieces(batch.column(1)):
                numbers, of, counts = runs.numbers(batch.column(1).slice(a, b - a))
                place, length, run = runs.find(numbers, of)
                if not len(place):
                    continue
                start = np.cumsum(counts) - counts
                n = many[run]
                own = np.repeat(first[run], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                item, seed, at = owner[own], seeds[own], np.repeat(place + length, n)
                text = of[np.repeat(place, n)]
                order = np.lexsort((at, item, text))
                text, item, at, seed = text[order], item[order], at[order], seed[order]
                reach = np.array([2 * len(c) + GRAM for c in coded])[item]
                pair = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])
                group = np.flatnonzero(pair | np.concatenate([[True], np.diff(at) > 2 * reach[1:]]))
                stop = np.append(group[1:], len(at))
                rare = np.logical_or.reduceat(seed, group)
                best: dict[tuple[int, int], tuple] = {}
                for g, h, seeded in zip(group.tolist(), stop.tolist(), rare.tolist(), strict=True):
                    t, k = int(text[g]), int(item[g])
                    lo, hi = max(int(start[t]), int(at[g] - reach[g])), min(int(start[t] + counts[t]), int(at[h - 1] + reach[g]))
                    window, words = numbers[lo:hi], coded[k]
                    if not seeded:
                        # a word of the item that is not near scores nothing, so this score cannot be reached
                        near[window] = True
                        near[-2:] = False
                        share = near[words].sum() / len(words)
                        near[window] = False
                        if share < least:
                            continue
                    score, x, y = align(words, window, 2 * len(words) * least - 1e-6)
                    best[t, k] = max(best.get((t, k), (0, 0, 0)), (score, -(lo + x - int(start[t])), lo + y - int(start[t])))
                for (t, k), (score, x, y) in best.items():
                    share = score / (2 * len(coded[k]))
                    if share >= least:
                        out.append((ids[a + t].as_py(), items[k][0], share, -x, y))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "score", "start_word", "stop_word"])

    return find


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Items in blocks of bounded size, as lists of (item_id, words)."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK_CHARS)) if total > BLOCK_CHARS else 1
    for b in range(n):
        got = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect() if n > 1 else rows.collect()
        yield sorted(((r["i"], w) for r in got if (w := words_of(r["t"]))), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SCORE) -> DataFrame:
    """doc_id, item_id, score, start_word, stop_word: each document and item that align with ``least`` or more.

    The place is the best alignment's, in words of the document.  Defined cases: null and wordless texts and
    items match nothing; an item of fewer than three words is its own seed; an item that is listed twice with
    one text is one; repeated documents give repeated rows; null ids stay null; empty tables give an empty
    result; extra columns are dropped.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    lean_batches(df.sparkSession)
    out = None
    for items in _blocks(benchmark, item_col, item_text):
        grams = sorted({g for _, w in items for g in grams_of(w)})
        if not grams:
            continue
        counted = docs.select("text").mapInArrow(_counter(grams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        count = {grams[r["gram"]]: r["n"] for r in counted}
        owners: dict[str, list[tuple[int, bool]]] = {}
        for k, (_, w) in enumerate(items):
            own = grams_of(w)
            seeds = seeds_of(own, count)
            for g in dict.fromkeys(own):
                if g in count:
                    owners.setdefault(g, []).append((k, g in seeds))
        # every run of the items, so that all their words have numbers; those that do not occur are nobody's
        found = docs.mapInArrow(_finder(items, grams, [owners.get(g, []) for g in grams], least), FOUND)
        out = found if out is None else out.union(found)
    return out if out is not None else df.sparkSession.createDataFrame([], FOUND)


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SCORE) -> DataFrame:
    """``df`` without the rows whose text is contaminated; all columns stay, null texts too."""
    # texts, not ids, are dropped: ids may be null or shared
    key = F.xxhash64(F.col(f"`{text_col}`"))
    keyed = df.select(F.col(f"`{text_col}`").alias("text"), key.alias("doc_id"))
    name = next(n for i in range(len(df.columns) + 1) if (n := f"_bad{i}") not in {c.lower() for c in df.columns})
    bad = contaminated(keyed, benchmark, least=least).select(F.col("doc_id").alias(name)).distinct()
    return df.join(materialize(bad, "dc_bad"), key == F.col(name), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
