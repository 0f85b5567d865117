"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

A text is a weighted set: its runs of five words, each with its number of occurrences.  DartMinHash throws
darts into the plane of weight by rank above each element: the plane is cut into dyadic regions, a region's
hash tells how many darts it holds (Poisson) and where, and a dart counts if it lies below the element's
weight.  Each dart names one of the signature's coordinates; the dart of lowest rank per coordinate is kept.
Two sets agree in a coordinate with probability equal to their weighted Jaccard similarity.  Only about
k ln k + 2k darts are looked at per text, whatever its length; should a coordinate stay empty, the next band
of ranks is opened.

Bands of five coordinates bring texts together.  Within a bucket no pairs are listed.  A pivot (the member whose
buckets are fullest, so the likely centre of its group) is compared with the others on their texts, and links are
merged to components.  What has one pivot is one group from there on.  Groups that lie in one component are done;
in the others every two members of different components whose sizes allow it are still compared, in blocks of
bounded size that hold hashed sets instead of texts: a task gets two blocks, counts all their shared elements at
once, and gives only links that join components.  So no link between texts that share a band is given up, and no
row is made for a pair.

Words are runs of letters and digits.  A text in a script without spaces between words is one or few words, so only
its exact copies, and copies that share whole runs of five clauses, are found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, materialize
from .worker import tool

SHINGLE, SIMILAR = 5, 0.8
BANDS, WIDTH = 24, 5
BLOCK, ELEMENTS = 128, 1 << 18  # members, and elements, in a block
COLUMNS = 1 << 13  # elements that two blocks are compared by at once
K = BANDS * WIDTH
WORDS = re.compile(r"\w+")
KEEP_WORDS = 500_000
M1, M2, GOLD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def _mix(x):
    """Finaliser of splitmix64 on an array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(M2)
    return x ^ (x >> np.uint64(31))


def _unit(x):
    import numpy as np

    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Shingles:
    """Hashed word runs of texts; word hashes are kept."""

    def __init__(self, n: int = SHINGLE):
        self.n, self.kept = n, {}

    def words(self, text: str):
        import numpy as np
        from xxhash import xxh3_64_intdigest

        words = WORDS.findall(text.lower())
        kept = self.kept
        try:
            return np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(kept) > KEEP_WORDS:
                kept.clear()
            for w in words:
                if w not in kept:
                    kept[w] = xxh3_64_intdigest(w)
            return np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))

    def weighted(self, text: str):
        """(elements, weights): distinct runs of n words and how often each occurs; fewer words are one run."""
        import numpy as np

        w = self.words(text)
        if not len(w):
            return w, np.zeros(0)
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = _mix((h + np.uint64(GOLD)) ^ w[i : len(w) - n + 1 + i])
        elements, counts = np.unique(h, return_counts=True)
        return elements, counts.astype(np.float64)


    def expanded(self, text: str):
        """The weighted set as a plain one: an element for each copy, sorted."""
        import numpy as np

        elements, counts = self.weighted(text)
        n = counts.astype(np.int64)
        if not len(n) or n.max() == 1:
            return elements
        copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(over="ignore"):
            out = np.repeat(elements, n) + copy.astype(np.uint64) * np.uint64(GOLD)
        return np.sort(out)


def inside(x, y):
    """Which elements of the sorted ``x`` are in the sorted ``y``."""
    import numpy as np

    if not len(y):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x


def similarity(x, y) -> float:
    """Jaccard similarity of two plain sets."""
    shared = int(inside(x, y).sum())
    return shared / (len(x) + len(y) - shared) if shared else 0.0


class Darts:
    """DartMinHash of weighted sets into k coordinates."""

    def __init__(self, k: int = K):
        import numpy as np

        self.k, self.np = k, np
        self.need = k * (math.log(k) + 2)  # darts that fill all coordinates with high probability
        self.first = self.need / 2**15  # the lowest band of ranks; each next one doubles what is open
        n = np.arange(64)
        self.low = np.where(n == 0, 0.0, 2.0 ** (n - 1))  # of cells of weight, and of bands times first
        self.wide = np.where(n == 0, 1.0, self.low)
        step = np.maximum(n - 1, 0)
        self.power = step[:, None] + step[None, :]  # a region holds first * 2 ** power darts on average
        self.none = np.exp(-self.first * 2.0**self.power)
        with np.errstate(over="ignore"):
            self.seed = (n.astype(np.uint64)[:, None] * np.uint64(64) + n.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(GOLD)
        self.cdf: dict[int, object] = {}

    def _poisson(self, power: int):
        if power not in self.cdf:
            mean = self.first * 2.0**power
            top = int(mean + 12 * math.sqrt(mean) + 24)
            logs = [i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(top)]
            self.cdf[power] = self.np.cumsum(self.np.exp(logs))
        return self.cdf[power]

    def _throw(self, x, w, cell, first: int, last: int):
        """(coordinate, rank, id) of the darts below the elements' weights in bands ``first`` to ``last``.

        ``x``, ``w`` and ``cell`` have an entry for each element and cell of weight that it reaches.
        """
        np = self.np
        h = _mix(x[:, None] + self.seed[cell, first : last + 1])
        u = _unit(h)
        row, col = np.nonzero(u > self.none[cell, first : last + 1])
        u, h, c, b = u[row, col], h[row, col], cell[row], col + first
        n = np.ones(len(row), dtype=np.int64)
        power = self.power[c, b]
        for p in np.unique(power):
            on = power == p
            n[on] = np.searchsorted(self._poisson(int(p)), u[on])
        own = np.repeat(np.arange(len(row)), n)
        j = np.arange(1, len(own) + 1, dtype=np.uint64) - np.repeat(np.cumsum(n) - n, n).astype(np.uint64)
        dart = _mix(h[own] + j * np.uint64(GOLD))
        a = _mix(dart + np.uint64(1))
        below = self.low[c][own] + self.wide[c][own] * _unit(a) < w[row][own]
        dart, a, b = dart[below], a[below], b[own][below]
        r = _mix(a + np.uint64(GOLD))
        rank = self.first * (self.low[b] + self.wide[b] * _unit(r))
        return (_mix(r + np.uint64(GOLD)) % np.uint64(self.k)).astype(np.int64), rank, dart

    def signature(self, elements, weights):
        np = self.np
        best = np.full(self.k, np.inf)
        out = np.zeros(self.k, dtype=np.uint64)
        reach = 1 + np.ceil(np.log2(np.maximum(weights, 1.0))).astype(np.int64)
        own = np.repeat(np.arange(len(weights)), reach)
        cell = np.arange(len(own)) - np.repeat(np.cumsum(reach) - reach, reach)
        x, w = elements[own], weights[own]
        first, last = 0, max(0, math.ceil(math.log2(self.need / (self.first * weights.sum()))))
        with np.errstate(over="ignore"):
            while True:
                at, rank, dart = self._throw(x, w, cell, first, last)
                order = np.argsort(-rank)  # the lowest rank is written last
                at, rank, dart = at[order], rank[order], dart[order]
                low = np.full(self.k, np.inf)
                low[at] = rank
                ids = np.zeros(self.k, dtype=np.uint64)
                ids[at] = dart
                new = low < best
                best[new], out[new] = low[new], ids[new]
                if np.isfinite(best).all():
                    return out
                first = last = last + 1

    def bands(self, signature, bands: int = BANDS):
        """A 64-bit key for each band of coordinates, different between bands."""
        np = self.np
        rows = signature.reshape(bands, -1)
        h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLD)
        with np.errstate(over="ignore"):
            for i in range(rows.shape[1]):
                h = _mix(h ^ rows[:, i]) + np.uint64(GOLD)
        return h.view(np.int64)


def _tools() -> tuple[Shingles, Darts]:
    return tool("shingles", lambda: (Shingles(), Darts()))


def _sign(batches: Iterator) -> Iterator:
    import pyarrow as pa

    cut, darts = _tools()
    for batch in batches:
        texts, keys = batch.column(1), []
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            e, w = cut.weighted(text) if text else ((), ())
            keys.append(darts.bands(darts.signature(e, w)) if len(e) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])


def _verify(similar: float):
    """Of pairs (a, b) with their texts those that are similar."""

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cut, kept = _tools()[0], {}

        def of(node, text):
            if node not in kept:
                if len(kept) >= 128:
                    kept.clear()
                kept[node] = cut.expanded(text.as_py())
            return kept[node]

        for batch in batches:
            a, b, ta, tb = batch.columns
            keep = [similarity(of(a[i].as_py(), ta[i]), of(b[i].as_py(), tb[i])) >= similar for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _sets(batches: Iterator) -> Iterator:
    """node, set (its sorted elements, eight bytes each) and their number, of (node, text)."""
    import pyarrow as pa

    cut = _tools()[0]
    for batch in batches:
        found = [cut.expanded(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(map(len, found), pa.int64())], names=["node", "set", "e"])


def shared_counts(a: list, b: list, step: int = COLUMNS):
    """How many elements each set of ``a`` shares with each of ``b``: products of 0-1 matrices, ``step`` elements at a time."""
    import numpy as np

    common = np.intersect1d(*(np.unique(np.concatenate(r)) for r in (a, b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, len(common), step):
        some = common[at : at + step]
        parts = []
        for r in (a, b):
            m = np.zeros((len(r), len(some)), dtype=np.float32)
            for line, x in zip(m, r, strict=True):
                lo, hi = np.searchsorted(x, some[0]), np.searchsorted(x, some[-1], side="right")
                place = np.searchsorted(some, x[lo:hi])
                line[place[some[place] == x[lo:hi]]] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _between(similar: float):
    """Links (a, b) between two blocks of (node, comp, set) that join different components."""

    def between(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def block(rows):
            rows = rows.values
            return rows.field(0).to_pylist(), rows.field(1).to_pylist(), [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.field(2)]

        for batch in batches:
            ends: tuple[list, list] = [], []
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                (na, ca, a), (nb, cb, b) = block(left), block(right)
                shared = shared_counts(a, b)
                sizes = [np.array([len(x) for x in r]) for r in (a, b)]
                found = shared / (sizes[0][:, None] + sizes[1][None, :] - shared) >= similar - 1e-9
                up: dict[bytes, bytes] = {}
                for i, j in zip(*np.nonzero(found), strict=True):
                    p, q = ca[i], cb[j]
                    while p in up:
                        p = up[p]
                    while q in up:
                        q = up[q]
                    if p != q:
                        up[p] = q
                        ends[0].append(na[i])
                        ends[1].append(nb[j])
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.binary()) for e in ends], names=["a", "b"])

    return between


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of its component for each node of ``edges`` (a, b).

    Each round takes the smallest label among the neighbours, then follows labels once (pointer jumping).
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("_c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_m"))
        low = materialize(labels.join(near, "node").select("node", F.least("comp", "_m").alias("comp"), F.col("comp").alias("_old")), "labels")
        up = low.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        before, labels = labels, materialize(low.join(up, "comp").select("node", F.col("_up").alias("comp"), (F.col("_up") != F.col("_old")).alias("_moved")), "labels")
        forget(before, low)
        if not labels.filter("_moved").limit(1).count():
            forget(both)
            return labels.select("node", "comp")


def _blocks(groups: DataFrame, comps: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(left, right): pairs of blocks of (node, comp, set) that hold a group's members of different components.

    A component of many members has blocks of its own, which need no comparison with each other; members of
    small ones share blocks.  Blocks are of one class of set sizes, and only those of equal and neighbouring
    classes meet: sets farther apart in size cannot be similar.  A block holds at most about BLOCK members and
    ELEMENTS elements.  Groups in one component are left out, and of equal groups all but one.
    """
    groups = materialize(groups.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "dd_groups")
    parts = materialize(groups.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x")), "dd_parts")
    live = parts.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("n"), F.bit_xor("x").alias("x")).filter("many > 1")
    live = materialize(live.groupBy("n", "x").agg(F.min("h").alias("h")).select("h"), "dd_live")
    own = groups.join(live, "h").join(parts.select("h", "comp", F.col("n").alias("own")), ["h", "comp"])
    sets = materialize(own.select("node").distinct().join(texts, "node").select("node", "text").mapInArrow(_sets, "node binary, set binary, e long"), "dd_sets")
    # a little wider than the ratio of sizes that similar sets can have
    size = F.floor(F.log("e") / F.lit(math.log(1 / similar) * (1 + 1e-9))).cast("int")
    large = F.col("own") >= BLOCK
    own = own.join(sets.select("node", "e"), "node").select("h", "node", F.when(large, F.col("comp")).alias("alone"), "comp", size.alias("size"), "e")
    placed = materialize(own, "dd_own")
    often = placed.groupBy("h", "alone", "size").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("e") / ELEMENTS)).alias("many"))
    on = (F.col("h") == F.col("_h")) & F.col("alone").eqNullSafe(F.col("_alone")) & (F.col("size") == F.col("_size"))
    placed = placed.join(often.toDF("_h", "_alone", "_size", "many"), on)
    slot = F.pmod(F.xxhash64(F.when(F.col("alone").isNull(), F.col("comp")).otherwise(F.col("node"))), F.col("many"))
    rows = placed.select("h", "alone", "size", slot.alias("slot"), "node", "comp").join(sets.select("node", "set"), "node")
    blocks = rows.groupBy("h", "alone", "size", "slot").agg(F.collect_list(F.struct("node", "comp", "set")).alias("rows"))
    blocks = materialize(blocks.withColumn("b", F.xxhash64("h", "alone", "size", "slot")), "dd_blocks")
    one = blocks.select("h", F.col("alone").alias("a1"), F.col("size").alias("s1"), F.col("b").alias("b1"), F.explode(F.array("size", F.col("size") + 1)).alias("size"))
    two = blocks.select("h", F.col("alone").alias("a2"), F.col("b").alias("b2"), "size")
    # pairs of blocks, not of members
    pairs = one.join(two, ["h", "size"]).filter("(s1 < size OR b1 <= b2) AND NOT coalesce(a1 = a2, false)")
    pairs = materialize(pairs.select("b1", "b2"), "dd_block_pairs")
    left = blocks.select(F.col("b").alias("b1"), F.col("rows").alias("left"))
    return pairs.join(left, "b1").join(blocks.select(F.col("b").alias("b2"), F.col("rows").alias("right")), "b2").select("left", "right")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(documents, nodes).

    documents: doc_id, node (md5 of the text), class_id, one row for each row of ``df``; class_id is the
    smallest id of the class.  nodes: node, comp, rep, class_node, class_id, one row a distinct text; ``class_node``
    is the text of the class's representative, ``rep`` the smallest id that has the node's text.

    Defined cases: a null text is in a class of its own (node null, class_id its own id); equal texts are
    always one class; texts without words are in the class of their exact copies only; a text of fewer than
    five words is one element; ids that are null come after all others and give class_id null if no other is in
    the class; an empty table gives empty results; extra columns are dropped.
    """
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("node"))
    signed = materialize(rows.mapInArrow(_sign, "doc_id long, node binary, bands array<long>"), "dd_signed")
    nodes = materialize(signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "dd_nodes")
    keyed = nodes.select("node", F.explode("bands").alias("h"))
    full = materialize(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "dd_buckets")
    met = keyed.join(full, "h").groupBy("node").agg(F.collect_list("h").alias("hs"), F.sum("c").alias("pop"))
    members = materialize(met.select(F.explode("hs").alias("h"), "node", "pop"), "dd_members")
    found = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = rows.join(found.withColumnRenamed("node", "_n"), (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    texts = materialize(texts.dropDuplicates(["node"]), "dd_texts")
    with_text = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    pivots = members.groupBy("h").agg(F.max(F.struct("pop", "node")).alias("p")).select("h", F.col("p.node").alias("a"))
    pairs = members.join(materialize(pivots, "dd_pivots"), "h").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    pairs = materialize(pairs, "dd_pairs")
    with_texts = pairs.join(with_text("a"), "a").join(with_text("b"), "b").select("a", "b", "text_a", "text_b")
    links = materialize(with_texts.mapInArrow(_verify(similar), "a binary, b binary"), "dd_links")
    comps = components(links)
    # all bands with one pivot are one group from here on; pivots have met their groups
    rest = pairs.select(F.xxhash64("a").alias("h"), F.col("b").alias("node"))
    more = materialize(_blocks(rest, comps, texts, similar).mapInArrow(_between(similar), "a binary, b binary"), "dd_more")
    if more.limit(1).count():
        comps = components(links.union(more))
    named = nodes.select("node", "rep")
    named = named.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = named.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("n"), F.col("rep").alias("r"), F.col("node").alias("d"))).alias("m"))
    best = best.select(F.col("comp").alias("_c"), F.col("m.d").alias("class_node"), F.col("m.r").alias("class_id"))
    nodes = materialize(named.join(best, F.col("comp") == F.col("_c")).drop("_c"), "dd_classes")
    of = nodes.select(F.col("node").alias("_n"), F.col("class_id").alias("_k"))
    whole = signed.select("doc_id", "node").join(of, F.col("node") == F.col("_n"), "left")
    documents = whole.select("doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_k")).alias("class_id"))
    return documents, nodes


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``df`` with one document of each class: the one with the smallest id; all columns stay.

    Rows with a null text all stay.  Of repeated rows (same id and text) one stays.
    """
    documents, nodes = classes(df, id_col, text_col, similar)
    keep = nodes.filter("node = class_node").select(F.col("node").alias("_dd_n"), F.col("rep").alias("_dd_r"))
    again = documents.filter("node IS NOT NULL").groupBy("node", "doc_id").count().filter("count > 1").select(F.col("node").alias("_dd_m")).distinct()
    keep = materialize(keep.join(again, F.col("_dd_n") == F.col("_dd_m"), "left"), "dd_keep")
    # columns have numbers for names on the way, so that none can clash
    number = {c: f"_own_{i}" for i, c in enumerate(df.columns)}
    own = df.toDF(*number.values())
    text, doc = F.col(number[text_col]), F.col(number[id_col]).cast("long")
    held = own.filter(text.isNotNull()).join(keep, (F.unhex(F.md5(text)) == F.col("_dd_n")) & doc.eqNullSafe(F.col("_dd_r")))
    once = held.filter("_dd_m IS NULL").select(*number.values())
    repeated = held.filter("_dd_m IS NOT NULL").dropDuplicates(["_dd_n"]).select(*number.values())
    return own.filter(text.isNull()).unionByName(once).unionByName(repeated).toDF(*df.columns)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs)[0].select("doc_id", "class_id")
