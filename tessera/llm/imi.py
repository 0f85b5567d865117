"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised to one of K centroids, so a vector lies in one of
K x K cells.  A query walks cells in order of summed distance of its halves to the pair of centroids, with a
heap (the multi-sequence algorithm), until the cells it has passed hold enough vectors; those are ranked again
by exact distance.

Centroids are fitted on a bounded sample; every vector is indexed.  Neighbouring cells are packed to blocks of
bounded size (a hot cell fills several), and queries meet blocks in bounded groups, so a hot cell is many tasks'
work.  How many vectors a query passes is measured on the sample: the share of it that must be passed to find its
rows' true neighbours in it.  Data without clusters takes about half, embeddings that cluster little.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

SAMPLE_BYTES, SAMPLE_ROWS = 32 << 20, 20_000  # of the sample that centroids are fitted on
MOST_CENTROIDS = 512  # so the table of cells has 2 ** 18 rows at most
BLOCK, GROUP = 1024, 64  # vectors in a block, queries in a group
PER_CELL = 8  # vectors in a cell on average, while the number of centroids allows it
LEAST, CELLS = 2000, 24  # vectors, and non-empty cells, that a query passes at least
RECALL, TRIALS = 0.95, 200  # recall that the share of the vectors is measured for, on that many rows of the sample
K = 10


def kmeans(x, k: int, rounds: int = 12, seed: int = 7):
    """Centroids of the rows of ``x`` (Lloyd's algorithm; an empty cluster takes the row farthest from its own)."""
    import numpy as np

    unique = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = unique[rng.permutation(len(unique))[:k]].astype(np.float64)
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        own = d.argmin(1)
        count = np.bincount(own, minlength=len(c))
        for j in np.flatnonzero(count):
            c[j] = x[own == j].mean(0)
        for j in np.flatnonzero(count == 0):
            c[j] = x[(d[np.arange(len(x)), own] + (x * x).sum(1)).argmax()]
    return c


def halves(x):
    cut = x.shape[1] // 2
    return x[:, :cut], x[:, cut:]


def nearest(x, c):
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def walk(da, db, count, candidates: int, cells: int) -> list[int]:
    """Cells (a * len(db) + b) in order of da[a] + db[b], empty ones left out, until enough is passed."""
    import numpy as np

    a, b = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    sa, sb, n = da[a].tolist(), db[b].tolist(), len(db)
    a, b = a.tolist(), b.tolist()
    heap, done, out, held = [(sa[0] + sb[0], 0, 0)], {}, [], 0
    while heap and (held < candidates or len(out) < cells):
        _, i, j = heapq.heappop(heap)
        done[i] = j  # of each row, cells are passed from left to right
        cell = a[i] * n + b[j]
        if c := count.get(cell):
            out.append(cell)
            held += c
        if i + 1 < len(a) and done.get(i + 1, -1) == j - 1:
            heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
        if j + 1 < n and (i == 0 or done.get(i - 1, -1) >= j + 1):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
    return out


def needed_share(x, ca, cb, k: int, recall: float = RECALL, trials: int = TRIALS) -> float:
    """The least share of the vectors that queries must pass, in order of their cells, to find ``recall`` of the
    ``k`` nearest; measured on ``x``, whose rows are farther apart than those of the whole, so it is rather too much.
    """
    import numpy as np

    x = np.unique(x, axis=0)
    if len(x) <= 2 * k:
        return 1.0
    a, b = halves(x)
    cell_a, cell_b = nearest(a, ca), nearest(b, cb)
    asked = np.random.default_rng(11).permutation(len(x))[:trials]
    places = []
    for i in asked:
        exact = ((x - x[i]) ** 2).sum(1)
        exact[i] = np.inf
        near = np.argpartition(exact, k)[:k]
        cost = ((a[i] - ca) ** 2).sum(1)[cell_a] + ((b[i] - cb) ** 2).sum(1)[cell_b]
        order = np.sort(cost)
        places.append(np.searchsorted(order, cost[near], side="right") / len(x))
    return float(np.quantile(np.concatenate(places), recall))


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (array of doubles, or of floats if that is what is given) of the vectors that take part."""
    v = F.col(f"`{vec_col}`")
    if df.select(v).dtypes[0][1] != "array<float>":
        v = v.cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    return rows.filter(fine)


def _top(ids, dist, k: int):
    """Indexes of the k smallest (distance, id), each id once with its smallest distance."""
    import numpy as np

    near = np.arange(len(ids))
    if len(ids) > 8 * k:  # what is farther than k different ids are cannot be in it
        close = np.flatnonzero(dist <= np.partition(dist, 4 * k)[4 * k])
        if len(np.unique(ids[close])) >= k:
            near = close
    order = near[np.lexsort((ids[near], dist[near]))]
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


def search(df: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", share: float | None = None, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id ``every`` divides, the k nearest other rows found.

    Score is the Euclidean distance in double precision on the original vectors; ties go to the smaller id.
    ``share`` of all vectors, in order of their cells, is what a query passes at least (default: as measured).
    Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do null ids, nor vectors whose length is not the most common one (the longer of equally common
    ones); an id on several rows is one candidate with its nearest vector, as a query it is its smallest
    vector, and never its own neighbour; with k or fewer candidates all are returned; an empty table gives an
    empty result; extra columns are dropped.
    """
    import numpy as np

    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]["d"], sizes[0]["n"]
    rows = rows.filter(F.size("v") == dim)
    most = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    part = min(1.0, 1.1 * most / n)
    seen = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(part * (1 << 30))).select("v").limit(2 * most).collect()
    x = np.array([r["v"] for r in seen] or [r["v"] for r in rows.limit(1).collect()], dtype=np.float64)
    kind = rows.dtypes[1][1]
    x = x[np.lexsort(x.T[:4][::-1])]
    pairs = max(1, min(MOST_CENTROIDS, round((n / PER_CELL) ** 0.5)))
    ca, cb = (kmeans(h, min(pairs, len(h))) if h.shape[1] else np.zeros((1, 0)) for h in halves(x))
    if share is None:
        share = needed_share(x, ca, cb, k)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dim)
            a, b = halves(v)
            cell = nearest(a, ca) * len(cb) + nearest(b, cb)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), batch.column(1)], names=["vec_id", "cell", "v"])

    index = rows.mapInArrow(assign, f"vec_id long, cell int, v {kind}").withColumn("place", F.monotonically_increasing_id())
    index = materialize(index, "imi_index")
    # one row a cell: at most MOST_CENTROIDS ** 2
    count = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    candidates = max(k + 1, LEAST, int(share * n))
    place, block, held = {}, 0, 0  # of each cell: first block, number of blocks
    for cell in sorted(count):
        if held and held + count[cell] > BLOCK:
            block, held = block + 1, 0
        parts = -(-count[cell] // BLOCK)
        place[cell] = (block, parts)
        block, held = (block + parts, 0) if parts > 1 else (block, held + count[cell])

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dim)
            da, db = ((h * h).sum(1)[:, None] - 2 * h @ c.T + (c * c).sum(1) for h, c in zip(halves(v), (ca, cb), strict=True))
            for i, q in enumerate(batch.column(0).to_pylist()):
                at: dict[int, list[int]] = {}
                for cell in walk(da[i], db[i], count, candidates, cells):
                    first, parts = place[cell]
                    for b in range(first, first + parts):
                        at.setdefault(b, []).append(cell)
                rows = [pa.array([q] * len(at), pa.int64()), pa.array(list(at), pa.int32()), pa.array(list(at.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(rows, names=["query_id", "block", "cells"])

    queries = materialize(index.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")), "imi_queries")
    probes = queries.repartition(F.col("query_id")).mapInArrow(probe, "query_id long, block int, cells array<int>")
    groups = (max(1, queries.count()) + GROUP - 1) // GROUP
    asked = probes.join(queries, "query_id").groupBy("block", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("query_id", "q", "cells")).alias("queries"))
    # a row a cell again
    places = spark.createDataFrame([(c, b, p) for c, (b, p) in place.items()], "cell int, first int, parts int")
    packed = index.join(F.broadcast(places), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("place"), F.col("parts"))).cast("int"))
    blocks = packed.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v", "cell")).alias("vectors"))
    met = materialize(blocks, "imi_blocks").join(materialize(asked, "imi_asked"), "block").select("queries", "vectors")

    def rank(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for qs, vs in zip(batch.column(0), batch.column(1), strict=True):
                qs, vs = qs.values, vs.values
                qid, vid, cell = np.asarray(qs.field(0)), np.asarray(vs.field(0)), np.asarray(vs.field(2))
                q, v = (np.asarray(s.field(1).flatten(), dtype=np.float64).reshape(-1, dim) for s in (qs, vs))
                out = []
                for i, own in enumerate(qid):
                    on = np.flatnonzero(np.isin(cell, qs.field(2)[i].values.to_numpy()) & (vid != own))
                    d = np.sqrt(((v[on] - q[i]) ** 2).sum(1))
                    top = _top(vid[on], d, k)
                    out.append((np.full(len(top), own), vid[on][top], d[top]))
                a, b, c = (np.concatenate(p) for p in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    near = met.mapInArrow(rank, "query_id long, vec_id long, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
