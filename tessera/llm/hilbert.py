"""Sharding along a Hilbert curve over quantised metadata (DataFrame functions only).

Metadata columns are quantised to five bits each by the rank of their value among the distinct values; a
number's value is its binary magnitude.  The Hilbert index of the cell orders the rows, and
the order is cut into runs, so that each shard covers a small box of the metadata and a reader's min/max
statistics prune files in every dimension.

The global rank needs no total sort: rows are counted by (cell, salt), running sums over that small table
give each group's first rank, and rows are numbered inside their group only.  A hot cell gets as many
salts as its count asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import by_ranges
from .shared import BROADCAST_ROWS, materialize, small

BITS = 5
GROUP_ROWS = 4096  # rows aimed at in a (cell, salt) group


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Index along the Hilbert curve of integer coordinates of ``bits`` bits each.

    Skilling's transform: from the highest bit down, axes whose bit is set flip the low bits of the first
    axis, others swap them with it; a Gray code follows, and the bits of all axes are interleaved.
    """
    n = len(coords)
    steps = F.array(*[F.struct(F.lit((1 << b) - 1).alias("low"), F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        first, own = F.get(x, F.lit(0)), F.get(x, s["i"])
        swap = first.bitwiseXOR(own).bitwiseAND(s["low"])
        hit = own.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, j: F.when(hit, F.when(j == 0, v.bitwiseXOR(s["low"])).otherwise(v)).otherwise(F.when((j == 0) != (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v)))

    x = F.aggregate(steps, F.array(*[c.cast("int") for c in coords]), turn)
    gray = F.transform(x, lambda v, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, e: a.bitwiseXOR(e)))
    last = F.get(gray, F.lit(n - 1))
    flips = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    out = F.transform(gray, lambda v: v.bitwiseXOR(flips))
    places = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(b).alias("b")) for b in range(bits - 1, -1, -1) for j in range(n)])
    bit = lambda p: F.call_function("shiftright", F.get(out, p["j"]), p["b"]).bitwiseAND(F.lit(1))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda a, p: a * 2 + bit(p))


def _ranked(values: DataFrame, name: str) -> DataFrame:
    """Distinct values with their rank from 0 and their number: ``_v``, ``_r``, ``_k``; many are ranked by ranges."""
    n = values.count()
    if n <= BROADCAST_ROWS:
        rank = F.row_number().over(Window.orderBy(F.asc_nulls_first(name))) - 1
        return values.select(F.col(name).alias("_v"), rank.cast("long").alias("_r"), F.lit(n).cast("long").alias("_k"))
    dealt = by_ranges(values, F.asc_nulls_first(name), label="shard_ranges")
    sums = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_in"))  # a row a range
    sums = sums.select(F.col("_p").alias("_q"), (F.sum("_in").over(Window.orderBy("_p")) - F.col("_in")).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(F.asc_nulls_first(name))) - 1
    numbered = dealt.withColumn("_i", own).join(F.broadcast(sums), F.col("_p") == F.col("_q"))
    return numbered.select(F.col(name).alias("_v"), (F.col("_base") + F.col("_i")).cast("long").alias("_r"), F.lit(n).cast("long").alias("_k"))


def shard(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"), bits: int = BITS, key: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, curve, shard, slot, grown_shard: one row for each row of ``df``.

    The law is ``rows``: shards' counts differ by one at most.  Dimensions are the text columns ``dims`` and
    the magnitude of the size.  Rows of one cell are ordered by salt, the text's checksum, and id.  Defined cases: a null text counts no bytes and has a null checksum; null is the
    first value of a dimension; repeated rows each get their own slot; with fewer rows than shards some stay
    empty; an empty table gives an empty result; extra columns are dropped,
    but for ``key``, if one is named.
    """
    keys = [key] if key else []
    text = F.col(f"`{text_col}`")
    names = [f"_d{i}" for i in range(len(dims))]
    rows = df.select(*keys, F.col(f"`{id_col}`").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), *[F.col(f"`{d}`").cast("string").alias(n) for d, n in zip(dims, names, strict=True)])
    rows = materialize(rows.withColumn("_place", F.monotonically_increasing_id()), "shard_rows")
    cells = 1 << bits
    # each dimension's values are spread over its whole axis, so that the curve turns in all of them alike
    rows = rows.withColumn("_m", F.length(F.bin("size")))
    coded, packed = rows, F.lit(0).cast("bigint")
    for i, name in enumerate(["_m", *names]):
        ranks = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_c"))
        ranks = _ranked(materialize(ranks, "shard_values"), name)
        ranks = materialize(ranks.select("_v", F.floor(F.col("_r") * cells / F.col("_k")).cast("int").alias(f"{name}_q")), "shard_ranks")
        coded = coded.join(small(ranks, ranks.count()), F.col(name).eqNullSafe(F.col("_v"))).drop("_v")
        packed = packed + F.col(f"{name}_q").cast("bigint") * (1 << bits * i)
    coded = coded.select(*keys, "doc_id", "size", "text_crc32", "_place", packed.alias("_cell"))
    # the curve is computed for cells, of which there are few, not for rows
    axis = lambda i: F.call_function("shiftright", F.col("_cell"), F.lit(bits * i)).bitwiseAND(F.lit(cells - 1))
    counts = materialize(coded.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")), "shard_counts")
    counts = counts.select("_cell", F.ceil(F.col("_n") / GROUP_ROWS).cast("long").alias("_salts"), hilbert_index([*[axis(i + 1) for i in range(len(dims))], axis(0)], bits).alias("curve"))
    counts = materialize(counts, "shard_cells")
    order = F.struct(F.coalesce("text_crc32", F.lit(-1)).alias("c"), F.col("doc_id").alias("d"), F.col("_place").alias("p"))
    salt = F.pmod(F.xxhash64("text_crc32", "doc_id"), F.col("_salts"))
    salted = coded.join(small(counts, counts.count()), "_cell").withColumn("_salt", salt)
    groups = salted.groupBy("curve", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # rows that repeat have one salt; where they are many they are split by their places
    heavy = materialize(groups.filter(F.col("_n") > 4 * GROUP_ROWS).select(F.col("curve").alias("_hc"), F.col("_salt").alias("_hs"), F.ceil(F.col("_n") / GROUP_ROWS).cast("long").alias("_more")), "shard_heavy")
    if many := heavy.count():
        part = F.when(F.col("_more").isNotNull(), F.pmod(F.xxhash64("_place"), F.col("_more")) + 1).otherwise(0)
        salted = salted.join(small(heavy, many), (F.col("curve") == F.col("_hc")) & (F.col("_salt") == F.col("_hs")), "left")
        salted = salted.withColumn("_salt", F.col("_salt") * (1 << 32) + part).drop("_hc", "_hs", "_more")
        groups = salted.groupBy("curve", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    high = F.shiftright("curve", 5)
    groups = materialize(groups.withColumn("_high", high), "shard_groups")
    # two levels of running sums: no single task sees all groups
    tops = groups.groupBy("_high").agg(F.sum("_n").alias("_t"))
    tops = tops.select(F.col("_high").alias("_top"), (F.sum("_t").over(Window.orderBy("_high")) - F.col("_t")).alias("_before"), F.sum("_t").over(Window.partitionBy()).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy("_high").orderBy("curve", "_salt")) - F.col("_n")
    base = groups.withColumn("_in", inside).join(F.broadcast(tops), F.col("_high") == F.col("_top"))  # at most 2 ** (15 - 5) rows
    base = materialize(base.select(F.col("curve").alias("_gc"), F.col("_salt").alias("_gs"), (F.col("_before") + F.col("_in")).alias("_base"), "_all"), "shard_bases")
    ranked = salted.withColumn("_in", F.row_number().over(Window.partitionBy("curve", "_salt").orderBy(order)) - 1)
    ranked = ranked.join(small(base, base.count()), (F.col("curve") == F.col("_gc")) & (F.col("_salt") == F.col("_gs")))
    out = ranked.withColumn("_rank", F.col("_base") + F.col("_in")).withColumn("_shard", F.expr(f"((_rank + 1) * {n_shards} - 1) div _all"))
    slot = F.col("_rank") - F.expr(f"(_shard * _all) div {n_shards}")
    return out.select(*keys, "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "curve", F.col("_shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"), **options) -> None:
    """Write ``df`` by shard, rows along the curve, so that file statistics are narrow in every dimension.

    Files have the columns of ``df`` and, in place of any of those names, ``shard`` and ``slot``.
    """
    # rows and columns are numbered: ids may be null or shared, and names may clash
    number = {c: f"_own_{i}" for i, c in enumerate(df.columns)}
    rows = materialize(df.toDF(*number.values()).withColumn("_row", F.monotonically_increasing_id()), "shard_input")
    plan = shard(rows, id_col=number[id_col], text_col=number[text_col], dims=tuple(number[d] for d in dims), key="_row", **options)
    plan = plan.select(F.col("_row").alias("_planned"), "shard", "slot")
    out = rows.join(plan, F.col("_row") == F.col("_planned"))
    out = out.select(*[F.col(n).alias(c) for c, n in number.items() if c.lower() not in ("shard", "slot")], "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_shard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return shard(docs).drop("curve")
