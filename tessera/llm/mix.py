"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every row has a size (its words) and a 60-bit hash of its id and text.  Words are summed by source and
hash bucket; in the running sum each source has one boundary bucket, in which its budget ends.  Only that
bucket is split further, ten bits at a time, until it holds one row.  What remains is a threshold per
source, and rows are taken by comparing their hash to it: no sort, no row ever moves for the choice.
Targets above a source's size take all of it once (or twice) and the rest by threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small, without

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 10, 6
OUTPUT = ("size", "source_size", "target", "taken", "copies")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of an md5; only rows with the same id and the same text tie."""
    whole = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("~")), F.coalesce(F.md5(text), F.lit("~")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a table of one row a source.

    Targets share ``share`` of all sizes by weight; one that passes ``most`` times its source's size
    stops there and the excess is shared again by weight.  The final level (target per unit of weight)
    is found in one pass over the sources ordered by cap per weight.
    """
    every = Window.partitionBy()
    named = Window.orderBy(F.asc_nulls_last("source"))
    i = (F.row_number().over(named) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), i + 1)
    t = sizes.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by = Window.orderBy("_ratio", F.asc_nulls_last("source"))
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
    left = F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    t = t.withColumn("_level", left / F.sum("_w").over(onward)).withColumn("_i", F.row_number().over(by))
    open_at = F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_i", "_level"))).over(every)["_level"]
    t = t.withColumn("_at", open_at)
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_w")))
    return t.select("source", "source_size", target.alias("target"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of ``df`` with size, source_size, target, taken (words) and copies (0 to ``most``).

    ``keep`` names the columns that the result carries on (default all).  Defined cases: a null text has
    size 0, takes 0 words and counts as taken once where its source is taken once in full; null is a source
    of its own, weighed last; rows with the same id, text and source are told apart by position, so that any
    number of them can be taken; a source whose size is 0 has target 0; an empty table gives an empty
    result; columns named like the outputs are replaced.
    """
    own = {"_id": F.col(f"`{id_col}`"), "_text": F.col(f"`{text_col}`"), "_source": F.col(f"`{source_col}`")}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in OUTPUT]
    # columns that are carried on have numbers for names, so none can clash with the operator's own
    rows = df.select(*[F.col(f"`{c}`").alias(f"_mix_{i}") for i, c in enumerate(kept)], own["_source"].alias("_mix_source"), words(own["_text"]).alias("_mix_size"), row_hash(own["_id"], own["_text"]).alias("_mix_h"))
    # position: the last resort between equal rows; the table is written, so it stays
    rows = materialize(rows.withColumn("_mix_g", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)), "mix_rows")
    sizes = rows.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("_mix_size").alias("source_size"))
    goals = materialize(targets(sizes, weights, share, most), "mix_targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = goals.withColumn("_base", whole).withColumn("_left", F.col("target") - F.col("_base") * F.col("source_size"))
    state = materialize(state.withColumns({"_p": F.lit(0).cast("long"), "_q": F.lit(0).cast("long"), "_size": F.lit(0).cast("long"), "_n": F.lit(0).cast("long")}), "mix_state")
    n = state.count()

    def at(level: int) -> tuple[Column, Column, Column]:
        """Of a row joined to its source's state: its bucket, in the boundary so far, below it."""
        shift = BITS * (LEVELS - 1 - level % LEVELS)
        key = F.shiftright(F.col("_mix_h" if level < LEVELS else "_mix_g"), shift)
        if level < LEVELS:
            return key, key == F.col("_p"), key < F.col("_p")
        tie = F.col("_mix_h") == F.col("_p")
        return key, tie & (key == F.col("_q")), (F.col("_mix_h") < F.col("_p")) | (tie & (key < F.col("_q")))

    level = -1
    while level < 2 * LEVELS - 1:
        level += 1
        key, _, _ = at(level)
        joined = rows.filter("_mix_size > 0").join(small(state, n), F.col("_mix_source").eqNullSafe(F.col("source")))
        if level:
            joined = joined.filter(at(level - 1)[1])
        sums = joined.groupBy("source", key.alias("_key")).agg(F.sum("_mix_size").alias("_size"), F.count(F.lit(1)).alias("_n"), F.first("_left").alias("_left"), F.first("_p").alias("_p"))
        run = F.sum("_size").over(Window.partitionBy("source").orderBy("_key"))
        ends = sums.withColumn("_run", run).filter("_run > _left and _run - _size <= _left")
        p, q = (F.col("_key"), F.lit(0).cast("long")) if level < LEVELS else (F.col("_p"), F.col("_key"))
        found = ends.select(F.col("source").alias("_s"), p.alias("_np"), q.alias("_nq"), (F.col("_left") - (F.col("_run") - F.col("_size"))).alias("_nleft"), F.col("_size").alias("_nsize"), F.col("_n").alias("_nn"))
        state = materialize(
            state.join(small(found, n), F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "_base", F.coalesce("_nleft", "_left").alias("_left"), F.coalesce("_np", "_p").alias("_p"), F.coalesce("_nq", "_q").alias("_q"), F.coalesce("_nsize", "_size").alias("_size"), F.coalesce("_nn", F.lit(0)).alias("_n")
            ),
            "mix_state",
        )
        if not state.filter("_n > 1").limit(1).count():
            break
    _, edge, below = at(level)
    # the row at the edge is taken if that brings the source nearer to its target
    more = below | (edge & (2 * F.col("_left") > F.col("_size")))
    copies = F.col("_base") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    out = rows.join(small(state, n), F.col("_mix_source").eqNullSafe(F.col("source")))
    copies = F.least(copies, F.lit(most)).cast("int")
    return out.select(*[F.col(f"_mix_{i}").alias(c) for i, c in enumerate(kept)], F.col("_mix_size").alias("size"), "source_size", "target", (F.col("_mix_size") * copies).alias("taken"), copies.alias("copies"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it was taken, without the operator's columns."""
    often = mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return without(often, *OUTPUT, "_copy")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(md5(text), '~')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         (source_size * 2)::DOUBLE AS cap FROM s),
l AS (
  SELECT *, cap / w AS ratio,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN a.level IS NULL THEN cap ELSE least(cap, a.level * w) END AS target
  FROM l LEFT JOIN (SELECT level FROM l WHERE level < ratio ORDER BY i LIMIT 1) a ON true),
r AS (
  SELECT n.doc_id, n.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS base,
         sum(n.size) OVER (PARTITION BY n.source ORDER BY n.h) AS run
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * least(2, base + CASE WHEN run <= target - base * source_size
           OR (run - size <= target - base * source_size AND 2 * (target - base * source_size - (run - size)) > size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
