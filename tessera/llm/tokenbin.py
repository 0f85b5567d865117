"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Rows are dealt to partitions by ranges of id; each task writes one shard of three files: ``.bin`` (all ids,
little-endian), ``.idx`` (n + 1 signed 64-bit offsets in tokens) and ``.doc`` (document ids, and a byte
each that is 1 where the id is not null).  A shard's name holds a random part, and only the shards of tasks
that succeeded are in the manifest, so repeated and speculative attempts do no harm.  The first token and
document of every shard come from prefix sums over the manifest.  Readers map the files into memory.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import lean_batches, local_path, materialize, open_fs, shared_dir

MANIFEST = "shard int, name string, width int, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _writer(folder: str, tokenizer: str, end_id: int, width: int):
    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from .bpe import encoder

        enc, part = encoder(tokenizer, width), TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        lens, ids, known, out = [np.zeros(1, dtype="<i8")], [], [], None
        fs, path = open_fs(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}.bin")
            for tokens, each in enc.encode(pc.fill_null(batch.column(1), ""), end_id):
                for some in tokens:
                    out.write(some.tobytes())
                lens.append(each)
            ids.append(np.asarray(pc.fill_null(batch.column(0), 0), dtype="<i8"))
            known.append(np.asarray(pc.is_valid(batch.column(0)), dtype="u1"))
        if out is None:
            return
        out.close()
        ends = np.cumsum(np.concatenate(lens), dtype="<i8")
        for suffix, arrays in ((".idx", [ends]), (".doc", [*ids, *known])):
            with fs.open_output_stream(f"{path}/{name}{suffix}") as f:
                for data in arrays:
                    f.write(data.tobytes())
        values = [[part], [name], [width], [len(ends) - 1], [int(ends[-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["shard", "name", "width", "n_docs", "n_tokens"])

    return write


def write_tokens(df: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Encode every whole text into ``folder`` (a shared one by default); return the manifest with bases.

    Documents are in ascending id order (null ids first; equal ids by a hash of the text, repeated rows side
    by side).  Null texts are empty: only the end id.  An empty table writes no shard.  ``width`` is the bytes
    of an id: 2 for vocabularies up to 65,536, else 4.  Extra columns are ignored.
    """
    spark = df.sparkSession
    lean_batches(spark)
    folder = folder or f"{shared_dir(spark)}/tokens"
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # rows that repeat are told apart by their place, so that any number of them can be dealt
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.col("_place")]
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    sorted_rows = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_place")
    made = materialize(sorted_rows.mapInArrow(_writer(folder, tokenizer, end_id, width), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = {f"first_{k}": F.coalesce(F.sum(f"n_{k}").over(before), F.lit(0)).cast("long") for k in ("docs", "tokens")}
    return materialize(made.withColumns(based).withColumn("folder", F.lit(folder)), "manifest")


def _map(folder: str, name: str):
    """Arrays of a shard: memory-mapped where the store is a file system, else read."""
    import numpy as np

    where = local_path(folder)
    if where is not None:
        get = lambda suffix: np.memmap(f"{where}/{name}{suffix}", dtype="u1", mode="r")
    else:
        fs, path = open_fs(folder)
        get = lambda suffix: np.frombuffer(fs.open_input_stream(f"{path}/{name}{suffix}").read(), dtype="u1")
    return get


def shard_arrays(folder: str, name: str, width: int, n_docs: int):
    """(tokens, offsets, ids, known) of a shard."""
    get = _map(folder, name)
    doc = get(".doc")
    return get(".bin").view(f"<u{width}"), get(".idx").view("<i8"), doc[: 8 * n_docs].view("<i8"), doc[8 * n_docs :].view("u1")


def _reader(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            tokens, ends, ids, known = shard_arrays(row["folder"], row["name"], row["width"], row["n_docs"])
            for at in range(0, row["n_docs"], 4096):
                stop = min(at + 4096, row["n_docs"])
                e = ends[at : stop + 1].tolist()
                crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(e, e[1:], strict=False)]
                docs = [i if k else None for i, k in zip(ids[at:stop].tolist(), known[at:stop].tolist(), strict=True)]
                columns = [docs, [row["first_tokens"] + a for a in e[:-1]], [b - a for a, b in zip(e, e[1:], strict=False)], crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that the manifest names."""
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(_reader, READ)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_tokens(write_tokens(docs, default_tokenizer()))
