"""WARC 1.1 archives in Zstandard: a dictionary in the leading skippable frame, one frame a record.

A shard is ``<skippable frame: dictionary><frame: record><frame: record>...``.  The dictionary is trained on
the shard's first payloads (a bounded sample) and may be absent; readers load it from the leading frame, decode
frame by frame, and check each record's version, headers, lengths and digests.

Of records with equal payloads one is a ``response``, which carries the payload; the others are ``revisit``
records (profile identical-payload-digest), which carry the HTTP head only and refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, open_fs, shared_dir

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables have no date
SAMPLE_BYTES, DICT_BYTES = 1 << 20, 1 << 15
MANIFEST = "name string, n_records long, n_bytes long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_id string, date string"


class BadRecord(ValueError):
    """A record that does not hold what its headers say."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{row}>"


def make_record(page_id: int | None, row: int, url: str | None, payload: bytes, refers: tuple[int | None, int] | None, date: str = DATE) -> bytes:
    """A whole record: version, headers, block, and the two line ends after it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    headers = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, row)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~")))
    if refers:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


KINDS = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")


def _fields(head: bytes, where: str, repeat: tuple[str, ...] = ()) -> tuple[str, dict[str, str]]:
    """(first line, fields by name in lower case); folded lines are joined."""
    try:
        first, *lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise BadRecord(f"{where} is no UTF-8") from e
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or (name.lower() in fields and name.lower() not in repeat):
            raise BadRecord(f"bad line in {where}: {line[:80]!r}")
        name = name.lower()
        fields[name] = value.strip() if name not in fields else f"{fields[name]} {value.strip()}"
    return first, fields


def _http(block: bytes) -> tuple[bytes, int | None]:
    """(payload, its length as the HTTP head says it: None if it does not)."""
    head, cut, payload = block.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"HTTP/"):
        raise BadRecord("no HTTP head")
    said, chunked = None, False
    for line in head.decode("latin-1").split("\r\n")[1:]:  # servers send what they like
        name, _, value = line.partition(":")
        if name.strip().lower() == "content-length" and value.strip().isascii() and value.strip().isdigit():
            said = int(value)
        chunked = chunked or name.strip().lower() == "transfer-encoding"
    return payload, None if chunked else said


def _number(uri: str | None) -> int | None:
    """The page's id in one of this module's record ids; None in others."""
    kind, _, rest = (uri or "").removeprefix("<urn:").removesuffix(">").partition(":")
    page = rest.partition(":")[0]
    return int(page) if kind == "x-page" and page.removeprefix("-").isascii() and page.removeprefix("-").isdigit() else None


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record of any type, after all checks; BadRecord says what is wrong.

    Version, headers, lengths, and digests by SHA-1 where they are given are checked.  The payload of a response
    is what follows the HTTP head, a revisit has none, and that of other records is their block.
    """
    from urllib.parse import unquote

    head, cut, rest = data.partition(b"\r\n\r\n")
    first, headers = _fields(head, "the header", ("warc-concurrent-to",))
    if not cut or first not in ("WARC/1.0", "WARC/1.1"):
        raise BadRecord(f"not a WARC record: {first[:40]!r}")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise BadRecord(f"no {need} header")
    said = headers["content-length"]
    if not (said.isascii() and said.isdigit()) or int(said) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length {said[:20]} but {len(rest) - 4} bytes")
    block, kind = rest[:-4], headers["warc-type"].lower()
    if kind not in KINDS:
        raise BadRecord(f"no record type {kind[:40]!r}")

    def check(name: str, content: bytes) -> None:
        scheme, _, value = headers.get(name, "").partition(":")
        if scheme.lower() == "sha1" and value.upper() != digest(content):
            raise BadRecord(f"{name} differs")

    check("warc-block-digest", block)
    is_http = headers.get("content-type", "").partition(";")[0].strip().lower() == "application/http"
    payload: bytes | None = block
    length: int | None = len(block)
    if kind == "revisit":
        if "warc-profile" not in headers:
            raise BadRecord("a revisit without a profile")
        length = None
        if block:
            extra, length = _http(block)
            if extra and headers["warc-profile"] == PROFILE:
                raise BadRecord("a revisit with a payload")
        payload = None
    elif kind == "response" and is_http:
        payload, length = _http(block)
        if length is not None and length != len(payload) and "warc-truncated" not in headers:
            raise BadRecord(f"the HTTP head says {length} bytes, the payload has {len(payload)}")
        length = len(payload)
        check("warc-payload-digest", payload)
    known = headers.get("warc-payload-digest", "").partition(":")
    value = known[2] if known[0].lower() == "sha1" else digest(payload) if payload is not None else None
    uri, refers = headers.get("warc-target-uri"), headers.get("warc-refers-to")
    return {
        "page_id": _number(headers["warc-record-id"]), "url": None if uri is None else unquote(uri.strip("<>")), "payload_bytes": length, "payload_digest": value,
        "record_type": kind, "refers_to": _number(refers), "payload": payload, "record_id": headers["warc-record-id"], "refers_to_id": refers, "date": headers["warc-date"],
    }


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing where the samples are too few or too plain for one."""
    import zstandard

    if len(samples) < 8 or sum(map(len, samples)) < 4 * DICT_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ShardWriter:
    """Writes the leading frame and then a frame for each record; the first records wait for the dictionary."""

    def __init__(self, out, level: int = 3):
        self.out, self.level, self.waiting, self.held, self.pack = out, level, [], 0, None
        self.records = self.bytes = 0

    def add(self, record: bytes) -> None:
        if self.pack:
            self._put(self.pack.compress(record))
        else:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= SAMPLE_BYTES:
                self._start()
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        import zstandard

        words = train(self.waiting)
        if words:
            self._put(struct.pack("<II", SKIPPABLE, len(words)) + words)
        self.pack = zstandard.ZstdCompressor(level=self.level, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}))
        for r in self.waiting:
            self._put(self.pack.compress(r))
        self.waiting = []

    def close(self) -> None:
        if not self.pack:
            self._start()
        self.out.close()


def read_shard(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decoded frames of a shard, one at a time; memory holds a chunk and a record."""
    import zstandard

    data = stream.read(8)
    options = {}
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:])[0]
        words = stream.read(size)
        if len(words) != size:
            raise BadRecord("the dictionary's frame is cut off")
        if words[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may be compressed itself
            words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
        options, data = {"dict_data": zstandard.ZstdCompressionDict(words)}, b""
    unpack = zstandard.ZstdDecompressor(**options)
    one, parts = unpack.decompressobj(), []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        parts.append(one.decompress(data))
        data = b""
        if one.eof:
            yield b"".join(parts)
            data = one.unused_data
            one, parts = unpack.decompressobj(), []
    if parts:  # a frame was begun
        raise BadRecord("the last frame is cut off")


def _writer(folder: str):
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fs, path = open_fs(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        shard = None
        for batch in batches:
            if shard is None and batch.num_rows:
                fs.create_dir(path, recursive=True)
                shard = ShardWriter(fs.open_output_stream(f"{path}/{name}"))
            for i in range(batch.num_rows):
                page, row, url, html, first, first_row = (c[i].as_py() for c in batch.columns)
                refers = None if first_row == row else (first, first_row)
                shard.add(make_record(page, row, url, (html or "").encode(), refers))
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [shard.records], "n_bytes": [shard.bytes]})

    return write


def write_warc(df: DataFrame, folder: str | None = None, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of ``df``; return the manifest (folder, name, n_records, n_bytes).

    Of rows with equal payloads that with the largest id (null is smallest; then the largest url, then place)
    is the response.  Null html is an empty payload, equal to other empty ones; a null url has no header; rows
    that repeat are records of their own; an empty table writes no shard; extra columns are ignored.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc"
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{page_col}`").cast("long").alias("page"), F.monotonically_increasing_id().alias("row"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha"))
    rows = materialize(rows, "warc_rows")  # so that the place of a row stays what it is
    best = F.max(F.struct(F.coalesce(F.col("page"), F.lit(-(1 << 63))).alias("p"), F.coalesce(F.col("url"), F.lit("")).alias("u"), F.col("row").alias("r"), F.col("page").alias("page")))
    # only payloads that occur again are joined, so most of the html never moves
    again = rows.groupBy("sha").agg(best.alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = materialize(again.select(F.col("sha").alias("_sha"), F.col("b.page").alias("first"), F.col("b.r").alias("first_row")), "warc_again")
    out = rows.join(again, F.col("sha") == F.col("_sha"), "left")
    out = out.select("page", "row", "url", "html", "first", F.coalesce("first_row", "row").alias("first_row"))
    return materialize(out.mapInArrow(_writer(folder), MANIFEST).withColumn("folder", F.lit(folder)), "warc_manifest")


def _reader(batches: Iterator) -> Iterator:
    import pyarrow as pa

    fields = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "record_id": pa.string(), "refers_to_id": pa.string(), "date": pa.string()}

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields.items()], names=list(fields))

    for batch in batches:
        for shard in batch.to_pylist():
            fs, path = open_fs(shard["folder"])
            n, rows, held = 0, [], 0
            with fs.open_input_stream(f"{path}/{shard['name']}") as f:
                for data in read_shard(f):
                    rows.append(parse_record(data))
                    n, held = n + 1, held + len(data)
                    if held > 1 << 23 or len(rows) == 1000:
                        yield batch_of(rows)
                        rows, held = [], 0
            if shard["n_records"] is not None and n != shard["n_records"]:
                raise BadRecord(f"{shard['name']} holds {n} records, the manifest says {shard['n_records']}")
            if rows:
                yield batch_of(rows)


def read_warc(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits), record_id,
    refers_to_id and date of every record of the shards that ``manifest`` (folder, name, n_records) names.

    Records of any type are read; page_id and refers_to are null where ids are not this module's.
    """
    return manifest.repartition(max(1, manifest.count())).mapInArrow(_reader, READ)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_warc(write_warc(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex,
             max(page_id) OVER (PARTITION BY payload) AS last FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + (('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT & 31)::INT, 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
