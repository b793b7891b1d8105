"""Zstandard WARC archives: a writer, and a reader that checks what it reads.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then each record is a frame of
its own, compressed with it. The reader loads the dictionary, decodes a frame at a time, and raises `WarcError` unless
every frame holds just one record with a version line, the mandatory headers, a block of Content-Length bytes and the
closing blank lines, and payloads have the digest and length stated.

Cases: null payloads count as empty; of equal payloads of `min_bytes` or more that with the smallest id is the response
and the others revisit it; rows without an id are responses; repeated rows of the response are responses too; a null
url gives a record without a target; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm.shared import even_sample, map_arrow, saved, shared_path

MAGIC = 0x184D2A5D
_FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A response, or a revisit with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = 32_768) -> bytes:
    """A trained dictionary, or raw content if there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def leading_frame(raw: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(raw)) + raw


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive."""
    at, held = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if len(data) < 8 + size:
            raise WarcError("the dictionary's frame is cut short")
        raw = data[8 : 8 + size]
        if raw[:4] == struct.pack("<I", _FRAME):  # a dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        held, at = _loaded(raw), 8 + size
    view = memoryview(data)
    while at < len(data):
        if len(data) - at < 4 or struct.unpack_from("<I", data, at)[0] != _FRAME:
            raise WarcError(f"no frame at byte {at}")
        unpack = zstandard.ZstdDecompressor(dict_data=held).decompressobj() if held else zstandard.ZstdDecompressor().decompressobj()
        out, end = [], at
        try:
            while not unpack.eof and end < len(data):
                out.append(unpack.decompress(view[end : end + 65_536]))
                end = min(end + 65_536, len(data))
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        if not unpack.eof:
            raise WarcError(f"frame at byte {at} is cut short")
        end -= len(unpack.unused_data)
        yield parse(b"".join(out))
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    cut = raw.find(b"\r\n\r\n")
    if cut < 0 or not raw.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise WarcError("a frame holds no WARC record")
    head: dict[str, str] = {}
    for line in raw[:cut].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        head[name.strip().lower()] = value.strip()
    if lost := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in head]:
        raise WarcError(f"no {', '.join(lost)}")
    if not head["content-length"].isdigit():
        raise WarcError("bad Content-Length")
    size = int(head["content-length"])
    if len(raw) != cut + 4 + size + 4 or raw[-4:] != b"\r\n\r\n":
        raise WarcError(f"the block has not the {size} bytes stated, or more follows it")
    return head, raw[cut + 4 : cut + 4 + size]


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, cut, body = block.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"HTTP/"):
        raise WarcError("the block is not an HTTP response")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


def described(head: dict[str, str], block: bytes) -> dict:
    """The row of a record; payload length and digest are checked where the payload is there."""
    http, body = http_parts(block)
    size, stated = int(http.get("content-length", -1)), head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(body) != size or digest(body) != stated):
        raise WarcError(f"{head['warc-record-id']}: payload differs from its length or digest")
    return {"page": head.get("warc-page-id"), "url": head.get("warc-target-uri"), "payload": body if head["warc-type"] == "response" else None, "payload_bytes": size, "payload_digest": stated, "record_type": head["warc-type"], "refers": head.get("warc-refers-to-page")}


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, roll_bytes: int = 32_000_000, sample_rows: int = 200) -> DataFrame:
    """Write archives into `folder`; returns their manifest (path, records, bytes), already made.

    The dictionary is fitted on the first 16 KB of `sample_rows` pages, those of the smallest hashes of the id. Tasks write files of their own names; those of
    failed attempts are not in the manifest.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    # Rows that share an id (or have none) share a hash: the texts of at most sample_rows different hashes are fetched, one each.
    hashed = pages.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    chosen = [r["h"] for r in even_sample(hashed.distinct(), F.col("h"), sample_rows).collect()]
    start = pages.select(F.substring(payload, 1, 16_384).alias("p"), F.xxhash64(F.col(id_col).cast("string")).alias("h")).where(F.col("h").isin(chosen))
    held = dictionary([r["p"].encode() for r in start.groupBy("h").agg(F.min("p").alias("p")).orderBy("h").collect()])
    ids = saved(rows.where(F.octet_length("payload") >= min_bytes).select("digest", "page"), "warc-digests")
    first = ids.groupBy("digest").agg(F.min("page").alias("first"))
    revisits = ids.join(first, "digest").where(F.col("page") > F.col("first")).distinct()
    joined = rows.join(revisits.hint("shuffle_hash"), ["digest", "page"], "left").select("page", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root)
        pack = zstandard.ZstdCompressor(level=3, dict_data=_loaded(held))
        made: list[tuple[str, int, int]] = []
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page, url, text, ref in zip(*(batch.column(c) for c in ("page", "url", "payload", "first")), strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out, n, size = where.open_output_stream(path, compression=None), 0, 0
                    out.write(leading_frame(held) if len(held) >= 8 else b"")
                frame = pack.compress(record(page.as_py(), url.as_py(), text.as_py().encode(), ref.as_py()))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= roll_bytes:
                    out.close()
                    made.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, n, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["path", "records", "bytes"])

    return saved(map_arrow(joined, run, "path string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of all records of the archives listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                with where.open_input_stream(path, compression=None) as f:
                    data = f.read()
                n = 0
                for part in _batches(data):
                    n += len(part)
                    yield part
                if n != expected:
                    raise WarcError(f"{path} has {n} records; {expected} were written")

    # An archive is a task's work; by number, since the manifest's few bytes would be put into one task.
    many = manifest.count()
    few = manifest.repartition(max(1, min(many, 20_000)), F.xxhash64("path"))
    out = map_arrow(few, run, _RECORD)
    return out.select(F.col("page").cast(id_type).alias("page_id"), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"))


def read_files(spark: SparkSession, paths: str | list[str], id_type: str = "long") -> DataFrame:
    """As `read`, of any archives that Spark's readers reach; each up to 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _batches(content.as_py())

    out = map_arrow(spark.read.format("binaryFile").load(paths).select("content"), run, _RECORD)
    return out.select(F.col("page").cast(id_type).alias("page_id"), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"))


_RECORD = "page string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers string"
_ARROW = pa.schema([("page", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string())])


def _batches(data: bytes, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for head, block in records(data):
        rows.append(described(head, block))
        size += len(block)
        if size >= most:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives in the shared folder and read them back, without payloads."""
    folder = shared_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    return read(write(pages, folder, min_bytes=min_bytes), folder, kind).drop("payload", "url")
