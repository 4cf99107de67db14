"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes`` of plain text; after the last frame comes
the seek table of the public Zstandard seekable format (a skippable frame with one entry for each frame and a nine-byte
footer). The index maps a record identifier to (bundle, frame, offset within the frame's plain text, length), so one
record costs one footer read, one frame read and one frame decompression.

Defined results: a null payload counts as empty; a null identifier gets a record without a page header and reads back as
null; a null URL gives no target header; rows that repeat the smallest identifier of their payload are all responses;
an empty table gives one empty result and no bundle. Columns other than the three named are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, read_table

# Fixed values of the Zstandard seekable format: skippable-frame magic, footer magic.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

#: Payloads shorter than this are never revisits.
MIN_REVISIT_BYTES = 100
#: Tasks of a read at most; further bundles share them.
MAX_READ_TASKS = 20_000
#: WARC-Date of every record: the archives hold no clock time, so that a task run again writes the same bytes.
DATE = "1970-01-01T00:00:00Z"

INDEX = "record_id string, page_id long, bundle string, frame int, frame_offset long, frame_length long, offset_in_frame long, record_length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:sha256:{digest}"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) carries headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a frame's plain text."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, plain[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle; frames: compressed and plain size of each."""
    entries = b"".join(struct.pack("<II", *x) for x in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(data: bytes) -> list[tuple[int, int]]:
    """(compressed, plain) sizes from a bundle's end."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC or flags & 0x80:
        raise ValueError("not a seekable bundle")
    return list(struct.iter_unpack("<II", data[-9 - 8 * n : -9]))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        squeeze = zstandard.ZstdCompressor(level=3)
        part = uuid.uuid4().hex  # a task run again writes other names; only those in the index are ever read
        out = {"n": 0, "file": None, "path": "", "frames": [], "at": 0}
        plain, rows = bytearray(), []

        def close():
            if out["file"]:
                out["file"].write(seek_table(out["frames"]))
                out["file"].close()
                store.move(out["path"] + ".tmp", out["path"])
                out["file"] = None

        def flush():
            nonlocal plain, rows
            if out["file"] is None:
                out.update(path=f"{root}/{part}-{out['n']:05d}.warc.zst", frames=[], at=0)
                out["n"] += 1
                out["file"] = store.open_output_stream(out["path"] + ".tmp")
            packed = squeeze.compress(bytes(plain))
            out["file"].write(packed)
            name = out["path"].rpartition("/")[2]
            done = [(rid, pid, name, len(out["frames"]), out["at"], len(packed), o, n) for rid, pid, o, n in rows]
            out["frames"].append((len(packed), len(plain)))
            out["at"] += len(packed)
            plain, rows = bytearray(), []
            if out["at"] >= bundle_bytes:
                close()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=_INDEX)

        store.create_dir(root, recursive=True)
        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
                payload = (html or "").encode()
                r = build_record(page, url, payload, digest, first)
                rows.append((record_id(page, digest), page, len(plain), len(r)))
                plain += r
                if len(plain) >= frame_bytes:
                    yield flush()
        if rows:
            yield flush()
        close()

    return write


_INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("frame_length", pa.int64()), ("offset_in_frame", pa.int64()), ("record_length", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the least page with an equal payload, null for responses.

    The least page of each digest comes from a partially aggregated groupBy of which only digests with copies are kept;
    the join back is one that AQE can split or broadcast, so a page copied a billion times burdens no single task.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = p.withColumn("digest", F.sha2(payload, 256)).withColumn("big", F.octet_length(payload) >= MIN_REVISIT_BYTES)
    first = p.where("big").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return p.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, frame_bytes: int = 1 << 20, bundle_bytes: int = 32 << 20, **columns: str) -> tuple[str, DataFrame]:
    """Write one record for each row; gives the folder of bundles and the index, itself a table beside the bundles.

    Memory of a task: one frame of plain text and one Arrow batch. A bundle is renamed into place when complete, and
    a task that runs again (a lost executor, speculation) writes bundles of new names, while the index holds those of
    the attempt that was committed, so strays are never read.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    path = f"{folder}/index"
    plan_records(pages, **columns).mapInArrow(_writer(f"{folder}/bundles", frame_bytes, bundle_bytes), INDEX).write.parquet(path)
    return folder, spark.read.schema(INDEX).parquet(path)


def _row(head: dict[str, str], block: bytes) -> tuple:
    number = lambda v: int(v[len("<urn:page:") : -1]) if v and v.startswith("<urn:page:") else None
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        size = len(payload)
    else:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return number(head["WARC-Record-ID"]), size, digest, kind, number(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), payload if kind == "response" else None


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    size = f.size()
                    f.seek(size - 9)
                    n = struct.unpack("<I", f.read(4))[0]
                    f.seek(size - 9 - 8 * n)
                    frames = read_seek_table(f.read(9 + 8 * n))
                    f.seek(0)
                    for packed, plain in frames:
                        rows = [_row(*x) for x in parse_records(expand.decompress(f.read(packed), max_output_size=max(plain, 1)))]
                        if not with_payload:
                            rows = [(*x[:-1], None) for x in rows]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ)], schema=_READ)

    return read


def read_archives(spark: SparkSession, folder: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles that the index names. A task reads one frame at a time, located by the seek table;
    digests of responses are checked against what was read."""
    bundles = index.select("bundle").distinct()
    tasks = max(1, min(bundles.count(), MAX_READ_TASKS))  # a given number, as a few names would be merged into one task
    return bundles.repartition(tasks).mapInArrow(_reader(f"{folder}/bundles", with_payload), READ)


def read_record(folder: str, entry) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record by its index row: reads its frame alone."""
    store, root = _open(f"{folder}/bundles")
    with store.open_input_file(f"{root}/{entry['bundle']}") as f:
        f.seek(entry["frame_offset"])
        plain = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(entry["frame_length"]))
    at = entry["offset_in_frame"]
    return next(parse_records(plain[at : at + entry["record_length"]]))


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all of pages and read the archives back."""
    folder, index = write_archives(read_table(spark, sf_dir, "pages"))
    return read_archives(spark, folder, index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc_bundles": op1_warc_bundles}
SQL = {
    "op1_warc_bundles": """
        with p as (
            select page_id, sha256(coalesce(html, '')) as payload_digest, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes
            from pages),
        f as (select payload_digest, min(page_id) as first_page from p where payload_bytes >= 100 group by payload_digest)
        select p.page_id, p.payload_bytes, p.payload_digest,
            case when f.first_page is null or p.page_id = f.first_page then 'response' else 'revisit' end as record_type,
            case when p.page_id <> f.first_page then f.first_page end as refers_to
        from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100""",
}
