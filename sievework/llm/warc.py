"""WARC archives, index first.

Records are written as gzip members of their own, and for each an index row with file, offset, length, URL and digest.
Reading starts from the index: selected rows are sorted by file and offset, neighbouring byte ranges become one read, and
the members inside are parsed and verified. Payloads that occur more than once are written once; later pages revisit.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, skewed_lookup, stash

#: Payloads of fewer bytes are always written in full.
REVISIT_FROM = 100
FILE_BYTES = 256 << 20
#: Ranges closer than GAP are read at once, up to READ bytes; records of one stretch of CHUNK bytes of a file go to one task, and a task has about CHUNK bytes to read.
GAP = 64 << 10
READ = 8 << 20
CHUNK = 4 << 20
DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id long, url string, file string, offset long, length long, digest string"
_CONTROL = re.compile(r"[^\x21-\x7e]")


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None = None) -> bytes:
    """One WARC 1.1 record. A revisit holds the HTTP header only, which states the full payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    target = _CONTROL.sub(lambda m: urllib.parse.quote(m.group()), url) if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers of a record, and its HTTP payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"headers": headers, "http": fields, "payload": payload}


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the rows of ``pages(page_id, size, digest)`` that repeat another page's payload.

    Copies are counted and reduced to their least id before anything is joined; a payload that a third of all pages share
    is joined by broadcast, see ``skewed_lookup``.
    """
    keys = stash(pages.select("page_id", "size", "digest"), "page-keys")
    groups = stash(keys.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null"), "copies")
    total = keys.count()
    found = skewed_lookup(keys.select("page_id", "digest"), groups, "digest", "n", total)
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row; the index, itself written: (page_id, url, file, offset, length, digest).

    A null html is an empty payload and a null url a URN. Of equal payloads of REVISIT_FROM bytes or more the one with the
    least id is the response; rows that repeat this page's id and payload are responses too; a page without an id can
    only revisit. Files get new names on every attempt, so a lost or repeated task leaves no doubt about the index.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    again = revisits(rows)
    known = rows.alias("p").join(again.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest")), "left").select(
        "p.page_id", "p.url", F.when(F.col("r.refers_to").isNull(), F.col("p.payload")).alias("payload"), "p.size", "p.digest", "r.refers_to"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(path)
        system.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        for b in batches:
            index = []
            for page_id, url, payload, size, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(name, compression=None)
                    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n" % (str(uuid.uuid4()).encode(), DATE.encode())
                    data = _gzip(info)
                    out.write(data)
                    offset = len(data)
                data = _gzip(record("response" if refers_to is None else "revisit", page_id, url, payload, digest, size, refers_to))
                out.write(data)
                index.append((page_id, url, name, offset, len(data), digest))
                offset += len(data)
            columns = list(zip(*index)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "file", "offset", "length", "digest"])
        if out is not None:
            out.close()

    index = known.mapInArrow(run, _INDEX)
    target = f"{path}-index"
    index.write.parquet(target)
    return spark.read.schema(_INDEX).parquet(target)


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Neighbouring records of one file as one read: (file, start, end, records)."""
    held: list[tuple[int, int]] = []
    file, start, end = "", 0, 0
    for f, offset, length in rows:
        if held and (f != file or offset - end > GAP or offset + length - start > READ):
            yield file, start, end, held
            held = []
        if not held:
            file, start = f, offset
        held.append((offset, length))
        end = offset + length
    if held:
        yield file, start, end, held


def read(index: DataFrame, location: str) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of the records in ``index``, which may be any selection.

    ``location`` is a URI on the file system that holds the archives. payload is null for revisits. A response whose
    payload doesn't have its digest raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(location)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        opened, name = None, None
        for b in batches:
            for file, start, end, records in _ranges(list(zip(*(c.to_pylist() for c in b.columns)))):
                if file != name:
                    if opened is not None:
                        opened.close()
                    opened, name = system.open_input_file(file), file
                data, out = opened.read_at(end - start, start), []
                for offset, length in records:
                    r = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    h, digest = r["headers"], r["headers"]["WARC-Payload-Digest"].split(":", 1)[1]
                    if h["WARC-Type"] == "response" and hashlib.sha256(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                    page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                    size = len(r["payload"]) if h["WARC-Type"] == "response" else int(r["http"]["Content-Length"])
                    out.append((page and int(page), h["WARC-Target-URI"], h["WARC-Type"], r["payload"] if h["WARC-Type"] == "response" else None, size, digest, refers and int(refers)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)
        if opened is not None:
            opened.close()

    # as many tasks as the selected records' bytes ask for: the index's own size says nothing about them
    tasks = index.agg(F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum("length"), F.lit(0)) / CHUNK))).first()[0]
    chunk = F.floor(F.col("offset") / CHUNK)
    sorted_ranges = index.select("file", "offset", "length").repartition(int(tasks), F.col("file"), chunk).sortWithinPartitions("file", "offset")
    return sorted_ranges.mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


#: The same in DuckDB, from the pages alone: what a reader of the archives must find.
OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN f.first IS NULL OR page_id IS NOT DISTINCT FROM f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first IS NULL OR page_id IS NOT DISTINCT FROM f.first THEN NULL ELSE f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""


def op8_warc(spark, sf_dir: str) -> DataFrame:
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read(index, shared_dir(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
