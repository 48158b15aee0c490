"""Operator 4: writing and splittable reading of WARC files."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import filesystem

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range that one task owns, and of one read.
SPLIT, READ = 1 << 20, 1 << 20
SCHEMA = "path string, at long, record_type string, record_id string, url string, warc_date string, content_type string, headers map<string,string>, payload binary"


def record(kind: str, url: str | None, payload: bytes, content_type: str, fields: dict[str, str]) -> bytes:
    """One WARC/1.1 record as a gzip member. Its id is a digest of what it holds, so a repeated task writes the same bytes."""
    same = hashlib.sha256(repr((kind, url, sorted(fields.items()))).encode() + payload).hexdigest()
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(same[:32])}>", "WARC-Date": "1970-01-01T00:00:00Z"}
    head |= {"WARC-Target-URI": url} if url is not None else {}
    head |= fields | {"Content-Type": content_type, "Content-Length": str(len(payload))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    data = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n"
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as .warc.gz files, one a task, a record a page; return the files: (path, bytes).

    The page's key goes into the field WARC-Page-ID, its payload is the page's UTF-8 bytes. A null html is a record with
    the field WARC-Truncated: unspecified and no payload, a null url one without WARC-Target-URI, a null id one without
    WARC-Page-ID; line breaks in a url become %0A or %0D, as a header is one line. File names are unique to a task's attempt; only files that the
    written list names belong to the collection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(uri)
        name, out, size = f"{uri}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = files.open_output_stream(f"{folder}/{name.rpartition('/')[2]}", compression=None)
                fields = {} if key is None else {"WARC-Page-ID": str(key)}
                fields |= {"WARC-Truncated": "unspecified"} if html is None else {}
                url = url and url.replace("\r", "%0D").replace("\n", "%0A")
                data = record("resource", url, (html or "").encode(), "text/html; charset=utf-8", fields)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["path", "bytes"])

    files, folder = filesystem(uri)
    files.create_dir(folder, recursive=True)
    pages.select(pages[id_col], pages[url_col], pages[html_col]).mapInArrow(run, "path string, bytes long").write.parquet(f"{uri}/files")
    return pages.sparkSession.read.parquet(f"{uri}/files")


def listing(spark: SparkSession, uri: str) -> DataFrame:
    """(path, bytes) of every .warc.gz under a folder, for collections that something else wrote."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", True).load(uri)
    return found.select("path", F.col("length").alias("bytes"))


def _parse(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Records of one member: (type, fields, payload)."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, colon, value = line.partition(b":")
            if colon:
                name, value = name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()
                fields[name] = f"{fields[name]}, {value}" if name in fields else value
        size = fields.get("content-length", "")
        if not (size.isascii() and size.isdigit() and len(size) < 19) or end + 4 + int(size) > len(data):
            return
        yield fields.get("warc-type", ""), fields, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        while data.startswith(b"\r\n", at):
            at += 2


def http_body(payload: bytes) -> bytes | None:
    """The body of an HTTP response as the server meant it: chunks joined, gzip or deflate undone. What doesn't decode stays as it is; without the head's end there is no body."""
    head, end, body = payload.partition(b"\r\n\r\n")
    if not end:
        return None
    lines = [line.partition(b":") for line in head.lower().split(b"\r\n")[1:]]
    fields = {name.strip(): value.strip() for name, _, value in lines}
    if b"chunked" in fields.get(b"transfer-encoding", b""):
        parts, at = [], 0
        while (eol := body.find(b"\r\n", at)) >= 0:
            size = body[at:eol].partition(b";")[0].strip()
            if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size) or eol + 2 + int(size, 16) > len(body):
                parts = None  # it was joined before it was stored
                break
            parts.append(body[eol + 2 : eol + 2 + int(size, 16)])
            at = eol + 4 + int(size, 16)
            if not int(size, 16):
                break
        body = body if parts is None else b"".join(parts)
    if fields.get(b"content-encoding") in (b"gzip", b"x-gzip", b"deflate"):
        for bits in (47, -15):
            try:
                return zlib.decompressobj(bits).decompress(body)
            except zlib.error:
                continue
    return body


class _Bytes:
    """A file from one offset on, read in pieces."""

    def __init__(self, file, start: int, size: int):
        self.file, self.base, self.size, self.held = file, start, size, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes at an offset; what lies before it is dropped."""
        if at > self.base:
            self.held, self.base = self.held[at - self.base :], max(at, self.base)
        while len(self.held) < n and (end := self.base + len(self.held)) < self.size:
            self.held += self.file.read_at(min(max(READ, n - len(self.held)), self.size - end), end)
        return self.held[:n]


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members that begin in [start, end) and hold WARC records.

    Magic bytes are only a candidate: the member's first bytes must decode to a record's head, and the whole must decode.
    After a good member the next is expected where it ends; otherwise the search goes on a byte further.
    """
    source, at = _Bytes(file, start, size), start
    while at < end:
        window = source.get(at, READ)
        if not window:
            return
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1) if len(window) > len(MAGIC) else len(window)
            continue
        at += found
        if at >= end:
            return
        decoder = zlib.decompressobj(31)
        try:
            if not decoder.decompress(source.get(at, 4096), 5) == b"WARC/":
                raise zlib.error
            decoder, parts, read = zlib.decompressobj(31), [], 0
            piece = source.get(at, 65536)
            while True:
                parts.append(decoder.decompress(piece))
                read += len(piece)
                if decoder.eof:
                    break
                more = source.get(at, read + max(READ, read))[read:]
                if not more:
                    raise zlib.error
                piece = more
            yield at, b"".join(parts)
            at += read - len(decoder.unused_data)
        except zlib.error:
            at += 1


def read(files: DataFrame, split: int = SPLIT, bodies: bool = False) -> DataFrame:
    """All records of .warc.gz files, a task reading byte ranges: (path, at, record_type, record_id, url, warc_date, content_type, headers, payload).

    ``files`` has (path, bytes). Each file is cut into ranges of ``split`` bytes; a record belongs to the range in which
    its member begins, whether or not it ends there, so each is read once, however files are cut. Members that don't decode, or aren't WARC,
    are passed over and the next good one is found again; a record whose length is wrong ends its member. Header names are
    lower case in ``headers``, the values of a repeated one joined by commas; a missing field is null. With ``bodies`` the payload of an HTTP response is its body, see http_body(). Repeated rows of ``files``
    give repeated records, null paths and empty files none; further columns are ignored. A record is held whole by the task that reads it.
    """
    ranges = files.where("path is not null and bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), *((c, pa.string()) for c in ("record_type", "record_id", "url", "warc_date", "content_type")), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, inner = filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(inner) as file:
                    for at, data in members(file, size, start, min(start + split, size)):
                        for kind, fields, payload in _parse(data):
                            if bodies and kind == "response" and fields.get("content-type", "").lower().startswith("application/http"):
                                payload = http_body(payload) or b""
                            rows.append((path, at, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("content-type"), list(fields.items()), payload))
                            held += len(payload)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return ranges.repartition(tasks, "path", "start").mapInArrow(run, SCHEMA)


def pages(records: DataFrame) -> DataFrame:
    """The pages that records hold: (page_id, url, html), from resource records, as write() makes them, and from response records that read() gave with ``bodies``.

    page_id is null where a record has no WARC-Page-ID, or none that is a number; html is null where the record says that it was truncated, and empty where its payload is.
    Bytes that aren't UTF-8 become replacement characters. Repeated records give repeated rows, an empty table none.
    """
    html = F.when(F.col("headers")["warc-truncated"].isNull(), F.make_valid_utf8(F.col("payload").cast("string")))
    page_id = F.expr("try_cast(headers['warc-page-id'] AS long)")
    return records.where("record_type in ('resource', 'response')").select(page_id.alias("page_id"), "url", html.alias("html"))
