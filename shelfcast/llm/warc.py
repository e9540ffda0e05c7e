"""WARC archives with a two-level capture index.

Tasks write pages as WARC records, each its own gzip member, to archive files in
the shared folder. A payload seen before is written as a revisit of the record with the
smallest id. The index has two levels: lines of captures, sorted by the URL's key
with the host's labels reversed, in compressed blocks; and a sparse directory that
holds each block's first key and place. Index files cover ranges of keys, each with its
own directory beside it; a list of the files, one row for ``INDEX_ROWS`` captures, says which file to ask.
A lookup finds the file and then the block by bisection, reads one block (more, if a key
fills several), and reads the record's range. Pages are read back by looking up their URLs this way.

File names hold a random part, and only files that a finished task reports are
in the index; a task that runs again leaves nothing behind that a reader sees.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, spread, utf8, written

ARCHIVE_BYTES = 256 << 20  # an archive file is closed beyond this size
BLOCK_LINES = 1000
#: A record's date; the pages carry none, so archives of equal pages are equal.
DATE = "2000-01-01T00:00:00Z"
GZIP_LEVEL = 4
INDEX_ROWS = 500_000  # captures of one index file
DIRECTORY = ".directory.z"  # ending of the file that holds an index file's directory
FENCE = 64  # characters of a file's first and last key that the list of files keeps
READ_BYTES = 64 << 20  # archive bytes that a task reads back
STRETCH = 4 << 20  # neighbouring records are read by one task in runs of this size

_CAPTURE = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("archive", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("kind", T.StringType()),
])
_FILE = T.StructType([
    T.StructField("index", T.StringType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
    T.StructField("blocks", T.LongType()), T.StructField("captures", T.LongType()), T.StructField("bytes", T.LongType()),
])
_ASKED = T.StructType([T.StructField("index", T.StringType()), T.StructField("key", T.StringType())])
_RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
])


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that pyarrow knows (file, hdfs, s3, gs) and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def url_key(url: str) -> str:
    """com,example,www)/path?query: the host's labels reversed, lower case; scheme and port are left out."""
    host, rest = re.match(r"(?s)(?:.*?://)?([^/?#]*)(.*)", url).groups()
    host = host.rpartition("@")[2].lower().partition(":")[0]
    return ",".join(reversed(host.split("."))) + ")" + rest.partition("#")[0]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(kind: str, fields: Sequence[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {_header(v)}" for k, v in fields), f"Content-Length: {len(block)}"]
    whole = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    press = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return press.compress(whole) + press.flush()


def capture_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit whose block has the HTTP header alone."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    fields = [("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url),
              ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", fields, http + payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _record("revisit", [*fields, ("WARC-Profile", profile), ("WARC-Refers-To", name(refers_to))], http)


def read_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one gzip member."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    warc = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:]), payload


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema, strict=True)], names=schema.names)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload, of at least ``least`` bytes, a smaller page_id has too."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = written(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")).where(F.col("bytes") >= least), "digests")
    first = seen.groupBy("digest", "bytes").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return written(seen.join(first, ["digest", "bytes"]).where("page_id > refers_to").select("page_id", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for each page; returns the written table of captures (key, page_id, archive, offset, length, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            for (page_id, url, refers_to), payload in zip(zip(*columns, strict=True), utf8(batch.column("html")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    info = _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                                                ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC/1.1\r\n")
                    out.write(info)
                    at = len(info)
                record = capture_record(page_id, url or "", payload, refers_to)
                out.write(record)
                rows.append((url_key(_header(url or "")), page_id, name, at, len(record), "response" if refers_to is None else "revisit"))
                at += len(record)
                if at > ARCHIVE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield _batch(rows, _CAPTURE)
        if out is not None:
            out.close()

    again = revisits(pages, least).select(F.col("page_id").alias("_page"), "refers_to")
    rows = pages.select("page_id", "url", "html").join(again, F.col("page_id") == F.col("_page"), "left").drop("_page")
    return written(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, _CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted lines in compressed blocks, each file with its directory; returns the written list of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, f"{uuid.uuid4().hex}.cdx.z", 0
        lines: list[tuple] = []
        directory: list[str] = []
        first, last, captures, stored = None, "", 0, 0

        def close_block() -> None:
            nonlocal at
            if lines:
                data = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode())
                out.write(data)
                directory.append(f"{lines[0][0]}\t{at}\t{len(data)}")
                at += len(data)
                lines.clear()

        for batch in batches:
            out = out or store.open_output_stream(posixpath.join(root, name), compression=None)
            for line in zip(*(batch.column(c).to_pylist() for c in _CAPTURE.names), strict=True):
                first, last = line[0] if first is None else first, line[0]
                captures, stored = captures + 1, stored + line[4]
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    close_block()
        close_block()
        if out is not None:
            out.close()
        if captures:
            with store.open_output_stream(posixpath.join(root, name + DIRECTORY), compression=None) as f:
                f.write(zlib.compress("\n".join(directory).encode()))
            yield _batch([(name, first[:FENCE], last[:FENCE], len(directory), captures, stored)], _FILE)

    parts = spread(captures, INDEX_ROWS)
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return written(ordered.mapInArrow(run, _FILE), "index-files")


class IndexFile:
    """One file of the index: its directory, searched by bisection, and its blocks, read by range.

    The block read last is kept, so keys asked in their order read each block once.
    """

    def __init__(self, store: pafs.FileSystem, root: str, name: str):
        path = posixpath.join(root, name)
        with store.open_input_stream(path + DIRECTORY, compression=None) as f:
            entries = [line.split("\t") for line in zlib.decompress(f.read()).decode().split("\n")]
        self.keys = [key for key, _, _ in entries]
        self.places = [(int(offset), int(length)) for _, offset, length in entries]
        self.file = store.open_input_file(path)
        self.held, self.lines = -1, []

    def block(self, k: int) -> list[tuple]:
        if k != self.held:
            offset, length = self.places[k]
            self.held, self.lines = k, list(_lines(self.file.read_at(length, offset)))
        return self.lines

    def captures(self, key: str) -> Iterator[tuple]:
        """The lines of a key, in the order of the index."""
        # The block before the first one that begins at or behind the key can end with it.
        for k in range(max(0, bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[k] > key:
                return
            lines = self.block(k)
            for n in range(bisect_left(lines, key, key=itemgetter(0)), len(lines)):
                if lines[n][0] != key:
                    return
                yield lines[n]


class FileList:
    """The index files in key order. It keeps ``FENCE`` characters of each file's first and last key."""

    def __init__(self, files: DataFrame):
        self.files = sorted((r["first"], r["last"], r["index"]) for r in files.select("first", "last", "index").collect())
        self.last = [last for _, last, _ in self.files]

    def holding(self, key: str) -> Iterator[str]:
        """Names of the files that can hold a key: one, more if the key fills several or they begin alike."""
        fence = key[:FENCE]
        for k in range(bisect_left(self.last, fence), len(self.files)):
            first, _, name = self.files[k]
            if first > fence:
                return
            yield name


def _lines(data: bytes) -> Iterator[tuple]:
    for line in zlib.decompress(data).decode().split("\n"):
        key, page_id, archive, offset, length, kind = line.split("\t")
        yield key, None if page_id == "None" else int(page_id), archive, int(offset), int(length), kind


def _range(store: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)


class CaptureIndex:
    """Lookups of single URLs."""

    def __init__(self, files: DataFrame, folder: str):
        self.files = FileList(files)
        self.store, self.root = open_store(folder)

    def lookup(self, url: str) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
        """All captures of a URL: (WARC header, HTTP header, payload), in the order of the index."""
        key = url_key(_header(url))
        lines = [x for name in self.files.holding(key) for x in IndexFile(self.store, self.root, name).captures(key)]
        return [read_record(_range(self.store, posixpath.join(self.root, x[2]), x[3], x[4])) for x in lines]


def look_up(urls: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """The captures of every different key in the column ``url``, found in the index.

    Keys are sent to the files that can hold them and asked there in their order. A key that
    fills several files is asked of each by itself, so its captures come from several tasks.
    """
    ranges = FileList(files)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {url_key(_header(u or "")) for u in set(batch.column("url").to_pylist())}
            rows = [(name, key) for key in keys for name in ranges.holding(key)]
            if rows:
                yield _batch(rows, _ASKED)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name, index, rows = None, None, []
        for batch in batches:
            for file, key in zip(*(batch.column(c).to_pylist() for c in _ASKED.names), strict=True):
                if file != name:
                    name, index = file, IndexFile(store, root, file)
                for line in index.captures(key):
                    rows.append(line)
                    if len(rows) == BLOCK_LINES:
                        yield _batch(rows, _CAPTURE)
                        rows = []
        if rows:
            yield _batch(rows, _CAPTURE)

    keys = urls.select("url").mapInArrow(asked, _ASKED).distinct()
    parts = spread(files, 1)
    return keys.repartitionByRange(parts, "index", "key").sortWithinPartitions("index", "key").mapInArrow(found, _CAPTURE)


def read_back(pages: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """The records of every page's URL, parsed: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The URLs are looked up in the index; the places found are dealt out by stretches of
    the archives and read in the order of their offsets. A response's payload is hashed anew and
    must match its header.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name, archive = None, None
        number = lambda urn: int(n) if (n := urn[len("<urn:page:"):-1]) else None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if path != name:
                    name, archive = path, store.open_input_file(posixpath.join(root, path))
                warc, http, payload = read_record(archive.read_at(length, offset))
                known = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = warc["WARC-Type"]
                if kind == "response" and known != digest(payload):
                    raise ValueError(f"the payload at {offset} of {path} does not match its digest")
                refers = warc.get("WARC-Refers-To")
                rows.append((number(warc["WARC-Record-ID"]), int(http["Content-Length"]), known, kind, number(refers) if refers else None))
            if rows:
                yield _batch(rows, _RECORD)

    places = look_up(pages, files, folder).select("archive", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    stored = files.agg(F.sum("bytes")).first()[0] or 0
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored // READ_BYTES))
    return places.repartition(parts, "archive", "stretch").sortWithinPartitions("archive", "offset").mapInArrow(records, _RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives with an index below ``folder`` and return the records read back, one per page.

    Null html is an empty payload, a null url an empty one. Of equal payloads (of at
    least ``least`` bytes) the smallest page_id is the response; rows that repeat this id, and rows with a null page_id, are responses
    too. Columns other than page_id, url and html take no part. An empty table
    gives no archive and no rows.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    files = write_index(write_archives(pages, folder, least), folder)
    return read_back(pages, files, folder)


def query(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM f
"""
