"""WARC archives and a two-level capture index.

Pages become response records, or revisit records where another page has the
same payload, in files of gzip members in the shared folder.  The index sorts
reversed-host URL keys into compressed blocks; a sparse directory keeps first
and last key of every block.  A lookup bisects the directory, then the blocks
it leads to, and reads the records' byte ranges; reading back goes through the
index blocks too.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize, scratch_path, sifted, small_batches

BLOCK_LINES = 1000
#: Bytes of archive that a reading task gets, and the least for a task of its own where there are cores to spare.
TASK_BYTES, LEAST_TASK_BYTES = 128 << 20, 1 << 20
_ID, _NO_ID = "urn:page:", "urn:page-without-id:"
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; without scheme, user, port, leading www and fragment."""
    rest = _SCHEME.sub("", (url or "").strip()).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, query = host.partition("?")
        slash, path = "/", "?" + query
    host = host.rpartition("@")[2].lower()
    host = re.sub(r":\d*$", "", host)
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (slash or "/") + path


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value holds no control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the length of the full payload, and no payload.

    A page without an id gets a record id of its own kind, made of its URL and digest.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_record_id(page_id, url, digest)}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"{_ID}{page_id}" if page_id is not None else _NO_ID + hashlib.sha1(f"{url}|{digest}".encode()).hexdigest()


def parse_record(data: bytes) -> dict:
    """Headers of a record by lower-case name, its HTTP header's length field and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(names["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = re.search(rb"(?i)content-length: *(\d+)", http)
    number = lambda name: int(names[name].strip("<>").removeprefix(_ID)) if names.get(name, "<").startswith(f"<{_ID}") else None
    return {
        "page_id": number("warc-record-id"),
        "record_type": names["warc-type"],
        "payload_digest": names["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": number("warc-refers-to"),
        "payload_bytes": int(full[1]) if full else len(payload),
        "payload": payload,
        "url": names.get("warc-target-uri"),
    }


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _digested(batches):
    for batch in batches:
        digests, sizes = [], []
        for x in batch.column(2):
            payload = (x.as_py() or "").encode()
            digests.append(payload_digest(payload))
            sizes.append(len(payload))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "html", "digest", "size"])


_MANIFEST = "key string, page_id long, file string, offset long, length long"


def _written(folder: str, date: str):
    def run(batches):
        ctx = TaskContext.get()
        # a task that is run again writes another file; only the files that the manifest names are ever read
        name = f"{folder}/capture-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
        files, path = _files(name)
        out, at = None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    out = files.open_output_stream(path, compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url, (html or "").encode(), digest, refers_to, date)) + packer.flush()
                out.write(data)
                rows.append((url_key(url), page_id, name, at, len(data)))  # a null page_id stays null
                at += len(data)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one archive per task under ``folder``; returns the manifest (key, page_id, file, offset, length).

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with
    the largest page_id is the response, the others revisit it; a null html is
    an empty payload, a null url has no target header.  Rows that repeat the
    largest page_id of their payload are all responses.  A null page_id is the
    smallest and comes back as null; where all of a payload are null all are
    responses.  Payloads of any size are written whole; an empty table gives an
    empty manifest.  Other columns are not read.
    """
    small_batches(pages.sparkSession)
    files, path = _files(folder)
    files.create_dir(path, recursive=True)
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_digested, "page_id long, url string, html string, digest string, size long")
    marks = materialize(full.select("page_id", "digest", "size"), "digests")
    groups = marks.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1 and refers_to is not null"), "payloads")
    # only payloads that may have copies travel; the others are written where they are read
    asked = sifted(full.where(F.col("size") >= min_bytes), groups, ["digest"])
    known = attach(asked, groups, ["digest"], "n").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")).alias("refers_to"))
    alone = sifted(full, groups, ["digest"], others=True)
    if min_bytes > 0:
        alone = alone.unionByName(sifted(full, groups, ["digest"]).where(F.col("size") < min_bytes))
    alone = alone.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers_to"))
    return materialize(known.unionByName(alone).mapInArrow(_written(folder, date), _MANIFEST), "manifest")


_DIRECTORY = "first string, last string, file string, offset long, length long, lines long"


def _indexed(folder: str, lines: int):
    def run(frames):
        ctx = TaskContext.get()
        name = f"{folder}/index-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.cdx.z"
        files, path = _files(name)
        out, at, held = None, 0, []

        def block():
            nonlocal out, at, held
            if out is None:
                out = files.open_output_stream(path, compression=None)
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            out.write(data)
            row = (held[0][0], held[-1][0], name, at, len(data), len(held))
            at += len(data)
            held = []
            return row

        for batch in frames:
            rows = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                if len(held) >= lines:
                    rows.append(block())
            yield _directory_rows(rows)
        if held:
            yield _directory_rows([block()])
        if out is not None:
            out.close()

    return run


def _directory_rows(rows):
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["first", "last", "file", "offset", "length", "lines"])


def write_index(manifest: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures into compressed blocks; returns the sparse directory, one row per block.

    The captures of one URL may lie in several blocks and index files: page_id
    and place are part of the order, so a URL with very many captures is split.
    """
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "page_id", "file", "offset"]
    ordered = manifest.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(_indexed(folder, lines), _DIRECTORY), "directory")


def _range(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return handle.read(length)


def _block_lines(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]


def _entries(key: str | None = None):
    """Index lines of the blocks; with a key only that key's, found by bisection in each block."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                files, path = _files(name)
                with files.open_input_file(path) as handle:
                    found = _block_lines(_range(handle, offset, length))
                if key is not None:
                    at = bisect.bisect_left(found, key, key=lambda x: x[0])
                    found = found[at : bisect.bisect_right(found, key, lo=at, key=lambda x: x[0])]
                rows += found
                if len(rows) > 50_000:
                    yield _entry_rows(rows)
                    rows = []
            yield _entry_rows(rows)

    return run


def _entry_rows(rows):
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["key", "page_id", "file", "offset", "length"])


_RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _records(frames):
    handle, opened = None, None
    for pdf in frames:
        rows, held = [], 0
        for row in pdf.itertuples(index=False):
            if row.file != opened:
                if handle is not None:
                    handle.close()
                files, path = _files(row.file)
                handle, opened = files.open_input_file(path), row.file
            rows.append(parse_record(zlib.decompress(_range(handle, int(row.offset), int(row.length)), 31)))
            held += len(rows[-1]["payload"])
            if held > 16 << 20:
                yield _record_frame(rows)
                rows, held = [], 0
        yield _record_frame(rows)
    if handle is not None:
        handle.close()


def _record_frame(rows: list[dict]) -> pd.DataFrame:
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    # ids beside nulls would become floats, which hold 53 bits only
    return pd.DataFrame({name: pd.array([r[name] for r in rows], "Int64") if name in ("page_id", "refers_to") else [r[name] for r in rows] for name in names})


def _payloads(lines: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records of index lines, read by range in file order, about ``task_bytes`` of archive a task."""
    spark = lines.sparkSession
    lines = materialize(lines.select("file", "offset", "length"), "lines")
    total = lines.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-total // task_bytes), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_TASK_BYTES)))
    stretch = (F.col("offset") / task_bytes).cast("long")
    dealt = lines.withColumn("stretch", stretch).repartition(parts, "file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInPandas(_records, _RECORD)


def read_archives(directory: DataFrame) -> DataFrame:
    """Every record of the archives, found through the index blocks."""
    return _payloads(directory.select("file", "offset", "length").mapInArrow(_entries(), _MANIFEST))


class Directory:
    """The sparse directory in the order of its blocks, for binary search.

    It is held as the first and last keys of the Parquet files that the
    directory was written to, one pair per index file; a search bisects these
    and then the blocks of the files that it hits, so only those are read.
    """

    def __init__(self, directory: DataFrame):
        self.directory = directory
        ends = directory.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("first", "last")
        self.files = [(r["first"], r["last"], r["file"]) for r in ends.collect()]

    def blocks(self, key: str) -> DataFrame:
        """The blocks that may hold a key."""
        # the files are in order and touch in one key at most, so both ends can be bisected
        low = bisect.bisect_left(self.files, key, key=lambda x: x[1])
        high = bisect.bisect_right(self.files, key, lo=low, key=lambda x: x[0])
        names = [x[2] for x in self.files[low:high]]
        return self.directory.where(F.col("file").isin(names) & (F.col("first") <= key) & (F.col("last") >= key))


def lookup(directory: DataFrame | Directory, url: str) -> DataFrame:
    """The records of one URL: binary search in the directory, in its blocks, then range reads; revisits name the response by refers_to."""
    known = directory if isinstance(directory, Directory) else Directory(directory)
    key = url_key(url)
    return _payloads(known.blocks(key).select("file", "offset", "length").mapInArrow(_entries(key), _MANIFEST))


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives and index of ``pages`` to the shared folder; returns the directory."""
    folder = scratch_path(pages.sparkSession, "warc")
    return write_index(write_archives(pages, folder, min_bytes), folder)
