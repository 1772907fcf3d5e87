"""WARC archives: deduplicating writer and salvage reader.

Writer: a record per page, each in a gzip member of its own. Among pages with
equal payloads (compared by SHA-256) of at least `min_revisit_bytes`, the one with
the smallest page_id is a `response`, the others are `revisit` records that refer
to it and hold HTTP headers only. Payload groups are pre-aggregated and matched on
digests; html is moved once, by page, so no group of copies meets in one task.
Files are named by partition and appear by a rename, so repeated attempts of a
task leave the same file; they go to the shared folder through pyarrow's file
systems, chosen by URI.

Reader: walks a file record by record in bounded memory. A record must pass every
check: gzip member complete with its CRC, version line, header block, content
length, closing blank lines, block and payload digests. After a failed check the
reader searches for the next gzip member or version line at which a valid record
starts, goes on there, and logs the bytes between as a quarantined gap with the
reason. So one damaged stretch costs only the records that it touches. A header block
may be of any length (a url may be); a block may be as long as any value of a row.

Defined cases: null html is an empty payload. A null page_id is written as `null`,
read back as null and sorts after all others; in a group of null ids alone one is
the response and the revisits refer to null. Rows that repeat a page_id and payload
are records of their own; one of them can be the response, the others revisit the
same page_id. A null url is written as `urn:page:<id>`. An empty table gives no
file and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nameprice.llm.common import checkpoint, share_package, shared_folder

FILE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"          # fixed, so that a repeated task writes the same bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
CHUNK, WINDOW, HEADER = 1 << 16, 1 << 20, 1 << 16
# a value of a row is shorter than 2 GiB, and its url three times as long when encoded
MAX_BLOCK, MAX_MEMBER = (1 << 31) + (1 << 16), 1 << 33
MANIFEST = "file string, n_records long, bytes long"
RECORD = ("file string, kind string, offset long, length long, reason string, record_type string, "
          "record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- writing -------------------------------------------------------------------------

def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *headers,
            ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") \
        + packer.flush()


def page_record(page_id: str | None, url: str | None, payload: bytes, copy: int, revisit: bool,
                refers_to: str | None) -> bytes:
    name = f"urn:page:{page_id or 'null'}"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    uri = quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else name
    headers = [("WARC-Record-ID", f"<{name}:{copy}>"), ("WARC-Target-URI", uri),
               ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
               ("Content-Type", "application/http;msgtype=response")]
    if not revisit:
        return record("response", headers, http + payload)
    headers += [("WARC-Refers-To", f"<urn:page:{refers_to or 'null'}:1>"), ("WARC-Profile", PROFILE)]
    return record("revisit", headers, http)


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id string, url, payload, copy, revisit, refers_to string) of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", F.col("page_id").cast("string").alias("id"), "url", "payload",
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("key"),
        F.sha2("payload", 256).alias("sha"))
    groups = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = rows.select("key", "sha").distinct().join(
        groups.select("sha", F.lit(True).alias("shared"), F.col("first").cast("string")), "sha")
    inside = Window.partitionBy("key", "sha").orderBy("url")
    numbered = rows.drop("page_id").withColumn("copy", F.row_number().over(inside))
    joined = numbered.join(members, ["key", "sha"], "left")
    revisit = F.col("shared").isNotNull() & ~(
        F.col("id").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    return joined.select("id", "url", "payload", "copy", revisit.alias("revisit"),
                         F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0,
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages to `folder`; returns (file, n_records, bytes), a row per file."""

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, out, done, count, size = task.partitionId(), None, [], 0, 0

        def close() -> None:
            out.close()
            files.move(draft, f"{root}/{name}")
            done.append((name, count, size))

        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    files.create_dir(root, recursive=True)
                    name = f"pages-{part:07d}-{len(done):05d}.warc.gz"
                    draft = f"{root}/.{name}.{task.taskAttemptId()}"
                    out, count, size = files.open_output_stream(draft, compression=None), 0, 0
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"),
                                               ("WARC-Filename", name),
                                               ("Content-Type", "application/warc-fields")],
                                  b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size += len(info)
                data = page_record(row.id, row.url, row.payload, row.copy, row.revisit,
                                   row.refers_to)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["file", "n_records", "bytes"])

    share_package()
    return checkpoint(plan_records(pages, min_revisit_bytes).mapInPandas(write, MANIFEST))


# ---- reading -------------------------------------------------------------------------

class Damaged(Exception):
    """A check that a record does not pass."""


@dataclass
class Record:
    offset: int
    length: int
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes:
        """Block without HTTP headers."""
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.block
        return self.block.partition(b"\r\n\r\n")[2]

    def payload_length(self) -> int:
        """Length of the full payload; a revisit states it in its HTTP headers."""
        if self.kind != "revisit":
            return len(self.payload)
        found = re.search(rb"(?i)^content-length: *([0-9]+) *\r$", self.block, re.M)
        return int(found[1]) if found else 0


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Source:
    """Random access to bytes, an archive file or a string of bytes."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size

    @classmethod
    def of(cls, data: bytes) -> Source:
        return cls(lambda at, n: data[at:at + n], len(data))

    def find_start(self, at: int) -> int:
        """Next place that could start a record; the end if there is none."""
        while at < self.size:
            window = self.read(at, WINDOW + 8)
            found = STARTS.search(window)
            if found:
                return at + found.start()
            at += WINDOW
        return self.size


def _header(take: Callable[[int, int], bytes], at: int) -> bytes:
    """Header block at `at`, read on until its blank line or a line that is none; raises Damaged."""
    n = HEADER
    while True:
        head = take(at, n)
        if not head.startswith(VERSION) or b"\r\n" not in head[:HEADER]:
            raise Damaged("no version line")
        stop = head.find(b"\r\n\r\n")
        if stop >= 0:
            return head[:stop]
        if any(b":" not in line for line in head.split(b"\r\n")[1:-1]):
            raise Damaged("header line without a colon")
        if len(head) < n:
            raise Damaged("header block does not end")
        n *= 4


def _parse(take: Callable[[int, int], bytes], at: int, size: int) -> tuple[Record, int]:
    """The record at `at` of uncompressed bytes and where it ends; raises Damaged."""
    head = _header(take, at)
    stop, headers = len(head), {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        key = name.decode("utf-8", "replace").lower()
        if key in headers and key in ("warc-type", "content-length"):      # of a record cut off before
            raise Damaged("header block runs into another one")
        headers[key] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit() or "warc-type" not in headers:
        raise Damaged("no type or content length")
    start, n = at + stop + 4, int(length)
    if n > MAX_BLOCK or start + n + 4 > size:
        raise Damaged("block runs past the end")
    block = take(start, n + 4)
    if block[n:] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    out = Record(at, stop + 8 + n, headers["warc-type"], headers, block[:n])
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != digest(out.block):
        raise Damaged("block digest does not hold")
    stated = headers.get("warc-payload-digest", "")
    if out.kind == "response" and stated.startswith("sha1:") and stated[5:] != digest(out.payload):
        raise Damaged("payload digest does not hold")
    return out, start + n + 4


def _member(source: Source, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at `at` and where it ends; raises Damaged."""
    unpacker, out, place, total = zlib.decompressobj(31), [], at, 0
    try:
        while not unpacker.eof:
            data = source.read(place, CHUNK)
            if not data:
                raise Damaged("gzip member is cut off")
            place += len(data)
            while data and not unpacker.eof:
                part = unpacker.decompress(data, WINDOW)
                total += len(part)
                if total > MAX_MEMBER:
                    raise Damaged("gzip member is too large")
                out.append(part)
                data = unpacker.unconsumed_tail
    except zlib.error as fault:
        raise Damaged(f"gzip member: {fault}") from fault
    return b"".join(out), place - len(unpacker.unused_data)


def _records_at(source: Source, at: int) -> tuple[list[Record], int]:
    """Valid records that start at `at` and where they end; raises Damaged."""
    if source.read(at, 3) != MAGIC:
        found, end = _parse(source.read, at, source.size)
        return [found], end
    data, end = _member(source, at)
    found, inner = [], 0
    while inner < len(data):
        one, inner = _parse(lambda a, n: data[a:a + n], inner, len(data))
        one.offset, one.length = at, end - at
        found.append(one)
    return found, end


def salvage(source: Source) -> Iterator[Record | Gap]:
    """All valid records of an archive, and the byte gaps between them."""
    at, lost, reason = 0, None, ""
    while at < source.size:
        try:
            found, end = _records_at(source, at)
        except Damaged as fault:
            if lost is None:
                lost, reason = at, str(fault)
            at = source.find_start(at + 1)
            continue
        if lost is not None:
            yield Gap(lost, at - lost, reason)
            lost = None
        yield from found
        at = end
    if lost is not None:
        yield Gap(lost, source.size - lost, reason)


def _page_id(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+):[0-9]+>", name)
    return int(found[1]) if found else None


def _row(file: str, item: Record | Gap, payload: bool) -> tuple:
    if isinstance(item, Gap):
        return (file, "gap", item.offset, item.length, item.reason, *[None] * 8)
    h = item.headers
    stated = h.get("warc-payload-digest", "")
    return (file, "record", item.offset, item.length, None, item.kind, h.get("warc-record-id"),
            h.get("warc-target-uri"), _page_id(h.get("warc-record-id", "")),
            _page_id(h.get("warc-refers-to", "")), item.payload_length(),
            stated[5:] if item.kind == "revisit" else digest(item.payload),
            item.payload if payload else None)


def read_archives(files: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Records and quarantined gaps of the archives named in `files.file` (schema RECORD)."""
    names = RECORD.split(", ")
    columns = [n.split()[0] for n in names]
    whole = [n.split()[0] for n in names if n.endswith(" long")]
    spark = files.sparkSession
    tasks = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in whole})

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["file"]:
                with store.open_input_file(f"{root}/{name}") as file:
                    rows, size = [], 0
                    source = Source(lambda at, n: file.read_at(n, at), file.size())
                    for item in salvage(source):
                        rows.append(_row(name, item, payload))
                        size += len(rows[-1][-1] or b"") + 200
                        if size > 8 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                    yield frame(rows)

    share_package()
    return files.select("file").repartition(tasks).mapInPandas(read, RECORD)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the archives of a folder that another writer made."""
    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    names = [(f.path[len(root):].lstrip("/"),) for f in found
             if re.search(r"\.warc(\.gz)?$", f.path) and not f.base_name.startswith(".")]
    return spark.createDataFrame(sorted(names), "file string")


def round_trip(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages to archives and read these back (records and gaps)."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_revisit_bytes), folder)
