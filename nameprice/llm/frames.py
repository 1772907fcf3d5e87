"""Token ids in independent zstandard frames with a trailing seek table.

A file holds one frame per document (its ids as little-endian unsigned 32-bit
integers, with a content checksum), a skippable frame with the document ids, and
the seek table of the public zstd seekable format: per frame its compressed and
decompressed size and the low 32 bits of XXH64 of its content. A reader fetches
the table from the end of the file and decompresses only the frames it wants.

Ranges of doc_id of near equal row counts come from a quantile sketch over the
doc_id column alone. Documents are encoded and compressed where they are read and
dealt out once, by range; each range is sorted and streamed into files in order.
Texts never move. A doc_id that fills several ranges is spread over them by
checksum. A file's name is fixed by its range and it appears by a rename,
so repeated or speculative task attempts leave the same file. Files go to the
shared folder through pyarrow's file systems, chosen by URI.

Strings of special tokens in a text are ordinary text. Defined cases: null text
counts as empty: just the end id. Null doc_ids come first. Rows repeating a
doc_id are neighbours, ordered by their frames. An empty table gives no file and
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nameprice.llm.common import checkpoint, share_package, shared_folder
from nameprice.llm.segments import CACHE_ENTRIES, cut_column
from nameprice.llm.tokens import slices

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
LEVEL = 1
FILE_BYTES = 64 << 20
CACHE_IDS = 4_000_000      # ids that a worker remembers
NULL_KEY = -(1 << 63)
# FIXED VALUES of the zstd seekable format
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80
MANIFEST = "file string, n_docs long, n_ids long, bytes long"
DOCUMENT = "file string, frame long, doc_id long, n_tokens long, ids_crc32 long, start long"


class CachedTokenizer:
    """Ids of whole columns of texts: cut at safe places, every distinct part encoded once and its
    ids kept in one array, from which those of all texts are gathered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark runs the tasks in parallel
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)                     # one character for each byte
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, dtype="<u4")
        self.ends = np.zeros(1, dtype=np.int64)            # part i: ids[ends[i]:ends[i + 1]]

    def _learn(self, new: list[str]) -> None:
        """Encode unknown parts: those that begin a safe place together, then cut by bytes."""
        joined = [p[0] in " \t\n\r" and p[-1] not in " \t\n\r" for p in new]
        together = [p for p, j in zip(new, joined) if j]
        alone = [p for p, j in zip(new, joined) if not j]
        if together:
            whole = "".join(together)
            ids = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, dtype="<u4")
            ends, sizes = np.cumsum(self.width[ids]), np.fromiter(map(len, together), np.int64, len(together))
            if not whole.isascii():
                sizes = np.fromiter((len(p.encode("utf-8")) for p in together), np.int64, len(together))
            wanted = np.cumsum(sizes)
            cuts = np.searchsorted(ends, wanted) + 1
            if len(ends) and ends[-1] == wanted[-1] and np.array_equal(ends[cuts - 1], wanted):
                self._keep(together, ids, cuts)
            else:
                alone += together
        if alone:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self._keep(alone, np.array([i for ids in found for i in ids], dtype="<u4"), np.cumsum(sizes))

    def _keep(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        first = len(self.ends) - 1
        self.number.update(zip(parts, range(first, first + len(parts))))
        self.ends = np.append(self.ends, len(self.ids) + ends)
        self.ids = np.append(self.ids, ids)

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text (null: none)."""
        cut = cut_column(texts)
        words = cut.words.to_pylist()
        if len(self.number) + len(words) > CACHE_ENTRIES or len(self.ids) > CACHE_IDS:
            self._forget()
        new = [w for w in words if w not in self.number]
        if new:
            self._learn(new)
        part = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))[cut.ids]
        sizes = np.diff(self.ends)[part]
        stops = np.cumsum(sizes)
        # place of every id: the first of its part, and one further for each id after it
        places = np.repeat((self.ends[part] - (stops - sizes)).astype(np.int32), sizes)
        places += np.arange(len(places), dtype=np.int32)
        every = self.ids[places]
        per_text = np.bincount(cut.row, sizes, len(texts)).astype(np.int64)
        return np.split(every, np.cumsum(per_text)[:-1])

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text]))[0].tobytes()


@lru_cache(maxsize=4)
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def ranges(docs: DataFrame, n: int) -> np.ndarray:
    """Ascending upper ends of n - 1 ranges of the sort key of doc_id."""
    shares = [i / n for i in range(1, n)]
    if not shares:
        return np.zeros(0, dtype=np.int64)
    found = docs.agg(F.percentile_approx(sort_key(F.col("doc_id")), shares,
                                         max(10_000, 10 * n))).first()[0]
    return np.array(found or [], dtype=np.int64)


def sort_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_KEY))


def place(ends: np.ndarray, key: int, check: int) -> int:
    """Range of a row; equal keys are dealt over all ranges that they fill, by checksum."""
    first, last = np.searchsorted(ends, key, "left"), np.searchsorted(ends, key, "right")
    return int(first + (check * int(last - first + 1) >> 32)) if last > first else int(first)


def framed(docs: DataFrame, ends: np.ndarray, path: str = TOKENIZER,
           level: int = LEVEL) -> DataFrame:
    """(doc_id, key, range, frame, size, check): the compressed ids of every text and where
    they go. Batches are cut into slices, so a task holds the ids of a few megabytes of text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       sort_key(F.col("doc_id")).alias("key"), "text")
    end = struct.pack("<I", END_ID)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        known = tokenizer(path)
        for batch in batches:
            for part in slices(batch, 2):
                ids = [i.tobytes() + end for i in known.encode_column(part.column(2))]
                checks = [xxhash.xxh64_intdigest(i) & 0xFFFFFFFF for i in ids]
                spots = [place(ends, k, c) for k, c in zip(part.column(1).to_pylist(), checks)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(spots, pa.int32()),
                     pa.array([packer.compress(i) for i in ids], pa.binary()),
                     pa.array([len(i) for i in ids], pa.int64()), pa.array(checks, pa.int64())],
                    names=["doc_id", "key", "range", "frame", "size", "check"])

    share_package()
    return rows.mapInArrow(encode, "doc_id long, key long, range int, frame binary, size long, check long")


def _skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


class SeekableFile:
    """Writes one file: frames as they come, ids and seek table at the end."""

    def __init__(self, folder: str, name: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.place = name, f"{self.folder}/{name}"
        task = TaskContext.get()
        self.draft = f"{self.folder}/.{name}.{task.taskAttemptId() if task else 0}"
        self.files.create_dir(self.folder, recursive=True)
        self.out, self.entries, self.ids = self.files.open_output_stream(self.draft), [], []
        self.bytes = 0

    def add(self, doc_id: int | None, frame: bytes, size: int, check: int) -> None:
        self.out.write(frame)
        self.entries.append((len(frame), size, check))
        self.ids.append(struct.pack("<?q", doc_id is not None, doc_id or 0))
        self.bytes += len(frame)

    def close(self) -> tuple[str, int, int, int]:
        ids = _skippable(SKIPPABLE_IDS, b"".join(self.ids))
        table = [*self.entries, (len(ids), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        footer = struct.pack("<IBI", len(table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(ids + _skippable(
            SKIPPABLE_TABLE, b"".join(struct.pack("<III", *e) for e in table) + footer))
        self.out.close()
        self.files.move(self.draft, self.place)
        return (self.name, len(self.entries), sum(e[1] for e in self.entries) // 4, self.bytes)


def write_ids(docs: DataFrame, folder: str, path: str = TOKENIZER,
              file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of every text to files in `folder`; returns their manifest.

    (file, n_docs, n_ids, bytes): a row per file; file names ascend with doc_id.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = framed(docs, ranges(docs, parts), path)
    ordered = encoded.repartitionById(parts, F.col("range")).sortWithinPartitions(
        "range", F.col("doc_id").isNotNull(), "key", "check", "frame")

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, done, now, number = None, [], None, 0
        for batch in batches:
            for doc_id, part, frame, size, check in zip(
                    batch["doc_id"], batch["range"], batch["frame"], batch["size"], batch["check"]):
                if out is not None and (part != now or out.bytes >= file_bytes):
                    done.append(out.close())
                    out = None
                if out is None:
                    now, number = part, number + 1 if part == now else 0
                    out = SeekableFile(folder, f"ids-{part:07d}-{number:05d}.zst")
                out.add(int(doc_id) if doc_id is not None else None, frame, size, check)
        if out is not None:
            done.append(out.close())
        yield pd.DataFrame(done, columns=["file", "n_docs", "n_ids", "bytes"])

    # a string column keeps null ids apart from numbers on the way through pandas
    rows = ordered.select(F.col("doc_id").cast("string"), "range", "frame", "size", "check")
    return checkpoint(rows.mapInPandas(write, MANIFEST))


class SeekableReader:
    """Random access to the documents of one file."""

    def __init__(self, folder: str, name: str):
        files, root = fs.FileSystem.from_uri(folder)
        self.file = files.open_input_file(f"{root}/{name}")
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError(f"{name}: no seek table with checksums at the end")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.sizes, self.checks = table[:, 1].astype(np.int64), table[:, 2]
        self.ends = np.cumsum(table[:, 0].astype(np.int64))
        start = int(self.ends[-2]) if n > 1 else 0
        raw = self._at(start + 8, int(self.ends[-1]) - start - 8)
        self.doc_ids = [v if known else None for known, v in struct.iter_unpack("<?q", raw)]
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def frame(self, i: int) -> bytes:
        """Id bytes of document number i; checked against the seek table."""
        start = int(self.ends[i - 1]) if i else 0
        ids = self.unpacker.decompress(self._at(start, int(self.ends[i]) - start))
        if len(ids) != self.sizes[i] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.checks[i]:
            raise ValueError(f"frame {i}: checksum of the seek table does not hold")
        return ids

    def document(self, doc_id: int | None) -> np.ndarray:
        """Ids of one document (without reading any other frame)."""
        return np.frombuffer(self.frame(self.doc_ids.index(doc_id)), dtype="<u4")


def read_documents(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(file, frame, doc_id, n_tokens, ids_crc32, start) of every document in the files.

    `start` counts the ids of all documents before it. The window over the manifest
    has one row per file of FILE_BYTES.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch["file"], batch["start"]):
                reader = SeekableReader(folder, name)
                at, rows = int(start), []
                for i in range(len(reader)):
                    ids = reader.frame(i)
                    rows.append((name, i, reader.doc_ids[i], len(ids) // 4, zlib.crc32(ids), at))
                    at += len(ids) // 4
                out = pd.DataFrame(rows, columns=["file", "frame", "doc_id", "n_tokens",
                                                  "ids_crc32", "start"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    share_package()
    return starts.repartition(tasks).mapInPandas(read, DOCUMENT)


def encode_to_files(docs: DataFrame, folder: str | None = None,
                    path: str = TOKENIZER) -> tuple[DataFrame, str]:
    """Write all documents; returns the manifest and the folder."""
    folder = folder or shared_folder(docs.sparkSession, "token-ids")
    return write_ids(docs, folder, path), folder
