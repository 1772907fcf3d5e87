"""Byte-level BPE as a monoid: tree reduction for encoding and decoding.

The encodings of two neighbouring byte strings are joined into the encoding of
their concatenation, so a pre-token of any length is encoded as a tree: halves
are encoded on their own, equal ones once, then joined. A join re-encodes a window of tokens
around the seam and doubles it until the tokens outside are proven stable: BPE
by ranks has exactly one token sequence in which every neighbouring pair encodes
to itself, so once both window edges are such pairs the joined sequence is the
encoding of the whole. Short strings are the leaves and merge directly.
Pre-tokens are independent by definition, so above them the join is plain
concatenation; decoding concatenates bytes up the same tree.

Ranks come from a file in the tiktoken format (base64 bytes and rank per line);
its path is a parameter. Workers keep one encoder per file and a bounded cache.

Defined cases: null text counts as empty: no ids, the digest of an empty string.
Repeated rows and null doc_ids give a row each. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameprice.llm.common import release_memory, share_package, worker_udf
from nameprice.llm.segments import CACHE_ENTRIES, blocks, parts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LEAF = 64                  # bytes encoded directly
DECODE_LEAF = 4096         # ids decoded directly
SLICE = 512                # documents whose ids a task holds at once
NONE = 1 << 62             # rank of a pair that is no token
MAX_CACHED = 64           # characters of a part that is remembered
STAGE_ENTRIES = 1 << 17    # parts that a worker of the pipeline remembers, for one task
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Remembered(dict):
    """Bounded cache of encoded parts."""

    def __init__(self, encode: Callable[[str], bytes], most: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(part)
        if len(part) <= MAX_CACHED:
            if len(self) >= self.most:
                self.clear()
            self[part] = ids
        return ids


class TreeBPE:
    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, most: int = CACHE_ENTRIES):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: token for token, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.decimal = [b"%d" % i for i in range(max(self.bytes_of) + 1)]
        self.parts = Remembered(self.encode_part, most)
        self.stable = lru_cache(maxsize=200_000)(self._stable)

    def merge(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked neighbouring pair, leftmost first, until none is left."""
        ranks = self.ranks
        if len(data) > 2 * LEAF:
            return self._merge_long(data)
        words = [data[i:i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i:i + 2], NONE) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            at = pairs.index(best)
            words[at:at + 2] = [words[at] + words[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(words[at] + words[at + 1], NONE)
            if at:
                pairs[at - 1] = ranks.get(words[at - 1] + words[at], NONE)
        return [ranks[w] for w in words]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for a long window: linked list and heap of (rank, place)."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))            # end of the word that starts here
        before, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            alive[gone], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if before[i] >= 0 and (r := ranks.get(data[before[i]:stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def _stable(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of what `left` and `right` encode."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        wide = 1
        while True:
            window = left[-wide:] + right[:wide]
            middle = self.merge(b"".join(map(self.bytes_of.__getitem__, window)))
            head, tail = left[:-wide], right[wide:]
            if (not head or self.stable(head[-1], middle[0])) and (
                    not tail or self.stable(middle[-1], tail[0])):
                return head + middle + tail
            wide *= 2

    def tree(self, data: bytes, last: dict[int, tuple[bytes, list[int]]] | None = None) -> list[int]:
        """Halves are cut at a power of two leaves; `last` holds the newest subtree of each
        size, so a run of equal halves is encoded once a level."""
        if len(data) <= LEAF:
            return self.merge(data)
        last = {} if last is None else last
        if len(data) in last and last[len(data)][0] == data:
            return last[len(data)][1]
        half = LEAF << ((len(data) - 1) // LEAF).bit_length() - 1
        ids = self.join(self.tree(data[:half], last), self.tree(data[half:], last))
        last[len(data)] = (data, ids)
        return ids

    def encode_pretoken(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data)

    def encode_part(self, part: str) -> bytes:
        """Ids of a part as native 32-bit integers."""
        return array("I", [i for word in self.pattern.findall(part)
                           for i in self.encode_pretoken(word)]).tobytes()

    def encode_block(self, block: str) -> list[int]:
        ids = array("I")
        ids.frombytes(b"".join(map(self.parts.__getitem__, parts(block))))
        return ids.tolist()

    def encode(self, text: str) -> list[int]:
        return [i for block in blocks(text) for i in self.encode_block(block)]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids and of the decoded bytes."""
        n, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for block in blocks(text):
            ids = self.encode_block(block)
            if ids:
                listed.update(((b"," if n else b"") + b",".join(map(self.decimal.__getitem__, ids))))
                decoded.update(self.decode(ids))
                n += len(ids)
        return n, listed.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=4)
def encoder(path: str, most: int = CACHE_ENTRIES) -> TreeBPE:
    return TreeBPE(path, most=most)


def encoded(docs: DataFrame, path: str = RANKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, source, kept columns, n_tokens, ids, intact): the ids of every whole text,
    and whether decoding them gives its bytes again. Batches are cut into slices, so a task
    holds the ids of `SLICE` documents at most."""
    given = ["doc_id", "lang", "source", *keep]
    rows = docs.select(*given, "text")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, STAGE_ENTRIES)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(len(given)).to_pylist()]
                ids = [np.array(own.encode(t), dtype=np.int32) for t in texts]
                intact = [own.decode(i.tolist()) == t.encode("utf-8") for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(given)], pa.array([len(i) for i in ids], pa.int64()),
                     pa.array(ids, pa.list_(pa.int32())), pa.array(intact, pa.bool_())],
                    names=[*given, "n_tokens", "ids", "intact"])
        own.parts.clear()
        release_memory()

    share_package()
    schema = T.StructType([*rows.schema.fields[:len(given)], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("intact", T.BooleanType())])
    return rows.mapInArrow(encode, schema)


def ids_of(text: Column, path: str = RANKS) -> Column:
    """Ids of a text as array<int>."""
    @worker_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([encoder(path).encode(t or "") for t in texts])
    return encode(text)


def text_of(ids: Column, path: str = RANKS) -> Column:
    """Bytes that an array of ids stands for."""
    @worker_udf("binary")
    def decode(lists: pd.Series) -> pd.Series:
        return pd.Series([encoder(path).decode([] if x is None else list(x)) for x in lists])
    return decode(ids)


def digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    @worker_udf(DIGEST)
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = [encoder(path).digest(t or "") for t in texts]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", digest(F.col("text")).alias("d")).select("doc_id", "d.*")
