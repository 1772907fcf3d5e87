"""Terms of whole columns of texts, found on their bytes.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII,
with only A to Z lower-cased. Every byte of a character beyond ASCII is 0x80 or more,
so runs can be found on the UTF-8 bytes of an Arrow column at once, without a regular
expression or a Python string per term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLICE_BYTES = 4 << 20      # texts that a task cuts at once (one text may be longer)

_BYTE = np.arange(256)
IN_TERM = (_BYTE >= 128) | np.array([chr(b).isalnum() and b < 128 for b in _BYTE])
LOWERED = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


@dataclass
class Terms:
    """Terms of a column in order: `row` they stand in and `ids` into the distinct `words`."""
    words: pa.StringArray
    ids: np.ndarray
    row: np.ndarray


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text begins and the last one ends)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], (ends - ends[0]).astype(np.int64)


def terms(texts: pa.Array) -> Terms:
    """All terms of a string column (null: none)."""
    if not len(texts):
        return Terms(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))
    data, ends = bytes_of(texts)
    inside = IN_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a term never runs from one text into the next
    begins = ends[:-1][ends[:-1] < ends[1:]]
    closes = ends[1:][ends[:-1] < ends[1:]] - 1
    first[begins] = inside[begins]
    last[closes] = inside[closes]
    starts, stops = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    places = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(stops - starts, out=places[1:])
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places.tobytes()),
                                        pa.py_buffer(LOWERED[data[inside]].tobytes()))
    coded = found.dictionary_encode()
    return Terms(coded.dictionary, coded.indices.to_numpy().astype(np.int64),
                 np.searchsorted(ends, starts, "right") - 1)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts have at most `most` bytes (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and total + size > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < batch.num_rows:
        yield batch.slice(at)
