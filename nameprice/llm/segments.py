"""Cutting texts where no pre-token of the byte-level pattern can span.

A pre-token never runs from a non-space into white space, and a run of letters ends
where another character follows, so a text may be cut before every blank, tab or
line end that follows a non-space and behind a word, and the parts tokenised
independently. Parts repeat far more often than texts do, so workers
keep a bounded cache of them. Texts with rarer white space go in one part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from nameprice.llm.tokens import Terms, bytes_of

# letters that an ASCII character or the end follows are a pre-token of their own;
# else everything up to the next white space goes together
_WORD = "A-Za-zÀ-ÖØ-öø-ɏ"
PART = re.compile(rf"[ \t\n\r]*+[{_WORD}]++(?=[\x00-\x7f]|$)|[ \t\n\r]*+[^ \t\n\r]++|[ \t\n\r]++")
RARE_SPACE = re.compile(
    "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
SAFE_CUT = re.compile(r"(?<=[^ \t\n\r])[ \t\n\r]")
BLOCK = 1 << 18
CACHE_ENTRIES = 500_000


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Consecutive parts of about `size` characters, cut at safe places."""
    if len(text) <= size or RARE_SPACE.search(text):
        yield text
        return
    at = 0
    while at < len(text):
        cut = SAFE_CUT.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def parts(text: str) -> list[str]:
    """Smallest safe parts of a text; their concatenation is the text."""
    return [text] if RARE_SPACE.search(text) else PART.findall(text)


_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [9, 10, 13, 32])
_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
_LEAD = (_BYTE >= 0xC3) & (_BYTE <= 0xC9)      # lead bytes of the Latin letters of _WORD
_MAY_BE_RARE = np.isin(_BYTE, [0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])


def _in_word(data: np.ndarray) -> np.ndarray:
    """True for the bytes of the letters of _WORD."""
    lead = _LEAD[data]
    second = np.zeros_like(lead)
    before, after = data[:-1], data[1:]
    odd = ((before == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((before == 0xC9) & (after >= 0x90))
    second[1:] = lead[:-1] & ~odd
    whole = second.copy()
    whole[:-1] |= second[1:]
    return _LETTER[data] | whole


def cut_column(texts: pa.Array) -> Terms:
    """The parts of all texts of a string column, as `parts` cuts each one: distinct parts, and
    for every part in order its number and the text it stands in. Found on the bytes at once."""
    data, ends = bytes_of(texts)
    if not len(data):
        return Terms(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))
    begins = ends[:-1][ends[:-1] < ends[1:]]
    space, fresh = _SPACE[data], np.zeros(len(data), dtype=bool)
    fresh[begins] = True
    cut = fresh.copy()
    cut[1:] |= space[1:] & ~space[:-1]
    # a word at the head of a part ends where another ASCII character follows
    first = np.nonzero(~space & (fresh | np.append(True, space[:-1])))[0]
    outside = np.nonzero(~_in_word(data))[0]
    stop = np.append(outside, len(data))[np.searchsorted(outside, first)]
    limit = np.append(begins, len(data))[np.searchsorted(begins, first, "right")]
    inside = (stop > first) & (stop < limit)
    stop = stop[inside]
    cut[stop[(data[stop] < 128) & ~space[stop]]] = True
    doubtful = np.zeros(len(texts), dtype=bool)
    at = np.nonzero(_MAY_BE_RARE[data])[0]
    doubtful[np.searchsorted(ends, at, "right") - 1] = True
    for row in np.nonzero(doubtful)[0].tolist():
        if RARE_SPACE.search(texts[row].as_py()):
            cut[ends[row] + 1:ends[row + 1]] = False
    places = np.append(np.nonzero(cut)[0], len(data))
    found = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int32).tobytes()),
                                        pa.py_buffer(data.tobytes()))
    coded = found.dictionary_encode()
    return Terms(coded.dictionary, coded.indices.to_numpy().astype(np.int64),
                 np.searchsorted(ends, places[:-1], "right") - 1)
