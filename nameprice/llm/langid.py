"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from labelled texts.
A lower-cased text is encoded with every dictionary, block by block, and the language whose
dictionary gives the fewest bytes wins (ties: the smaller language name). The
prediction is rejected when the margin is narrow: the bytes saved against the
runner-up, as a share of the runner-up's. A short text would be stored as it is,
whatever the dictionary; it is encoded behind a lead that every dictionary ends
with, so that each of its own matches counts.

Learning reads a bounded sample: `SAMPLE_DOCS` labelled texts per language, those
with the smallest hashes of doc_id, of which at most `SAMPLE_CHARS` characters
each go into a dictionary of at most `DICT_BYTES`. At most `MAX_LANGUAGES`
languages are learned (more raise ValueError), which bounds what tasks receive.
Predictions read whole texts and nothing but the text.

Defined cases: a text that is null or has no letter is `und`, score 0, rejected.
Without any learned language every text is `und`. With one learned language the
runner-up is encoding without a dictionary. Rows with a null doc_id are not
learned from and are not held out. Repeated rows are predicted alike. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameprice.llm.common import release_memory, worker_udf

SAMPLE_DOCS = 192
SAMPLE_CHARS = 4096
DICT_BYTES = 128 << 10
MAX_LANGUAGES = 1024
BLOCK = 1024               # characters encoded on their own, so dictionaries always matter
LEVEL = 6
MIN_MARGIN = 0.002
SHORT = 256                # characters below which a text is encoded behind LEAD
LEAD = b"".join(b"%05d\n" % (i * 7919 % 100_000) for i in range(48))
UNKNOWN = "und"
PREDICTION = "lang_pred string, score double, margin double, rejected boolean"
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 2 by 4."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from."""
    return docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
                      & ~held_out(F.col("doc_id")))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Language -> dictionary bytes.

    Counts per language fix a hash threshold that passes about four times the
    wanted texts, so ranking sees a bounded number of rows however large a
    language is.
    """
    rows = training_rows(docs)
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    bound = F.lit(None).cast("long")
    for r in counts:
        share = min(1.0, 4 * sample_docs / r["count"])
        bound = F.when(F.col("lang") == r["lang"], F.lit(min(2 ** 63 - 1, int(share * 2 ** 63)))).otherwise(bound)
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "piece")
    picked = rows.where(place <= bound).select(
        "lang", "doc_id", place.alias("place"),
        F.lower(F.substring("text", 1, SAMPLE_CHARS)).alias("piece")).where("piece is not null") \
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs)
    texts: dict[str, dict[str, None]] = {}
    for r in picked.orderBy("lang", "n").collect():
        texts.setdefault(r["lang"], {})[r["piece"]] = None
    out = {}
    for lang, pieces in sorted(texts.items()):
        share = max(1, DICT_BYTES // max(1, len(pieces)))
        data = b"".join(p.encode("utf-8")[:max(share, 512)] + b"\n" for p in pieces)
        out[lang] = data[:DICT_BYTES - len(LEAD)] + LEAD
    return out


@dataclass(frozen=True)
class Compressors:
    """One compressor per language, sorted by name, and one without a dictionary."""
    langs: tuple[str, ...]
    own: tuple[zstandard.ZstdCompressor, ...]
    bare: zstandard.ZstdCompressor

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple:
        if not text or not self.langs or not LETTER.search(text):
            return (UNKNOWN, 0.0, 0.0, True)
        text = text.lower()
        if len(text) < SHORT:
            blocks = [LEAD + f" {text} ".encode()]
        else:
            blocks = [text[i:i + BLOCK].encode("utf-8") for i in range(0, len(text), BLOCK)]
        sizes = [sum(len(z.compress(b)) for b in blocks) for z in self.own]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rivals = [s for i, s in enumerate(sizes) if i != best] or [
            sum(len(self.bare.compress(b)) for b in blocks)]
        second = min(rivals)
        margin = max(0.0, (second - sizes[best]) / second)
        return (self.langs[best], min(1.0, margin), margin, margin < min_margin)


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> Compressors:
    own = []
    for _, data in sorted(dictionaries.items()):
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        own.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_checksum=False,
                                            write_content_size=False, write_dict_id=False))
    return Compressors(tuple(sorted(dictionaries)), tuple(own), zstandard.ZstdCompressor(
        level=level, write_checksum=False, write_content_size=False))


@lru_cache(maxsize=1)
def _worker(dictionaries: tuple) -> Compressors:
    return compressors(dict(dictionaries))


def predicted(text: Column, dictionaries: dict[str, bytes],
              min_margin: float = MIN_MARGIN) -> Column:
    """struct(lang_pred, score, margin, rejected) of a text column."""
    given = tuple(sorted(dictionaries.items()))

    @worker_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _worker(given)
        for texts in batches:
            yield pd.DataFrame([model.predict(t, min_margin) for t in texts],
                               columns=["lang_pred", "score", "margin", "rejected"])
        release_memory()
    return predict(text)


def identify(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) of every document."""
    given = learn(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       predicted(F.col("text"), given, min_margin).alias("p")).select(
        "doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of `docs` (all columns) whose language is not rejected."""
    given = learn(docs)
    rejected = predicted(F.col("text"), given, min_margin)["rejected"]
    return docs.where(~rejected)
