"""Text cleaners and tokenisers as native Column expressions (no Python UDF).

Java regex is ASCII-only for \\s, \\d and \\w unless `(?U)` is set; the
surveyed code used Python's Unicode-aware `re`, so every pattern that uses
those classes carries `(?U)`. Null text is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nameprice.functions.common import safe_text
from nameprice.functions.lexicon import CJK

WS = "(?U)\\s+"
# FIXED VALUES: the character classes each cleaner keeps
KEEP_SYMBOLS = f"(?U)[^a-zA-Z0-9{CJK}\\s\\[\\]\\(\\)\\-\\+\\*/]"
KEEP_ALNUM = f"(?U)[^a-zA-Z0-9{CJK}\\s]"
KEEP_V2 = f"(?U)[^a-z0-9{CJK}\\s]"
KEEP_V3 = f"(?U)[^a-z0-9{CJK}\\s\\-\\+\\*/\\(\\)\\[\\]]"
KEEP_TFIDF = f"[^a-z0-9{CJK}#+/\\-]"
QUICK_TOKEN = f"(?U)[A-Za-z]+|\\d+(?:\\.\\d+)?|[{CJK}]+"
# word analyser: maximal runs of ≥2 word characters (letters, numbers, _)
WORD_TOKEN = "[\\p{L}\\p{N}_]{2,}"


def _squash(c: Column) -> Column:
    """Collapse whitespace runs to one space and strip (split/join)."""
    return F.trim(F.regexp_replace(c, WS, " "))


def clean_keep_symbols(col: str | Column = "name") -> Column:
    """Keep letters, digits, CJK, whitespace and [ ] ( ) - + * /; case kept."""
    t = F.regexp_replace(safe_text(col), WS, " ")
    return _squash(F.regexp_replace(t, KEEP_SYMBOLS, " "))


def clean_alnum(col: str | Column = "name") -> Column:
    """Keep letters, digits, CJK and whitespace; case kept."""
    return _squash(F.regexp_replace(safe_text(col), KEEP_ALNUM, " "))


def clean_v1(col: str | Column = "name") -> Column:
    """Lowercase, collapse whitespace."""
    return _squash(F.lower(safe_text(col)))


def clean_v2(col: str | Column = "name") -> Column:
    """I4: lowercase, keep a-z 0-9 CJK."""
    return _squash(F.regexp_replace(F.lower(safe_text(col)), KEEP_V2, " "))


def clean_v3(col: str | Column = "name") -> Column:
    """Lowercase, keep a-z 0-9 CJK and - + * / ( ) [ ]."""
    return _squash(F.regexp_replace(F.lower(safe_text(col)), KEEP_V3, " "))


def clean_tfidf(col: str | Column = "name") -> Column:
    """Lowercase, keep a-z 0-9 CJK # + / -."""
    return _squash(F.regexp_replace(F.lower(safe_text(col)), KEEP_TFIDF, " "))


CLEANERS = {
    "clean_keep_symbols": clean_keep_symbols,
    "clean_alnum": clean_alnum,
    "clean_v1": clean_v1,
    "clean_v2": clean_v2,
    "clean_v3": clean_v3,
    "clean_tfidf": clean_tfidf,
}


def quick_tokens(col: str | Column = "name") -> Column:
    """I8: runs of ASCII letters, numbers with optional decimals, or CJK."""
    return F.regexp_extract_all(safe_text(col), F.lit(QUICK_TOKEN), 0)


def mixed_tokens(col: str | Column) -> Column:
    """I7 (re-aimed segmentation): quick tokens, each CJK run of length ≥ 2
    expanded to its overlapping character bigrams."""
    toks = quick_tokens(col)

    def expand(t: Column) -> Column:
        # quick tokens are uniform runs: a token is a CJK run iff its first
        # character is in U+4E00..U+9FFF (a byte-order range test, no regex)
        n = F.length(t)
        first = t.substr(1, 1)
        cjk = (first >= F.lit("\u4e00")) & (first <= F.lit("\u9fff"))
        bigrams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: t.substr(i, F.lit(2)))
        return F.when(cjk & (n >= 2), bigrams).otherwise(F.array(t))

    return F.flatten(F.transform(toks, expand))


def segment(col: str | Column) -> Column:
    """Segmented text: mixed tokens joined by single spaces."""
    return F.array_join(mixed_tokens(col), " ")


def word_tokens(text: Column) -> Column:
    """Word analyser tokens: lowercase, maximal runs of ≥ 2 word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_TOKEN), 0)


def _slicer(tokens: Column, n: int):
    # one-argument lambdas only: F.transform reads a second parameter as the index
    return lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")


def _substring(t: Column, n: int):
    return lambda i: t.substr(i, F.lit(n))


def word_ngrams(tokens: Column, n_min: int, n_max: int) -> Column:
    """All word n-grams (n_min..n_max) of a token array, space-joined, in order.

    `tokens` must be a column reference of a projected array, not an
    expression: a lambda re-evaluates captured expressions per element.
    """
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(tokens)
            continue
        count = F.size(tokens) - n + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                            _slicer(tokens, n))
        parts.append(F.when(count >= 1, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def char_text(text: Column) -> Column:
    """Character-analyser input: lowercase, whitespace runs collapsed to one space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WS, " ")


def char_ngrams(t: Column, n_min: int, n_max: int) -> Column:
    """Character n-grams of a projected `char_text` column (see word_ngrams)."""
    parts = []
    for n in range(n_min, n_max + 1):
        count = F.length(t) - n + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                            _substring(t, n))
        parts.append(F.when(count >= 1, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def stable_hash(token: Column, modulo: int = 2048) -> Column:
    """crc32 of the UTF-8 bytes mod `modulo` (equal to zlib.crc32)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(token, F.lit("")), "UTF-8")), F.lit(modulo))
