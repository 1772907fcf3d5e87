"""Small Column helpers shared by the feature families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_text(col: str | Column = "name") -> Column:
    """Null text becomes the empty string (the surveyed fill policy)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def count_matches(text: Column, pattern: str) -> Column:
    """Non-overlapping, leftmost-first match count of a Java regex."""
    return F.regexp_count(text, F.lit(pattern))


def has_match(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern)).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is not positive (no ANSI divide error)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def any_contains(text: Column, terms: list[str]) -> Column:
    """Byte-level substring test for any literal term (no regex, no decoding)."""
    tests = [F.contains(text, F.lit(t)) for t in terms]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def keyword_count(text: Column, terms: list[str]) -> Column:
    """Leftmost-first non-overlapping count of literal terms (listed order).

    Exactly the alternation count: when no term occurs as a substring the
    count is 0 and the regex is skipped (CASE evaluates its branch lazily);
    most names hit one to three of the 23 categories.
    """
    from nameprice.functions.lexicon import fast_alternation

    return F.when(any_contains(text, terms),
                  F.regexp_count(text, F.lit(fast_alternation(terms, lower=False)))
                  ).otherwise(F.lit(0))


def keyword_flag(text: Column, terms: list[str]) -> Column:
    """A literal alternation matches iff some term is a substring."""
    return any_contains(text, terms).cast("int")


def char_count(text: Column, chars: str) -> Column:
    """Occurrences of a fixed set of single characters (no regex)."""
    if len(chars) == 1:
        return F.length(text) - F.length(F.replace(text, F.lit(chars), F.lit("")))
    return F.length(text) - F.length(F.translate(text, chars, ""))
