"""Registered text queries (§2.I): cleaners, tokenisers, n-grams, token hashes.

Names come from `products`; the `_documents` variants run the same operators
over every whole text of the `documents` table (doc_id plays product_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameprice.functions import text as X
from nameprice.operators.partitioning import spread
from nameprice.operators import tfidf
from nameprice.plans import sql_features as SF
from nameprice.plans.registry import register
from nameprice.sources.tables import products, read_table

CJK = "\\x{4e00}-\\x{9fff}"


def fill(template: str, c: str) -> str:
    """Substitute the text expression for {c} (regexes contain other braces)."""
    return template.replace("{c}", c)


# DuckDB (RE2) text of each cleaner; RE2's \s is ASCII, as are the fixture names
SQL_CLEAN = {
    "clean_keep_symbols": "trim(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), "
                          "'\\s+', ' ', 'g'), '[^a-zA-Z0-9" + CJK + "\\s\\[\\]\\(\\)\\-\\+\\*/]', ' ', 'g'), "
                          "'\\s+', ' ', 'g'))",
    "clean_alnum": "trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[^a-zA-Z0-9" + CJK
                   + "\\s]', ' ', 'g'), '\\s+', ' ', 'g'))",
    "clean_v1": "trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))",
    "clean_v2": "trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9" + CJK
                + "\\s]', ' ', 'g'), '\\s+', ' ', 'g'))",
    "clean_v3": "trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9" + CJK
                + "\\s\\-\\+\\*/\\(\\)\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g'))",
    "clean_tfidf": "trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9" + CJK
                   + "#+/\\-]', ' ', 'g'), '\\s+', ' ', 'g'))",
}

SQL_QUICK_TOKENS = ("regexp_extract_all(coalesce({c}, ''), '[A-Za-z]+|\\d+(?:\\.\\d+)?|["
                    + CJK + "]+')")
SQL_SEGMENT = ("array_to_string(flatten(list_transform(" + SQL_QUICK_TOKENS + ", lambda tok: "
               "case when regexp_full_match(tok, '[" + CJK + "]+') and length(tok) >= 2 "
               "then list_transform(range(1, length(tok)), lambda i: substring(tok, i, 2)) "
               "else [tok] end)), ' ')")
SQL_WORD_TOKENS = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{L}\\p{N}_]{2,}')"


def _clean_query(key: str):
    fn = X.CLEANERS[key]

    @register(key, f"select product_id, {fill(SQL_CLEAN[key], 'name')} as text from products")
    def q(spark, sf):
        return products(spark, sf).select("product_id", fn("name").alias("text"))

    q.__doc__ = fn.__doc__
    return q


for _k in X.CLEANERS:
    _clean_query(_k)


def _documents(spark, sf) -> DataFrame:
    return spread(read_table(spark, sf, "documents").select("doc_id", "text"))


@register("clean_tfidf_documents",
          f"select doc_id, {fill(SQL_CLEAN['clean_tfidf'], 'text')} as text from documents")
def clean_tfidf_documents(spark, sf):
    """I6 over whole document texts."""
    return _documents(spark, sf).select("doc_id", X.clean_tfidf("text").alias("text"))


@register("quick_tokens", f"""
select product_id, array_to_string({fill(SQL_QUICK_TOKENS, 'name')}, ' ') as tokens,
  cast(len({fill(SQL_QUICK_TOKENS, 'name')}) as int) as n_tokens
from products
""")
def quick_tokens(spark, sf):
    """I8: quick tokens (space-joined) and their count."""
    toks = X.quick_tokens("name")
    return products(spark, sf).select("product_id", F.array_join(toks, " ").alias("tokens"),
                                      F.size(toks).alias("n_tokens"))


@register("tokenize_mixed", f"""
select product_id,
  {fill(SQL_SEGMENT, fill(SQL_CLEAN['clean_tfidf'], 'name'))} as segmented
from products
""")
def tokenize_mixed(spark, sf):
    """I7 re-aimed: clean_tfidf, then quick tokens with CJK runs as bigrams."""
    return products(spark, sf).select("product_id", X.segment(X.clean_tfidf("name")).alias("segmented"))


@register("tokenize_mixed_documents", f"""
select doc_id, {fill(SQL_SEGMENT, fill(SQL_CLEAN['clean_tfidf'], 'text'))} as segmented
from documents
""")
def tokenize_mixed_documents(spark, sf):
    return _documents(spark, sf).select("doc_id", X.segment(X.clean_tfidf("text")).alias("segmented"))


@register("token_hashes", "select product_id, first_token_hash, second_token_hash, last_token_hash "
          "from (" + SF.tokens_sql(True) + ") t")
def token_hashes(spark, sf):
    """crc32 mod 2048 of the first/second/last lowercased quick token."""
    toks = F.transform(X.quick_tokens("name"), lambda t: F.lower(t))
    n = F.size(toks)
    first = F.when(n > 0, toks[0]).otherwise(F.lit(""))
    second = F.when(n > 1, toks[1]).otherwise(F.lit(""))
    last = F.when(n > 0, F.element_at(toks, -1)).otherwise(F.lit(""))
    return products(spark, sf).select(
        "product_id", X.stable_hash(first).alias("first_token_hash"),
        X.stable_hash(second).alias("second_token_hash"),
        X.stable_hash(last).alias("last_token_hash"))


def _word_ngram_sql(src: str, id_col: str, text_sql: str, n_max: int, n_min: int = 1) -> str:
    toks = fill(SQL_WORD_TOKENS, text_sql)
    parts = [f"select {id_col}, unnest(t) as term from w"] if n_min == 1 else []
    for n in range(max(2, n_min), n_max + 1):
        parts.append(
            f"select {id_col}, unnest(list_transform(range(1, len(t) - {n - 2}), "
            f"lambda i: array_to_string(t[i:i + {n - 1}], ' '))) as term from w where len(t) >= {n}")
    return (f"with w as (select {id_col}, {toks} as t from {src}) "
            f"select {id_col}, term, cast(count(*) as bigint) as tf from ("
            + " union all ".join(parts) + f") g group by {id_col}, term")


def _char_ngram_sql(src: str, id_col: str, text_sql: str, n_min: int, n_max: int) -> str:
    t = f"regexp_replace(lower(coalesce({text_sql}, '')), '\\s+', ' ', 'g')"
    parts = [f"select {id_col}, substring(t, i, {n}) as term from "
             f"(select {id_col}, t, unnest(range(1, length(t) - {n - 2})) as i from c "
             f"where length(t) >= {n}) s{n}"
             for n in range(n_min, n_max + 1)]
    return (f"with c as (select {id_col}, {t} as t from {src}) "
            f"select {id_col}, term, cast(count(*) as bigint) as tf from ("
            + " union all ".join(parts) + f") g group by {id_col}, term")


def _segmented_products(spark, sf) -> DataFrame:
    return products(spark, sf).select(
        F.col("product_id").alias("doc_id"), X.segment(X.clean_tfidf("name")).alias("text"))


SEG_NAME_SQL = fill(SQL_SEGMENT, fill(SQL_CLEAN["clean_tfidf"], "name"))
SEG_TEXT_SQL = fill(SQL_SEGMENT, fill(SQL_CLEAN["clean_tfidf"], "text"))


@register("word_ngrams", _word_ngram_sql(
    f"(select product_id as doc_id, {SEG_NAME_SQL} as s from products) p", "doc_id", "s", 2))
def word_ngrams(spark, sf):
    """Word 1–2-gram term counts per product over the segmented name."""
    return tfidf.term_counts(_segmented_products(spark, sf), X.word_tokens(F.col("text")), tfidf.word_analyzer(1, 2))


@register("word_ngrams_13", _word_ngram_sql(
    f"(select product_id as doc_id, {SEG_NAME_SQL} as s from products) p", "doc_id", "s", 3))
def word_ngrams_13(spark, sf):
    """Word 1–3-grams (the 8k/10k grid vectorisers)."""
    return tfidf.term_counts(_segmented_products(spark, sf), X.word_tokens(F.col("text")), tfidf.word_analyzer(1, 3))


@register("char_ngrams", _char_ngram_sql(
    f"(select product_id as doc_id, {fill(SQL_CLEAN['clean_tfidf'], 'name')} as s from products) p",
    "doc_id", "s", 2, 4))
def char_ngrams(spark, sf):
    """Character 2–4-gram counts per product over the cleaned name."""
    docs = products(spark, sf).select(F.col("product_id").alias("doc_id"),
                                      X.clean_tfidf("name").alias("text"))
    return tfidf.term_counts(docs, X.char_text(F.col("text")), tfidf.char_analyzer(2, 4))


@register("word_ngrams_documents", _word_ngram_sql(
    f"(select doc_id, {SEG_TEXT_SQL} as s from documents) d", "doc_id", "s", 2))
def word_ngrams_documents(spark, sf):
    """I10 over whole document texts: word 1–2-gram counts per document."""
    docs = _documents(spark, sf).select("doc_id", X.segment(X.clean_tfidf("text")).alias("text"))
    return tfidf.term_counts(docs, X.word_tokens(F.col("text")), tfidf.word_analyzer(1, 2))
