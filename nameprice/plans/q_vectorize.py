"""Registered vectorisation queries (§2.K): TF-IDF vocabularies and weights,
fit/transform on a holdout, standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameprice.functions import text as X
from nameprice.operators import scale, split, tfidf
from nameprice.operators.partitioning import spread
from nameprice.plans.q_text import (
    SEG_NAME_SQL, SEG_TEXT_SQL, SQL_CLEAN, _char_ngram_sql, _word_ngram_sql, fill)
from nameprice.plans.registry import register
from nameprice.sources.tables import products, read_table

WORD_CFG = tfidf.TfidfConfig(max_features=20000, min_df=5, max_df=1.0, sublinear_tf=True)
CHAR_CFG = tfidf.TfidfConfig(max_features=12000, min_df=5, max_df=1.0, sublinear_tf=True)
GRID_5K = tfidf.TfidfConfig(max_features=5000, min_df=3, max_df=0.9, sublinear_tf=True)

MD5_BUCKET_SQL = "(('0x' || substr(md5(cast(doc_id as varchar)), 1, 8))::bigint % 100)"


def _word_tf(spark, sf, n_max=2) -> DataFrame:
    docs = products(spark, sf).select(F.col("product_id").alias("doc_id"),
                                      X.segment(X.clean_tfidf("name")).alias("text"))
    return tfidf.term_counts(docs, X.word_tokens(F.col("text")), tfidf.word_analyzer(1, n_max))


def _char_tf(spark, sf) -> DataFrame:
    docs = products(spark, sf).select(F.col("product_id").alias("doc_id"),
                                      X.clean_tfidf("name").alias("text"))
    return tfidf.term_counts(docs, X.char_text(F.col("text")), tfidf.char_analyzer(2, 4))


def _n_products(spark, sf):
    return products(spark, sf).select(F.count(F.lit(1))).scalar()


def _vocab_sql(fit_tf_sql: str, n_sql: str, cfg: tfidf.TfidfConfig) -> str:
    """CTEs tf_fit, nn, st, v, vi (the fitted vocabulary)."""
    lo = str(cfg.min_df) if isinstance(cfg.min_df, int) else f"cast({cfg.min_df!r} as double) * nn.n"
    hi = str(cfg.max_df) if isinstance(cfg.max_df, int) else f"cast({cfg.max_df!r} as double) * nn.n"
    return f"""
tf_fit as ({fit_tf_sql}),
nn as (select cast(({n_sql}) as double) as n),
st as (select term, cast(count(*) as bigint) as df, cast(sum(tf) as bigint) as total
       from tf_fit group by term),
v as (select st.*, nn.n from st join nn on true where df >= {lo} and df <= {hi}
      order by total desc, term limit {cfg.max_features}),
vi as (select term, cast(row_number() over (order by term) - 1 as int) as idx, df, total,
         ln((1.0 + n) / (1.0 + cast(df as double))) + 1.0 as idf from v)
"""


def _weights_sql(apply_tf_sql: str, cfg: tfidf.TfidfConfig) -> str:
    """CTEs tf_apply, w and the final normalised select."""
    tfw = "(1.0 + ln(cast(t.tf as double)))" if cfg.sublinear_tf else "cast(t.tf as double)"
    return f"""
tf_apply as ({apply_tf_sql}),
w as (select t.doc_id, t.term, vi.idx, {tfw} * vi.idf as w from tf_apply t join vi using (term))
select doc_id, term, idx, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from w
"""


WORD_TF_SQL = _word_ngram_sql(f"(select product_id as doc_id, {SEG_NAME_SQL} as s from products) p",
                              "doc_id", "s", 2)
CHAR_TF_SQL = _char_ngram_sql(
    f"(select product_id as doc_id, {fill(SQL_CLEAN['clean_tfidf'], 'name')} as s from products) p",
    "doc_id", "s", 2, 4)


@register("tfidf_vocab", "with " + _vocab_sql(WORD_TF_SQL, "select count(*) from products", WORD_CFG)
          + " select term, idx, df, total, idf from vi", ["idf"])
def tfidf_vocab(spark, sf):
    """K1: word 1–2-gram vocabulary (20k cap, min_df 5) with smoothed idf."""
    return tfidf.fit_vocabulary(_word_tf(spark, sf), _n_products(spark, sf), WORD_CFG)


@register("tfidf_weights", "with " + _vocab_sql(WORD_TF_SQL, "select count(*) from products", WORD_CFG)
          + "," + _weights_sql(WORD_TF_SQL, WORD_CFG), ["weight"])
def tfidf_weights(spark, sf):
    """K1: sublinear TF × smoothed IDF, L2-normalised, every product (long form)."""
    tf = _word_tf(spark, sf)
    vocab = tfidf.fit_vocabulary(tf, _n_products(spark, sf), WORD_CFG)
    return tfidf.transform(tf, vocab, WORD_CFG)


@register("char_tfidf_vocab", "with " + _vocab_sql(CHAR_TF_SQL, "select count(*) from products", CHAR_CFG)
          + " select term, idx, df, total, idf from vi", ["idf"])
def char_tfidf_vocab(spark, sf):
    """K2: character 2–4-gram vocabulary (12k cap, min_df 5)."""
    return tfidf.fit_vocabulary(_char_tf(spark, sf), _n_products(spark, sf), CHAR_CFG)


@register("char_tfidf_weights", "with " + _vocab_sql(CHAR_TF_SQL, "select count(*) from products", CHAR_CFG)
          + "," + _weights_sql(CHAR_TF_SQL, CHAR_CFG), ["weight"])
def char_tfidf_weights(spark, sf):
    tf = _char_tf(spark, sf)
    vocab = tfidf.fit_vocabulary(tf, _n_products(spark, sf), CHAR_CFG)
    return tfidf.transform(tf, vocab, CHAR_CFG)


_FIT_TF_SQL = f"select * from ({WORD_TF_SQL}) a where {MD5_BUCKET_SQL} >= 20"
_APPLY_TF_SQL = f"select * from ({WORD_TF_SQL}) b where {MD5_BUCKET_SQL} < 20"
_N_TRAIN_SQL = ("select count(*) from products where "
                + MD5_BUCKET_SQL.replace("doc_id", "product_id") + " >= 20")


@register("tfidf_transform_holdout", "with " + _vocab_sql(_FIT_TF_SQL, _N_TRAIN_SQL, GRID_5K)
          + "," + _weights_sql(_APPLY_TF_SQL, GRID_5K), ["weight"])
def tfidf_transform_holdout(spark, sf):
    """K3: fit the 5k/1–2/min 3/max .9 vectoriser on the train split, apply to
    the validation split (out-of-vocabulary terms dropped)."""
    tf = split.split_random(_word_tf(spark, sf), "doc_id", 20)
    n_train = split.split_random(products(spark, sf), "product_id", 20).where(
        F.col("split") == "train").select(F.count(F.lit(1))).scalar()
    vocab = tfidf.fit_vocabulary(tf.where(F.col("split") == "train").drop("split"), n_train, GRID_5K)
    return tfidf.transform(tf.where(F.col("split") == "val").drop("split"), vocab, GRID_5K)


DOC_TF_SQL = _word_ngram_sql(f"(select doc_id, {SEG_TEXT_SQL} as s from documents) d", "doc_id", "s", 2)


@register("tfidf_vocab_documents", "with " + _vocab_sql(DOC_TF_SQL, "select count(*) from documents", GRID_5K)
          + " select term, idx, df, total, idf from vi", ["idf"])
def tfidf_vocab_documents(spark, sf):
    """K1 over whole document texts: 5k vocabulary, min_df 3, max_df .9."""
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    seg = docs.select("doc_id", X.segment(X.clean_tfidf("text")).alias("text"))
    tf = tfidf.term_counts(seg, X.word_tokens(F.col("text")), tfidf.word_analyzer(1, 2))
    n = read_table(spark, sf, "documents").select(F.count(F.lit(1))).scalar()
    return tfidf.fit_vocabulary(tf, n, GRID_5K)


# the remaining vectoriser configurations: name, n-gram range, vocabulary
OTHER_VOCABULARIES = {
    "tfidf_vocab_3k": ((1, 2), tfidf.TfidfConfig(3000, 2, 1.0, False)),
    "tfidf_vocab_8k_13": ((1, 3), tfidf.TfidfConfig(8000, 2, 0.95, True)),
    "tfidf_vocab_10k_13": ((1, 3), tfidf.TfidfConfig(10000, 2, 0.95, True)),
    "tfidf_vocab_15k_23": ((2, 3), tfidf.TfidfConfig(15000, 2, 0.95, True)),
}


def _register_vocabulary(name: str, ngrams: tuple[int, int], cfg: tfidf.TfidfConfig) -> None:
    tf_sql = _word_ngram_sql(f"(select product_id as doc_id, {SEG_NAME_SQL} as s from products) p",
                             "doc_id", "s", ngrams[1], ngrams[0])

    @register(name, "with " + _vocab_sql(tf_sql, "select count(*) from products", cfg)
              + " select term, idx, df, total, idf from vi", ["idf"])
    def vocabulary(spark, sf):
        docs = products(spark, sf).select(F.col("product_id").alias("doc_id"),
                                          X.segment(X.clean_tfidf("name")).alias("text"))
        tf = tfidf.term_counts(docs, X.word_tokens(F.col("text")), tfidf.word_analyzer(*ngrams))
        return tfidf.fit_vocabulary(tf, _n_products(spark, sf), cfg)

    vocabulary.__doc__ = f"K1: {ngrams[0]}-{ngrams[1]}-gram vocabulary of {cfg.max_features} terms."


for _name, (_ngrams, _cfg) in OTHER_VOCABULARIES.items():
    _register_vocabulary(_name, _ngrams, _cfg)
