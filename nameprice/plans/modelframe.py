"""The modelling frame: split + engineered features + TF-IDF sparse rows.

Built once per (sf, config) and checkpointed into the shared
`spark.checkpoint.dir`: iterative learners re-read it many times, and a lost
executor then recomputes from the checkpoint instead of re-running the regex
features and the TF-IDF shuffles.
"""

from __future__ import annotations

import threading

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameprice.functions import features as FT
from nameprice.functions import text as X
from nameprice.operators import models, split, tfidf
from nameprice.session import checkpoint
from nameprice.sources.tables import products

GRID_5K = tfidf.TfidfConfig(max_features=5000, min_df=3, max_df=0.9, sublinear_tf=True)

_CACHE: dict[tuple, tuple[DataFrame, list[str]]] = {}
_SPLITS: dict[tuple, DataFrame] = {}
_ONE = threading.Lock()        # frames that are built beside each other wait for the split they share


def inputs(spark: SparkSession, sf: str) -> tuple:
    """What a frame depends on: the application, and the state of the table it reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/part.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return (spark.sparkContext.applicationId, sf, files.getFileStatus(path).getModificationTime(),
            files.getContentSummary(path).getLength())


def _split_features(spark, sf, q, p: DataFrame, cacheable: bool) -> DataFrame:
    """Split + 31 features, computed once per (sf, q) and checkpointed."""
    key = (*inputs(spark, sf), q)
    if cacheable and key in _SPLITS:
        return _SPLITS[key]
    feats = FT.with_basic31(p.select("product_id", "name", "price"))
    sp = checkpoint(split.split_stratified(feats, "product_id", "price", q, 15))
    if cacheable:
        _SPLITS[key] = sp
    return sp


def variant_counts(p: DataFrame, text: str, segmented: bool, ngrams: tuple[int, int]) -> DataFrame:
    """(doc_id, term, tf) of the names of `p` in one text variant."""
    cleaned = X.CLEANERS[text]("name")
    doc_text = X.segment(cleaned) if segmented else cleaned
    docs = p.select(F.col("product_id").alias("doc_id"), doc_text.alias("text"))
    return tfidf.term_counts(docs, X.word_tokens(F.col("text")), tfidf.word_analyzer(*ngrams))


def model_frame(spark: SparkSession, sf: str, q: int = 10, cfg: tfidf.TfidfConfig = GRID_5K,
                text: str = "clean_v1", segmented: bool = False,
                base: DataFrame | None = None, ngrams: tuple[int, int] = (1, 2),
                extra: DataFrame | None = None,
                counted: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(product_id, name, price, stratum, split, tfidf, features) and feature names.

    The vectoriser is fit on the train split only (validation does not leak)
    and applied to every row; `features` = hstack(tfidf, 31 engineered). Rows of
    `extra` (product_id, name) have no price and the split `score`. `counted` gives the term
    counts (doc_id, term, tf) of the text, with n-grams that hold those asked for.
    """
    key = (*inputs(spark, sf), q, cfg, text, segmented, ngrams, extra is not None)
    if base is None and key in _CACHE:
        return _CACHE[key]
    p = base if base is not None else products(spark, sf)
    with _ONE:
        sp = _split_features(spark, sf, q, p, base is None)
    if extra is not None:
        more = FT.with_basic31(extra.select("product_id", "name")).select(
            "*", F.lit(None).cast("long").alias("price"), F.lit(None).cast("int").alias("stratum"),
            F.lit("score").alias("split"))
        sp = sp.unionByName(more.select(*sp.columns))
        p = p.select("product_id", "name").unionByName(extra.select("product_id", "name"))
    # read twice (vocabulary on train rows, weights on all rows): persist once
    if counted is None:
        tf = variant_counts(p, text, segmented, ngrams)
    else:
        n = F.size(F.split("term", " "))
        tf = counted.where((n >= ngrams[0]) & (n <= ngrams[1]))
    tf = tf.persist(StorageLevel.MEMORY_AND_DISK)
    train_ids = sp.where(F.col("split") == "train").select(F.col("product_id").alias("doc_id"))
    tf_train = tf.join(train_ids, "doc_id", "left_semi")
    n_train = train_ids.select(F.count(F.lit(1))).scalar()
    vocab = checkpoint(tfidf.fit_vocabulary(tf_train, n_train, cfg))
    size = vocab.count()  # one scalar: the vector width
    weights = tfidf.transform(tf, vocab, cfg)
    rows = models.sparse_rows(sp, weights, size)
    data = models.assemble(rows, ["tfidf"] + FT.BASIC31_COLUMNS)
    data = checkpoint(data.select("product_id", "name", "price", "stratum", "split", "tfidf",
                                  "features", *FT.BASIC31_COLUMNS))
    tf.unpersist()
    names = [f"tfidf_{i}" for i in range(size)] + FT.BASIC31_COLUMNS
    if base is None:
        _CACHE[key] = (data, names)
    return data, names
