"""Headline benchmark: prints ONE JSON line.

Runs the operators behind the published single-node numbers over
`products_large` (600,000 rows at sf0.1, about the surveyed train size):
CSV load, 31-feature extraction, five text variants, q=10 stratified split,
plus the 201-feature frame, TF-IDF fit+transform and the category summary. Ridge with one
and with four alphas runs on the model frame of `products` (20,000 rows at sf0.1, frame
built before) and is not part of the total.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from nameprice.functions import features as FT  # noqa: E402
from nameprice.functions import text as X  # noqa: E402
from nameprice.functions.categories import with_category_features  # noqa: E402
from nameprice.operators import models, profile, ridge, split, tfidf  # noqa: E402
from nameprice.plans.modelframe import model_frame  # noqa: E402
from nameprice.session import get_spark  # noqa: E402
from nameprice.sources import files  # noqa: E402
from nameprice.sources.tables import products_large  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, repeat: int = 2) -> float:
    best = None
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]")
    scratch = tempfile.mkdtemp(prefix="nameprice-bench-")

    base = products_large(spark, sf_dir).cache()
    n_rows = base.count()
    queries: dict[str, float] = {}

    csv_dir = os.path.join(scratch, "train_csv")
    base.select("name", "price").write.mode("overwrite").option("header", True).csv(csv_dir)
    queries["csv_load"] = timed(lambda: run(
        files.read_price_csv(spark, csv_dir).agg(F.sum(F.length("name")), F.sum("price"))))

    queries["features_31"] = timed(lambda: run(FT.with_basic31(base)))

    def variants():
        tok = {"v1_notok": X.clean_v1("name"), "v1_tok": X.segment(X.clean_v1("name")),
               "v2_notok": X.clean_v2("name"), "v2_tok": X.segment(X.clean_v2("name")),
               "v3_tok": X.segment(X.clean_v3("name"))}
        run(base.select("product_id", *[c.alias(k) for k, c in tok.items()]))
    queries["text_variants_5"] = timed(variants)

    queries["split_stratified_q10"] = timed(lambda: run(
        split.split_stratified(base.select("product_id", "price"), "product_id", "price", 10, 15)))

    queries["features_all_201"] = timed(lambda: run(FT.with_all_features(base)), repeat=1)

    def tfidf_fit_transform():
        docs = base.select(F.col("product_id").alias("doc_id"),
                           X.segment(X.clean_v1("name")).alias("text"))
        tf = tfidf.term_counts(docs, X.word_tokens(F.col("text")), tfidf.word_analyzer(1, 2))
        cfg = tfidf.TfidfConfig(max_features=5000, min_df=3, max_df=0.9, sublinear_tf=True)
        _, weights = tfidf.fit_transform(tf, F.lit(n_rows), cfg)
        run(weights)
        tf.unpersist()
    queries["tfidf_5k_fit_transform"] = timed(tfidf_fit_transform, repeat=1)

    queries["category_price_summary"] = timed(lambda: run(
        profile.category_price_summary(with_category_features(base))))

    total = round(sum(queries.values()), 3)

    data, _ = model_frame(spark, sf_dir)
    train, y = data.where("split = 'train'"), F.col("price").cast("double")
    queries["model_ridge"] = timed(lambda: ridge.fit(train, [(3.0, y)]), repeat=1)
    queries["ridge_sweep"] = timed(lambda: ridge.fit(train, [(a, y) for a in models.RIDGE_ALPHAS_SWEEP]),
                                   repeat=1)
    print(json.dumps({"metric": "products_large_headline_total", "value": total, "unit": "sec",
                      "queries": queries, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "rows": n_rows, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
