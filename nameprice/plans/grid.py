"""Grid search: text variant × vectoriser × model, resumable.

Every run has a key and its own partition of the log, so a stopped grid goes on where it
was: finished runs are read from the log and skipped, and a frame without open runs is
not built. The split and engineered features are computed once, the term counts once per
text variant (with the n-grams of all its vectorisers). The frames of a text variant are built
`BESIDE` at a time, as their many short jobs leave most cores idle, and beside the fits of the variant
before; runs are committed in order.
In a frame all ridges are one fit and
all boosting configurations grow together, on the engineered features beside
`COMPONENTS` components of the TF-IDF rows. A failed fit logs a NULL metric and its reason.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameprice.functions.features import BASIC31_COLUMNS
from nameprice.operators import boosting, leaderboard, metrics, models, svd, tfidf
from nameprice.plans.modelframe import model_frame, variant_counts
from nameprice.session import checkpoint
from nameprice.sources import files
from nameprice.sources.tables import products
from nameprice.streaming.leaderboard import scratch_dir

# FIXED VALUES: the five preprocessing variants and four vectorisers of the grid
TEXT_VARIANTS = (("v1_notok", "clean_v1", False), ("v1_tok", "clean_v1", True),
                 ("v2_notok", "clean_v2", False), ("v2_tok", "clean_v2", True),
                 ("v3_tok", "clean_v3", True))
VECTORIZERS = (  # name, vocabulary, n-gram range
    ("tfidf_5k_12", tfidf.TfidfConfig(5000, 3, 0.9, True), (1, 2)),
    ("tfidf_8k_13", tfidf.TfidfConfig(8000, 2, 0.95, True), (1, 3)),
    ("tfidf_10k_13", tfidf.TfidfConfig(10000, 2, 0.95, True), (1, 3)),
    ("tfidf_15k_23", tfidf.TfidfConfig(15000, 2, 0.95, True), (2, 3)),
)
# what a fit can fail with: its reason goes to the log, anything else is a fault
FIT_ERRORS = (PySparkException, Py4JJavaError, ArithmeticError, ValueError)


COMPONENTS = 50
BESIDE = 4                 # frames or fits at a time


@dataclass(frozen=True)
class Run:
    """One cell of the grid; `use_log` tells the target."""
    prep: str
    vec: str
    model: str
    use_log: bool

    @property
    def full_name(self) -> str:
        return f"{self.prep}|{self.vec}|{self.model}{'_log' if self.use_log else ''}"

    @property
    def key(self) -> str:
        return hashlib.md5(self.full_name.encode()).hexdigest()


def _logged(spark: SparkSession, runs: list[Run], fit) -> DataFrame:
    """Log rows of runs that one fit serves; `fit()` gives (long predictions, seconds)."""
    listed = spark.createDataFrame(
        [(r.key, r.prep, r.vec, r.model, r.use_log, r.full_name) for r in runs],
        "run_key string, preprocessing string, vectorization string, model string, use_log boolean, full_name string")
    try:
        preds, seconds = fit()
        found = checkpoint(metrics.model_comparison(preds).select(F.col("model").alias("m"), "val_smape"))
    except FIT_ERRORS as fault:
        return listed.select("*", F.lit(None).cast("string").alias("val_smape"), F.lit("0.00").alias("train_time"),
                             F.lit(f"{type(fault).__name__}: {fault}"[:500]).alias("error"))
    return listed.join(F.broadcast(found), F.col("model") == F.col("m"), "left").drop("m").withColumn(
        "val_smape", F.format_string("%.4f", "val_smape")).withColumn(
        "train_time", F.lit(f"{seconds:.2f}")).withColumn("error", F.lit(None).cast("string"))


def _fits(data: DataFrame, models_open: list[models.ModelConfig], boosted_open: list[boosting.BoostConfig]):
    """(names served, fit): ridges together, boosting together, every other model alone."""
    ridges = [m for m in models_open if m.kind == "ridge"]
    if ridges:
        def ridge_fit():
            preds, _, seconds = models.fit_evaluate_ridges(ridges, data)
            return preds, seconds
        yield [(m.name, m.log_target) for m in ridges], ridge_fit
    for m in models_open:
        if m.kind != "ridge":
            def one(m=m):
                preds, _, seconds = models.fit_evaluate(m, data)
                return preds, seconds
            yield [(m.name, m.log_target)], one
    if boosted_open:
        def boosted_fit():
            reduced = svd.fit(data.where("split = 'train'"), "tfidf", COMPONENTS)
            names = [F.col(c).cast("double") for c in BASIC31_COLUMNS]
            dense = checkpoint(data.withColumn("dense", F.concat(F.array(*names), reduced.scores())))
            preds, _, seconds = models.fit_evaluate_boosted(boosted_open, dense)
            return preds, seconds
        yield [(c.name, True) for c in boosted_open], boosted_fit


def run_grid(spark: SparkSession, sf: str, variants, vectorizers, model_cfgs=(), boosted=(),
             log_path: str | None = None, on_commit=None) -> DataFrame:
    """Run what the log at `log_path` does not hold yet; returns the whole log, best first.

    `on_commit(names)` is called after each commit. Boosting runs have the log target.
    """
    log_path = log_path or scratch_dir(spark, "experiment-log")
    done = finished(spark, log_path)
    before = []                # fits of the variant before, committed while this one's frames are built

    def commit(logged) -> None:
        for runs, rows in logged:
            files.commit_run(rows.result(), log_path)
            if on_commit is not None:
                on_commit(runs)

    with ThreadPoolExecutor(BESIDE) as building, ThreadPoolExecutor(BESIDE) as fitting:
        try:
            for prep, cleaner, seg in variants:
                cells = []
                for vec, cfg, ngrams in vectorizers:
                    ridge_open = [m for m in model_cfgs if Run(prep, vec, m.name, m.log_target).key not in done]
                    boost_open = [c for c in boosted if Run(prep, vec, c.name, True).key not in done]
                    if ridge_open or boost_open:
                        cells.append((vec, cfg, ngrams, ridge_open, boost_open))
                if not cells:
                    continue
                low, high = min(n[0] for _, _, n in vectorizers), max(n[1] for _, _, n in vectorizers)
                counted = variant_counts(products(spark, sf), cleaner, seg, (low, high)).persist(
                    StorageLevel.MEMORY_AND_DISK)
                frames = [building.submit(model_frame, spark, sf, cfg=cfg, text=cleaner, segmented=seg, ngrams=ngrams,
                                          counted=counted) for _, cfg, ngrams, _, _ in cells]
                commit(before)
                before = []
                for (vec, _, _, ridge_open, boost_open), frame in zip(cells, frames):
                    for names, fit in _fits(frame.result()[0], ridge_open, boost_open):
                        runs = [Run(prep, vec, name, log) for name, log in names]
                        before.append((runs, fitting.submit(_logged, spark, runs, fit)))
                counted.unpersist()
            commit(before)
        finally:
            building.shutdown(cancel_futures=True)
            fitting.shutdown(cancel_futures=True)
    log = leaderboard.typed_log(files.read_log(spark, log_path))
    return log.orderBy(F.col("val_smape").asc_nulls_last(), "full_name")


def finished(spark: SparkSession, log_path: str) -> set[str]:
    """Keys of the runs that the log holds (one row per run of the grid)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return set()
    return {r["run_key"] for r in files.read_log(spark, log_path).select("run_key").distinct().collect()}
