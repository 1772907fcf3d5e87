"""Steps whose cost must not outgrow their input: tasks, long aggregates, products, counts of trees."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nameprice.operators import boosting, correlation, models, ridge, scale, tfidf
from nameprice.plans import q_features
from nameprice.sources import tables


@pytest.fixture()
def part(tmp_path):
    """A table of one row group."""
    duckdb.sql("select i as p_partkey, 'red steel ' || i as p_name, 'Brand#1' as p_brand, 'TIN' as p_type, "
               f"cast(i % 50 as int) as p_size from range(300) t(i)").write_parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def sizes(df):
    return [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_a_table_of_one_row_group_is_dealt_to_every_core(spark, part):
    for rows in (tables.products(spark, part), tables.products_unpriced(spark, part)):
        assert max(sizes(rows)) < 300 / 4 and rows.count() == 300


def test_the_sample_builds_features_of_its_rows_alone(spark, part):
    plan = q_features.feature_sample(spark, part)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan and "RDD" in plan
    assert [r["product_id"] for r in q_features.feature_sample(spark, part).collect()] == list(range(200))


def test_moments_and_correlations_over_long_rows(spark):
    rows = [(float(i), None if i % 7 == 0 else float(i * i), 4.0, i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    frame = pd.DataFrame(rows, columns=["a", "b", "c", "y"])
    m = scale.fit_standardizer(df, ["a", "b", "c"])
    assert len(m._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = m.first()
    for c in "abc":
        assert got[f"mean_{c}"] == pytest.approx(frame[c].mean())
        assert got[f"std_{c}"] == pytest.approx(frame[c].std(ddof=0), abs=1e-12)
    wide = df.select("y", *[(F.col("a") * i + F.col("y")).alias(f"f{i}") for i in range(60)], F.lit(1.0).alias("one"))
    out = correlation.correlations_with(wide, [f"f{i}" for i in range(60)] + ["one"], "y")
    # one aggregate function of each kind, however many features
    assert out._jdf.queryExecution().optimizedPlan().toString().count("covar_pop") <= 2
    found = {r["feature"]: r["correlation"] for r in out.collect()}
    assert found["one"] is None and len(found) == 61
    assert found["f3"] == pytest.approx(np.corrcoef(frame["a"] * 3 + frame["y"], frame["y"])[0, 1])
    nothing = correlation.correlations_with(wide.where("false"), ["f1", "one"], "y").collect()
    assert [(r["feature"], r["correlation"]) for r in nothing] == [("f1", None), ("one", None)]
    assert scale.fit_standardizer(df.where("false"), ["a"]).first()["mean_a"] is None


def test_ngrams_are_counted_in_tasks_of_bounded_texts(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "TASK_CHARS", 1000)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"))
    counts = tfidf.term_counts(docs, F.split("text", " "), tfidf.word_analyzer(1, 2))
    assert counts.rdd.getNumPartitions() == 36 and max(sizes(counts)) < 2 * 7 * 2000 / 36
    assert counts.count() == 7 * 2000
    none = docs.where("false")
    assert tfidf.term_counts(none, F.split("text", " "), tfidf.word_analyzer(1, 2)).count() == 0


def test_wide_products_are_those_of_columns():
    rng = np.random.default_rng(3)
    x = np.where(rng.random((40, 30)) < 0.2, rng.normal(size=(40, 30)), 0)
    x[[0, 7, 39]] = 0
    row, place = np.nonzero(x)
    block = ridge.Block(row.astype(np.int32), place.astype(np.int32), x[row, place], np.zeros((40, 1)))
    v, u = rng.normal(size=(30, 5)), rng.normal(size=(40, 5))
    assert np.allclose(block.times_wide(v), x @ v) and np.allclose(block.back_wide(u, 30), x.T @ u)
    assert np.allclose(block.back_wide(u, 70_000)[:30], x.T @ u)


def test_a_task_counts_the_smaller_child_only(monkeypatch):
    rng = np.random.default_rng(8)
    n, width = 6000, 12
    bins = rng.integers(0, 8, (n, width)).astype(np.uint8)
    bins[:, 4], bins[:, 7] = 3, bins[:, 2]
    target = bins[:, 0] * 1.5 + (bins[:, 1] > 3) * bins[:, 2] + rng.normal(size=n)
    config = boosting.BoostConfig("c", 4, 0.3, 6, 20, 5, 0.5, rows=0.8, columns=0.8, held_share=0.1, patience=3)
    held = boosting.held_rows(config, np.arange(n))[:, None]
    counted, plain = [], boosting._cells

    def watched(bins, rows, *rest):
        counted.append(len(rows) * len(rest[3]))
        return plain(bins, rows, *rest)
    monkeypatch.setattr(boosting, "_cells", watched)
    grown, work = [], []
    for least in (n, 100):                     # all nodes counted, then one child of each node
        monkeypatch.setattr(boosting, "BLOCK_ROWS", least)
        monkeypatch.setattr(boosting, "KEPT_ROWS", 200)
        blocks = [boosting.Block(np.arange(a, a + 1500), bins[a:a + 1500], target[a:a + 1500], held[a:a + 1500],
                                 np.zeros((1500, 1))) for a in (1500, 0, 4500, 3000)]
        counted.clear()
        grown.append(boosting._rounds(boosting.Together(blocks), [config], np.array([target.mean()]),
                                      np.full(width, 9), 0)[0])
        work.append(sum(counted))
    assert work[1] < 0.6 * work[0]
    a, b = grown
    assert np.allclose(a.errors, b.errors) and len(a.trees) == 4
    for s, t in zip(a.trees, b.trees):
        # of the equal columns 2 and 7 either may be named
        assert [f % 5 if f == 7 else f for f in s.feature] == [f % 5 if f == 7 else f for f in t.feature]
        assert s.cut == t.cut and np.allclose(s.value, t.value)


def test_vectors_are_assembled_without_a_job_for_their_width(spark):
    ids = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, 5.0)], "product_id long, a double")
    weights = spark.createDataFrame([(1, 0, 0.6), (1, 3, 0.8), (3, 1, 1.0)], "doc_id long, idx int, weight double")
    spark.sparkContext.setJobGroup("assembled", "vectors")
    data = models.assemble(models.sparse_rows(ids, weights, 4), ["tfidf", "a"])
    spark.sparkContext.setJobGroup("read", "rows")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("assembled")
    found = {r["product_id"]: r["features"].toArray().tolist() for r in data.collect()}
    assert found == {1: [0.6, 0, 0, 0.8, 2.0], 2: [0.0] * 5, 3: [0, 1.0, 0, 0, 5.0]}
