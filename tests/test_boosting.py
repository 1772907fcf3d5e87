"""Shared-round boosting: rounds, patience, limits; the same trees over many tasks as in one."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nameprice.operators import boosting, models
from nameprice.operators.boosting import BoostConfig


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(600, 5))
    x[::50, 4] = np.nan
    y = 3 * x[:, 0] + 2 * (x[:, 1] > 0.5) + rng.normal(scale=0.05, size=600)
    frame = pd.DataFrame({"product_id": np.arange(600), "dense": list(x), "price": y})
    return spark.createDataFrame(frame).repartition(3), x, y


CONFIGS = [BoostConfig("a", 60, 0.3, 4, 12, 5, 0.1, held_share=0.2, patience=5),
           BoostConfig("b", 8, 0.2, 3, None, 1, 0.0, rows=0.7, columns=0.6)]


def test_many_tasks_grow_the_same_trees_as_one(signal, monkeypatch):
    df, _, _ = signal
    together = boosting.fit(df, F.col("price"), CONFIGS)
    monkeypatch.setattr(boosting, "TASK_ROWS", 200)
    spread = boosting.fit(df, F.col("price"), [replace(c, rounds=6) for c in CONFIGS])
    for a, b in zip(together, spread):
        n = min(len(a.trees), len(b.trees), 6)
        assert n and [t.feature for t in a.trees[:n]] == [t.feature for t in b.trees[:n]]
        assert [t.cut for t in a.trees[:n]] == [t.cut for t in b.trees[:n]]
        assert np.allclose([v for t in a.trees[:n] for v in t.value], [v for t in b.trees[:n] for v in t.value])


def test_patience_keeps_the_best_prefix(signal):
    df, x, y = signal
    model = boosting.fit(df, F.col("price"), CONFIGS)[0]
    best = int(np.argmin(model.errors))
    assert len(model.trees) == best + 1
    assert len(model.errors) == 60 or len(model.errors) == best + 1 + CONFIGS[0].patience
    rows = df.select("price", boosting.predictions([model])[0].alias("p")).toPandas()
    assert ((rows["price"] - rows["p"]) ** 2).mean() < 0.05 * y.var()
    # held-out error by hand: the rows of the configuration's hash
    held = boosting.held_rows(CONFIGS[0], np.arange(600))
    bins = boosting.binned(x, model.edges)
    assert abs(((y - model.of_bins(bins))[held] ** 2).mean() - model.errors[best]) < 1e-9


def test_limits_hold(signal):
    df, x, _ = signal
    a, b = boosting.fit(df, F.col("price"), CONFIGS)
    for model, c in ((a, CONFIGS[0]), (b, CONFIGS[1])):
        for tree in model.trees:
            leaves = sum(f < 0 for f in tree.feature)
            assert leaves <= (c.leaves or 2 ** c.depth)
    rows = ~boosting.held_rows(CONFIGS[0], np.arange(600))
    places = a.trees[0].places(boosting.binned(x, a.edges)[rows])
    assert np.unique(places, return_counts=True)[1].min() >= CONFIGS[0].min_leaf
    assert len(b.trees) == 8 and len({f for f in b.trees[0].feature if f >= 0}) <= 3


def test_first_split_is_the_best_by_hand(signal):
    df, x, y = signal
    model = boosting.fit(df, F.col("price"), [BoostConfig("stump", 1, 1.0, 1)])[0]
    bins, r = boosting.binned(x, model.edges), y - y.mean()
    gains = {}
    for f in range(5):
        for cut in np.unique(bins[:, f])[:-1]:
            left = bins[:, f] <= cut
            gains[f, int(cut)] = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum()
    tree = model.trees[0]
    assert (tree.feature[0], tree.cut[0]) == max(gains, key=gains.get)
    assert np.isclose(tree.gain[0], max(gains.values()))


def test_importances_name_the_signal(signal):
    df, _, _ = signal
    model = boosting.fit(df, F.col("price"), [BoostConfig("i", 20, 0.3, 3)])[0]
    change = boosting.permutation_errors(model, df, F.col("price"))
    gains = model.gains()
    assert np.isclose(gains.sum(), 1) and set(np.argsort(-gains)[:2]) == {0, 1}
    assert set(np.argsort(-change)[:2]) == {0, 1} and change[0] > 0.3


def test_no_rows_and_fixed_configurations(spark, signal):
    with pytest.raises(ValueError):
        boosting.fit(signal[0].where("price > 1e9").withColumn("dense", F.array(F.lit(1.0))),
                     F.col("price"), CONFIGS)
    found = models.boost_configs()
    assert [len(found[k]) for k in ("hgb", "three", "grid")] == [11, 3, 9]
    assert all(c.patience for c in found["hgb"])


def test_sparse_rows_count_by_their_entries(monkeypatch):
    """Bins, counts and children of sparse rows are those of the whole matrix."""
    from nameprice.operators import sparsebins

    rng = np.random.default_rng(4)
    x = np.where(rng.random((300, 9)) < 0.2, rng.normal(size=(300, 9)), 0)
    x[:, 2], x[:, 3], x[5, 4] = 0, rng.normal(size=300), np.nan
    edges = [np.unique(np.append(np.nanquantile(x[:, i], [0.1, 0.5, 0.9]), 0)) for i in range(9)]
    row, place = np.nonzero(x)
    start = np.append(0, np.cumsum(np.bincount(row, minlength=300)))
    sparse = sparsebins.binned(start, place.astype(np.int32), x[row, place], edges, sparsebins.zero_bins(edges))
    dense = boosting.binned(x, edges)
    rows, columns = np.divmod(np.arange(2700), 9)
    assert (sparse.at(rows, columns).reshape(300, 9) == dense).all() and len(sparse.place) < 800
    assert all((a == b).all() for a, b in zip(sparse.ends(), (dense.min(0), dense.max(0))))
    both = sparsebins.merged([sparse, sparse])
    assert (both.at(rows + 300, columns).reshape(300, 9) == dense).all()
    monkeypatch.setattr(sparsebins, "CHUNK", 50)
    chosen, own = np.repeat(rng.permutation(300)[:200], 2), np.array([0, 3, 4, 8])
    ends = np.append(0, np.cumsum([len(edges[i]) + 2 for i in own]))
    given = (chosen, rng.integers(0, 3, 400), 3, rng.normal(size=400), own, ends)
    assert np.allclose(boosting._cells(sparse, *given), boosting._cells(dense, *given))


def test_boosters_and_forests_grow_over_vectors(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(6)
    x = np.where(rng.random((400, 40)) < 0.1, rng.uniform(1, 2, (400, 40)), 0)
    x[:, 0] = rng.uniform(size=400)
    y = 5 * x[:, 0] + 3 * (x[:, 1] > 0) + rng.normal(scale=0.05, size=400)
    rows = [(None if i == 7 else i, Vectors.sparse(40, np.nonzero(r)[0].tolist(), r[r != 0].tolist()), float(v), "train")
            for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["product_id", "features", "price", "split"])
    for cfg in (models.ModelConfig("g", "gbt", {"maxIter": 30, "maxDepth": 3, "subsamplingRate": 0.8}),
                models.ModelConfig("f", "rf", {"numTrees": 20, "maxDepth": 6, "featureSubsetStrategy": "all"})):
        preds, model, _ = models.fit_evaluate(cfg, df, floor=-1e18)
        got = preds.toPandas()
        assert len(got) == 400 and ((got["y"] - got["yhat"]) ** 2).mean() < 0.1 * y.var()
        assert set(np.argsort(-model.featureImportances.toArray())[:2]) == {0, 1}
        # each tree of the forest draws its own rows, with replacement
        assert cfg.kind == "gbt" or len({tuple(m.trees[0].value) for m in model.members}) == 20
    config = [BoostConfig("s", 4, 0.3, 2, min_leaf=25, rows=0.7), BoostConfig("b", 4, 0.5, 2, min_leaf=25, bag=True)]
    together = boosting.fit(df, F.col("price"), config, "features")
    monkeypatch.setattr(boosting, "TASK_ENTRIES", 300)
    spread = boosting.fit(df, F.col("price"), config, "features")
    for a, b in zip(together, spread):
        assert [t.feature for t in a.trees] == [t.feature for t in b.trees]
        assert np.allclose([v for t in a.trees for v in t.value], [v for t in b.trees for v in t.value])


def test_permutations_ask_the_trees_of_a_feature_only(signal):
    df, x, y = signal
    model = boosting.fit(df, F.col("price"), [BoostConfig("i", 20, 0.3, 3)])[0]
    plain = boosting.permutation_errors(model, df, F.col("price"))
    rows = df.select("dense", "price", F.xxhash64(F.col("dense"), F.col("price").cast("double")).alias("o")).orderBy("o").collect()
    bins, target = boosting.binned(np.array([r["dense"] for r in rows], dtype=float), model.edges), np.array([r["price"] for r in rows])
    for f in range(5):
        own = bins.copy()
        own[:, f] = np.roll(own[:, f], 1 + boosting._salt(str(f)) % (len(target) - 1))
        rise = np.abs(target - model.of_bins(own)).mean() - np.abs(target - model.of_bins(bins)).mean()
        assert np.isclose(plain[f], rise)


@pytest.mark.parametrize("task_rows", [1 << 18, 200])
def test_predictions_of_all_rows_come_without_the_trees(spark, signal, monkeypatch, task_rows):
    df, _, _ = signal
    fits = F.col("product_id") % 5 != 0
    # a row without a target is not fitted, and predicted as the rows that are left out; rows may come twice
    marked = df.withColumn("price", F.when(F.col("product_id") != 7, F.col("price")))
    marked = marked.unionByName(marked.where("product_id = 10"))
    models_found = boosting.fit(marked.where(fits), F.col("price"), CONFIGS)
    wanted = df.select("product_id", boosting.predictions(models_found).alias("p")).toPandas().set_index("product_id")["p"]
    monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
    kept = []
    plain = boosting.Growing.finish
    monkeypatch.setattr(boosting.Growing, "finish", lambda g, w: (plain(g, w), kept.append(len(g.trees)))[0])
    rows, rounds = boosting.fit_predicted(marked, F.col("price"), fits, CONFIGS, ["product_id", "price"])
    assert rows.columns == ["product_id", "price", "m", "p"] and rows.count() == 2 * 601 and not any(kept)
    for m, (model, r) in enumerate(zip(models_found, rounds)):
        own = rows.where(F.col("m") == m).toPandas()
        assert np.allclose(own["p"], [wanted[i][m] for i in own["product_id"]])
        assert own["price"].isna().sum() == 1 and r.kept == len(model.trees) and np.allclose(r.errors, model.errors)
    with pytest.raises(ValueError):
        boosting.fit_predicted(marked.withColumn("price", F.lit(None)), F.col("price"), fits, CONFIGS, ["product_id"])


def test_long_configurations_begin_first():
    grid = models.boost_configs()["grid"]
    order = boosting._longest_first(grid)
    assert sorted(order) == list(range(9)) and [grid[i].rounds for i in order[:3]] == [500, 500, 400]
