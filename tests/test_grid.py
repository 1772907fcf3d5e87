"""The resumable grid: a stop after seven runs, a restart, a failing model."""

import pytest

from nameprice.operators import models
from nameprice.operators.boosting import BoostConfig
from nameprice.plans import grid
from nameprice.sources import files

SF = "/root/testdata/sf0.001"
RIDGES = [models.ModelConfig("r1", "ridge", {"alpha": 1.0}), models.ModelConfig("r5", "ridge", {"alpha": 5.0}, True)]


class Stop(Exception):
    pass


def test_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    path, committed = str(tmp_path / "log"), []
    boosted = [BoostConfig("GB", 5, 0.1, 3), BoostConfig("GB2", 3, 0.1, 2)]
    args = dict(model_cfgs=RIDGES, boosted=boosted, log_path=path)
    variants, vectorizers = grid.TEXT_VARIANTS[:2], grid.VECTORIZERS[:2]

    def stop(runs):
        committed.extend(r.full_name for r in runs)
        if len(committed) >= 6:
            raise Stop
    with pytest.raises(Stop):
        grid.run_grid(spark, SF, variants, vectorizers, on_commit=stop, **args)
    before = {r["full_name"]: r for r in files.read_log(spark, path).collect()}
    assert set(before) == set(committed) and len(before) == 6
    # a seventh run that was committed twice (a retry) stays one row
    again = files.read_log(spark, path).where("model = 'r1'").limit(1)
    files.commit_run(spark.createDataFrame(again.collect(), again.schema), path)

    frames, build, later = [], grid.model_frame, []
    monkeypatch.setattr(grid, "model_frame", lambda *a, **k: frames.append(k) or build(*a, **k))
    log = grid.run_grid(spark, SF, variants, vectorizers, on_commit=later.extend, **args).collect()
    assert len(log) == len({r["full_name"] for r in log}) == 16
    assert len(later) == 10 and not {r.full_name for r in later} & set(before)
    assert len(frames) == 3                       # the finished frame is not built again
    assert all(r["val_smape"] > 0 and r["error"] is None for r in log)
    assert [r["val_smape"] for r in log] == sorted(r["val_smape"] for r in log)
    kept = {r["full_name"]: f"{r['val_smape']:.4f}" for r in log}
    assert all(kept[n] == r["val_smape"] for n, r in before.items())
    assert not grid.run_grid(spark, SF, variants, vectorizers, on_commit=stop, **args).count() - 16


def test_a_failed_fit_is_logged_with_its_reason(spark, tmp_path):
    bad = models.ModelConfig("bad", "gbt", {"maxIter": 1, "maxBins": 1})
    log = grid.run_grid(spark, SF, grid.TEXT_VARIANTS[:1], grid.VECTORIZERS[:1], [bad, *RIDGES],
                        log_path=str(tmp_path / "log")).collect()
    found = {r["model"]: r for r in log}
    assert found["bad"]["val_smape"] is None and found["bad"]["error"]
    assert found["r1"]["val_smape"] > 0 and found["r1"]["error"] is None
