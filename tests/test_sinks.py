"""Sinks and sources: prediction CSV round trip, metrics JSON, append-only log."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from nameprice.operators import validate
from nameprice.sources import files
from nameprice.sources.tables import products
from nameprice.streaming import leaderboard


def test_prediction_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="np-sink-")
    p = products(spark, SF_SMALL)
    sub = p.select("name", (F.col("price") * 1.5).alias("price"))
    files.write_predictions(sub, os.path.join(d, "pred"))
    back = files.read_price_csv(spark, os.path.join(d, "pred"), files.PREDICTION_SCHEMA)
    assert back.count() == p.count()
    chk = validate.validate_predictions(back.select("name", "price"), p).first()
    assert chk["columns_ok"] and chk["row_count_ok"] and chk["negative_rows"] == 0
    assert chk["null_rows"] > 0  # null names survive as nulls (flagged, not dropped)


def test_append_log_and_json(spark):
    d = tempfile.mkdtemp(prefix="np-log-")
    row = spark.createDataFrame([(1, "a", "b", "m", True, "12.3400", "1.00", "a|b|m_log")],
                                "run_id long, preprocessing string, vectorization string, "
                                "model string, use_log boolean, val_smape string, "
                                "train_time string, full_name string")
    files.append_log(row, os.path.join(d, "log"))
    files.append_log(row, os.path.join(d, "log"))
    assert files.read_log(spark, os.path.join(d, "log")).count() == 2
    files.write_metrics_json(row.select("model", F.lit(1.0).alias("value")), os.path.join(d, "m"))
    assert spark.read.json(os.path.join(d, "m")).count() == 1


def test_numeric_string_column_split(spark):
    from nameprice.functions import features as FT

    df = FT.with_all_features(products(spark, SF_SMALL))
    strings = [f.name for f in df.schema.fields
               if f.dataType.simpleString() == "string" and f.name in FT.all_feature_columns()]
    assert sorted(strings) == sorted(FT.STRING_FEATURES)
    assert len(FT.all_feature_columns()) == 201


def test_stable_ids_do_not_depend_on_the_split_of_rows(spark, monkeypatch):
    monkeypatch.setattr(files, "ID_BLOCK", 3)
    rows = [("a", 1)] * 10 + [("a", None), (None, 1), (None, None), (None, None), ("1:a", 1), ("", 1)]
    df = spark.createDataFrame(rows, "name string, price long")
    one = sorted(map(str, files.with_stable_ids(df.coalesce(1)).collect()))
    other = sorted(map(str, files.with_stable_ids(df.repartition(5)).collect()))
    assert one == other and len(set(one)) == len(rows)
    ids = files.with_stable_ids(df)
    assert ids.select("product_id").distinct().count() == len(rows)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(key, [tuple(r)[1:] for r in ids.collect()])) == sorted(map(key, rows))
    assert files.with_stable_ids(df.limit(0)).count() == 0


def test_latest_run_statistics_go_on_after_a_restart(spark, tmp_path):
    def land(rows):
        spark.createDataFrame(rows, leaderboard.LOG_STREAM_SCHEMA).coalesce(1).write.option(
            "header", True).mode("append").csv(str(tmp_path / "log"))
    run = lambda i, name, smape: (i, "p", "v", "m", False, smape, "1.0", name)
    land([run(1, "x", "50.0"), run(2, "y", "20.0")])
    out = str(tmp_path / "latest")
    first = leaderboard.run_latest_stats(spark, str(tmp_path / "log"), out).first()
    assert (first["runs"], first["best_smape"], first["worst_smape"]) == (2, 20.0, 50.0)
    land([run(3, "x", "24.0"), run(4, "z", "bad"), run(5, None, "1.0")])
    after = leaderboard.run_latest_stats(spark, str(tmp_path / "log"), out).first()
    assert (after["runs"], after["best_smape"], after["worst_smape"], after["under_25"]) == (3, 20.0, 24.0, 2)
