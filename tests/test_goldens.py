"""Golden names that RE2 cannot express (Unicode, fullwidth, lookarounds, crc32)."""

import zlib

from pyspark.sql import functions as F

from nameprice.functions import features as FT
from nameprice.functions import text as X
from nameprice.functions.categories import with_category_features


def _row(df, pid):
    return df.where(F.col("product_id") == pid).first().asDict()


def test_null_and_empty(names_df):
    df = FT.with_all_features(names_df)
    for pid in (1, 2):
        r = _row(df, pid)
        assert r["name_length"] == 0 and r["digit_count"] == 0 and r["token_count"] == 0
        assert r["starts_with_symbol"] == 1
        assert r["primary_category"] == "other" and r["secondary_category"] == "other"
        assert r["category_entropy"] == 0.0
        assert r["dominant_color"] == "none"


def test_unicode_name(names_df):
    chars = _row(FT.with_char_features(names_df), 3)
    assert chars["name_length"] == 14
    assert chars["space_count"] == 2          # ASCII space and U+3000
    assert chars["digit_count"] == 2          # fullwidth ５ and 9
    assert chars["chinese_count"] == 3        # 𠮷 is outside U+4E00..9FFF
    assert _row(FT.with_basic31(names_df), 3)["special_char_count"] == 3
    h = names_df.where(F.col("product_id") == 3).select(X.stable_hash(F.col("name"))).first()[0]
    assert h == zlib.crc32("日本 A　５x-9(克)𠮷ß".encode()) % 2048 == 35


def test_units_and_lookarounds(names_df):
    r = _row(FT.with_basic31(names_df), 4)
    assert r["has_g"] == 0
    u = _row(FT.with_unit_features(names_df), 4)
    assert abs(u["weight_mean_kg"] - 0.5) < 1e-12
    assert _row(with_category_features(names_df), 4)["food_snack"] == 1.0
    v = _row(FT.with_unit_features(names_df), 5)
    assert abs(v["volume_mean_l"] - 0.5) < 1e-12
    assert abs(v["dimension_mean_cm"] - 50000.0) < 1e-9


def test_numbers(names_df):
    r = _row(FT.with_number_features(names_df), 6)
    assert r["number_count"] == 2 and r["number_sum"] == 15.0
    assert r["number_decimal_count"] == 2
    assert _row(FT.with_token_features(names_df), 6)["token_numeric_count"] == 0
    big = _row(FT.with_number_features(names_df), 7)
    assert big["number_max"] == 1e20


def test_category_ties(names_df):
    r = _row(with_category_features(names_df), 7)
    assert r["household"] == 1.0 and r["stationery"] == 1.0
    assert r["primary_category"] == "household" and r["secondary_category"] == "stationery"
    e = _row(with_category_features(names_df), 8)
    assert e["electronics"] == 1.0 and e["primary_category"] == "electronics"
    assert e["secondary_category"] == "food_staple" and e["secondary_category_score"] == 0.0


def test_token_hashes_match_zlib(names_df):
    r = _row(FT.with_token_features(names_df), 6)
    assert r["first_token_hash"] == zlib.crc32("米".encode()) % 2048
    assert r["last_token_hash"] == zlib.crc32("12.5".encode()) % 2048
    assert _row(FT.with_token_features(names_df), 2)["first_token_hash"] == 0


def test_mixed_tokens(spark):
    df = spark.createDataFrame([("黃金手錶 !? abc 12.5kg 米",)], "t string")
    assert df.select(X.segment(F.col("t"))).first()[0] == "黃金 金手 手錶 abc 12.5 kg 米"
