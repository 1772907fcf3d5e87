"""Name feature families as native projections (no Python UDF, no shuffle).

Each `with_*` function appends one family to a DataFrame that has a `name`
column. Extracted arrays (numbers, tokens, unit matches) are projected once
into `_`-prefixed helper columns and every feature reads that column, so a
regex runs once per row; helpers are dropped at the end of the family.

Python's `re` is Unicode-aware, so `\\d`, `\\s`, `\\w` patterns carry `(?U)`;
numbers written with full-width digits are mapped to ASCII before the cast
(Python's float() accepts them, Java's does not). Integers are DOUBLE: a long
digit run overflows BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameprice.functions import lexicon as L
from nameprice.functions.common import (
    char_count, count_matches, has_match, keyword_count, keyword_flag, ratio, safe_text)
from nameprice.functions.lexicon import CJK
from nameprice.functions.text import QUICK_TOKEN, stable_hash

FULLWIDTH_DIGITS = "０１２３４５６７８９"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LETTERS = UPPER + LOWER
CJK_FIRST, CJK_LAST = "\u4e00", "\u9fff"
ASCII_DIGITS = "0123456789"


def _num(s: Column) -> Column:
    return F.translate(s, FULLWIDTH_DIGITS, ASCII_DIGITS).try_cast("double")


def _nums(c: Column) -> Column:
    return F.transform(c, _num)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, _sum(arr) / F.size(arr)).otherwise(F.lit(0.0))


def _pop_std(arr: Column, mean: Column) -> Column:
    """Population std (two-pass), 0 for fewer than two values."""
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(F.size(arr) > 1, F.sqrt(ss / F.size(arr))).otherwise(F.lit(0.0))


def _median(arr: Column) -> Column:
    s = F.array_sort(arr)
    n = F.size(arr)
    mid = F.floor(n / 2).cast("int")
    odd = F.element_at(s, mid + 1)
    even = (F.element_at(s, mid) + F.element_at(s, mid + 1)) / F.lit(2.0)
    return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, odd).otherwise(even)


def _count_if(arr: Column, pred) -> Column:
    return F.size(F.filter(arr, pred))


def _is_ascii_letter(ch: Column) -> Column:
    """One-character string in [A-Za-z] (UTF-8 byte order = code point order)."""
    return ((ch >= F.lit("A")) & (ch <= F.lit("Z"))) | ((ch >= F.lit("a")) & (ch <= F.lit("z")))


# --------------------------------------------------------------- J1 basic-5
def with_basic5(df: DataFrame) -> DataFrame:
    """num_count, max/min/sum/avg over integer runs `\\d+` (0 when none)."""
    s = df.select("*", _nums(F.regexp_extract_all(safe_text("name"), F.lit("(?U)\\d+"), 0))
                  .alias("_ints"))
    a = F.col("_ints")
    has = F.size(a) > 0
    return s.select(
        *df.columns,
        F.size(a).alias("num_count"),
        F.when(has, F.array_max(a)).otherwise(F.lit(0.0)).alias("max_number"),
        F.when(has, F.array_min(a)).otherwise(F.lit(0.0)).alias("min_number"),
        _sum(a).alias("sum_numbers"),
        _mean(a).alias("avg_number"))


BASIC5_COLUMNS = ["num_count", "max_number", "min_number", "sum_numbers", "avg_number"]


# --------------------------------------------------------------- J2 / J3
def _word_count(name: Column) -> Column:
    """Whitespace-split word count (str.split semantics: runs, no empties)."""
    return F.size(F.filter(F.split(F.trim(F.regexp_replace(name, "(?U)\\s+", " ")), " "),
                           lambda w: w != ""))


def with_basic11(df: DataFrame) -> DataFrame:
    n = safe_text("name")
    s = df.select("*", _nums(F.regexp_extract_all(n, F.lit("(?U)\\d+"), 0)).alias("_ints"))
    a = F.col("_ints")
    return s.select(
        *df.columns,
        F.size(a).alias("num_count"),
        F.when(F.size(a) > 0, F.array_max(a)).otherwise(F.lit(0.0)).alias("max_num"),
        _sum(a).alias("sum_num"),
        F.length(n).alias("name_length"),
        _word_count(n).alias("word_count"),
        has_match(n, "[a-zA-Z]").alias("has_english"),
        has_match(n, f"[{CJK}]").alias("has_chinese"),
        has_match(n, "(?U)\\d").alias("has_number"),
        has_match(n, "[A-Z]{2,}").alias("has_brand"),
        has_match(n, "[()]").alias("has_parenthesis"),
        has_match(n, "[\\[\\]]").alias("has_bracket"))


BASIC11_COLUMNS = ["num_count", "max_num", "sum_num", "name_length", "word_count", "has_english",
                   "has_chinese", "has_number", "has_brand", "has_parenthesis", "has_bracket"]


def with_basic31(df: DataFrame) -> DataFrame:
    """The 31 grid-search features."""
    n = safe_text("name")
    s = df.select("*", _nums(F.regexp_extract_all(n, F.lit("(?U)\\d+"), 0)).alias("_ints"))
    a = F.col("_ints")
    has = F.size(a) > 0
    return s.select(
        *df.columns,
        F.length(n).alias("name_length"),
        _word_count(n).alias("word_count"),
        F.length(F.replace(n, F.lit(" "), F.lit(""))).alias("char_count"),
        F.size(a).alias("num_count"),
        F.when(has, F.array_max(a)).otherwise(F.lit(0.0)).alias("max_num"),
        F.when(has, F.array_min(a)).otherwise(F.lit(0.0)).alias("min_num"),
        _sum(a).alias("sum_num"),
        _mean(a).alias("mean_num"),
        F.when(has, F.element_at(a, 1)).otherwise(F.lit(0.0)).alias("first_num"),
        has_match(n, "[a-zA-Z]").alias("has_english"),
        has_match(n, f"[{CJK}]").alias("has_chinese"),
        has_match(n, "(?U)\\d").alias("has_number"),
        char_count(n, ASCII_LETTERS).alias("english_count"),
        count_matches(n, f"[{CJK}]").alias("chinese_count"),
        has_match(n, "[()]").alias("has_parenthesis"),
        has_match(n, "[\\[\\]]").alias("has_bracket"),
        F.contains(n, F.lit("-")).cast("int").alias("has_dash"),
        F.contains(n, F.lit("/")).cast("int").alias("has_slash"),
        F.contains(n, F.lit("*")).cast("int").alias("has_asterisk"),
        count_matches(n, "(?U)[^\\w\\s]").alias("special_char_count"),
        has_match(n, "[A-Z]{2,}").alias("has_brand"),
        count_matches(n, "\\p{Lu}").alias("uppercase_count"),
        keyword_flag(n, ["kg", "KG", "公斤"]).alias("has_kg"),
        has_match(n, "(?U)(?<!\\d)g(?!\\d)|克").alias("has_g"),
        keyword_flag(n, ["ml", "ML", "毫升"]).alias("has_ml"),
        has_match(n, "(?U)(?<!\\d)[Ll](?!\\d)|公升").alias("has_l"),
        keyword_flag(n, ["cm", "CM", "公分"]).alias("has_cm"),
        keyword_flag(n, ["inch", "吋"]).alias("has_inch"),
        keyword_flag(n, ["包", "入", "組", "盒"]).alias("has_pack"),
        keyword_flag(n, L.SET_WORDS).alias("has_set"),
        keyword_flag(n, L.LUXURY_WORDS_31).alias("has_luxury"))


BASIC31_COLUMNS = [
    "name_length", "word_count", "char_count", "num_count", "max_num", "min_num", "sum_num",
    "mean_num", "first_num", "has_english", "has_chinese", "has_number", "english_count",
    "chinese_count", "has_parenthesis", "has_bracket", "has_dash", "has_slash", "has_asterisk",
    "special_char_count", "has_brand", "uppercase_count", "has_kg", "has_g", "has_ml", "has_l",
    "has_cm", "has_inch", "has_pack", "has_set", "has_luxury"]


# --------------------------------------------------------------- J4 characters
CHAR_COLUMNS = [
    "name_length", "char_no_space", "space_count", "digit_count", "alpha_count",
    "alpha_upper_count", "alpha_lower_count", "chinese_count", "symbol_count",
    "punctuation_count", "exclamation_count", "question_count", "hash_count", "slash_count",
    "dash_count", "plus_count", "ampersand_count", "digit_ratio", "alpha_ratio",
    "chinese_ratio", "symbol_ratio", "starts_with_digit", "starts_with_alpha",
    "starts_with_chinese", "starts_with_symbol", "ends_with_digit", "ends_with_alpha",
    "ends_with_chinese", "unique_char_count", "unique_char_ratio"]


def with_char_features(df: DataFrame) -> DataFrame:
    n = safe_text("name")
    base = df.select(
        "*", n.alias("_n"), F.length(n).alias("_len"),
        count_matches(n, "(?U)\\s").alias("_sp"), count_matches(n, "(?U)\\d").alias("_dg"),
        char_count(n, ASCII_LETTERS).alias("_al"), count_matches(n, f"[{CJK}]").alias("_zh"))
    t, ln = F.col("_n"), F.col("_len")
    sp, dg, al, zh = F.col("_sp"), F.col("_dg"), F.col("_al"), F.col("_zh")
    sym = ln - (sp + dg + al + zh)
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    s_dig = first.rlike("(?U)^\\d")
    s_alp = _is_ascii_letter(first)
    s_zh = (first >= F.lit(CJK_FIRST)) & (first <= F.lit(CJK_LAST))
    uniq = F.size(F.array_distinct(F.split(t, "")))
    uniq = F.when(ln > 0, uniq).otherwise(F.lit(0))

    def lit_count(ch: str) -> Column:
        return char_count(t, ch)

    return base.select(
        *df.columns,
        ln.alias("name_length"), (ln - sp).alias("char_no_space"), sp.alias("space_count"),
        dg.alias("digit_count"), al.alias("alpha_count"),
        char_count(t, UPPER).alias("alpha_upper_count"),
        char_count(t, LOWER).alias("alpha_lower_count"),
        zh.alias("chinese_count"), sym.alias("symbol_count"),
        char_count(t, "!?.,;:").alias("punctuation_count"),
        lit_count("!").alias("exclamation_count"), lit_count("?").alias("question_count"),
        lit_count("#").alias("hash_count"), lit_count("/").alias("slash_count"),
        lit_count("-").alias("dash_count"), lit_count("+").alias("plus_count"),
        lit_count("&").alias("ampersand_count"),
        ratio(dg, ln).alias("digit_ratio"), ratio(al, ln).alias("alpha_ratio"),
        ratio(zh, ln).alias("chinese_ratio"), ratio(sym, ln).alias("symbol_ratio"),
        s_dig.cast("int").alias("starts_with_digit"),
        s_alp.cast("int").alias("starts_with_alpha"),
        s_zh.cast("int").alias("starts_with_chinese"),
        (~(s_dig | s_alp | s_zh)).cast("int").alias("starts_with_symbol"),
        last.rlike("(?U)\\d$").cast("int").alias("ends_with_digit"),
        _is_ascii_letter(last).cast("int").alias("ends_with_alpha"),
        ((last >= F.lit(CJK_FIRST)) & (last <= F.lit(CJK_LAST))).cast("int")
        .alias("ends_with_chinese"),
        uniq.alias("unique_char_count"), ratio(uniq, ln).alias("unique_char_ratio"))


# --------------------------------------------------------------- J5 numbers
NUMBER_COLUMNS = [
    "number_count", "number_sum", "number_max", "number_min", "number_mean", "number_median",
    "number_std", "number_range", "number_log_sum", "number_decimal_count", "number_ge_1000",
    "number_year_count", "number_two_digit", "number_three_digit", "number_unique_count",
    "number_max_digit_len", "number_avg_digit_len", "number_density", "number_fraction_flag",
    "number_percentage_flag", "number_series_flag"]


def with_number_features(df: DataFrame) -> DataFrame:
    n = safe_text("name")
    s1 = df.select("*", n.alias("_n"),
                   F.regexp_extract_all(n, F.lit("(?U)" + L.NUMBER_PATTERN), 0).alias("_txt"))
    s2 = s1.select("*", _nums(F.col("_txt")).alias("_v"))
    s3 = s2.select("*", _mean(F.col("_v")).alias("_mean"),
                   F.transform("_txt", lambda x: F.length(F.replace(x, F.lit("."), F.lit(""))))
                   .alias("_dl"))
    v, txt, cnt = F.col("_v"), F.col("_txt"), F.size(F.col("_v"))
    has = cnt > 0
    mx = F.when(has, F.array_max(v)).otherwise(F.lit(0.0))
    mn = F.when(has, F.array_min(v)).otherwise(F.lit(0.0))
    dl = F.col("_dl")
    return s3.select(
        *df.columns,
        cnt.alias("number_count"), _sum(v).alias("number_sum"), mx.alias("number_max"),
        mn.alias("number_min"), F.col("_mean").alias("number_mean"),
        _median(v).alias("number_median"), _pop_std(v, F.col("_mean")).alias("number_std"),
        F.when(cnt >= 2, mx - mn).otherwise(F.lit(0.0)).alias("number_range"),
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.log1p(x)).alias("number_log_sum"),
        _count_if(txt, lambda x: F.contains(x, F.lit("."))).alias("number_decimal_count"),
        _count_if(v, lambda x: x >= 1000).alias("number_ge_1000"),
        _count_if(v, lambda x: (x >= 1900) & (x <= 2035)).alias("number_year_count"),
        _count_if(v, lambda x: (x >= 10) & (x < 100)).alias("number_two_digit"),
        _count_if(v, lambda x: (x >= 100) & (x < 1000)).alias("number_three_digit"),
        F.size(F.array_distinct(txt)).alias("number_unique_count"),
        F.when(has, F.array_max(dl)).otherwise(F.lit(0)).alias("number_max_digit_len"),
        F.when(has, F.aggregate(dl, F.lit(0.0), lambda a, x: a + x) / cnt)
        .otherwise(F.lit(0.0)).alias("number_avg_digit_len"),
        ratio(cnt, F.length("_n")).alias("number_density"),
        F.col("_n").rlike("(?U)\\d+/\\d+").cast("int").alias("number_fraction_flag"),
        F.contains(F.col("_n"), F.lit("%")).cast("int").alias("number_percentage_flag"),
        (cnt >= 3).cast("int").alias("number_series_flag"))


# --------------------------------------------------------------- J6 units
UNIT_FAMILIES = list(L.UNIT_PATTERNS)
MEASURES = (("dimension", "cm", L.DIMENSION_PATTERN, L.TO_CM),
            ("weight", "kg", L.WEIGHT_PATTERN, L.TO_KG),
            ("volume", "l", L.VOLUME_PATTERN, L.TO_LITRE))
UNIT_COLUMNS = (
    [c for f in UNIT_FAMILIES for c in (f"unit_{f}_count", f"unit_{f}_flag")]
    + ["unit_total_count", "unit_diversity"]
    + [c for m, u, _, _ in MEASURES for c in (
        (f"{m}_mean_{u}", f"{m}_max_{u}", f"{m}_min_{u}", f"{m}_std_{u}", f"{m}_count"))])


def _value_unit(x: Column) -> Column:
    v = F.regexp_extract(x, "(?U)^\\d+(?:\\.\\d+)?", 0)
    rest = x.substr(F.length(v) + 1, F.length(x))
    u = F.regexp_replace(rest, "(?U)^\\s", "")
    return F.struct(_num(v).alias("v"), u.alias("u"))


def _convert_chain(table: dict[str, tuple[float, float]]):
    def conv(p: Column) -> Column:
        v, u = p["v"], F.lower(p["u"])
        expr = None
        for unit, (mul, div) in table.items():
            e = v
            if mul != 1:
                e = e * F.lit(float(mul))
            if div != 1:
                e = e / F.lit(float(div))
            expr = F.when(u == unit, e) if expr is None else expr.when(u == unit, e)
        return expr.otherwise(v)
    return conv


def with_unit_features(df: DataFrame) -> DataFrame:
    n = safe_text("name")
    low = F.lower(n)
    counts = [keyword_count(F.col("_low"), [x.lower() for x in t]).cast("double").alias(f"_u_{f}")
              for f, t in L.UNIT_PATTERNS.items()]
    # one pass per measure over the name (whole matches); each short match is
    # then split into its greedy number and its unit after at most one space
    extracts = [F.regexp_extract_all(n, F.lit("(?iU)" + pat), 0).alias(f"_{m}_x")
                for m, _, pat, _ in MEASURES]
    s1 = df.select("*", low.alias("_low")).select(*df.columns, *counts, *extracts)
    conv = []
    for m, _, _, table in MEASURES:
        pairs = F.transform(f"_{m}_x", _value_unit)
        conv.append(F.transform(pairs, _convert_chain(table)).alias(f"_{m}"))
    s2 = s1.select("*", *conv)
    s3 = s2.select("*", *[_mean(F.col(f"_{m}")).alias(f"_{m}_mean") for m, _, _, _ in MEASURES])
    out = []
    for f in UNIT_FAMILIES:
        c = F.col(f"_u_{f}")
        out += [c.alias(f"unit_{f}_count"), (c > 0).cast("int").alias(f"unit_{f}_flag")]
    ucols = [F.col(f"_u_{f}") for f in UNIT_FAMILIES]
    out.append(sum(ucols[1:], ucols[0]).alias("unit_total_count"))
    flags = [(c > 0).cast("int") for c in ucols]
    out.append(sum(flags[1:], flags[0]).cast("double").alias("unit_diversity"))
    for m, u, _, _ in MEASURES:
        a = F.col(f"_{m}")
        has = F.size(a) > 0
        out += [
            F.col(f"_{m}_mean").alias(f"{m}_mean_{u}"),
            F.when(has, F.array_max(a)).otherwise(F.lit(0.0)).alias(f"{m}_max_{u}"),
            F.when(has, F.array_min(a)).otherwise(F.lit(0.0)).alias(f"{m}_min_{u}"),
            _pop_std(a, F.col(f"_{m}_mean")).alias(f"{m}_std_{u}"),
            F.size(a).cast("double").alias(f"{m}_count")]
    return s3.select(*df.columns, *out)


# --------------------------------------------------------------- J7 tokens
TOKEN_COLUMNS = [
    "token_count", "token_unique_count", "token_unique_ratio", "token_numeric_count",
    "token_alpha_count", "token_chinese_count", "token_avg_len", "token_max_len",
    "token_min_len", "first_token_hash", "last_token_hash", "second_token_hash",
    "uppercase_token_count", "uppercase_token_avg_len", "bundle_flag", "gift_flag",
    "limited_flag"]
TOKEN_HASH_COLUMNS = ["first_token_hash", "last_token_hash", "second_token_hash"]


def with_token_features(df: DataFrame) -> DataFrame:
    n = safe_text("name")
    s1 = df.select("*", n.alias("_n"),
                   F.regexp_extract_all(n, F.lit(QUICK_TOKEN), 0).alias("_t"),
                   F.regexp_extract_all(n, F.lit("[A-Z]{2,}"), 0).alias("_up"))
    s2 = s1.select("*", F.transform("_t", lambda x: F.length(x)).alias("_tl"))
    t, tl, up = F.col("_t"), F.col("_tl"), F.col("_up")
    cnt = F.size(t)
    has = cnt > 0
    uniq = F.size(F.array_distinct(t))
    low = F.transform(t, lambda x: F.lower(x))
    first = F.when(has, F.element_at(low, 1)).otherwise(F.lit(""))
    last = F.when(has, F.element_at(low, -1)).otherwise(F.lit(""))
    second = F.when(cnt > 1, F.element_at(low, 2)).otherwise(F.lit(""))
    nup = F.size(up)
    up_len = F.aggregate(up, F.lit(0.0), lambda a, x: a + F.length(x))
    return s2.select(
        *df.columns,
        cnt.alias("token_count"), uniq.alias("token_unique_count"),
        ratio(uniq, cnt).alias("token_unique_ratio"),
        _count_if(t, lambda x: x.rlike("(?U)^\\d+$")).alias("token_numeric_count"),
        _count_if(t, lambda x: x.rlike(f"^([A-Za-z]+|[{CJK}]+)$")).alias("token_alpha_count"),
        _count_if(t, lambda x: x.rlike(f"^[{CJK}]+$")).alias("token_chinese_count"),
        F.when(has, F.aggregate(tl, F.lit(0.0), lambda a, x: a + x) / cnt)
        .otherwise(F.lit(0.0)).alias("token_avg_len"),
        F.when(has, F.array_max(tl)).otherwise(F.lit(0)).alias("token_max_len"),
        F.when(has, F.array_min(tl)).otherwise(F.lit(0)).alias("token_min_len"),
        stable_hash(first).alias("first_token_hash"),
        stable_hash(last).alias("last_token_hash"),
        stable_hash(second).alias("second_token_hash"),
        nup.alias("uppercase_token_count"),
        F.when(nup > 0, up_len / nup).otherwise(F.lit(0.0)).alias("uppercase_token_avg_len"),
        keyword_flag(F.lower(F.col("_n")), [w.lower() for w in L.BUNDLE_WORDS]).alias("bundle_flag"),
        keyword_flag(F.lower(F.col("_n")), [w.lower() for w in L.GIFT_WORDS]).alias("gift_flag"),
        keyword_flag(F.lower(F.col("_n")), [w.lower() for w in L.LIMITED_WORDS])
        .alias("limited_flag"))


# --------------------------------------------------------------- J9 signals
def _families() -> list[tuple[str, dict[str, list[str]]]]:
    return [("gender", L.GENDER_KEYWORDS), ("age", L.AGE_KEYWORDS),
            ("season", L.SEASON_KEYWORDS), ("festival", L.FESTIVAL_KEYWORDS)]


SIGNAL_COLUMNS = (
    ["color_hit_count", "color_flag", "dominant_color", "import_flag", "discount_flag",
     "size_keyword_flag", "luxury_flag", "luxury_keyword_count", "model_code_flag",
     "hash_code_flag"]
    + [c for fam, groups in _families() for g in groups
       for c in (f"{fam}_{g}_count", f"{fam}_{g}_flag")])


def with_signal_features(df: DataFrame) -> DataFrame:
    n = safe_text("name")
    s1 = df.select("*", n.alias("_n"), F.lower(n).alias("_l"))
    t, low = F.col("_n"), F.col("_l")
    color = keyword_count(low, [c.lower() for c in L.COLOR_KEYWORDS]).cast("double")
    dominant = F.coalesce(*[F.when(F.contains(low, F.lit(c.lower())), F.lit(c))
                            for c in L.COLOR_KEYWORDS], F.lit("none"))
    lux = keyword_count(low, [c.lower() for c in L.LUXURY_KEYWORDS]).cast("double")
    out = [
        color.alias("color_hit_count"), (color > 0).cast("int").alias("color_flag"),
        dominant.alias("dominant_color"),
        keyword_flag(low, [w.lower() for w in L.IMPORT_KEYWORDS]).alias("import_flag"),
        keyword_flag(low, [w.lower() for w in L.DISCOUNT_KEYWORDS]).alias("discount_flag"),
        keyword_flag(low, [w.lower() for w in L.SIZE_KEYWORDS]).alias("size_keyword_flag"),
        (lux > 0).cast("int").alias("luxury_flag"), lux.alias("luxury_keyword_count"),
        has_match(t, "(?U)" + L.MODEL_CODE_PATTERN).alias("model_code_flag"),
        has_match(t, L.HASH_CODE_PATTERN).alias("hash_code_flag"),
    ]
    for fam, groups in _families():
        for g, terms in groups.items():
            c = keyword_count(low, [w.lower() for w in terms]).cast("double")
            out += [c.alias(f"{fam}_{g}_count"), (c > 0).cast("int").alias(f"{fam}_{g}_flag")]
    return s1.select(*df.columns, *out)


# --------------------------------------------------------------- J10 assemble
def with_all_features(df: DataFrame) -> DataFrame:
    """J4–J9 side by side (201 columns, 3 strings), nulls → 0.

    One narrow chain of projections over the same rows: no join, no shuffle.
    """
    from nameprice.functions.categories import with_category_features

    out = df
    for fam in (with_char_features, with_number_features, with_unit_features,
                with_token_features, with_category_features, with_signal_features):
        out = fam(out)
    names = all_feature_columns()
    numeric = [c for c in names if c not in STRING_FEATURES]
    return out.select(*df.columns, *names).fillna(0, subset=numeric)


STRING_FEATURES = ["primary_category", "secondary_category", "dominant_color"]


def all_feature_columns() -> list[str]:
    from nameprice.functions.categories import CATEGORY_COLUMNS

    return (CHAR_COLUMNS + NUMBER_COLUMNS + UNIT_COLUMNS + TOKEN_COLUMNS
            + list(CATEGORY_COLUMNS) + SIGNAL_COLUMNS)
