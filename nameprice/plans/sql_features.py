"""DuckDB oracle SQL for the feature families (§2.J), written column by column.

RE2 has ASCII \\d/\\s and no lookarounds: the fixture names are ASCII + CJK,
and lookarounds are rewritten as consuming classes (equivalent for `contains`).
DuckDB has no crc32: `crc32_sql` computes it from the UTF-8 bytes with the
reflected 0xEDB88320 table, built by its defining rule.
"""

from __future__ import annotations

from nameprice.functions import lexicon as L
from nameprice.functions.lexicon import CJK, java_alternation
from nameprice.plans.sql_fragments import sql_str

QUICK_TOKEN_RE2 = f"[A-Za-z]+|\\d+(?:\\.\\d+)?|[{CJK}]+"


def rc(pattern: str, text: str = "n") -> str:
    return f"len(regexp_extract_all({text}, {sql_str(pattern)}))"


def rm(pattern: str, text: str = "n") -> str:
    return f"regexp_matches({text}, {sql_str(pattern)})"


def guard_ratio(num: str, den: str) -> str:
    return f"case when {den} > 0 then cast({num} as double) / {den} else 0.0 end"


def cols(spec: list[tuple[str, str, str]]) -> str:
    return ",\n  ".join(f"cast({expr} as {typ}) as {name}" for name, expr, typ in spec)


BASE = "b as (select product_id, coalesce(name, '') as n from products)"


# ---------------------------------------------------------------- crc32
def _utf8_bytes(s: str) -> str:
    u = "unicode(ch)"
    return (f"flatten(list_transform(string_split({s}, ''), lambda ch: case "
            f"when {u} < 128 then [{u}] "
            f"when {u} < 2048 then [192 | ({u} >> 6), 128 | ({u} & 63)] "
            f"when {u} < 65536 then [224 | ({u} >> 12), 128 | (({u} >> 6) & 63), 128 | ({u} & 63)] "
            f"else [240 | ({u} >> 18), 128 | (({u} >> 12) & 63), 128 | (({u} >> 6) & 63), "
            f"128 | ({u} & 63)] end))")


CRC_TABLE_CTE = ("crc as (select list_transform(range(256), lambda n: list_reduce(range(8), "
                 "lambda c, k: case when (c & 1) = 1 then xor(3988292384, c >> 1) else c >> 1 end, "
                 "n::bigint)) as tbl)")


def crc32_sql(s: str, tbl: str = "crc.tbl") -> str:
    return (f"case when coalesce({s}, '') = '' then 0 else xor(list_reduce({_utf8_bytes(s)}, "
            f"lambda c, x: xor({tbl}[(xor(c, x::bigint) & 255) + 1], c >> 8), "
            f"4294967295::bigint), 4294967295) end")


# ---------------------------------------------------------------- J1 / J2 / J3
INTS = "list_transform(regexp_extract_all(n, '\\d+'), lambda x: cast(x as double))"


def basic5_sql() -> str:
    spec = [("num_count", "len(v)", "int"),
            ("max_number", "coalesce(list_max(v), 0.0)", "double"),
            ("min_number", "coalesce(list_min(v), 0.0)", "double"),
            ("sum_numbers", "coalesce(list_sum(v), 0.0)", "double"),
            ("avg_number", "case when len(v) > 0 then list_sum(v) / len(v) else 0.0 end", "double")]
    return (f"with {BASE}, x as (select product_id, n, {INTS} as v from b) "
            f"select product_id, {cols(spec)} from x")


WORD_COUNT = "len(list_filter(string_split_regex(trim(n), '\\s+'), lambda w: w <> ''))"


def basic11_sql() -> str:
    spec = [("num_count", "len(v)", "int"),
            ("max_num", "coalesce(list_max(v), 0.0)", "double"),
            ("sum_num", "coalesce(list_sum(v), 0.0)", "double"),
            ("name_length", "length(n)", "int"),
            ("word_count", WORD_COUNT, "int"),
            ("has_english", rm("[a-zA-Z]"), "int"),
            ("has_chinese", rm(f"[{CJK}]"), "int"),
            ("has_number", rm("\\d"), "int"),
            ("has_brand", rm("[A-Z]{2,}"), "int"),
            ("has_parenthesis", rm("[()]"), "int"),
            ("has_bracket", rm("[\\[\\]]"), "int")]
    return (f"with {BASE}, x as (select product_id, n, {INTS} as v from b) "
            f"select product_id, {cols(spec)} from x")


def basic31_sql() -> str:
    spec = [("name_length", "length(n)", "int"),
            ("word_count", WORD_COUNT, "int"),
            ("char_count", "length(replace(n, ' ', ''))", "int"),
            ("num_count", "len(v)", "int"),
            ("max_num", "coalesce(list_max(v), 0.0)", "double"),
            ("min_num", "coalesce(list_min(v), 0.0)", "double"),
            ("sum_num", "coalesce(list_sum(v), 0.0)", "double"),
            ("mean_num", "case when len(v) > 0 then list_sum(v) / len(v) else 0.0 end", "double"),
            ("first_num", "case when len(v) > 0 then v[1] else 0.0 end", "double"),
            ("has_english", rm("[a-zA-Z]"), "int"),
            ("has_chinese", rm(f"[{CJK}]"), "int"),
            ("has_number", rm("\\d"), "int"),
            ("english_count", rc("[a-zA-Z]"), "int"),
            ("chinese_count", rc(f"[{CJK}]"), "int"),
            ("has_parenthesis", rm("[()]"), "int"),
            ("has_bracket", rm("[\\[\\]]"), "int"),
            ("has_dash", "contains(n, '-')", "int"),
            ("has_slash", "contains(n, '/')", "int"),
            ("has_asterisk", "contains(n, '*')", "int"),
            ("special_char_count", rc("[^\\p{L}\\p{N}_\\s]"), "int"),
            ("has_brand", rm("[A-Z]{2,}"), "int"),
            ("uppercase_count", rc("\\p{Lu}"), "int"),
            ("has_kg", rm("kg|KG|公斤"), "int"),
            ("has_g", f"{rm('(^|[^0-9])g($|[^0-9])')} or contains(n, '克')", "int"),
            ("has_ml", rm("ml|ML|毫升"), "int"),
            ("has_l", f"{rm('(^|[^0-9])[Ll]($|[^0-9])')} or contains(n, '公升')", "int"),
            ("has_cm", rm("cm|CM|公分"), "int"),
            ("has_inch", rm("inch|吋"), "int"),
            ("has_pack", rm("包|入|組|盒"), "int"),
            ("has_set", rm(java_alternation(L.SET_WORDS, lower=False)), "int"),
            ("has_luxury", rm(java_alternation(L.LUXURY_WORDS_31, lower=False)), "int")]
    return (f"with {BASE}, x as (select product_id, n, {INTS} as v from b) "
            f"select product_id, {cols(spec)} from x")


# ---------------------------------------------------------------- J4 chars
def char_spec() -> list[tuple[str, str, str]]:
    sp, dg, al, zh = rc("\\s"), rc("\\d"), rc("[A-Za-z]"), rc(f"[{CJK}]")
    sym = f"(length(n) - ({sp} + {dg} + {al} + {zh}))"
    first, last = "substring(n, 1, 1)", "right(n, 1)"
    sd, sa, sz = rm("^\\d", first), rm("^[A-Za-z]", first), rm(f"^[{CJK}]", first)
    uniq = "case when length(n) > 0 then len(list_distinct(string_split(n, ''))) else 0 end"

    def lit(ch: str) -> str:
        return rc("\\Q" + ch + "\\E")

    return [
        ("name_length", "length(n)", "int"), ("char_no_space", f"length(n) - {sp}", "int"),
        ("space_count", sp, "int"), ("digit_count", dg, "int"), ("alpha_count", al, "int"),
        ("alpha_upper_count", rc("[A-Z]"), "int"), ("alpha_lower_count", rc("[a-z]"), "int"),
        ("chinese_count", zh, "int"), ("symbol_count", sym, "int"),
        ("punctuation_count", rc("[!?.,;:]"), "int"),
        ("exclamation_count", lit("!"), "int"), ("question_count", lit("?"), "int"),
        ("hash_count", lit("#"), "int"), ("slash_count", lit("/"), "int"),
        ("dash_count", lit("-"), "int"), ("plus_count", lit("+"), "int"),
        ("ampersand_count", lit("&"), "int"),
        ("digit_ratio", guard_ratio(dg, "length(n)"), "double"),
        ("alpha_ratio", guard_ratio(al, "length(n)"), "double"),
        ("chinese_ratio", guard_ratio(zh, "length(n)"), "double"),
        ("symbol_ratio", guard_ratio(sym, "length(n)"), "double"),
        ("starts_with_digit", sd, "int"), ("starts_with_alpha", sa, "int"),
        ("starts_with_chinese", sz, "int"),
        ("starts_with_symbol", f"not ({sd} or {sa} or {sz})", "int"),
        ("ends_with_digit", rm("\\d$", last), "int"),
        ("ends_with_alpha", rm("[A-Za-z]$", last), "int"),
        ("ends_with_chinese", rm(f"[{CJK}]$", last), "int"),
        ("unique_char_count", uniq, "int"),
        ("unique_char_ratio", guard_ratio(uniq, "length(n)"), "double")]


def chars_sql() -> str:
    return f"with {BASE} select product_id, {cols(char_spec())} from b"


# ---------------------------------------------------------------- J5 numbers
NUMBER_CTE = ("nb as (select product_id, n, t, list_transform(t, lambda x: cast(x as double)) as v "
              "from (select product_id, n, regexp_extract_all(n, '\\d+(?:\\.\\d+)?') as t from b) q)")


def number_spec() -> list[tuple[str, str, str]]:
    dl = "list_transform(t, lambda x: length(replace(x, '.', '')))"
    mean = "(case when len(v) > 0 then list_sum(v) / len(v) else 0.0 end)"
    return [
        ("number_count", "len(v)", "int"),
        ("number_sum", "coalesce(list_sum(v), 0.0)", "double"),
        ("number_max", "coalesce(list_max(v), 0.0)", "double"),
        ("number_min", "coalesce(list_min(v), 0.0)", "double"),
        ("number_mean", mean, "double"),
        ("number_median", "case when len(v) > 0 then list_median(v) else 0.0 end", "double"),
        ("number_std", "case when len(v) > 1 then sqrt(list_aggregate(v, 'var_pop')) else 0.0 end",
         "double"),
        ("number_range", "case when len(v) >= 2 then list_max(v) - list_min(v) else 0.0 end",
         "double"),
        ("number_log_sum", "coalesce(list_sum(list_transform(v, lambda x: ln(1 + x))), 0.0)",
         "double"),
        ("number_decimal_count", "len(list_filter(t, lambda x: contains(x, '.')))", "int"),
        ("number_ge_1000", "len(list_filter(v, lambda x: x >= 1000))", "int"),
        ("number_year_count", "len(list_filter(v, lambda x: x >= 1900 and x <= 2035))", "int"),
        ("number_two_digit", "len(list_filter(v, lambda x: x >= 10 and x < 100))", "int"),
        ("number_three_digit", "len(list_filter(v, lambda x: x >= 100 and x < 1000))", "int"),
        ("number_unique_count", "len(list_distinct(t))", "int"),
        ("number_max_digit_len", f"case when len(t) > 0 then list_max({dl}) else 0 end", "int"),
        ("number_avg_digit_len", f"case when len(t) > 0 then list_sum({dl}) / len(t) else 0.0 end",
         "double"),
        ("number_density", guard_ratio("len(t)", "length(n)"), "double"),
        ("number_fraction_flag", rm("\\d+/\\d+"), "int"),
        ("number_percentage_flag", "contains(n, '%')", "int"),
        ("number_series_flag", "len(t) >= 3", "int")]


def numbers_sql() -> str:
    return f"with {BASE}, {NUMBER_CTE} select product_id, {cols(number_spec())} from nb"


# ---------------------------------------------------------------- J6 units
MEASURES = (("dimension", "cm", L.DIMENSION_PATTERN, L.TO_CM),
            ("weight", "kg", L.WEIGHT_PATTERN, L.TO_KG),
            ("volume", "l", L.VOLUME_PATTERN, L.TO_LITRE))


def _conv_case(vals: str, units: str, table) -> str:
    v = f"cast({vals}[i] as double)"
    arms = []
    for unit, (mul, div) in table.items():
        e = v
        if mul != 1:
            e = f"{e} * cast({float(mul)!r} as double)"
        if div != 1:
            e = f"{e} / cast({float(div)!r} as double)"
        arms.append(f"when lower({units}[i]) = {sql_str(unit)} then {e}")
    return (f"list_transform(range(1, len({vals}) + 1), lambda i: case {' '.join(arms)} "
            f"else {v} end)")


def units_sql() -> str:
    ext = []
    for m, _, pat, table in MEASURES:
        p = sql_str("(?i)" + pat)
        vals, units = f"regexp_extract_all(n, {p}, 1)", f"regexp_extract_all(n, {p}, 2)"
        ext.append(f"{_conv_case(vals, units, table)} as {m}")
    ucount = {f: f"cast({rc(java_alternation(t), 'lower(n)')} as double)"
              for f, t in L.UNIT_PATTERNS.items()}
    spec = []
    for f in L.UNIT_PATTERNS:
        spec += [(f"unit_{f}_count", ucount[f], "double"),
                 (f"unit_{f}_flag", f"{ucount[f]} > 0", "int")]
    spec.append(("unit_total_count", " + ".join(ucount.values()), "double"))
    spec.append(("unit_diversity",
                 " + ".join(f"cast({c} > 0 as int)" for c in ucount.values()), "double"))
    for m, u, _, _ in MEASURES:
        mean = f"(case when len({m}) > 0 then list_sum({m}) / len({m}) else 0.0 end)"
        spec += [
            (f"{m}_mean_{u}", mean, "double"),
            (f"{m}_max_{u}", f"coalesce(list_max({m}), 0.0)", "double"),
            (f"{m}_min_{u}", f"coalesce(list_min({m}), 0.0)", "double"),
            (f"{m}_std_{u}", f"case when len({m}) > 1 then sqrt(list_aggregate({m}, 'var_pop')) "
                             f"else 0.0 end", "double"),
            (f"{m}_count", f"len({m})", "double")]
    return (f"with {BASE}, ub as (select product_id, n, {', '.join(ext)} from b) "
            f"select product_id, {cols(spec)} from ub")


# ---------------------------------------------------------------- J7 tokens
TOKEN_CTE = (f"tb as (select product_id, n, regexp_extract_all(n, {sql_str(QUICK_TOKEN_RE2)}) as t, "
             "regexp_extract_all(n, '[A-Z]{2,}') as up from b)")


def token_spec(with_hash: bool) -> list[tuple[str, str, str]]:
    tl = "list_transform(t, lambda x: length(x))"
    spec = [
        ("token_count", "len(t)", "int"),
        ("token_unique_count", "len(list_distinct(t))", "int"),
        ("token_unique_ratio", guard_ratio("len(list_distinct(t))", "len(t)"), "double"),
        ("token_numeric_count",
         "len(list_filter(t, lambda x: regexp_full_match(x, '[0-9]+')))", "int"),
        ("token_alpha_count",
         f"len(list_filter(t, lambda x: regexp_full_match(x, '[A-Za-z]+|[{CJK}]+')))", "int"),
        ("token_chinese_count",
         f"len(list_filter(t, lambda x: regexp_full_match(x, '[{CJK}]+')))", "int"),
        ("token_avg_len", f"case when len(t) > 0 then list_sum({tl}) / len(t) else 0.0 end",
         "double"),
        ("token_max_len", f"case when len(t) > 0 then list_max({tl}) else 0 end", "int"),
        ("token_min_len", f"case when len(t) > 0 then list_min({tl}) else 0 end", "int")]
    if with_hash:
        spec += [
            ("first_token_hash",
             f"({crc32_sql('case when len(t) > 0 then lower(t[1]) else null end')}) % 2048", "int"),
            ("last_token_hash",
             f"({crc32_sql('case when len(t) > 0 then lower(t[len(t)]) else null end')}) % 2048",
             "int"),
            ("second_token_hash",
             f"({crc32_sql('case when len(t) > 1 then lower(t[2]) else null end')}) % 2048", "int")]
    spec += [
        ("uppercase_token_count", "len(up)", "int"),
        ("uppercase_token_avg_len",
         "case when len(up) > 0 then list_sum(list_transform(up, lambda x: length(x))) / len(up) "
         "else 0.0 end", "double"),
        ("bundle_flag", rm("(?i)" + java_alternation(L.BUNDLE_WORDS)), "int"),
        ("gift_flag", rm("(?i)" + java_alternation(L.GIFT_WORDS)), "int"),
        ("limited_flag", rm("(?i)" + java_alternation(L.LIMITED_WORDS)), "int")]
    return spec


def tokens_sql(with_hash: bool = True) -> str:
    crc = f", {CRC_TABLE_CTE}" if with_hash else ""
    join = " join crc on true" if with_hash else ""
    return (f"with {BASE}, {TOKEN_CTE}{crc} select product_id, {cols(token_spec(with_hash))} "
            f"from tb{join}")


# ---------------------------------------------------------------- J9 signals
def signal_spec() -> list[tuple[str, str, str]]:
    low = "lower(n)"
    color = f"cast({rc(java_alternation(L.COLOR_KEYWORDS), low)} as double)"
    dominant = ("case " + " ".join(f"when contains({low}, {sql_str(c.lower())}) then {sql_str(c)}"
                                   for c in L.COLOR_KEYWORDS) + " else 'none' end")
    lux = f"cast({rc(java_alternation(L.LUXURY_KEYWORDS), low)} as double)"
    spec = [
        ("color_hit_count", color, "double"), ("color_flag", f"{color} > 0", "int"),
        ("dominant_color", dominant, "varchar"),
        ("import_flag", rm(java_alternation(L.IMPORT_KEYWORDS), low), "int"),
        ("discount_flag", rm(java_alternation(L.DISCOUNT_KEYWORDS), low), "int"),
        ("size_keyword_flag", rm(java_alternation(L.SIZE_KEYWORDS), low), "int"),
        ("luxury_flag", f"{lux} > 0", "int"), ("luxury_keyword_count", lux, "double"),
        ("model_code_flag", rm(L.MODEL_CODE_PATTERN), "int"),
        ("hash_code_flag", rm(L.HASH_CODE_PATTERN), "int")]
    for fam, groups in (("gender", L.GENDER_KEYWORDS), ("age", L.AGE_KEYWORDS),
                        ("season", L.SEASON_KEYWORDS), ("festival", L.FESTIVAL_KEYWORDS)):
        for g, terms in groups.items():
            c = f"cast({rc(java_alternation(terms), low)} as double)"
            spec += [(f"{fam}_{g}_count", c, "double"), (f"{fam}_{g}_flag", f"{c} > 0", "int")]
    return spec


def signals_sql() -> str:
    return f"with {BASE} select product_id, {cols(signal_spec())} from b"


def double_columns(spec: list[tuple[str, str, str]]) -> list[str]:
    return [name for name, _, typ in spec if typ == "double"]
