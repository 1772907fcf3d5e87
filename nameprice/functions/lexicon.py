"""Keyword lexicons and regex constants.

FIXED VALUES: the term lists and patterns below must stay exactly as they
are (content and order) for the features to equal the surveyed pipeline.
Order matters: matching is leftmost-first over the listed alternatives, and
`dominant_color` is the first colour in list order contained in the name.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
CATEGORY_KEYWORDS: dict[str, list[str]] = {
    "food_staple": ["米", "飯", "麵", "粽", "粥", "麥", "穀", "油"],
    "food_snack": ["餅", "糖", "餅乾", "零食", "巧克力", "堅果", "點心"],
    "food_dessert": ["蛋糕", "甜", "布丁", "派", "冰", "冰淇淋"],
    "drink": ["飲", "茶", "咖啡", "汁", "酒", "奶", "粉", "豆漿"],
    "beauty": ["面膜", "乳", "霜", "精華", "化妝", "美容", "保養", "洗髮"],
    "household": ["清潔", "洗衣", "垃圾", "衛生", "紙", "拖把", "掃把"],
    "kitchen": ["鍋", "盤", "碗", "筷", "餐具", "烤盤", "廚"],
    "furniture": ["沙發", "床", "椅", "桌", "櫃", "收納", "衣櫥"],
    "appliance": ["電鍋", "微波", "冰箱", "洗衣機", "冷氣", "烤箱", "吹風機"],
    "electronics": ["手機", "電腦", "筆電", "耳機", "音響", "充電", "USB", "Wifi", "攝影"],
    "stationery": ["筆", "紙", "筆記", "本", "書寫", "文具", "資料夾"],
    "pet": ["狗", "貓", "寵", "犬", "貓砂", "飼料", "貓狗"],
    "baby": ["嬰", "寶寶", "幼兒", "奶瓶", "尿布", "成長", "學習"],
    "clothing": ["衣", "褲", "裙", "外套", "鞋", "襪", "帽", "洋裝", "T恤"],
    "sport": ["球", "運動", "健身", "瑜伽", "登山", "跑步", "自行車"],
    "automotive": ["車", "汽車", "機車", "輪胎", "機油", "汽油", "車架"],
    "garden": ["花", "植", "園藝", "盆栽", "肥料", "土", "種子"],
    "hardware": ["螺絲", "工具", "五金", "刀", "剪", "鋸", "鉗"],
    "festival": ["春聯", "燈籠", "禮盒", "贈品", "節", "年", "中秋", "端午", "聖誕"],
    "health": ["保健", "維生素", "補充", "藥", "醫", "護", "血", "體重"],
    "finance": ["禮券", "禮卡", "儲值", "票券", "gift", "voucher"],
    "books": ["書", "漫畫", "雜誌", "小說", "教材"],
    "travel": ["行李", "旅行", "背包", "露營", "旅遊", "裝備"],
}

UNIT_PATTERNS: dict[str, list[str]] = {
    "weight": ["公斤", "kg", "公克", "克", "g", "mg", "磅", "斤"],
    "volume": ["毫升", "ml", "公升", "l", "cc", "oz"],
    "length": ["公分", "cm", "毫米", "mm", "公尺", "m", "inch", "吋"],
    "area": ["平方", "坪", "㎡", "m2"],
    "temperature": ["℃", "度c", "°c"],
    "quantity": ["入", "包", "盒", "瓶", "罐", "袋", "支", "顆", "台", "雙", "件", "片", "條", "組"],
    "currency": ["元", "nt$", "n.t", "$"],
}

COLOR_KEYWORDS: list[str] = [
    "紅", "橙", "黃", "綠", "藍", "紫", "黑", "白", "灰", "棕", "咖啡", "粉", "金", "銀",
    "red", "orange", "yellow", "green", "blue", "purple", "black", "white", "grey", "gray",
    "brown", "pink", "gold", "silver", "navy", "ivory",
]

GENDER_KEYWORDS: dict[str, list[str]] = {
    "female": ["女", "女性", "女生", "婦", "女士", "girl", "woman", "women", "ladies"],
    "male": ["男", "男性", "男生", "紳士", "男士", "boy", "man", "men", "gentleman"],
}

AGE_KEYWORDS: dict[str, list[str]] = {
    "baby": ["嬰", "幼兒", "寶寶", "新生", "幼"],
    "kids": ["童", "兒童", "小孩", "學童", "國小"],
    "teen": ["青少年", "teen"],
    "adult": ["成人", "大人"],
    "senior": ["銀髮", "長者", "老人", "高齡"],
}

SEASON_KEYWORDS: dict[str, list[str]] = {
    "spring": ["春", "spring"],
    "summer": ["夏", "summer"],
    "autumn": ["秋", "autumn"],
    "winter": ["冬", "winter"],
}

FESTIVAL_KEYWORDS: dict[str, list[str]] = {
    "chinese_new_year": ["新年", "過年", "春節"],
    "dragon_boat": ["端午", "龍舟", "粽"],
    "mid_autumn": ["中秋", "月餅"],
    "christmas": ["聖誕", "christmas"],
    "valentine": ["情人", "valentine", "七夕"],
}

SIZE_KEYWORDS: list[str] = ["XS", "S", "M", "L", "XL", "2L", "XXL", "3XL", "4XL", "5XL", "6XL"]
IMPORT_KEYWORDS: list[str] = ["日本", "韓國", "美國", "德國", "法國", "義大利", "進口", "原裝"]
DISCOUNT_KEYWORDS: list[str] = ["折", "SALE", "特價", "優惠", "買一送一", "送", "折扣"]
LUXURY_KEYWORDS: list[str] = [
    "鑽石", "戒指", "黃金", "金條", "金飾", "金器", "錶", "手錶", "腕錶", "名錶",
    "相機", "單眼", "鏡頭", "攝影機", "珠寶", "寶石", "首飾", "精品", "名牌", "奢華",
]

# token-structure keyword alternations (case-insensitive)
BUNDLE_WORDS: list[str] = ["組", "set", "套", "雙", "對"]
GIFT_WORDS: list[str] = ["禮", "贈", "gift", "present"]
LIMITED_WORDS: list[str] = ["限量", "限定", "首發", "獨家"]

# 31-feature keyword alternations
SET_WORDS: list[str] = ["組", "套裝", "set", "Set", "SET"]
LUXURY_WORDS_31: list[str] = ["豪華", "高級", "premium", "Premium"]

# regex constants (Java syntax; CJK block U+4E00..U+9FFF)
CJK = "\\x{4e00}-\\x{9fff}"
MODEL_CODE_PATTERN = "[A-Za-z]{1,4}-?\\d{2,}|\\d{2,}[A-Za-z]{1,4}"
HASH_CODE_PATTERN = "#[0-9A-Za-z\\-]+"
NUMBER_PATTERN = "\\d+(?:\\.\\d+)?"
DIMENSION_PATTERN = "(\\d+(?:\\.\\d+)?)\\s?(cm|公分|mm|毫米|m|公尺|inch|吋)"
WEIGHT_PATTERN = "(\\d+(?:\\.\\d+)?)\\s?(kg|公斤|g|公克|mg|磅|斤)"
VOLUME_PATTERN = "(\\d+(?:\\.\\d+)?)\\s?(ml|毫升|l|公升|cc|oz)"

# unit conversions as (multiplier, divisor): value * multiplier / divisor
TO_CM = {"cm": (1, 1), "公分": (1, 1), "mm": (1, 10), "毫米": (1, 10),
         "m": (100, 1), "公尺": (100, 1), "inch": (2.54, 1), "吋": (2.54, 1)}
TO_KG = {"kg": (1, 1), "公斤": (1, 1), "g": (1, 1000), "公克": (1, 1000),
         "mg": (1, 1000000), "磅": (0.453592, 1), "斤": (0.6, 1)}
TO_LITRE = {"l": (1, 1), "公升": (1, 1), "ml": (1, 1000), "毫升": (1, 1000),
            "cc": (1, 1000), "oz": (0.0295735, 1)}
# ------------------------------------------------------------ END FIXED VALUES

CATEGORY_NAMES: list[str] = list(CATEGORY_KEYWORDS)
OTHER_CATEGORY = "other"
OTHER_INDEX = len(CATEGORY_NAMES)  # 23


def java_alternation(terms: list[str], lower: bool = True) -> str:
    """Literal alternation (Java and RE2): each term quoted, listed order kept."""
    return "|".join("\\Q" + (t.lower() if lower else t) + "\\E" for t in terms)


def fast_alternation(terms: list[str], lower: bool = True) -> str:
    """Same matches as `java_alternation`, faster in Java's backtracking engine.

    A zero-width lookahead on the set of first characters rejects almost every
    start position with one class test before any branch is tried; when all
    terms are single characters the alternation is exactly a character class.
    Leftmost-first choice among the branches is unchanged.
    """
    ts = [t.lower() if lower else t for t in terms]
    firsts = sorted({t[0] for t in ts}, key=ord)
    cls = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in firsts) + "]"
    if all(len(t) == 1 for t in ts):
        return cls
    return f"(?={cls})(?:" + java_alternation(ts, lower=False) + ")"
