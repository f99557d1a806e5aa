"""Scalar functions as column expressions: text, phone, address, URL, number, geometry, hours and holidays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .kernels import address_kernel, jaro_winkler_udf, nfkc, to_fixed, web_url_udf

#: Inside a character class: what counts as white space (wider than Java's \s).
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_SYMBOLS = r"""[【】\[\]()（）<>「」『』'"`.,，、。!！?？:：;；~〜·・/\\|]"""
_NUMERAL = "[0-9一二三四五六七八九十]+"
_FIXED_SUFFIX = r"総本店|本店|支店|本館|別館|新館|駅前店|[東西南北]口店|[0-9]+号店"
_PLACE_SUFFIX = r"(?:駅前?|インター|通り?|[東西南北]口|モール)店"
_HINTS = "駅口通町市区郡県都府谷坂川前橋丘島北南東西"


def _quoted(words: Sequence[str]) -> str:
    return "|".join(r"\Q" + w + r"\E" for w in words)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def collapse_spaces(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, rf"[{WS}]+", " "))


def remove_symbols(c: Column) -> Column:
    return F.regexp_replace(c, _SYMBOLS, "")


def strip_corporate_words(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)株式会社|有限会社|合同会社|（株）|\(株\)|㈱|Inc\.?|LLC|Corp\.?", "")


def strip_business_words(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)" + _quoted(config.BUSINESS_WORDS), "")


def clean_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"[（(]([^）)]+店)[）)]\z", "$1")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: columns that a chain of conditions repeats would double with each step, past what
    generated code may hold. No UDF can be in body, and Spark can't pass the result to a UDF: names, addresses and numbers,
    which are, do without."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(suffix: str) -> str:
    """A pattern for what precedes a suffix (group 1), where the longest one leaves two characters at least; no match else."""
    return rf"(?!.{{0,1}}(?:{suffix})\z)(.{{2,}}?)(?:{suffix})"


#: The last step: the first of these that fits. Suffixes of the first two have 3 and 4 characters.
_LAST_SUFFIX = rf"(?s)^(?:(.{{2,}})(?:.[{_HINTS}]|丁目)店|(.{{2,}})(?:モール|プラザ|パーク)店|{_cut('[一-龠ァ-ヶー]{2,4}店')})\z"


def strip_branch_suffix(c: Column) -> Column:
    """The name without its branch: fixed suffixes, then places; never down to a single character.

    Each step is one replacement, so that its input occurs once: conditions that repeat it would double with every step.
    Names of less than four characters can't fit any.
    """
    s = clean_brackets(trim_ws(c))
    for suffix in (_FIXED_SUFFIX, _PLACE_SUFFIX):
        s = F.regexp_replace(s, rf"(?s)^{_cut(suffix)}\z", "$1")
    return F.regexp_replace(s, _LAST_SUFFIX, "$1$2$3")


def normalize_name(c: Column, remove_business_words: bool = False) -> Column:
    s = strip_branch_suffix(strip_corporate_words(F.lower(nfkc(text_or_empty(c)))))
    s = remove_symbols(F.regexp_replace(s, rf"[{WS}・\-]+", ""))
    shorter = F.regexp_replace(s, "本店|支店|号店|店|階|[Ff]", "")
    s = F.when(F.length(shorter) >= 2, shorter).otherwise(s)
    if remove_business_words:
        s = F.regexp_replace(strip_business_words(s), rf"[{WS}]+", "")
    return trim_ws(s)


def phone_digits(c: Column) -> Column:
    """ASCII digits if there are 10 or 11 of them, else empty."""
    return let(F.regexp_replace(c, "[^0-9]", ""), lambda digits: F.when(F.length(digits).isin(10, 11), digits).otherwise(""))


def normalize_phone(c: Column, fold: bool = True) -> Column:
    """fold: NFKC first; without it the whole function is native, for text that is ASCII anyway."""
    s = trim_ws(nfkc(text_or_empty(c)) if fold else text_or_empty(c))
    s = F.regexp_replace(s, rf"^\+81[{WS}\-]?", "0")
    return phone_digits(F.regexp_replace(s, rf"^0081[{WS}\-]?", "0"))


def strip_building(c: Column) -> Column:
    words = "(?:" + "|".join(config.BUILDING_WORDS) + ")"
    n = _NUMERAL
    s = F.regexp_replace(c, rf"(?i)[{WS}]*(?:{n}(?:F|階)|B{n}F?|地下{n}(?:階|F)?)[{WS}]*\z", "")
    s = F.regexp_replace(s, rf"(?i)[{WS}]+.*{words}.*\z", "")
    return F.regexp_replace(s, rf"(?i)(?<=[0-9])[{WS}]*[^0-9{WS}\-\u30FC\uFF0D\u2212\u2010\u2015]+{words}.*\z", "")


def address_steps(s: Column) -> Column:
    """What follows NFKC and numerals in `normalize_address`; native."""
    for pattern, to in ((r"[\u30FC\uFF0D\u2212\u2010\u2015]", "-"), ("([0-9]+)丁目", "$1-"), ("([0-9]+)番地?の?", "$1-"), ("([0-9]+)の([0-9]+)", "$1-$2"), ("([0-9]+)号", "$1"), ("-+", "-")):
        s = F.regexp_replace(s, pattern, to)
    s = remove_symbols(F.regexp_replace(strip_building(s), rf"[{WS}]", ""))
    return F.lower(F.regexp_replace(F.regexp_replace(s, "-+", "-"), r"^-|-\z", ""))


def normalize_address(c: Column, strip_prefecture: bool = False) -> Column:
    return F.when(trim_ws(text_or_empty(c)) == "", "").otherwise(address_steps(address_kernel(text_or_empty(c), strip_prefecture)))


_PLAIN_URL = r"^(https?)://([A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?)(:[0-9]{1,4})?((?:/[A-Za-z0-9_~!$&'()*+,;=:@%\-][A-Za-z0-9._~!$&'()*+,;=:@%\-]*)*/?)(?:[?#][\s\S]*)?\z"


def normalize_url(c: Column) -> Column:
    """Native for plain http(s) URLs; Arrow batches of the others only."""
    s = trim_ws(text_or_empty(c))
    lowered = F.concat(F.lower(F.regexp_extract(s, r"^([A-Za-z]+)(?=://)", 1)), F.regexp_replace(s, r"^[A-Za-z]+(?=://)", ""))
    read = let(lowered, lambda x: F.when(_is_plain(x), _plain_url(x)))
    # the condition is written out for the UDF, whose argument can't hold a lambda
    return F.coalesce(F.when(s == "", "").otherwise(read), web_url_udf(F.when((s != "") & ~_is_plain(lowered), s)))


def _is_plain(lowered: Column) -> Column:
    return lowered.rlike(_PLAIN_URL) & ~lowered.rlike(r"(?i)%2e|^[a-z]+://[0-9.x]+(?:[:/?#]|\z)")


def _plain_url(lowered: Column) -> Column:
    part = lambda i: F.regexp_extract(lowered, _PLAIN_URL, i)
    port = lambda scheme: let(F.regexp_replace(part(3), "^:0*([0-9]+)$", ":$1"), lambda p: F.when(((scheme == "http") & (p == ":80")) | ((scheme == "https") & (p == ":443")), "").otherwise(p))
    return let(part(1), lambda scheme: F.concat(scheme, F.lit("://"), F.lower(part(2)), port(scheme), F.regexp_replace(part(4), r"/\z", "")))


def safe_number(c: Column) -> Column:
    """A double if the whole text is a finite number, else null."""
    s = trim_ws(c.cast("string"))
    number = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), s.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


# --- Similarity, geometry, digests ----------------------------------------------------------------------------------
def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def best_name_similarity(a: Column, b: Column) -> Column:
    """The greater of Jaro-Winkler and Levenshtein similarity."""
    return F.greatest(jaro_winkler_udf(a, b), levenshtein_similarity(a, b))


def haversine_meters(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    rise, run = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    a = rise * rise + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * run * run
    return 2 * F.lit(6371000.0) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geo_cell(x: Column, scale: int = 2000) -> Column:
    """Index of the cell along one axis, rounding halves up."""
    return F.floor(x * scale + F.lit(0.5))


def store_id(name: Column, phone: Column, lat: Column, lng: Column) -> Column:
    six = lambda x: F.coalesce(to_fixed(x, 6), F.lit(""))
    return store_id_of(name, phone, six(lat), six(lng))


def store_id_of(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(text_or_empty(p) for p in parts))), 1, 20)


# --- Signals --------------------------------------------------------------------------------------------------------
def has_chain_url(url: Column) -> Column:
    return F.lower(text_or_empty(url)).rlike(_quoted(config.CHAIN_URL_PARTS))


def has_branch_suffix(raw_name: Column) -> Column:
    return let(trim_ws(text_or_empty(raw_name)), _ends_like_branch)


def _ends_like_branch(s: Column) -> Column:
    return s.rlike(rf"(?:{_FIXED_SUFFIX}|{_PLACE_SUFFIX})\z") | s.rlike(rf"(?:[{_HINTS}]|丁目|モール|プラザ|パーク)店\z")


def mall_text(name: Column, address: Column, fold: bool = True) -> Column:
    both = F.lower(F.concat(text_or_empty(name), F.lit(" "), text_or_empty(address)))
    return nfkc(both) if fold else both


def mall_pattern(text: Column, words: config.MallWords = config.MallWords()) -> Column:  # noqa: B008
    """The first word or facility that `text` (folded, lower case) holds; null if none."""
    import unicodedata

    def first(group: Sequence[str], prefix: str = "") -> Column:
        if not group:
            return F.lit(None).cast("string")
        listed = F.array(*(F.struct(F.lit(unicodedata.normalize("NFKC", w).lower()).alias("w"), F.lit(prefix + w).alias("said")) for w in group))
        any_of = _quoted([unicodedata.normalize("NFKC", w).lower() for w in group])
        # the alternation tells most texts apart in one scan; only hits look for which word comes first in the list
        return F.when(text.rlike(any_of), F.get(F.filter(listed, lambda x: text.contains(x["w"])), F.lit(0))["said"])

    floor = F.when(text.rlike("(?i)" + words.floor_pattern), first(words.floor_words, "floor_with_"))
    return F.coalesce(first(words.strict), floor, first(words.keywords), first(words.facilities))


def is_menu_source(source: Column) -> Column:
    return F.lower(text_or_empty(source)).rlike("rocket|ロケット|menu|メニュー")


def is_aeon_mall(name: Column, address: Column) -> Column:
    return let(mall_text(name, address, fold=False), lambda s: (s.contains("aeon") & s.contains("mall")) | (s.contains("イオン") & s.contains("モール")))


# --- Hours and holidays ---------------------------------------------------------------------------------------------
def format_holiday(c: Column) -> Column:
    return let(trim_ws(text_or_empty(c)), _holiday)


def _holiday(s: Column) -> Column:
    days = F.filter(F.array(*(F.when(s.contains(d), F.lit(f"{d}曜")) for d in config.WEEKDAYS)), lambda x: x.isNotNull())
    return F.when(s == "", "なし").when(s.contains("不定休"), "不定休").when(s.contains("無休") | s.contains("なし"), "なし").when(F.size(days) > 0, F.array_join(days, ", ")).otherwise(s)


_TIMES = r"([0-9]{1,2}:[0-9]{2}〜[0-9]{1,2}:[0-9]{2})"


def format_hours(c: Column) -> Column:
    cleaned = trim_ws(text_or_empty(c))
    for pattern, to in (("：", ":"), ("[～〜–－-]+", "〜"), (rf"[{WS}]+", " "), (r"[（(][^）)]*[）)]", "")):
        cleaned = F.regexp_replace(cleaned, pattern, to)
    return F.when(trim_ws(text_or_empty(c)) == "", "").otherwise(let(cleaned, _hours))


def _hours(s: Column) -> Column:
    groups = "(" + "|".join(config.DAY_GROUPS) + ")"
    times = F.regexp_extract_all(s, F.lit(_TIMES), 1)
    parts = F.filter(F.transform(F.split(s, "(?=[月土平祝金日曜])|(?=[A-Za-z]+:)"), trim_ws), lambda x: x.rlike(_TIMES))
    day = lambda x: F.when(x.rlike(groups), F.regexp_extract(x, groups, 1)).otherwise("全日")
    block = lambda x: F.concat(day(x), F.lit("："), F.array_join(F.regexp_extract_all(x, F.lit(_TIMES), 1), " / "))
    listed = let(F.transform(parts, block), lambda b: F.when(F.size(b) > 0, F.array_join(b, "\n")).otherwise(s))
    return let(times, lambda t: F.when((F.size(t) > 0) & ~s.rlike(groups), F.concat(F.lit("全日："), F.array_join(t, " / "))).otherwise(listed))
