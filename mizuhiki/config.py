"""Dictionaries, weights and options. Everything here can be replaced by the caller."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: source ranks, word lists and column aliases that results depend on -----------------------------
SOURCE_RANK = {"google": 300, "tabelog": 200, "hotpepper": 100}
SOURCE_MARKS = (("google", ("google",)), ("tabelog", ("tabelog", "食べログ")), ("hotpepper", ("hotpepper", "ホットペッパー")))

GENERIC_CHAIN_WORDS = ("酒場", "食堂", "居酒屋", "焼肉", "焼鳥", "焼き鳥", "cafe", "カフェ", "喫茶", "bar", "バー", "レストラン", "ダイニング")
BUSINESS_WORDS = (
    "居酒屋", "焼肉", "焼鳥", "焼き鳥", "串焼き", "カフェ", "cafe", "coffee", "喫茶", "レストラン",
    "ダイニング", "bar", "バー", "ラーメン", "中華", "寿司", "鮨", "イタリアン", "フレンチ", "ビストロ",
)
BUILDING_WORDS = ("ビル", "bldg", "building", "マンション", "ハイツ", "コーポ", "タワー", "アパート", "コート", "レジデンス", "メゾン", "プラザ")
CHAIN_URL_PARTS = ("/company/", "/shop/", "/brand/", "/store/", "/chain/")
REVIEW_COLUMNS = ("review_count", "reviews", "reviews_count", "rating_count", "口コミ数", "クチコミ数", "reviewCount")

#: Canonical field: columns that may hold it, best first.
ALIASES = {
    "name": ("name", "店舗名", "店名", "restaurant_name"),
    "address": ("address", "住所", "所在地"),
    "phone": ("phone", "電話番号", "電話", "tel"),
    "lat": ("lat", "latitude", "緯度"),
    "lng": ("lng", "lon", "longitude", "経度"),
    "url": ("url", "URL", "店舗URL", "store_url"),
    "area": ("area", "region", "prefecture", "city", "エリア", "地域", "市区町村", "都道府県"),
    "category": ("category", "genre", "type", "カテゴリ", "ジャンル", "業種"),
    "business_hours": ("businessHours", "営業時間", "営業日", "opening_hours", "open_hours", "hours"),
    "regular_holiday": ("regularHoliday", "定休日", "定期休日", "regular_holiday", "holiday", "closed_days"),
}
#: What comes before ALIASES in records of a source.
SOURCE_ALIASES = {
    "tabelog": {"category": ("genre",), "business_hours": ("raw_business_hours",), "regular_holiday": ("raw_business_hours",)},
    "hotpepper": {"category": ("genre",), "business_hours": ("raw_business_hours",), "regular_holiday": ("raw_business_hours",)},
    "google": {"category": ("genre",), "business_hours": ("opening_hours_details",), "regular_holiday": ("regular_holiday",)},
}
#: Columns that name the platform, best first.
PLATFORM_COLUMNS = ("source", "媒体", "媒体名", "site", "platform")

MALL_STRICT_WORDS = (
    "parco", "パルコ", "マルイ", "ルミネ", "アトレ", "アトレヴィ", "高島屋", "そごう", "東急", "西武", "opa", "ミロード", "駅ビル", "地下街",
    "ららぽーと", "ミッドタウン", "ヒカリエ", "スクランブルスクエア", "コレド", "テラスモール", "ゆめタウン", "アリオ", "モレラ", "コクーン", "大丸", "三越",
    "伊勢丹", "ラクーン", "ショッピングモール", "エキア", "ビーンズ", "エソラ", "イオンモール", "イオンスタイル", "aeon mall", "aeonmall",
)
MALL_FLOOR_PATTERN = r"(?:[0-9一二三四五六七八九十]+F|[0-9一二三四五六七八九十]+階|B[0-9一二三四五六七八九十]+|地下[0-9一二三四五六七八九十]+階|地下[0-9一二三四五六七八九十]+F?)"
MALL_FLOOR_WORDS = (
    "モール", "プラザ", "アリオ", "アトレ", "ルミネ", "パルコ", "イオン", "東急", "西武", "マルイ", "百貨店", "デパート", "スクエア", "ヒルズ", "ウォーク",
    "ポート", "テラス", "ゲート", "コレド", "キャナル", "フォーラム", "ショッピングセンター", "そごう", "高島屋", "大丸", "三越", "伊勢丹", "コクーン",
    "ラクーン",
)
MALL_KEYWORDS = (
    "イオンモール", "aeonmall", "ららぽーと", "lalaport", "アリオ", "ario", "テラスモール", "terracemall", "ゆめタウン", "youmetown",
    "メイカーズピア", "makerspier", "ヒルサイドモール", "hillsidemall", "トレッサ", "tressa", "ワンダーシティ", "wondercity", "mozo",
    "モゾ", "マーケットプレース", "marketplace", "有明ガーデン", "ariakegarden", "ヒルズウォーク", "hillswalk", "サンシャインワーフ",
    "sunshinewharf", "フェスティバルマーケット", "festivalmarket", "ラグーナ", "laguna", "bino", "ビーノ", "パークプレイス",
    "parkplace", "モザイクモール", "mosaicmall", "ピオニウォーク", "イクスピアリ", "ikspiari", "キューズモール", "qsmall", "リバーウォーク",
    "riverwalk", "ルミネ", "lumine", "アトレ", "atre", "シャポー", "shapo", "ペリエ", "perie", "ラスカ", "lusca", "エキュート",
    "ecute", "グランスタ", "gransta", "セレオ", "celeo", "エスパル", "アミュプラザ", "amuplaza", "ルクア", "lucua", "なんばパークス",
    "nambaparks", "グランベリーパーク", "grandberrypark", "東急スクエア", "tokyusquare", "なんばcity", "nambacity", "阪急三番街",
    "ホワイティうめだ", "なんばウォーク", "アウトレット", "outlet", "三井アウトレット", "プレミアムアウトレット", "premiumoutlet", "ショッピングセンター",
)
MALL_FACILITIES = (
    "三井ショッピングパーク ららぽーと和泉", "三井ショッピングパーク ららぽーと立川立飛", "錦ケ丘ヒルサイドモール", "トレッサ横浜", "アーバンドック ららぽーと豊洲", "テラスモール湘南",
    "三井ショッピングパーク ららぽーと柏の葉", "mozo ワンダーシティ", "三井ショッピングパーク ららぽーと名古屋みなとアクルス", "イオンモール橿原", "アリオ亀有",
    "三井ショッピングパーク ららぽーと富士見", "三井ショッピングパーク ららぽーとEXPOCITY", "イオンモール堺鉄砲町", "天保山マーケットプレース", "有明ガーデン",
    "三井ショッピングパーク ららぽーと横浜", "三井ショッピングパーク ららぽーと安城", "イオンモールつくば", "イオンモール太田", "ヒルズウォーク徳重ガーデンズ", "サンシャインワーフ神戸",
    "ラグーナフェスティバルマーケット", "三井ショッピングパーク ららぽーと湘南平塚", "イオンモール新利府", "三井ショッピングパーク ららぽーと海老名", "イオンモール四條畷", "モレラ岐阜",
    "三井ショッピングパーク ららぽーと新三郷", "イオンモール幕張新都心", "イオンモール福岡", "三井ショッピングパーク ららぽーとTOKYO-BAY", "光が丘IMA", "パークプレイス大分",
    "モザイクモール港北", "イオンモール神戸南", "イオンモール岡崎", "イオンモール岡山", "ピオニウォーク東松山", "イクスピアリ", "イオンモール大和郡山", "イオンモール水戸内原",
    "ゆめタウン高松", "イオンモール堺北花田", "岸和田カンカンベイサイドモール", "イオンモール日の出", "イオンモール茨木", "イオンモール和歌山", "イオンモール川口前川", "アリオ蘇我",
    "あべのキューズモール", "三井ショッピングパークららぽーと甲子園", "イオンモールりんくう泉南", "リバーウォーク北九州", "イオンモール筑紫野", "三井アウトレットパーク",
    "プレミアム・アウトレット", "軽井沢プリンスショッピングプラザ", "那須ガーデンアウトレット", "沖縄アウトレットモールあしびなー", "千歳アウトレットモール・レラ", "レイクタウンアウトレット",
    "コクーンシティ", "コクーン新都心",
)

WEEKDAYS = ("月", "火", "水", "木", "金", "土", "日")
DAY_GROUPS = ("月〜金", "土日祝", "平日", "土日", "祝日", "月〜木", "金土日", "月", "火", "水", "木", "金", "土", "日", "祝前日", "祝")
FIELD_PRIORITY = {
    "phone": ("google", "tabelog", "hotpepper"),
    "regular_holiday": ("google", "tabelog", "hotpepper"),
    "address": ("google", "tabelog", "hotpepper"),
    "url": ("google", "tabelog", "hotpepper"),
    "name": ("google", "tabelog", "hotpepper"),
    "business_hours": ("tabelog", "hotpepper", "google"),
    "category": ("tabelog", "hotpepper", "google"),
}
RESERVED_EXPORT_COLUMNS = ("normalized_name", "normalized_address", "duplicate_score", "chain_flag", "mall_flag", "exclude_reason")
#: Of a download's name: where the input's name is broken up (inside a character class), and words whose parts are left out.
FILE_NAME_BREAKS = r"\s_　!！|｜\-"
FILE_NAME_IGNORED = ("google", "tabelog", "hotpepper", "食べログ", "ホットペッパー", "グーグルマップ", "マップ", "map", "の予約・クーポン")


@dataclass(frozen=True)
class DuplicateScoring:
    phone_match: int = 100
    name_address_exact: int = 90
    similarity_match: int = 80
    url_match: int = 70
    distance_match: int = 50
    name_similarity: float = 0.85
    address_similarity: float = 0.80
    distance_meters: float = 80.0
    phone_name_guard: float = 0.5
    distance_name_similarity: float = 0.75


@dataclass(frozen=True)
class ChainScoring:
    exact_match: int = 70
    partial_match: int = 65
    similar_match: int = 40
    similarity: float = 0.94
    url_pattern: int = 20
    occurrence: int = 30
    name_suffix: int = 10
    high_review: int = 20
    medium_review: int = 10
    high_review_from: int = 500
    medium_review_from: int = 200
    occurrence_from: int = 5
    chain_from: int = 60


# --- End of fixed values ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class MallWords:
    strict: tuple[str, ...] = MALL_STRICT_WORDS
    floor_pattern: str = MALL_FLOOR_PATTERN
    floor_words: tuple[str, ...] = MALL_FLOOR_WORDS
    keywords: tuple[str, ...] = MALL_KEYWORDS
    facilities: tuple[str, ...] = MALL_FACILITIES


@dataclass(frozen=True)
class Options:
    strip_prefecture: bool = False
    remove_business_words: bool = False
    exclude_commercial_facilities: bool = False
    chain_names: tuple[str, ...] = ()
    generic_words: tuple[str, ...] = GENERIC_CHAIN_WORDS
    pairing: str = "auto"  # auto, all or blocked
    all_pairs_limit: int = 500
    run_ts: str | None = None  # fixes the time in logs and stores; else the time of the run
    duplicate: DuplicateScoring = field(default_factory=DuplicateScoring)
    chain: ChainScoring = field(default_factory=ChainScoring)
    mall: MallWords = field(default_factory=MallWords)
