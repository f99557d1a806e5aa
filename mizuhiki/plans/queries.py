"""Driver queries for the engine's operators over the test tables, each with the SQL that gives the same rows.

The tables are no listings, so views make some of them: `LISTINGS` is one SQL text that Spark and the other engine both
run. Names, phones and addresses are ASCII there unless a query is about something else.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text as t
from ..functions.kernels import jaro_winkler_udf, nfkc, to_fixed
from ..operators import merge, pairs
from ..operators.classify import brand_matches, classify, heavy_brands, master_brands, route
from ..operators.components import connected_components
from ..operators.matches import find_matches
from ..operators.normalize import normalize_records
from ..operators.scoring import cascade, first_numbers, score_pairs
from ..session import materialize, scratch_path
from ..sources.export import excluded_rows, export_table, phone_first, with_phone_flag, write_csv
from ..sources.mapping import detect_source, map_columns, source_name
from ..sources.readers import load_chain_names, load_records
from .resolve import run_pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names begin with three digits of a hash, so that they make many small blocks, and a third of the phones are missing.
LISTINGS = """
with s as (
  select 'google' as source, s_suppkey as k, s_name as name, s_nationkey as nk from supplier
  union all
  select 'tabelog', c_custkey, concat('Supplier#', substring(c_name, 10)), c_nationkey from customer
  union all
  select 'hotpepper', p_partkey, p_name, p_size % 25 from part)
select source, k, concat(substring(md5(cast(k as varchar(10))), 1, 3), ' ', name) as name,
  case when k % 3 <> 0 then concat('03-1', lpad(cast(k % 1000 as varchar(10)), 3, '0'), '-', lpad(cast(k % 7919 as varchar(10)), 4, '0')) end as phone,
  concat(n_name, ' ', cast(k as varchar(10)), '-', cast(k % 7 as varchar(10)), '-', case when source = 'google' then '1' else '01' end) as address,
  35.0 + cast(k as double) * 0.01 + case when source = 'google' then 0.0 else 0.0001 end as lat,
  139.0 + cast(k as double) * 0.01 as lng,
  concat('http://', lower(source), '.example.com/', cast(k % 500 as varchar(10)), '?x=1') as url,
  k * 4 + case source when 'google' then 0 when 'tabelog' then 1 else 2 end as record_index
from s join nation on nk = n_nationkey"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = LISTINGS
    for name in ("supplier", "customer", "part", "nation"):
        sql = re.sub(rf"\b(from|join) {name}\b", rf"\1 parquet.`{sf_dir}/{name}.parquet`", sql)
    return spark.sql(sql)


def normalized_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as the columns that pairs compare, by plain lower case: the oracle does the same."""
    phone = F.coalesce("phone", F.lit(""))
    return listings(spark, sf_dir).select("record_index", "source", F.lower("name").alias("normalized_name"), F.col("name").alias("raw_name"), F.replace(phone, F.lit("-"), F.lit("")).alias("normalized_phone"), phone.alias("raw_phone"), F.lower(F.replace("address", F.lit(" "), F.lit(""))).alias("normalized_address"), F.col("address").alias("raw_address"), "lat", "lng", F.substring_index("url", "?", 1).alias("normalized_url"), "url")


NORMAL_SQL = f"""l as ({LISTINGS}),
n as (select record_index, source, lower(name) as normalized_name, name as raw_name, replace(coalesce(phone, ''), '-', '') as normalized_phone, coalesce(phone, '') as raw_phone,
  lower(replace(address, ' ', '')) as normalized_address, address as raw_address, lat, lng, split_part(url, '?', 1) as normalized_url, url from l)"""



def jaro_winkler_sql(source: str, name: str) -> str:
    """Tables of a WITH clause: `name` has (a, b, similarity) for the pairs (a, b) of `source`.

    A fold over the letters of a takes for each the first equal letter of b that is in reach and not yet taken.
    """
    near = "range(greatest(1, x.i - reach), least(length(b), x.i + reach) + 1)"
    first = f"list_filter({near}, lambda j: b[j] = a[x.i] and not list_contains(t.taken, j))[1:1]"
    none = "cast([] as bigint[])"
    places = f"list_transform(range(1, length(a) + 1), lambda i: {{'i': i, 'taken': {none}}})"
    taken = f"list_reduce({places}, lambda t, x: {{'i': x.i, 'taken': t.taken || {first}}}, {{'i': cast(0 as bigint), 'taken': {none}}}).taken"
    odd = "len(list_filter(range(1, len(taken) + 1), lambda i: b[taken[i]] <> b[list_sort(taken)[i]])) / 2.0"
    share = "len(taken) / cast(length(a) as double) + len(taken) / cast(length(b) as double)"
    prefix = "len(list_filter(range(1, 5), lambda i: length(a) >= i and length(b) >= i and a[1:i] = b[1:i]))"
    return f"""{name}_taken as (select a, b, {taken} as taken from (select a, b, greatest(length(a), length(b)) // 2 - 1 as reach from {source})),
{name}_jaro as (select a, b, case when a = b then 1.0 when len(taken) = 0 then 0.0 else ({share} + (len(taken) - {odd}) / cast(len(taken) as double)) / 3 end as jaro from {name}_taken),
{name} as (select a, b, case when jaro <= 0.7 then jaro else jaro + {prefix} * cast(0.1 as double) * (1 - jaro) end as similarity from {name}_jaro)"""


# --- Scalar functions -----------------------------------------------------------------------------------------------
PHONES = """case c_custkey % 6 when 0 then concat('+81-3-', lpad(cast(c_custkey as varchar(12)), 8, '0')) when 1 then concat('0081 90', lpad(cast(c_custkey as varchar(12)), 8, '0'))
  when 2 then concat('(03) ', lpad(cast(c_custkey as varchar(12)), 8, '0')) when 3 then cast(c_custkey as varchar(12)) when 4 then concat('090-', lpad(cast(c_custkey as varchar(12)), 8, '0'), ' ') else null end"""


@query("normalize_phone", f"with p as (select c_custkey, {PHONES} as phone from customer), d as (select c_custkey, regexp_replace(regexp_replace(regexp_replace(trim(coalesce(phone, '')), '^\\+81[- ]?', '0'), '^0081[- ]?', '0'), '[^0-9]', '', 'g') as d from p) select c_custkey, case when length(d) in (10, 11) then d else '' end as normalized_phone from d")
def _phone(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.expr(PHONES).alias("phone")).select("c_custkey", t.normalize_phone(F.col("phone")).alias("normalized_phone"))


@query("normalize_url", "select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') as normalized_url from pages")
def _url(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.normalize_url(F.col("url")).alias("normalized_url"))


@query("collapse_spaces", "select doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as digest from documents")
def _spaces(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.collapse_spaces(F.col("text"))).alias("digest"))


@query("remove_symbols", "select doc_id, md5(regexp_replace(text, '[【】\\[\\]()（）<>「」『』''\"`.,，、。!！?？:：;；~〜·・/\\\\|]', '', 'g')) as digest from documents")
def _symbols(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.remove_symbols(F.col("text"))).alias("digest"))


@query("strip_corporate", "select p_partkey, regexp_replace(concat(p_name, case p_partkey % 3 when 0 then ' Inc.' when 1 then ' llc' else ' Corp' end), '株式会社|有限会社|合同会社|（株）|\\(株\\)|㈱|Inc\\.?|LLC|Corp\\.?', '', 'gi') as name from part")
def _corporate(spark, sf):
    said = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " Inc.").when(F.col("p_partkey") % 3 == 1, " llc").otherwise(" Corp"))
    return table(spark, sf, "part").select("p_partkey", t.strip_corporate_words(said).alias("name"))


@query("strip_business_words", "select p_partkey, regexp_replace(concat(p_name, ' CAFE bar 居酒屋'), '居酒屋|焼肉|焼鳥|焼き鳥|串焼き|カフェ|cafe|coffee|喫茶|レストラン|ダイニング|bar|バー|ラーメン|中華|寿司|鮨|イタリアン|フレンチ|ビストロ', '', 'gi') as name from part")
def _business(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.strip_business_words(F.concat("p_name", F.lit(" CAFE bar 居酒屋"))).alias("name"))


BRANCH = "concat('さくら', case p_partkey % 5 when 0 then '本店' when 1 then '12号店' when 2 then '中央駅店' when 3 then '屋' else 'モール店' end)"


@query("branch_suffix", f"with n as (select p_partkey, {BRANCH} as raw from part) select p_partkey, case when p_partkey % 5 = 3 then raw else 'さくら' || case when p_partkey % 5 = 2 then '中央' else '' end end as name from n")
def _branch(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(BRANCH).alias("raw")).select("p_partkey", t.strip_branch_suffix(F.col("raw")).alias("name"))


@query("normalize_name", f"""with n as (select p_partkey, p_name, {BRANCH} as raw from part)
select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw || p_name), 'inc\\.?|llc|corp\\.?', '', 'g'), '[ \\-]', '', 'g'), '本店|支店|号店|店|階', '', 'g'), 'f', '', 'g') as name from n""")
def _name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.normalize_name(F.concat(F.lit("株式会社 "), F.expr(BRANCH), F.col("p_name"))).alias("name"))


@query("nfkc", "select p_partkey, p_name || '①㍿ｶﾞ' as wide, p_name || '1株式会社ガ' as folded from part")
def _nfkc(spark, sf):
    letters = "abcdefghijklmnopqrstuvwxyz "
    wide = F.translate("p_name", letters, "".join(chr(ord(c) + 0xFEE0) if c != " " else "\u3000" for c in letters))
    return table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit("①㍿ｶﾞ")).alias("wide"), nfkc(F.concat(wide, F.lit("①㍿ｶﾞ"))).alias("folded"))


@query("clean_brackets", "select p_partkey, p_name || case p_partkey % 3 when 0 then '駅前店' when 1 then '(駅前)' else '（駅前店）x' end as name from part")
def _brackets(spark, sf):
    said = F.when(F.col("p_partkey") % 3 == 0, "（駅前店）").when(F.col("p_partkey") % 3 == 1, "(駅前)").otherwise("（駅前店）x")
    return table(spark, sf, "part").select("p_partkey", t.clean_brackets(F.concat("p_name", said)).alias("name"))


@query("branch_signal", f"with n as (select p_partkey, {BRANCH} as raw from part) select p_partkey, p_partkey % 5 <> 3 as branch from n")
def _branch_signal(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(BRANCH).alias("raw")).select("p_partkey", t.has_branch_suffix(F.col("raw")).alias("branch"))


@query("mall_words", "select p_partkey, case p_partkey % 5 when 0 then 'ルミネ' when 1 then 'floor_with_百貨店' when 2 then 'イクスピアリ' when 3 then '光が丘IMA' end as pattern from part")
def _mall_words(spark, sf):
    """The dictionaries that come with the package: strict words, floors, keywords and listed facilities."""
    said = F.element_at(F.array(*(F.lit(x) for x in ("ルミネ 3F モール", "3階 百貨店", "ｲｸｽﾋﾟｱﾘ", "光が丘ima", "道"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", t.mall_text(F.lit("店"), said).alias("s"))
    return rows.select("p_partkey", t.mall_pattern(F.col("s")).alias("pattern"))


@query("normalize_address", "select n_nationkey, lower(regexp_replace(n_name, '[ ]', '', 'g')) || cast(n_nationkey as varchar) || '-12-' || cast(n_nationkey % 7 as varchar) as address from nation")
def _address(spark, sf):
    raw = F.concat("n_name", F.lit(" "), F.col("n_nationkey").cast("string"), F.lit("丁目十二番"), (F.col("n_nationkey") % 7).cast("string"), F.lit("号 3階"))
    return table(spark, sf, "nation").select("n_nationkey", t.normalize_address(raw).alias("address"))


NUMBERS = "case event_id % 6 when 0 then cast(value as varchar(40)) when 1 then '12d' when 2 then 'Infinity' when 3 then ' 7.5e2 ' when 4 then '' else '-.5' end"


@query("safe_number", "select event_id, case event_id % 6 when 0 then value when 3 then 750.0 when 5 then -0.5 else null end as number from events")
def _number(spark, sf):
    kinds = F.col("event_id") % 6
    said = F.when(kinds == 0, F.col("value").cast("string")).when(kinds == 1, "12d").when(kinds == 2, "Infinity").when(kinds == 3, " 7.5e2 ").when(kinds == 4, "").otherwise("-.5")
    return table(spark, sf, "events").select("event_id", t.safe_number(said).alias("number"))


@query("levenshtein_similarity", "select a.n_nationkey as l, b.n_nationkey as r, levenshtein(a.n_name, b.n_name) as distance, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) as similarity from nation a join nation b on a.n_nationkey < b.n_nationkey")
def _levenshtein(spark, sf):
    n = table(spark, sf, "nation")
    both = n.alias("a").join(F.broadcast(n.alias("b")), F.col("a.n_nationkey") < F.col("b.n_nationkey"))  # 25 rows
    return both.select(F.col("a.n_nationkey").alias("l"), F.col("b.n_nationkey").alias("r"), F.levenshtein("a.n_name", "b.n_name").alias("distance"), F.round(t.levenshtein_similarity(F.col("a.n_name"), F.col("b.n_name")), 6).alias("similarity"))


@query("jaro_winkler_pairs", f"with n as (select a.n_nationkey as l, b.n_nationkey as r, a.n_name as a, b.n_name as b from nation a join nation b on a.n_nationkey < b.n_nationkey), {jaro_winkler_sql('n', 'w')} select l, r, similarity from n join w on n.a = w.a and n.b = w.b")
def _jaro(spark, sf):
    n = table(spark, sf, "nation")
    both = n.alias("a").join(F.broadcast(n.alias("b")), F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return both.select(F.col("a.n_nationkey").alias("l"), F.col("b.n_nationkey").alias("r"), jaro_winkler_udf(F.col("a.n_name"), F.col("b.n_name")).alias("similarity"))


@query("best_name_similarity", f"with n as (select a.n_nationkey as l, b.n_nationkey as r, a.n_name as a, b.n_name as b from nation a join nation b on a.n_nationkey < b.n_nationkey), {jaro_winkler_sql('n', 'w')} select l, r, greatest(similarity, 1 - levenshtein(n.a, n.b) / greatest(length(n.a), length(n.b))) as similarity from n join w on n.a = w.a and n.b = w.b")
def _best_similarity(spark, sf):
    n = table(spark, sf, "nation")
    both = n.alias("a").join(F.broadcast(n.alias("b")), F.col("a.n_nationkey") < F.col("b.n_nationkey"))  # 25 rows
    return both.select(F.col("a.n_nationkey").alias("l"), F.col("b.n_nationkey").alias("r"), t.best_name_similarity(F.col("a.n_name"), F.col("b.n_name")).alias("similarity"))


POINTS = "35 + (n_nationkey % 5) * 0.01 as lat, 139 + n_nationkey * 0.001 as lng"


@query("haversine_pairs", f"with p as (select n_nationkey as k, cast(35 + (n_nationkey % 5) * 0.01 as double) as lat, cast(139 + n_nationkey * 0.001 as double) as lng from nation), j as (select a.k as l, b.k as r, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lng - a.lng) / 2), 2) as h from p a join p b on a.k < b.k) select l, r, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) as meters from j")
def _haversine(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.lit(35) + (F.col("n_nationkey") % 5) * F.lit(0.01)).alias("lat"), (F.lit(139) + F.col("n_nationkey") * F.lit(0.001)).alias("lng"))
    both = n.alias("a").join(F.broadcast(n.alias("b")), F.col("a.k") < F.col("b.k"))
    return both.select(F.col("a.k").alias("l"), F.col("b.k").alias("r"), F.round(t.haversine_meters(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")), 3).alias("meters"))


@query("geo_cells", "select vec_id, cast(floor(cast(embedding[1] as double) * 2000 + 0.5) as bigint) as lat_cell, cast(floor(cast(embedding[2] as double) * 2000 + 0.5) as bigint) as lng_cell from embeddings")
def _cells(spark, sf):
    at = lambda i: t.geo_cell(F.col("embedding")[i].cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", at(0).alias("lat_cell"), at(1).alias("lng_cell"))


@query("store_id", "select c_custkey, substr(sha1(concat_ws('|', lower(c_name), cast(c_nationkey as varchar), '', coalesce(c_mktsegment, ''))), 1, 20) as store_id from customer")
def _store_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", t.store_id_of(F.lower("c_name"), F.col("c_nationkey"), F.lit(None).cast("string"), F.col("c_mktsegment")).alias("store_id"))


@query("to_fixed", "select s_suppkey, printf('%.6f', s_suppkey + 0.125) as fixed from supplier")
def _fixed(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", to_fixed(F.col("s_suppkey") + F.lit(0.125), 6).alias("fixed"))


HOLIDAY = "case n_nationkey % 6 when 0 then '火曜・水曜' when 1 then '' when 2 then '不定休' when 3 then '年中無休' when 4 then 'お盆' else '毎週日曜日' end"


@query("holiday_format", "select n_nationkey, case n_nationkey % 6 when 0 then '火曜, 水曜' when 1 then 'なし' when 2 then '不定休' when 3 then 'なし' when 4 then 'お盆' else '日曜' end as holiday from nation")
def _holiday(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.expr(HOLIDAY).alias("h")).select("n_nationkey", t.format_holiday(F.col("h")).alias("holiday"))


HOURS = "case n_nationkey % 4 when 0 then '11：00～14：00、17:00-22:00' when 1 then '月〜金 11:00〜14:00' when 2 then '土日祝 10:00〜20:00(L.O.19:30)' else '不明' end"


@query("hours_format", "select n_nationkey, case n_nationkey % 4 when 0 then '全日：11:00〜14:00 / 17:00〜22:00' when 1 then '金：11:00〜14:00' when 2 then '祝：10:00〜20:00' else '不明' end as hours from nation")
def _hours(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.expr(HOURS).alias("h")).select("n_nationkey", t.format_hours(F.col("h")).alias("hours"))


# --- Sources and mapping --------------------------------------------------------------------------------------------
SITES = "case page_id % 4 when 0 then 'https://tabelog.com/1' when 1 then 'https://www.hotpepper.jp/x' when 2 then 'https://www.google.com/maps/1' else url end"


@query("source_detect", "select page_id, case page_id % 4 when 0 then 'tabelog' when 1 then 'hotpepper' when 2 then 'google' else 'crawl' end as source from pages")
def _detect(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.expr(SITES).alias("url"), F.lit(" Crawl").alias("site"))
    return rows.select("page_id", detect_source(rows).alias("source"))


@query("source_name", "select c_custkey, case when c_custkey % 3 = 0 then 'google' else lower(c_mktsegment) end as source from customer")
def _source_name(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", source_name(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" Google "), F.col("c_mktsegment"))).otherwise(F.col("c_mktsegment"))).alias("source"))


@query("column_mapping", "select s_name as name, cast(s_suppkey as varchar) as phone, s_acctbal as lat, 'google' as source, cardinality(map([1], [1])) + 3 as columns from supplier")
def _mapping(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("店名"), F.col("s_suppkey").cast("string").alias(" TEL "), F.col("s_acctbal").cast("string").alias("緯度"), F.lit("Google").alias("媒体"))
    return map_columns(rows).select("name", "phone", "lat", "source", F.size("raw").alias("columns"))


@query("load_files", """with s as (select 0 as file, s_suppkey as k, s_name as name, 'Google' as source, cast(s_nationkey as varchar) as phone, cast(s_acctbal as varchar) as hours from supplier where s_suppkey % 5 > 0
  union all select 1, n_nationkey, n_name, 'nations', cast(n_regionkey as varchar), '' from nation union all select 2, r_regionkey, r_name, 'hotpepper', '', r_name || ' day' from region)
select row_number() over (order by file, k) - 1 as record_index, name, case when file = 0 then 'google' else source end as source, phone, case when file = 0 then '' else hours end as business_hours, case when file = 2 then hours else '' end as regular_holiday, case file when 0 then 5 when 1 then 3 else 3 end as columns from s""")
def _load(spark, sf):
    """A CSV with a mark and nameless rows, JSON as an object and as an array, and a file that isn't there."""
    at = scratch_path(spark, "files")
    supplier, nation, region = (table(spark, sf, n) for n in ("supplier", "nation", "region"))
    named = F.when(F.col("s_suppkey") % 5 > 0, F.col("s_name")).otherwise(F.lit("  "))
    rows = supplier.select(named.alias("\ufeff店名"), F.lit("Google").alias("媒体"), F.col("s_nationkey").alias("TEL"), F.col("s_acctbal").alias("緯"), F.lit("a, \"b\"").alias("備考"), "s_suppkey")
    write_csv(rows.coalesce(1).sortWithinPartitions("s_suppkey").drop("s_suppkey"), f"{at}/a.csv", single=True)
    listed = lambda df, by, *columns: df.agg(F.sort_array(F.collect_list(F.struct(by, F.struct(*columns).alias("r")))).alias("l")).select(F.transform("l", lambda x: x["r"]).alias("records"))
    nations = listed(nation, "n_nationkey", F.col("n_name").alias("Name "), F.lit(" Nations").alias("site"), F.col("n_regionkey").cast("string").alias("電話"))
    nations.select(F.to_json(F.struct("records")).alias("value")).coalesce(1).write.text(f"{at}/b.json")
    regions = listed(region, "r_regionkey", F.col("r_name").alias("店舗名"), F.lit("ホットペッパー").alias("platform"), F.concat("r_name", F.lit(" day")).alias("raw_business_hours"))
    regions.select(F.to_json("records").alias("value")).coalesce(1).write.text(f"{at}/c.json")
    loaded = load_records(spark, [f"{at}/{n}" for n in ("a.csv", "none.csv", "b.json", "c.json")], encoding="auto", on_error="skip")
    return loaded.select("record_index", "name", "source", "phone", "business_hours", "regular_holiday", F.size("source_columns").alias("columns"))


@query("chain_master", "with p as (select distinct p_name as name from part union all select 'さくら 本店' union all select 'さくら'), b as (select row_number() over (order by name) as ord, case when name like 'さくら%' then 'さくら' else regexp_replace(replace(lower(name), ' ', ''), 'f', '', 'g') end as brand from p) select row_number() over (order by min(ord)) - 1 as ord, brand from b group by brand")
def _master(spark, sf):
    """A chain master written as JSON and read back; brands in its order, normalised and each once."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().unionByName(spark.createDataFrame([("さくら 本店",), ("さくら",)], "name string"))
    at = f"{scratch_path(spark, 'chains')}/chains.json"
    names.agg(F.sort_array(F.collect_list("name")).alias("chains")).select(F.to_json(F.struct("chains")).alias("value")).coalesce(1).write.text(at)
    brands = master_brands(spark, load_chain_names(spark, at))
    return spark.createDataFrame(list(enumerate(brands)), "ord long, brand string")


# --- Classification -------------------------------------------------------------------------------------------------
def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("record_index"), F.lower("p_name").alias("normalized_name"))


@query("brand_occurrences", "select lower(p_name) as normalized_name, count(*) as n from part group by 1 having count(*) >= 5")
def _occurrences(spark, sf):
    return heavy_brands(_parts(spark, sf), 5)


@query("heavy_brand_semi_join", "select p_partkey as record_index from part where lower(p_name) in (select lower(p_name) from part group by 1 having count(*) >= 35)")
def _heavy(spark, sf):
    rows = _parts(spark, sf)
    return rows.join(heavy_brands(rows, 35), "normalized_name", "left_semi").select("record_index")


BRANDS = ["small ring", "green", "red box", "mall", "xsteel plated"]


@query("chain_matches", "with b(ord, brand) as (values (0, 'small ring'), (1, 'green'), (2, 'red box'), (3, 'mall'), (4, 'xsteel plated')), n as (select distinct lower(p_name) as name from part), e as (select name, brand from n join b on name = brand), p as (select name, arg_min(brand, ord) as brand from n join b on (length(brand) >= 3 and contains(name, brand)) or (length(name) >= 4 and contains(brand, name)) group by name) select n.name as normalized_name, case when e.brand is not null then 'exact' when p.brand is not null then 'partial' else 'none' end as kind, coalesce(e.brand, p.brand) as brand from n left join e on e.name = n.name left join p on p.name = n.name")
def _chains(spark, sf):
    options = config.Options(generic_words=(), chain=config.ChainScoring(similarity=2.0))
    return brand_matches(_parts(spark, sf), BRANDS, options).select("normalized_name", "match.kind", "match.brand")


SIMILAR_TO = ("smal ring", "gren box")


@query("chain_similar", f"""with m(ord, b) as (values (0, '{SIMILAR_TO[0]}'), (1, '{SIMILAR_TO[1]}')), n as (select distinct lower(p_name) as a from part), p as (select a, b, ord from n, m),
{jaro_winkler_sql('p', 'w')}, s as (select p.a, p.b, similarity, row_number() over (partition by p.a order by similarity desc, ord) as no from p join w on p.a = w.a and p.b = w.b)
select a as normalized_name, case when similarity >= 0.94 then 'similar' else 'none' end as kind, case when similarity >= 0.94 then b end as brand, round(similarity, 4) as similarity from s where no = 1""")
def _similar(spark, sf):
    return brand_matches(_parts(spark, sf), list(SIMILAR_TO), config.Options(generic_words=())).select("normalized_name", "match.kind", "match.brand", F.round("match.similarity", 4).alias("similarity"))


CHAIN_RECORDS = "select p_partkey as record_index, p_name as name, concat('http://x.example.com/', case when p_partkey % 3 = 0 then 'Shop/' else 'a/' end, cast(p_partkey as varchar(12))) as url, cast(p_size * 20 as varchar(12)) as reviews from part"


@query("chain_scores", f"with r as ({CHAIN_RECORDS}), k as (select lower(replace(name, ' ', '')) as n from r group by 1 having count(*) >= 5), s as (select record_index, case when lower(replace(name, ' ', '')) in (select n from k) then 30 else 0 end + case when url like '%/Shop/%' then 20 else 0 end + case when cast(reviews as int) >= 500 then 20 when cast(reviews as int) >= 200 then 10 else 0 end as chain_score from r) select record_index, chain_score, chain_score >= 60 as chain_flag from s")
def _chain_scores(spark, sf):
    rows = spark.sql(CHAIN_RECORDS.replace("from part", f"from parquet.`{sf}/part.parquet`"))
    return classify(normalize_records(rows), []).select("record_index", "chain_score", "chain_flag")


MALL_WORDS = config.MallWords(strict=("ththe", "ered"), floor_words=("tion", "ing"), floor_pattern="[0-9]+F", keywords=("enden", "lich"), facilities=("mente", "eau"))


@query("mall_first_match", "with d as (select doc_id, lower(text) as s from documents) select doc_id, case when contains(s, 'ththe') then 'ththe' when contains(s, 'ered') then 'ered' when regexp_matches(s, '[0-9]+f') and contains(s, 'tion') then 'floor_with_tion' when regexp_matches(s, '[0-9]+f') and contains(s, 'ing') then 'floor_with_ing' when contains(s, 'enden') then 'enden' when contains(s, 'lich') then 'lich' when contains(s, 'mente') then 'mente' when contains(s, 'eau') then 'eau' end as pattern from d")
def _mall(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower("text").alias("s")).select("doc_id", t.mall_pattern(F.col("s"), MALL_WORDS).alias("pattern"))


@query("menu_source_aeon_rule", "select c_custkey, c_custkey % 2 = 0 and c_custkey % 3 = 0 as mall from customer")
def _aeon(spark, sf):
    k = F.col("c_custkey")
    source = F.when(k % 2 == 0, "RocketNow").otherwise("google")
    name = F.when(k % 3 == 0, "Cafe AEON the Mall").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", (t.is_menu_source(source) & t.is_aeon_mall(name, F.lit(""))).alias("mall"))


FLAGGED = "select c_custkey as record_index, c_custkey % 5 = 0 as chain_flag, c_custkey % 3 = 0 as mall_flag from customer"


@query("split_route", f"with f as ({FLAGGED}) select 'chain' as list, record_index from f where chain_flag union all select 'mall', record_index from f where mall_flag union all select 'candidate', record_index from f where not chain_flag and not mall_flag")
def _route(spark, sf):
    lists = route(spark.sql(FLAGGED.replace("from customer", f"from parquet.`{sf}/customer.parquet`")))
    tagged = [df.select(F.lit(n).alias("list"), "record_index") for n, df in (("chain", lists.chain_excluded), ("mall", lists.mall_excluded), ("candidate", lists.candidates))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("exclude_reasons", "select p_partkey as record_index, case when p_partkey % 4 = 0 then 'mall_tenant' else '' end as reasons from part")
def _reasons(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("record_index"), F.concat(F.lit("n"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, " aeonmall").otherwise("")).alias("name"), F.lit("menu").alias("source"))
    return classify(normalize_records(rows), []).select("record_index", F.array_join("exclude_reason", "|").alias("reasons"))


# --- Pairs, scores, clusters ----------------------------------------------------------------------------------------
def _block_sql(condition: str, normal: str = NORMAL_SQL) -> str:
    return f"with {normal} select l.record_index as left_idx, r.record_index as right_idx from n l join n r on l.record_index < r.record_index and ({condition})"


def _cell(side: str) -> str:
    return f"floor({side}.lat * 2000 + 0.5), floor({side}.lng * 2000 + 0.5)"


BLOCK_SQL = {
    "phone": "l.normalized_phone = r.normalized_phone and l.normalized_phone <> ''",
    "name": "length(l.normalized_name) >= 4 and length(r.normalized_name) >= 4 and substr(l.normalized_name, 1, 4) = substr(r.normalized_name, 1, 4)",
    "address": "length(l.normalized_address) >= 6 and substr(l.normalized_address, 1, 10) = substr(r.normalized_address, 1, 10) and length(r.normalized_address) >= 6",
    "url": "l.normalized_url = r.normalized_url and l.normalized_url <> ''",
    "geo": f"row({_cell('l')}) = row({_cell('r')})",
}
for _kind, _sql in BLOCK_SQL.items():

    @query(f"block_pairs_{_kind}", _block_sql(_sql))
    def _blocks(spark, sf, kind=_kind):
        return pairs.blocked_pairs(normalized_listings(spark, sf), (kind,)).select("left_idx", "right_idx")


#: The pairs of all kinds of block as one table p; a union by kinds, as an OR would compare all with all.
UNION_SQL = " union ".join(f"select l.record_index as left_idx, r.record_index as right_idx from n l join n r on l.record_index < r.record_index and {x}" for x in BLOCK_SQL.values())


@query("block_pairs_union", f"with {NORMAL_SQL} {UNION_SQL}")
def _union(spark, sf):
    return pairs.block_pairs(normalized_listings(spark, sf))


@query("block_sizes_name", f"with {NORMAL_SQL} select substr(normalized_name, 1, 4) as key, count(*) as n, cast(count(*) * (count(*) - 1) / 2 as bigint) as pairs from n where length(normalized_name) >= 4 group by 1")
def _name_sizes(spark, sf):
    return pairs.block_sizes(normalized_listings(spark, sf), ("name",)).select("key", "n", "pairs")


@query("block_sizes_geo", f"with {NORMAL_SQL}, g as (select case when record_index % 5 > 0 then cast(floor(lat * 2000 + 0.5) as bigint) || ':' || cast(floor(lng * 2000 + 0.5) as bigint) end as key from n) select key, count(*) as n, cast(count(*) * (count(*) - 1) / 2 as bigint) as pairs from g where key is not null group by 1")
def _geo_sizes(spark, sf):
    """A fifth of the listings have no longitude, and so no cell."""
    rows = normalized_listings(spark, sf).withColumn("lng", F.when(F.col("record_index") % 5 > 0, F.col("lng")))
    return pairs.block_sizes(rows, ("geo",)).select("key", "n", "pairs")


@query("all_pairs_nation", "select l.n_nationkey as left_idx, r.n_nationkey as right_idx from nation l join nation r on l.n_nationkey < r.n_nationkey")
def _all(spark, sf):
    """A whole table that is small at any scale; the switch to blocks beyond 500 rows is tested on made-up records."""
    empty = {c: F.lit("") for c in ("normalized_phone", "normalized_address", "normalized_url")} | {c: F.lit(None).cast("double") for c in ("lat", "lng")}
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("record_index"), F.lower("n_name").alias("normalized_name")).withColumns(empty)
    return pairs.candidate_pairs(rows).select("left_idx", "right_idx")


SCORED_SQL = f"""with {NORMAL_SQL},
p as (select l.record_index as left_idx, r.record_index as right_idx, l.normalized_phone as lp, r.normalized_phone as rp, l.normalized_name as ln, r.normalized_name as rn, l.normalized_url = r.normalized_url as u
  from n l join n r on l.record_index < r.record_index and l.normalized_phone = r.normalized_phone and l.normalized_phone <> '')"""


def matches_sql(pair_sql: str, s: config.DuplicateScoring = config.DuplicateScoring()) -> str:  # noqa: B008
    """Tables of a WITH clause after n: `p`, the pairs (left_idx, right_idx) of pair_sql, and `m`, those that a rule accepts."""
    numbers = lambda side: f"regexp_extract_all({side}.normalized_address, '[0-9]+')[1:3]"
    both = ", ".join(f"{side}.normalized_{x} as {side}_{x}" for side in "lr" for x in ("name", "phone", "address", "url"))
    h = "power(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * power(sin(radians(r.lng - l.lng) / 2), 2)"
    return f"""p as ({pair_sql}),
f as (select left_idx, right_idx, {both}, {numbers('l')} as l_numbers, {numbers('r')} as r_numbers, {h} as h from p join n l on l.record_index = left_idx join n r on r.record_index = right_idx),
fn as (select distinct l_name as a, r_name as b from f), {jaro_winkler_sql('fn', 'wn')},
g as (select f.*, similarity as name_sim, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) as distance, least(len(l_numbers), len(r_numbers)) as shortest from f join wn on l_name = a and r_name = b),
fa as (select distinct l_address as a, r_address as b from g where name_sim >= {s.name_similarity}), {jaro_winkler_sql('fa', 'wa')},
e as (select g.*, l_phone = r_phone and l_phone <> '' as same_phone, l_url = r_url and l_url <> '' as same_url, (l_phone = '' or r_phone = '') and l_name = r_name and l_address = r_address as equal,
  name_sim >= {s.name_similarity} and similarity >= {s.address_similarity} as alike, shortest = 0 or l_numbers[1:shortest] = r_numbers[1:shortest] as numbers_fit, distance <= {s.distance_meters} and name_sim >= {s.distance_name_similarity} as near
  from g left join wa on l_address = a and r_address = b),
v as (select *, case when same_phone and name_sim >= {s.phone_name_guard} then 1 when same_url then 2 when equal then 3 when coalesce(alike, false) and numbers_fit then 4 when coalesce(near, false) then 5 else 0 end as level from e),
m as (select left_idx, right_idx, [{s.phone_match}, {s.url_match}, {s.name_address_exact}, {s.similarity_match}, {s.distance_match}][level] as score,
  concat_ws(',', case when same_phone and level <> 1 then 'phone_match_rejected_name_mismatch' end, case when level = 5 and coalesce(alike, false) and not numbers_fit then 'similarity_match_rejected_different_address_numbers' end,
    ['phone_match', 'url_match', 'name_and_address_exact_match', 'similarity_match', 'distance_and_name_match'][level]) as reasons,
  round(name_sim, 4) as name_similarity, round(distance, 2) as distance_meters from v where level > 0)"""


@query("score_cascade", f"{SCORED_SQL} select left_idx, right_idx, case when ln = rn then 100 when u then 70 else 0 end as score, case when ln = rn then 'phone_match' when u then 'phone_match_rejected_name_mismatch,url_match' else 'phone_match_rejected_name_mismatch' end as reasons from p")
def _cascade(spark, sf):
    p = pairs.blocked_pairs(normalized_listings(spark, sf), ("phone",))
    # equality stands in for similarity, which the oracle has no function for
    sims = p.withColumn("name_sim", F.when(F.col("l.normalized_name") == F.col("r.normalized_name"), 1.0).otherwise(0.0)).withColumn("address_sim", F.lit(0.0)).withColumn("distance", F.lit(None).cast("double"))
    return sims.withColumns({k: v for k, v in cascade().items() if k in ("score", "reasons")}).select("left_idx", "right_idx", "score", F.array_join("reasons", ",").alias("reasons"))


@query("score_pairs", f"with {NORMAL_SQL}, {matches_sql(UNION_SQL)} select * from m")
def _scores(spark, sf):
    """All rules over the pairs of all kinds of block."""
    # dealt over tasks: the tables may be few files
    candidates = materialize(normalized_listings(spark, sf).select("record_index", *pairs.COMPARED).repartition("record_index"), "listings")
    found = find_matches(candidates, "blocked").brief_edges()
    return found.select("left_idx", "right_idx", "score", F.array_join("reasons", ",").alias("reasons"), "name_similarity", "distance_meters")


STRICT = config.DuplicateScoring(phone_match=7, url_match=6, distance_match=3, phone_name_guard=0.9, name_similarity=0.95, address_similarity=0.9, distance_meters=5.0, distance_name_similarity=0.5)


@query("score_pairs_strict", f"with {NORMAL_SQL}, {matches_sql(UNION_SQL, STRICT)} select left_idx, right_idx, score, reasons from m")
def _strict_scores(spark, sf):
    """The same with other points and thresholds."""
    return score_pairs(pairs.blocked_pairs(normalized_listings(spark, sf)), STRICT).select("left_idx", "right_idx", "score", F.array_join("reasons", ",").alias("reasons"))


@query("address_numbers", f"with l as ({LISTINGS}) select record_index, array_to_string(regexp_extract_all(address, '[0-9]+')[1:3], ',') as numbers from l")
def _numbers(spark, sf):
    return listings(spark, sf).select("record_index", F.array_join(first_numbers(F.col("address")), ",").alias("numbers"))


EDGES = "select c_custkey as src, cast(floor(c_custkey / 3) as bigint) as dst from customer where c_custkey % 10 <> 0"


@query("connected_components", f"with recursive e as (select src, dst from ({EDGES}) where src <> dst), b as (select src, dst from e union select dst, src from e), r(id, spot) as (select src, src from b union select r.id, b.dst from r join b on b.src = r.spot) select id, min(spot) as component from r group by id")
def _components(spark, sf):
    return connected_components(spark.sql(EDGES.replace("from customer", f"from parquet.`{sf}/customer.parquet`")))


CLUSTERED_SQL = f"""with {NORMAL_SQL},
x as (select *, min(record_index) over (partition by case when normalized_phone = '' then cast(record_index as varchar) else normalized_phone end) as cluster, case when normalized_phone <> '' then 1000 else 0 end + case source when 'google' then 300 when 'tabelog' then 200 else 100 end + 30 + length(raw_address) + length(raw_name) as richness from n)"""


def _clustered(spark, sf):
    rows = normalized_listings(spark, sf)
    rows = rows.withColumn("_by", F.coalesce(F.nullif("normalized_phone", F.lit("")), F.col("record_index").cast("string")))
    least = rows.groupBy("_by").agg(F.min("record_index").alias("cluster"))
    return rows.join(least, "_by").drop("_by").withColumn("richness", merge.richness())


@query("primary_by_richness", f"{CLUSTERED_SQL}, r as (select cluster, record_index, richness, row_number() over (partition by cluster order by richness desc, record_index) as k from x) select cluster, record_index as primary_index, richness from r where k = 1")
def _primary(spark, sf):
    return _clustered(spark, sf).groupBy("cluster").agg(merge.primary(F.col("record_index")).alias("primary_index"), F.max("richness").alias("richness"))


@query("best_field_by_source_priority", f"{CLUSTERED_SQL}, r as (select cluster, raw_name, row_number() over (partition by cluster order by case source when 'tabelog' then 0 when 'hotpepper' then 1 when 'google' then 2 end, record_index) as k from x where raw_name <> '') select cluster, raw_name as name from r where k = 1")
def _best(spark, sf):
    return _clustered(spark, sf).groupBy("cluster").agg(merge.best(F.col("raw_name"), F.col("raw_name") != "", ("tabelog", "hotpepper", "google")).alias("name"))


@query("cluster_max_score", f"{SCORED_SQL}, x as (select record_index, min(record_index) over (partition by normalized_phone) as cluster from n), s as (select left_idx, case when ln = rn then 100 else 0 end as score from p) select cluster, max(score) as duplicate_score from s join x on x.record_index = s.left_idx group by cluster")
def _max_score(spark, sf):
    p = pairs.blocked_pairs(normalized_listings(spark, sf), ("phone",))
    scored = p.select("left_idx", F.when(F.col("l.normalized_name") == F.col("r.normalized_name"), 100).otherwise(0).alias("score"))
    labels = _clustered(spark, sf).select(F.col("record_index").alias("left_idx"), "cluster")
    return scored.join(labels, "left_idx").groupBy("cluster").agg(F.max("score").alias("duplicate_score"))


CHAINS = ("Small Ring", "RED BOX", "鳥貴族", "Small Ring")
OPTIONS = config.Options(chain_names=CHAINS, run_ts="2026-01-01 00:00:00")
#: What normalisation and the default rules make of LISTINGS: z all records, n candidates, p pairs, m matches, x clustered records.
RESOLVED_SQL = f"""with recursive l as ({LISTINGS}),
y as (select record_index, source, name as raw_name, coalesce(phone, '') as raw_phone, address as raw_address, lat, lng, url, replace(coalesce(phone, ''), '-', '') as normalized_phone, lower(replace(address, ' ', '')) as normalized_address,
  split_part(url, '?', 1) as normalized_url, regexp_replace(regexp_replace(regexp_replace(lower(name), 'inc\\.?|llc|corp\\.?', '', 'g'), '[ \\-]', '', 'g'), 'f', '', 'g') as normalized_name from l),
brands(ord, brand) as (values (0, 'smallring'), (1, 'redbox'), (2, '鳥貴族')),
pb as (select distinct normalized_name as a, brand as b from y, brands), {jaro_winkler_sql("pb", "wb")},
k as (select a, max(case when a = b then 70 when contains(a, b) or (length(a) >= 4 and contains(b, a)) then 65 when similarity >= 0.94 then 40 else 0 end) as points from wb group by a),
h as (select normalized_name as a, case when count(*) >= 5 then 30 else 0 end as points from y where normalized_name <> '' group by 1),
z as (select y.*, k.points + h.points >= 60 as chain_flag from y join k on normalized_name = k.a join h on normalized_name = h.a),
n as (select * from z where not chain_flag),
{matches_sql("select l.record_index as left_idx, r.record_index as right_idx from n l join n r on l.record_index < r.record_index where (select count(*) from n) <= 500 union " + UNION_SQL)},
b as (select left_idx as src, right_idx as dst from m union select right_idx, left_idx from m),
r(id, spot) as (select src, src from b union select r.id, b.dst from r join b on b.src = r.spot),
c as (select id, min(spot) as component from r group by id),
x as (select n.*, coalesce(component, record_index) as cluster, case source when 'google' then 0 when 'tabelog' then 1 else 2 end as place,
  case when normalized_phone <> '' then 1000 else 0 end + case source when 'google' then 300 when 'tabelog' then 200 else 100 end + 30 + length(raw_address) + length(raw_name) as richness from n left join c on record_index = id)"""


@query("resolve_stores", f"""{RESOLVED_SQL},
q as (select cluster, arg_min(raw_name, place * 10000000000 + record_index) as name, arg_min(normalized_name, place * 10000000000 + record_index) as normalized_name,
  coalesce(arg_min(raw_phone, place * 10000000000 + record_index) filter (raw_phone <> ''), '') as phone, coalesce(arg_min(normalized_phone, place * 10000000000 + record_index) filter (raw_phone <> ''), '') as normalized_phone,
  arg_min(raw_address, place * 10000000000 + record_index) as address, arg_min(lat, record_index - richness * 10000000000) as lat, arg_min(lng, record_index - richness * 10000000000) as lng,
  array_to_string(list_transform(list_sort(list_distinct(list(place))), lambda i: ['google', 'tabelog', 'hotpepper'][i + 1]), '|') as sources, count(*) as n_records from x group by cluster),
t as (select cluster, max(score) as score from m join x on left_idx = record_index group by cluster)
select substr(sha1(normalized_name || '|' || normalized_phone || '|' || printf('%.6f', lat) || '|' || printf('%.6f', lng)), 1, 20) as store_id, name, phone, address, lat, lng, sources, coalesce(score, 0) as duplicate_score, n_records
from q left join t on q.cluster = t.cluster""")
def stores(spark, sf):
    """The whole run over all listings, with the default kinds of block and rules and a chain master; one row for each
    store, without the time-stamped columns."""
    out = run_pipeline(listings(spark, sf).drop("k"), OPTIONS).stores
    return out.select("store_id", "name", "phone", "address", "lat", "lng", F.array_join("sources", "|").alias("sources"), "duplicate_score", F.size("raw_records").alias("n_records"))


@query("run_summary", f"""{RESOLVED_SQL},
s as (select count(distinct cluster) as stores from x), d as (select count(*) as several from (select cluster from x group by cluster having count(*) > 1)),
i as (select count(*) as input_count, count(*) filter (chain_flag) as chains from z)
select input_count, input_count as normalized_count, chains as chain_excluded_count, cast(0 as bigint) as mall_excluded_count, input_count - chains - stores as duplicate_excluded_count, several as duplicate_cluster_count, (select count(*) from m) as merged_count, stores as output_count from i, s, d""")
def _summary(spark, sf):
    return run_pipeline(listings(spark, sf).drop("k"), OPTIONS).summary.drop("exclude_reasons_stats")


@query("match_edges", f"{RESOLVED_SQL} select left_idx, right_idx, score, reasons from m")
def _edges(spark, sf):
    """The duplicate matches of the whole run."""
    return run_pipeline(listings(spark, sf).drop("k"), OPTIONS).duplicate_matches.select("left_idx", "right_idx", "score", F.array_join("reasons", ",").alias("reasons"))


#: Optional fields of listings, for merging: some have none.
DETAILS = {
    "area": "case when k % 3 = 1 then concat('area ', source) else '' end",
    "category": "case when k % 4 = 0 or source = 'google' then '' else concat('kind ', source) end",
    "business_hours": "case when source = 'google' then '火曜 9:00～17:00' when k % 2 = 0 then '11:00-14:00' else '' end",
    "regular_holiday": "case when source = 'google' and k % 2 = 0 then '' when source = 'google' then '火曜' else '不定休あり' end",
}
_first = lambda column, order: f"coalesce(arg_min({column}, {order}) filter ({column} <> ''), '')"
_google, _tabelog, _rich = "place * 10000000000 + record_index", "((place + 2) % 3) * 10000000000 + record_index", "record_index - richness * 10000000000"


@query("merged_fields", f"""{RESOLVED_SQL},
j as (select x.*, l.k, {", ".join(f"{v.replace('source', 'x.source').replace('k %', 'l.k %')} as {n}" for n, v in DETAILS.items())} from x join l on l.record_index = x.record_index),
mm as (select id, count(*) as times from (select left_idx as id from m union all select right_idx from m) group by 1),
q as (select cluster, {_first("area", _rich)} as area, {_first("category", _tabelog)} as category, {_first("business_hours", _tabelog)} as hours, {_first("regular_holiday", _google)} as holiday, arg_min(raw_name, {_rich}) as raw_name,
  arg_min(normalized_url, {_google}) as u, count(*) as n, string_agg(source, ',' order by record_index) as records, string_agg('normalized_record' || repeat(',duplicate_match', coalesce(times, 0)), ',' order by record_index) as logs from j left join mm on id = record_index group by cluster)
select cluster, area, category, case hours when '火曜 9:00～17:00' then '全日：9:00〜17:00' when '11:00-14:00' then '全日：11:00〜14:00' else '' end as business_hours, case holiday when '' then 'なし' when '火曜' then '火曜' else '不定休' end as regular_holiday,
  raw_name as primary_name, u || '?x=1' as url, false as flagged, case when n > 1 then 'duplicate' else '' end as reasons, records, logs || ',cluster_merged,output_ready' as codes from q""")
def _merged(spark, sf):
    """What merging makes of optional fields, raw columns, flags, reasons, records and logs."""
    records = listings(spark, sf).withColumns({n: F.expr(v) for n, v in DETAILS.items()}).drop("k")
    out = run_pipeline(records, OPTIONS).brief_stores
    of = lambda column, field: F.array_join(F.transform(column, lambda x: x[field]), ",")
    return out.select("cluster", "area", "category", "business_hours", "regular_holiday", F.col("raw")["name"].alias("primary_name"), "url", (F.col("is_chain") | F.col("chain_flag") | F.col("mall_flag")).alias("flagged"), F.array_join("exclude_reason", "|").alias("reasons"), of("raw_records", "source").alias("records"), merge.joined_codes(F.col("codes")).alias("codes"))


# --- Sorts and sinks ------------------------------------------------------------------------------------------------
@query("phone_first_topk", "select c_custkey as cluster, c_name as name, c_custkey % 4 <> 0 as has_phone from customer order by has_phone desc, c_custkey limit 50")
def _topk(spark, sf):
    phone = F.when(F.col("c_custkey") % 4 != 0, F.lit("03-1234-5678")).otherwise(F.when(F.col("c_custkey") % 8 == 0, F.lit(" \u3000")))
    rows = with_phone_flag(table(spark, sf, "customer").select(F.col("c_custkey").alias("cluster"), F.col("c_name").alias("name"), phone.alias("phone"), F.lit(0).alias("_part")))
    return phone_first(rows).limit(50).select("cluster", "name", F.col("_has_phone").alias("has_phone"))


@query("union_excluded", f"{RESOLVED_SQL}, ex as (select record_index, 0 as part from z where chain_flag union all select record_index, 1 from z where raw_address like 'NATION_1%') select part, 'rec_' || record_index as store_id, count(*) over (partition by record_index) as times from ex")
def _excluded(spark, sf):
    """Chain then mall exclusions as the exporter adds them; a record may be both, and comes twice then."""
    records = listings(spark, sf).withColumn("url", F.lit("")).drop("k")
    words = config.MallWords(strict=("nation_1",), floor_words=(), keywords=(), facilities=())
    done = run_pipeline(records, dataclasses.replace(OPTIONS, exclude_commercial_facilities=True, mall=words))
    return excluded_rows(done).select((F.col("_part") - 1).alias("part"), "store_id", F.count("*").over(Window.partitionBy("cluster")).alias("times"))


@query("export_projection", f"""{RESOLVED_SQL}, s as (select cluster, max(score) as score from m join x on left_idx = record_index group by cluster),
o as (select x.*, coalesce(score, 0) as score, row_number() over (partition by x.cluster order by {_rich}) as no, row_number() over (partition by x.cluster order by {_google}) as first, count(*) over (partition by x.cluster) as n from x left join s on x.cluster = s.cluster),
t as (select cluster, max(case when first = 1 then normalized_name end) as normalized_name, max(case when first = 1 then normalized_address end) as normalized_address, max(score) as score, max(n) as n, max(case when no = 1 then raw_name end) as name, max(case when no = 1 then source end) as source, max(case when no = 1 then url end) as url, max(case when no = 1 then raw_phone end) as phone from o group by cluster)
select name, source, url, phone, normalized_name, normalized_address, cast(score as varchar) as duplicate_score, 'false' as chain_flag, 'false' as mall_flag, case when n > 1 then 'duplicate' else '' end as exclude_reason from t
union all select raw_name, source, url, raw_phone, normalized_name, normalized_address, cast(k.points + h.points as varchar), 'true', 'false', 'chain_store' from z join k on normalized_name = k.a join h on normalized_name = h.a where chain_flag""")
def _export(spark, sf):
    """What the CSV holds of the whole run, exclusions among it: original columns of the richest record, then the added ones."""
    done = run_pipeline(listings(spark, sf).drop("k"), OPTIONS)
    return export_table(done, include_excluded=True).drop("lat", "lng", "address")
