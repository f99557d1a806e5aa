"""Sinks: CSV with the original columns, JSON, and the three report sheets."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Sequence
from datetime import datetime
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.text import trim_ws


def excluded_as_stores(records: DataFrame) -> DataFrame:
    """Excluded records in the columns of stores that exports read; the score is the chain score."""
    return records.select(
        F.coalesce(F.nullif("normalized_url", F.lit("")), F.concat(F.lit("rec_"), F.col("record_index").cast("string"))).alias("store_id"),
        F.col("raw_name").alias("name"), "normalized_name", F.col("raw_phone").alias("phone"), "normalized_phone", F.col("raw_address").alias("address"), "normalized_address",
        F.coalesce("chain_score", F.lit(0)).alias("duplicate_score"), "chain_flag", "mall_flag", "exclude_reason", "raw", F.col("record_index").alias("cluster"),
    )


EXPORTED = ("cluster", "store_id", "name", "normalized_name", "phone", "normalized_phone", "address", "normalized_address", "duplicate_score", "chain_flag", "mall_flag", "exclude_reason", "raw")


def excluded_rows(result) -> DataFrame:
    """Chain (_part 1), then mall exclusions (2); a record may be both, and comes twice then. Needs no pairs."""
    chains, malls = (excluded_as_stores(x).select(*EXPORTED).withColumn("_part", F.lit(i)) for i, x in enumerate((result.chain_excluded, result.mall_excluded), 1))
    return chains.unionByName(malls)


def export_rows(result, include_excluded: bool = False) -> DataFrame:
    """Stores (and, if wanted, chain then mall exclusions) with _part and cluster to order them; phones first."""
    stores = result.stores.select(*EXPORTED).withColumn("_part", F.lit(0))
    if include_excluded:
        stores = stores.unionByName(excluded_rows(result))
    else:
        stores = stores.filter("not chain_flag and not mall_flag")
    return with_phone_flag(stores)


def with_phone_flag(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_has_phone", trim_ws(F.coalesce("phone", F.lit(""))) != "")


def phone_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("_has_phone"), "_part", "cluster")


def raw_headers(rows: DataFrame) -> list[str]:
    """Original columns, reserved names left out, by the first row that has them and their place in it.

    As many as there are distinct column names, which the driver needs to name the output's columns anyway.
    """
    keys = rows.select("_part", "cluster", F.posexplode(F.map_keys("raw")).alias("at", "key"))
    firsts = keys.groupBy("key").agg(F.min(F.struct("_part", "cluster", "at")).alias("first"))
    return [r["key"] for r in firsts.orderBy("first").collect() if r["key"].strip().lower() not in config.RESERVED_EXPORT_COLUMNS]


def export_table(result, include_excluded: bool = False) -> DataFrame:
    """What the CSV holds, as a DataFrame of strings in output order."""
    rows = export_rows(result, include_excluded)
    raw = [F.coalesce(F.col("raw")[h], F.lit("")).alias(h) for h in raw_headers(rows)]
    flag = lambda c: F.when(F.col(c), "true").otherwise("false").alias(c)
    extra = [F.coalesce("normalized_name", F.lit("")).alias("normalized_name"), F.coalesce("normalized_address", F.lit("")).alias("normalized_address"), F.coalesce("duplicate_score", F.lit(0)).cast("string").alias("duplicate_score"), flag("chain_flag"), flag("mall_flag"), F.array_join("exclude_reason", "|").alias("exclude_reason")]
    return phone_first(rows).select(*raw, *extra)


#: Rows that text and workbooks made by the driver may have: as many as a sheet holds.
MAX_ROWS = 1 << 20


def _bounded(rows: DataFrame) -> DataFrame:
    """rows, or an error if there are too many for the driver; looks at one more than that."""
    if rows.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: write a folder with write_csv or write_json instead")
    return rows


def csv_text(table: DataFrame) -> str:
    """The whole CSV as text, for at most MAX_ROWS rows. Empty if there is no row."""
    rows = _bounded(table).collect()
    if not rows:
        return ""
    out = io.StringIO()
    quote = lambda v: '"' + v.replace('"', '""') + '"' if re.search('[,"\n]', v) else v
    out.write(",".join(table.columns))
    for r in rows:
        out.write("\n" + ",".join(quote("" if v is None else str(v)) for v in r))
    return out.getvalue()


def write_csv(table: DataFrame, path: str, single: bool = False) -> None:
    """A CSV folder: as many parts as the plan has, each with a header; one part if single."""
    (table.coalesce(1) if single else table).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


#: Keys of JSON documents that stay in snake case (fixed values); other columns are written in camel case.
SNAKE_KEYS = ("chain_flag", "mall_flag", "exclude_reason")


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return name if name in SNAKE_KEYS else head + "".join(x.title() for x in rest)


def _iso(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _documented(value: Column, kind: T.DataType) -> Column:
    """value with keys in camel case, times as ISO 8601 text, and `ts` of logs as `timestamp`; at any depth."""
    if isinstance(kind, T.TimestampType):
        return _iso(value)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda x: _documented(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.struct(*(_documented(value[f.name], f.dataType).alias("timestamp" if f.name == "ts" else _camel(f.name)) for f in kind))
    return value


def documents(result) -> dict[str, DataFrame]:
    """summary, stores, chainExcluded, mallExcluded and duplicateMatches, in the order and with the keys of JSON output."""
    e = result.duplicate_matches
    pair = F.concat_ws(":", F.least("left_idx", "right_idx").cast("string"), F.greatest("left_idx", "right_idx").cast("string"))
    evaluation = F.struct(pair.alias("pair_key"), *(c for c in e.columns if c not in ("left_idx", "right_idx")))
    matches = e.orderBy("left_idx", "right_idx").select(F.col("left_idx").alias("left_index"), F.col("right_idx").alias("right_index"), evaluation.alias("evaluation"))
    frames = {"summary": result.summary, "stores": result.stores.orderBy("cluster").drop("cluster"), "chain_excluded": result.chain_excluded.orderBy("record_index"), "mall_excluded": result.mall_excluded.orderBy("record_index"), "duplicate_matches": matches}
    return {_camel(n): df.select(*(_documented(F.col(f"`{f.name}`"), f.dataType).alias(_camel(f.name)) for f in df.schema)) for n, df in frames.items()}


#: Keys that are written as null where there is nothing; others are left out then (fixed values).
NULL_KEYS = {"stores": ("lat", "lng"), "chainExcluded": ("lat", "lng"), "mallExcluded": ("lat", "lng")}


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, distributed."""
    df.write.mode("overwrite").json(path)


def json_text(result) -> str:
    """The whole result as one pretty-printed document, for at most MAX_ROWS rows of each list."""
    found = documents(result)
    out: dict = {"summary": json.loads(found["summary"].toJSON().first())}
    for name in list(found)[1:]:
        rows = [json.loads(x) for x in _bounded(found[name]).toJSON().collect()]
        for r in rows:
            for key in NULL_KEYS.get(name, ()):
                r.setdefault(key, None)
            if "evaluation" in r:
                r["evaluation"].setdefault("distanceMeters", None)
            if "chainDecision" in r:
                r["chainDecision"].setdefault("matchedChainName", None)
        out[name] = rows
    return json.dumps(out, ensure_ascii=False, indent=2) + "\n"


def export_file_name(inputs: Sequence[str], extension: str, now: datetime) -> str:
    """What a download is called: the first input's name without its platform words, and the minute."""
    parts = [p for p in re.split("[" + config.FILE_NAME_BREAKS + "]+", inputs[0].split(".")[0]) if p] if inputs else []
    kept = [p for p in parts if not any(w in p.lower() for w in config.FILE_NAME_IGNORED)]
    prefix = f"{'_'.join(kept) or '店舗'}_重複統合結果" if inputs else "店舗統合結果"
    return f"{prefix}_{now:%Y%m%d_%H%M}.{extension}"


def report_sheets(result) -> dict[str, DataFrame]:
    """Three sheets: merged stores, the records that merging absorbed, and exclusions."""
    stores, size = result.stores, F.size("raw_records")
    merged = stores.orderBy("cluster").select(
        F.col("store_id").alias("店舗ID"), F.col("name").alias("店名"), F.col("area").alias("エリア"), F.col("category").alias("ジャンル"), F.col("phone").alias("電話番号"), F.col("address").alias("住所"),
        F.when(size > 1, "あり").otherwise("なし").alias("重複"), size.alias("統合された店舗数"), F.col("lat").alias("緯度"), F.col("lng").alias("経度"), F.col("url").alias("URL"),
        F.array_join("sources", " | ").alias("ソース"), F.col("duplicate_score").alias("最高重複スコア"),
    )
    absorbed = stores.filter(size > 1).select("cluster", "store_id", "name", F.posexplode("raw_records").alias("at", "r")).filter("at > 0").orderBy("cluster", "at")
    match = F.get(F.filter("r.logs", lambda x: x["code"] == "duplicate_match"), F.lit(0))
    absorbed = absorbed.select(
        F.col("r.name").alias("店名"), F.col("r.area").alias("エリア"), F.col("r.category").alias("ジャンル"), F.col("r.phone").alias("電話番号"), F.col("r.address").alias("住所"), F.col("r.url").alias("URL"), F.col("r.source").alias("ソース"),
        match["score"].alias("判定スコア"), F.coalesce(match["meta"]["reasons"], F.lit("")).alias("判定理由"), F.col("store_id").alias("統合先店舗ID"), F.col("name").alias("統合先店名"),
    )
    both = result.chain_excluded.withColumn("_part", F.lit(0)).unionByName(result.mall_excluded.withColumn("_part", F.lit(1))).orderBy("_part", "record_index")
    entry = lambda code: F.get(F.filter("logs", lambda x: x["code"] == code), F.lit(0))
    chain, aeon, mall = entry("excluded_chain"), entry("excluded_aeon_mall"), entry("excluded_commercial_facility")
    filled = lambda c: F.nullif(c, F.lit(""))
    excluded = both.select(
        F.col("raw_name").alias("店名(生)"), F.col("area").alias("エリア"), F.col("category").alias("ジャンル"), F.col("normalized_name").alias("正規化店名"), F.col("raw_phone").alias("電話番号"), F.col("raw_address").alias("住所"), F.col("url").alias("URL"), F.col("source").alias("ソース"),
        F.coalesce(filled(chain["meta"]["matchedChainName"]), F.when(aeon.isNotNull(), "イオンモール"), filled(mall["meta"]["matchedFacility"]), F.lit("")).alias("該当チェーン名"),
        F.coalesce(filled(chain["meta"]["matchType"]), F.when(aeon.isNotNull(), "イオンモール除外"), F.when(mall.isNotNull(), "商業施設除外"), F.lit("")).alias("判定タイプ"),
    )
    return {"統合データ": merged, "重複排除済み": absorbed, "除外リスト": excluded}


def write_xlsx(sheets: dict[str, DataFrame], path: str) -> None:
    """A minimal workbook with inline strings, written by the driver, for at most MAX_ROWS rows a sheet."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i, _ in enumerate(sheets, 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            rows = [df.columns, *_bounded(df).collect()]
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
