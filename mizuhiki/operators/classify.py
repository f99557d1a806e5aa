"""Chain stores and mall tenants: signals, scores, flags and the three-way split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.kernels import BrandMatcher, match_brands, to_fixed
from ..functions.text import has_branch_suffix, has_chain_url, is_aeon_mall, is_menu_source, let, mall_pattern, mall_text, normalize_name, safe_number
from ..sources.mapping import _key
from .logs import log, when_log
from .normalize import run_time


def heavy_brands(records: DataFrame, threshold: int = 5) -> DataFrame:
    """(normalized_name, n): names that at least `threshold` rows have. Partial counts precede the shuffle."""
    return records.filter(F.col("normalized_name") != "").groupBy("normalized_name").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)


def master_brands(spark, names, remove_business_words: bool = False) -> list[str]:
    """Normalised brands in the order of the master; repeated and empty ones dropped. As small as its argument."""
    if not names:
        return []
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(names))), "ord int, brand string")
    df = df.select("ord", normalize_name(F.col("brand"), remove_business_words).alias("brand")).filter("brand <> ''")
    return [r["brand"] for r in df.groupBy("brand").agg(F.min("ord").alias("ord")).orderBy("ord").collect()]


def brand_matches(records: DataFrame, brands: list[str], options: config.Options) -> DataFrame:
    """(normalized_name, match): one row for each distinct name, so that no name is compared twice."""
    spark = records.sparkSession
    matcher = spark.sparkContext.broadcast(BrandMatcher(brands, frozenset(options.generic_words), options.chain.similarity))
    names = records.select("normalized_name").filter("normalized_name <> ''").distinct()
    return names.withColumn("match", match_brands(F.col("normalized_name"), matcher))


def review_count(raw: Column) -> Column:
    """The first review column of a record that is there and holds a number; 0 without one."""
    wanted = [_key(name) for name in config.REVIEW_COLUMNS]

    def number(entry: Column) -> Column:
        value = F.coalesce(F.trim(entry["value"]), F.lit(""))
        return safe_number(F.when(value == "", "0").otherwise(value))

    def count(entries: Column) -> Column:
        of = lambda name: F.get(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == F.lit(name)), F.lit(0))
        return F.coalesce(*(let(of(name), lambda e: F.when(e.isNotNull(), number(e))) for name in wanted), F.lit(0.0))

    # most records have no such column: its names are looked for once
    listed = F.filter(F.map_entries(F.coalesce(raw, F.create_map().cast("map<string,string>"))), lambda e: F.lower(F.trim(e["key"])).isin(wanted))
    return let(listed, lambda entries: F.when(F.size(entries) == 0, 0.0).otherwise(count(entries)))


def classify(records: DataFrame, brands: list[str], options: config.Options = config.Options()) -> DataFrame:  # noqa: B008
    """records with chain_score, chain_flag, mall_flag, exclude_reason, chain_decision and longer logs."""
    c = options.chain
    heavy = heavy_brands(records, c.occurrence_from).select("normalized_name", F.lit(True).alias("_heavy"))
    lookup = brand_matches(records, brands, options).join(heavy, "normalized_name", "left") if brands else None
    if lookup is None:
        lookup = heavy.withColumn("match", F.lit(None).cast("struct<kind:string,brand:string,similarity:double>"))
    df = records.join(lookup, "normalized_name", "left")
    kind = F.coalesce(F.col("match.kind"), F.lit("none"))
    sim = F.coalesce(F.col("match.similarity"), F.lit(0.0))
    named = F.col("normalized_name") != ""
    reviews = review_count(F.col("raw"))
    signals = [
        (kind == "exact", c.exact_match, F.lit("exact_brand_match")),
        (kind == "partial", c.partial_match, F.lit("partial_brand_match")),
        (kind == "similar", c.similar_match, F.concat(F.lit("similar_brand_match ("), F.coalesce(to_fixed(sim, 2), F.lit("")), F.lit(")"))),
        (has_chain_url(F.col("url")), c.url_pattern, F.lit("chain_url_pattern")),
        (F.coalesce("_heavy", F.lit(False)), c.occurrence, F.lit("high_frequency_name")),
        (has_branch_suffix(F.col("raw_name")), c.name_suffix, F.lit("branch_suffix_pattern")),
        (reviews >= c.high_review_from, c.high_review, F.lit("reviews_500_plus")),
        ((reviews < c.high_review_from) & (reviews >= c.medium_review_from), c.medium_review, F.lit("reviews_200_plus")),
    ]
    df = df.withColumn("_hits", F.array(*(named & hit for hit, _, _ in signals)))
    hit = lambda i: F.col("_hits")[i]
    score = F.lit(0)
    for i, (_, points, _) in enumerate(signals):
        score = score + F.when(hit(i), points).otherwise(0)
    reasons = F.filter(F.array(*(F.when(hit(i), said) for i, (_, _, said) in enumerate(signals))), lambda x: x.isNotNull())
    df = df.withColumn("chain_score", score.cast("int")).withColumn("_reasons", F.when(named, reasons).otherwise(F.array(F.lit("empty_name"))))
    decision = F.struct(
        (F.col("chain_score") >= c.chain_from).alias("is_chain"),
        F.col("match.brand").alias("matched_chain_name"),
        kind.alias("match_type"),
        F.when(sim > 0, to_fixed(sim, 4).cast("double")).alias("similarity"),
        F.col("_reasons").alias("reasons"),
    )
    df = df.withColumn("chain_decision", decision).withColumn("chain_flag", F.col("chain_decision.is_chain")).drop("_hits", "_heavy", "match", "_reasons")
    return _exclusions(df, options)


def _exclusions(df: DataFrame, options: config.Options) -> DataFrame:
    ts = run_time(options)
    if options.exclude_commercial_facilities:
        df = df.withColumn("_text", mall_text(F.col("raw_name"), F.col("raw_address")))  # a column: lambdas can't hold a UDF
        df = df.withColumn("_mall", mall_pattern(F.col("_text"), options.mall)).drop("_text")
        mall_flag = F.col("_mall").isNotNull()
        mall_log = log("mall", "excluded_commercial_facility", "商業施設内店舗除外", ts, {"matchedFacility": F.col("_mall"), "rawName": F.col("raw_name"), "rawAddress": F.col("raw_address")})
    else:
        df = df.withColumn("_mall", F.lit(None).cast("string"))
        mall_flag = is_menu_source(F.col("source")) & is_aeon_mall(F.col("raw_name"), F.col("raw_address"))
        mall_log = log("mall", "excluded_aeon_mall", "イオンモール除外（ロケットナウ・メニュー案件）", ts, {"source": F.col("source"), "rawName": F.col("raw_name"), "rawAddress": F.col("raw_address")})
    d, score = F.col("chain_decision"), F.col("chain_score")
    detected = log("chain", "chain_detected", F.concat(F.lit("チェーン店判定 (Score: "), score.cast("string"), F.lit(")")), ts, {"chainScore": score, "matchedChainName": d["matched_chain_name"], "matchType": d["match_type"], "reasons": F.array_join(d["reasons"], ",")})
    excluded = log("exclude", "excluded_chain", "チェーン店として除外", ts, {"matchedChainName": d["matched_chain_name"], "matchType": d["match_type"], "chainScore": score})
    df = df.withColumn("mall_flag", mall_flag)
    chain = F.col("chain_flag")
    logs = F.concat("logs", when_log(F.col("mall_flag"), mall_log), when_log(chain, detected), when_log(chain, excluded))
    reasons = F.array_compact(F.array(F.when(F.col("mall_flag"), "mall_tenant"), F.when(chain, "chain_store")))
    return df.withColumn("logs", logs).withColumn("exclude_reason", reasons).drop("_mall")


@dataclass(frozen=True)
class Routed:
    """A record may be in both excluded lists; candidates are in neither."""

    chain_excluded: DataFrame
    mall_excluded: DataFrame
    candidates: DataFrame


def route(classified: DataFrame) -> Routed:
    return Routed(classified.filter("chain_flag"), classified.filter("mall_flag"), classified.filter("not chain_flag and not mall_flag"))
