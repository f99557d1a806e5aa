"""The rule cascade over candidate pairs: phone, URL, exact, similar, distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.kernels import jaro_winkler_udf, to_fixed
from ..functions.text import haversine_meters, let


def first_numbers(address: Column) -> Column:
    """The first three runs of digits: block, lot and house."""
    return F.slice(F.regexp_extract_all(address, F.lit("([0-9]+)"), 1), 1, 3)


def same_numbers(left: Column, right: Column) -> Column:
    """Whether the first numbers of two addresses agree, as far as both have them."""

    def fit(n: Column) -> Column:
        shortest = F.least(F.size(n["l"]), F.size(n["r"]))
        return F.slice(n["l"], F.lit(1), shortest) == F.slice(n["r"], F.lit(1), shortest)

    return let(F.struct(first_numbers(left).alias("l"), first_numbers(right).alias("r")), fit)


def cascade(config_: config.DuplicateScoring = config.DuplicateScoring()) -> dict[str, Column]:  # noqa: B008
    """duplicate, score, reasons and matched_on, from l, r, name_sim, address_sim and distance of a pair."""
    s = config_
    same = lambda f: F.col(f"l.{f}") == F.col(f"r.{f}")
    phone = same("normalized_phone") & (F.col("l.normalized_phone") != "")
    url = same("normalized_url") & (F.col("l.normalized_url") != "")
    no_phone = (F.col("l.normalized_phone") == "") | (F.col("r.normalized_phone") == "")
    name, address, distance = F.col("name_sim"), F.col("address_sim"), F.col("distance")
    numbers_fit = same_numbers(F.col("l.normalized_address"), F.col("r.normalized_address"))
    near = F.coalesce(distance <= s.distance_meters, F.lit(False))
    alike = (name >= s.name_similarity) & (address >= s.address_similarity)
    by_phone = phone & (name >= s.phone_name_guard)
    exact = no_phone & same("normalized_name") & same("normalized_address")
    rules = [(by_phone, s.phone_match, "phone_match"), (url, s.url_match, "url_match"), (exact, s.name_address_exact, "name_and_address_exact_match"), (alike & numbers_fit, s.similarity_match, "similarity_match"), (near & (name >= s.distance_name_similarity), s.distance_match, "distance_and_name_match")]
    level = F.lit(0)
    for i, (rule, _, _) in reversed(list(enumerate(rules, 1))):
        level = F.when(rule, i).otherwise(level)
    score, verdict = F.lit(0), F.lit(None).cast("string")
    for i, (_, points, said) in enumerate(rules, 1):
        score, verdict = F.when(level == i, points).otherwise(score), F.when(level == i, said).otherwise(verdict)
    reasons = F.array_compact(
        F.array(
            F.when(phone & ~by_phone, "phone_match_rejected_name_mismatch"),
            # the fourth rule is looked at only where none before it holds
            F.when(((level == 0) | (level == 5)) & alike & ~numbers_fit, "similarity_match_rejected_different_address_numbers"),
            verdict,
        )
    )
    matched = F.struct(phone.alias("phone"), near.alias("distance"), (name >= s.name_similarity).alias("name"), url.alias("url"), (address >= s.address_similarity).alias("address"))
    return {"duplicate": level > 0, "score": score.cast("int"), "reasons": reasons, "matched_on": matched}


def same_phone(l: Column, r: Column) -> Column:  # noqa: E741
    return F.coalesce((l["normalized_phone"] == r["normalized_phone"]) & (l["normalized_phone"] != ""), F.lit(False))


def same_url(l: Column, r: Column) -> Column:  # noqa: E741
    return F.coalesce((l["normalized_url"] == r["normalized_url"]) & (l["normalized_url"] != ""), F.lit(False))


def could_match(l: Column, r: Column, options: config.DuplicateScoring) -> Column:  # noqa: E741
    """Whether two records without an equal phone or URL could match at all: they are neighbours or have equal house numbers."""
    near = F.coalesce(haversine_meters(l["lat"], l["lng"], r["lat"], r["lng"]) <= options.distance_meters, F.lit(False))
    return near | same_numbers(l["normalized_address"], r["normalized_address"])


def score_pairs(pairs: DataFrame, options: config.DuplicateScoring = config.DuplicateScoring()) -> DataFrame:  # noqa: B008
    """Match edges: pairs that a rule accepts, with similarities to four places and the distance to two.

    Most pairs of a block are told apart without comparing texts: without an equal phone or URL, only neighbours or equal
    house numbers can match. Of the rest names are compared, and addresses only where a rule could still accept.
    """
    s, l, r = options, F.col("l"), F.col("r")  # noqa: E741
    same = lambda f: F.col(f"l.{f}") == F.col(f"r.{f}")
    by_url, phone = same("normalized_url") & (F.col("l.normalized_url") != ""), same("normalized_phone")
    equal = same("normalized_name") & same("normalized_address")
    distance = haversine_meters(l["lat"], l["lng"], r["lat"], r["lng"])
    near = F.coalesce(distance <= s.distance_meters, F.lit(False))
    df = pairs.filter(by_url | phone | equal | near | same_numbers(l["normalized_address"], r["normalized_address"]))
    df = df.withColumn("name_sim", jaro_winkler_udf(l["normalized_name"], r["normalized_name"]))
    by_name = F.col("name_sim") >= min(s.name_similarity, s.distance_name_similarity)
    df = df.filter(by_url | phone & (F.col("name_sim") >= s.phone_name_guard) | by_name | equal)
    df = df.withColumn("address_sim", jaro_winkler_udf(l["normalized_address"], r["normalized_address"]))
    df = df.withColumn("distance", distance).withColumns(cascade(options))
    return _edges(df.filter("duplicate"))


def edges_by_url(pairs: DataFrame, options: config.DuplicateScoring = config.DuplicateScoring()) -> DataFrame:  # noqa: B008
    """The same for pairs with an equal URL and without an equal phone, on which the rule of URLs decides alone: nothing is
    compared for who reads points and reasons only."""
    l, r = F.col("l"), F.col("r")  # noqa: E741
    df = pairs.withColumn("name_sim", jaro_winkler_udf(l["normalized_name"], r["normalized_name"])).withColumn("address_sim", jaro_winkler_udf(l["normalized_address"], r["normalized_address"]))
    df = df.withColumn("distance", haversine_meters(l["lat"], l["lng"], r["lat"], r["lng"])).withColumn("matched_on", cascade(options)["matched_on"])
    return _edges(df.withColumns({"duplicate": F.lit(True), "score": F.lit(options.url_match), "reasons": F.array(F.lit("url_match"))}))


def _edges(df: DataFrame) -> DataFrame:
    places = lambda c, n: to_fixed(F.col(c), n).cast("double")
    return df.select("left_idx", "right_idx", "duplicate", "score", "reasons", places("name_sim", 4).alias("name_similarity"), places("address_sim", 4).alias("address_similarity"), places("distance", 2).alias("distance_meters"), "matched_on")
