"""Canonical records to normalised records; stateless, so it works on streams too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import normalize_address, normalize_name, normalize_phone, normalize_url, safe_number, text_or_empty
from .logs import log

INPUT_TEXT = ("name", "address", "phone", "url", "area", "category", "business_hours", "regular_holiday")


def run_time(options: config.Options):
    return F.lit(options.run_ts).cast("timestamp") if options.run_ts else F.current_timestamp()


def normalize_records(records: DataFrame, options: config.Options = config.Options()) -> DataFrame:  # noqa: B008
    """records: record_index and any canonical columns. Missing ones are empty, a missing source is `unknown`.

    Without raw and source_columns, the given columns are what they hold.
    """
    given = [c for c in records.columns if c != "record_index"]
    missing = {c: F.lit(None).cast("string") for c in (*INPUT_TEXT, "lat", "lng", "source") if c not in given}
    df = records.withColumns(missing) if missing else records
    if "raw" not in given:
        df = df.withColumn("raw", F.create_map(*(x for c in given for x in (F.lit(c), F.col(c).cast("string")))))
    if "source_columns" not in given:
        df = df.withColumn("source_columns", F.array(*(F.lit(c) for c in given)))
    text = {c: text_or_empty(F.col(c)) for c in INPUT_TEXT}
    df = df.select(
        "record_index",
        text["name"].alias("raw_name"),
        normalize_name(F.col("name"), options.remove_business_words).alias("normalized_name"),
        text["phone"].alias("raw_phone"),
        normalize_phone(F.col("phone")).alias("normalized_phone"),
        text["address"].alias("raw_address"),
        normalize_address(F.col("address"), options.strip_prefecture).alias("normalized_address"),
        safe_number(F.col("lat")).alias("lat"),
        safe_number(F.col("lng")).alias("lng"),
        text["url"].alias("url"),
        normalize_url(F.col("url")).alias("normalized_url"),
        F.lower(F.coalesce(F.col("source").cast("string"), F.lit("unknown"))).alias("source"),
        *(text[c].alias(c) for c in ("area", "category", "business_hours", "regular_holiday")),
        "source_columns",
        "raw",
    )
    names = ("raw_name", "normalized_name", "raw_phone", "normalized_phone", "raw_address", "normalized_address")
    camel = lambda n: n.split("_")[0] + n.split("_")[1].title()
    return df.withColumn("logs", F.array(log("normalize", "normalized_record", "正規化を実行", run_time(options), {camel(n): F.col(n) for n in names})))
