"""Records that arrive as a stream: cleaning and classification in flight, resolution of what has arrived by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.kernels import BrandMatcher, match_brands
from ..functions.text import has_branch_suffix, has_chain_url, is_aeon_mall, is_menu_source, mall_pattern, mall_text
from ..operators.classify import review_count
from ..operators.normalize import normalize_records


def clean_stream(records: DataFrame, options: config.Options = config.Options()) -> DataFrame:  # noqa: B008
    """Normalised records; no state, no shuffle."""
    return normalize_records(records, options)


def score_stream(normalized: DataFrame, brands: list[str], heavy: DataFrame, options: config.Options = config.Options()) -> DataFrame:  # noqa: B008
    """Chain score and flag, and mall flag, as `classify` gives them, with a static snapshot (normalized_name) of the heavy
    brands of what came before."""
    c = options.chain
    matcher = normalized.sparkSession.sparkContext.broadcast(BrandMatcher(brands, frozenset(options.generic_words), c.similarity))
    df = normalized.withColumn("match", match_brands(F.col("normalized_name"), matcher))
    df = df.join(heavy.select("normalized_name", F.lit(True).alias("_heavy")), "normalized_name", "left")
    kind = F.col("match.kind")
    points = F.when(kind == "exact", c.exact_match).when(kind == "partial", c.partial_match).when(kind == "similar", c.similar_match).otherwise(0)
    points = points + F.when(has_chain_url(F.col("url")), c.url_pattern).otherwise(0) + F.when(F.col("_heavy"), c.occurrence).otherwise(0) + F.when(has_branch_suffix(F.col("raw_name")), c.name_suffix).otherwise(0)
    reviews = review_count(F.col("raw"))
    points = points + F.when(reviews >= c.high_review_from, c.high_review).when(reviews >= c.medium_review_from, c.medium_review).otherwise(0)
    df = df.withColumn("chain_score", F.when(F.col("normalized_name") == "", 0).otherwise(points)).drop("_heavy")
    df = df.withColumn("chain_flag", F.col("chain_score") >= c.chain_from)
    if options.exclude_commercial_facilities:
        df = df.withColumn("_text", mall_text(F.col("raw_name"), F.col("raw_address")))  # a column: lambdas can't hold a UDF
        return df.withColumn("mall_flag", mall_pattern(F.col("_text"), options.mall).isNotNull()).drop("_text")
    return df.withColumn("mall_flag", is_menu_source(F.col("source")) & is_aeon_mall(F.col("raw_name"), F.col("raw_address")))


def resolve_batches(stream: DataFrame, resolve: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch to `resolve`, e.g. to append it and run the batch pipeline."""
    return stream.writeStream.foreachBatch(resolve).option("checkpointLocation", checkpoint).start()
