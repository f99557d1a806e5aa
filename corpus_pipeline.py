"""The corpus pipeline: documents to token ids, in stages that each call one operator of mizuhiki.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of docs;
the last returns token ids. A stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizuhiki.llm import bpe, langid, mixing, quality, simhash
from mizuhiki.session import discard, materialize, materialize_alone, ship

#: SQL can express neither compression, nor min-hashes over whole texts, nor byte-level BPE.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null and empty texts among them, and those whose language is a narrow call.

    Very long texts are judged whole; a tie is a margin of none, so it is dropped. Repeated rows fare alike, and columns
    of any name pass. Of an empty table nothing is learned and nothing is left.
    """
    dictionaries = langid.train(docs.filter(~langid.held_out()))
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    return langid.classify(rows, dictionaries, "_text").filter("accepted").select("_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a fence of their language and source.

    Null and empty texts have too few words; null languages and sources are groups of their own. Very long texts are
    measured whole, a ratio that ties with a fence is kept, repeated rows fare alike, and columns of any name pass. An empty
    table has no fences and stays empty. Measures are written once with their rows, as they cost more than that.
    """
    packed = docs.select(F.struct("*").alias("_row"), "text", "lang", "source")
    measured = materialize(quality.measures(packed).drop("text"), "measures")
    return quality.judge(measured, quality.fences(measured)).filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts with a similarity of 0.8 or more on five-word shingles.

    Candidates are SimHash classes, and bands of min-hashes beside them; all are verified with the whole shingle sets.

    All texts without a word, null ones among them, are one group. Of a group the row of the least doc_id stays (nulls
    first, ties by a digest of the text); of rows with both in common one. Very long texts are compared whole. Columns of
    any name pass; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources weigh the same, in a globally random order.

    A null source is one of its own, a null doc_id counts as empty text; rows of equal doc_id, repeated rows among them, are
    repeated alike. Texts of any length, null and empty ones, and columns of any name pass; an empty table stays empty.
    """
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "source")
    return mixing.mix(packed).select("_row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text.

    Null and empty texts have no ids; very long ones are encoded whole. Repeated rows get equal ids, and the unique last
    token of each prefix leaves no ties. Other columns than those of documents are left out, so none can clash; an empty
    table gives an empty result.
    """
    content = bpe.vocabulary()
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), content, decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), same.alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of sf_dir; what a stage wrote besides its result is deleted when that is written."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
