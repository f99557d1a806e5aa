"""Language identification by compression with per-language zstandard raw-content dictionaries.

A text belongs to the language whose dictionary makes it smallest. Null texts and texts without a letter are `und`
with score 0 and are never accepted. Ties go to the language that sorts first, with score 0. Repeated rows get equal
predictions. Very long texts are compressed whole, piece by piece. Extra columns pass through `classify`, but those named as
a result column are replaced by it. Without a single usable training row everything is `und`; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORD = re.compile(r"[^\W\d_]+")
#: Whole texts are compressed in pieces of this many bytes, so that a long text can't live on its own repeats alone.
PIECE = 1 << 14
LEVEL = 3


def letters(text: str | None) -> bytes:
    """What is compressed: the text's words of letters in lower case. Empty if it has none."""
    return " ".join(WORD.findall(text.lower())).encode() if text else b""


def train(docs: DataFrame, rows: int = 300, chars: int = 1000, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary for each non-null language, from a bounded sample.

    The bound: about `rows` labelled rows a language, picked by a hash of their text, and of each a window of at most
    `chars` characters whose place the same hash decides. So what reaches the driver is some `rows * chars` characters
    for each language, whatever the size of the corpus. The sample is drawn in two passes: a count, then one hash
    threshold for each language; no pass sorts or moves the corpus.
    """
    rows_in = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    counts = {x["lang"]: x["n"] for x in rows_in.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (rows + 4 * rows**0.5) / n))))
    hashed = rows_in.filter("text is not null").withColumn("h", F.xxhash64("text"))
    picked = hashed.filter(F.shiftrightunsigned("h", 11) < share[F.col("lang")] * F.lit(float(1 << 53)))
    at = F.pmod("h", F.greatest(F.length("text") - F.lit(chars) + 1, F.lit(1)).cast("long")).cast("int")
    picked = picked.select("lang", "h", F.substring(F.col("text"), at + 1, F.lit(chars)).alias("text")).distinct()
    first = picked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= rows)
    found: dict[str, list[tuple[int, str]]] = {}
    for x in first.collect():
        found.setdefault(x["lang"], []).append((x["rank"], x["text"]))
    contents = {lang: b" ".join(letters(t) for _, t in sorted(texts)) for lang, texts in sorted(found.items())}
    return {lang: content for lang, content in contents.items() if content.strip()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.packers = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=0, write_content_size=0, write_dict_id=0, min_match=3)
            content.precompute_compress(compression_params=params)
            self.packers.append(zstandard.ZstdCompressor(dict_data=content, compression_params=params))

    def __call__(self, text: str | None) -> tuple[str, float, int]:
        """Language, score (by how much the runner-up is larger, relative to it) and margin in bytes."""
        data = letters(text)
        if not data or not self.langs:
            return "und", 0.0, 0
        sizes = [sum(len(p.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for p in self.packers]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, sizes[0]
        second = min(x for i, x in enumerate(sizes) if i != best)
        return self.langs[best], (second - sizes[best]) / second, second - sizes[best]


_KEPT: dict[int, Classifier] = {}


def _classifier(dictionaries: dict[str, bytes]) -> Classifier:
    """One for each worker and set of dictionaries; workers are used again from task to task."""
    key = hash(tuple(sorted(dictionaries.items())))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Classifier(dictionaries)
    return _KEPT[key]


SAID = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.LongType())])


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: int = 1, min_score: float = 0.005) -> DataFrame:
    """docs with lang_pred, score, margin and accepted: false for `und` and for margins that are narrow. Columns of docs with
    these names are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    # an Arrow UDF: only texts go to the worker and only verdicts come back; nondeterministic for the optimizer, which
    # would else run it again for each filter by a verdict
    @F.arrow_udf(SAID)
    def judge(texts: pa.Array) -> pa.Array:
        judge_one = _classifier(model.value)
        said = [judge_one(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in said], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64()))], names=["lang_pred", "score", "margin"])

    said = docs.withColumn("_langid", judge.asNondeterministic()(F.col(text_col)))
    out = said.withColumns({c: F.col(f"_langid.{c}") for c in ("lang_pred", "score", "margin")}).drop("_langid")
    accepted = (F.col("lang_pred") != "und") & (F.col("margin") >= min_margin) & (F.col("score") >= min_score)
    return out.withColumn("accepted", accepted)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of documents that nothing may be learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    dictionaries = train(docs.filter(~held_out()))
    said = classify(docs.select("doc_id", "text"), dictionaries)
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")
