"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .avi import op8_avi
from .bpe import op7_bpe
from .chat import OP2_SQL, op2_chat
from .langid import op1_langid
from .mixing import OP6_SQL, op6_mixing
from .quality import OP10_SQL, op10_quality
from .sharding import op3_kdtree
from .simhash import op5_simhash
from .urlfilter import OP4_SQL, op4_urls
from .warc import OP9_SQL, op9_warc


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_langid": op1_langid, "op2_chat": op2_chat, "op8_avi": op8_avi, "op3_kdtree": op3_kdtree, "op4_urls": op4_urls, "op9_warc": op9_warc, "op5_simhash": op5_simhash, "op6_mixing": op6_mixing, "op7_bpe": op7_bpe, "op10_quality": op10_quality, "pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op4_urls": OP4_SQL, "op6_mixing": OP6_SQL, "op9_warc": OP9_SQL, "op10_quality": OP10_SQL}
