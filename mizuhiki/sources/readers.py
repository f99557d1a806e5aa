"""Scans: CSV, JSON and chain masters, with charset detection and per-file error handling."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import SNIFFED, sniff_charset
from ..functions.text import trim_ws
from ..session import materialize, scratch_path
from .mapping import map_columns

BOM = chr(0xFEFF)
_LISTED_CHARSETS = ("iso-8859-1", "us-ascii", "utf-8", "utf-16be", "utf-16le", "utf-16", "utf-32")


def _suffix(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def _stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _strip_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.removeprefix(BOM).strip() for c in df.columns)) if df.columns else df


def _head(spark: SparkSession, path: str) -> bytes:
    """The first SNIFFED bytes of a file, or of the first data file of a folder; no more is read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.getFileStatus(at).isDirectory():
        inside = sorted(str(x.getPath()) for x in files.listStatus(at) if x.getPath().getName()[0] not in "._" and x.getLen())
        if not inside:
            return b""
        at = jvm.org.apache.hadoop.fs.Path(inside[0])
    stream = files.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, SNIFFED)))
    finally:
        stream.close()


def file_charset(spark: SparkSession, path: str) -> str:
    """Sniffed from the first bytes of the file."""
    return sniff_charset(_head(spark, path))


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """All cells as trimmed strings; ragged rows get nulls, empty lines are skipped. An empty file has no rows.

    encoding: a charset, or `auto` to sniff it. One that Spark doesn't list, such as shift_jis, sets the session's
    spark.sql.legacy.javaCharsets, as files are read when a query runs.
    """
    charset = file_charset(spark, path) if encoding == "auto" else encoding
    if charset not in _LISTED_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else Spark reads only the listed ones
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "PERMISSIVE", "encoding": charset, "inferSchema": False}
    df = _strip_bom(spark.read.options(**options).csv(path))
    return df.select(*(trim_ws(F.col(f"`{c}`")).alias(c) for c in df.columns))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, or an object with one in `records`; anything else has no rows. Bad syntax is an error. Blanks
    before the first bracket may take up to SNIFFED bytes."""
    first = _head(spark, path).removeprefix(BOM.encode()).lstrip()[:1]
    if not first:
        return spark.createDataFrame([], "name string")
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if first == b"{":
        if "records" not in df.columns or not df.schema["records"].dataType.simpleString().startswith("array<struct"):
            return spark.createDataFrame([], "name string")
        df = df.select(F.explode("records").alias("r")).select("r.*")
    return df


def read_source(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    kind = _suffix(path)
    if kind == "csv":
        return read_csv(spark, path, encoding)
    if kind == "json":
        return read_json(spark, path)
    raise ValueError(f"Unsupported input format: {path}")


def load_records(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8", on_error: str = "raise", names: Sequence[str] | None = None) -> DataFrame:
    """Canonical records of all files, in order; rows without a name are dropped, record_index counts the rest from 0.

    on_error: `raise`, or `skip` to go on without a file that can't be read. names: what each file is called, if not as its
    path ends; a file's name tells the source of records that don't.
    """
    frames = []
    for i, path in enumerate(paths):
        try:
            df = read_source(spark, path, encoding)
            if not df.columns:
                continue
            mapped = map_columns(df, names[i] if names else _stem(path)).filter(trim_ws(F.col("name")) != "")
            frames.append(mapped.withColumn("_file", F.lit(i)).withColumn("_row", F.monotonically_increasing_id()))
        except Exception as e:
            if on_error != "skip":
                raise ValueError(f"{path}: {e}") from e
    if not frames:
        raise ValueError("no file has any rows")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    # written, as the index needs two passes over rows that keep their numbers
    return with_index(materialize(out, "records"), "_file", "_row").drop("_file", "_row")


def load_uploads(spark: SparkSession, uploads: Sequence[tuple[str, bytes]]) -> DataFrame:
    """Records of uploaded files (name, content), all read as CSV in the charset that each seems to have.

    Files that can't be read are left out; without any record there is an error. The file's name tells the source of
    records that don't.
    """
    if not uploads:
        raise ValueError("no files")
    folder = scratch_path(spark, "uploads")
    jvm = spark.sparkContext._jvm
    paths = []
    for i, (_, content) in enumerate(uploads):
        text = content.decode(sniff_charset(content), "replace").removeprefix(BOM)
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{i}.csv")
        out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at)
        out.write(text.encode())
        out.close()
        paths.append(at.toString())
    records = load_records(spark, paths, on_error="skip", names=[_stem(name) for name, _ in uploads])
    if records.isEmpty():
        raise ValueError("no file has any records")
    return records


def with_index(df: DataFrame, file_col: str, row_col: str) -> DataFrame:
    """df with record_index, 0, 1, ... by file and row, without sorting df: only counts of (file, partition) are summed."""
    part = F.shiftright(row_col, 33).alias("_part")
    sizes = df.groupBy(file_col, part).agg(F.count("*").alias("_n"), F.min(row_col).alias("_first"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(file_col, "_part")) - F.col("_n")).drop("_n")
    # rows that a filter dropped leave gaps in row_col, so places within a partition are counted
    place = F.row_number().over(Window.partitionBy(file_col, "_part").orderBy(row_col)) - 1
    placed = df.withColumn("_part", F.shiftright(row_col, 33)).withColumn("_place", place)
    return placed.join(F.broadcast(before), [file_col, "_part"]).withColumn("record_index", (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before", "_first")


def load_chain_names(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A chain master, in its order: a JSON array, an object with one in `chains`, or the first column of a CSV.

    Small by nature (one entry a brand); it is matched through a broadcast dictionary.
    """
    kind = _suffix(path)
    if kind == "json":
        content = json.loads(spark.read.text(path, wholetext=True).first()["value"].removeprefix(BOM))
        names = content if isinstance(content, list) else content.get("chains", []) if isinstance(content, dict) else []
    elif kind == "csv":
        df = read_csv(spark, path)
        names = [r[0] for r in df.select(df.columns[0]).collect()] if df.columns else []
    else:
        raise ValueError(f"Unsupported chain master: {path}")
    return tuple(str(n).strip() for n in names if n is not None and str(n).strip())
