"""Session helpers: importable workers and a scratch folder that every executor can see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)
_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it runs from a checkout (a cluster uses --py-files)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only for a local master that names none."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="mizuhiki-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return f"file://{_LOCAL['dir']}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder, below one folder for each application, which can go when the application ends."""
    path = f"{scratch_root(spark)}/mizuhiki-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the scratch folder and read it back: lineage ends there, and lost executors cost only a reread."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._mizuhiki_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df; only once nothing reads it any more."""
    path = getattr(df, "_mizuhiki_path", None)
    if path:
        _delete(df.sparkSession, path)


_WRITTEN: list[list[str]] = []


def materialize_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make(), written as by materialize(); all else that was written to the scratch folder meanwhile is deleted."""
    _WRITTEN.append([])
    try:
        back = materialize(make(), label)
    finally:
        paths = _WRITTEN.pop()
    for path in paths:
        if path != back._mizuhiki_path:
            _delete(spark, path)
    return back
