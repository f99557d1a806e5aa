"""Sharding by a k-d tree over metadata: nodes split at distributed weighted medians along their widest dimension.

Weights are bytes: of the text in UTF-8 (null: none; of any length) plus a fixed overhead a row. Null metadata sort first,
one below the least value of their dimension. Ties, repeated rows among them, are told apart by a number that is written
once, so every split can fall between any two rows. Extra columns are ignored, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import discard, materialize

OVERHEAD = 8
#: Bins for each node in a histogram pass; a bin with so few rows is sorted instead; rows of a node that one task finishes;
#: rows in a run of slots. What a task holds at most, and nothing of it reaches the driver.
BINS, FEW, LOCAL, RUN = 4096, 20_000, 50_000, 100_000
#: Tables with a row for each node are broadcast up to so many nodes (some 10 MB).
MAX_BROADCAST = 50_000
MIN_LONG = -(1 << 63)


def _nodes_joined(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Many nodes are shuffled: as nodes of one level weigh nearly the same, none has many of all rows by then."""
    return rows.join(F.broadcast(nodes) if n <= MAX_BROADCAST else nodes, "node")


def _widest(dims: int, spans: Sequence[float]) -> Column:
    """The dimension in which a node's part of the whole span is greatest; the first of equals."""
    extent = lambda d: (F.col(f"max{d}").cast("double") - F.col(f"min{d}").cast("double")) / F.lit(max(spans[d], 1.0))
    return -F.array_max(F.array(*(F.struct(extent(d).alias("w"), F.lit(-d).alias("d")) for d in range(dims))))["d"]


def _cuts(rows: DataFrame, stats: DataFrame, dims: int, spans: Sequence[float], bins: int, few: int) -> DataFrame:
    """(node, leaves, dim, value, tie): the last row that goes left, of each node of stats.

    A node's rows are ordered by its widest dimension, then tie. Its lower leaves // 2 leaves are to have their part of its
    bytes, so the cut is at one end, the nearer one, of the first row with which the sum reaches that. Histogram passes
    narrow the range of rows that this row may be in, for all nodes at once, until it has few rows; these are sorted.
    """
    pick = lambda name, dim: F.element_at(F.array(*(F.col(f"{name}{d}") for d in range(dims))), dim + 1)
    dim = _widest(dims, spans)
    aim = F.col("bytes").cast("double") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    state = stats.select("node", "leaves", dim.alias("dim"), pick("min", dim).alias("low"), pick("max", dim).alias("high"), F.lit(0).cast("long").alias("tlow"), F.lit((1 << 63) - 1).alias("thigh"), F.col("n").alias("left"), F.lit(0).cast("long").alias("below"), aim.alias("aim"))
    state = materialize(state, "shard-cuts")
    inside = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")) & ((F.col("low") < F.col("high")) | (F.col("tie") >= F.col("tlow")) & (F.col("tie") <= F.col("thigh")))
    nodes = state.count()

    def candidates(of: DataFrame) -> DataFrame:
        joined = _nodes_joined(rows.drop("leaves"), of, nodes).withColumn("v", F.element_at("at", F.col("dim") + 1))
        return joined.filter(inside)

    at_end = state.filter(F.col("left") <= few)
    wide = state.filter(F.col("left") > few)
    parts = []
    while True:
        parts.append(at_end)
        if wide.isEmpty():
            break
        # bins by any function that never decreases will do: doubles, but whole numbers where a difference has few bits
        tied = F.col("low") == F.col("high")
        x, a, b = (F.when(tied, F.col(t)).otherwise(F.col(v)) for t, v in (("tie", "v"), ("tlow", "low"), ("thigh", "high")))
        span = b.cast("double") - a.cast("double")
        narrow = span < float(1 << 52)
        step = F.when(narrow, F.floor(span / bins) + 1).otherwise(span / bins)
        offset = F.when(narrow, (F.greatest(x, a) - F.when(narrow, a).otherwise(0)).cast("double")).otherwise(x.cast("double") - a.cast("double"))
        binned = candidates(wide).select(*state.columns, F.floor(offset / step).cast("long").alias("bin"), "v", "tie", "size")
        sums = binned.groupBy(*state.columns, "bin").agg(F.sum("size").alias("bytes"), F.count("*").alias("k"), *(f(c).alias(f"{n}{c}") for c in ("v", "tie") for n, f in (("min", F.min), ("max", F.max))))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin")) + F.col("below")
        last = F.max("bin").over(Window.partitionBy("node")) == F.col("bin")
        found = sums.withColumns({"upto": upto, "last": last}).filter((F.col("upto") >= F.col("aim")) | F.col("last"))
        found = found.withColumn("no", F.row_number().over(Window.partitionBy("node").orderBy("bin"))).filter("no = 1")
        now = found.select("node", "leaves", "dim", F.col("minv").alias("low"), F.col("maxv").alias("high"), F.col("mintie").alias("tlow"), F.col("maxtie").alias("thigh"), F.col("k").alias("left"), (F.col("upto") - F.col("bytes")).alias("below"), "aim")
        now = materialize(now, "shard-cuts")
        done = (F.col("left") <= few) | (F.col("low") == F.col("high")) & (F.col("tlow") == F.col("thigh"))
        at_end, wide = now.filter(done), now.filter(~done)
    final = parts[0]
    for p in parts[1:]:
        final = final.unionByName(p)
    order = Window.partitionBy("node").orderBy("v", "tie")
    sums = candidates(final).withColumns({"upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("below")})
    # of rows that are wholly left of where the sum reaches the aim, and of the next one if it's nearer with it, the last
    goes = (F.col("upto") <= F.col("aim")) | (F.col("upto") - F.col("aim") < F.col("aim") - (F.col("upto") - F.col("size")))
    cut = F.max(F.when(goes, F.struct("v", "tie")))
    # none goes left: the cut is just before the first one
    first = F.min(F.struct("v", (F.col("tie") - 1).alias("tie")))
    return sums.groupBy("node", "leaves", "dim").agg(F.coalesce(cut, first).alias("c")).select("node", "leaves", "dim", "c.v", F.col("c.tie").alias("cut_tie")).withColumnRenamed("v", "cut")


def split_here(values: np.ndarray, tie: np.ndarray, size: np.ndarray, first: int, leaves: int, spans: Sequence[float]) -> np.ndarray:
    """The leaf of each row of a node, by the same rule as `_cuts`; values: a column for each dimension."""
    out = np.empty(len(size), np.int64)
    todo = [(np.arange(len(size)), first, leaves)]
    while todo:
        rows, first, leaves = todo.pop()
        if leaves == 1 or not len(rows):
            out[rows] = first
            continue
        at = values[rows]
        extent = (at.max(axis=0).astype(float) - at.min(axis=0).astype(float)) / np.maximum(spans, 1.0)
        order = np.lexsort((tie[rows], at[:, int(np.argmax(extent))]))
        sums = np.cumsum(size[rows][order])
        aim = float(sums[-1]) * (leaves // 2) / leaves
        k = int(np.searchsorted(sums, aim, "right"))
        if k < len(rows) and sums[k] - aim < aim - (sums[k] - size[rows[order[k]]]):
            k += 1
        half = leaves // 2
        todo += [(rows[order[:k]], first, half), (rows[order[k:]], first + half, leaves - half)]
    return out


def _finish(rows: DataFrame, dims: int, spans: Sequence[float]) -> DataFrame:
    """Whole subtrees of nodes that fit in a task."""

    def run(table: pa.Table) -> pa.Table:
        flat = table.column("at").combine_chunks()
        values = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        tie, size = (table.column(c).to_numpy() for c in ("tie", "size"))
        leaf = split_here(values, tie, size, table.column("node")[0].as_py(), table.column("leaves")[0].as_py(), spans)
        return table.select(["id", "size", "text_crc32", "uid"]).append_column("shard", pa.array(leaf, pa.int64()))

    fields = T.StructType([rows.schema[c] for c in ("id", "size", "text_crc32", "uid")] + [T.StructField("shard", T.LongType())])
    return rows.groupBy("node").applyInArrow(run, fields)


def kd_shards(docs: DataFrame, dimensions: Sequence[Column], shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, few: int = FEW, local: int = LOCAL) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot): shards of nearly equal bytes, rows alike in their metadata together.

    dimensions: columns that can be cast to long, of any range. A node of m leaves is cut where its lower m // 2 leaves have
    their part of its bytes; with target_bytes, there are as many leaves as that takes. A level takes a pass for the extents
    of its nodes, a few histogram passes that narrow all their cuts at once, and one that deals rows out again; only
    (node, values, tie, size) rows of nodes that are still open move. Nodes of at most `local` rows are finished whole, each by
    one task: the same tree, without further passes. The driver counts nodes and sees none of their bins or cuts.
    Slots number a shard's rows from 0 without gaps, in runs of some RUN rows that are numbered apart.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    if not dimensions:
        raise ValueError("give a dimension at least")
    text, dims = F.col(text_col), len(dimensions)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    base = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"), F.array(*(c.cast("long") for c in dimensions)).alias("at"))
    base = materialize(base.withColumn("uid", F.monotonically_increasing_id()), "shard-rows")
    ends = base.agg(F.sum("size"), *(f(F.col("at")[d]) for d in range(dims) for f in (F.min, F.max, lambda c: F.max(c.isNull())))).first()
    total, none, spans = int(ends[0] or 0), [], []
    for d in range(dims):
        low, high, holes = ends[1 + 3 * d : 4 + 3 * d]
        low, high = (0, 0) if low is None else (low, high)
        none.append(max(low - 1, MIN_LONG))
        spans.append(float(high) - float(none[d] if holes else low))
    leaves = shards if shards is not None else max(1, -(-total // target_bytes))
    filled = F.transform("at", lambda x, i: F.coalesce(x, F.element_at(F.array(*(F.lit(v).cast("long") for v in none)), i + 1)))
    tie = F.shiftrightunsigned(F.xxhash64("uid"), 1)  # 63 bits
    rows = base.select("id", "size", "text_crc32", "uid", filled.alias("at"), tie.alias("tie"), F.lit(0).cast("long").alias("node"), F.lit(leaves).cast("long").alias("leaves"))
    parts, written = [], []
    while True:
        extents = [f(F.col("at")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("min", F.min), ("max", F.max))]
        stats = materialize(rows.groupBy("node", "leaves").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *extents), "shard-nodes")
        small = (F.col("n") <= local) | (F.col("leaves") == 1)
        n = stats.count()
        ready = _nodes_joined(rows, stats.filter(small).select("node"), n)
        one, several = ready.filter("leaves = 1"), ready.filter("leaves > 1")
        parts.append(one.select("id", "size", "text_crc32", "uid", F.col("node").alias("shard")))
        parts.append(_finish(several, dims, spans))
        big = stats.filter(~small)
        n = big.count()
        if n == 0:
            break
        cuts = materialize(_cuts(rows, big, dims, spans, bins, few), "shard-cuts")
        joined = _nodes_joined(rows.drop("leaves"), cuts, n)
        v, half = F.element_at("at", F.col("dim") + 1), F.floor(F.col("leaves") / 2)
        right = (v > F.col("cut")) | (v == F.col("cut")) & (F.col("tie") > F.col("cut_tie"))
        moved = joined.select("id", "size", "text_crc32", "uid", "at", "tie", F.when(right, F.col("node") + half).otherwise(F.col("node")).alias("node"), F.when(right, F.col("leaves") - half).otherwise(half).alias("leaves"))
        rows = materialize(moved, "shard-rows")
        written.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out, "shards")
    for x in (base, *written):
        discard(x)
    return _slots(out).withColumnRenamed("id", id_col)


def _slots(rows: DataFrame) -> DataFrame:
    runs = max(1, -(-rows.count() // RUN))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("uid"), F.lit(runs)).cast("long"))
    sizes = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    # a row for each run: what a shard's window orders is RUN times fewer than its rows
    starts = sizes.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).drop("n")
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy("shard", "run").orderBy("uid")) - 1)
    return numbered.join(starts, ["shard", "run"]).withColumn("slot", (F.col("start") + F.col("row")).cast("long")).drop("run", "uid", "start", "row")


def op3_kdtree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ordinal = F.regexp_extract("source", r"(\d+)$", 1)
    dimensions = [F.octet_length("text"), F.shiftright(F.crc32("lang"), 1), F.when(ordinal != "", ordinal).cast("long")]
    shards = kd_shards(docs, dimensions, shards=24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
