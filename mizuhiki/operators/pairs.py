"""Candidate pairs: all of a few records, else those that share a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import geo_cell
from ..session import materialize
from .skew import SHARE

KINDS = ("phone", "name", "address", "url", "geo")
COMPARED = ("normalized_name", "normalized_phone", "normalized_address", "normalized_url", "lat", "lng")


def block_keys() -> dict[str, Column]:
    """Kind of block: its key; null where a record is in none of that kind."""
    name, address = F.col("normalized_name"), F.col("normalized_address")
    return {
        "phone": F.nullif(F.col("normalized_phone"), F.lit("")),
        "name": F.when(F.length(name) >= 4, F.substring(name, 1, 4)),
        "address": F.when(F.length(address) >= 6, F.substring(address, 1, 10)),
        "url": F.nullif(F.col("normalized_url"), F.lit("")),
        "geo": F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.concat_ws(":", geo_cell(F.col("lat")).cast("string"), geo_cell(F.col("lng")).cast("string"))),
    }


def _side(df: DataFrame, side: str) -> Column:
    return F.struct(*(F.col(c) for c in COMPARED)).alias(side)


def all_pairs(candidates: DataFrame) -> DataFrame:
    """(left_idx, right_idx, l, r) of every two candidates. For a checked handful only: pairs grow with the square."""
    left = candidates.select(F.col("record_index").alias("left_idx"), _side(candidates, "l"))
    right = candidates.select(F.col("record_index").alias("right_idx"), _side(candidates, "r"))
    return left.join(F.broadcast(right), F.col("left_idx") < F.col("right_idx"))


#: Rows of a chunk of a block at least, before it is parted; and rows of a slice, whose pairs are in memory at a time.
_CHUNK, _SLICE = 2048, 256


def _paired(candidates: DataFrame, kinds: tuple[str, ...], *carried: Column) -> DataFrame:
    """(left_idx, right_idx, x, y): each pair that shares a block, once; x and y, in no order, have what is carried and the
    record_index. candidates are read twice.

    Blocks become chunks, arrays of rows, which are paired with each other and then unpacked: nothing is compared but
    the keys of other kinds. A pair that shares several blocks is made by the first of them only, and the kinds with most
    pairs come first, as there is least to compare for these. A block of more than _CHUNK rows and more than one in 16 SHARE
    of all block rows is parted into several chunks; fewer than 16 SHARE blocks are that large, and their list is broadcast.
    """
    keys = block_keys()
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), keys[k].alias("key")) for k in kinds)))
    sizes = materialize(candidates.select(listed.alias("b")).filter("b.key is not null").groupBy("b.kind", "b.key").agg(F.count("*").alias("n")).filter("n > 1"), "block-sizes")
    # a row for each kind
    of = {r["kind"]: r for r in sizes.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1.0) / 2).alias("pairs")).collect()}
    order = sorted(of, key=lambda k: (-of[k]["pairs"], k)) or list(kinds)
    most = max(_CHUNK, -(-sum(r["n"] for r in of.values()) // (16 * SHARE)))
    large = sizes.filter(F.col("n") > most).select("kind", "key", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    nothing = F.lit(None).cast("string")
    before = lambda i: F.struct(*((keys[k] if j < i else nothing).alias(f"k{j}") for j, k in enumerate(order)))
    made = [F.struct(F.lit(k).alias("kind"), keys[k].alias("key"), F.when(F.lit(i > 0), before(i)).alias("before")) for i, k in enumerate(order)]
    blocks = candidates.select(F.struct("record_index", *carried).alias("s"), F.explode(F.array(*made)).alias("b")).filter("b.key is not null").select("s", "b.*")
    blocks = blocks.join(F.broadcast(large), ["kind", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("s.record_index"), F.col("parts")).cast("int")
    chunks = blocks.groupBy("kind", "key", "parts", part.alias("part")).agg(F.collect_list(F.struct("s.*", "before")).alias("rows"))
    chunks = materialize(chunks.filter("parts > 1 or size(rows) > 1").withColumn("rows", F.sort_array("rows")), "chunks")
    alone = chunks.filter("parts = 1").select("kind", "key", F.col("part").alias("a"), F.col("part").alias("b"), F.col("rows").alias("x"), F.col("rows").alias("y"))
    parted = chunks.filter("parts > 1")
    left = parted.select("kind", "key", F.col("part").alias("a"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("b"), F.col("rows").alias("x"))
    right = parted.select("kind", "key", F.explode(F.sequence(F.lit(0), "part")).alias("a"), F.col("part").alias("b"), F.col("rows").alias("y"))
    both = alone.unionByName(left.join(right, ["kind", "key", "a", "b"]))
    tasks = max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, int(sum(r["pairs"] for r in of.values()) / 20_000_000)))
    both = both.repartition(tasks, "kind", "key", "a", "b")
    # slices by a function that is not compiled: what is compiled keeps all rows that it makes of one row
    few = max(1, _SLICE // 4) if carried else _SLICE
    slices = lambda c, start: F.transform(F.sequence(start, F.floor((F.size(c) - 1) / few).cast("int")), lambda i: F.slice(c, i * few + 1, F.lit(few)))
    both = both.select((F.col("a") == F.col("b")).alias("own"), "y", F.posexplode(slices("x", F.lit(0))).alias("i", "x"))
    both = both.select("own", "x", F.explode(slices("y", F.when(F.col("own"), F.col("i")).otherwise(0))).alias("y"))
    both = both.select("own", F.explode("x").alias("x"), "y").select("own", "x", F.explode("y").alias("y"))
    shared = F.lit(False)
    for j in range(len(order) - 1):
        shared = shared | F.coalesce(F.col(f"x.before.k{j}") == F.col(f"y.before.k{j}"), F.lit(False))
    x, y = F.col("x.record_index"), F.col("y.record_index")
    return both.filter((~F.col("own") | (x < y)) & ~shared).select(F.least(x, y).alias("left_idx"), F.greatest(x, y).alias("right_idx"), "x", "y")


def block_pairs(candidates: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(left_idx, right_idx): each pair that shares a block, once, without what the records say."""
    return _paired(candidates, kinds).select("left_idx", "right_idx")


def blocked_pairs(candidates: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(left_idx, right_idx, l, r): each pair that shares a block, once. candidates are read twice."""
    both, ordered = _paired(candidates, kinds, _side(candidates, "s")), F.col("x.record_index") < F.col("y.record_index")
    return both.select("left_idx", "right_idx", F.when(ordered, F.col("x.s")).otherwise(F.col("y.s")).alias("l"), F.when(ordered, F.col("y.s")).otherwise(F.col("x.s")).alias("r"))


def wants_all(candidates: DataFrame, pairing: str = "auto", all_pairs_limit: int = 500) -> bool:
    """Whether every two candidates are compared; auto: up to all_pairs_limit candidates (this counts them)."""
    if pairing not in ("auto", "all", "blocked"):
        raise ValueError(f"unknown pairing: {pairing}")
    return pairing == "all" or pairing == "auto" and candidates.limit(all_pairs_limit + 1).count() <= all_pairs_limit


def candidate_pairs(candidates: DataFrame, pairing: str = "auto", all_pairs_limit: int = 500) -> DataFrame:
    """auto: all pairs of up to all_pairs_limit candidates (this counts them), blocks beyond."""
    return all_pairs(candidates) if wants_all(candidates, pairing, all_pairs_limit) else blocked_pairs(candidates)


def block_sizes(candidates: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, key, n, pairs) of each block, for finding those that would make too many pairs."""
    keys = block_keys()
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), keys[k].alias("key")) for k in kinds))).alias("b")
    sizes = candidates.select(listed).filter("b.key is not null").groupBy("b.kind", "b.key").agg(F.count("*").alias("n"))
    return sizes.withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
