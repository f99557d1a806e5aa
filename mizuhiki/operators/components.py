"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


#: So many edges are finished by one task, some 1 MB of them; a plan for small graphs, with the same result.
SMALL = 10_000


def _finish(edges: DataFrame) -> DataFrame:
    """(id, component) of a graph of at most SMALL edges, by union-find in one task."""
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: dict = {}

        def find(x):
            while lead[x] != x:
                lead[x] = lead[lead[x]]
                x = lead[x]
            return x

        arrow = None
        for b in batches:
            arrow = b.schema.field(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(lead.setdefault(u, u)), find(lead.setdefault(v, v))
                lead[max(x, y)] = min(x, y)
        if lead:
            yield pa.RecordBatch.from_arrays([pa.array(list(lead), arrow), pa.array([find(x) for x in lead], arrow)], names=["id", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("component", kind)]))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex of an edge; component is the least id that can be reached.

    Undirected; repeated edges, self loops and edges with a null end are harmless (the last two are dropped, so a
    vertex with nothing but a self loop doesn't appear). Works on any type that has an order. Each round writes its
    edges to the scratch folder, so neither lineage nor driver memory grows with the graph.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    now = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    if isinstance(now.schema["u"].dataType, (T.IntegralType, T.StringType, T.BinaryType)) and now.limit(SMALL + 1).count() <= SMALL:
        return _finish(now)
    mark = None
    while True:
        after = materialize(_small_star(_large_star(now).distinct()).distinct(), "cc")
        discard(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or (seen[0], seen[1]) == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        mark = (seen[0], seen[1])
