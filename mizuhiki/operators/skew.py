"""Joins with a small row a key, whose other side may have a third of its rows under one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it has more than one in so many of all rows; so there are fewer frequent keys than this.
SHARE = 1000


def look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with table on keys, `inner` or `left`; table has one row for each key, and in `count` its number of rows.

    The table's rows of frequent keys are broadcast, fewer than SHARE by their definition whatever the size of rows, so
    rows of a frequent key stay where they are. The others are joined by a shuffle, in which no key has more than one
    row in SHARE. Null keys find nothing. Both sides are read twice: pass tables that are written. Columns: those of
    rows, then those of table without keys and count.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown kind of join: {how}")
    given = [c for c in table.columns if c not in keys and c != count]
    total = table.agg(F.sum(count)).first()[0] or 0
    if total == 0:
        return rows.join(table.drop(count), list(keys), how).select(*rows.columns, *given)
    often = F.col(count) * SHARE > total
    frequent = F.broadcast(table.filter(often).select(*keys, *given, F.lit(True).alias("_often")))
    marked = rows.join(frequent, list(keys), "left")
    hot = marked.filter("_often").select(*rows.columns, *given)
    rest = marked.filter("_often is null").select(*rows.columns)
    return hot.unionByName(rest.join(table.filter(~often).drop(count), list(keys), how).select(*rows.columns, *given))


def salted_join(rows: DataFrame, table: DataFrame, key: str, table_key: str, by: Column, count: str = "n") -> DataFrame:
    """rows joined with table where rows.key is table.table_key (null-safe); for wide rows, which are read only once.

    table has one row for each key, and in `count` its number of rows. Its rows of frequent keys are repeated for salts, and
    rows of these keys are dealt over the salts by a hash of `by` (an id, say), so that a task gets some one row in SHARE of
    one key. What is broadcast is the number of salts of frequent keys, fewer than SHARE of them. Columns: those of rows and of table.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    salts = F.ceil(F.col(count) * SHARE / F.lit(max(1, total))).cast("int")
    often = table.filter(F.col(count) * SHARE > total).select(F.col(table_key).alias("_often"), salts.alias("_salts"))
    dealt = rows.join(F.broadcast(often), F.col(key).eqNullSafe(F.col("_often")), "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_often", "_salts")
    many = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(many, F.col(key).eqNullSafe(F.col(table_key)) & (F.col("_salt") == F.col("_copy"))).drop("_salt", "_copy")
