"""Mixing sources to target weights by Poisson replication.

DataFrame functions only. Each row's count is the inverse Poisson distribution function at a uniform number that a
seeded hash of its id decides; so a rerun, or a lost executor, changes nothing. A null source is a source of its own,
known to the weights as None. Rows with equal ids, repeated rows among them, get equal counts and keys (a null id counts
as empty text). A source of weight zero yields nothing. Texts are moved whole, whatever their length. Extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import salted_join
from ..session import discard, materialize

SEED = 20
#: The tables of all sources are broadcast up to this many bytes, and joined by a salted shuffle beyond.
MAX_BROADCAST = 16 << 20


def _uniform(key: Column, salt: str) -> Column:
    """In [0, 1), from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _distributions(known: DataFrame) -> DataFrame:
    """(source, cdf) for sources with a rate: P(X <= k) for k = 0, 1, ...; as far as 52 bits can tell the rest from 1.

    A row for each k, with running sums of logarithms and then of probabilities over a source; so time and memory are
    n log n in the length of a table.
    """
    last = F.ceil(F.col("rate") + F.lit(12.0) * F.sqrt("rate") + F.lit(30.0)).cast("int")
    each = known.filter("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log_p = F.col("k") * F.ln("rate") - F.col("rate") - F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(upto)
    sums = each.select("source", "k", log_p.alias("log_p")).select("source", "k", F.sum(F.exp("log_p")).over(upto).alias("p"))
    return sums.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("cdf"))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, source_col: str = "source") -> DataFrame:
    """(source, n, rate, cdf): how often, in the mean, each row of a source is to be repeated.

    weights: each source's share of the mix (normalised here; sources that it lacks get none); without any, all sources
    weigh the same. total: rows that the mix is to have in the mean; as many as docs without it.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_s string, w double")
        counts = counts.withColumn("_k", F.col("source").cast("string")).join(table, F.col("_k").eqNullSafe(F.col("_s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    counts = materialize(counts, "sources")
    sums = counts.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    goal = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    rate = F.when(F.col("all_w") > 0, goal * F.col("w") / F.col("all_w") / F.col("n")).otherwise(0.0)
    known = materialize(counts.join(F.broadcast(sums)).select("source", "n", rate.alias("rate")), "rates")
    tables = _distributions(known).withColumnRenamed("source", "_s")
    done = materialize(known.join(tables, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "distributions")
    discard(counts)
    discard(known)
    return done


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs, each row as often as its count, in a globally random order that the seed decides.

    Adds n_copies, copy (from 0) and mix_key, in place of columns of these names; the shuffle deals rows by mix_key, and
    each part is sorted by it. A row's count is found in its source's table: a step for each repetition that it may get.
    """
    known = rates(docs, weights, total, source_col).select(F.col("source").alias("_mix_source"), F.col("n").alias("_mix_n"), F.col("cdf").alias("_mix_cdf"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    width = F.coalesce(F.size("_mix_cdf") * 8, F.lit(0)) + F.coalesce(F.octet_length(F.col("_mix_source").cast("string")), F.lit(0)) + 40
    if (known.agg(F.sum(width.cast("long"))).first()[0] or 0) <= MAX_BROADCAST:
        counted = docs.join(F.broadcast(known), F.col(source_col).eqNullSafe(F.col("_mix_source")))
    else:
        counted = salted_join(docs, known, source_col, "_mix_source", key, "_mix_n")
    n = F.when(F.col("_mix_cdf").isNull(), F.lit(0)).otherwise(F.size(F.filter("_mix_cdf", lambda p: p <= _uniform(key, f"count{seed}"))))
    copies = counted.withColumn("n_copies", n).drop("_mix_cdf", "_mix_source", "_mix_n").filter("n_copies > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    copies = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), key, F.col("copy").cast("string"))))
    return copies.repartition("mix_key").sortWithinPartitions("mix_key", id_col)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed so that every source has the same weight."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = f"""
with s as (select source, count(*) as n from documents group by source),
r as (select source, cast((select sum(n) from s) as double) * 1.0 / cast((select count(*) from s) as double) / n as rate from s),
k as (select source, rate, cast(unnest(range(0, cast(ceil(rate + 12.0 * sqrt(rate) + 30.0) as bigint) + 1)) as double) as k from r),
c as (select source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by source order by k) as p from k),
u as (select d.*, row_number() over () as rid, cast(cast('0x' || substr(md5('count{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) as double) / 4503599627370496.0 as u from documents d),
m as (select u.rid, u.doc_id, u.text, u.lang, u.source, u.n_chars, cast(sum(case when c.p <= u.u then 1 else 0 end) as integer) as n_copies
  from u join c on u.source is not distinct from c.source group by all),
x as (select *, cast(unnest(range(0, cast(n_copies as bigint))) as integer) as copy from m where n_copies > 0)
select doc_id, text, lang, source, n_chars, n_copies, copy, md5('order{SEED}:' || coalesce(cast(doc_id as varchar), '') || ':' || cast(copy as varchar)) as mix_key from x
"""
