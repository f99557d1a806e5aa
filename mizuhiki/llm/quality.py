"""Quality rules with adaptive thresholds from mergeable quantile sketches, for each language and source.

DataFrame functions only. Null texts have no word; null languages and sources are groups of their own. Repeated rows
get equal verdicts, and so do equal ratios (ties): a fence is passed by being beyond it. Very long texts are measured
whole, each in one task. Extra columns pass through, but those named as a result column are replaced by it. An empty
table gives an empty result.

The sketch is a DDSketch (Masson, Rim and Lee 2019) with its linearly interpolated mapping, in integers: a ratio is a
fixed-point number of 20 binary places, its bucket the number's exponent and the 7 bits after its first. So bucket edges
are 0.8 % apart, a quantile is off by that at most, and a sketch is a table of counts: adding counts merges sketches,
in any order and to the same result, so neither partitions nor lost executors change a verdict.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialize

BLANK = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated windows
#: Fixed-point numbers are ratios times this; buckets have this many mantissa steps.
ONE, STEPS = 1 << 20, 128


class Rule(NamedTuple):
    """A ratio and its fences: `spreads` times the distance of two quantiles (per mille) beyond them."""

    ratio: str
    above: str
    below: str
    low: int
    high: int
    spreads: float
    both_ways: bool


#: Repetition is zero in most documents and slight in many good ones, so its quartiles tell nothing and a high quantile does.
RULES = (
    Rule("symbol_ratio", "n_symbols", "word_chars", 250, 750, 6.0, False),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", 750, 990, 0.25, False),
    Rule("repeat_ratio", "n_repeat_words", "n_words", 750, 990, 0.25, False),
    Rule("word_length", "word_chars", "n_words", 250, 750, 6.0, True),
)
RATIOS = tuple(r.ratio for r in RULES)
#: No upper fence is lower than this: one in a thousand is slight even where the quantiles are zero.
EPSILON = 1049 / ONE
#: A group's fences are drawn to those of its language, and these to those of all rows, as by so many rows more.
PULL = 100
#: Fences are broadcast up to this many bytes, and joined by a shuffle beyond.
MAX_BROADCAST = 16 << 20


def _let(value: Column, body) -> Column:
    """body(value), with value computed once, wherever the optimizer moves or copies the expression to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(w: Column) -> Column:
    """How many of the words lie in windows of three that occur twice or more.

    Where all digests differ, no window is repeated. Else windows are known by two digests and sorted with their
    places, so equal ones are neighbours: n log n in the length of a text, and no shuffle.
    """
    at = F.sequence(F.lit(1), F.size(w) - 2)

    def places(h: Column) -> Column:
        windows = F.transform(at, lambda i: F.struct(h[i - 1].alias("h"), F.hash(w[i + 1], w[i - 1], w[i]).alias("g"), i.alias("i")))
        return _let(F.sort_array(windows), neighbours)

    def neighbours(s: Column) -> Column:
        # same[k]: whether windows k and k + 1 of the sorted ones are equal
        same = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"]))
        return _let(same, lambda t: inside(s, t))

    def inside(s: Column, same: Column) -> Column:
        hit = F.filter(s, lambda x, k: ((k > 0) & F.coalesce(F.get(same, k - 1), F.lit(False))) | F.coalesce(F.get(same, k), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    digests = F.transform(at, lambda i: F.xxhash64(w[i - 1], w[i], w[i + 1]))
    count = _let(digests, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), places(h)).otherwise(0))
    return F.when(F.size(w) > 3, count).otherwise(0)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and base_failed, in place of columns
    of these names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, BLANK, " " * len(BLANK)), " "), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANK, "") != "")
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("repeated")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    out = docs.withColumns({"_q_words": of_words, "_q_lines": of_lines})
    out = out.withColumns(
        {
            "n_words": F.col("_q_words.n"),
            "word_chars": F.length(F.translate(text, BLANK, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": F.col("_q_lines.dup"),
            "n_lines": F.col("_q_lines.n"),
            "n_repeat_words": F.col("_q_words.repeated"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED) * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_q_words", "_q_lines")


def _fixed(rule: Rule) -> Column:
    """The ratio in units of 1 / ONE, rounded down; the divisor is 1 at least."""
    return F.expr(f"cast(`{rule.above}` as bigint) * {ONE} div greatest(cast(`{rule.below}` as bigint), 1)")


def _bucket(v: Column) -> Column:
    """The bucket of a fixed-point number; below 2 * STEPS each number is a bucket by itself."""
    e = F.greatest(F.length(F.bin(v)) - 8, F.lit(0))
    return e * STEPS + F.call_function("shiftright", v, e)


def _edge(bucket: Column) -> Column:
    """The greatest fixed-point number in a bucket."""
    e = F.greatest(F.floor(bucket / STEPS).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", bucket - e * STEPS + 1, e) - 1


def sketch(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, rule, bucket, n): a sketch of each ratio for each group of `measures`, over rows that pass the base
    rules; counts are added up before the shuffle."""
    each = F.when(~F.col("base_failed"), F.array(*(F.struct(F.lit(i).alias("rule"), _bucket(_fixed(r)).alias("bucket")) for i, r in enumerate(RULES))))
    rows = measured.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.inline(each))
    return rows.groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of the coarser groups by keys."""
    return sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def _bounds(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule, n, low, high): the two quantiles of each rule, as upper edges of their buckets."""
    group = Window.partitionBy(*keys, "rule")
    counted = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    of_rule = lambda get: F.element_at(F.array(*(F.lit(get(r)) for r in RULES)), F.col("rule") + 1)
    at = lambda q: F.min(F.when(F.col("upto") * 1000 >= F.col("all") * of_rule(q), F.col("bucket")))
    found = counted.groupBy(*keys, "rule").agg(F.max("all").alias("n"), at(lambda r: r.low).alias("a"), at(lambda r: r.high).alias("b"))
    low, high = _edge(F.col("a")).cast("double"), _edge(F.col("b")).cast("double")
    reach = of_rule(lambda r: r.spreads) * (high - low)
    return found.select(*keys, "rule", "n", (low - reach).alias("low"), (high + reach).alias("high"))


def fences(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, n, <ratio>_low, <ratio>_high): of each group of `measures` with a row that passes the base rules.

    Fences of n rows are drawn to those of the coarser group with the weight of PULL rows: (n * own + PULL * coarser) /
    (n + PULL), from source to language to all; so there is no size at which they change suddenly. Without a lower fence,
    <ratio>_low is null. measured is read once; the result is written to the scratch folder: one row for each group.
    """
    own = materialize(sketch(measured, lang_col, source_col), "sketches")
    same = lambda a, b, *cols: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in cols))
    drawn = lambda a, b: [((F.col(f"{a}.n") * F.col(f"{a}.{x}") + PULL * F.col(f"{b}.{x}")) / (F.col(f"{a}.n") + PULL)).alias(x) for x in ("low", "high")]
    overall = _bounds(merged(own)).alias("o")  # a row for each rule
    langs = _bounds(merged(own, "lang"), "lang").alias("l").join(F.broadcast(overall), "rule").select("l.lang", "l.rule", *drawn("l", "o"))
    groups = _bounds(own, "lang", "source").alias("g").join(langs.alias("l"), same("g", "l", "lang", "rule")).select("g.lang", "g.source", "g.rule", "g.n", *drawn("g", "l"))
    sides = []
    for i, r in enumerate(RULES):
        of = lambda x, i=i: F.max(F.when(F.col("rule") == i, F.col(x))) / ONE
        sides += [(of("low") if r.both_ways else F.lit(None).cast("double")).alias(f"{r.ratio}_low"), F.greatest(F.lit(EPSILON), of("high")).alias(f"{r.ratio}_high")]
    done = materialize(groups.groupBy("lang", "source").agg(F.max("n").alias("n"), *sides), "fences")
    discard(own)
    return done


def judge(measured: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """measured with kept: false if base_failed or if any ratio is beyond a fence of its group."""
    names = [f"{r}_{x}" for r in RATIOS for x in ("low", "high")]
    limits = limits.select(F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), F.struct(*names).alias("_q_fence"))
    width = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    if (limits.agg(F.sum(width("_q_lang") + width("_q_source") + 100)).first()[0] or 0) <= MAX_BROADCAST:
        limits = F.broadcast(limits)
    joined = measured.join(limits, F.col(lang_col).eqNullSafe(F.col("_q_lang")) & F.col(source_col).eqNullSafe(F.col("_q_source")), "left")
    beyond = F.lit(False)
    for r in RULES:
        value = _fixed(r) / ONE
        beyond = beyond | F.coalesce(value > F.col(f"_q_fence.{r.ratio}_high"), F.lit(False)) | F.coalesce(value < F.col(f"_q_fence.{r.ratio}_low"), F.lit(False))
    # one CASE for both: a filter by it stays above the join
    return joined.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~beyond)).drop("_q_lang", "_q_source", "_q_fence")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    measured = materialize(measures(docs).drop("text"), "measures")
    judged = judge(measured, fences(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same in SQL: windows of three words as rows, buckets and quantiles in integers."""
    of_rule = lambda get: "case rule " + " ".join(f"when {i} then {get(r)}" for i, r in enumerate(RULES)) + " end"
    edge = lambda b: f"cast((({b} - greatest({b} // {STEPS} - 1, 0) * {STEPS} + 1) << greatest({b} // {STEPS} - 1, 0)) - 1 as double)"

    def bounds(table: str, keys: str) -> str:
        part = f"{keys}, rule" if keys else "rule"
        upto = f"select *, cast(sum(n) over (partition by {part} order by bucket) as bigint) as upto, cast(sum(n) over (partition by {part}) as bigint) as total from {table}"
        at = lambda q: f"min(case when upto * 1000 >= total * ({of_rule(q)}) then bucket end)"
        ends = f"select {part}, max(total) as n, {at(lambda r: r.low)} as a, {at(lambda r: r.high)} as b from ({upto}) group by all"
        sides = f"select *, {edge('a')} as x, {edge('b')} as y, ({of_rule(lambda r: r.spreads)}) * (y - x) as reach from ({ends})"
        return f"select {part}, n, x - reach as low, y + reach as high from ({sides})"

    drawn = ", ".join(f"(a.n * a.{x} + {PULL} * b.{x}) / (a.n + {PULL}) as {x}" for x in ("low", "high"))
    beyond = " or ".join(f"(rule = {i} and (v / {ONE} > greatest({EPSILON!r}, high / {ONE})" + (f" or v / {ONE} < low / {ONE}" if r.both_ways else "") + "))" for i, r in enumerate(RULES))
    return f"""
with t as (select doc_id, lang, source, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select rid, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as word, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) as i from t),
g as (select rid, i, word, lead(word, 1) over z as word2, lead(word, 2) over z as word3 from w window z as (partition by rid order by i)),
r as (select rid, i from g where word3 is not null qualify count(*) over (partition by rid, word, word2, word3) > 1),
c as (select rid, count(distinct i + k) as n from r, range(3) as x(k) group by rid),
l as (select rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from t),
m as (select t.rid, doc_id, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines, coalesce(c.n, 0) as n_repeat_words
  from t join l on t.rid = l.rid left join c on t.rid = c.rid),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed from m),
v as (select rid, lang, source, rule, v, greatest(length(bin(v)) - 8, 0) as e from (select f.*, unnest([{", ".join(f"{{'rule': {i}, 'v': {r.above} * {ONE} // greatest({r.below}, 1)}}" for i, r in enumerate(RULES))}], recursive := true) from f where not base_failed)),
s as (select lang, source, rule, e * {STEPS} + (v >> e) as bucket, count(*) as n from v group by all),
sl as (select lang, rule, bucket, cast(sum(n) as bigint) as n from s group by all), sa as (select rule, bucket, cast(sum(n) as bigint) as n from s group by all),
ba as ({bounds("sa", "")}), bl as ({bounds("sl", "lang")}), bg as ({bounds("s", "lang, source")}),
pl as (select a.lang, a.rule, {drawn} from bl a join ba b on a.rule = b.rule),
pg as (select a.lang, a.source, a.rule, {drawn} from bg a join pl b on a.rule = b.rule and a.lang is not distinct from b.lang),
x as (select v.rid, bool_or({beyond.replace("rule =", "v.rule =")}) as beyond from v join pg on v.rule = pg.rule and v.lang is not distinct from pg.lang and v.source is not distinct from pg.source group by v.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not beyond as kept from f left join x on f.rid = x.rid
"""


OP10_SQL = _sql()
