"""URL filter: rules by host and path, and block decisions that pass along redirects and canonical links.

Null urls, and urls without `://`, have an empty host and path, and no rule fits them. Repeated rows are judged alike, and
so are equal urls. Urls and pages are read whole, whatever their length. Null pages have no link. Extra columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..operators.skew import look_up
from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules are held against each url as a literal expression; more, and tables of rules, are joined by host.
LITERAL = 200


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first `://` to `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


RULE = "struct<rule:string,verdict:string>"


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (struct of rule and verdict) that fits; of equally long ones an allow rule, then the one that sorts
    first. Null if none fits.

    A rule fits its host and all subdomains, if the path starts with its path. No shuffle; for a few rules.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "allow", r.host + r.path))
    out = F.lit(None).cast(RULE)
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _counted(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """table, with n: how many of rows have its key; keys that none has are dropped."""
    return materialize(table.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys), "rule-counts")


def with_rules(rows: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """rows (host, path, ...) with `_r`, the rule of each as `rule_of` gives it; rules: (verdict, host, path), any number.

    Many rules are joined: a url by the suffixes of its host, as many as rules have labels at most, and then by the prefixes
    of its path that have the length of a rule of that host; so a url meets only rules that fit, whatever their number.
    Each distinct host and path is looked up once.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= LITERAL:
            return rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
        rules = rows.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    best = F.min(F.struct((F.col("verdict") != "allow").alias("blocks"), "verdict"))["verdict"]
    table = materialize(rules.groupBy("host", "path").agg(best.alias("verdict")), "rules")
    hosts = materialize(table.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths")), "rule-hosts")
    deepest = hosts.agg(F.max(F.size(F.split("host", "[.]", -1)))).first()[0] or 0
    urls = materialize(rows.select("host", "path").distinct().filter("host is not null and path is not null"), "urls")
    labels = F.split("host", "[.]", -1)
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, deepest)))), lambda k: F.concat_ws(".", F.slice(labels, F.size(labels) - k + 1, k)))
    suffixes = urls.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.explode(tails).alias("host"))
    suffixes = materialize(suffixes, "url-suffixes")
    met = look_up(suffixes, _counted(suffixes, hosts, ["host"]), ["host"])
    lengths = F.filter("lengths", lambda n: n <= F.length("_path"))
    prefixes = materialize(met.select("_host", "_path", "host", F.explode(lengths).alias("_len")).select("_host", "_path", "host", F.col("_path").substr(F.lit(1), F.col("_len")).alias("path")), "url-prefixes")
    fits = look_up(prefixes, _counted(prefixes, table, ["host", "path"]), ["host", "path"])
    rule = F.concat("host", "path")
    first = F.min(F.struct((-F.length(rule)).alias("len"), (F.col("verdict") != "allow").alias("blocks"), rule.alias("rule"), "verdict"))
    found = fits.groupBy("_host", "_path").agg(first.alias("f")).select("_host", "_path", F.struct("f.rule", "f.verdict").cast(RULE).alias("_r"))
    times = rows.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.count("*").alias("n"))
    found = materialize(found.join(times, ["_host", "_path"]), "url-rules")
    keyed = rows.withColumns({"_host": F.col("host"), "_path": F.col("path")})
    return look_up(keyed, found, ["_host", "_path"], how="left").drop("_host", "_path")


def _vertex(url: Column) -> Column:
    """What redirects and links are about: the url without its fragment."""
    return F.regexp_extract(url, "^[^#]*", 0)


@F.arrow_udf(T.StringType())
def _resolved(bases: pa.Array, targets: pa.Array) -> pa.Array:
    """Targets as RFC 3986 resolves them; null if a part isn't valid."""

    def one(base: str | None, target: str | None) -> str | None:
        try:
            return None if base is None or target is None else urljoin(base, target)
        except ValueError:
            return None

    return pa.array(map(one, bases.to_pylist(), targets.to_pylist()), pa.string())


#: Comments, scripts and styles hide tags; a tag ends at the first > outside quotes, and other tags are passed over whole, as
#: their quotes may hold anything; an attribute is a name and maybe a value.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_INSIDE = r"""(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
_TAG = rf"(?is)(<(?:link|meta)(?=[\s/]){_INSIDE})|<[a-z/!]{_INSIDE}"
_ATTRIBUTE = r"""([^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+)"""


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): from each page to what its canonical links and refresh redirects name, resolved against its url."""
    seen = F.regexp_replace(F.col(html_col), _HIDDEN, " ")
    # what it looks for says one of these words; few pages do
    found = pages.filter(F.col(html_col).rlike("(?i)canonical|refresh")).select(F.col(url_col).alias("src"), F.explode(F.regexp_extract_all(seen, F.lit(_TAG), 1)).alias("tag")).filter("tag <> ''")
    inside = F.regexp_extract("tag", r"(?s)^<\w+(.*?)/?>$", 1)
    found = found.select("src", F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), 1).alias("attributes"))

    def attr(name: str) -> Column:
        """The value of the first attribute of that name, without quotes."""
        said = F.get(F.filter("attributes", lambda x: F.lower(F.regexp_extract(x, r"^[^\s=]*", 0)) == name), F.lit(0))
        value = F.regexp_extract(said, r"(?s)=\s*(.*)$", 1)
        return F.when(value.rlike("(?s)^[\"'].*[\"']$"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)

    canonical = F.when(F.array_contains(F.split(F.lower(attr("rel")), r"\s+"), "canonical"), F.nullif(attr("href"), F.lit("")))
    refresh = F.when(F.lower(attr("http-equiv")) == "refresh", F.nullif(F.regexp_extract(attr("content"), r"(?i)url\s*=\s*['\"]?([^'\"]+)", 1), F.lit("")))
    target = F.replace(F.trim(F.coalesce(canonical, refresh)), F.lit("&amp;"), F.lit("&"))
    links = found.filter(F.col("src").contains("://")).select("src", target.alias("target")).filter("target is not null")
    return links.select("src", _resolved(F.col("src"), F.col("target")).alias("dst"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(id_col, url, host, path, rule, verdict): the verdict of the rule, else that of the url's aliases.

    Aliases are the urls of a connected component of redirects (src, dst) and links. An explicitly allowed one makes
    allow the verdict of those without a rule, else a blocked one makes it block; without either it is allow.
    """
    many = isinstance(rules, DataFrame) or len(rules) > LITERAL
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"))
    judged = rows.select("_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = with_rules(materialize(judged, "urls-of-pages") if many else judged, rules)
    edges = None if redirects is None else redirects.select("src", "dst")
    if html_col is not None:
        links = link_edges(pages, url_col, html_col)
        edges = links if edges is None else edges.unionByName(links)
    own = F.coalesce(F.col("_r.verdict"), F.lit("allow"))
    if edges is None:
        return judged.select(F.col("_id").alias(id_col), "url", "host", "path", F.col("_r.rule").alias("rule"), own.alias("verdict"))
    edges = materialize(edges.select(_vertex(F.col("src")).alias("src"), _vertex(F.col("dst")).alias("dst")), "links")
    parts = connected_components(edges)
    said = parts.select("component", host_of(F.col("id")).alias("host"), path_of(F.col("id")).alias("path"))
    said = with_rules(materialize(said, "aliases") if many else said, rules).withColumn("v", F.col("_r.verdict"))
    lots = said.groupBy("component").agg(F.max(F.coalesce(F.col("v") == "allow", F.lit(False))).alias("allow"), F.max(F.coalesce(F.col("v") == "block", F.lit(False))).alias("block"), F.count("*").alias("n"))
    lots = materialize(lots.filter("block and not allow").drop("allow"), "blocked")
    passed = materialize(look_up(parts, lots, ["component"]).select(F.col("id").alias("_u"), F.lit("block").alias("_passed")), "passed")
    joined = judged.withColumn("_u", _vertex(F.col("url")))
    # a url may be that of a third of all pages
    joined = joined.withColumn("_passed", F.lit(None).cast("string")) if passed.isEmpty() else look_up(joined, _counted(joined, passed, ["_u"]), ["_u"], how="left")
    return joined.select(F.col("_id").alias(id_col), "url", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", "_passed", F.lit("allow")).alias("verdict"))


def op4_urls(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql_rules() -> str:
    return ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)


#: The pages of the test tables have neither canonical links nor refresh tags, so the rules alone decide there;
#: components are held against brute force in the tests.
OP4_SQL = f"""
with r(v, h, p) as (values {_sql_rules()}),
u as (select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
s as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select s.*, r.h || r.p as rule, r.v, row_number() over (partition by page_id order by length(r.h || r.p) desc nulls last, r.v) as n
  from s left join r on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from f where n = 1
"""
