"""Content-addressed WARC archive: payload bytes once per strong digest, exact record headers apart, records by joins.

Null payloads are empty ones; null page ids come last among equal payloads, and null ids and urls yield no line. Of
repeated rows, and of rows with equal ids, one is the response. A payload of any length is one cell, which must fit in a
task. Extra columns are ignored, whatever their names. An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import look_up
from ..session import discard, materialize, scratch_path

CRLF = "\r\n"
#: The alphabet of base32 (RFC 4648), and Spark's digits of a number to the base 32.
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """headers: (id, header, http, digest) by record; payloads: (digest, payload) once for each payload, in buckets by digest."""

    headers: DataFrame
    payloads: DataFrame


def base32_sha1(content: Column) -> Column:
    """SHA-1 in bare upper-case base32: five hexadecimal digits are four of base 32."""
    digest = F.sha1(content)
    parts = (F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8))
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _uuid(text: Column) -> Column:
    h = F.md5(text)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _stored(payloads: DataFrame) -> DataFrame:
    """payloads (digest, payload) written to the scratch folder in buckets by digest: joins by it don't move payloads again."""
    spark = payloads.sparkSession
    name = f"mizuhiki_warc_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payloads.write.format("parquet").bucketBy(buckets, "digest").option("path", scratch_path(spark, "warc-payloads")).saveAsTable(name)
    back = spark.table(name)
    spark.sql(f"drop table {name}")  # an entry of the catalog; its files stay
    return back


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Percent signs and line ends are written as percent codes."""
    coded = value
    for c, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        coded = F.replace(coded, F.lit(c), F.lit(code))
    return F.coalesce(F.concat(F.lit(f"{name}: "), coded, F.lit(CRLF)), F.lit(""))


def header_field(name: str) -> Column:
    """The value of a field of `header`; null if the record lacks it."""
    value = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    for c, code in (("\n", "%0A"), ("\r", "%0D"), ("%", "%25")):
        value = F.replace(value, F.lit(code), F.lit(c))
    return F.when(F.col("header").contains(f"{CRLF}{name}: "), value)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Writes the two tables of the archive to the scratch folder.

    Of records whose payloads are equal and of at least min_bytes, that with the least id is a response and the others
    revisit it. The SHA-256 of a payload is its address; it is verified against a second digest (equal addresses must
    have equal lengths and XXH64) before the archive is handed out, and again with the bytes whenever they are read.
    Payloads are shuffled once, after equal ones of a task have become one; all else moves rows of some 200 bytes.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    marks = [F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"), F.xxhash64("payload").alias("check")]
    keys = materialize(rows.select("id", "url", "digest", *marks).withColumn("uid", F.monotonically_increasing_id()), "warc-keys")
    by = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    same = (F.min("bytes") == F.max("bytes")) & (F.min("check") == F.max("check"))
    firsts = materialize(keys.groupBy("digest").agg(F.min(by).alias("first"), same.alias("same"), F.count("*").alias("n")), "warc-firsts")
    if not firsts.filter("not same").isEmpty():
        raise ValueError("different payloads have the same SHA-256")
    store = _stored(rows.groupBy("digest").agg(F.first("payload").alias("payload")))
    joined = look_up(keys, firsts.drop("same"), ["digest"])
    revisit = (F.col("bytes") >= min_bytes) & (F.col("uid") != F.col("first.uid"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    record = lambda u: _uuid(F.concat_ws(":", F.lit("record"), u.cast("string")))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", record(F.col("uid"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, record(F.col("first.uid")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("X-Refers-To-Page", F.when(revisit, F.col("first.id").cast("string"))),
        _line("X-Page", F.col("id").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF),
    )
    headers = materialize(joined.select("id", header.alias("header"), http.alias("http"), "digest"), "warc-headers")
    discard(keys)
    discard(firsts)
    return Archive(headers, store)


def verified(payloads: DataFrame) -> DataFrame:
    """(digest, payload), with an error if bytes that were read don't have the digest they are filed under."""
    fits = F.sha2("payload", 256) == F.col("digest")
    return payloads.select("digest", F.when(fits, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")).alias("payload"))


def reconstruct(kept: Archive) -> DataFrame:
    """(id, digest, record): the bytes of each WARC record as it was written; digest is the address of its payload.

    A response gets its payload by a join on the digest, to which the store's buckets stay in place and only headers move:
    one response a payload, but for those below min_bytes. A revisit has no payload in its record and needs no join.
    """
    record = lambda body: F.concat(F.encode("header", "utf-8"), F.encode("http", "utf-8"), body, F.lit((CRLF * 2).encode()))
    response = header_field("WARC-Type") == "response"
    full = verified(kept.payloads).join(kept.headers.filter(response).hint("shuffle_hash"), "digest")
    empty = kept.headers.filter(~response).select("id", "digest", record(F.lit(b"")).alias("record"))
    return full.select("id", "digest", record(F.col("payload")).alias("record")).unionByName(empty)


def read_back(kept: Archive) -> DataFrame:
    """(header, payload_bytes, payload_digest) read from the bytes of each reconstructed record.

    Length and digest of a response are those of the body inside; those of a revisit are of the body inside the response
    whose record id it names. An error if a record's Content-Length, its payload digest or its HTTP length isn't what
    bodies say, or if a revisit names no response.
    """
    text = F.col("record").cast("string")  # the same bytes
    ends = [(F.octet_length(F.substring_index(text, CRLF * 2, n)) + 4).alias(f"end{n}") for n in (1, 2)]
    header = F.concat(F.substring_index(text, CRLF * 2, 1), F.lit(CRLF)).alias("header")
    size = F.octet_length("record") - 4
    http = F.col("record").substr(F.col("end1") + 1, F.col("end2") - F.col("end1")).cast("string")
    said = F.regexp_extract(http, r"\r\nContent-Length: (\d+)\r\n", 1).try_cast("long")
    rows = reconstruct(kept).select("record", header, *ends)
    rows = rows.select("header", "end1", "end2", size.alias("size"), said.alias("said"), F.col("record").substr(F.col("end2") + 1, size - F.col("end2")).alias("body"))
    response = header_field("WARC-Type") == "response"
    rows = rows.select(
        "header", "said", response.alias("response"), F.substring(header_field("WARC-Payload-Digest"), 6, 32).alias("named"), header_field("WARC-Refers-To").alias("refers"),
        F.coalesce(header_field("Content-Length").try_cast("long") == F.col("size") - F.col("end1"), F.lit(False)).alias("fits"),
        F.octet_length("body").cast("long").alias("payload_bytes"), F.when(response, base32_sha1(F.col("body"))).alias("payload_digest"),
    )
    read = materialize(rows, "warc-read")
    whole = read.filter("response").withColumn("whole", F.col("fits"))
    times = read.filter("not response").groupBy("refers").agg(F.count("*").alias("n"))
    named = whole.select(header_field("WARC-Record-ID").alias("refers"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")).join(times, "refers")
    revisits = look_up(read.filter("not response"), materialize(named, "warc-named"), ["refers"], how="left")
    revisits = revisits.withColumn("whole", F.col("fits") & (F.col("payload_bytes") == 0)).withColumns({"payload_bytes": F.col("b"), "payload_digest": F.col("d")})
    both = whole.unionByName(revisits.drop("b", "d"))
    right = F.col("whole") & (F.col("named") == F.col("payload_digest")) & (F.col("said") == F.col("payload_bytes"))
    digest = F.when(F.coalesce(right, F.lit(False)), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("header"))).cast("string"))
    return both.select("header", "payload_bytes", digest.alias("payload_digest"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    read = read_back(archive(pages))
    number = lambda name: header_field(name).cast(pages.schema["page_id"].dataType)
    return read.select(number("X-Page").alias("page_id"), "payload_bytes", "payload_digest", header_field("WARC-Type").alias("record_type"), number("X-Refers-To-Page").alias("refers_to"))


OP9_SQL = f"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s, min(page_id) over (partition by coalesce(html, '')) as f from pages)
select page_id, octet_length(encode(h)) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', cast((cast('0x' || substr(s, cast(1 + 5 * (i // 4) as bigint), 5) as bigint) >> cast(5 * (3 - i % 4) as bigint)) & 31 as bigint) + 1, 1)), '') as payload_digest,
  case when page_id = f then 'response' else 'revisit' end as record_type,
  case when page_id = f then null else f end as refers_to
from p
"""
