"""Every engine query with SQL against that SQL, on the smallest test tables; the driver's entry; streams."""

import dataclasses
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mizuhiki import config
from mizuhiki.functions.text import best_name_similarity
from mizuhiki.operators.classify import classify, heavy_brands
from mizuhiki.operators.normalize import normalize_records
from mizuhiki.operators.pairs import blocked_pairs, candidate_pairs
from mizuhiki.plans import queries as engine
from mizuhiki.streaming.stateless import clean_stream, resolve_batches, score_stream

SF = Path("/root/testdata/sf0.001")


def plain(rows):
    def value(x):
        return round(x, 6) + 0.0 if isinstance(x, float) else x

    return sorted(repr(tuple(value(r[k]) for k in sorted(r))) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_oracle(spark, duck, name):
    got = [r.asDict(recursive=True) for r in engine.QUERIES[name](spark, str(SF)).collect()]
    cursor = duck.execute(engine.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert plain(got) == plain([dict(zip(columns, r)) for r in cursor.fetchall()])


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(engine.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_auto_pairing_over_whole_inputs(spark):
    """All pairs of 500 records, and blocks beyond, by brute force; no registered query is on an id subset."""
    columns = "record_index long, normalized_name string, normalized_phone string, normalized_address string, normalized_url string, lat double, lng double"
    rows = [(i, f"{i % 90:04d} shop", str(i % 70 or ""), f"town {i % 110}-1", f"u{i % 130}" if i % 3 else "", 35.0 + i % 60 if i % 2 else None, 139.0) for i in range(501)]
    cell = lambda r: None if r[5] is None else (r[5], r[6])
    keys = [(r[2] or None, r[1][:4], r[3][:10] if len(r[3]) >= 6 else None, r[4] or None, cell(r)) for r in rows]
    pairs_of = lambda df: sorted(map(tuple, candidate_pairs(df).select("left_idx", "right_idx").collect()))
    assert pairs_of(spark.createDataFrame(rows[:500], columns)) == [(i, j) for i in range(500) for j in range(i + 1, 500)]
    assert pairs_of(spark.createDataFrame(rows, columns)) == [(i, j) for i in range(501) for j in range(i + 1, 501) if any(a is not None and a == b for a, b in zip(keys[i], keys[j]))]
    assert not any("record_index <" in sql.replace("record_index < r.record_index", "") for sql in engine.ORACLES.values())


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_names_make_pairs_of_their_own(spark):
    others = tuple(k for k in engine.BLOCK_SQL if k != "name")
    got = {n: {tuple(r) for r in engine.QUERIES[n](spark, str(SF)).collect()} for n in ("block_pairs_name", "block_pairs_union")}
    without = {tuple(r) for r in blocked_pairs(engine.normalized_listings(spark, str(SF)), others).select("left_idx", "right_idx").collect()}
    assert got["block_pairs_name"] - without and got["block_pairs_union"] == got["block_pairs_name"] | without


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_whole_run_links_listings_without_phone(spark):
    got = engine.QUERIES["resolve_stores"](spark, str(SF)).collect()
    summary = engine.QUERIES["run_summary"](spark, str(SF)).first()
    assert any(r["n_records"] > 1 and not r["phone"] for r in got)
    assert summary["chain_excluded_count"] > 0
    assert sum(r["n_records"] for r in got) + summary["chain_excluded_count"] == engine.listings(spark, str(SF)).count()  # no listing is lost


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_merged_fields_make_no_pairs_of_urls(spark, monkeypatch):
    monkeypatch.setattr(engine, "OPTIONS", dataclasses.replace(engine.OPTIONS, pairing="blocked"))  # as beyond 500 listings
    stores = engine.run_pipeline(engine.listings(spark, str(SF)).drop("k"), engine.OPTIONS).stores
    want = {r["cluster"]: ",".join(x["code"] for x in r["logs"]) for r in stores.select("cluster", "logs").collect()}
    for made in ("blocked_pairs", "edges_by_url"):
        monkeypatch.setattr(f"mizuhiki.operators.matches.{made}", None)
    got = {r["cluster"]: r["codes"] for r in engine.QUERIES["merged_fields"](spark, str(SF)).collect()}
    assert got == want and any("duplicate_match,duplicate_match" in x for x in got.values())


def test_large_blocks_are_parted(spark, monkeypatch):
    """Sub-blocks make the same pairs, each once."""
    rows = [(i, "same name" if i % 2 else f"{i:04d}", f"p{i % 7}", "", "", None, None) for i in range(120)]
    df = spark.createDataFrame(rows, "record_index long, normalized_name string, normalized_phone string, normalized_address string, normalized_url string, lat double, lng double")
    want = sorted((i, j) for i in range(120) for j in range(i + 1, 120) if i % 7 == j % 7 or i % 2 and j % 2)
    for share in (1000, 1):
        monkeypatch.setattr("mizuhiki.operators.pairs.SHARE", share)
        assert sorted(map(tuple, blocked_pairs(df).select("left_idx", "right_idx").collect())) == want


def test_pairs_are_unpacked_from_chunks(spark, monkeypatch):
    """Chunks and slices of any size make the pairs of all kinds of block, each once; no task's join makes pairs."""
    from mizuhiki.operators import pairs

    columns = "record_index long, normalized_name string, normalized_phone string, normalized_address string, normalized_url string, lat double, lng double"
    rows = [(i * 7 % 150, f"{i % 11:04d} shop", str(i % 70 or ""), f"town {'x' * (i % 3)}-1", f"u{i % 4}" if i % 5 else "", 35.0 + i % 60 if i % 2 else None, 139.0) for i in range(150)]
    df = spark.createDataFrame(rows, columns)
    keys = {r[0]: (r[2] or None, r[1][:4], r[3][:10] if len(r[3]) >= 6 else None, r[4] or None, None if r[5] is None else (r[5], r[6])) for r in rows}
    want = [(i, j) for i in range(150) for j in range(i + 1, 150) if any(a is not None and a == b for a, b in zip(keys[i], keys[j]))]
    for chunk, size, share in ((2048, 256, 1000), (7, 2, 1000), (1, 1, 1000), (10, 256, 1)):
        for name, value in (("_CHUNK", chunk), ("_SLICE", size), ("SHARE", share)):
            monkeypatch.setattr(pairs, name, value)
        assert sorted(map(tuple, pairs.block_pairs(df).collect())) == want
        whole = pairs.blocked_pairs(df).select("left_idx", "right_idx", "l.normalized_name", "r.normalized_url").collect()
        assert sorted(map(tuple, whole)) == [(i, j, *(next(r[k] for r in rows if r[0] == n) for n, k in ((i, 1), (j, 4)))) for i, j in want]
    assert pairs.block_pairs(df.limit(0)).count() == pairs.block_pairs(df.limit(1)).count() == 0
    plan = pairs.block_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(y") < plan.index("Join")  # joined are chunks


def test_frequent_keys_stay_in_place(spark, monkeypatch):
    from mizuhiki.operators.skew import look_up, salted_join

    rows = [(None if i % 50 == 0 else min(i % 97, 9), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, i int")
    table = df.filter("k is not null and k <> 3").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most"))
    most = {r["k"]: r["most"] for r in table.collect()}
    for share in (1000, 3, 1):
        monkeypatch.setattr("mizuhiki.operators.skew.SHARE", share)
        for how in ("inner", "left"):
            got = sorted(map(str, look_up(df, table, ["k"], how=how).collect()))
            assert got == sorted(str(Row(k=k, i=i, most=most.get(k))) for k, i in rows if how == "left" or k in most)
        salted = salted_join(df, table.withColumnRenamed("k", "key"), "k", "key", F.col("i"))
        assert sorted(tuple(r) for r in salted.select("k", "i", "most").collect()) == sorted((k, i, most[k]) for k, i in rows if k in most)
    assert look_up(df, table.limit(0), ["k"], how="left").count() == 1000


def test_best_name_similarity(spark):
    r = spark.range(1).select(best_name_similarity(F.lit("鳥貴族"), F.lit("鳥貴")).alias("s")).first()
    assert round(r["s"], 4) == 0.9111


@pytest.mark.parametrize("facilities", [False, True])
def test_stream_scores_are_those_of_classify(spark, facilities):
    rows = [(i, "鳥貴族 新宿店" if i % 2 else f"さくら{i} 中央店", "rocket", ("イオンモール", "ルミネ 3F", "x")[i % 3], {"reviews": ("600", "300", "10")[i // 3 % 3]}) for i in range(18)]
    batch = normalize_records(spark.createDataFrame(rows, "record_index long, name string, source string, address string, raw map<string,string>"))
    options = config.Options(exclude_commercial_facilities=facilities)
    columns = ("record_index", "chain_score", "chain_flag", "mall_flag")
    got = score_stream(batch, ["鳥貴族"], heavy_brands(batch, options.chain.occurrence_from), options).select(*columns).collect()
    want = classify(batch, ["鳥貴族"], options).select(*columns).collect()
    assert sorted(got) == sorted(want) and len({r["chain_score"] for r in got}) > 3 and any(r["mall_flag"] for r in got)


def test_streams(spark, tmp_path):
    rows = [(i, "鳥貴族 新宿店" if i % 2 else "さくら", "rocket", "イオンモール" if i == 2 else "x") for i in range(6)]
    schema = "record_index long, name string, source string, address string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    batch = normalize_records(spark.createDataFrame(rows, schema))
    heavy = heavy_brands(batch, 3)
    stream = score_stream(clean_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), ["鳥貴族"], heavy)
    seen = []
    q = resolve_batches(stream, lambda df, _: seen.extend(df.select("record_index", "normalized_name", "chain_score", "mall_flag").collect()), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    got = {r["record_index"]: (r["normalized_name"], r["chain_score"], r["mall_flag"]) for r in seen}
    assert got[1][0].startswith("鳥貴族") and got[1][1] >= 65 + 30 and got[2] == ("さくら", 30, True) and got[0][2] is False
