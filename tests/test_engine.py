"""Goldens of the scalar functions and of whole runs."""

import json
import math
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mizuhiki import cli, config
from mizuhiki.functions import kernels as k
from mizuhiki.functions import text as t
from mizuhiki.operators.classify import classify, heavy_brands, master_brands
from mizuhiki.operators.components import connected_components
from mizuhiki.operators.normalize import normalize_records
from mizuhiki.operators.matches import find_matches
from mizuhiki.operators.merge import joined_codes
from mizuhiki.operators.pairs import all_pairs, block_sizes, blocked_pairs, candidate_pairs
from mizuhiki.operators.scoring import score_pairs
from mizuhiki.plans.resolve import process_uploads, run_pipeline, trace
from mizuhiki.sources.export import excluded_rows, csv_text, export_file_name, export_table, json_text, report_sheets, write_xlsx
from mizuhiki.sources.mapping import detect_source, map_columns
from mizuhiki.sources.readers import load_chain_names, load_records

RECORD = "record_index long, name string, phone string, address string, lat double, lng double, url string, source string"


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    cases = {"焼肉 大将 渋谷店": "焼肉大将", "鳥一郎 新宿店": "鳥一郎", "cafe": "cae", "株式会社 さくら": "さくら", "prince": "pre", "本店": "本店", None: "", "  ": "", "ＡＢＣ商店": "abc商"}
    assert dict(zip(cases, values(spark, t.normalize_name, cases))) == cases
    assert values(spark, t.strip_branch_suffix, ["マクドナルド新宿店", "鳥貴族新宿店", "テスト(新宿店)", "さくらモール店"]) == ["マクドナ", "鳥貴族新宿店", "テスト新宿店", "さくら"]


def test_phones(spark):
    cases = {"03-1234-5678": "0312345678", "+81-3-1234-5678": "0312345678", "0081 90 1234 5678": "09012345678", "０３ー１２３４ー５６７８": "0312345678", "12345": "", None: ""}
    assert dict(zip(cases, values(spark, t.normalize_phone, cases))) == cases


def test_addresses(spark):
    one = "東京都渋谷区道玄坂一丁目2番3号 渋谷ビル 3F"
    assert values(spark, t.normalize_address, [one, None, " ", "大阪市北区二三丁目", "港区芝5-1 タワービル"]) == ["東京都渋谷区道玄坂1-2-3", "", "", "大阪市北区nan丁目", "港区芝5-1"]
    assert values(spark, lambda c: t.normalize_address(c, True), [one]) == ["渋谷区道玄坂1-2-3"]
    assert [k.kanji_number(x) for x in ("十", "二十三", "百", "三百二十一", "〇", "二三", "百五")] == ["10", "23", "100", "321", "0", "NaN", "105"]


def test_urls(spark):
    cases = {
        "https://Example.com/A/?q=1#x": "https://example.com/A",
        "HTTP://example.com:80/a/b/": "http://example.com/a/b",
        "https://example.com:8443": "https://example.com:8443",
        "http://u:p@example.com/a/../b": "http://example.com/b",
        "http://example.com/日本": "http://example.com/%E6%97%A5%E6%9C%AC",
        "not a url/": "not a url",
        "Foo/": "foo",
        "": "",
        None: "",
    }
    assert dict(zip(cases, values(spark, t.normalize_url, cases))) == cases


def test_numbers(spark):
    assert values(spark, t.safe_number, ["1.5", " 2 ", "12d", "Infinity", "", None, "1e400", "-.5e1"]) == [1.5, 2.0, None, None, None, None, None, -5.0]


def test_similarity():
    assert round(k.jaro_winkler("鳥貴族", "鳥貴"), 4) == 0.9111
    assert round(k.jaro("焼鳥鳥一郎", "鳥一郎"), 4) == 0.5111
    assert k.jaro("居酒屋さくら", "さくら") == 0
    assert k.jaro_winkler("", "") == 1 and k.jaro_winkler("", "a") == 0
    assert round(k.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert k.fixed(35.6812365, 6) == "35.681236" and k.fixed(-2.5, 0) == "-3"


def test_geometry_and_ids(spark):
    row = spark.range(1).select(
        t.haversine_meters(F.lit(35.658), F.lit(139.701), F.lit(35.65801), F.lit(139.70101)).alias("a"),
        t.geo_cell(F.lit(-0.00125)).alias("cell"),
        t.store_id(F.lit("焼肉大将"), F.lit("0312345678"), F.lit(35.658), F.lit(139.701)).alias("one"),
        t.store_id(F.lit("居酒屋さくら"), F.lit("0311112222"), F.lit(35.657), F.lit(139.703)).alias("two"),
        t.store_id(F.lit("a"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("none"),
    ).first()
    assert round(row["a"], 2) == 1.43 and row["cell"] == -2
    assert (row["one"], row["two"]) == ("dcec34107fe022305c32", "a9a41abaa26e7f9346f9") and len(row["none"]) == 20


def test_hours_and_holidays(spark):
    assert values(spark, t.format_hours, ["月曜 11:00〜14:00", "月〜金 11:00〜14:00", "11：00～14：00、17:00-22:00", "", "不明"]) == ["全日：11:00〜14:00", "金：11:00〜14:00", "全日：11:00〜14:00 / 17:00〜22:00", "", "不明"]
    assert values(spark, t.format_holiday, ["火曜・水曜", "毎週火曜日", "不定休", "年中無休", None, "お盆"]) == ["火曜, 水曜", "火曜, 日曜", "不定休", "なし", "なし", "お盆"]


def test_malls(spark):
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string").select(t.mall_text(F.col("x"), F.lit("")).alias("s"))
    assert [r["p"] for r in df(["ルミネ新宿"]).select(t.mall_pattern(F.col("s")).alias("p")).collect()] == ["ルミネ"]
    assert sorted(map(str, [r["p"] for r in df(["ルミネ新宿", "ＰＡＲＣＯ", "プラザ3F", "プラザ", "Lalaport", "一般店舗", "光が丘IMA"]).select(t.mall_pattern(F.col("s")).alias("p")).collect()])) == sorted(map(str, ["ルミネ", "parco", "floor_with_プラザ", None, "lalaport", None, "光が丘IMA"]))


def test_charsets():
    assert k.sniff_charset(b"\xef\xbb\xbfa") == "utf-8" and k.sniff_charset(b"\xff\xfea\0") == "utf-16le"
    assert k.sniff_charset("店舗名,住所".encode("shift_jis")) == "shift_jis" and k.sniff_charset(b"name,phone") == "utf-8"


def test_brand_matcher():
    m = k.BrandMatcher(["鳥貴族", "日高屋", "ガスト", "酒場", "スターバックスコーヒー"], frozenset(config.GENERIC_CHAIN_WORDS), 0.94)
    assert m("鳥貴族")[:2] == ("exact", "鳥貴族")
    assert m("鳥貴族渋谷")[:2] == ("partial", "鳥貴族")
    assert m("スターバックス")[:2] == ("partial", "スターバックスコーヒー")
    assert m("大衆酒場しぶや")[0] == "none"
    names = ["日高", "ガスットト", "スターバクスコーヒ", "xyz", "屋高日", "鳥貴"]
    for n in names:  # the bound never hides the best
        best = max(k.jaro_winkler(n, b) for b in m.brands if b != "酒場")
        if m(n)[0] in ("similar", "none"):
            assert m(n)[2] == best


def test_chain_matcher(spark):
    brands = master_brands(spark, ("鳥貴族", "日高屋", "ガスト", "酒場", "鳥貴族"))
    assert brands == ["鳥貴族", "日高屋", "ガスト", "酒場"]
    df = spark.createDataFrame([(0, "鳥貴族 渋谷店", None, None, None, None, "", "google"), (1, "大衆酒場 しぶや", None, None, None, None, "https://x.jp/shop/1", "google"), (2, None, None, None, None, None, "", None)], RECORD)
    rows = {r["record_index"]: r for r in classify(normalize_records(df), brands).collect()}
    assert rows[0]["chain_flag"] and rows[0]["chain_decision"]["match_type"] == "exact" and rows[0]["chain_score"] == 80
    assert not rows[1]["chain_flag"] and rows[1]["chain_decision"]["reasons"] == ["chain_url_pattern"]
    assert rows[2]["chain_decision"]["reasons"] == ["empty_name"] and rows[2]["source"] == "unknown"


def test_signals_convict_without_a_brand(spark):
    rows = [(i, "さくら食堂本店", None, f"a{i}", None, None, "https://x.jp/store/1", "x") for i in range(5)]
    out = classify(normalize_records(spark.createDataFrame(rows, RECORD)), [])
    assert {(r["chain_score"], r["chain_flag"]) for r in out.collect()} == {(60, True)}
    assert heavy_brands(normalize_records(spark.createDataFrame(rows[:4], RECORD))).count() == 0


def test_reviews(spark):
    rows = [(0, "a", {"reviews": "x", "口コミ数": "650"}), (1, "b", {" Review_Count ": "250"}), (2, "c", {"reviews": ""})]
    df = spark.createDataFrame(rows, "record_index long, name string, raw map<string,string>").withColumn("source_columns", F.array())
    out = {r["record_index"]: r["chain_decision"]["reasons"] for r in classify(normalize_records(df), []).collect()}
    assert out == {0: ["reviews_500_plus"], 1: ["reviews_200_plus"], 2: []}


MERGE = [
    (0, "焼鳥 鳥一郎", "03-1111-2222", "東京都新宿区西新宿1-1-1", 35.69, 139.70, "https://maps.example/1", "google"),
    (1, "鳥一郎 新宿店", "03-1111-2222", "新宿区西新宿1丁目1-1", None, None, None, "tabelog"),
    (2, "鳥貴族 新宿店", "03-9999-9999", "新宿区2-2-2", None, None, None, "google"),
    (3, "海鮮 まる", "03-3333-4444", "新宿区3-3-3", None, None, None, "hotpepper"),
]


def test_run(spark):
    out = run_pipeline(spark.createDataFrame(MERGE, RECORD), config.Options(chain_names=("鳥貴族",), run_ts="2026-01-01 00:00:00"))
    s = out.summary.first()
    assert (s["input_count"], s["chain_excluded_count"], s["output_count"], s["merged_count"], s["duplicate_excluded_count"], s["duplicate_cluster_count"]) == (4, 1, 2, 1, 1, 1)
    store = {r["cluster"]: r for r in out.stores.collect()}
    assert store[0]["duplicate_score"] == 100 and store[0]["sources"] == ["google", "tabelog"] and store[0]["exclude_reason"] == ["duplicate"]
    assert store[0]["name"] == "焼鳥 鳥一郎" and store[0]["lat"] == 35.69 and store[0]["regular_holiday"] == "なし"
    assert [x["code"] for x in store[0]["logs"]].count("duplicate_match") == 2 and store[0]["logs"][-1]["code"] == "output_ready"
    assert out.duplicate_matches.first()["reasons"] == ["phone_match"]
    table = csv_text(export_table(out, include_excluded=True))
    assert table.splitlines()[0].endswith("normalized_name,normalized_address,duplicate_score,chain_flag,mall_flag,exclude_reason") and len(table.splitlines()) == 4
    assert json.loads(json_text(out))["summary"]["outputCount"] == 2


def test_malls_by_source_and_in_full(spark):
    rows = [(0, "カレー屋 イオンモール店", None, "A", None, None, None, "rocketnow"), (1, "うどん", None, "AEON MALL 2F", None, None, None, "menu"), (2, "そば イオンモール店", None, "B", None, None, None, "google"), (3, "一般店舗", None, "C", None, None, None, "google")]
    some = run_pipeline(spark.createDataFrame(rows, RECORD)).summary.first()
    assert (some["mall_excluded_count"], some["output_count"]) == (2, 2)
    full = run_pipeline(spark.createDataFrame(rows, RECORD), config.Options(exclude_commercial_facilities=True))
    assert full.summary.first()["mall_excluded_count"] == 3 and [r["name"] for r in full.stores.collect()] == ["一般店舗"]
    assert {x["code"] for r in full.mall_excluded.collect() for x in r["logs"]} >= {"excluded_commercial_facility"}


def test_exclusions_need_no_pairs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("pairs were made")

    monkeypatch.setattr("mizuhiki.plans.resolve.find_matches", refuse)
    out = run_pipeline(spark.createDataFrame(MERGE, RECORD), config.Options(chain_names=("鳥貴族",)))
    assert [(r["_part"], r["cluster"], r["exclude_reason"]) for r in excluded_rows(out).collect()] == [(1, 2, ["chain_store"])]


def scored(spark, left, right):
    df = normalize_records(spark.createDataFrame([(0, *left), (1, *right)], RECORD))
    got = score_pairs(all_pairs(df)).collect()
    return (got[0]["score"], got[0]["reasons"]) if got else None


def test_cascade(spark):
    base = ("さくら食堂", None, "新宿区1-2-3", None, None, None, "a")
    put = lambda **x: tuple(x.get(n, v) for n, v in zip(("name", "phone", "address", "lat", "lng", "url", "source"), base))
    phone = "03-1111-2222"
    assert scored(spark, put(phone=phone), put(phone=phone, name="さくら食堂2")) == (100, ["phone_match"])
    assert scored(spark, put(url="http://x.jp/a"), put(url="http://x.jp/a?b", name="別")) == (70, ["url_match"])
    assert scored(spark, put(), put()) == (90, ["name_and_address_exact_match"])
    assert scored(spark, put(phone=phone), put(phone="03-1111-2223", address="新宿区1-2")) == (80, ["similarity_match"])
    near = {"lat": 35.0, "lng": 139.0}
    assert scored(spark, put(phone=phone, **near), put(phone="03-1111-2223", address="新宿区1-2-4", **near)) == (50, ["similarity_match_rejected_different_address_numbers", "distance_and_name_match"])
    assert scored(spark, put(phone=phone, name="あああ", **near), put(phone=phone, name="いいい", **near)) is None
    assert scored(spark, put(name="", address=None), put(name="", address=None))[0] == 90  # empty equals empty


def test_matches_by_groups(spark, monkeypatch):
    """Against all pairs of all blocks: equal URLs with and without phones, addresses without numbers, neighbours."""
    rows = [(i, f"さくら食堂{i % 7}", f"03-0000-{i % 11:04d}" if i % 3 else None, f"新宿区西新宿{i % 5}-1-{i % 2}" if i % 4 else "新宿区西新宿", 35.0 + (i % 3) * 0.0001 + i % 2 * 360, 139.0 if i % 5 else None, f"http://x.jp/{i % 13}" if i % 6 else None, "a") for i in range(60)]
    df = normalize_records(spark.createDataFrame(rows, RECORD)).cache()
    want = sorted(map(repr, score_pairs(blocked_pairs(df)).collect()))
    found = find_matches(df, "blocked")
    assert sorted(map(repr, found.edges().collect())) == want and len(want) == found.count().first()[0] > found.named.count()
    sets = lambda links: sorted(map(tuple, connected_components(links, "left_idx", "right_idx").collect()))
    assert sets(found.links()) == sets(found.edges())
    monkeypatch.setattr("mizuhiki.operators.matches.blocked_pairs", None)  # summaries and exports make no pairs of URLs
    out = run_pipeline(spark.createDataFrame(rows, RECORD), config.Options(pairing="blocked"))
    assert out.summary.first()["merged_count"] == len(want)


@pytest.mark.parametrize("pairing", ["blocked", "all"])
def test_codes_are_counted(spark, monkeypatch, pairing):
    """Codes of brief stores and of their records are those of all logs, and are found without a pair of URLs."""
    rows = [(i, f"さくら食堂{i % 7}" if i % 10 else "鳥貴族 新宿店", f"03-0000-{i % 11:04d}" if i % 3 else None, f"新宿区西新宿{i % 5}-1-{i % 2}" if i % 4 else None, 35.0 + i % 9, 139.0, f"http://x.jp/{i % 13 % 5 * 7 % 6}" if i % 6 else None, "a") for i in range(90)]
    rows += [(100 + i, f"{'ABC'[i]}屋", None, None, None, None, f"http://y.jp/{i}", "b") for i in range(3)]  # alone
    rows += [(110 + i, "一二三四", "03-9999-0000", None, None, None, "http://z.jp", "b") for i in range(3)]  # a URL with one phone
    out = run_pipeline(spark.createDataFrame(rows, RECORD), config.Options(pairing=pairing, chain_names=("鳥貴族",), run_ts="2026-01-01 00:00:00"))
    names = lambda entries: ",".join(x["code"] for x in entries)
    want = {r["cluster"]: r for r in out.stores.collect()}
    assert {names(r["logs"]).count("duplicate_match") for r in want.values()} >= {0, 6} and len(want) > 4
    for made in ("blocked_pairs", "edges_by_url"):
        monkeypatch.setattr(f"mizuhiki.operators.matches.{made}", None)
    for share in (1000, 3):
        monkeypatch.setattr("mizuhiki.operators.skew.SHARE", share)
        got = out.brief_stores.withColumn("text", joined_codes(F.col("codes"))).collect()
        assert sorted(r["cluster"] for r in got) == sorted(want)
        for r in got:
            same = want[r["cluster"]]
            assert r["text"] == names(same["logs"])
            assert [",".join(x["code"] for x in y["codes"] for _ in range(x["times"])) for y in r["raw_records"]] == [names(y["logs"]) for y in same["raw_records"]]
            assert all(r[c] == same[c] for c in out.stores.columns if c not in ("logs", "raw_records"))
        del out.__dict__["brief_stores"]


def test_edges_of_urls_in_grids(spark, monkeypatch):
    """brief_edges() against edges(), with parts, batches and masks of any size: phones, nulls, long and wide names among them."""
    from mizuhiki.functions import grid
    from mizuhiki.operators import matches

    names = ["さくら食堂", "さくら食堂2", "abc " * 18, "abc " * 17 + "x", "", "a", "b", "鳥😀", "cab bac", "ab"]
    columns = "record_index long, normalized_name string, normalized_phone string, normalized_address string, normalized_url string, lat double, lng double"
    rows = [(i, None if i == 77 else names[i % 10] + str(i % 4 or ""), str(i % 9 or ""), f"town {i % 8}-{i % 3}", f"u{i % 13 % 4}" if i % 6 else f"v{i}", None if i % 7 == 0 else 35.0 + i % 5 * 0.003, 139.0 + i % 3 / 7) for i in range(160)]
    found = find_matches(spark.createDataFrame(rows, columns).cache(), "blocked")
    want = sorted(map(repr, found.edges().drop("address_similarity", "matched_on").collect()))
    assert len(want) > found.named.count() > 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for part in (1024, 5):
            monkeypatch.setattr(matches, "_GRID", part)
            assert sorted(map(repr, found.brief_edges().collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # workers don't see what is set here, so sizes are varied without them
    rows.sort(key=lambda r: (r[0] % 3, r[0] % 2))
    columns = {"g": [r[0] % 3 for r in rows], "a": [0] * 160, "b": [int(r[0] % 3 > 0) for r in rows], "side": [r[0] % 2 for r in rows], "id": [r[0] for r in rows], "name": [r[1] for r in rows], "phone": [r[2] for r in rows], "lat": [r[5] for r in rows], "lng": [r[6] for r in rows]}
    meets = lambda l, r: l[0] % 3 == r[0] % 3 and (l[0] % 3 == 0 or l[0] % 2 < r[0] % 2) and (not l[2] or l[2] != r[2])  # noqa: E731, E741
    for small, batch in ((64, 1 << 16), (0, 1 << 16), (0, 10), (64, 1)):
        monkeypatch.setattr(grid, "_SMALL", small)
        monkeypatch.setattr(grid, "_BATCH", batch)
        got = [x for made in grid.pairs_of_groups(iter(pa.table(columns).to_batches(max_chunksize=9))) for x in made.to_pylist()]
        assert sorted((x["x"], x["y"]) for x in got) == sorted((l[0], r[0]) for i, l in enumerate(rows) for j, r in enumerate(rows) if meets(l, r) and (i < j or l[0] % 3))
        said = {r[0]: r[1] for r in rows}
        similarity = lambda x, y: None if None in (x, y) else float(k.fixed(k.jaro_winkler(x, y), 4))
        assert all(x["name_similarity"] == similarity(said[x["x"]], said[x["y"]]) for x in got)


def test_small_groups_are_compared_at_once(monkeypatch):
    """No pair of plain names is compared alone, also in groups of some dozen rows; names of several sizes meet, each once."""
    import random

    from mizuhiki.functions import grid

    draw = random.Random(9)
    said = ["".join(draw.choices("abc 01#日", k=draw.randint(0, 63))) for _ in range(20)] + ["".join(draw.choices("ab1", k=draw.randint(0, 9))) for _ in range(40)]
    sides = [0] * 25 + [1] * 35

    def alone(a, b):
        raise AssertionError("a pair was compared alone")

    for chosen in (range(60), range(20, 60)):  # masks of 64 and of 32 bits
        for b in (0, 1):
            rows = list(chosen)
            table = pa.table({"g": [4] * len(rows), "a": [0] * len(rows), "b": [b] * len(rows), "side": [b and sides[i] for i in rows], "id": rows, "name": [said[i] for i in rows], "phone": ["7" if i % 10 == 0 else "" for i in rows], "lat": [35.0] * len(rows), "lng": [139.0] * len(rows)})
            for tile in (1 << 15, 100):
                with monkeypatch.context() as m:
                    m.setattr(grid, "_similarity", alone)
                    m.setattr(grid, "_TILE", tile, raising=False)
                    got = sorted((x["x"], x["y"], x["name_similarity"]) for made in grid.pairs_of_groups(iter(table.to_batches())) for x in made.to_pylist())
                meet = lambda i, j: (sides[i] < sides[j] if b else i < j) and (i % 10 or j % 10)
                assert got == [(i, j, float(k.fixed(k.jaro_winkler(said[i], said[j]), 4))) for i in rows for j in rows if meet(i, j)]


def test_names_by_masks():
    import random

    from mizuhiki.functions.grid import Names, rounded

    draw = random.Random(5)
    names = [None, "", "a", "a", "鳥😀", "x" * 64, "x" * 65, "y" * 63 + "x", *("".join(draw.choices(letters, k=draw.randint(0, most))) for most, letters in ((3, "ab"), (12, "ab"), (70, "abc日本"), (30, "abcdefgh 012#")) for _ in range(60))]
    against = Names(names)
    for start in (0, 6, 100):
        for x in names:
            want = [None if x is None or y is None else k.jaro_winkler(x, y) for y in names[start:]]
            assert [None if math.isnan(s) else s for s in against.similarities(x, start).tolist()] == want
    values = np.array([0.0, 0.125, 1.005, 2.675, 0.00005, 1.00005, 8.5e9, 19999999.995, *(draw.random() for _ in range(3000)), *(round(draw.random(), 5) for _ in range(3000))])
    for digits in (2, 4):
        assert rounded(values, digits).tolist() == [float(k.fixed(v, digits)) for v in values.tolist()]
    assert np.isnan(rounded(np.array([np.nan, np.inf]), 2)).all()


def test_cells_have_all_neighbours(spark):
    """Points within reach, also of poles and beyond 180 degrees: the cell of one is among the near cells of the other."""
    import random

    from mizuhiki.functions.text import haversine_meters
    from mizuhiki.operators.matches import _with_cells

    draw = random.Random(3)
    at = [(draw.choice((35.0, 89.9999, -90.0, 400.0)) + draw.uniform(-0.001, 0.001), draw.choice((139.0, 180.0, -180.0, 900.0)) + draw.uniform(-0.001, 0.001)) for _ in range(300)] + [(None, 1.0), (math.nan, 1.0), (35.0, None)]
    placed = _with_cells(spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "i int, lat double, lng double"), 50.0).cache()
    assert placed.columns == ["i", "lat", "lng", "cell", "near"]
    l, r = placed.alias("l"), placed.alias("r")
    close = l.join(r, haversine_meters(F.col("l.lat"), F.col("l.lng"), F.col("r.lat"), F.col("r.lng")) <= 50).filter("l.i < 300 and r.i < 300")
    assert close.count() > 600
    assert close.filter(~F.array_contains("r.near", F.col("l.cell"))).count() == 0
    assert placed.filter("i < 300").agg(F.max(F.size("near"))).first()[0] <= 8


def test_blocks(spark):
    rows = [(i, f"さくら食堂{i % 7}", f"03-0000-{i % 11:04d}", f"新宿区西新宿{i % 5}-1-1", 35.0 + (i % 3) * 0.0001, 139.0, f"http://x.jp/{i % 13}", "a") for i in range(40)]
    df = normalize_records(spark.createDataFrame(rows, RECORD)).cache()
    every = {(r["left_idx"], r["right_idx"]): r for r in all_pairs(df).collect()}
    assert len(every) == 40 * 39 // 2
    cell = lambda x: (int((x["lat"] * 2000 + 0.5) // 1), int((x["lng"] * 2000 + 0.5) // 1))
    share = lambda l, r: l["normalized_phone"] == r["normalized_phone"] or l["normalized_name"][:4] == r["normalized_name"][:4] or l["normalized_address"][:10] == r["normalized_address"][:10] or l["normalized_url"] == r["normalized_url"] or cell(l) == cell(r)  # noqa: E731, E741
    got = [(r["left_idx"], r["right_idx"]) for r in blocked_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p, r in every.items() if share(r["l"], r["r"])}
    assert candidate_pairs(df, "auto", 39).count() == len(got) and candidate_pairs(df, "auto", 40).count() == len(every)
    assert block_sizes(df).filter("kind = 'phone'").agg(F.sum("n")).first()[0] == 40
    with pytest.raises(ValueError):
        candidate_pairs(df, "none")


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr("mizuhiki.operators.components.SMALL", small)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    loops = [(7, 7), (500, 500)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star + loops + chain[:3], "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    named = connected_components(spark.createDataFrame([("b", "é"), ("é", "日本"), (None, "b"), ("x", "y")], "src string, dst string"))
    assert sorted(map(tuple, named.collect())) == [("b", "b"), ("x", "x"), ("y", "x"), ("é", "b"), ("日本", "b")]


def test_sources(spark):
    one = lambda row, fallback="": spark.createDataFrame([row]).select(detect_source(spark.createDataFrame([row]), fallback).alias("s")).first()["s"]
    assert one({"google_map_url": "x"}) == "google" and one({"my_tabelog_url": "x"}) == "tabelog" and one({"Coupon ": "x"}) == "hotpepper"
    assert one({"url": "https://tabelog.com/1"}) == "tabelog" and one({"url": "https://maps.google.co.jp"}) == "google"
    assert one({"媒体": "ホットペッパー2"}) == "hotpepper" and one({"site": "Other"}) == "other" and one({"a": "x"}, "Google_0401.csv") == "google" and one({"a": "x"}) == "unknown"


def test_mapping(spark):
    df = spark.createDataFrame([("", "店A", "11:00", "水", "https://tabelog.com/1", "12.5")], "name string, `店舗名` string, raw_business_hours string, `定休日` string, url string, `緯度` string")
    r = map_columns(df).first()
    assert r["name"] == ""  # the first alias that is a column wins, blank or not
    assert r["source"] == "tabelog" and r["business_hours"] == "11:00" and r["regular_holiday"] == "11:00" and r["lat"] == 12.5 and r["raw"]["店舗名"] == "店A"


def test_loaders_and_exports(spark, tmp_path, monkeypatch):
    a, b, c, broken = tmp_path / "google.csv", tmp_path / "tabelog.json", tmp_path / "sjis.csv", tmp_path / "broken.json"
    a.write_text('﻿name,phone,address,lat,lng,url,source\n"焼肉 大将 渋谷店",03-1234-5678,東京都渋谷区道玄坂1-2-3,35.658,139.701,https://google.com/1,google\n\n,03,x,,,,google\n"居酒屋, ""さくら""",03-1111-2222,a,35.657,139.703,https://google.com/3,google\n', encoding="utf-8")
    b.write_text(json.dumps([{"name": "焼肉大将", "phone": "0312345678", "address": "渋谷区道玄坂一丁目2-3", "lat": 35.65801, "lng": 139.70101, "url": "https://tabelog.com/1", "source": "tabelog"}]), encoding="utf-8")
    c.write_bytes("店舗名,電話番号\n中華料理屋,03-5555-6666\n".encode("shift_jis"))
    broken.write_text('[{"name": "a"', encoding="utf-8")
    paths = [f"file://{x}" for x in (a, b, c)]
    loaded = load_records(spark, paths, encoding="auto")
    rows = loaded.orderBy("record_index").collect()
    assert [(r["record_index"], r["name"]) for r in rows] == [(0, "焼肉 大将 渋谷店"), (1, '居酒屋, "さくら"'), (2, "焼肉大将"), (3, "中華料理屋")]
    assert [r["source"] for r in rows] == ["google", "google", "tabelog", "sjis.csv"]
    with pytest.raises(ValueError):
        load_records(spark, [*paths, f"file://{broken}"]).count()
    with pytest.raises(ValueError, match="Unsupported"):
        load_records(spark, ["file:///tmp/a.txt"])
    assert load_records(spark, ["file:///tmp/a.txt", *paths], on_error="skip", encoding="auto").count() == 4
    out = run_pipeline(loaded)
    assert out.summary.first()["output_count"] == 3
    text = csv_text(export_table(out))
    assert '"居酒屋, ""さくら"""' in text and text.splitlines()[0].startswith("name,phone,address,lat,lng,url,source,店舗名,電話番号,")
    write_xlsx(report_sheets(out), str(tmp_path / "o.xlsx"))
    assert (tmp_path / "o.xlsx").stat().st_size > 1000
    said = json.loads(json_text(out))
    assert list(said) == ["summary", "stores", "chainExcluded", "mallExcluded", "duplicateMatches"]
    assert {"inputCount", "outputCount", "duplicateClusterCount", "excludeReasonsStats"} <= set(said["summary"]) and said["summary"]["outputCount"] == 3
    store = said["stores"][0]
    assert {"storeId", "normalizedName", "duplicateScore", "rawRecords", "chain_flag", "exclude_reason", "createdAt", "businessHours"} <= set(store)
    assert store["logs"][0]["timestamp"].endswith("Z") and {"businessHours", "logs"} <= set(store["rawRecords"][0])
    assert said["stores"][-1]["lat"] is None
    match = said["duplicateMatches"][0]
    assert (match["leftIndex"], match["rightIndex"], match["evaluation"]["pairKey"], match["evaluation"]["matchedOn"]["phone"]) == (0, 2, "0:2", True)
    assert trace(out.classified).filter("record_index = 3").first().asDict() == {"record_index": 3, "normalized_name": "中華料理屋", "normalized_phone": "0355556666", "normalized_address": "", "chain_matched": None, "chain_score": 0, "mall_matched": False, "excluded": False}
    monkeypatch.setattr("mizuhiki.sources.export.MAX_ROWS", 2)
    with pytest.raises(ValueError, match="more than 2 rows"):
        json_text(out)
    monkeypatch.undo()
    sheets = report_sheets(out)
    assert sheets["重複排除済み"].count() == 1 and sheets["統合データ"].filter("`重複` = 'あり'").count() == 1


def test_chain_masters(spark, tmp_path):
    (tmp_path / "a.json").write_text('["x", " y ", ""]')
    (tmp_path / "b.json").write_text('{"chains": ["z"]}')
    (tmp_path / "c.csv").write_text("brand,n\nfoo,1\nbar,2\n")
    assert [load_chain_names(spark, f"file://{tmp_path}/{n}") for n in ("a.json", "b.json", "c.csv")] == [("x", "y"), ("z",), ("foo", "bar")]
    with pytest.raises(ValueError):
        load_chain_names(spark, "file:///tmp/a.xml")


def test_uploads(spark):
    files = [("a/Google map 渋谷.csv", "店名,電話番号\nさくら,03-1111-2222\n,1\n".encode("shift_jis")), ("b", "\ufeffname,phone,source\nさくら 本店,0311112222,x\n鳥貴族,,x\n".encode()), ("empty.csv", b"")]
    out = process_uploads(spark, files, chain_names=["鳥貴族"])
    assert out.summary.first()["input_count"] == 3 and out.summary.first()["chain_excluded_count"] == 1
    assert [(r["n"], r["sources"]) for r in out.stores.select(F.size("raw_records").alias("n"), "sources").collect()] == [(2, ["google", "x"])]
    for nothing in ([], [("x.csv", b"name\n")]):
        with pytest.raises(ValueError):
            process_uploads(spark, nothing)


def test_file_names():
    now = datetime(2026, 1, 2, 3, 4)
    name = lambda *x: export_file_name(x, "csv", now)
    assert name() == "店舗統合結果_20260102_0304.csv"
    assert name("Google Map_渋谷 焼肉！x.y.csv", "b.csv") == "渋谷_焼肉_x_重複統合結果_20260102_0304.csv"
    assert name("tabelog.csv") == "店舗_重複統合結果_20260102_0304.csv"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("name,phone,address,source\nルミネ食堂,03-1111-2222,x,google\nルミネ食堂 本店,0311112222,x,tabelog\n鳥貴族,,y,google\n", encoding="utf-8")
    (tmp_path / "chains.json").write_text('["鳥貴族"]', encoding="utf-8")
    common = ["--input", f"file://{tmp_path}/a.csv", "--chain-db", f"file://{tmp_path}/chains.json"]
    cli.main([*common, "--output", str(tmp_path / "o.json"), "--report", "--trace", f"file://{tmp_path}/trace"])
    assert "suspicious_stores" in capsys.readouterr().out
    assert json.loads((tmp_path / "o.json").read_text())["summary"]["outputCount"] == 1
    assert spark.read.json(f"file://{tmp_path}/trace").filter("excluded").count() == 1
    cli.main([*common, "--output", str(tmp_path / "o.csv"), "--includeExcluded"])
    assert len((tmp_path / "o.csv").read_text().splitlines()) == 3
    cli.main([*common, "--output", f"file://{tmp_path}/folder"])
    assert spark.read.json(f"file://{tmp_path}/folder/stores").first()["storeId"]
    result = run_pipeline(load_records(spark, [f"file://{tmp_path}/a.csv"]))
    report = cli.issue_report(result)
    assert report["suspicious_stores"].count() == 1 and report["top_matches"].count() == 1 and report["chain_excluded"].count() == 0
    n, first = cli.dump(load_records(spark, [f"file://{tmp_path}/a.csv"]))
    assert n == 3 and first["name"] == "ルミネ食堂" and first["record_index"] == 0
