"""Registered queries over small tables with odd rows: against their SQL where there is some, else against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from mizuhiki.llm import avi, langid, queries, simhash

from .test_operators import brute_fp, brute_measures, components, corpus

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(21)
    rows = [(*r[:4], r[4]) for r in corpus() if r[0] is not None]
    for i in range(400, 520):  # enough words to pass the base rules, some with symbols, repeats, long words
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(50, 140))]
        text = " ".join(words) + rng.choice(["", " # | # ", "\nsame line\nsame line", " a b c d a b c d"])
        rows.append((i, text, rng.choice(["xx", "yy", None]), rng.choice(["s0", "s1", None]), len(text)))
    return rows


def pages():
    rng = random.Random(22)
    html = ["same", "same", "", None, "<p>日本</p>", "x" * 5000]
    hosts = ["example.com", "WWW.Example.com", "a.net", "net", "b.org", "", "x.www.example.com"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/en/', '/es/x', '/fr/?q', '#/en/', '/en'])}", rng.choice(html)) for i in range(200)]
    return [*rows, (900, None, None), (901, "no url", "same"), (902, "ftp://net/es/", "z\r\n\r\nz")]


def conversations():
    rng = random.Random(23)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["a<b&c", "", None, "<|im_end|>", "日本\n", "x" * 3000])) for c in range(40) for t in range(rng.randint(1, 9))]
    return [*rows, *rows[:3], (None, 0, "user", "no id"), (None, 1, "assistant", "either"), (7, None, "user", "no turn")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (("documents", documents(), DOCUMENTS), ("pages", pages(), "page_id long, url string, html string"), ("conversations", conversations(), "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCUMENTS), ("pages", "page_id long, url string, html string"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return at


def plain(rows):
    value = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted(repr(tuple(value(r[k]) for k in sorted(r))) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    got = [r.asDict(recursive=True) for r in queries.queries()[name](spark, folder).collect()]
    assert plain(got) == plain(want) and len(want) > 30


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, nothing, name):
    found = queries.queries()[name](spark, nothing)
    assert [r["conv_id"] for r in found.collect()] == [-1] if name == "op2_chat" else found.count() == 0


def test_quality_measures_of_the_query(spark, folder):
    rows = documents()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in queries.queries()["op10_quality"](spark, folder).collect())
    assert got == Counter((r[0], *brute_measures(r[1])) for r in rows)


def test_language_by_other_compressors(spark, folder):
    """Sizes by compressors made here, one for each text and language."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    dictionaries = langid.train(docs.filter(~langid.held_out()))
    texts = {r[0]: r[1] for r in documents()}

    def sizes(text):
        data = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())).encode()
        if not data:
            return None
        out = {}
        for lang, content in dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(3, write_checksum=0, write_content_size=0, write_dict_id=0, min_match=3)
            one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            out[lang] = sum(len(one.compress(data[i : i + 16384])) for i in range(0, len(data), 16384))
        return out

    rows = queries.queries()["op1_langid"](spark, folder).collect()
    assert len(rows) == len(documents()) and set(dictionaries) == {"xx", "yy"}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        found = sizes(texts[r["doc_id"]])
        if found is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        best, second = sorted(found, key=lambda k: (found[k], k))
        assert (r["lang_pred"], r["margin"]) == (best, found[second] - found[best])
        assert r["score"] == pytest.approx((found[second] - found[best]) / found[second])


def test_simhash_query(spark, folder):
    rows = documents()
    fps = [brute_fp(r[1]) for r in rows]
    group = components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    least = defaultdict(list)
    for r, g in zip(rows, group):
        least[g].append(r[0])
    want = Counter((r[0], f"{f:016x}", min(least[g])) for r, f, g in zip(rows, fps, group))
    assert Counter(map(tuple, queries.queries()["op5_simhash"](spark, folder).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_shards_query(spark, folder):
    rows = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in documents())
    got = queries.queries()["op3_kdtree"](spark, folder).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == rows
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("bytes", None) and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_tokens_query(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in documents():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(library.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter(tuple(r) for r in queries.queries()["op7_bpe"](spark, folder).collect()) == want


def decode_bit_by_bit(data):
    """Samples of a lossless JPEG by its Huffman table, a bit at a time, with predictor 1 (T.81, annex H)."""
    at, lengths, symbols = 2, None, None
    while True:
        marker, size = struct.unpack_from(">HH", data, at)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFFC4:
            lengths, symbols = body[1:17], body[17:]
        elif marker == 0xFFC3:
            precision, rows, columns = struct.unpack_from(">BHH", body)
        elif marker == 0xFFDA:
            break
    codes, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            codes[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    bits = "".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\x00", b"\xff"))
    place, out = 0, np.zeros((rows, columns), int)
    for y in range(rows):
        for x in range(columns):
            n, code = 0, 0
            while (n, code) not in codes:
                code, n, place = code << 1 | int(bits[place]), n + 1, place + 1
            s = codes[n, code]
            v = int(bits[place : place + s] or "0", 2)
            place += s
            d = v if not s or v >> (s - 1) else v - (1 << s) + 1
            before = out[y, x - 1] if x else out[y - 1, 0] if y else 1 << (precision - 1)
            out[y, x] = before + d
    return out


def test_frames_by_another_decoder():
    rng = np.random.default_rng(5)
    for shape in ((1, 64), (3, 64), (9, 64)):
        for samples in (rng.integers(0, 256, shape), np.zeros(shape, int), np.tile([0, 255], shape[0] * 32).reshape(shape), rng.integers(97, 123, shape)):
            assert (decode_bit_by_bit(avi.encode_frame(samples.astype(np.uint8))) == samples).all()


def test_shots_by_another_count():
    rng = random.Random(6)
    for _ in range(20):
        frames = [np.full((4, 64), rng.choice([10, 10, 10, 100, 200]), np.uint8) for _ in range(30)]
        for f in frames:
            f[0, : rng.randint(0, 40)] = rng.randint(0, 255)
        share = [Counter(int(v) // 8 for v in f.ravel()) for f in frames]
        moves = [sum(abs(a[k] - b[k]) for k in range(32)) / 2 / 256 for a, b in zip(share, share[1:])]
        cuts, since = [0], 0
        for i, d in enumerate(moves):
            near = moves[max(since, i - 12) : i]
            mean = sum(near) / len(near) if near else 0
            spread = (sum((m - mean) ** 2 for m in near) / len(near)) ** 0.5 if near else 0
            if d > 0.25 and d > (mean + 3 * spread + 1e-12 if near else 0.25):
                cuts.append(i + 1)
                since = i + 1
        assert [a for a, _ in avi.shots(frames)] == cuts


def test_media_query(spark, folder):
    texts = {r[0]: (r[1] or "").encode() for r in documents()}
    for r in queries.queries()["op8_avi"](spark, folder).collect():
        spans = [x.split(":") for x in r["feature"].split(";")]
        payload = texts[r["doc_id"]] + b"\0" * (-len(texts[r["doc_id"]]) % 64 or (0 if texts[r["doc_id"]] else 64))
        frames = -(-len(payload) // 4096)
        assert spans[0][0] == "0" and spans[-1][1] == str(40 * frames) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        for a, b, mean in spans:
            part = payload[int(a) // 40 * 4096 : int(b) // 40 * 4096]
            assert float(mean) == pytest.approx(sum(part) / len(part), abs=1e-4)


def test_clashing_columns(spark, folder):
    """Columns of any name pass, but those that a result column replaces."""
    from mizuhiki.llm import bpe, mixing, quality

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    odd = ("score", "margin", "accepted", "lang_pred", "kept", "n_words", "word_length", "low", "n", "copy", "n_copies", "mix_key", "payload", "media", "clips", "ids", "decoded", "digest", "fp", "component", "rule", "bucket")
    clash = docs.withColumns({c: F.lit("own") for c in odd})
    own = lambda df, *replaced: all(r[c] == "own" for r in df.collect() for c in odd if c not in replaced)
    assert own(langid.classify(clash, {"xx": b"abc", "yy": b"xyz"}), "score", "margin", "accepted", "lang_pred")
    m = quality.measures(clash)
    assert own(quality.judge(m, quality.fences(m)), "kept", "n_words")
    assert own(mixing.mix(clash), "copy", "n_copies", "mix_key")
    assert own(simhash.drop_near_duplicates(clash))
    assert own(bpe.encode(clash, bpe.vocabulary()), "ids")
    media = avi.encode_media(clash.withColumn("body", F.col("text").cast("binary")), "body")
    assert own(media, "media") and own(avi.decode_media(media), "media", "payload", "clips")
    assert avi.decode_media(media.withColumn("media", F.lit(None).cast("binary"))).filter("payload is null").count() == 40
