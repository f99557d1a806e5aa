"""Operators against brute force, exact round trips and held-out accuracy; nulls, ties, repeated rows, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mizuhiki.llm import avi, bpe, chat, langid, mixing, quality, sharding, simhash, urlfilter, warc
from mizuhiki.session import materialize

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))


def corpus(seed=5, n=60):
    """Documents of two languages with copies, near copies, nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "xx" if i % 2 else "yy"
        rows.append((i, prose(rng, rng.randint(60, 120), "abcdefgh" if i % 2 else "mnopqrst"), lang, f"s{i % 3}"))
    base = rows[3][1].split()
    for k in range(12):
        near = list(base)
        near[(7 * k) % len(near)] = f"changed{k}"
        rows.append((100 + k, " ".join(near), "xx", "s0"))
    rows += [(200 + k, rows[4][1], "yy", "s1") for k in range(5)]
    rows += [(300, None, "xx", "s0"), (301, "", None, None), (302, " \n\t ", "yy", "s2"), (None, "ein wort", None, "s0"), (303, "123 456 !!", "xx", None)]
    rows += [(304, "ab cd " * 20000, "xx", "s0"), (305, "x" * 100_000, "yy", "s1"), (306, "héß 日本 🙂<|endoftext|> it's", "yy", "s1")]
    rows += [rows[5]] * 3  # repeated rows
    return [(*r, len(r[1] or ""), "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(corpus(), DOC).repartition(4), "docs")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


# --- 5 --------------------------------------------------------------------------------------------------------------
def brute_fp(text, words=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(n, linked):
    lead = list(range(n))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                lead[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_simhash(docs, nothing):
    rows = corpus()
    fps = [brute_fp(r[1]) for r in rows]
    group = components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    least = defaultdict(list)
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g].append(r[0])
    want = Counter((r[0], f, min(least[g], default=None)) for r, f, g in zip(rows, fps, group))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicate_classes(docs).collect())
    assert got == want
    assert simhash.near_duplicate_classes(nothing).count() == 0
    assert simhash.fingerprints(docs).filter("doc_id = 301").first()["fp"] == 0


@pytest.mark.parametrize("dense", [2048, 3])
def test_hamming_links(spark, dense):
    """Dense buckets are filed again; their links make the same components."""
    rng = random.Random(1)
    fps = []
    for _ in range(6):
        center = rng.getrandbits(64)
        fps += [center] + [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(40)]
    hot = rng.getrandbits(32) << 32
    fps += [hot | rng.getrandbits(32) for _ in range(30)] + [hot | 5, hot | 7, hot | 6, 0]
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), dense=dense).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert all((fps[at[e["a"]]] ^ fps[at[e["b"]]]).bit_count() <= 3 for e in edges)
    pairs = {frozenset((at[e["a"]], at[e["b"]])) for e in edges}
    assert components(len(fps), lambda a, b: frozenset((a, b)) in pairs) == components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


def test_simhash_finds_near_duplicates_by_itself(spark):
    """With no band of min-hashes: texts of one class of fingerprints are linked if they are alike, and others are not."""
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 4000)]
    other = [f"v{x}" for x in rng.integers(0, 10**6, 4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-8])), (3, " ".join(other)), (4, " ".join(words[:2000] + other[:2000])), (5, None)]
    prints = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows[:2]]
    assert (prints[0] ^ prints[1]) % (1 << 64) and ((prints[0] ^ prints[1]) % (1 << 64)).bit_count() <= simhash.DISTANCE
    got = simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), bands=0).collect()
    assert sorted(r["id"] for r in got if r["keeper"]) == [1, 3, 4, 5]


def test_near_duplicate_groups(docs, nothing):
    rows = corpus()
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set())
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    group = components(len(rows), alike)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    by_id = {r[0]: g for r, g in zip(rows, group)}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(by_id[i] for i in got) == sorted(set(group))  # one row of each group
    firsts = {g: min((r[0] is not None, r[0] or 0) for r, x in zip(rows, group) if x == g) for g in set(group)}
    assert sorted((i is not None, i or 0) for i in got) == sorted(firsts.values())
    assert simhash.drop_near_duplicates(nothing).count() == 0


# --- 1 --------------------------------------------------------------------------------------------------------------
def test_langid(spark, docs, nothing):
    rng = random.Random(2)
    letters = {"xx": "abcdefgh", "yy": "mnopqrst", "zz": "éèàbmñ"}
    lexicon = {k: [prose(rng, 1, v) + prose(rng, 1, v) for _ in range(60)] for k, v in letters.items()}
    rows = [(i, " ".join(rng.choices(lexicon[k], k=40)), k) for i in range(600) for k in [("xx", "yy", "zz")[i % 3]]]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, score string, accepted string")
    model = langid.train(df.filter(~langid.held_out()))
    assert sorted(model) == ["xx", "yy", "zz"] and all(len(x) <= 400_000 for x in model.values())
    out = langid.classify(df.select("doc_id", "text", "lang"), model).filter(langid.held_out()).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in out) and len(out) > 80
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    odd = {r["doc_id"]: r for r in langid.classify(docs.select("doc_id", "text"), model).collect()}
    for i in (300, 301, 302, 303):
        assert (odd[i]["lang_pred"], odd[i]["score"], odd[i]["accepted"]) == ("und", 0.0, False)
    assert odd[304]["lang_pred"] in model
    assert langid.classify(nothing, model).count() == 0 and langid.train(nothing) == {}
    assert {r["lang_pred"] for r in langid.classify(docs.select("text"), {}).collect()} == {"und"}
    one = langid.train(df.filter("lang = 'xx'"), rows=5, chars=50)
    assert len(one["xx"]) <= 5 * 51


# --- 10 -------------------------------------------------------------------------------------------------------------
def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_measures(spark, docs, nothing):
    rng = random.Random(3)
    extra = [" ".join(rng.choices("ab", k=rng.randint(0, 30))) + "\n" * rng.randint(0, 2) + "a # b|\n \na # b|\n" * rng.randint(0, 2) for _ in range(150)]
    df = docs.select("text").unionByName(spark.createDataFrame([(x,) for x in extra], "text string"))
    for r in quality.measures(df).collect():
        want = brute_measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.measures(nothing).count() == 0


def test_quality_verdicts(spark, docs, nothing):
    rng = random.Random(4)
    rows = [(prose(rng, 80) + (" ###" * 40 if i % 40 == 0 else ""), "xx", "s0", i % 40 == 0) for i in range(400)]
    rows += [(prose(rng, 80) + " |" * 10, "yy", "tables", False) for _ in range(200)]  # usual for this source
    df = spark.createDataFrame(rows, "text string, lang string, source string, bad boolean")
    measured = materialize(quality.measures(df), "m")
    limits = quality.fences(measured)
    assert all(r["kept"] != r["bad"] for r in quality.judge(measured, limits).collect())
    usual = {r["source"]: r["symbol_ratio_high"] for r in limits.collect()}
    assert usual["tables"] > usual["s0"]
    m = quality.measures(docs.select("text", "lang", "source"))
    assert quality.judge(m, quality.fences(m)).count() == docs.count()  # null languages and sources, groups that fail as a whole
    e = quality.measures(nothing)
    assert quality.judge(e, quality.fences(e)).count() == 0


def test_quality_fences_follow_sketches(spark):
    def row(lang, source, k):
        usual = source == "logs"
        # of 1,000 rows: 5 repeat more, 5 have longer words and 5 a symbol or two, all below any cutoff fixed for every source
        dup, repeat, length, symbols = (0.3, 0.2, 6.5, 0.02) if usual else (0.3 if k < 5 else 0.0, 0.2 if 5 <= k < 10 else 0.0, 6.5 if 10 <= k < 15 else 4.0 + k % 10 / 100, 0.02 if 15 <= k < 20 else 0.0)
        return (lang, source, k, 1000, round(length * 1000), round(symbols * length * 1000), round(dup * 100), 100, round(repeat * 1000), False)

    schema = "lang string, source string, k long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, base_failed boolean"
    rows = [row("xx", s, k) for s in ("prose", "logs") for k in range(1000)] + [row("xx", "few", k) for k in range(20)]
    measured = materialize(spark.createDataFrame(rows, schema), "m")
    limits = quality.fences(measured)
    judged = quality.judge(measured, limits).collect()
    assert {r["k"] for r in judged if r["source"] == "prose" and not r["kept"]} == set(range(20))
    assert all(r["kept"] for r in judged if r["source"] == "logs")
    of = {r["source"]: r for r in limits.collect()}
    assert all(of["logs"][f"{r}_high"] > of["prose"][f"{r}_high"] for r in quality.RATIOS)
    # nothing passes the base rules: no fence, and no row is kept
    failed = measured.withColumn("base_failed", F.lit(True))
    none = quality.fences(failed)
    assert none.count() == 0
    assert quality.judge(failed, none).filter("kept").count() == 0


def test_quality_fences_by_brute_force(spark):
    """Quantiles of sorted ratios, drawn to coarser groups; small and large groups, nulls, ties."""
    rng = random.Random(9)
    rows = []
    for lang, source, n in (("xx", "a", 500), ("xx", "b", 7), ("yy", "a", 120), (None, None, 30), ("yy", "odd", 1)):
        for _ in range(n):
            words = rng.randint(50, 400)
            rows.append((lang, source, words, rng.randint(3, 9) * words + rng.randint(0, 50), rng.choice([0, 0, rng.randint(0, 60)]), rng.choice([0, rng.randint(0, 5)]), rng.randint(5, 20), rng.randint(0, words // 2), rng.random() < 0.1))
    schema = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, base_failed boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def exact(of, rule):
        values = sorted(((r[names.index(rule.above)] << 20) // max(1, r[names.index(rule.below)])) for r in of)
        top = lambda v: v if v < 256 else (((v >> (v.bit_length() - 8)) + 1) << (v.bit_length() - 8)) - 1
        low, high = (top(values[max(0, -(-q * len(values) // 1000) - 1)]) for q in (rule.low, rule.high))
        return np.array([low - rule.spreads * (high - low), high + rule.spreads * (high - low)])

    want = {}
    passed = [r for r in rows if not r[-1]]
    for rule in quality.RULES:
        overall = exact(passed, rule)
        for lang in {r[0] for r in passed}:
            of = [r for r in passed if r[0] == lang]
            by_lang = (len(of) * exact(of, rule) + 100 * overall) / (len(of) + 100)
            for source in {r[1] for r in of}:
                own = [r for r in of if r[1] == source]
                low, high = (len(own) * exact(own, rule) + 100 * by_lang) / (len(own) + 100) / (1 << 20)
                want[lang, source, rule.ratio] = (low if rule.both_ways else None, max(high, quality.EPSILON))
    measured = materialize(spark.createDataFrame(rows, schema).repartition(5), "m")
    limits = quality.fences(measured)
    got = {(r["lang"], r["source"], x): (r[f"{x}_low"], r[f"{x}_high"]) for r in limits.collect() for x in quality.RATIOS}
    assert got.keys() == want.keys()
    for k, (low, high) in want.items():
        assert (got[k][0] is None) == (low is None) and got[k][1] == pytest.approx(high, rel=1e-12) and got[k][0] == (low and pytest.approx(low, rel=1e-12)), k

    def kept(r):
        value = lambda x: ((r[names.index(x.above)] << 20) // max(1, r[names.index(x.below)])) / (1 << 20)
        bounds = [(value(x), *want[r[0], r[1], x.ratio]) for x in quality.RULES] if not r[-1] else []
        return not r[-1] and all((low is None or v >= low) and v <= high for v, low, high in bounds)

    judged = quality.judge(measured.withColumn("kept", F.lit("clash")).withColumn("word_length", F.lit("own")), limits).collect()
    assert Counter((*(r[c] for c in names), r["kept"]) for r in judged) == Counter((*r, kept(r)) for r in rows)
    assert {r["word_length"] for r in judged} == {"own"}


def test_dimensions_of_any_range_order_rows(spark):
    for low, step in ((-500, 1), (1_700_000_000_000, 86_400_000), (-(1 << 62), 1 << 53)):
        df = spark.createDataFrame([(i, "word", low + step * (i * 7 % 1000)) for i in range(1000)], "doc_id long, text string, at long")
        out = sharding.kd_shards(df, [F.col("at")], shards=4).join(df, "doc_id").groupBy("shard").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
        assert [r["n"] for r in out] == [250] * 4 and all(x["b"] < y["a"] for x, y in zip(out, out[1:]))


# --- 6 --------------------------------------------------------------------------------------------------------------
def test_mixing(spark, docs, nothing):
    df = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(20000)], "doc_id long, source string")
    out = mixing.mix(df).groupBy("source").agg(F.count("*").alias("n")).collect()
    assert {r["source"]: abs(r["n"] - 10000) < 500 for r in out} == {"big": True, "small": True}
    counts = Counter(r["n_copies"] for r in mixing.mix(df).filter("source = 'small' and copy = 0").collect())
    assert abs(np.average(list(counts), weights=list(counts.values())) * sum(counts.values()) / 2000 - 5) < 0.25 and max(counts) > 9
    some = mixing.mix(df, {"small": 1.0, "absent": 3.0}, total=400)
    assert {r["source"] for r in some.select("source").distinct().collect()} == {"small"} and 300 < some.count() < 500  # absent sources weigh nothing
    got, again = (sorted(map(str, mixing.mix(docs).collect())) for _ in range(2))
    assert got == again
    assert mixing.mix(nothing).count() == 0
    big = mixing.rates(df.filter("source = 'small'").limit(1), total=1_000_000).select(F.size("cdf"), F.col("cdf")[F.size("cdf") - 1], F.col("cdf")[1_000_000]).first()
    assert big[0] > 1_000_000 and abs(big[1] - 1) < 1e-6 and abs(big[2] - 0.5) < 1e-3  # a rate of a million


def test_mixing_without_broadcast(spark, docs, monkeypatch):
    df = spark.createDataFrame([(i, "big" if i % 3 else None, "x") for i in range(3000)], "doc_id long, source string, copy string")
    of = lambda: sorted(map(str, mixing.mix(df).collect()))
    want = of()
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert of() == want and len(want) > 2500


def test_poisson_counts_by_brute_force(spark):
    """Each row's count, from the digest of its id and a plain sum of the distribution."""
    import math

    df = spark.createDataFrame([(i, f"s{min(i % 7, 2)}") for i in range(400)] + [(5, "s2"), (None, "s0")], "doc_id long, source string")
    n = Counter(r["source"] for r in df.collect())
    got = {(r["doc_id"], r["source"]): r["n_copies"] for r in mixing.mix(df).collect()}
    for r in df.collect():
        rate = 402 / 3 / n[r["source"]]
        u = int(hashlib.md5(f"count{mixing.SEED}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        assert got.get((r["doc_id"], r["source"]), 0) == k


# --- 7 --------------------------------------------------------------------------------------------------------------
def test_bpe(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    content = bpe.vocabulary()
    rng = random.Random(6)
    bits = ["a", " ", "  ", "\n", "é", "日本", "🙂", "½", "123", "'ll", "...", "<|endoftext|>", "the", "ing", "\x1c", " ", "ก", "𝒳", "İ", "_"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(2000)] + ["a" * 3000, " " * 999, "ab" * 1500, "\r\n\t x"]
    one, back = bpe.Encoder(content), bpe.Decoder(content)
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(one.encode(t), "<u4").tolist() == e.ids
        assert back.decode(one.encode(t)) == t
    out = bpe.encode(docs, content, decoded_col="decoded").collect()
    assert len(out) == docs.count()
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    coded = bpe.encode(docs.select("doc_id", "text"), content)
    assert bpe.decode(coded, content).filter(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert bpe.encode(nothing, content).count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------------
def test_sharding(spark, docs, nothing):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, "x" * rng.randint(0, 400), rng.choice("ab")) for i in range(3000)] + [(7, "y", "a")] * 500, "doc_id long, text string, lang string")
    out = sharding.kd_shards(df, [F.length("text"), F.crc32("lang")], shards=7).collect()
    assert len(out) == 3500
    sums, slots = Counter(), defaultdict(list)
    for r in out:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(sums) == list(range(7)) and max(sums.values()) - min(sums.values()) < 3000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    few = sharding.kd_shards(docs, [F.length("text")], target_bytes=50_000).collect()
    assert len(few) == docs.count() and max(r["shard"] for r in few) >= 3
    assert {r["text_crc32"] for r in few if r["doc_id"] == 300} == {0} and {r["size"] for r in few if r["doc_id"] == 300} == {8}
    assert sharding.kd_shards(nothing, [F.length("text")], shards=3).count() == 0


def brute_tree(rows, first, leaves, span, out):
    """rows: (values, tie, size, place). Cuts at the row where the sum reaches its aim, at its nearer end."""
    if leaves == 1 or not rows:
        out.update((r[3], first) for r in rows)
        return
    dims = range(len(rows[0][0]))
    wide = [(max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) / max(span[d], 1) for d in dims]
    d = wide.index(max(wide))
    rows = sorted(rows, key=lambda r: (r[0][d], r[1]))
    aim = sum(r[2] for r in rows) * (leaves // 2) / leaves
    k = total = 0
    while k < len(rows) and (total + rows[k][2] <= aim or total + rows[k][2] - aim < aim - total):
        total += rows[k][2]
        k += 1
    brute_tree(rows[:k], first, leaves // 2, span, out)
    brute_tree(rows[k:], first + leaves // 2, leaves - leaves // 2, span, out)


@pytest.mark.parametrize("kwargs", [{}, {"local": 40, "few": 10, "bins": 16}, {"local": 1, "few": 1, "bins": 4}])
def test_sharding_by_brute_force(spark, kwargs):
    """The same tree whether nodes are split by passes or finished by a task; distinct values, so that no tie decides."""
    rng = random.Random(11)
    a, b = rng.sample(range(-(10**6), 10**6), 600), rng.sample(range(10**12, 10**12 + 10**9), 600)
    rows = [(i, "x" * rng.randint(0, 300), a[i], b[i] if i % 50 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a long, b long").repartition(4)
    # several nulls tie; give each of the others a value of its own
    one = df.withColumn("b", F.when(F.col("b").isNull() & (F.col("doc_id") > 0), F.lit(10**13) + F.col("doc_id")).otherwise(F.col("b")))
    low = min(r["b"] for r in one.collect() if r["b"] is not None) - 1
    known = [((r["a"], low if r["b"] is None else r["b"]), 0, len(r["text"]) + 8, r["doc_id"]) for r in one.collect()]
    want: dict = {}
    brute_tree(known, 0, 13, [max(k[0][d] for k in known) - min(k[0][d] for k in known) for d in range(2)], want)
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(one, [F.col("a"), F.col("b")], shards=13, **kwargs).collect()}
    assert got == want


def test_many_leaves_and_ties(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod("id", F.lit(9)).cast("int")).alias("text"), F.lit("clash").alias("shard"))
    # all values tie: the written number tells rows apart, in passes as in a task
    for kwargs in ({}, {"local": 500, "few": 20, "bins": 8}):
        sums = Counter()
        for r in sharding.kd_shards(df, [F.lit(7), F.lit(None)], shards=16, **kwargs).collect():
            sums[r["shard"]] += r["size"]
        assert len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 5 * 16
    assert sharding.kd_shards(df, [F.length("text"), F.col("doc_id")], shards=10_000).agg(F.max("shard")).first()[0] > 9_000
    ends = spark.createDataFrame([(i, "x", v) for i, v in enumerate([-(1 << 63), (1 << 63) - 1, None, 0])], "doc_id long, text string, at long")
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(ends, [F.col("at")], shards=2).collect()}
    assert got[0] == got[2] == 0 and got[1] == got[3] == 1


# --- 2 --------------------------------------------------------------------------------------------------------------
def test_reply_trees(spark):
    nodes = [("t", "r", None, "user", "q", 0.0), ("t", "a", "r", "assistant", "<|im_end|> &lt; a", 1.0), ("t", "b", "r", "assistant", "b", 5.0), ("t", "c", "a", "user", None, 9.0), ("t", "d", "c", "assistant", "d", None)]
    nodes += [("u", "x", "missing", None, "alone", 1.0), ("v", "p", "q", "user", "cycle", 1.0), ("v", "q", "p", "user", "cycle", 1.0)]
    nodes += [("w", f"{i:04d}", f"{i - 1:04d}" if i else None, "us\ner" if i % 2 else "assistant", str(i), 1.0) for i in range(300)]
    nodes += [(None, "m", None, "user", "no tree", 1.0), (None, "n", "m", "assistant", "either", 1.0)]
    nodes += [("x", "r", None, "user", "a", 1.0), ("x", "r", None, "user", "b", 1.0), ("x", "r", None, "user", "a", 1.0), ("x", "s", "r", "assistant", "c", 1.0)]  # repeated nodes
    df = spark.createDataFrame([(*x, "clash") for x in nodes], "tree string, node string, parent string, role string, text string, score double, depth string")
    done = chat.format_paths(chat.paths(df, top=2))
    back = done.select("tree", "leaf", "branch", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    got = {(r["tree"], r["branch"]): r for r in back}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1), ("w", 1), (None, 1), ("x", 1)} and len(back) == 6
    assert [x["text"] for x in got[None, 1]["t"]] == ["no tree", "either"] and [x["text"] for x in got["x", 1]["t"]] == ["a", "c"]
    assert [x["text"] for x in got["t", 1]["t"]] == ["q", "<|im_end|> &lt; a", "", "d"] and got["t", 1]["loss"] == "<|im_end|> &lt; ad"
    assert [x["text"] for x in got["t", 2]["t"]] == ["q", "b"] and got["u", 1]["t"][0]["role"] == ""
    assert [x["text"] for x in got["w", 1]["t"]] == [str(i) for i in range(300)] and got["w", 1]["t"][1]["role"] == "us\ner"
    assert chat.paths(df.limit(0)).count() == 0


def test_long_conversations(spark):
    """Two hundred thousand turns in one path; loss spans in code points and bytes."""
    turns = spark.range(200_000).select(F.lit("t").alias("tree"), F.lit(1).alias("leaf"), F.lit(1).alias("branch"), F.col("id").alias("depth"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<"), F.col("id").cast("string")).alias("text"))
    row = chat.format_paths(turns).select("formatted", "loss", chat.read_loss(F.col("formatted"), F.col("loss")).alias("said"), F.size(chat.read_turns(F.col("formatted"))).alias("n")).first()
    assert row["n"] == 200_000 and row["said"] == "".join(f"é<{i}" for i in range(1, 200_000, 2))
    raw = row["formatted"].encode()
    for s in (row["loss"][0], row["loss"][777], row["loss"][-1]):
        assert row["formatted"][s["start"] : s["start"] + s["chars"]].encode() == raw[s["at"] : s["at"] + s["bytes"]]


def test_chat_query(table, spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a<|im_end|>"), (2, 0, None, None), (2, 0, None, None), (3, 0, "assistant", None)]
    out = {r["conv_id"]: r for r in chat.op2_chat(spark, table("conversations", rows, "conv_id long, turn long, role string, text string")).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "<|im_end|><|im_start|>assistant ok"
    assert out[-1]["turns_sha256"] == digest(f"user\n{said}\nassistant\n{said}\n") and out[-1]["loss_sha256"] == digest(said) and out[-1]["loss_chars"] == len(said)
    assert out[1]["turns_sha256"] == digest("user\na<|im_end|>\nassistant\nb\n") and out[1]["loss_sha256"] == digest("b")
    assert (out[2]["n_turns"], out[2]["loss_chars"], out[3]["loss_sha256"]) == (2, 0, digest(""))


# --- 4 --------------------------------------------------------------------------------------------------------------
def test_urls(spark):
    page = lambda i, u, h="": (i, u, h, "x")
    rows = [
        page(1, "http://www.Example.com/en/a?b"), page(2, "http://m.example.com/en/a#t"), page(3, "http://a.net/es/1"), page(4, "http://b.org/1", '<link rel="canonical" href="http://a.net/es/1">'),
        page(5, "http://c.org/2", "<META http-equiv='refresh' content='0; URL=http://b.org/1'>"), page(6, "http://d.org/3"), page(7, None), page(8, "no url"), page(9, "http://example.com"), page(9, "http://example.com"),
        page(10, "http://e.org/x/y", '<link href="../z" rel=canonical><link rel="canonical" href="/en/">'), page(11, "http://f.org/4", '<link rel="canonical" href="http://g.com/ok">'), page(12, "http://f.org/5", '<link rel="canonical" href="http://f.org/4"><link rel="canonical" href="http://h.net/fr/">'),
        page(13, "http://i.net/en#top"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[2] == ("m.example.com", "/en/a", "example.com/en/", "block")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == (None, "block") and got[5][2:] == (None, "block") and got[6][2:] == (None, "allow")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9] == ("example.com", "", None, "allow")
    assert got[11][3] == "allow" and got[12][3] == "allow"  # an explicitly allowed alias comes before a blocked one
    assert urlfilter.judge_urls(df.limit(0)).count() == 0 and urlfilter.judge_urls(df).count() == len(rows)
    more = urlfilter.judge_urls(df, redirects=spark.createDataFrame([("http://d.org/3", "http://a.net/es/1")], "src string, dst string"))
    assert more.filter("page_id = 6").first()["verdict"] == "block"
    assert urlfilter.judge_urls(df, rules=()).filter("verdict <> 'allow'").count() == 0


def brute_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fit, key=lambda r: (-len(r.host + r.path), r.verdict != "allow", r.host + r.path), default=None)


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_urls_by_brute_force(spark, monkeypatch, seed):
    """Random rules over random graphs of links and redirects; rules as a literal and as a joined table."""
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choices(["a", "b", "www", "Net"], k=rng.randint(1, 3)))
    path = lambda: "".join(rng.choices(["/", "/x", "/y/", "z"], k=rng.randint(0, 3)))
    rules = [urlfilter.Rule(rng.choice(["allow", "block", "block"]), host().lower(), "/" + path().lstrip("/")) for _ in range(10)] + [urlfilter.Rule("block", "a", "/x"), urlfilter.Rule("allow", "a", "/x")]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f', '/'])}" for _ in range(120)] + [None, "no url", "http://", "http://b", "http://b"]
    vertex = lambda u: u.split("#")[0]
    links, pages = [], []
    for i, u in enumerate(urls):
        html = None
        if u and "://" in u and rng.random() < 0.15:
            to = rng.choice([v for v in urls[:120] if v])
            links.append((vertex(u), vertex(to)))
            html = f"<p title='<link rel=canonical href=http://a/x/no>'><link data-href='http://a/x' rel='nofollow Canonical' href=\"{to}\">" + "<!-- <link rel=canonical href='http://a/x/no'> -->"
        pages.append((i, u, html, "clash"))
    jumps = [(rng.choice(urls[:120]), f"http://{host()}{path()}") for _ in range(5)]
    links += [(vertex(a), vertex(b)) for a, b in jumps]
    names = sorted({x for e in links for x in e})
    near = {frozenset(e) for e in links}
    group = dict(zip(names, components(len(names), lambda a, b: frozenset((names[a], names[b])) in near)))
    verdicts = defaultdict(set)
    for x, g in group.items():
        r = brute_rule(*split_url(x), rules)
        verdicts[g].add(r and r.verdict)
    want = {}
    for i, u, *_ in pages:
        h, p = split_url(u)
        r = brute_rule(h, p, rules)
        of = verdicts[group[vertex(u)]] if u and vertex(u) in group else set()
        want[i] = (h, p, r and r.host + r.path, r.verdict if r else "block" if "block" in of and "allow" not in of else "allow")
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    redirects = spark.createDataFrame(jumps, "src string, dst string")
    of = lambda rules: {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df, rules, redirects).collect()}
    assert of(rules) == want
    assert {w[3] for i, w in want.items() if w[2] is None} == {"allow", "block"}  # aliases decide some
    monkeypatch.setattr(urlfilter, "LITERAL", 0)
    assert of(rules) == want


def test_a_million_rules(spark):
    rules = spark.range(1_000_000).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), F.pmod("id", F.lit(1000)).cast("string"), F.lit(".org")).alias("host"), F.concat(F.lit("/p"), F.col("id").cast("string"), F.lit("/")).alias("path"))
    pages = spark.createDataFrame([(1, "http://www.h7.org/p5007/x"), (2, "http://h7.org/p5008/x"), (3, "http://H8.org/p5008/")], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in urlfilter.judge_urls(pages, rules, html_col=None).collect()}
    assert got == {1: "h7.org/p5007/", 2: None, 3: "h8.org/p5008/"}


def test_links_of_pages(spark):
    rows = [("http://e.org/x/y?q", x) for x in ("<link rel=canonical href=../z>", "<link rel=canonical href='?k=1&amp;l'>", "<link rel='a canonical b'href=//f.org/a>", "<script><link rel=canonical href='/no'></script>", "<linkx rel=canonical href='/no'>", "<meta http-equiv=Refresh content='1;url=w'/>", "<link rel=canonical href=''>", "<link rel=canonical title='x>y' href='/t'>", "<link rel=canonical href='http://[/'>")]
    got = [r["dst"] for r in urlfilter.link_edges(spark.createDataFrame(rows, "url string, html string").coalesce(1)).collect()]
    assert got == ["http://e.org/z", "http://e.org/x/y?k=1&l", "http://f.org/a", "http://e.org/x/w", "http://e.org/t", None]


# --- 9 --------------------------------------------------------------------------------------------------------------
def test_warc(spark, table):
    import base64

    rows = [(i, f"http://x/{i}", "same" if i % 3 == 0 else f"page {i}") for i in range(1, 20)] + [(50, None, None), (51, "u\r\nX: y", ""), (9, "http://x/9", "same"), (None, "n", "same")]
    schema = "page_id long, url string, html string, digest string"
    path = table("pages", [(*r, "clash") for r in rows], schema)
    out = warc.op9_warc(spark, path).collect()
    assert len(out) == len(rows)
    first = {h: min(i for i, _, x in rows if (x or "") == h and i is not None) for h in {r[2] or "" for r in rows}}
    html = {i: x or "" for i, _, x in rows}  # one text an id
    kinds = defaultdict(Counter)
    for r in out:
        h = html[r["page_id"]].encode()
        assert r["payload_bytes"] == len(h) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h).digest()).decode()
        kinds[h][r["record_type"]] += 1
        assert (r["record_type"], r["refers_to"]) in ((("response", None), ("revisit", first[h.decode()])) if r["page_id"] in first.values() else (("revisit", first[h.decode()]),))
    assert all(k["response"] == 1 for k in kinds.values())
    kept = warc.archive(spark.read.parquet(f"{path}/pages.parquet"), min_bytes=5)
    assert kept.payloads.count() == len(first)
    for r in warc.reconstruct(kept).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        http, _, body = rest[:-4].partition(b"\r\n\r\n")
        assert len(rest) == size + 4 and rest.endswith(b"\r\n\r\n") and r["digest"] == hashlib.sha256(html[r["id"]].encode()).hexdigest()
        revisit = b"WARC-Type: revisit" in head
        assert revisit == (len(html[r["id"]].encode()) >= 5 and r["id"] not in first.values()) or r["id"] == 9
        assert body.decode() == ("" if revisit else html[r["id"]]) and int(re.search(rb"Content-Length: (\d+)", http)[1]) == len(html[r["id"]].encode())
    plan = warc.reconstruct(kept)._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    assert warc.archive(spark.createDataFrame([], schema)).headers.count() == 0


def test_warc_records_are_read_back(spark):
    import base64

    rows = [(1, "u1", "one\r\n\r\ntwo"), (2, "u2", "one\r\n\r\ntwo"), (3, None, None), (None, "u4", "日本")]
    kept = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r["payload_bytes"], r["payload_digest"]) for r in warc.read_back(kept).collect()}
    assert got == {(len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for b in ((x[2] or "").encode() for x in rows)}
    for name, wrong in (("Content-Length", "9"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)):
        bad = kept.headers.withColumn("header", F.regexp_replace("header", rf"\r\n{name}: [^\r\n]*", f"\r\n{name}: {wrong}"))
        with pytest.raises(Exception, match="damaged record"):
            warc.read_back(warc.Archive(bad, kept.payloads)).collect()
    with pytest.raises(Exception, match="damaged record"):
        warc.read_back(warc.Archive(kept.headers.withColumn("http", F.lit("")), kept.payloads)).collect()


# --- 8 --------------------------------------------------------------------------------------------------------------
def test_avi_files():
    rng = random.Random(8)
    for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 50_000):
        payload = avi._pad(bytes(rng.choices(range(256), k=n)))
        assert len(payload) % 64 == 0 and len(payload) - n in range(0, 65)
        data = avi.write_avi(payload)
        assert int.from_bytes(data[4:8], "little") == len(data) - 8
        assert b"".join(avi.decode_frame(f).tobytes() for f in avi.read_frames(data)) == payload
    for x in (np.zeros((2, 64), np.uint8), np.full((2, 64), 255, np.uint8), np.tile(np.array([0, 255], np.uint8), (3, 32))):
        assert (avi.decode_frame(avi.encode_frame(x)) == x).all()
    with pytest.raises(ValueError):
        avi.read_frames(b"RIFF....WAVE")
    dark, light = np.full((8, 64), 20, np.uint8), np.full((8, 64), 200, np.uint8)
    assert avi.shots([dark] * 5 + [light] * 4 + [dark]) == [(0, 5), (5, 9), (9, 10)]
    assert avi.clips([dark] * 5 + [light] * 4)[1] == (1, 200, 360, 4, 200.0)


def test_avi_query(spark, table):
    rows = [r[:2] for r in corpus()]
    out = avi.op8_avi(spark, table("documents", rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        b = (texts[r["doc_id"]] or "").encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_bytes"] == len(avi.write_avi(p)) and r["media_sha256"] == hashlib.sha256(avi.write_avi(p)).hexdigest()


# --- The pipeline ---------------------------------------------------------------------------------------------------
def test_pipeline(spark, table):
    import corpus_pipeline

    rows = [(*r[:4], r[4]) for r in corpus()]
    path = table("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = spark.read.parquet(f"{path}/documents.parquet").withColumn("kept", F.lit("own"))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, frame, path), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == frame.columns
        frame = after
        counts.append(frame.count())
    assert counts[0] >= counts[1] > counts[2] and counts[3] == counts[4]
    assert frame.filter("not round_trip").count() == 0
    assert [r["doc_id"] for r in frame.filter("doc_id between 100 and 120").collect()] == []  # near copies of 3
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, path), "stage")
    assert empty.count() == 0
