"""SimHash near-duplicates by multi-index hashing.

Null and empty texts have no word: fingerprint zero, linked like any other. Repeated rows keep their own output rows.
Very long texts are hashed whole, one after the other. Bits that tie, set in just half the hashes, are 0. Null ids belong to
a group like others and are never its least id. Extra columns of the input are ignored here, whatever their names, and pass
through `drop_near_duplicates`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import look_up
from ..session import discard, materialize
from .batches import pieces

SEED = 42
DISTANCE = 3
_CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` lower-cased words; the whole sequence if there are fewer; none without a word."""
    parts = text.lower().split() if text else []  # bytes: A-Z only, and just \x20 \x09-\x0D part words
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """64 majority bits, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        octets = np.ascontiguousarray(hashes[i : i + _CHUNK]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _forest(members: np.ndarray, probes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join whatever links of at most `distance` bits join: member to member, and member to probe."""
    every = np.concatenate((members, probes))
    n, m = len(every), len(members)
    unseen = np.ones(n, bool)
    edges = []
    for first in range(m):
        if not unseen[first]:
            continue
        unseen[first] = False
        stack = [first]
        while stack:
            i = stack.pop()
            among = every if i < m else members
            near = np.flatnonzero((np.bitwise_count(among ^ every[i]) <= distance) & unseen[: len(among)])
            if len(near):
                unseen[near] = False
                stack.extend(near.tolist())
                edges.extend((int(every[i]), int(x)) for x in every[near])
    return edges


def _linked(buckets: DataFrame, distance: int) -> DataFrame:
    """buckets: rows (key, fp, probe). Rows of one key meet in one task; (a, b): a spanning forest of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for members, probes in zip(b.column(0), b.column(1)):
                one, two = members.values.to_numpy().view(np.uint64), probes.values.to_numpy().view(np.uint64)
                found += _forest(np.unique(one), np.setdiff1d(two, one), distance)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

    keys = [c for c in buckets.columns if c not in ("fp", "probe")]
    lists = buckets.groupBy(*keys).agg(
        F.collect_list(F.when(~F.col("probe"), F.col("fp"))).alias("members"), F.collect_list(F.when(F.col("probe"), F.col("fp"))).alias("probes")
    )
    return lists.filter("size(members) > 0 and size(members) + size(probes) > 1").select("members", "probes").mapInArrow(run, "a long, b long")


def _ball(value: Column, bits: int, both: bool = False) -> Column:
    """Values one bit from value: those with one more bit (the other side finds the rest), or all."""
    flips = F.array(*(F.lit(1 << j).cast("long") for j in range(bits)))
    return F.transform(flips if both else F.filter(flips, lambda x: value.bitwiseAND(x) == 0), lambda x: value.bitwiseXOR(x))


def hamming_links(fps: DataFrame, distance: int = DISTANCE, dense: int = 2048) -> DataFrame:
    """(a, b): edges among the distinct values of fps.fp that have the components of all pairs within `distance` <= 3.

    Of two 32-bit segments, one differs in at most one bit. Each fingerprint is filed under both of its segments and
    probes their balls of radius one; complete distances are verified per bucket, and a spanning forest of the
    verified links leaves it, so output is linear in the probes that hit. A bucket of over `dense` rows is filed
    again by the 16-bit halves of the other segment, by the same argument: with a segment and a half fixed, a
    bucket has 65,536 members at most, whatever the size of the table.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one prove distances up to 3 only")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned("fp", 32)
    segments = F.array(F.struct(F.lit(0).alias("seg"), high.alias("key"), low.alias("rest")), F.struct(F.lit(1).alias("seg"), low.alias("key"), high.alias("rest")))
    filed = materialize(fps.select("fp").distinct().select("fp", F.explode(segments).alias("s")).select("s.seg", "s.key", "s.rest", "fp"), "segments")
    probes = filed.select("seg", F.explode(_ball(F.col("key"), 32)).alias("key"), "rest", "fp", F.lit(True).alias("probe"))
    hits = probes.join(filed.select("seg", "key").distinct(), ["seg", "key"], "left_semi")
    rows = filed.withColumn("probe", F.lit(False)).unionByName(hits)
    rows = materialize(rows, "buckets")
    discard(filed)
    sizes = rows.groupBy("seg", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["seg", "key"])
    plain = rows.filter(F.col("n") <= dense).select("seg", "key", "fp", "probe")
    crowd = rows.filter(F.col("n") > dense)
    half = F.col("half.v")
    crowd = crowd.select("seg", "key", "fp", "probe", F.explode(F.array(F.struct(F.lit(0).alias("no"), F.col("rest").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("v")), F.struct(F.lit(1).alias("no"), F.shiftrightunsigned("rest", 16).alias("v")))).alias("half"))
    exact = crowd.select("seg", "key", F.col("half.no").alias("no"), half.alias("v"), "fp", "probe")
    near = crowd.select("seg", "key", F.col("half.no").alias("no"), F.explode(_ball(half, 16, True)).alias("v"), "fp", F.lit(True).alias("probe"))
    return _linked(plain, distance).unionByName(_linked(exact.unionByName(near), distance)).distinct()


def _classes(fps: DataFrame, distance: int, dense: int = 2048) -> DataFrame:
    """(fp, part) of fingerprints that links of at most `distance` bits join to others."""
    return connected_components(hamming_links(fps, distance, dense), "a", "b").withColumnsRenamed({"id": "fp", "component": "part"})


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE, dense: int = 2048) -> DataFrame:
    """(id_col, fp, component_id): component_id is the least id reachable over links of at most `distance` bits."""
    marked = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    held = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "distinct")
    parts = _classes(held, distance, dense)
    joined = held.join(parts, "fp", "left")
    lows = joined.filter("part is not null").groupBy("part").agg(F.min("least").alias("low"))
    classes = materialize(joined.join(lows, "part", "left").select("fp", F.coalesce("low", "least").alias("component_id"), "n"), "classes")
    discard(held)
    # the fingerprint of copies, or of empty texts, may be that of a third of all rows
    return look_up(marked, classes, ["fp"]).select(id_col, "fp", "component_id")


#: Bands of the signature for the similarity mode: two texts with a Jaccard similarity of 0.8 share one of them with
#: probability 1 - (1 - 0.8 ** 6) ** 24 = 0.9993.
BANDS, ROWS = 24, 6
_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor", i) | 1 for i in range(BANDS * ROWS)], np.uint64)[:, None]
_OFFSETS = np.array([xxhash.xxh64_intdigest(b"offset", i) for i in range(BANDS * ROWS)], np.uint64)[:, None]


def _bands(hashes: np.ndarray) -> list[int]:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[None, i : i + 2048] * _FACTORS + _OFFSETS).min(axis=1))
    octets = low.astype("<u8").tobytes()
    size = 8 * ROWS
    return [xxhash.xxh64_intdigest(octets[i * size : (i + 1) * size], i) - (1 << 63) for i in range(BANDS)]


def _digest(text: Column) -> Column:
    """SHA-256 of the text; the same for all texts without a word. Texts that differ in case or blanks only are linked by bands."""
    return F.unhex(F.sha2(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(""), 256))


#: Texts of a block; a task holds the shingle sets of two blocks.
BLOCK = 128


def _alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of at least `similarity`; by counts of shared values only."""
    n, sizes = len(sets), np.array([len(s) for s in sets], float)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[value] > 1
    column = np.cumsum(times > 1) - 1
    owner, column = owner[shared], column[value[shared]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((n, 4096), np.float32)
        part[owner[i:j], column[i:j] - start] = 1
        both += part @ part.T
    return both >= similarity * (sizes[:, None] + sizes[None, :] - both)


def _across(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(center, digest): edges that join whatever links of rows (band, key, digest, label) of a band and key join.

    Rows of one label are known to hang together. So those that lack the most frequent label of their band and key are
    held against all of its rows: blocks of the former against blocks of the latter, each pair of blocks by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[bytes, bytes]] = []
            for members in b.column(0):
                own = {m["digest"].as_py(): m["hashes"].as_py() for m in members}
                names = sorted(own)
                alike = _alike([np.frombuffer(own[d], "<u8") for d in names], similarity)
                unseen = np.ones(len(names), bool)
                for first in range(len(names)):
                    stack = [first] if unseen[first] else []
                    unseen[first] = False
                    while stack:
                        i = stack.pop()
                        near = np.flatnonzero(alike[i] & unseen)
                        unseen[near] = False
                        stack.extend(near.tolist())
                        found.extend((names[i], names[k]) for k in near)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["center", "digest"])

    counts = rows.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("band", "key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
    sizes = sizes.filter("n > most.n").select("band", "key", F.col("most.label").alias("most"), F.ceil(F.col("n") / BLOCK).cast("int").alias("all"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("few"))
    dealt = rows.join(sizes, ["band", "key"])
    block = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = dealt.filter("label <> most").withColumn("i", block("few")).withColumn("j", upto("all"))
    every = dealt.withColumn("j", block("all")).withColumn("i", upto("few"))
    both = few.select("digest", "band", "key", "i", "j").unionByName(every.select("digest", "band", "key", "i", "j")).distinct()
    groups = both.join(sets, "digest").groupBy("band", "key", "i", "j").agg(F.collect_list(F.struct("digest", "hashes")).alias("members"))
    return groups.filter("size(members) > 1").select("members").mapInArrow(run, "center binary, digest binary").distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, bands: int = BANDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, digest) of each row; (digest, component, n) of each distinct text, n of its rows; (component, first, n) of each group.

    Candidates come from SimHash, as texts of one class of fingerprints (of the same shingles, repeats included), and from
    bands of min-hashes beside it; a class is filed as a band of its own. They are verified with the whole sets. In each band, all texts are held
    against the least one, so a large group of copies makes as many edges as rows; those that these links leave apart are held against all others of the band, in blocks
    that bound what a task holds, and a spanning forest of their links is kept. No cap cuts off a link.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = [], []
            for t in b.column(2):
                hashes = shingle_hashes(t.as_py(), words)
                fps.append(fingerprint(hashes) if len(hashes) else None)  # texts without a word are one already
                keys.append(_bands(np.unique(hashes))[:bands] if bands and len(hashes) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "fp", "bands"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            sets = pa.array((np.unique(shingle_hashes(t.as_py(), words)).astype("<u8").tobytes() for t in b.column(1)), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["digest", "hashes"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = []
            for x, y in zip(b.column(2), b.column(3)):
                one, two = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(one, two, assume_unique=True)) if min(len(one), len(two)) >= similarity * max(len(one), len(two)) else 0
                alike.append(both >= similarity * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike, pa.bool_())], names=["center", "digest", "alike"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("digest"), F.col(text_col).cast("binary").alias("text"))
    signed = materialize(rows.mapInArrow(sign, f"id {kind}, digest binary, fp long, bands array<long>"), "signed")
    hashed = materialize(signed.filter("fp is not null").select("digest", "fp").distinct(), "hashed")
    classes = materialize(hashed.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    # of a class of one fingerprint, that is the name; else its least
    named = materialize(classes.join(_classes(classes, DISTANCE), "fp", "left").select("fp", F.coalesce("part", "fp").alias("key"), "n"), "classes")
    filed = look_up(hashed, named, ["fp"]).select("digest", F.lit(BANDS).alias("band"), "key")
    # digests are in no order that has to do with texts: the least of a band is its center
    filed_all = materialize(signed.select("digest", F.posexplode("bands").alias("band", "key")).distinct().unionByName(filed), "filed")
    sizes = filed_all.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    left = materialize(filed_all.join(sizes, ["band", "key"]), "bands")
    # one row for each text that has a candidate; by id and text, as either may be that of a third of all rows
    least = F.min(F.struct("id"))["id"]  # nulls first
    texts = materialize(signed.groupBy("digest").agg(least.alias("id"), F.count("*").alias("n")), "texts")
    wanted = left.select("digest").distinct().join(texts, "digest").select(F.col("digest").alias("_d"), F.col("id").alias("_i"))
    found = rows.join(wanted, (F.col("digest") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_i"))).groupBy("digest").agg(F.first("text").alias("text"))
    sets = materialize(found.mapInArrow(gather, "digest binary, hashes binary"), "sets")
    # each text against the least one of its band
    centers = left.groupBy("band", "key").agg(F.min("digest").alias("center"))
    rest = left.join(centers, ["band", "key"]).filter("digest <> center")
    pairs = rest.select("center", "digest").distinct()
    full = pairs.join(sets.withColumnsRenamed({"hashes": "x", "digest": "center"}), "center").join(sets.withColumnRenamed("hashes", "y"), "digest")
    judged = materialize(full.select("center", "digest", "x", "y").mapInArrow(verify, "center binary, digest binary, alike boolean"), "judged")
    links = judged.filter("alike").select("center", "digest")
    # then what these links leave apart within a band
    labels = connected_components(links, "center", "digest").select(F.col("id").alias("digest"), "component")
    labelled = materialize(left.join(labels, "digest", "left").select("band", "key", "digest", F.coalesce("component", "digest").alias("label")), "labelled")
    links = links.unionByName(materialize(_across(labelled, sets, similarity), "links"))
    parts = connected_components(links, "center", "digest").withColumnRenamed("id", "digest")
    for x in (filed_all, left, sets, labelled, hashed, classes, named):
        discard(x)
    grouped = materialize(texts.join(parts, "digest", "left").select("digest", "id", F.coalesce("component", "digest").alias("component"), "n"), "groups")
    stays = materialize(grouped.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("first"), F.sum("n").alias("n")), "stays")
    discard(texts)
    return signed.select("id", "digest"), grouped.select("digest", "component", "n"), stays


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = BANDS) -> DataFrame:
    """(id, digest, copies, component, keeper): for each distinct id and text, its group and whether it's the one that stays.

    Texts link if the Jaccard similarity of their shingle sets is at least `similarity`; components of links are the
    groups. Equal texts are one, and so are all without a word. Candidates come from classes of SimHash fingerprints; as 64
    bits find few of these links (the README has figures), also from up to 24 bands of min-hashes of the same shingles; 0 leaves
    SimHash alone. All are verified with the whole sets.
    """
    signed, grouped, stays = _groups(docs, id_col, text_col, words, similarity, bands)
    ids = materialize(signed.groupBy("id", "digest").agg(F.count("*").alias("copies")), "ids")
    joined = materialize(look_up(ids, grouped, ["digest"]), "ids")
    joined = look_up(joined, stays, ["component"])
    return joined.select("id", "digest", "copies", "component", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))).alias("keeper"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of `near_duplicate_groups`: that of the least id (nulls first), then digest."""
    signed, _, stays = _groups(docs, id_col, text_col, words, similarity)
    repeated = materialize(signed.groupBy("id", "digest").agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated")
    keepers = stays.select(F.col("first.id").alias("_i"), F.col("first.digest").alias("_d"))
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), _digest(F.col(text_col)).alias("_digest"))
    if repeated.isEmpty():
        return packed.join(keepers, (F.col("_digest") == F.col("_d")) & F.col("_id").eqNullSafe(F.col("_i"))).select("_row.*")
    # rows with both an id and a text in common are one
    keepers = keepers.join(repeated, (F.col("_d") == F.col("digest")) & F.col("_i").eqNullSafe(F.col("id")), "left").select("_i", "_d", "copies")
    keepers = materialize(keepers, "keepers")
    joined = packed.join(keepers, (F.col("_digest") == F.col("_d")) & F.col("_id").eqNullSafe(F.col("_i")))
    several = joined.filter("copies > 1").groupBy("_id", "_digest").agg(F.first("_row").alias("_row"))
    return joined.filter("copies is null").select("_row").unionByName(several.select("_row")).select("_row.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
