"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a pre-token there is one last token that its encoding can end with. A token that matches as a
suffix of the prefix is that one if the encoding of what precedes it ends with a token beside which it may stand. So
the last tokens of all prefixes, found from left to right, give the encoding by following them back.

Null and empty texts have no id and decode to the empty text. Repeated rows get equal ids; extra columns pass through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from .batches import pieces

#: Fixed value, how byte-level BPE parts a text before merging:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
#: Here for texts below U+0250, where these classes are the same in every version of Unicode.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾", " \\t-\\r\x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-\u024f]")
#: Bounds of what a worker keeps: pre-tokens of at most so many bytes, twice so many of them, and so many pairs.
_CACHED_BYTES, _CACHED, _PAIRS = 64, 200_000, 250_000


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE is read here")
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = {raw(s): i for s, i in model["vocab"].items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # two ids: rank of their merge, and its id
        #: Of a merged id: rank of its merge, and its halves. Ids of single bytes have none.
        self.born: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            pair = ids[a], ids[b]
            self.pairs.setdefault(pair, (rank, ids[a + b]))
            self.born.setdefault(ids[a + b], (rank, *pair))
        self.beside: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.unicode_parts = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            if len(b) == 1 or self._stands(i):
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.cache = _Cache(self)

    def _stands(self, token: int) -> bool:
        """Whether the encoding of a token's bytes is the token alone: its halves may stand side by side until it merges them."""
        rank, a, b = self.born.get(token, (-1, 0, 0))
        return rank >= 0 and self._compatible(a, b, rank)

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of a rank below limit would have joined the bytes on both sides of the border of a and b.

        Time runs backwards from limit: the half that was made last is taken apart, and each pair that faces the
        border meanwhile must not be one that merges earlier than that. Of equal ranks the left place merges first.
        """
        while True:
            met = self.pairs.get((a, b))
            if met is not None and met[0] < limit:
                return False
            left, right = self.born.get(a), self.born.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[0] > right[0]:
                limit, a = left[0], left[2]
            else:
                limit, b = right[0] + 1, right[1]

    def encode_part(self, part: bytes) -> list[int]:
        """The ids of a pre-token."""
        last: list[tuple[int, int] | None] = [None] * (len(part) + 1)
        beside = self.beside
        for end, (token, size) in self.automaton.iter(part.decode("latin-1")):
            end += 1
            if last[end] is not None:
                continue
            start = end - size
            if start:
                before = last[start]
                if before is None:
                    continue
                pair = before[0], token
                fits = beside.get(pair)
                if fits is None:
                    if len(beside) >= _PAIRS:
                        beside.clear()
                    fits = beside[pair] = self._compatible(*pair, 1 << 60)
                if not fits:
                    continue
            last[end] = token, size
        found, at = [], len(part)
        while at:
            token, size = last[at]
            found.append(token)
            at -= size
        return found[::-1]

    def parts(self, text: str) -> list[str]:
        """Pre-tokens; the tokenizers library parts what goes beyond Latin, by its own version of Unicode."""
        if _BEYOND.search(text) is None:
            return _LATIN.findall(text)
        return [text[a:b] for _, (a, b) in self.unicode_parts(text)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known = self.cache.__getitem__
        if self.split_special is None:
            return b"".join(map(known, self.parts(text)))
        out = []
        for i, piece in enumerate(self.split_special.split(text)):
            out.append(self.special[piece].to_bytes(4, "little") if i % 2 else b"".join(map(known, self.parts(piece))))
        return b"".join(out)


class _Cache(dict):
    """Pre-token to the bytes of its ids: those met lately, and for a while those met before."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.before: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            data = part.encode()
            ids = np.array(self.encoder.encode_part(data), "<u4").tobytes()
            if len(data) > _CACHED_BYTES:
                return ids
        if len(self) >= _CACHED:
            self.before = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Decoder:
    def __init__(self, content: str):
        spec = json.loads(content)
        letters = _byte_letters()
        known = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        known |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.table = [known.get(i, b"") for i in range(max(known) + 1)].__getitem__

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_KEPT: dict[tuple[type, int], Encoder | Decoder] = {}


def _kept(kind: type, content: str):
    """One for each worker and vocabulary; workers are used again from task to task."""
    key = kind, hash(content)
    if key not in _KEPT:
        for k in [k for k in _KEPT if k[0] is kind]:
            del _KEPT[k]
        _KEPT[key] = kind(content)
    return _KEPT[key]


def vocabulary(path: str | None = None) -> str:
    """The content of a vocabulary file that the driver can open; the public byte_bpe_50k.json without a path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, content: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with out_col: the ids of each whole text, as binary of little-endian unsigned 32-bit integers.

    decoded_col: also the text that these ids decode to, in the same pass over the same worker. Columns of docs by the
    names of the new ones are replaced.
    """
    docs = docs.drop(*(c for c in (out_col, decoded_col) if c and c != text_col))
    shared = docs.sparkSession.sparkContext.broadcast(content)
    at = docs.columns.index(text_col)
    added = [out_col, *([decoded_col] if decoded_col else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, back = _kept(Encoder, shared.value), _kept(Decoder, shared.value) if decoded_col else None
        for b in pieces(batches, at):
            ids = [one.encode(t.as_py()) for t in b.column(at)]
            new = [pa.array(ids, pa.binary())]
            if back is not None:
                new.append(pa.array((back.decode(x) for x in ids), pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.BinaryType()), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]))


def decode(rows: DataFrame, content: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col: the text of the ids; the empty one for null."""
    shared = rows.sparkSession.sparkContext.broadcast(content)
    at = rows.columns.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _kept(Decoder, shared.value)
        for b in pieces(batches, at):
            texts = pa.array((one.decode(t.as_py() or b"") for t in b.column(at)), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))


def op7_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    content = vocabulary(path)
    coded = encode(docs, content, decoded_col="decoded")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
