"""AVI motion-JPEG columns: lossless intra frames, RIFF parsing, and shots by adaptive histogram differences.

Frames are lossless JPEG (ITU-T T.81, process 14, predictor 1) of 8-bit samples, 64 a row. Their Huffman table gives
each difference 9 bits in all (9 - s for its category s, and s more), so both directions work on whole arrays.
Null payloads are empty. Equal payloads give equal files, so repeated rows are treated alike; of differences that tie with a
threshold none is a cut. A payload of any length is one file, and a worker holds some megabytes of files, or one that is
longer. Extra columns pass through, but those named as a result column are replaced by it. An empty table gives an empty
result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import pieces

WIDTH, ROWS, FRAME_US = 64, 64, 40_000
CLIP = T.ArrayType(T.StructType([T.StructField("clip", T.IntegerType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("frames", T.IntegerType()), T.StructField("mean", T.DoubleType())]))

_DIFF = np.arange(-255, 256)
_CAT = np.array([abs(int(d)).bit_length() for d in _DIFF])
#: The 9 bits of a difference (at 255 + difference): ones and a zero for the category, then its T.81 magnitude bits.
_CODES = ((512 - (2 << _CAT)) | np.where(_DIFF > 0, _DIFF, _DIFF + (1 << _CAT) - 1)).astype(np.uint16)
_DIFFS = np.zeros(512, np.uint8)
_DIFFS[_CODES] = _DIFF.astype(np.int64).astype(np.uint8)  # samples are right modulo 256
_SOI, _EOI = b"\xff\xd8", b"\xff\xd9"
_DHT = b"\xff\xc4" + struct.pack(">HB16B", 2 + 1 + 16 + 9, 0, *([1] * 9 + [0] * 7)) + bytes(range(8, -1, -1))
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 1, 0, 0)


def encode_frame(samples: np.ndarray) -> bytes:
    """A lossless JPEG of an (rows, columns) array of 8-bit samples; their number is a multiple of 8."""
    x = samples.astype(np.int16)
    before = np.empty_like(x)
    before[:, 1:] = x[:, :-1]
    before[1:, 0] = x[:-1, 0]
    before[0, 0] = 128
    v = _CODES[(x - before + 255).ravel()].reshape(-1, 8)
    out = np.empty((len(v), 9), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    for i in range(1, 8):
        out[:, i] = (v[:, i - 1] << (8 - i)) | (v[:, i] >> (i + 1))
    out[:, 8] = v[:, 7]
    sof = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, *x.shape, 1, 1, 0x11, 0)
    return b"".join((_SOI, _DHT, sof, _SOS, out.tobytes().replace(b"\xff", b"\xff\x00"), _EOI))


def decode_frame(data: bytes) -> np.ndarray:
    """The samples of a frame as `encode_frame` writes them; an error if its segments say anything else."""
    if data[:2] != _SOI or data[-2:] != _EOI:
        raise ValueError("not a whole JPEG")
    at, shape, table = 2, None, None
    while True:
        marker, size = struct.unpack_from(">HH", data, at)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFFC4:
            table = body
        elif marker == 0xFFC3:
            shape = struct.unpack_from(">xHH", body)
        elif marker == 0xFFDA:
            if body != _SOS[4:]:
                raise ValueError("another predictor or point transform")
            break
    if table != _DHT[4:] or shape is None:
        raise ValueError("another Huffman table or process")
    b = np.frombuffer(data[at:-2].replace(b"\xff\x00", b"\xff"), np.uint8).reshape(-1, 9).astype(np.uint16)
    v = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        v[:, i] = ((b[:, i] << (i + 1)) | (b[:, i + 1] >> (7 - i))) & 511
    d = _DIFFS[v.ravel()].reshape(shape)
    d[0, 0] = (int(d[0, 0]) + 128) & 255
    d[:, 0] = np.add.accumulate(d[:, 0], dtype=np.uint8)
    return np.add.accumulate(d, axis=1, dtype=np.uint8)


def _chunk(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of frames of at most ROWS rows of WIDTH samples; the payload fills whole rows."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [encode_frame(samples[i : i + ROWS]) for i in range(0, len(samples), ROWS)]
    height, most = min(ROWS, len(samples)), max(map(len, frames))
    avih = struct.pack("<14I", FRAME_US, 0, 0, 0x10, len(frames), 0, 1, most, WIDTH, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_US, 1_000_000, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl", _chunk(b"avih", avih), _chunk(b"LIST", b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf)))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    return _chunk(b"RIFF", b"AVI ", header, _chunk(b"LIST", b"movi", *(_chunk(b"00dc", f) for f in frames)), _chunk(b"idx1", *index))


def read_frames(data: bytes) -> list[bytes]:
    """The frames that a file's idx1 lists, in its order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        head = struct.unpack_from("<4sI", data, movi + offset)
        if head != (name, size):
            raise ValueError("the index doesn't fit the frames")
        if name[2:] in (b"dc", b"db"):
            frames.append(data[movi + offset + 8 : movi + offset + 8 + size])
    return frames


def shots(frames: list[np.ndarray], window: int = 12, spread: float = 3.0, least: float = 0.25) -> list[tuple[int, int]]:
    """(first, end) frames of shots: a cut where a histogram differs from the one before by more than the mean of the
    `window` differences before it plus `spread` times their deviation, and by `least` of all samples at any rate."""
    counts = np.array([np.bincount(f.ravel() >> 3, minlength=32) / f.size for f in frames])
    moves = np.abs(np.diff(counts, axis=0)).sum(axis=1) / 2
    cuts, since = [0], 0
    for i, d in enumerate(moves):
        near = moves[max(since, i - window) : i]
        if d > least and d > (near.mean() + spread * near.std() if len(near) else least):
            cuts.append(i + 1)
            since = i + 1
    return list(zip(cuts, [*cuts[1:], len(frames)]))


def clips(frames: list[np.ndarray]) -> list[tuple[int, int, int, int, float]]:
    """Timed clip rows: number, start and end in milliseconds, frames, and mean sample."""
    ms = FRAME_US // 1000
    return [(i, a * ms, b * ms, b - a, round(float(sum(int(f.sum()) for f in frames[a:b]) / sum(f.size for f in frames[a:b])), 4)) for i, (a, b) in enumerate(shots(frames))]


def _pad(payload: bytes) -> bytes:
    return payload + b"\0" * (-len(payload) % WIDTH if payload else WIDTH)


def encode_media(rows: DataFrame, payload_col: str, out_col: str = "media") -> DataFrame:
    """rows with out_col, an AVI file (binary), in place of payload_col; payloads get zero bytes up to whole rows, one at least."""
    kept = [c for c in rows.columns if c not in (payload_col, out_col)]
    fields = T.StructType([*(rows.schema[c] for c in kept), T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(kept)
        for b in pieces(batches, last):
            files = pa.array((write_avi(_pad(p.as_py() or b"")) for p in b.column(last)), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:last], files], names=[*kept, out_col])

    return rows.select(*kept, F.col(payload_col).cast("binary").alias(payload_col)).mapInArrow(run, fields)


def decode_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows with payload (binary, all samples) and clips (array of timed clip rows) in place of media_col, and of columns of
    these names. Null files give null payloads and clips."""
    kept = [c for c in rows.columns if c not in (media_col, "payload", "clips")]
    fields = T.StructType([*(rows.schema[c] for c in kept), T.StructField("payload", T.BinaryType()), T.StructField("clips", CLIP)])
    arrow = pa.list_(pa.struct([("clip", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int32()), ("mean", pa.float64())]))
    names = [f.name for f in CLIP.elementType.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, len(kept)):
            payloads, found = [], []
            for m in b.column(len(kept)):
                if not m.is_valid:
                    payloads.append(None)
                    found.append(None)
                    continue
                frames = [decode_frame(f) for f in read_frames(m.as_py())]
                payloads.append(b"".join(f.tobytes() for f in frames))
                found.append([dict(zip(names, c)) for c in clips(frames)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(payloads, pa.binary()), pa.array(found, arrow)], names=[*kept, "payload", "clips"])

    return rows.select(*kept, media_col).mapInArrow(run, fields)


def op8_avi(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    media = encode_media(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("payload")), "payload")
    marked = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    back = decode_media(marked)
    size = F.octet_length("payload")
    feature = F.concat_ws(";", F.transform("clips", lambda c: F.concat_ws(":", c["start_ms"].cast("string"), c["end_ms"].cast("string"), F.format_string("%.4f", c["mean"]))))
    return back.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -WIDTH, WIDTH)).cast("long").alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))
