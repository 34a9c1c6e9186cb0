"""Texts stored as raw video in an ISO base media file, and a reader of such files' sample tables."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import string_buffers, texts

#: A frame is 8 by 8 samples of 8 bits. FPS frames are a second; every KEY_EVERY-th frame is a key frame, PER_CHUNK lie together.
FRAME, FPS, KEY_EVERY, PER_CHUNK = 64, 25, 16, 256
CODEC = b"raw "
#: Fixed values of ISO/IEC 14496-12: boxes that hold boxes, and the unity matrix.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes) -> bytes:
    """The payload with bytes 0 appended up to a positive multiple of FRAME."""
    return payload.ljust(max(FRAME, -(-len(payload) // FRAME) * FRAME), b"\0")


def mux(payload: bytes) -> bytes:
    """An ISO media file with one video track whose samples are the payload's frames. The length must be a positive multiple of FRAME."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError("a payload is a positive number of whole frames")
    chunks = -(-n // PER_CHUNK)
    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = [(1, PER_CHUNK, 1)] if n >= PER_CHUNK else []
    if n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK, 1))
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")

    def moov(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.uint64) * (PER_CHUNK * FRAME)
        wide = first + len(payload) >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, FPS, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, FPS, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    start = len(kind) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return kind + moov(start) + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, first, last) of each box's body, outermost first, by sizes alone. A box that runs past its parent is an error."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def tracks(data: bytes) -> list[dict]:
    """For each track: codec, timescale, duration, sample sizes, places and key frames (1 is the first), from its sample tables. Payloads aren't read."""
    found: list[dict] = []
    for path, at, _ in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"sizes": np.zeros(0, np.int64), "keys": None})
        if not found or b"trak" not in path:
            continue
        track, (version, count) = found[-1], (data[at], struct.unpack_from(">I", data, at + 4)[0] if kind in (b"stsd", b"stts", b"stss", b"stsc", b"stco", b"co64") else 0)
        if kind == b"mdhd":
            track["timescale"], track["duration"] = struct.unpack_from(">IQ" if version else ">II", data, at + (20 if version else 12))
        elif kind == b"stsd":
            track["codec"] = data[at + 12 : at + 16].decode("latin-1")
        elif kind == b"stts":
            track["times"] = np.frombuffer(data, ">u4", 2 * count, at + 8).reshape(-1, 2).astype(np.int64)
        elif kind == b"stss":
            track["keys"] = np.frombuffer(data, ">u4", count, at + 8).astype(np.int64)
        elif kind == b"stsc":
            track["runs"] = np.frombuffer(data, ">u4", 3 * count, at + 8).reshape(-1, 3).astype(np.int64)
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            track["sizes"] = np.full(n, same, np.int64) if same else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
        elif kind in (b"stco", b"co64"):
            track["chunks"] = np.frombuffer(data, ">u4" if kind == b"stco" else ">u8", count, at + 8).astype(np.int64)
    for track in found:
        sizes, chunks, runs = track["sizes"], track["chunks"], track["runs"]
        until = np.append(runs[1:, 0], len(chunks) + 1)
        each = np.repeat(runs[:, 1], until - runs[:, 0])
        if each.sum() != len(sizes) or track["times"][:, 0].sum() != len(sizes):
            raise ValueError("sample tables disagree about the number of samples")
        first = np.cumsum(each) - each
        past = np.cumsum(sizes) - sizes
        chunk = np.repeat(np.arange(len(chunks)), each)
        track["places"] = chunks[chunk] + past - past[np.minimum(first, len(sizes) - 1)][chunk] if len(sizes) else sizes
        track["keys"] = np.arange(1, len(sizes) + 1) if track["keys"] is None else track["keys"]
    return found


def read_samples(data: bytes, track: dict) -> bytes:
    """The track's samples in order; samples that lie side by side are read at once."""
    places, sizes = track["places"], track["sizes"]
    if not len(places):
        return b""
    cut = np.flatnonzero(places[1:] != places[:-1] + sizes[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut - 1, len(places) - 1)
    return b"".join(data[a:b] for a, b in zip(places[first], places[last] + sizes[last], strict=True))


SCHEMA = "__key {key}, n_bytes long, media binary"
INDEX = "codec string, duration_ms long, n_samples long, key_offsets array<long>, key_sizes array<long>"


def store(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, media) for each row: the whole text as UTF-8, padded and muxed. Null and empty texts become one frame of zeros.

    Rows are handled one by one, so a task holds a few copies of its longest text. Repeated rows
    stay, null keys too; other columns are left out. An empty table gives no rows.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            data, at = string_buffers(batch.column(1))
            for k in range(batch.num_rows):
                raw = data[at[k] : at[k + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([len(raw)], pa.int64()), pa.array([mux(padded(raw))], pa.binary())], ["__key", "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key], df[text]).mapInArrow(run, SCHEMA.format(key=kind)).withColumnRenamed("__key", key)


def index(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """(key, codec, duration_ms, n_samples, key_offsets, key_sizes) of each file's first track, without decoding payloads; null files give nulls."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                if value.is_valid:
                    t = tracks(value.as_py())[0]
                    k = t["keys"] - 1
                    rows.append((t["codec"], 1000 * t["duration"] // t["timescale"], len(t["sizes"]), t["places"][k].tolist(), t["sizes"][k].tolist()))
                else:
                    rows.append((None,) * 5)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["__key", "codec", "duration_ms", "n_samples", "key_offsets", "key_sizes"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key], df[media]).mapInArrow(run, f"__key {kind}, {INDEX}").withColumnRenamed("__key", key)


def digest(df: DataFrame, key: str, text: str) -> DataFrame:
    """What store() keeps, read back through the sample tables: a row of sizes, checksums and a feature for each row of df.

    feature is codec, milliseconds, frames, key frames, the byte ranges of the first and last key frame,
    and a CRC-32 of all key frame ranges. Nulls, repeats and empty tables as in store().
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            data, at = string_buffers(batch.column(1))
            rows = []
            for k in range(batch.num_rows):
                raw = data[at[k] : at[k + 1]].tobytes()
                media = mux(padded(raw))
                t = tracks(media)[0]
                back = read_samples(media, t)
                keys = np.stack([t["places"][t["keys"] - 1], t["sizes"][t["keys"] - 1]], 1)
                (a, b), (y, z) = keys[0].tolist(), keys[-1].tolist()
                said = f"{t['codec']};{1000 * t['duration'] // t['timescale']};{len(t['sizes'])};{len(keys)};{a}+{b};{y}+{z};{zlib.crc32(keys.astype('<i8').tobytes()):08x}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), said))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["__key", *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key], df[text]).mapInArrow(run, f"__key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("__key", key)


def query(spark, sf_dir):
    return digest(texts(spark, sf_dir), "doc_id", "text")
