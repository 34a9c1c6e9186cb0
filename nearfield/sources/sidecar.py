"""The int8 sidecar file and the JSON root beside it, and a versioned Parquet index."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators.index import pack_rows
from ..operators.ranking import saved

#: Fixed values of the format: magic, version, type, and the header's layout.
MAGIC, VERSION, INT8, LAYOUT, SIZE = 0x53494D42, 2, 1, "<IBBHII", 16

LEGACY = "schemaVersion int, index array<struct<id: string, embedding: array<double>, contentHash: string, updatedAt: string>>"
ROOT = "schemaVersion int, embeddingDim int, index array<struct<id: string, contentHash: string, updatedAt: string, chunks: array<struct<row: int, start: int, `end`: int, hash: string>>>>"


def encode(vectors: np.ndarray, dim: int) -> bytes:
    flat = np.asarray(vectors, np.float64).ravel()
    if flat.size and (dim <= 0 or flat.size % dim):
        raise ValueError("the number of values is not a multiple of the dimension")
    codes = np.clip(np.floor(np.nan_to_num(flat, nan=0.0, posinf=2, neginf=-2) * 127 + 0.5), -127, 127).astype(np.int8)
    return struct.pack(LAYOUT, MAGIC, VERSION, INT8, 0, dim, flat.size // dim if flat.size else 0) + codes.tobytes()


def decode(data: bytes | None) -> np.ndarray | None:
    """count x dim float32, or None if the header or the size is wrong. The type byte isn't checked."""
    if data is None or len(data) < SIZE:
        return None
    magic, version, _, _, dim, count = struct.unpack_from(LAYOUT, data)
    if magic != MAGIC or version != VERSION or len(data) - SIZE != dim * count:
        return None
    return (np.frombuffer(data, np.int8, dim * count, SIZE).reshape(count, dim) / 127.0).astype(np.float32)


def header(files: DataFrame) -> DataFrame:
    """(path, magic, version, dtype, dim, count, valid) of files read as binaryFile, by expressions on the bytes."""
    le = lambda first, n: F.conv(F.concat(*[F.hex(F.substring("content", first + k, 1)) for k in reversed(range(n))]), 16, 10).cast("long")
    out = files.select("path", F.length("content").cast("long").alias("size"), le(1, 4).alias("magic"), le(5, 1).alias("version"), le(6, 1).alias("dtype"), le(9, 4).alias("dim"), le(13, 4).alias("count"))
    ok = (F.col("size") >= SIZE) & (F.col("magic") == MAGIC) & (F.col("version") == VERSION) & layout_valid(F.col("size"), F.col("dim"), F.col("count"))
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def layout_valid(size, dim, count):
    return (size - SIZE) == dim * count


def vectors(files: DataFrame) -> DataFrame:
    """(path, row, embedding) of sidecar files read as binaryFile; files that can't be decoded give no rows."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                m = decode(content)
                for low in range(0, 0 if m is None else len(m), 4096):
                    part = m[low : low + 4096]
                    yield pd.DataFrame({"path": path, "row": np.arange(low, low + len(part), dtype=np.int32), "embedding": list(part)})

    return files.select("path", "content").mapInPandas(run, "path string, row int, embedding array<float>")


def _put(spark: SparkSession, path: str, parts) -> None:
    """Writes bytes to a file of any store that Spark knows, under another name until it is whole."""
    jvm = spark._jvm
    to, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.tmp"))
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    for part in parts:
        out.write(bytearray(part))
    out.close()
    fs.delete(to, False)
    if not fs.rename(new, to):
        raise OSError(f"{path} couldn't be written")


def write(index: DataFrame, folder: str) -> None:
    """embeddings.bin, then data.json, by the driver: the format is one file of each. A crash between the two leaves the old root, and a new run repeats both.

    For an index beyond one machine write_version() is the way.
    """
    spark = index.sparkSession
    packed = saved(pack_rows(index))
    sizes = packed.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if sizes["low"] != sizes["high"]:
        raise ValueError("vectors of different lengths")
    dim = sizes["low"] or 0

    def quantized(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"part": [b["row"].iloc[0]], "data": [encode(np.stack(b["embedding"].to_numpy()), dim)[SIZE:]]})

    # rows are in order within a partition, and partitions are ranges of them
    codes = packed.repartitionByRange("row").sortWithinPartitions("row").select("row", "embedding").mapInPandas(quantized, "part int, data binary")

    def vectors_of():
        yield struct.pack(LAYOUT, MAGIC, VERSION, INT8, 0, dim, sizes["n"])
        for r in codes.orderBy("part").select("data").toLocalIterator():  # a row for each few thousand vectors
            yield bytes(r["data"])

    def root():
        yield json.dumps({"schemaVersion": 2, "embeddingDim": dim})[:-1].encode() + b', "index": ['
        for r in packed.select("id", "content_hash", "updated_at", "row").orderBy("row").toLocalIterator():
            entry = {"id": r["id"], "contentHash": r["content_hash"], "updatedAt": r["updated_at"], "chunks": [{"row": r["row"], "start": 0, "end": 0, "hash": r["content_hash"]}]}
            yield (", " if r["row"] else "").encode() + json.dumps(entry).encode()
        yield b"]}"

    _put(spark, f"{folder}/embeddings.bin", vectors_of())
    _put(spark, f"{folder}/data.json", root())


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "embeddings.bin").load(folder)


def needs_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """One row (needs_rebuild): true if there are entries and the sidecar is missing, damaged, of another dimension or too short; false for old or empty roots."""
    root = spark.read.schema(ROOT).json(f"{folder}/data.json", multiLine=True).select("schemaVersion", "embeddingDim", F.size("index").alias("entries"))
    state = header(_files(spark, folder)).select("valid", "dim", "count")
    joined = root.join(state, F.lit(True), "left")
    bad = ~F.coalesce(F.col("valid"), F.lit(False)) | (F.col("dim") != F.col("embeddingDim")) | (F.col("count") < F.col("entries"))
    return joined.select(((F.col("schemaVersion") >= 2) & (F.col("entries") > 0) & bad).alias("needs_rebuild"))


def is_empty(spark: SparkSession, folder: str) -> DataFrame:
    """One row (is_empty): true without entries, and with entries of a new root whose sidecar is missing, damaged or of another dimension; false for an old root with entries."""
    root = spark.read.schema(ROOT).json(f"{folder}/data.json", multiLine=True).select("schemaVersion", "embeddingDim", F.coalesce(F.size("index"), F.lit(0)).alias("entries"))
    state = header(_files(spark, folder)).where("valid").select("dim")
    usable = (F.coalesce("schemaVersion", F.lit(1)) < 2) | F.coalesce(F.col("dim") == F.col("embeddingDim"), F.lit(False))
    return root.join(state, F.lit(True), "left").select(((F.col("entries") <= 0) | ~usable).alias("is_empty"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(id, embedding, content_hash, updated_at, position): the index, empty if the root is old or the sidecar doesn't fit it."""
    root = spark.read.schema(ROOT).json(f"{folder}/data.json", multiLine=True)
    good = header(_files(spark, folder)).where("valid").select("dim")
    entries = root.where("schemaVersion >= 2").join(good, F.col("dim") == F.col("embeddingDim")).select(F.posexplode("index").alias("position", "e"))
    rows = entries.select("e.id", "e.contentHash", "e.updatedAt", "position", F.get("e.chunks", F.lit(0))["row"].alias("row"))
    found = rows.join(vectors(_files(spark, folder)), "row")
    return found.select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("contentHash").alias("content_hash"), F.col("updatedAt").alias("updated_at"), F.col("position").cast("long").alias("position"))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from a root with vectors inline; no rows if its schemaVersion is 2 or more."""
    root = spark.read.schema(LEGACY).json(path, multiLine=True).where("coalesce(schemaVersion, 1) < 2")
    return root.select(F.posexplode("index").alias("position", "e")).select("e.id", "e.embedding", F.col("e.contentHash").alias("content_hash"), F.col("e.updatedAt").alias("updated_at"), F.col("position").cast("long").alias("position"))


def migrate(spark: SparkSession, path: str, folder: str) -> bool:
    """Rewrites an old root as sidecar and new root; vectors aren't computed anew. False if there is nothing to migrate."""
    old = read_legacy(spark, path)
    if old.isEmpty():
        return False
    write(old, folder)
    return True


def write_version(index: DataFrame, folder: str, version: int) -> None:
    """The index as one version in Parquet, with int8 vectors; it is complete once _SUCCESS is there. store.Store names the version that readers take."""
    codes = index.withColumn("embedding", V.quantize(F.col("embedding")))
    codes.write.mode("overwrite").parquet(f"{folder}/version={version}")


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/version={version}")
    return rows.withColumn("embedding", V.dequantize(F.col("embedding")).cast("array<double>"))


def latest(df: DataFrame) -> DataFrame:
    """Of rows (id, version, ...) each id's last version, for folders with several."""
    last = Window.partitionBy("id").orderBy(F.desc("version"))
    return df.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
