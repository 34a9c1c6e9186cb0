"""The vector index as a table (id, embedding, content_hash, updated_at, position): changes, packing and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .ranking import global_rank

COLUMNS = ["id", "embedding", "content_hash", "updated_at", "position"]


def find_by_id(index: DataFrame, note_id) -> DataFrame:
    return index.where(F.col("id") == F.lit(note_id)).orderBy("position").limit(1)


def upsert(index: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's last row for an id wins. Known ids keep the place of their first row, new ones are appended; repeats in the index collapse to their last row."""
    rest = [c for c in index.columns if c not in ("id", "position")]
    old = index.groupBy("id").agg(*[F.max_by(F.struct(*rest), "position").alias("old")], F.min("position").alias("position"))
    new = batch.groupBy("id").agg(F.max_by(F.struct(*rest), "position").alias("new"), F.min("position").alias("later"))
    shift = index.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("__end"))
    rows = old.join(new, "id", "full").crossJoin(F.broadcast(shift))
    value = F.coalesce("new", "old")
    return rows.select("id", *[value[c].alias(c) for c in rest], F.coalesce("position", F.col("__end") + 1 + F.col("later")).alias("position"))


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def rename(index: DataFrame, old: str, new: str) -> DataFrame:
    """The first row of old becomes new, at the end, in place of rows of new; nothing happens if old has no row or is new."""
    if old == new:
        return index
    first = find_by_id(index, old)
    end = index.agg(F.max("position").alias("__end"))
    moved = first.crossJoin(end).select(*[(F.lit(new) if c == "id" else F.col("__end") + 1 if c == "position" else F.col(c)).alias(c) for c in index.columns])
    there = F.broadcast(first.select(F.lit(True).alias("__there")))
    kept = index.join(there, F.col("id").isin(old, new), "left_anti")
    return kept.unionByName(moved)


def pack_rows(index: DataFrame) -> DataFrame:
    """Adds row from 0 by rising id: a vector's place in the sidecar."""
    return global_rank(index, [F.col("id"), F.col("position")], "row").withColumn("row", F.col("row").cast("int"))


def unpack(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """entries(id, chunks) with the vector of their first chunk's row; entries without one in vectors(row, embedding) are left out."""
    rows = entries.withColumn("row", F.get("chunks", F.lit(0))["row"])
    return rows.join(vectors, "row")


def stored(index: DataFrame, vectors: str = "exact") -> DataFrame:
    """The index with vectors as they are (exact) or as they come back from int8 storage (quantized)."""
    if vectors not in ("exact", "quantized"):
        raise ValueError("vectors must be exact or quantized")
    return index if vectors == "exact" else index.withColumn("embedding", V.dequantize(V.quantize(F.col("embedding"))).cast("array<double>"))
