"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import md5_int, table

SHARDS, SLOTS = 16, 2039


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot of the table, the position of the shard that holds it.

    slots must be prime and larger than the number of shards, so that each shard's
    preference order, (offset + turn * skip) mod slots, visits every slot. Shards take
    turns in the order given; each claims the first slot of its order that is still free.
    Offset and skip come from the shard's name alone, so a shard that joins or leaves moves
    few keys between the others. The same name twice, or no name, is an error.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime above the number of shards")
    digest = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at = [int(d[:12], 16) % slots for d in digest]
    skip = [int(d[12:24], 16) % (slots - 1) + 1 for d in digest]
    owner = [-1] * slots
    for claim in range(slots):
        k = claim % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % slots
        owner[at[k]] = k
    return owner


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df's rows with ``slot`` (int) and ``shard`` (string), found by one lookup for each row.

    The table has ``slots`` rows whatever the data's size, and is broadcast; rows don't move.
    A null key counts as the empty string. Equal keys share a shard, repeated rows stay.
    Columns of df named slot or shard are replaced; other columns stay. Empty tables give no rows.
    """
    held = df.sparkSession.createDataFrame(list(enumerate(fill(shards, slots))), "__slot int, __owner int")
    names = F.array(*[F.lit(s) for s in shards])
    held = held.select("__slot", F.element_at(names, F.col("__owner") + 1).alias("__shard"))
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    hashed = df.withColumn("__slot", (md5_int(F.coalesce(F.col(key).cast("string"), F.lit("")), 1, 12) % slots).cast("int"))
    return hashed.join(F.broadcast(held), "__slot").select(*kept, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def write_shards(df: DataFrame, path: str, rows_each: int = 1_000_000) -> None:
    """Writes placed rows under path/shard=...; files take about rows_each rows, so a large shard has many writers, also one of equal rows.

    The salt is a row's place in its partition of the input, which a task that runs again gives again if its input
    comes in the same order, as files and checkpoints do.
    """
    parts = max(1, -(-df.count() // rows_each))
    place = F.monotonically_increasing_id()
    df.withColumn("__salt", F.pmod(F.xxhash64(place), F.lit(parts))).repartition("shard", "__salt").drop("__salt").write.partitionBy("shard").parquet(path)


NAMES = [f"shard-{k:02d}" for k in range(SHARDS)]


def query(spark, sf_dir):
    """op1: the shard of every document: doc_id, slot, shard."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", NAMES)


SQL = f"""
WITH RECURSIVE shards AS (
  SELECT k, printf('shard-%02d', k) AS shard FROM range({SHARDS}) t(k)),
prefs AS (
  SELECT k, shard, CAST('0x' || substr(md5(shard), 1, 12) AS BIGINT) % {SLOTS} AS first_slot,
         CAST('0x' || substr(md5(shard), 13, 12) AS BIGINT) % {SLOTS - 1} + 1 AS skip FROM shards),
wishes AS (
  SELECT k, list((first_slot + turn * skip) % {SLOTS} ORDER BY turn) AS wish
  FROM prefs, range({SLOTS}) t(turn) GROUP BY k),
claims AS (
  SELECT 0 AS claim, list_transform(range({SLOTS}), lambda x: -1) AS owner
  UNION ALL
  SELECT claim + 1, list_transform(range({SLOTS}), lambda s: CASE WHEN s = got THEN claim % {SHARDS} ELSE owner[s + 1] END)
  FROM (SELECT claim, owner, list_filter(wish, lambda s: owner[s + 1] = -1)[1] AS got
        FROM claims JOIN wishes ON k = claim % {SHARDS} WHERE claim < {SLOTS})),
slots AS (
  SELECT unnest(range({SLOTS})) AS slot, unnest(owner) AS k FROM claims WHERE claim = {SLOTS})
SELECT doc_id, CAST(slot AS INT) AS slot, shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % {SLOTS} AS slot FROM documents)
JOIN slots USING (slot) JOIN shards USING (k)
"""
