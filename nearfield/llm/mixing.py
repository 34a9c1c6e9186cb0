"""Mixing sources to target weights, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table

MOST, SEEDS = 3, 64
#: A plan with more sources than this is joined by a shuffle and not broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digits(key: str, seeds: int = SEEDS) -> Column:
    """8 hexadecimal digits for each seed of a row's key, by md5s of the key and a number."""
    of = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.concat(*[F.md5(F.concat(of, F.lit(f":{j}"))) for j in range(-(-seeds // 4))])


def uniform(digits: Column, seed: Column) -> Column:
    """A number from 0 to below 1 for a row's digits() and a seed."""
    return F.conv(F.substr(digits, (seed * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of the total by weights 1, 2, 3, repeating.

    Weights go by code point order of the source, null last. No target is above most times
    its source's size; what is cut off is shared by weight among the others, until none is
    above. That is the level L with the sum of min(most * size, L * weight) equal to the total:
    sources are taken in order of most * size / weight, and the first that isn't cut fixes L.
    One row for each source, so the sorts are as large as the list of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = weighted.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cut"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("gone"),
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.row_number().over(by_ratio).alias("place"),
    )
    free = F.when((F.col("total") - F.col("cut")) * F.col("weight") <= F.col("cap") * (F.col("weights") - F.col("gone")), F.struct("place", "total", "cut", "weights", "gone"))
    run = run.withColumn("level", F.min(free).over(everything))
    level = F.col("level")
    share = (level["total"] - level["cut"]).cast("double") * F.col("weight") / (level["weights"] - level["gone"])
    return run.select("source", "source_size", F.when(level.isNull() | (F.col("place") < level["place"]), F.col("cap").cast("double")).otherwise(share).alias("target"))


def plan(rows: DataFrame, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """(source, source_size, target, whole, part, seed) for rows(source, size, __digits): a source's rate, whole + part, and the best of ``seeds`` hashes.

    Best is the hash whose words come nearest the target, over all rows of the source; the first of equals. Sources
    with many rows are near with any; one with a few long rows can only choose among their sums.
    """
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = saved(per_source.select("*", F.least(F.floor(rate), F.lit(most)).alias("whole"), (rate - F.floor(rate)).alias("part")))
    extra = F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda k: F.when(uniform(F.col("__digits"), k) < F.col("part"), F.col("size")).otherwise(0))
    tried = _known(rows, per_source.select("source", "part")).select("source", extra.alias("__extra")).groupBy("source").agg(*[F.sum(F.get("__extra", F.lit(k))).alias(f"extra{k}") for k in range(seeds)])
    miss = F.array(*[F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"extra{k}") - F.col("target")).alias("miss"), F.lit(k).alias("seed")) for k in range(seeds)])
    tried = tried.withColumnRenamed("source", "__source")
    return saved(per_source.join(tried, F.col("source").eqNullSafe(F.col("__source"))).select("source", "source_size", "target", "whole", "part", F.array_min(miss)["seed"].alias("seed")))


def _known(rows: DataFrame, per_source: DataFrame, source: str = "source") -> DataFrame:
    """rows with their source's columns of per_source; a plan of few sources is broadcast, and rows don't move."""
    named = per_source.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(named) if named.count() <= BROADCAST_SOURCES else named, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")


def copies() -> Column:
    """How often a row with the columns of plan() and digits() is taken."""
    return (F.col("whole") + F.when(uniform(F.col("__digits"), F.col("seed")) < F.col("part"), 1).otherwise(0)).cast("long")


def _sizes(df: DataFrame, key: str, text: str, source: str, seeds: int) -> DataFrame:
    return df.select(F.col(key).alias("__key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), digits(key, seeds).alias("__digits"))


def mix(df: DataFrame, key: str, text: str, source: str, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """How often the mix takes each row: (key, size, source, source_size, target, copies), a row for each of df.

    A source's rate is its target over its size, at most ``most``. A row is taken floor(rate)
    times, and once more if its hash falls below the fraction: a Bernoulli copy that a rerun
    repeats. Each source uses that one of ``seeds`` hashes whose words come nearest its target (plan()).

    Null texts and texts without words have size 0; they are taken as often as the rate says
    and add no words. A source of size 0 has rate 0. Null sources form one source, the last. Rows
    that repeat a key get the same hash; null keys count as empty strings. Other columns
    are left out, so names can't clash. An empty table gives no rows.
    """
    rows = saved(_sizes(df, key, text, source, seeds))
    return _known(rows, plan(rows, most, seeds)).select(F.col("__key").alias(key), "size", "source", "source_size", "target", copies().alias("copies"))


def emit(df: DataFrame, key: str, text: str, source: str, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """df's rows as often as the mix takes them, with df's columns; rows that repeat a key or have none are rows of their own."""
    held = plan(saved(_sizes(df, key, text, source, seeds)), most, seeds).select("source", "whole", "part", "seed")
    # df's own names can't clash: they are put aside under one name
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"), F.col(source).alias("__of"), digits(key, seeds).alias("__digits"))
    taken = _known(rows, held, "__of").select("__row", copies().alias("__copies")).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("__row.*")


def query(spark, sf_dir):
    """op4: how many words the mix takes of each document: doc_id, size, source_size, target, taken."""
    rows = mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _u(seed: str) -> str:
    return f"CAST(CAST('0x' || substr(h, CAST({seed} AS BIGINT) * 8 + 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    array_to_string(list_transform(range({SEEDS // 4}), lambda j: md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || j)), '') AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, {MOST} * source_size AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
        coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
        row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
        sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
l AS (SELECT arg_min(total - cut, place) AS rest, arg_min(weights - gone, place) AS shares, min(place) AS place FROM r
      WHERE (total - cut) * weight <= cap * (weights - gone)),
t AS (SELECT source, source_size, CASE WHEN l.place IS NULL OR r.place < l.place THEN CAST(cap AS DOUBLE) ELSE CAST(rest AS DOUBLE) * weight / shares END AS target FROM r, l),
p AS (SELECT *, least(floor(rate), {MOST}) AS whole, rate - floor(rate) AS part
      FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)),
x AS (SELECT doc_id, size, h, d.source, source_size, target, whole, part FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, seed, any_value(whole * source_size - target) AS whole_miss, sum(CASE WHEN {_u("seed")} < part THEN size ELSE 0 END) AS extra
      FROM x, range({SEEDS}) k(seed) GROUP BY source, seed),
b AS (SELECT source, seed FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(whole_miss + extra), seed) = 1)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN {_u("seed")} < part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x JOIN b ON x.source IS NOT DISTINCT FROM b.source
"""
