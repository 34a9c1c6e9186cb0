"""Ignore rules, links and what a list of related notes shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import saved


def ignored(df: DataFrame, rules: DataFrame, key: str = "id", keep: bool = False) -> DataFrame:
    """Rows whose path is a rule or lies below one; with keep, the other rows.

    Each path's own prefixes meet the rules in an equality join, so neither side is compared pair by pair.
    """
    wanted = rules.select(T.normalize_path(F.col("rule")).alias("rule")).where("rule <> ''").distinct()
    parts = F.split(T.normalize_path(F.col(key)), "/")
    hits = df.select(F.col(key).alias("__id"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("rule"))
    hits = hits.join(wanted, "rule", "left_semi").select("__id").distinct()
    return df.join(hits, F.col(key) == F.col("__id"), "left_anti" if keep else "left_semi")


def wikilinks(df: DataFrame, key: str = "id") -> DataFrame:
    """Adds basename, target and link: the basename if no other row has it, else the path.

    Basenames are counted, with partial counts in each partition, and rows join the repeated ones, so a common name isn't one task's.
    """
    named = df.withColumn("basename", T.basename(F.col(key)))
    repeated = saved(named.groupBy(F.col("basename").alias("__name")).agg(F.count("*").alias("__n")).where("__n > 1"))
    named = named.join(repeated, F.col("basename") == F.col("__name"), "left")
    named = named.withColumn("target", F.when(F.col("__n").isNotNull(), T.strip_md(F.col(key))).otherwise(F.col("basename"))).drop("__name", "__n")
    return named.withColumn("link", F.concat(F.lit("[["), F.col("target"), F.lit("]]")))


def render(df: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """title, parent and percent of the list; modal_title and modal_percent of the search window."""
    share = F.col(score) * 100
    return df.select(
        key,
        T.basename(F.col(key)).alias("title"),
        T.parent(F.col(key)).alias("parent"),
        F.concat(F.floor(share + 0.5).cast("string"), F.lit("%")).alias("percent"),
        F.regexp_replace(key, r"\.md$", "").alias("modal_title"),
        F.concat((F.signum(share) * F.floor(F.abs(share) + 0.5)).cast("long").cast("string"), F.lit("%")).alias("modal_percent"),
    )
