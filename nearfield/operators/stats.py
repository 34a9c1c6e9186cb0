"""Summaries of measurements and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import saved


def summarize(df: DataFrame, group: str, value: str) -> DataFrame:
    """mean, min, max, and the median and p95 at index floor(q (n - 1)) of each group's sorted values.

    Values are counted first and the counts sorted by ranges of (group, value). A value's place in its group is its place in its range plus what the ranges
    before hold of the group, of which there is one count for each range and group in it, so no task sees a whole group.
    """
    tally = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    tally = saved(tally.repartitionByRange("__g", "__v").sortWithinPartitions("__g", "__v").withColumn("__part", F.spark_partition_id()))
    held = tally.groupBy("__g", "__part").agg(F.sum("__c").alias("__n"))
    of_group = Window.partitionBy("__g")
    before = of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = saved(held.select("__g", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(of_group).alias("__all")))
    same = (F.col("__g").eqNullSafe(F.col("__g2"))) & (F.col("__part") == F.col("__part2"))
    placed = tally.join(held.withColumnsRenamed({"__g": "__g2", "__part": "__part2"}), same)
    inside = F.sum("__c").over(Window.partitionBy("__part", "__g").orderBy("__v"))
    placed = placed.withColumn("__upto", F.col("__before") + inside)
    at = lambda q: F.min(F.when(F.col("__upto") > F.floor(F.lit(q) * (F.col("__all") - 1)), F.col("__v")))
    mean = F.sum(F.col("__v") * F.col("__c")) / F.max("__all")
    return placed.groupBy(F.col("__g").alias(group)).agg(mean.alias("mean"), F.min("__v").alias("min"), F.max("__v").alias("max"), at(0.5).alias("median"), at(0.95).alias("p95"))


def chunk_stats(df: DataFrame, chunks: str) -> DataFrame:
    """Embedding calls and characters: the number of chunks and their total length."""
    return df.agg(F.sum(F.size(chunks)).alias("n_chunks"), F.sum(F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + F.length(c))).alias("n_chars"))
