"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only on a single machine, as in tests, a temporary one stands in where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or f"file://{tempfile.mkdtemp(prefix='nearfield-')}"


def saved(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with ``name``, each row's place from 0 in the order.

    Rows are sorted by ranges and kept; a row's place is its place in its range and the number of rows in the ranges
    before, of which there is one count for each partition. Rows that the order doesn't tell apart take places as they come.
    """
    rows = saved(df.orderBy(*order).select("*", F.monotonically_increasing_id().alias("__id")))
    part, inside = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(name, (F.col("__start") + inside)).drop("__part", "__start", "__id")
