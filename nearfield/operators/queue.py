"""The indexing queue as a table (id, reason, seq). Reasons drain manual, edit, open, seed; a higher seq of the first three comes first, seeds go by rising seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank

PRIORITY = {"manual": 0, "edit": 1, "open": 2, "seed": 3}
#: Banner texts.
FAILED_LATER = "Index updates paused after an error. Results may be stale until you sync again."
FAILED_FIRST = "Indexing paused after an error. Results may be incomplete until you sync again."
RUNNING_LATER = "Index update in progress. Results may shift as more notes are processed."
RUNNING_FIRST = "Initial indexing in progress. Results are already available, but they may still be incomplete."
MIN_BANNER = 8


def priority(reason: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, place in PRIORITY.items():
        out = F.when(reason == name, place).otherwise(out)
    return out


def _order() -> list[Column]:
    return [priority(F.col("reason")), F.when(F.col("reason") == "seed", F.col("seq")).otherwise(-F.col("seq")), F.col("id")]


def bump(events: DataFrame) -> DataFrame:
    """The queue after events(id, reason, seq): each one moves its id to the front of its bucket, so an id's last event counts."""
    return events.groupBy("id").agg(F.max_by("reason", "seq").alias("reason"), F.max("seq").alias("seq"))


def remove(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return queue.join(ids.select("id"), "id", "left_anti")


def invalid(queue: DataFrame, valid: DataFrame) -> DataFrame:
    """Queued ids that aren't valid any more, once each."""
    return queue.select("id").distinct().join(valid.select("id"), "id", "left_anti")


def contains(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(queue.select("id"), "id", "left_semi")


def merge_seeds(queue: DataFrame, seeds: DataFrame) -> DataFrame:
    """New seeds take the old ones' place; ids in another bucket are left out, repeats count at their first seq."""
    rest = queue.where("reason <> 'seed'").select("id", "reason", F.col("seq").cast("long").alias("seq"))
    first = seeds.groupBy("id").agg(F.min("seq").cast("long").alias("seq"))
    return rest.unionByName(first.join(rest.select("id"), "id", "left_anti").select("id", F.lit("seed").alias("reason"), "seq"))


def next_note(queue: DataFrame) -> DataFrame:
    return queue.orderBy(*_order()).limit(1).select("id", "reason")


def drain_order(queue: DataFrame) -> DataFrame:
    """Adds place from 1 over the whole queue: its total order."""
    return global_rank(queue, _order(), "place").select("id", "reason", (F.col("place") + 1).cast("int").alias("place"))


def counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("reason").agg(F.count("*").alias("n"))


def banner_of(fatal: str | None, busy: bool, done: bool) -> tuple[str, str]:
    """(kind, message) of banner() for one run's state."""
    if fatal:
        return "failed", FAILED_LATER if done else FAILED_FIRST
    if busy:
        return ("updating", RUNNING_LATER) if done else ("initial", RUNNING_FIRST)
    return "hidden", ""


def banner(df: DataFrame) -> DataFrame:
    """Adds kind, message, progress_label and visible to snapshots(fatal_error, is_running, completed, pending, processed, total)."""
    failed, busy, done = F.col("fatal_error").isNotNull() & (F.col("fatal_error") != ""), F.col("is_running") | (F.col("pending") > 0), F.col("completed")
    kind = F.when(failed, "failed").when(busy & done, "updating").when(busy, "initial").otherwise("hidden")
    said = F.when(failed & done, FAILED_LATER).when(failed, FAILED_FIRST).when(busy & done, RUNNING_LATER).when(busy, RUNNING_FIRST).otherwise("")
    out = df.withColumns({"kind": kind, "message": said, "progress_label": F.when(F.col("total") > 0, F.concat("processed", F.lit(" / "), "total"))})
    return out.withColumn("visible", (F.col("kind") == "failed") | ((F.col("kind") != "hidden") & (F.col("total") >= MIN_BANNER)))


def snapshot(runs: DataFrame) -> DataFrame:
    """Adds total, indexed_delta and deleted_delta to runs with counters before and after."""
    return runs.withColumns(
        {
            "total": F.col("processed") + F.col("pending") + F.when(F.col("current").isNotNull(), 1).otherwise(0),
            "indexed_delta": F.col("indexed_after") - F.col("indexed_before"),
            "deleted_delta": F.col("deleted_after") - F.col("deleted_before"),
        }
    )
