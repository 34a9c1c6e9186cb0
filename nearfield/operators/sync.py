"""Set reconciliation and the plan that brings an index in line with its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import ignored
from .ranking import global_rank


def to_add(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.select("id").distinct().join(target.select("id"), "id", "left_anti")


def to_remove(source: DataFrame, target: DataFrame) -> DataFrame:
    return to_add(target, source)


def duplicates(target: DataFrame) -> DataFrame:
    """A row for each occurrence of an id after its first."""
    return target.groupBy("id").count().where("count > 1").select("id", F.explode(F.sequence(F.lit(2), F.col("count"))).alias("occurrence"))


def sync_actions(source: DataFrame, target: DataFrame) -> DataFrame:
    """(action, id): add and remove; ids that the target has more than once are in both."""
    again = duplicates(target).select("id")
    adds = to_add(source, target).unionByName(again).select(F.lit("add").alias("action"), "id")
    return adds.unionByName(to_remove(source, target).unionByName(again).select(F.lit("remove").alias("action"), "id"))


def seed_order(candidates: DataFrame) -> DataFrame:
    """Adds seq from 0: recently opened first, then the latest change, then id in Unicode collation order."""
    order = [F.col("recent_open_rank").asc_nulls_last(), F.desc("modified_at"), F.collate("id", "UNICODE").asc(), F.col("id").asc()]
    return global_rank(candidates, order, "seq").select("id", F.col("seq").cast("int").alias("seq"))


def sync_plan(candidates: DataFrame, indexed: DataFrame, queued: DataFrame, rules: DataFrame, force: bool = False) -> DataFrame:
    """(action, id, seq): remove_from_index, remove_from_queue and seed; only seeds have a seq, their order."""
    valid = ignored(candidates, rules, keep=True)
    actions = sync_actions(valid, indexed)
    wanted = valid if force else valid.join(actions.where("action = 'add'").select("id"), "id", "left_semi")
    gone = actions.where("action = 'remove'").select("id").distinct()
    stale = queued.select("id").distinct().join(valid.select("id"), "id", "left_anti")
    none = F.lit(None).cast("int")
    return (
        gone.select(F.lit("remove_from_index").alias("action"), "id", none.alias("seq"))
        .unionByName(stale.select(F.lit("remove_from_queue").alias("action"), "id", none.alias("seq")))
        .unionByName(seed_order(wanted).select(F.lit("seed").alias("action"), "id", "seq"))
    )


def apply_plan(plan: DataFrame, index: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index without removed ids, and the queue without removed ids and with the plan's seeds."""
    from .queue import merge_seeds, remove

    out = plan.where("action <> 'seed'").select("id").distinct()
    kept = index.join(plan.where("action = 'remove_from_index'").select("id"), "id", "left_anti")
    return kept, merge_seeds(remove(queue, out), plan.where("action = 'seed'").select("id", "seq"))


def index_outcome(prepared: DataFrame, index: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, outcome, content_hash): removed, unchanged or indexed, from prepared(id, status, content_hash).

    Of an index's rows with one id the first counts, by position where the index has it. Everything here is known before a vector
    is made, so the embedder sees only rows whose outcome is indexed.
    """
    hit = ignored(prepared, rules).select("id", F.lit(True).alias("__ignored"))
    first = F.min_by("content_hash", "position") if "position" in index.columns else F.min("content_hash")
    known = index.groupBy("id").agg(first.alias("__hash"))
    rows = prepared.join(hit, "id", "left").join(known, "id", "left")
    gone = ~F.lower("id").endswith(".md") | F.col("__ignored").isNotNull() | (F.col("status") != "ready")
    outcome = F.when(gone, "removed").when(F.col("__hash").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("indexed")
    return rows.select("id", outcome.alias("outcome"), "content_hash")
