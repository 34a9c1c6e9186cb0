"""Jobs that bring an index in line with its notes, their counters, and what happens at the start."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from . import queue as Q
from .index import remove, upsert
from .prepare import Settings, mean_pool, prepare
from .ranking import saved
from .sync import apply_plan, index_outcome, sync_plan

EMPTY_QUEUE = "id string, reason string, seq long"


@dataclass
class Runtime:
    """Counters of this session's runs, and who wants to hear of them."""

    completed: bool = False
    running: bool = False
    fatal: str | None = None
    pending: int = 0
    processed: int = 0
    failed: int = 0
    indexed: int = 0
    deleted: int = 0
    closed: bool = False
    listeners: list[Callable[[dict], None]] = field(default_factory=list)

    def snapshot(self) -> dict:
        total = self.processed + self.pending
        kind, message = Q.banner_of(self.fatal, self.running or self.pending > 0, self.completed)
        return {"is_running": self.running, "completed": self.completed, "pending": self.pending, "processed": self.processed, "total": total, "failed": self.failed, "fatal_error": self.fatal, "kind": kind, "message": message}

    def subscribe(self, listener: Callable[[dict], None]) -> Callable[[], None]:
        """Tells the listener of each change; what is returned ends that."""
        self.listeners.append(listener)
        return lambda: self.listeners.remove(listener) if listener in self.listeners else None

    def set(self, **new) -> None:
        """Changes counters; listeners hear of it if any is another."""
        if any(getattr(self, k) != v for k, v in new.items()):
            for k, v in new.items():
                setattr(self, k, v)
            for listener in list(self.listeners):
                listener(self.snapshot())

    def begin(self, pending: int) -> None:
        self.set(running=True, processed=0, failed=0, fatal=None, pending=pending)

    def unload(self) -> None:
        """Later runs do nothing."""
        self.set(closed=True, running=False, pending=0)


def processed(queue: DataFrame, notes: DataFrame, index: DataFrame, rules: DataFrame, settings: Settings, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, outcome, content_hash, embedding, error) for each queued id: removed, unchanged, indexed or failed.

    Only texts whose outcome is indexed are embedded, chunk by chunk. embed(chunk) is a struct (vector, error), as prepare.tried_udf()
    gives it; a note with a chunk that has an error fails with it, and the others go on.
    """
    ready = saved(prepare(queue.select("id").distinct(), notes, settings).withColumn("content_hash", T.content_hash("prepared_text")))
    outcome = saved(index_outcome(ready, index, rules))
    new = outcome.where("outcome = 'indexed'").select("id").join(ready.select("id", F.explode("chunks").alias("chunk")), "id")
    made = saved(new.select("id", embed(F.col("chunk")).alias("e")).select("id", "e.vector", "e.error"))
    errors = made.where("error is not null").groupBy("id").agg(F.min("error").alias("error"))
    pooled = mean_pool(made.where("error is null"), "id", "vector").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    vectors = pooled.select("id", V.normalize(F.transform("v", lambda x: x["value"])).alias("embedding"))
    out = outcome.join(errors, "id", "left").join(vectors, "id", "left")
    return out.select("id", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("outcome")).alias("outcome"), "content_hash", F.when(F.col("error").isNull(), F.col("embedding")).alias("embedding"), "error")


def applied(index: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """The index after processed(): indexed notes get their row, removed ones lose it, failed ones keep what they had."""
    kept = remove(index, outcomes.where("outcome = 'removed'"))
    new = outcomes.where("outcome = 'indexed' and embedding is not null")
    return upsert(kept, new.select("id", "embedding", "content_hash", F.lit(now).alias("updated_at"), F.xxhash64("id").bitwiseAND((1 << 40) - 1).alias("position")))


def sync(store, notes: DataFrame, candidates: DataFrame, rules: DataFrame, embed, runtime: Runtime, queue: DataFrame | None = None, force: bool = False, now: str = "1970-01-01T00:00:00.000Z") -> dict:
    """One run: plan, process what is queued, write. {"indexed", "deleted"} counts what this run changed.

    A note that fails is counted and the run goes on; an error of the run itself is kept in the runtime and raised. The index is flushed
    once, at the end, and the initial pass counts as completed after the first run without such an error.
    """
    if runtime.closed:
        return {"indexed": 0, "deleted": 0}
    spark = notes.sparkSession
    runtime.set(completed=store.settings().initial_index_completed)
    before = (runtime.indexed, runtime.deleted)
    try:
        index = saved(store.read())
        queue = spark.createDataFrame([], EMPTY_QUEUE) if queue is None else queue
        plan = saved(sync_plan(candidates, index.select("id"), queue.select("id"), rules, force=force))
        kept, todo = apply_plan(plan, index, queue)
        todo = saved(todo)
        gone = plan.where("action = 'remove_from_index'").select("id").distinct().count()
        runtime.set(deleted=runtime.deleted + gone)
        n, counts = todo.count(), {}
        if n:
            runtime.begin(n)
            outcomes = saved(processed(todo, notes, kept, rules, store.settings(), embed))
            counts = {r["outcome"]: r["n"] for r in outcomes.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
            kept = applied(kept, outcomes, now)
            runtime.set(pending=0, processed=n, failed=counts.get("failed", 0), indexed=runtime.indexed + counts.get("indexed", 0))
        if gone or counts.get("indexed") or counts.get("removed"):
            store.rewrite(saved(kept))
            store.flush()
        runtime.set(running=False)
        if not runtime.completed:
            store.update_settings(initial_index_completed=True)
            runtime.set(completed=True)
    except Exception as e:
        runtime.set(fatal=str(e), running=False)
        raise
    return {"indexed": runtime.indexed - before[0], "deleted": runtime.deleted - before[1]}


def sync_with_progress(on_progress: Callable[[dict], None], runtime: Runtime, **how) -> dict:
    """sync() that tells of its progress: {"phase": scan or index, "processed", "total"}; nothing is told while there is nothing to show."""

    def tell(s: dict) -> None:
        if s["kind"] != "hidden":
            on_progress({"phase": "index" if s["completed"] else "scan", "processed": s["processed"], "total": s["total"]})

    stop = runtime.subscribe(tell)
    try:
        return sync(runtime=runtime, **how)
    finally:
        stop()


def reindex(note_id: str, store, notes: DataFrame, rules: DataFrame, embed, runtime: Runtime, now: str = "1970-01-01T00:00:00.000Z") -> str:
    """One note, now: its outcome, or "ignored" if it isn't Markdown. A note below an ignore rule is removed."""
    if not note_id.lower().endswith(".md"):
        return "ignored"
    spark = notes.sparkSession
    one = spark.createDataFrame([(note_id, "manual", 0)], EMPTY_QUEUE)
    index = saved(store.read())
    outcomes = saved(processed(one, notes, index, rules, store.settings(), embed))
    outcome = outcomes.first()["outcome"]
    if outcome in ("indexed", "removed"):
        store.rewrite(saved(applied(index, outcomes, now)))
        store.flush()
        runtime.set(**{"indexed": runtime.indexed + 1} if outcome == "indexed" else {"deleted": runtime.deleted + 1})
    return outcome


def save_settings(store, run: Callable[..., dict], **patch) -> bool:
    """Writes checked settings; if the index isn't empty all notes are queued again by run(force=True). Whether they were."""
    store.update_settings(**patch)
    if store.is_empty():
        return False
    run(force=True)
    return True


def bootstrap(store, run: Callable[..., dict], legacy: str | None = None) -> str:
    """What a start does: "migrated", "rebuilt", "synced" or "ready".

    An old root with vectors inline is written as a version, without embedding anything. An index that can't be read whole is emptied and
    made anew from all notes. Otherwise a run repairs the index, unless the initial pass is done and left nothing.
    """
    from ..sources import sidecar

    migrated = False
    if legacy and not store.version():
        old = sidecar.read_legacy(store.spark, legacy)
        if not old.isEmpty():
            store.rewrite(old)
            store.flush()
            migrated = True
    if store.needs_rebuild():
        store.rewrite(store.spark.createDataFrame([], "id string, embedding array<double>, content_hash string, updated_at string, position long"))
        store.flush()
        run(force=True)
        return "rebuilt"
    if not store.settings().initial_index_completed or not store.is_empty():
        run()
        return "migrated" if migrated else "synced"
    return "ready"
