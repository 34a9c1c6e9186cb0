"""Debounced edits, throttled writes and change feeds, as batches and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import saved

DEBOUNCE_MS, THROTTLE_MS = 1100, 1000
#: Stands for the time before a feed's first event.
BEGINNING = -(1 << 62)


def debounce(events: DataFrame, key: str, ts: str, gap: str = f"{DEBOUNCE_MS} milliseconds") -> DataFrame:
    """(key, session_start, last_ts, n): a key's events with no more than the gap between them, which fire once after the last.

    Batch and stream alike; a stream needs a watermark on ts, of type TIMESTAMP, and gives closed sessions.
    """
    grouped = events.groupBy(F.col(key), F.session_window(ts, gap).alias("__w"))
    return grouped.agg(F.max(ts).alias("last_ts"), F.count("*").alias("n")).select(key, F.col("__w.start").alias("session_start"), "last_ts", "n")


def debounce_stream(events: DataFrame, key: str, ts: str, gap: str, late: str = "0 seconds") -> DataFrame:
    return debounce(events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), key, ts, gap)


def throttle(writes: DataFrame, key: str, ts_ms: str, seq: str, every_ms: int = THROTTLE_MS) -> DataFrame:
    """(key, flush_ms, seq): what is written if the first pending write starts a timer and its end writes the latest snapshot.

    A window starts at the first write after the last window's end, so windows depend on the data. Writes at one time are reduced to their
    last before they are dealt; a key's times are then followed in one sorted pass that holds a single window, also of a key that never pauses.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    kind = writes.schema[key]
    last = writes.groupBy(F.col(key).alias("__key"), F.col(ts_ms).cast("long").alias("__t")).agg(F.max(seq).alias("__seq"))
    schema = StructType([StructField(key, kind.dataType), StructField("flush_ms", LongType()), StructField("seq", writes.schema[seq].dataType)])

    def fold(batches):
        import pandas as pd

        known = start = newest = None
        begun = False
        for batch in batches:
            out = []
            for k, t, s in zip(batch["__key"], batch["__t"].tolist(), batch["__seq"].tolist(), strict=True):
                if begun and k == known and t < start + every_ms:
                    newest = s
                    continue
                if begun:
                    out.append((known, start + every_ms, newest))
                known, start, newest, begun = k, t, s, True
            yield pd.DataFrame(out, columns=[key, "flush_ms", "seq"])
        if begun:
            yield pd.DataFrame([(known, start + every_ms, newest)], columns=[key, "flush_ms", "seq"])

    return last.repartition("__key").sortWithinPartitions("__key", "__t").mapInPandas(fold, schema)


def outcomes(ids: DataFrame, feed: DataFrame) -> DataFrame:
    """(id, source_id, edited, seq): the ids that exist after feed(op, id, old_id, seq) over ids(id), and where each one's content comes from.

    Events count in order of seq, one by one: edit and open make an id exist with content of its own; delete takes it away; a
    rename moves the content of old_id to id, in place of what id had, and does nothing if old_id doesn't exist then or is id. source_id is the id whose content it is: edited in this feed or
    as it was before. seq is the id's last event that did something, null where none did.

    What an id is after an event depends on the event before it of that id or, for a rename, of old_id. Renames are settled in rounds, as
    far as what they depend on is settled: as many rounds as the longest chain of renames without an edit between them.
    """
    e = feed.select("seq", "op", "id", "old_id").where("op <> 'rename' or (old_id is not null and old_id <> id)")
    moves = e.where("op = 'rename'")
    touched = e.unionByName(moves.select("seq", F.lit("out").alias("op"), F.col("old_id").alias("id"), F.lit(None).cast("string").alias("old_id")))
    before = F.coalesce(F.lag("seq").over(Window.partitionBy("id").orderBy("seq")), F.lit(BEGINNING))
    nodes = saved(touched.withColumn("before", before))
    first = nodes.select("id").distinct().join(ids.select("id").distinct().withColumn("__there", F.lit(True)), "id", "left")
    state = lambda alive, source, edited, last: [alive.alias("alive"), source.alias("source_id"), F.lit(edited).alias("edited"), last.cast("long").alias("last")]
    settled = first.select("id", F.lit(BEGINNING).alias("seq"), *state(F.col("__there").isNotNull(), F.col("id"), False, F.lit(None)))
    own = nodes.where("op <> 'rename'").select("id", "seq", *state(F.col("op").isin("edit", "open"), F.col("id"), True, F.col("seq")))
    settled = saved(settled.unionByName(own))
    old = nodes.where("op = 'out'").select("seq", F.col("before").alias("old_before"))
    waiting = saved(nodes.where("op = 'rename'").join(old, "seq").select("id", "seq", "old_id", "before", "old_before"))
    while not waiting.isEmpty():
        known = lambda prefix, a, b: settled.select(F.col("id").alias(a), F.col("seq").alias(b), *[F.col(c).alias(prefix + c) for c in ("alive", "source_id", "edited", "last")])
        tried = waiting.join(known("a_", "old_id", "old_before"), ["old_id", "old_before"], "left").join(known("b_", "id", "before"), ["id", "before"], "left")
        done = F.col("a_alive") | (~F.col("a_alive") & F.col("b_alive").isNotNull())
        tried = saved(tried.withColumn("done", F.coalesce(done, F.lit(False))))
        pick = lambda c: F.when(F.col("a_alive"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
        new = tried.where("done").select("id", "seq", pick("alive").alias("alive"), pick("source_id").alias("source_id"), pick("edited").alias("edited"), F.when(F.col("a_alive"), F.col("seq")).otherwise(F.col("b_last")).alias("last"))
        settled = saved(settled.unionByName(new))
        waiting = tried.where("not done").select("id", "seq", "old_id", "before", "old_before")
    final = settled.groupBy("id").agg(F.max_by(F.struct("alive", "source_id", "edited", "last"), "seq").alias("s"))
    alive = final.where("s.alive").select("id", "s.source_id", "s.edited", F.col("s.last").alias("seq"))
    rest = ids.select("id").join(final.select("id"), "id", "left_anti")
    return alive.unionByName(rest.select("id", F.col("id").alias("source_id"), F.lit(False).alias("edited"), F.lit(None).cast("long").alias("seq")))


def apply_changes(ids: DataFrame, feed: DataFrame) -> DataFrame:
    """(id, source_id, seq) of outcomes()."""
    return outcomes(ids, feed).select("id", "source_id", "seq")


def apply_batch(index: DataFrame, batch: DataFrame, vectors: DataFrame) -> DataFrame:
    """An index after one micro-batch of feed(op, id, old_id, seq), in order of seq; vectors has new rows for edited ids, under the id that was edited.

    Ids that stay where they are keep their place; renamed and new ones come after them, by seq. An edited id without a new row keeps its old one, and has none if it
    had none. Of an index's repeated ids the first row counts. The plan doesn't depend on how many renames there are.
    """
    rest = [c for c in index.columns if c not in ("id", "position")]
    old = index.groupBy("id").agg(F.min_by(F.struct(*rest), "position").alias("old"), F.min("position").alias("position"))
    new = vectors.groupBy("id").agg(F.max_by(F.struct(*rest), "position").alias("new"))
    after = saved(outcomes(index, batch).distinct())
    end = index.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("__end"))
    rows = after.join(old.withColumnRenamed("id", "source_id"), "source_id", "left").join(new.withColumnRenamed("id", "source_id"), "source_id", "left").crossJoin(F.broadcast(end))
    rows = rows.withColumn("row", F.when(F.col("edited"), F.coalesce("new", "old")).otherwise(F.col("old"))).where("row is not null")
    stays = (F.col("id") == F.col("source_id")) & F.col("position").isNotNull()
    place = F.when(stays, F.col("position")).otherwise(F.col("__end") + 1 + F.col("seq") - F.lit(after.agg(F.min("seq")).first()[0] or 0))
    return rows.select("id", *[F.col(f"row.{c}").alias(c) for c in rest], place.alias("position")).select(index.columns)


def routed(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Of feed(op, id, old_id, seq, is_file) what reaches the index and the queue: files alone, and edits and opens of Markdown notes; those below an ignore rule become deletes."""
    from ..functions.text import is_markdown
    from ..operators.paths import ignored

    files = events.where("is_file").drop("is_file")
    bumps = files.where(F.col("op").isin("edit", "open") & is_markdown(F.col("id")))
    return files.where(~F.col("op").isin("edit", "open")).unionByName(ignored(bumps, rules, keep=True)).unionByName(ignored(bumps, rules).withColumn("op", F.lit("delete")))


def run_stream(feed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Starts handle(batch, n) over a streaming feed, one batch at a time, so there is one writer. Batches may come again after a failure; handle must bear that."""
    writer = feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{THROTTLE_MS} milliseconds")).start()


def latest_snapshot(writes: DataFrame, key: str, seq: str) -> DataFrame:
    """Of pending writes the last for each key: what a flush keeps."""
    last = Window.partitionBy(key).orderBy(F.desc(seq))
    return writes.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
