"""python -m nearfield VERB --store FOLDER --notes PARQUET: sync, reindex ID, similar ID, search TEXT, settings NAME=VALUE ...

notes is a table (id, title, markdown[, modified_at, recent_open_rank]). The embedder is the letter stand-in; a model takes its place
through operators.prepare.tried_udf() in a program of one's own.
"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vector as V
from .operators import lifecycle, search
from .operators import prepare as PR
from .sources.store import Store


def run(spark: SparkSession, verb: str, store: Store, notes: DataFrame | None = None, words: list[str] = ()) -> object:
    """What a verb prints: counts, an outcome, rows (id, score), or settings."""
    runtime, now = lifecycle.Runtime(), datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")

    def sync(force: bool = False):
        known = notes.columns
        extra = [F.col(c) if c in known else F.lit(None if c == "recent_open_rank" else 0).cast(kind).alias(c) for c, kind in (("modified_at", "long"), ("recent_open_rank", "int"))]
        candidates = notes.where(T.is_markdown(F.col("id"))).select("id", *extra)
        return lifecycle.sync(store, notes, candidates, rules(), PR.letters_tried, runtime, force=force, now=now)

    def rules():
        return spark.createDataFrame([(p,) for p in store.settings().ignored_paths], "rule string")

    if verb == "sync":
        return {"start": lifecycle.bootstrap(store, sync)} | {"indexed": runtime.indexed, "deleted": runtime.deleted, "failed": runtime.failed}
    if verb == "reindex":
        return {words[0]: lifecycle.reindex(words[0], store, notes, rules(), PR.letters_tried, runtime, now)}
    if verb == "similar":
        return [tuple(r) for r in search.related_by_id(store.read(), words[0]).collect()]
    if verb == "search":
        asked = T.with_chunks(spark.createDataFrame([(" ".join(words),)], "text string"), "text", "chunks").select(F.lit("").alias("id"), "chunks")
        query = PR.letter_vectors(asked).withColumn("embedding", V.normalize(F.col("embedding")))
        return [tuple(r) for r in search.related(store.read(), query).collect()]
    if verb == "settings":
        patch = {k: json.loads(v) for k, _, v in (w.partition("=") for w in words)}
        patch = {k: tuple(v) if isinstance(v, list) else v for k, v in patch.items()}
        queued = lifecycle.save_settings(store, sync, **patch) if patch else False
        return {"settings": store.root()["settings"], "reindexed": queued}
    raise ValueError(f"no verb {verb}")


def main() -> None:
    parser = argparse.ArgumentParser(prog="nearfield", description=__doc__)
    parser.add_argument("verb", choices=["sync", "reindex", "similar", "search", "settings"])
    parser.add_argument("words", nargs="*")
    parser.add_argument("--store", required=True)
    parser.add_argument("--notes")
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    try:
        print(json.dumps(run(spark, args.verb, Store(spark, args.store), spark.read.parquet(args.notes) if args.notes else None, args.words), default=list, ensure_ascii=False))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
