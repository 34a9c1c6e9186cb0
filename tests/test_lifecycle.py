import pytest
from pyspark.sql import functions as F

from nearfield import __main__ as cli
from nearfield import benchmarks as B
from nearfield.operators import lifecycle as L
from nearfield.operators import prepare as PR
from nearfield.sources import sidecar
from nearfield.sources.store import SCHEMA, Store, normalized

NOTES = [("a.md", "A", "apples and pears"), ("b.md", "B", "bees"), ("skip/c.md", "C", "cats"), ("d.md", "D", "boom")]


@pytest.fixture
def notes(spark):
    return spark.createDataFrame(NOTES, "id string, title string, markdown string")


def candidates(notes):
    return notes.select("id", F.lit(1).cast("long").alias("modified_at"), F.lit(None).cast("int").alias("recent_open_rank"))


def index(spark, *rows):
    return spark.createDataFrame([(i, [1.0, 0.0], h, "old", k) for k, (i, h) in enumerate(rows)], SCHEMA)


def test_run_counts_failures_and_goes_on(spark, tmp_path, notes):
    def model():
        def embed(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("no boom")
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    store, runtime, seen = Store(spark, str(tmp_path / "s")), L.Runtime(), []
    rules = spark.createDataFrame([("skip",)], "rule string")
    store.rewrite(index(spark, ("gone.md", "h")))
    how = {"store": store, "notes": notes, "candidates": candidates(notes), "rules": rules, "embed": PR.tried_udf(model, attempts=1)}
    assert L.sync_with_progress(seen.append, runtime, **how) == {"indexed": 2, "deleted": 1}
    assert runtime.failed == 1 and runtime.completed and not runtime.running and store.settings().initial_index_completed
    assert {r["id"] for r in store.read().collect()} == {"a.md", "b.md"}
    assert seen[0]["phase"] == "scan" and seen[0]["total"] == 3
    again = L.sync(runtime=runtime, **how)
    assert again == {"indexed": 0, "deleted": 0} and runtime.failed == 1 and store.version() == 1  # the failing note is tried again
    runtime.unload()
    assert L.sync(runtime=runtime, **how) == {"indexed": 0, "deleted": 0}


def test_fatal_errors_are_kept(spark, tmp_path, notes):
    runtime = L.Runtime()
    with pytest.raises(Exception, match="nothing"):
        L.sync(Store(spark, str(tmp_path / "s")), notes, candidates(notes), spark.createDataFrame([], "rule string"), lambda c: F.struct(F.raise_error(F.lit("nothing")).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("error")), runtime)
    assert "nothing" in runtime.fatal and runtime.snapshot()["kind"] == "failed" and not runtime.completed


def test_start(spark, tmp_path, notes):
    runs = []
    run = lambda force=False: runs.append(force)
    store = Store(spark, str(tmp_path / "new"))
    assert L.bootstrap(store, run) == "synced" and runs == [False]
    store.update_settings(initial_index_completed=True)
    assert L.bootstrap(store, run) == "ready" and len(runs) == 1
    sidecar._put(spark, str(tmp_path / "old.json"), [b'{"schemaVersion": 1, "index": [{"id": "a.md", "embedding": [1.0, 0.0], "contentHash": "h", "updatedAt": "t"}]}'])
    moved = Store(spark, str(tmp_path / "moved"))
    assert L.bootstrap(moved, run, str(tmp_path / "old.json")) == "migrated" and [r["id"] for r in moved.read().collect()] == ["a.md"]
    moved.update(lambda root: root | {"version": 7})
    assert moved.needs_rebuild()
    assert L.bootstrap(moved, run) == "rebuilt" and runs[-1] is True and moved.is_empty()


def test_store(spark, tmp_path):
    now = [0.0]
    store = Store(spark, str(tmp_path / "s"), clock=lambda: now[0])
    assert store.is_empty() and store.version() == 0 and not store.tick()
    store.rewrite(index(spark, ("a.md", "h")))
    assert not store.is_empty() and store.version() == 0  # seen before it is written
    now[0] = 0.9
    store.rewrite(index(spark, ("b.md", "h")))
    assert not store.tick()
    now[0] = 1.0
    assert store.tick() and store.version() == 1 and [r["id"] for r in store.read().collect()] == ["b.md"]
    (tmp_path / "s" / "version=2").mkdir()  # a writer that died
    assert store.versions() == [1] and store.version() == 1
    (tmp_path / "s" / "data.json").unlink()
    assert store.version() == 1
    store.rewrite(index(spark, ("c.md", "h"), ("d.md", "h")))
    store.flush()
    store.flush()
    assert store.version() == 2 and store.read().count() == 2


def test_settings(spark, tmp_path, notes):
    store = Store(spark, str(tmp_path / "s"))
    assert store.update_settings(max_chunks=5).max_chunks == 5 and store.settings() == PR.Settings(max_chunks=5)
    with pytest.raises(ValueError, match="Max chunks"):
        store.update_settings(max_chunks=0)
    calls = []
    run = lambda force=False: calls.append(force)
    assert not L.save_settings(store, run, title_weight=1) and not calls
    store.rewrite(index(spark, ("a.md", "h")))
    assert L.save_settings(store, run, ignored_paths=("x",)) and calls == [True]
    odd = normalized({"settings": {"max_chunks": True, "title_weight": -1, "ignored_paths": ["a"], "advanced_open": "yes"}, "version": "x", "schemaVersion": 9})
    assert odd["settings"]["max_chunks"] == 32 and odd["settings"]["title_weight"] == 3 and odd["settings"]["ignored_paths"] == ["a"] and odd["settings"]["advanced_open"] is False
    assert odd["version"] == 0 and odd["schemaVersion"] == 2


def test_verbs(spark, tmp_path, notes):
    store = Store(spark, str(tmp_path / "s"))
    assert cli.run(spark, "sync", store, notes) == {"start": "synced", "indexed": 4, "deleted": 0, "failed": 0}
    assert cli.run(spark, "search", store, words=["apples", "and", "pears"])[0][0] == "a.md"
    assert {i for i, _ in cli.run(spark, "similar", store, words=["a.md"])} <= {"b.md", "skip/c.md", "d.md"}
    assert cli.run(spark, "settings", store, notes, ['ignored_paths=["skip"]'])["reindexed"] and store.read().count() == 3
    changed = notes.withColumn("markdown", F.concat("markdown", F.lit(" zzz")))
    assert cli.run(spark, "reindex", store, changed, ["a.md"]) == {"a.md": "indexed"}
    assert cli.run(spark, "reindex", store, changed, ["skip/c.md"]) == {"skip/c.md": "removed"}
    assert cli.run(spark, "reindex", store, changed, ["x.txt"]) == {"x.txt": "ignored"}


def test_timeouts():
    import time

    assert PR.within(5, lambda x: x + 1, 1) == 2 and PR.within(None, int, "3") == 3
    with pytest.raises(TimeoutError):
        PR.within(0.05, time.sleep, 5)
    with pytest.raises(ZeroDivisionError):
        PR.within(5, lambda: 1 / 0)


def test_measures(spark):
    calls = []
    got = B.measure(lambda: calls.append(1), iterations=3, warm_up=2)
    assert len(calls) == 5 and got["min"] <= got["median"] <= got["p95"] <= got["max"]
    assert B.summary([4, 1, 3, 2]) == {"mean": 2.5, "median": 2, "p95": 3, "min": 1, "max": 4} and B.summary([])["p95"] == 0
    assert B.ms(1.005) in ("1.00ms", "1.01ms") and B.kb(1536) == "1.5KB" and B.row([("a", 3), ("bc", 4)]) == "    a  bc"
    out = B.formats(spark, 20, 8, iterations=1, warm_up=0)
    assert out["vector_bytes"]["int8"] == 16 + 160 and out["bytes"]["sidecar"] < out["bytes"]["json"]
