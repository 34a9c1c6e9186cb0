import random

import pytest
from pyspark.sql import functions as F

from nearfield.streaming import changes as C


def test_debounce_batch_and_stream(spark, tmp_path):
    rows = [("a", 0.0), ("a", 1.0), ("a", 2.1), ("a", 4.0), ("b", 0.5), ("z", 100.0)]
    events = spark.createDataFrame(rows, "id string, s double").select("id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    batch = sorted(tuple(r) for r in C.debounce(events, "id", "ts").select("id", F.unix_millis("last_ts"), "n").collect())
    assert batch == [("a", 2100, 3), ("a", 4000, 1), ("b", 500, 1), ("z", 100000, 1)]
    events.write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = C.debounce_stream(feed, "id", "ts", "1100 milliseconds").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = sorted(tuple(r) for r in spark.table("closed").select("id", F.unix_millis("last_ts"), "n").collect())
    assert closed == [r for r in batch if r[0] != "z"]


def test_throttle(spark):
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 100, 999, 1000, 2500, 2600])], "id string, ms long, seq long")
    got = sorted(tuple(r) for r in C.throttle(df, "id", "ms", "seq").collect())
    assert got == [("k", 1000, 2), ("k", 2000, 3), ("k", 3500, 5)]


def test_changes(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    feed = spark.createDataFrame([("edit", "n", None, 1), ("rename", "x", "a", 2), ("delete", "b", None, 3), ("edit", "b", None, 4), ("delete", "n", None, 5)], "op string, id string, old_id string, seq long")
    assert sorted((r["id"], r["source_id"]) for r in C.apply_changes(ids, feed).collect()) == [("b", "b"), ("c", "c"), ("x", "a")]


def fold(ids, feed):
    """The feed one by one."""
    state = {i: (i, False, None) for i in ids}
    for op, new, old, seq in sorted(feed, key=lambda e: e[3]):
        if op in ("edit", "open"):
            state[new] = (new, True, seq)
        elif op == "delete":
            state.pop(new, None)
        elif old != new and old in state:
            state[new] = (*state.pop(old)[:2], seq)
    return sorted((i, *s) for i, s in state.items())


FEEDS = {
    "edit then delete": [("edit", "x", None, 1), ("delete", "x", None, 2)],
    "delete then edit": [("delete", "a", None, 1), ("edit", "a", None, 2)],
    "chain": [("rename", "b2", "a", 1), ("rename", "c2", "b2", 2), ("rename", "d2", "c2", 3)],
    "onto a live id": [("rename", "b", "a", 1)],
    "swap": [("rename", "t", "a", 1), ("rename", "a", "b", 2), ("rename", "b", "t", 3)],
    "of nothing": [("rename", "b", "gone", 1), ("rename", "b", "b", 2), ("delete", "gone", None, 3)],
    "edit then rename": [("edit", "a", None, 1), ("rename", "z", "a", 2), ("rename", "a", "nobody", 3)],
}


@pytest.mark.parametrize("name", FEEDS)
def test_feeds_in_order(spark, name):
    ids = ["a", "b", "c"]
    feed = spark.createDataFrame(FEEDS[name], "op string, id string, old_id string, seq long")
    got = C.outcomes(spark.createDataFrame([(i,) for i in ids], "id string"), feed).collect()
    assert sorted((r["id"], r["source_id"], r["edited"], r["seq"]) for r in got) == fold(ids, FEEDS[name])


def test_random_feeds(spark):
    r = random.Random(4)
    names = "abcdefgh"
    for _ in range(4):
        feed = [(r.choice(["edit", "delete", "rename", "rename", "open"]), r.choice(names), r.choice(names), k) for k in range(120)]
        df = spark.createDataFrame(feed, "op string, id string, old_id string, seq long")
        got = C.outcomes(spark.createDataFrame([(i,) for i in "abcx"], "id string"), df).collect()
        assert sorted((x["id"], x["source_id"], x["edited"], x["seq"]) for x in got) == fold("abcx", feed)


def test_batches_in_order(spark):
    columns = "id string, embedding array<double>, content_hash string, updated_at string, position long"
    index = spark.createDataFrame([(i, [float(k)], f"h{i}", "t", k) for k, i in enumerate("abcd")], columns)
    new = spark.createDataFrame([(i, [9.0], f"n{i}", "t", 0) for i in "abx"], columns)
    after = lambda feed: [(r["id"], r["content_hash"]) for r in C.apply_batch(index, spark.createDataFrame(feed, "op string, id string, old_id string, seq long"), new).orderBy("position").collect()]
    assert after([("edit", "x", None, 1), ("delete", "x", None, 2), ("edit", "b", None, 3)]) == [("a", "ha"), ("b", "nb"), ("c", "hc"), ("d", "hd")]
    assert after([("edit", "a", None, 1), ("rename", "z", "a", 2), ("edit", "x", None, 3), ("rename", "c", "d", 4)]) == [("b", "hb"), ("z", "na"), ("x", "nx"), ("c", "hd")]
    assert after([("delete", "a", None, 1), ("edit", "nowhere", None, 2)]) == [("b", "hb"), ("c", "hc"), ("d", "hd")]


def test_routes(spark):
    feed = spark.createDataFrame([("edit", "a.md", None, 1, True), ("edit", "a.txt", None, 2, True), ("open", "skip/b.md", None, 3, True), ("delete", "d", None, 4, True), ("edit", "folder.md", None, 5, False)], "op string, id string, old_id string, seq long, is_file boolean")
    got = C.routed(feed, spark.createDataFrame([("skip/",)], "rule string")).collect()
    assert sorted((x["op"], x["id"]) for x in got) == [("delete", "d"), ("delete", "skip/b.md"), ("edit", "a.md")]


def test_stream_of_changes(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "id string, seq long").write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("id string, seq long").parquet(str(tmp_path / "in"))
    seen = []
    q = C.run_stream(feed, lambda df, n: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted(seen) == ["a", "b"]
