
from nearfield.operators import paths as P
from nearfield.operators import prepare as PR
from nearfield.operators import queue as Q
from nearfield.operators import stats, sync


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def listed(df):
    return sorted(r["id"] for r in df.collect())


def test_reconcile(spark):
    a, b = ids(spark, "x", "y", "x"), ids(spark, "y", "z", "z", "z")
    assert listed(sync.to_add(a, b)) == ["x"] and listed(sync.to_remove(a, b)) == ["z"]
    assert listed(sync.duplicates(b)) == ["z", "z"]
    actions = sorted(tuple(r) for r in sync.sync_actions(a, b).collect())
    assert actions == [("add", "x"), ("add", "z"), ("add", "z"), ("remove", "z"), ("remove", "z"), ("remove", "z")]


def test_plan(spark):
    c = spark.createDataFrame([("a.md", 5, None), ("b.md", 9, None), ("c.md", 1, 0), ("skip/d.md", 1, 1)], "id string, modified_at long, recent_open_rank int")
    rules = spark.createDataFrame([("skip/",)], "rule string")
    plan = sync.sync_plan(c, ids(spark, "gone.md", "a.md"), ids(spark, "b.md", "old.md"), rules)
    got = sorted((r["action"], r["id"], r["seq"]) for r in plan.collect())
    assert got == [("remove_from_index", "gone.md", None), ("remove_from_queue", "old.md", None), ("seed", "b.md", 1), ("seed", "c.md", 0)]
    forced = sync.sync_plan(c, ids(spark, "a.md"), ids(spark), rules, force=True).where("action = 'seed'").orderBy("seq")
    assert [r["id"] for r in forced.collect()] == ["c.md", "b.md", "a.md"]


def test_queue(spark):
    events = spark.createDataFrame([("a", "seed", 1), ("b", "edit", 2), ("a", "edit", 3), ("c", "manual", 4), ("d", "seed", 5), ("e", "seed", 6), ("b", "open", 7)], "id string, reason string, seq long")
    q = Q.bump(events)
    assert [r["id"] for r in Q.drain_order(q).orderBy("place").collect()] == ["c", "a", "b", "d", "e"]
    assert tuple(Q.next_note(q).first()) == ("c", "manual")
    seeds = spark.createDataFrame([("a", 0), ("n", 1), ("n", 2), ("d", 3)], "id string, seq long")
    merged = Q.drain_order(Q.merge_seeds(q, seeds)).orderBy("place").collect()
    assert [r["id"] for r in merged] == ["c", "a", "b", "n", "d"]
    assert listed(Q.remove(q, ids(spark, "a", "zz"))) == ["b", "c", "d", "e"]


def test_ignored_and_links(spark):
    rules = spark.createDataFrame([("a",), ("b/c/",), ("",), ("\\x\\y.md",)], "rule string")
    notes = ids(spark, "a/n.md", "ab/n.md", "b/c.md", "b/c/d/e.md", "x/y.md", "A/n.md")
    assert listed(P.ignored(notes, rules)) == ["a/n.md", "b/c/d/e.md", "x/y.md"]
    assert listed(P.ignored(notes, rules, keep=True)) == ["A/n.md", "ab/n.md", "b/c.md"]
    links = {r["id"]: r["link"] for r in P.wikilinks(ids(spark, "test.md", "dir/other.md", "x/dup.md", "dup.MD")).collect()}
    assert links == {"test.md": "[[test]]", "dir/other.md": "[[other]]", "x/dup.md": "[[x/dup]]", "dup.MD": "[[dup]]"}


def test_prepare(spark):
    notes = spark.createDataFrame([("a", "T", "word " * 30), ("b", "T", "   "), ("c", "T", "-- !!"), ("d", "", "x" * 25000)], "id string, title string, markdown string")
    got = {r["id"]: r for r in PR.prepare(ids(spark, "a", "b", "c", "d", "z"), notes).collect()}
    assert got["a"]["prepared_text"].startswith("T T T word word") and got["a"]["warnings"] == []
    assert [got[i]["reason"] for i in "abcdz"] == [None, "empty-content", "non-semantic-content", None, "missing-note"]
    assert got["d"]["warnings"] == ["raw-markdown-truncated", "prepared-text-truncated", "chunk-limit-reached"] and len(got["d"]["chunks"]) == 32


def test_a_null_text_is_no_missing_note(spark):
    notes = spark.createDataFrame([("a", "T", None), ("b", "T", "!!")], "id string, title string, markdown string")
    got = {r["id"]: r for r in PR.prepare(ids(spark, "a", "b", "z"), notes, rejected_text=True).collect()}
    assert [got[i]["reason"] for i in "abz"] == ["empty-content", "non-semantic-content", "missing-note"]
    assert [got[i]["prepared_text"] for i in "abz"] == [None, "T T T !!", None] and all(r["chunks"] is None for r in got.values())
    assert all(r["prepared_text"] is None for r in PR.prepare(ids(spark, "a", "b", "z"), notes).collect())


def test_embedder_and_pool(spark):
    calls = []

    def load():
        def model(texts):
            calls.append(1)
            if len(calls) == 1:
                raise RuntimeError("once")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    df = spark.createDataFrame([("a", ["xx", "xxxx"]), ("b", ["x", " "])], "id string, chunks array<string>").coalesce(1)
    got = {r["id"]: r["embedding"] for r in PR.embed_chunks(df, PR.embed_udf(load)).collect()}
    assert got == {"a": [3.0, 1.0], "b": [1.0, 1.0]}


def test_summaries(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 3, 2, 4)] + [("b", None)], "g string, v double")
    r = stats.summarize(df, "g", "v").first()
    assert (r["mean"], r["min"], r["max"], r["median"], r["p95"]) == (3, 1, 5, 3, 4)


def test_banner(spark):
    rows = spark.createDataFrame([(None, True, False, 0, 1, 8), (None, True, False, 0, 1, 7), ("x", False, True, 0, 0, 0)], "fatal_error string, is_running boolean, completed boolean, pending int, processed int, total int")
    got = [(r["kind"], r["visible"], r["progress_label"]) for r in Q.banner(rows).collect()]
    assert got == [("initial", True, "1 / 8"), ("initial", False, "1 / 7"), ("failed", True, None)]
