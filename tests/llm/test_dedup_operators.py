import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import common, embdup, neardup, passages, quality, substrings
from nearfield.llm import words as W

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def vocabulary(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]


def corpus(seed=1, groups=6, copies=40):
    """Groups of near copies, exact copies, short and odd texts, and texts that share a passage."""
    r, words = random.Random(seed), vocabulary(3000)
    texts = []
    for g in range(groups):
        base = [r.choice(words) for _ in range(120)]
        for _ in range(copies if g < 2 else 4):
            t = list(base)
            for _ in range(r.randint(0, 7)):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
        texts += [" ".join(base)] * 3
    passage = " ".join(r.choice(words) for _ in range(70))
    texts += [" ".join([r.choice(words) for _ in range(80)] + [passage] + [r.choice(words) for _ in range(60)]) for _ in range(6)]
    texts += [" ".join(r.choice(words) for _ in range(150)) for _ in range(20)]
    texts += ["", "  \t", "One two", "one TWO", "one two three", None, "A b c d e", "é É " * 40, "x" * 5000, "ab " * 900]
    return list(enumerate(texts))


# --- words ---------------------------------------------------------------------------------------------
def test_words_are_split_alike(monkeypatch):
    texts = [t or "" for _, t in corpus()]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    h, start, first = W.words(data, at)
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    want = [WORD.findall(lower(t)) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    names = {}
    for word, x in zip([w for ws in want for w in ws], h.tolist(), strict=True):
        assert names.setdefault(word, x) == x
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr(W, "PIECE", 100)
    again = W.words(data, at)
    assert all((a == b).all() for a, b in zip((h, start, first), again, strict=True))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4100)] + [(1, 1)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {x["id"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top if any(x in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near-duplicates -----------------------------------------------------------------------------------
def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 400), (5, 80, 16)])
def test_near_duplicates(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BUCKET", 8)
    rows = corpus()
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), "doc_id", "text", k, percent)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute_components(rows, k, percent)


def test_near_duplicates_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    df = neardup.query(spark, DATA)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == brute_components(rows, 3, 85)


def test_large_buckets_that_a_representative_leaves_apart(spark, monkeypatch):
    """Texts of one template share buckets without being alike; in them are pairs that are."""
    monkeypatch.setattr(neardup, "BUCKET", 6)
    monkeypatch.setattr(neardup, "BLOCK", 10)
    r, words = random.Random(21), vocabulary(4000)
    frame, rows = [r.choice(words) for _ in range(90)], []
    for k in range(40):
        t = list(frame)
        for at in range(0, 90, 7):
            t[at] = r.choice(words)
        rows.append((3 * k, " ".join(t)))
        if k % 4 == 0:
            t[40] = r.choice(words)
            rows.append((3 * k + 1, " ".join(t)))
    seen = []
    monkeypatch.setattr(neardup, "_apart", lambda *a, f=neardup._apart: seen.append(f(*a)) or seen[-1])
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), "doc_id", "text", 3, 60)
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == brute_components(rows, 3, 60)
    assert seen and seen[0] is not None


def test_keep_one_keeps_different_texts_of_a_key(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, near, "p"), (1, "something else that is not alike at all", "p"), (2, near + " end", "q"), (None, near, "r"), (None, "only here and nowhere else in this table", "r"), (3, "", "s"), (4, None, "s"), (2, near + " end", "q")]
    df = spark.createDataFrame(rows, DOCS + ", source string")
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:9]) for r in neardup.keep_one(df, "doc_id", "text").collect())
    assert len(kept) == 5 and sum(t.startswith("a b c") for _, _, t in kept) == 1 and sum(t.startswith(("something", "only here")) for _, _, t in kept) == 2


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d"), (None, None), (7, "a b c d"), (7, "a b c d"), (5, "e f g h"), (7, "e f g h")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", component_id long, n_shingles long")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, "doc_id", "text", 3, 85).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (7, 2, 5, False), (7, 2, 5, False), (7, 2, 5, False), (None, 0, None, True), (None, 2, None, True)], key=str)
    assert neardup.keep_one(df, "doc_id", "text").select("doc_id").count() == 3
    assert neardup.near_duplicates(df.where("false"), "doc_id", "text").count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = neardup.least_matches(85)
    draws = np.random.default_rng(0).random((200_000, neardup.HASHES)) < 0.85
    kept = np.ones(len(draws), bool)
    for i, m in enumerate(least):
        kept &= draws[:, : (i + 1) * neardup.BATCH].sum(1) >= m
    assert kept.mean() > 0.999
    bands, rows = neardup.bands_for(85)
    assert (1 - 0.85**rows) ** bands <= 1e-5 and bands * rows <= neardup.HASHES


# --- vectors -------------------------------------------------------------------------------------------
def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embdup, "BLOCK", 16)
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 32))
    rows = [v for v in base] + [base[0] + 0.04 * r.normal(size=32) for _ in range(60)] + [base[k % 20] + 0.03 * r.normal(size=32) for k in range(60)] + [base[3] * 2, base[3], base[3]]
    data = [(k, v.tolist()) for k, v in enumerate(rows)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [float("inf")] + [1.0] * 31), (904, []), (None, base[0].tolist())]
    got = {x["vec_id"]: tuple(x)[1:] for x in embdup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding", tables=64).collect()}
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        label = np.where(linked, label[None, :], len(rows)).min(1)
    want = {k: (int(linked[k].sum()) - 1, int(label[k]), bool(label[k] == k)) for k in range(len(rows))}
    assert {k: v for k, v in got.items() if k is not None and k < 900} == want
    assert [got[k] for k in (900, 901, 902, 903, 904)] == [(0, k, True) for k in (900, 901, 902, 903, 904)] and got[None] == (0, None, True)
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embdup.near_vectors(none, "vec_id", "embedding").count() == 0


def test_wide_keys_lose_no_links(spark):
    r = np.random.default_rng(6)
    one, other = r.normal(size=(2, 600, 40))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    rows = np.concatenate([one, 0.9501 * one + np.sqrt(1 - 0.9501**2) * other])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {x["vec_id"]: x["component_id"] for x in embdup.near_vectors(df, "vec_id", "embedding", bits=24).collect()}
    assert all(got[k + 600] == got[k] == k for k in range(600))


def brute_links(rows):
    unit = np.array([v / np.linalg.norm(v) for v in rows])
    linked = unit @ unit.T >= 0.95
    label = np.arange(len(rows))
    while True:
        new = np.where(linked, label[None, :], len(rows)).min(1)
        if (new == label).all():
            return linked.sum(1) - 1, label
        label = new


@pytest.mark.parametrize(("bits", "apart"), [(None, 0), (20, 0), (24, 0), (None, 3)])
def test_links_against_brute_force(spark, bits, apart):
    """With the tables of production: near pairs from 0.95 up, groups, and vectors that are alone; also where all vectors lie one way."""
    r = np.random.default_rng(7)
    base = r.normal(size=(500, 64))
    base[:, 0] += 8 * np.sqrt(apart)
    near = base[r.integers(0, 300, 900)]
    noise = r.normal(size=near.shape)
    noise -= (noise * near).sum(1, keepdims=True) / (near * near).sum(1, keepdims=True) * near
    noise *= np.linalg.norm(near, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = r.uniform(0.95, 1, (900, 1))
    rows = np.concatenate([base, cosine * near + np.sqrt(1 - cosine**2) * noise]).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {x["vec_id"]: x for x in embdup.near_vectors(df, "vec_id", "embedding", bits=bits).collect()}
    links, label = brute_links(rows)
    assert links.sum() > 1000
    found = sum(got[k]["n_links"] for k in range(len(rows)))
    assert all(got[k]["n_links"] <= links[k] for k in range(len(rows))) and found >= 0.999 * links.sum()
    assert sum(got[k]["component_id"] == label[k] for k in range(len(rows))) >= 0.999 * len(rows)


def test_vectors_of_odd_sizes(spark):
    """Squares that over- or underflow, several lengths, repeated and null keys, and clashing names."""
    v = [1.0, 2.0, -3.0]
    rows = [(1, v), (2, [x * 1e-200 for x in v]), (3, [x * 1e200 for x in v]), (4, [*v, 0.0]), (5, [*v, 0.01]), (5, [*v, 0.01]), (6, [2 * x for x in v]), (None, v), (7, [5e-324, 1e-323, -1.5e-323])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n_links long, component_id long")
    got = sorted((tuple(x) for x in embdup.near_vectors(df, "vec_id", "embedding").collect()), key=str)
    assert [(x[0], x[2]) for x in got] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 1), (7, 1), (None, None)]


def test_tables_grow_with_bits():
    same = 1 - np.arccos(0.95) / np.pi
    missed = [(1 - same**bits) ** embdup.tables_for(bits, embdup.TABLES, embdup.COSINE) for bits in range(embdup.BITS, embdup.MOST_BITS + 1)]
    assert embdup.tables_for(embdup.BITS, embdup.TABLES, embdup.COSINE) == embdup.TABLES and max(missed) <= missed[0] * 1.0001 < 2e-6


def test_codes_are_balanced_and_near():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 16)) @ r.normal(size=(16, 16))
    p = embdup.rotation(x, 16, 0)
    z = x @ p
    start = x @ embdup.rotation(x, 16, 0, iterations=0)
    loss = lambda z: ((np.where(z >= 0, 1, -1) - z) ** 2).sum()
    assert loss(z) < loss(start) and np.allclose(p.T @ p, np.eye(16))


# --- substrings ----------------------------------------------------------------------------------------
def brute_removed(rows, length):
    seen = {}
    for i, t in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    gone = [np.zeros(len((t or "").encode()) + 1, bool) for t in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = True
    out = []
    for t, g in zip(rows, gone, strict=True):
        b = (t or "").encode()
        kept = bytes(x for x, dead in zip(b, g, strict=False) if not dead)
        out.append((len(b), int(g.sum()), int((g[:-1] & ~np.append(False, g[:-2])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "run"), [(20_000, 32 << 20), (3, 32 << 20), (20_000, 3000)])
def test_remove_repeats(spark, monkeypatch, hot, run):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "RUN", run)
    texts = [t for _, t in corpus(copies=12)] + ["é" * 45, "ü" + "é" * 45, "abc" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = [tuple(r)[1:] for r in substrings.remove_repeats(df, "doc_id", "text", 90, 24).orderBy("doc_id").collect()]
    assert got == brute_removed(texts, 90)


def test_substrings_query_against_brute_force(spark):
    """All documents at 400 bytes and production parameters: bytes under strings that start elsewhere too."""
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    seen: dict = {}
    for k, (_, b) in enumerate(rows):
        for p in range(len(b) - 399):
            seen.setdefault(hash(b[p : p + 400]), []).append((k, p))
    gone = [np.zeros(len(b) + 1, bool) for _, b in rows]
    for held in seen.values():
        if len(held) > 1:
            for k, p in held:
                gone[k][p : p + 400] = True
    want = {}
    for (doc, b), g in zip(rows, gone, strict=True):
        spans = int((g[:-1] & ~np.append(False, g[:-2])).sum()) if b else 0
        want[doc] = (len(b), int(g.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~g[:-1]].tobytes()).hexdigest())
    df = substrings.query(spark, DATA)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == want and sum(w[1] > 0 for w in want.values()) > 10


def test_windows_of_equal_hashes_are_compared_by_bytes(spark):
    """Two stretches of 16 letters that the rolling hash can't tell apart: texts around them repeat nothing, unless a third has one of them, too."""
    one, other = "m" * 16, "oqqqqkiluqjojyij"
    assert substrings.rolling(np.frombuffer(one.encode(), np.uint8), 16, substrings._powers(16)) == substrings.rolling(np.frombuffer(other.encode(), np.uint8), 16, substrings._powers(16))
    r = random.Random(1)
    texts = []
    for k in range(8):
        left, right = ("".join(r.choice("abcdefgh ") for _ in range(340)) for _ in range(2))
        texts += [left + one + right, left + other + right] + ["x" + left[50:] + one + right[:200]] * (k % 2)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = [tuple(x)[1:] for x in substrings.remove_repeats(df, "doc_id", "text").orderBy("doc_id").collect()]
    assert got == brute_removed(texts, 400) and sum(g[1] > 0 for g in got) == 8


def test_remove_repeats_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "y" * 500, 1), (None, None, 2), (3, "", 3), (3, "q" * 399, 4)], DOCS + ", n_bytes long")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substrings.remove_repeats(df, "doc_id", "text").collect())
    assert got == [(0, 0, 0), (0, 0, 0), (399, 0, 0), (500, 500, 1)]
    assert substrings.remove_repeats(df.where("false"), "doc_id", "text").count() == 0


def test_loser_tree():
    r = random.Random(2)
    names = ["".join(r.choice("ab") for _ in range(r.randint(1, 12))).encode() for _ in range(400)]
    for ways in (1, 2, 3, 7, 16):
        parts = [sorted(names[k::ways]) for k in range(ways)]
        runs = [substrings.read_run(substrings.write_run([(s, b"", [(b"0" * 16, 1)]) for s in p])) for p in parts]
        merged = list(substrings.merge_runs(runs))
        assert [m[1] for m in merged] == sorted(names)
        before = b""
        for shared, suffix, _, _ in merged:
            assert shared == substrings.common_prefix(before, suffix)
            before = suffix


def test_anchors_are_chosen_wherever_chunks_end(monkeypatch):
    r = random.Random(10)
    raw = ["".join(r.choice("abcdefgh") for _ in range(n)).encode() for n in (170, 2000, 1300)]
    monkeypatch.setattr(substrings, "CHUNK", 300)
    text, h, anchor = substrings.places(raw, 90, 24)
    for k, t in enumerate(raw):
        hashes, _, first, last = substrings.suffixes(t, anchor[text == k], 90, 24)
        windows = [i for a, b in zip(first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1)]
        assert windows == list(range(len(t) - 89)) and set(hashes.tolist()) == set(h[text == k].tolist())


# --- passages ------------------------------------------------------------------------------------------
def test_compact_windows():
    r = np.random.default_rng(0)
    x = r.integers(0, 50, 200).astype(np.uint64)
    left, pivot, right = passages.compact_windows(x, np.array([0, 120]), np.array([120, 200]), 10)
    windows = list(zip(left.tolist(), pivot.tolist(), right.tolist(), strict=True))
    for low, high in ((0, 120), (120, 200)):
        for a in range(low, high):
            for b in range(a + 9, high):
                holds = [c for p, c, q in windows if p <= a <= c <= b <= q]
                assert len(holds) == 1 and x[holds[0]] == x[a : b + 1].min()


def test_near_passages(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in passages.near_passages(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", kept long"), "doc_id", "text").collect()}
    words = {i: WORD.findall((t or "").lower()) for i, t in rows}
    holders: dict = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            holders.setdefault(tuple(w[k : k + 50]), set()).add(i)
    for span, ids in holders.items():
        if len(ids) > 1:
            assert len({got[i]["component_id"] for i in ids}) == 1, span[:3]
            assert all(got[i]["n_passages"] for i in ids)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    for i, r in got.items():
        if r["n_passages"]:
            assert any(j != i and len(sets[i] & sets[j]) >= 30 for j in sets)
        else:
            assert r["component_id"] == i and r["kept"]
    assert passages.near_passages(spark.createDataFrame([], DOCS), "doc_id", "text").count() == 0


def edited(r, words, times):
    """words with as many replaced, inserted or deleted, but not at the ends."""
    out = list(words)
    for _ in range(times):
        at, how = r.randrange(1, len(out) - 1), r.randrange(3)
        out[at : at + (how != 1)] = [] if how == 2 else [f"other{r.random()}"]
    return out


def shingles_of(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def alike(one, other):
    one, other = shingles_of(one), shingles_of(other)
    return len(one & other) / len(one | other)


def test_alignment_follows_edits():
    r = random.Random(8)
    held = lambda words: passages.tokens(np.array([zlib.crc32(w.encode()) for w in words], np.uint64))
    fresh = lambda n: [f"w{r.random()}" for _ in range(n)]
    near = 0
    for k in range(300):
        one = fresh(r.choice([50, 55, 60, 80, 92]))
        other = edited(r, one, 1 + k % 5)
        x, y = held(fresh(40) + one + fresh(40)), held(fresh(25) + other + fresh(60))
        both = np.intersect1d(x, y)
        if not len(both):
            continue
        token = r.choice(both.tolist())
        c, d = int(np.flatnonzero(x == token)[0]), int(np.flatnonzero(y == token)[0])
        rows = np.zeros((1, 185), np.uint64), np.ones((1, 185), np.uint64)
        for row, v, at in ((rows[0], x, c), (rows[1], y, d)):
            low, high = max(0, at - 92), min(len(v), at + 93)
            row[0, low - at + 92 : high - at + 92] = v[low:high]
        row, a, b, p, q = passages.aligned(*rows, 46, 80)
        for a, b, p, q in zip(a + c - 92, b + c - 92, p + d - 92, q + d - 92, strict=True):
            sx, sy = set(x[a:b].tolist()), set(y[p:q].tolist())
            assert b - a >= 46 and q - p >= 46 and len(sx & sy) >= 0.8 * len(sx | sy)
        if alike(one, other) >= 0.8 and min(len(one), len(other)) >= 50:
            near += 1
            assert len(row)
    assert near > 60


def test_near_passages_are_found(spark):
    """Recall of passages at 0.8 and above; half of them hold one of three lines that hundreds of texts have."""
    r = random.Random(9)
    fresh = lambda n: [f"w{r.randrange(1 << 40)}" for _ in range(n)]
    lines, rows = [fresh(20) for _ in range(3)], []
    while len(rows) < 1200:
        one = fresh(r.choice([50, 55, 60, 80, 120]))
        if r.random() < 0.5:
            at = r.randrange(len(one) - 20)
            one[at : at + 20] = r.choice(lines)
        other = edited(r, one, r.randint(1, 4))
        if alike(one, other) >= 0.8 and len(other) >= 50:
            rows += [(len(rows), " ".join(fresh(40) + one + fresh(30))), (len(rows) + 1, " ".join(fresh(20) + other + fresh(50)))]
    got = {x["doc_id"]: x for x in passages.near_passages(spark.createDataFrame(rows, DOCS), "doc_id", "text").collect()}
    assert all(got[i]["component_id"] in (i, i - i % 2) for i in got)
    assert sum(got[i]["n_passages"] > 0 and got[i]["component_id"] == i - 1 for i in got if i % 2) >= 0.97 * 600


def test_runs_that_near_passages_share():
    r = random.Random(10)
    longest = passages.run_of(46, 80)
    assert longest == 19 and passages.run_of(46, 100) == 46
    for _ in range(300):
        one = [f"w{r.random()}" for _ in range(r.choice([50, 52, 70, 120, 200]))]
        other = edited(r, one, r.randint(1, 5))
        if alike(one, other) >= 0.8 and len(other) >= 50:
            held = {tuple(other[k : k + longest + 4]) for k in range(len(other))}
            assert any(tuple(one[k : k + longest + 4]) in held for k in range(len(one) - longest - 3))


def test_no_near_passage_is_lost(spark):
    """Pairs at 0.8 and above; those of the second half share their only run with a line that all of them have."""
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(1 << 40)}" for _ in range(n)]
    line, rows = fresh(22), []
    while len(rows) < 3000:
        if len(rows) < 2400:
            one = fresh(60)
            other = list(one)
            other[r.randrange(5, 55)] = "other"
        else:
            one = fresh(16) + ["one"] + fresh(12) + line
            other = one[:16] + ["other"] + one[17:]
        assert alike(one, other) >= 0.8
        rows += [(len(rows), " ".join(fresh(30) + one + fresh(30))), (len(rows) + 1, " ".join(fresh(20) + other + fresh(40)))]
    got = {x["doc_id"]: x for x in passages.near_passages(spark.createDataFrame(rows, DOCS), "doc_id", "text").collect()}
    assert [i for i in got if got[i]["component_id"] != i - i % 2 or not got[i]["n_passages"]] == []


def test_unlike_surroundings_of_a_line_give_no_pairs():
    """A line and, far from it, another that all have don't make candidates; near passages around the line do."""
    r = random.Random(12)
    half, line, far = 92, list(range(1, 31)), list(range(31, 61))
    fresh = lambda n: [r.randrange(1 << 20, 1 << 60) for _ in range(n)]
    rows = [fresh(half) + line + fresh(25) + far + fresh(half - 84) for _ in range(400)]
    for k in range(0, 40, 2):  # 46 tokens at 0.8: 41 of them in common
        rows[k + 1][half - 16 : half - 5] = rows[k][half - 16 : half - 5]
    x = np.array(rows, np.uint64)
    none, names = np.zeros(400, np.int64), np.arange(400)
    for side, across in ((none, False), (names % 2, True)):
        first, of, pairs = passages.candidates(x, names, none, side, across, 46, 80)
        got = {tuple(sorted(p)) for p in first[pairs].tolist()}
        assert got == {(k, k + 1) for k in range(0, 40, 2)}
    m, o = first[pairs].T
    assert len(passages.aligned(x[m], x[o], 46, 80)[0]) == 20
    first, of, pairs = passages.candidates(np.concatenate([x, x]), np.concatenate([names, names]), np.zeros(800, np.int64), np.zeros(800, np.int64), False, 46, 80)
    assert len(first) == 400 and (of[:400] == of[400:]).all() and len(pairs) == 20


def test_blocks_of_a_large_group_lose_nothing(spark, monkeypatch):
    r = random.Random(13)
    fresh = lambda n: [f"w{r.randrange(1 << 40)}" for _ in range(n)]
    line, rows = fresh(22), []
    for k in range(0, 300, 2):
        one = fresh(16) + ["one"] + fresh(12) + line
        other = one[:16] + ["other"] + one[17:]
        rows += [(k, " ".join(fresh(30) + one + fresh(30))), (k + 1, " ".join(fresh(20) + other + fresh(40)))]
    found = []
    for block in (2048, 40):
        monkeypatch.setattr(passages, "BLOCK", block)
        found.append(sorted(passages.near_passages(spark.createDataFrame(rows, DOCS), "doc_id", "text").collect()))
    assert found[0] == found[1]
    assert all(x["component_id"] == x["doc_id"] - x["doc_id"] % 2 and x["n_passages"] for x in found[1])


def test_passages_of_texts_that_another_links(spark):
    """Near passages around a line that all have are found, too, if the two texts share something else as well."""
    r = random.Random(14)
    fresh = lambda n: [f"w{r.randrange(1 << 40)}" for _ in range(n)]
    line, rows = fresh(44), []  # a word short of a passage by itself
    for k in range(0, 300, 2):
        one, copied = fresh(16) + line, fresh(60)
        other = one[:15] + fresh(1) + line
        rows += [(k, " ".join(fresh(30) + one + fresh(130) + copied)), (k + 1, " ".join(copied + fresh(130) + other + fresh(40)))]
    got = spark.createDataFrame(rows, DOCS)
    got = passages.near_passages(got, "doc_id", "text").collect()
    assert [x["doc_id"] for x in got if x["n_passages"] != 2 or x["n_words"] < 60 + 50] == []
    assert all(x["component_id"] == x["doc_id"] - x["doc_id"] % 2 for x in got)


def repeated_words(rows, size=50):
    """Which words of each text lie in a part of ``size`` words that another row has too, and the holders of each such part."""
    words = {i: WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for i, t in rows}
    holders: dict = {}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            holders.setdefault(tuple(w[k : k + size]), []).append((i, k))
    marked = {i: [False] * len(w) for i, w in words.items()}
    groups = [held for held in holders.values() if len({i for i, _ in held}) > 1]
    for held in groups:
        for i, k in held:
            marked[i][k : k + size] = [True] * size
    return marked, groups


def test_passages_query_against_brute_force(spark):
    """Every repeated run of 50 words is found whole, and the rows are the same whatever the partitions."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    marked, groups = repeated_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(groups) > 100
    got = passages.query(spark, DATA).collect()
    by = {r["doc_id"]: r for r in got}
    for held in groups:
        assert len({by[i]["component_id"] for i, _ in held}) == 1
    for i, marks in marked.items():
        covered = [False] * len(marks)
        for p in by[i]["passages"]:
            covered[p["first"] : p["first"] + p["words"]] = [True] * p["words"]
        assert all(c or not m for c, m in zip(covered, marks, strict=True)) and by[i]["n_words"] == sum(covered)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        again = passages.near_passages(docs.repartition(7), "doc_id", "text").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_passages_of_odd_rows(spark):
    r = random.Random(12)
    shared_part = " ".join(f"w{r.random()}" for _ in range(60))
    rows = [(None, shared_part + " a"), (4, shared_part + " b"), (4, "short"), (9, shared_part + " c"), (9, shared_part + " c"), (None, None), (1, ""), (2, "a " * 3000), (3, "a " * 2000)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], DOCS + ", n_words long, component_id long")
    got = sorted(((x["doc_id"], x["n_passages"], x["n_words"], x["component_id"], x["kept"]) for x in passages.near_passages(df, "doc_id", "text").collect()), key=str)
    want = [(None, 1, 60, None, True), (4, 1, 60, 4, True), (4, 0, 0, 4, True), (9, 1, 61, 4, False), (9, 1, 61, 4, False), (None, 0, 0, None, True), (1, 0, 0, 1, True), (2, 1, 3000, 2, True), (3, 1, 2000, 2, False)]
    assert got == sorted(want, key=str)


# --- quality -------------------------------------------------------------------------------------------
def test_quality(spark):
    r, words = random.Random(4), vocabulary(400)
    good = lambda: " ".join(r.choice(words) for _ in range(r.randint(5, 200))).capitalize() + "."
    bad = lambda: r.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: (t.split()[0] + " ") * 60])(good())
    rows = [(k, bad() if k % 5 == 1 else good(), 0 if k % 5 == 1 else 1) for k in range(900)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(None, None), (5000, ""), (5001, "x" * 100_000)], DOCS)
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows] + [(None, 1), (17, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    got = {s["doc_id"]: s["score"] for s in quality.score(docs, model, "text").collect()}
    assert len(got) == 903 and all(0 <= s <= 1 for s in got.values())
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert sum((got[x[0]] >= 0.3) == bool(x[2]) for x in held) >= 0.98 * len(held)
    assert quality.score(docs.where("false"), model, "text").count() == 0
    marked = {x["doc_id"] for x in docs.where(quality.held_out(docs["doc_id"])).collect()}
    assert {x[0] for x in held} <= marked


def test_quality_query(spark):
    """Held-out accuracy at production parameters; the labels of held-out rows, and what isn't text, change no score."""
    data = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.query(spark, data).collect()}
    assert list(next(iter(got.values())).asDict()) == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = spark.read.parquet(f"{data}/labels.parquet")
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 40 and sum(r["predicted"] == q for r, q in held) >= 0.95 * len(held)
    good, bad = ([r["score"] for r, q in held if q == v] for v in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    learned = labels.where(~quality.held_out(labels["doc_id"]))
    assert quality.train(docs, learned, "doc_id", "text", "quality").cut == quality.train(docs, labels, "doc_id", "text", "quality").cut
    twice = docs.union(docs.limit(300))
    assert np.allclose(quality.train(twice, labels.union(labels), "doc_id", "text", "quality").weights, quality.train(docs, labels, "doc_id", "text", "quality").weights)


def test_quality_keeps_other_columns(spark):
    model = quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0, int))
    df = spark.createDataFrame([(1, None, 5.0, "x"), (1, "", 5.0, "x")], DOCS + ", score double, __id string")
    assert quality.score(df, model, "text").columns == ["doc_id", "text", "__id", "score"] and quality.score(df, model, "text").count() == 2


def test_quality_without_both_labels():
    assert quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0, int)).score(np.zeros((1, len(quality.NAMES))))[0] == pytest.approx(0.3)
    only = quality.fit(np.ones((3, len(quality.NAMES))), np.ones(3, int))
    assert (only.score(np.ones((2, len(quality.NAMES)))) >= 0.3).all()


def test_quality_learns_from_every_labelled_row(spark):
    """A kind of bad text that only a few of many labelled rows have is learned, and training by parts is training at once."""
    r = np.random.default_rng(3)
    y = (r.random(30_000) > 0.3).astype(int)
    x = r.random((len(y), len(quality.NAMES))) + 0.1 * y[:, None]
    rare = slice(0, len(y), 3000)
    y[rare], x[rare], x[1::3000, 5] = 0, x[rare] + 0.1, 9.0
    whole = quality.fit(x, y)
    cuts = [0, 10, 7000, 19_000, len(y)]
    parts = quality.learn(lambda f: [f(x[a:b], y[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
    assert np.allclose(parts.weights, whole.weights, atol=1e-6) and abs(parts.cut - whole.cut) < 1e-6
    z = (quality.expand(x) - quality.expand(x).mean(0)) / quality.expand(x).std(0)
    assert np.allclose(whole.mean, quality.expand(x).mean(0)) and np.allclose(whole.spread, quality.expand(x).std(0))
    # the slope of the mean loss of all pairs is none there
    s, total = z @ whole.weights, quality.RIDGE * whole.weights
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for low in range(0, len(good), 500):
        p = 1 / (1 + np.exp(s[good[low : low + 500], None] - s[None, bad]))
        total = total - (z[good[low : low + 500]].T @ p.sum(1) - z[bad].T @ p.sum(0)) / len(good) / len(bad)
    assert np.abs(total).max() < 1e-4


def test_quality_counts_more_rows_than_a_part(spark, monkeypatch):
    """The last of many labelled rows count as the first do."""
    monkeypatch.setattr(quality, "ROWS", 40)
    rows = [(k, ("good words here. " if k % 2 else "BAD | TEXT ") * (1 + k % 7), k % 2) for k in range(300)]
    docs = spark.createDataFrame([x[:2] for x in rows], DOCS)
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    seen = []
    learn = quality.learn
    monkeypatch.setattr(quality, "learn", lambda each, threshold: seen.append(each(lambda x, y: len(y))) or learn(each, threshold))
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    assert sum(seen[0]) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(300)) and len(seen[0]) > 1
    assert all((r["score"] >= 0.3) == r["doc_id"] % 2 for r in quality.score(docs, model, "text").collect())


# --- pipeline ------------------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "pii", "mixing", "packing"]
    kept = corpus_pipeline.quality_filter(spark, docs, data).cache()
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert sum((i in left) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    single = corpus_pipeline.near_dedup(spark, kept, data).cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert {r["doc_id"] for r in single.collect()} == {i for i, v in brute_components(rows, 5, 80).items() if v[2]}
    clear = corpus_pipeline.surrogates(spark, single, data).cache()
    assert clear.columns == docs.columns and clear.count() == single.count()
    token = re.compile(r"[0-9a-f]{40}|\S+@\S+")
    before = {t for r in single.collect() for t in token.findall(r["text"])}
    assert not before & {t for r in clear.collect() for t in token.findall(r["text"])}
    mixed = corpus_pipeline.mix(spark, clear, data).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clear.collect()}
    packed = corpus_pipeline.pack(spark, mixed, data)
    assert packed.where("piece = 0").count() == mixed.count()


def test_released_lets_go_of_finished_shuffles(spark):
    def live():
        shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
        return {*shuffles.keySet().mkString(",").split(",")} - {""}

    before = live()
    kept = [common.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()) for _ in range(3)]
    made = live() - before
    assert made
    common.released(spark)
    end = time.time() + 10
    while live() & made and time.time() < end:
        time.sleep(0.1)
    assert not live() & made
    assert [df.count() for df in kept] == [7] * 3
