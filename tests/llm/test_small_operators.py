import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import embdup, media, mixing, neardup, packing, pii, sharding

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# --- sharding ------------------------------------------------------------------------------------------
def test_fill_is_even_and_stable():
    names = [f"s{k}" for k in range(7)]
    full = sharding.fill(names, 1009)
    assert np.ptp(np.bincount(full)) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, fewer, strict=True) if a != 6)
    assert moved < 0.15 * 1009
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.fill(bad, 1009)
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_place(spark):
    df = spark.createDataFrame([(1, "x", "old"), (1, "x", "old"), (None, None, None)], "doc_id long, slot string, shard string")
    got = sharding.place(df, "doc_id", ["a", "b"], 101).collect()
    assert len(got) == 3 and got[0] == got[1] and {r["shard"] for r in got} <= {"a", "b"}
    assert sharding.place(empty(spark), "doc_id", ["a"], 101).count() == 0


def test_write_shards(spark, tmp_path):
    placed = sharding.place(spark.range(100), "id", ["a", "b", "c"], 101)
    sharding.write_shards(placed, str(tmp_path / "out"), rows_each=10)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


# --- packing -------------------------------------------------------------------------------------------
def test_encoder_agrees_with_tokenizers():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = packing.encoder(path)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()]
    texts += ["", " ", "  a  b\n\n c\t", "I'll we've 'tis <|endoftext|>", "日本語 😀 ½ Ⅷ", "a b  c", "x" * 3000, "\x00\x1f", "\r\n \r\n"]
    assert [encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["end <|endoftext|> start", "<|endoftext|>", "a  <|endoftext|>  b\n", "<|endoftext|><|endoftext|>x", "<|endoftext |> <|ENDOFTEXT|>", "  a  b\n\n c\t", ""]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' LIMIT 50").fetchall()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["__key"]: r["ids"] for r in packing.pieces(df, "doc_id", "text", capacity=1 << 20, ids=True).collect()}
    assert got == {k: [*e.ids, 0] for k, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=20))
def test_runs_are_best_fit(counts):
    many = sum(counts.values())
    plan, missing, left = packing.best_fit_runs(counts, [(64, 0, many)] if many else [], 64)
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(64 - length)
    used = set()
    for length, n in counts.items():
        runs = plan[length]
        for rank in range(n):
            r = runs[np.searchsorted(runs[:, 0], rank, "right") - 1]
            j = rank - r[0]
            seq, at = int(r[1] + j // r[3]), int(r[2] + j % r[3] * length)
            cells = {(seq, c) for c in range(at, at + length)}
            assert not cells & used and at + length <= 64
            used |= cells
    opened = {s for s, _ in used}
    assert len(opened) == len(gaps) and not missing
    for seq in opened:
        mine = sorted(c for s, c in used if s == seq)
        assert mine == list(range(len(mine)))
    assert sorted(g for size, _, n in left for g in [size] * n) == sorted(g for g in gaps + [64] * (many - len(gaps)) if g)


def test_pieces_without_a_gap_are_left():
    plan, missing, left = packing.best_fit_runs({30: 3, 20: 2}, [(64, 5, 1), (25, 9, 1)], 64)
    assert missing == {30: 1, 20: 1} and plan[30].tolist() == [[0, 5, 0, 2]] and plan[20].tolist() == [[0, 9, 39, 1]] and sorted(left) == [(4, 5, 1), (5, 9, 1)]


def sequences_are_gapless(pieces, capacity=2048):
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= capacity
    return len(by)


@pytest.mark.parametrize("rows_each", [20_000, 60])
def test_pack_in_rounds(spark, rows_each):
    """Many salts leave many pieces to later rounds; ties and repeated rows are placed one by one."""
    r = np.random.default_rng(3)
    rows = [(k, "a " * int(n), "s") for k, n in enumerate([*r.integers(1, 2040, 400), *[700] * 50, *[1500] * 40])] + [(9999, "b", "s")] * 30
    got = packing.pack(spark.createDataFrame(rows, DOCS), "doc_id", "text", rows_each=rows_each).collect()
    assert len(got) == len(rows)
    lengths, counts = np.unique([p["length"] for p in got], return_counts=True)
    plan, _, left = packing.best_fit_runs(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), [(2048, 0, len(got))])
    at_once = len(got) - sum(n for size, _, n in left if size == 2048)
    assert sequences_are_gapless(got) <= 1.03 * at_once


def test_packing_query(spark):
    """All documents' ids are the library's, their pieces add up, and the sequences are as few as can be."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    got = packing.query(spark, DATA)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = got.collect()
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    assert set(by) == {d for d, _ in docs}
    for (doc, _), e in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False), strict=True):
        ids, mine = np.array([*e.ids, 0], "<u4"), sorted(by[doc], key=lambda p: p["piece"])
        assert [p["piece"] for p in mine] == list(range(len(mine))) and sum(p["length"] for p in mine) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in mine)
    lengths, counts = np.unique([p["length"] for p in pieces], return_counts=True)
    _, _, left = packing.best_fit_runs(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), [(2048, 0, len(pieces))])
    assert sequences_are_gapless(pieces) == len(pieces) - sum(n for size, _, n in left if size == 2048)  # best fit at once, the longest first


def test_pack(spark):
    rows = [(1, "a b c " * 3000, "s"), (2, None, "s"), (3, "", "s"), (4, "hello", "s"), (4, "hello", "s"), (None, "x y", "s")]
    got = packing.pack(spark.createDataFrame(rows, DOCS), "doc_id", "text", ids=True)
    pieces = got.collect()
    encode = packing.encoder(packing.tokenizer_path())
    for doc, text in {(r[0], r[1]) for r in rows}:
        mine = sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["piece"])[: None if doc != 4 else 1]
        ids = np.concatenate([p["ids"] for p in mine])
        assert ids.tolist() == [*encode(text or ""), 0]
        assert [p["length"] for p in mine[1:]] == [2048] * (len(mine) - 1)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in mine)
        assert [p["start"] for p in mine] == (np.cumsum([p["length"] for p in mine]) - [p["length"] for p in mine]).tolist()
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(by) == -(-sum(p["length"] for p in pieces) // 2048)
    sequences_are_gapless(packing.pack(spark.createDataFrame(rows, DOCS), "doc_id", "text", rows_each=2).collect())
    assert sum(len(r["ids"]) for r in packing.sequences(got).collect()) == sum(p["length"] for p in pieces)
    assert packing.pack(empty(spark), "doc_id", "text").count() == 0


# --- mixing --------------------------------------------------------------------------------------------
def water(sizes, weights, most=3):
    total, left, target = sum(sizes), set(range(len(sizes))), {}
    rest = total
    while left:
        share = {k: rest * weights[k] / sum(weights[j] for j in left) for k in left}
        over = {k for k in left if share[k] > most * sizes[k]}
        if not over:
            return target | share
        for k in over:
            target[k] = most * sizes[k]
            rest -= target[k]
        left -= over
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5, 40, 3, 900], [0, 5], [7], [100, 1, 1, 1, 1, 1]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = water(sizes, [k % 3 + 1 for k in range(len(sizes))])
    assert {k: pytest.approx(want[i]) for i, k in enumerate(sorted(got))} == got


def test_mix(spark):
    rows = [(k, "w " * (k % 50), [None, "a", "b", "é"][k % 4]) for k in range(400)] + [(None, None, "a"), (1000, "\x0b\x1f x", "z")]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    got = mixing.mix(df, "doc_id", "text", "source").collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df, "doc_id", "text", "source").collect()))
    assert next(r["size"] for r in got if r["doc_id"] == 1000) == 2
    for source in (None, "a", "b", "é"):
        mine = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert abs(taken - mine[0]["target"]) < 0.1 * mine[0]["target"] and all(0 <= r["copies"] <= 3 for r in mine)
    out = mixing.emit(df, "doc_id", "text", "source")
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in got)
    twice = df.unionByName(df.where("doc_id = 7"))
    plan = [r["copies"] for r in mixing.mix(twice, "doc_id", "text", "source").collect()]
    assert mixing.emit(twice, "doc_id", "text", "source").count() == sum(plan) and max(plan) <= 3
    assert mixing.mix(empty(spark), "doc_id", "text", "source").count() == 0


@pytest.mark.parametrize(("query", "sql"), [(sharding.query, sharding.SQL), (mixing.query, mixing.SQL), (neardup.query, neardup.SQL), (embdup.query, embdup.SQL)])
def test_sql(spark, query, sql):
    c = duckdb.connect()
    for name in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    got = query(spark, DATA)
    names = sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(c.sql(sql).project(", ".join(names)).fetchall())


# --- media ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 64 * 256, 64 * 256 + 1, 64 * 257, 64 * 1000 - 3])
def test_media_round_trip(size):
    payload = media.padded(np.random.default_rng(size).bytes(size))
    data = media.mux(payload)
    (track,) = media.tracks(data)
    assert media.read_samples(data, track) == payload and len(payload) % 64 == 0
    assert track["codec"] == "raw " and track["duration"] == len(payload) // 64
    assert track["keys"].tolist() == list(range(1, len(payload) // 64 + 1, 16))
    first = track["places"][track["keys"] - 1].tolist()
    assert data[first[0] : first[0] + 64] == payload[:64]


def test_media_boxes():
    data = media.mux(bytes(64))
    paths = [b"/".join(p) for p, _, _ in media.walk(data)]
    assert b"moov/trak/mdia/minf/stbl/stsz" in paths and paths[-1] == b"mdat"
    with pytest.raises(ValueError):
        list(media.walk(data[:-1]))
    with pytest.raises(ValueError):
        media.mux(b"x")
    wide = media.box(b"free", bytes(8)) + b"\0\0\0\1mdat" + (24).to_bytes(8, "big") + bytes(8)
    assert [p[-1] for p, _, _ in media.walk(wide)] == [b"free", b"mdat"]


def test_media_query(spark):
    rows = [(1, "é" * 100, "s"), (2, None, "s"), (3, "", "s"), (None, "é" * 100, "s")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in media.digest(df, "doc_id", "text").collect()}
    payload = media.padded(("é" * 100).encode())
    assert got[1]["n_bytes"] == 200 and got[1]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[1]["tail_crc32"] == zlib.crc32(payload[-64:])
    assert got[1][1:] == got[None][1:] and got[2][1:] == got[3][1:] and got[2]["payload_bytes"] == 64
    files = media.store(df, "doc_id", "text")
    found = {r["doc_id"]: r for r in media.index(files, "doc_id").collect()}
    assert found[1]["codec"] == "raw " and found[1]["n_samples"] == 4 and found[1]["key_sizes"] == [64] and found[1]["duration_ms"] == 160
    assert media.digest(empty(spark), "doc_id", "text").count() == 0


def test_media_query_against_the_texts(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    df = media.query(spark, DATA)
    assert df.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = {r["doc_id"]: r for r in df.collect()}
    for doc, text in docs:
        payload, r = media.padded((text or "").encode()), got[doc]
        stored = media.mux(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and r["feature"]


def test_clashing_names_and_repeated_rows(spark):
    """Columns that are named as results, and rows that repeat, in the operators that take any table."""
    df = spark.createDataFrame([(1, "a b", "s", 7, 8)] * 2 + [(None, None, None, 7, 8)], DOCS + ", n_bytes long, length long")
    assert [r["n_bytes"] for r in media.digest(df, "doc_id", "text").orderBy("n_bytes").collect()] == [0, 3, 3]
    assert sorted(r["length"] for r in packing.pack(df, "doc_id", "text").collect()) == [1, 3, 3]
    out = pii.replace(df.withColumn("m", F.lit(1)).withColumn("kind", F.lit(2)), "text", KEY)
    assert out.columns == ["doc_id", "text", "source", "n_bytes", "length", "m", "kind"] and out.count() == 3


# --- personal data -------------------------------------------------------------------------------------
KEY = "a key of the tests"


def swap(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.replace(df, "text", KEY).orderBy("doc_id").collect()]


def test_surrogates_keep_type_and_format(spark):
    import re

    text = 'ann.42@mail7.example.com 97.51.17.173 9807915762804490 +1 (974) 555-3436 token = "ede43f42c939b6405768150e0411590525cf889e" 4111-1111-1111-1111 078-05-1120 555-123-4567 030 1234567 DE89 3704 0044 0532 0130 00'
    (out,) = swap(spark, text)
    assert re.fullmatch(r'[a-z]{3}\.\d\d@[a-z]{4}\d\.example\.com (\d{1,3}\.){3}\d{1,3} \d{16} \+1 \(\d{3}\) \d{3}-\d{4} token = "[0-9a-f]{40}" (\d{4}-){3}\d{4} \d{3}-\d\d-\d{4} \d{3}-\d{3}-\d{4} \d{3} \d{7} DE\d\d( \d{4}){4} \d\d', out)
    assert not set(re.findall(r"[\w.@-]{7,}", text)) & set(re.findall(r"[\w.@-]{7,}", out))


def test_coreference_and_names(spark):
    a, b, c, d, e, f = swap(spark, "A.b@x.example.com 4111 1111 1111 1111 +1 974 555 3436", "a.b@X.example.com 4111111111111111 +19745553436", "Mrs Jane Doe met Mr. Bob Doe", "Госпожа Анна Петрова и Господин Петров", "Mr Doe and Dr DOE, Dr Jane Roe, Mr Bill Doe", "Mr Bob Doe")
    assert a.split()[0].lower() == b.split()[0].lower()
    assert "".join(a.split()[1:5]) == b.split()[1] and "".join(a.split()[5:]) == b.split()[2]
    assert c.split()[0] == "Mrs" and c.split()[1] in pii.FIRST["woman"] and c.split()[5] in pii.FIRST["man"]
    doe = c.split()[2]
    assert c.split()[6] == doe and e.split()[1] == doe and e.split()[4] == doe.upper() + "," and f == c[c.index("Mr.") :].replace(".", "")
    assert e.split()[6] in pii.FIRST["any"] and e.split()[9].removesuffix(",") not in ("Bill", c.split()[5]) and e.split()[10] == doe
    assert d.split()[1] in pii.FIRST["woman_ru"] and d.split()[2].endswith("ова") and d.split()[5].endswith("ов")


def test_scripts_stay(spark):
    import regex

    texts = ["иван7@почта.рф", "κώστας@αθήνα.gr", "דוד@דואר.co", "राम९@डाक.in", "山田@日本.jp", "Frau Ωμέγα", "Mr Петров"]
    for old, new in zip(texts, swap(spark, *texts), strict=True):
        assert old != new
        for script in ("Latin", "Cyrillic", "Greek", "Hebrew", "Devanagari", "Han"):
            assert bool(regex.search(rf"\p{{{script}}}", old)) == bool(regex.search(rf"\p{{{script}}}", new)), (old, new)


def test_clean_texts_stay(spark):
    clean = ["version 4.0. Page 3, 1,000 words", "", "Mr nobody", "a@b", "1.2.3", "12345678901", "GPL version 3.\n", None, "2020 1234567", "10-20 30 40", "Drs Are In", "AB12 only"]
    assert swap(spark, *clean) == clean
    assert pii.replace(empty(spark), "text", KEY).count() == 0


def test_mentions_without_digit_or_title(spark):
    secret = "abcdefabcdefabcdefabcdefabcdefab"
    mail, hidden = swap(spark, "write to jane.doe@corp.com", f"the key is {secret} here")
    assert mail.startswith("write to ") and mail.endswith(".com") and "jane.doe" not in mail
    assert secret not in hidden and len(hidden) == len(f"the key is {secret} here")
    rows = spark.createDataFrame([(1, "write to jane.doe@corp.com"), (2, secret)], "doc_id long, text string")
    assert {(r["kind"], r["value"]) for r in pii._entities(rows, "text").collect()} == {("email", "jane.doe@corp.com"), ("secret", secret)}


def test_no_mention_survives(spark):
    """Random texts around mentions of every type: each is searched, and none is left in its text."""
    import random

    r = random.Random(1)
    pieces = ["jane@corp.com", "x.y+z@a-b.co.uk", "deadbeef" * 4, "ABCDEFABCDEFABCDEFABCDEFABCDEFAB", "10.0.0.1", "4111 1111 1111 1111", "(030) 123-4567", "+49 30 1234567", "555-123-4567", "030 1234567", "078-05-1120", "DE89370400440532013000", "Mrs. Ann Lee", "Miss Ann Lee", "Mme Zola", "Señora Ruiz", "Sr. Ruiz", "Monsieur Zola", "Dr Jane Roe", "Prof. Roe", "Госпожа Петрова", "Господин Иван Петров"]
    filler = ["", " ", ". ", ", ", "\n", "word ", "é", "9", "-", "Mr", "@", "(", "日本", ":"]
    texts = ["".join(r.choice(filler + pieces) for _ in range(r.randint(1, 8))) for _ in range(4000)] + pieces
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert df.where(F.col("text").rlike(pii.ANY) & ~F.col("text").rlike(pii.SUSPECT)).count() == 0
    found = F.regexp_extract_all(F.col("text"), F.lit(pii.ANY), F.lit(0)).alias("found")
    mentions = {x["doc_id"]: x["found"] for x in df.select("doc_id", found).collect()}
    new = {x["doc_id"]: x["text"] for x in pii.replace(df, "text", KEY).collect()}
    values = {m for ms in mentions.values() for m in ms}
    assert len(values) > 100
    for i, ms in mentions.items():
        again = new[i]
        for m in ms:
            assert again.count(m) <= texts[i].count(m) - ms.count(m), (texts[i], again)  # it may stand within a word too
        if not ms:
            assert again == texts[i]


def test_distinct_values_stay_distinct(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"10.{k // 256}.{k % 256}.1") for k in range(150)], "doc_id long, text string")
    monkeypatch.setattr(pii, "_byte", lambda digest, i, f=pii._byte: f(digest, i) % 5)  # 5**4 addresses: many collide
    assert pii.collided(rows, "text", KEY).count() > 5
    monkeypatch.setattr(pii, "BROADCAST_VALUES", 3)
    got = {r["text"] for r in pii.replace(rows, "text", KEY).collect()}
    assert len(got) == 150 and not got & {r["text"] for r in rows.collect()}


def test_many_names_and_short_addresses(spark):
    """Values beyond a format's room: names and addresses get longer; 30,000 distinct names of one script pass."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.com" for a in letters for b in letters]
    russian = spark.range(30_000).select(F.concat(F.lit("Госпожа А"), F.translate(F.format_string("%05d", "id"), "0123456789", "абвгдежзик")).alias("text"))
    df = russian.union(spark.createDataFrame([(m,) for m in mails], "text string")).union(spark.createDataFrame([(f"Mr {a.upper()}x Doe",) for a in letters + "äöüßéèñç"], "text string"))
    got = pii.replace(df, "text", KEY)
    assert got.distinct().count() == df.count() and got.intersect(df).count() == 0


def test_surrogates_agree_with_plain_python(spark):
    """All documents, against the same rules in plain Python."""
    import regex

    any_, kinds = regex.compile(pii.ANY.replace("Is", "")), {k: regex.compile(p.replace("Is", "")) for k, p in pii.PATTERNS.items()}
    is_letter, is_upper, is_mark = (regex.compile(p) for p in (r"[\p{L}\p{N}]", r"\p{Lu}", r"\p{M}"))
    scripts = [(regex.compile(s.replace("Is", "")), a) for s, a in pii.ALPHABETS.items()]
    russian, latin = regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{Latin}")

    def digest(kind, value, attempt):
        return hashlib.sha512("\u0001".join([KEY, kind, value, str(attempt)]).encode()).digest()

    def same_format(m, d, keep=0):
        out, n = [], 0
        for i, c in enumerate(m):
            if i >= keep and is_mark.match(c):
                continue
            if i >= keep and is_letter.match(c):
                letters = next((a for s, a in scripts if s.match(c)), pii.ALPHABETS[r"\p{IsLatin}"])
                new = letters[d[n % 64] % len(letters)]
                out.append(new.upper() if is_upper.match(c) else new)
            else:
                out.append(c)
            n += bool(is_letter.match(c))
        return "".join(out)

    def word(kind, old, d, attempt):
        if russian.match(old) or latin.match(old):
            ru = bool(russian.match(old))
            if kind.startswith("first_"):
                list_ = pii.FIRST[kind[6:] + "_ru" * ru]
                new = "-".join(list_[d[i] % 16] for i in range(attempt + 1))
            else:
                c, v = pii.CYRILLIC if ru else pii.LATIN
                new = "".join(c[d[2 * i % 64] % len(c)] + v[d[(2 * i + 1) % 64] % len(v)] for i in range(1, 5 + 2 * attempt))
                new = (new + (("нова" if kind == "last_woman" else "нов") if ru else "nrst"[d[0] % 4])).capitalize()
        else:
            new = same_format(old, d)
        return new.upper() if len(old) > 1 and old == old.upper() else new

    def replaced(m):
        kind = next(k for k, p in kinds.items() if p.fullmatch(m))
        if kind in pii.GENDERS:
            title, first, space, last = regex.fullmatch(r"(\S+\s)(?:(\S+)(\s))?(\S+)", m).groups()
            k = f"last_{kind}" if russian.match(last.lower()) else "last"
            out = word(k, last, digest(k, last.lower(), 0), 0)
            if first:
                k = f"first_{kind}"
                out = word(k, first, digest(k, f"{last.lower()}|{first.lower()}", 0), 0) + space + out
            return title + out
        value = m.lower() if kind in ("email", "secret") else regex.sub("[^0-9+]", "", m) if kind in ("card", "phone", "ssn") else m.replace(" ", "") if kind == "iban" else m
        d = digest(kind, value, 0)
        if kind == "secret":
            return d.hex()[: len(m)] if m == m.lower() else d.hex()[: len(m)].upper()
        if kind == "ip":
            return ".".join(map(str, d[:4]))
        if kind == "email":
            host = regex.search(r"(?:\.[^.@]+){1,2}$", m).group()
            return same_format(m[: len(m) - len(host)], d) + host
        return same_format(m, d, 2 if kind == "iban" or kind == "phone" and m[0] == "+" else 0)

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert pii.collided(docs, "text", KEY).count() == 0
    got = {x["doc_id"]: x["text"] for x in pii.replace(docs, "text", KEY).collect()}
    changed = 0
    for row in docs.collect():
        want = any_.sub(lambda m: replaced(m.group()), row["text"])
        changed += want != row["text"]
        assert got[row["doc_id"]] == want
    assert changed > 5
