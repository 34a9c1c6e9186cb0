"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import components, saved, slices, string_buffers, texts

HASHES, BATCH, MISS = 120, 24, 1e-6
#: Buckets up to BUCKET members give all pairs, larger ones a pair with their representative for each member; what stays apart then is compared in blocks of BLOCK.
BUCKET, BLOCK = 24, 400
#: A list of ids up to this length (8 MB) is broadcast, a longer one joined by a shuffle.
BROADCAST_IDS = 1_000_000


def bands_for(percent: int, hashes: int = HASHES, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair at the threshold shares no band with probability miss at most."""
    j = percent / 100
    fits = [r for r in range(1, hashes + 1) if (1 - j**r) ** (hashes // r) <= miss]
    rows = max(fits, default=1)
    return hashes // rows, rows


def least_matches(percent: int, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> tuple[int, ...]:
    """For each number of hashes looked at so far (batch, 2 batch, ...) the fewest matches that keep a pair.

    The posterior of the similarity under a uniform prior after m matches of n is Beta(m + 1, n - m + 1);
    a pair goes when its probability of reaching the threshold falls below miss. That tail equals a binomial
    sum: P(X >= t) = P(Bin(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def plausible(x: np.ndarray, y: np.ndarray, percent: int, batch: int = BATCH) -> np.ndarray:
    """Which pairs of rows of two signature matrices are kept: batches are compared in turn, pairs that fall out are not looked at again."""
    live = np.arange(len(x))
    matches = np.zeros(len(x), np.int64)
    for k, least in enumerate(least_matches(percent, x.shape[1], batch)):
        cut = slice(k * batch, (k + 1) * batch)
        matches[live] += (x[live, cut] == y[live, cut]).sum(1)
        live = live[matches[live] >= least]
    return live


def signatures(df: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(id, n, digest, sig, bands) for each row: set size, a digest of the set, signature and band keys; the last three are null for an empty set."""
    import pyarrow as pa

    bands, rows = bands_for(percent)

    def run(batches):
        a, b = W.coefficients(HASHES)
        for whole in batches:
            for batch in slices(whole, 1):
                h, _, at = W.words(*string_buffers(batch.column(1)))
                out = []
                for i in range(batch.num_rows):
                    s = W.shingles(h[at[i] : at[i + 1]], k)
                    if not len(s):
                        out.append((0, None, None, None))
                        continue
                    sig = W.signature(s, a, b)
                    keys = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        keys = W.mix(keys * W._BASE + sig[: bands * rows].reshape(bands, rows)[:, r])
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig.tobytes(), keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.list_(pa.int64()))], ["id", "n", "digest", "sig", "bands"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n long, digest binary, sig binary, bands array<long>")


def shingle_sets(df: DataFrame, key: str, text: str, ids: DataFrame, k: int) -> DataFrame:
    """(id, s): the sorted sets of the rows whose key is in ids(id)."""
    import pyarrow as pa

    few = ids.count() <= BROADCAST_IDS
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                h, _, at = W.words(*string_buffers(batch.column(1)))
                sets = [W.shingles(h[at[i] : at[i + 1]], k).view(np.int64) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, s array<long>")


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, by products of incidence matrices over the values that occur on both sides."""
    ax, ay = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(ax, ay)
    out = np.zeros((len(x), len(y)), np.float32)
    rx, ry = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    px, py = np.searchsorted(both, ax), np.searchsorted(both, ay)
    hx, hy = np.isin(ax, both), np.isin(ay, both)
    rx, px, ry, py = rx[hx], px[hx], ry[hy], py[hy]
    for low in range(0, len(both), 4096):
        width = min(4096, len(both) - low)
        m, n = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
        i, j = (px >= low) & (px < low + width), (py >= low) & (py < low + width)
        m[rx[i], px[i] - low] = 1
        n[ry[j], py[j] - low] = 1
        out += m @ n.T
    return out


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple]:
    """Edges that join what a matrix of links between two lists of ids joins: each id and the least id that it reaches."""
    r, c = rows.copy(), columns.copy()
    top = np.iinfo(np.int64).max
    known = {}
    while True:
        r2 = np.minimum(r, np.where(linked, c[None, :], top).min(1))
        c2 = np.minimum(c, np.where(linked, r2[:, None], top).min(0))
        for ids, labels in ((rows, r2), (columns, c2)):
            for i, m in zip(ids.tolist(), labels.tolist(), strict=True):
                known[i] = min(m, known.get(i, i))
        r3, c3 = np.array([known[i] for i in rows.tolist()]), np.array([known[i] for i in columns.tolist()])
        if (r3 == r).all() and (c3 == c).all():
            break
        r, c = r3, c3
    return [(i, m) for i, m in known.items() if i != m]


def _apart(df: DataFrame, key: str, text: str, hot: DataFrame, linked: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Edges (a, b) between the components of one large bucket, from hot(band, bucket, id, rep) and linked(id, component); None if each bucket is in one.

    Members outside of their representative's component, and all members, are dealt to blocks; a block of the ones and a block
    of the others are compared by products of incidence matrices and give the edges of a spanning forest.
    """
    if hot.isEmpty():
        return None
    kind = hot.schema["id"].dataType.simpleString()
    named = hot.join(linked, "id", "left").select("band", "bucket", "id", "rep", F.coalesce("component", "id").alias("label"))
    named = saved(named)
    main = saved(named.where("id = rep").select("band", "bucket", F.col("label").alias("main")))
    sided = named.join(main, ["band", "bucket"]).select("band", "bucket", "id", (F.col("label") != F.col("main")).alias("other"))
    counts = sided.groupBy("band", "bucket").agg(F.sum(F.col("other").cast("long")).alias("n"), F.count("*").alias("m")).where("n > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    open_ = saved(counts.select("band", "bucket", blocks("n").alias("xs"), blocks("m").alias("ys")))
    if open_.isEmpty():
        return None
    rows = saved(sided.join(open_, ["band", "bucket"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = rows.where("other").select("band", "bucket", "id", mine("xs").alias("x"), every("ys").alias("y"), F.lit(True).alias("left"))
    right = rows.select("band", "bucket", "id", every("xs").alias("x"), mine("ys").alias("y"), F.lit(False).alias("left"))
    sets = saved(shingle_sets(df, key, text, saved(rows.select("id").distinct()), k))

    def block(pdf):
        import pandas as pd

        one, two = pdf[pdf["left"]], pdf[~pdf["left"]]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        ls, rs = ([np.asarray(s) for s in part["s"]] for part in (one, two))
        common = common_counts(ls, rs).astype(np.int64)
        union = np.array([len(s) for s in ls])[:, None] + np.array([len(s) for s in rs])[None, :] - common
        edges = forest(100 * common >= percent * union, one["id"].to_numpy(np.int64), two["id"].to_numpy(np.int64))
        return pd.DataFrame(edges, columns=["a", "b"])

    return left.unionByName(right).join(sets, "id").groupBy("band", "bucket", "x", "y").applyInPandas(block, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, key: str, text: str, k: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of df; keys are whole numbers.

    A text's set is its distinct shingles of k words in lower case; with fewer words all of it is one
    shingle; null texts and texts without words have the empty set and no links. Texts are linked if
    100 * intersection >= percent * union. component_id is the least key reached by links, kept says that it
    is the row's own.

    Rows with the same set are one class, represented by their least key. Classes meet in bands of their
    signatures. Buckets up to BUCKET members give their pairs, larger ones link each member to one of theirs, which a hash
    chooses anew for each band. Pairs are compared by batches of hashes (least_matches()) and confirmed on whole sets. Members of
    a large bucket that these links leave in another component than its representative are compared with all of
    the bucket, exactly and in blocks, which gives a spanning forest of their links and no pairs. So a bucket of near copies costs a pair for each,
    and no link between components is given up. A linked pair is missed with
    probability 1e-5 (no common band) or MISS (pruned) at most.

    Rows that repeat a key count as one document with several texts. Rows with a null key aren't linked: their
    component is null and they are kept. Other columns are left out. An empty table gives no rows.
    """
    _, rows_each = bands_for(percent)
    rows = saved(signatures(df, key, text, k, percent))
    good = rows.where("n > 0 and id is not null")
    classes = saved(good.groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n")))
    reps = good.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi")
    keyed = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    chosen = F.min(F.struct(F.xxhash64("band", "id").alias("h"), "id"))["id"]
    # counted in advance: a join whose both sides are exchanges can split a large bucket
    sizes = saved(keyed.groupBy("band", "bucket").agg(F.count("*").alias("members"), chosen.alias("rep")).where("members > 1"))
    met = saved(keyed.join(sizes, ["band", "bucket"]))

    lists = met.where(F.col("members") <= BUCKET).groupBy("band", "bucket").agg(F.array_sort(F.collect_set("id")).alias("m"))
    pair = F.explode(F.transform(F.slice("m", F.lit(2), F.size("m")), lambda x, i: F.struct(x.alias("b"), F.slice("m", F.lit(1), i + 1).alias("before"))))
    pairs = lists.where("size(m) > 1").select(pair.alias("p")).select(F.explode("p.before").alias("a"), F.col("p.b").alias("b"))
    hot = met.where(F.col("members") > BUCKET)
    pairs = pairs.union(hot.where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"))).distinct()
    sigs = reps.select("id", "sig")
    with_a = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
    both = with_a.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array(plausible(x, y, percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    kind = df.schema[key].dataType.simpleString()
    likely = saved(both.mapInArrow(verify, f"a {kind}, b {kind}").distinct())

    needed = saved(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct())
    sets = saved(shingle_sets(df, key, text, needed, k))

    of_b = likely.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    full = of_b.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    confirmed = full.withColumn("i", shared).where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")

    linked = saved(components(confirmed))
    apart = _apart(df, key, text, hot, linked, k, percent)
    if apart is not None:
        linked = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(apart))
    classes = classes.join(linked, classes["rep"] == linked["id"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    same_key = good.groupBy("id").agg(F.count_distinct("digest").alias("c")).where("c > 1")
    if not same_key.isEmpty():  # a key with several texts joins their components
        again = good.join(same_key, "id").join(classes, "digest").select("id", "component_id")
        more = components(again.select(F.col("id").alias("a"), F.col("component_id").alias("b")))
        classes = classes.join(more, classes["component_id"] == more["id"], "left").select("digest", F.coalesce("component", "component_id").alias("component_id"))
    out = rows.select("id", "n", "digest").join(classes, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir):
    """op6: documents by 3-word shingles at 85%: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(texts(spark, sf_dir), "doc_id", "text", k=3, percent=85)


def keep_one(df: DataFrame, key: str, text: str, k: int = 5, percent: int = 80) -> DataFrame:
    """df's rows without near-duplicates: of each component one row stays, that with the least key.

    Rows count by their texts: different texts under one key are documents of their own, as are texts without a
    key, which come after all others; so only a copy or a near copy goes, and of repeated rows one stays. Texts without
    words have no near copies and all stay. An empty table gives no rows.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    rows = df.withColumn("__h", digest)
    several = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min("__h").alias("__first"), F.max("__h").alias("__last")).where("__first <> __last")
    several = saved(several.select("__k", "__first"))
    # numbers far above real keys for texts that have none of their own
    own = F.lit(1 << 62) + F.shiftright(F.xxhash64(F.col(key), "__h"), 2).bitwiseAND((1 << 61) - 1)
    mine = F.col(key).isNotNull()
    n = several.count()
    if n:  # of a key's texts the one of the least hash has the key, which others can't
        rows = rows.join(F.broadcast(several) if n <= BROADCAST_IDS else several, rows[key] == several["__k"], "left")
        mine = mine & (F.col("__first").isNull() | (F.col("__first") == F.col("__h")))
    rows = rows.withColumn("__key", F.when(mine, F.col(key).cast("long")).otherwise(own)).select(*df.columns, "__key")
    found = saved(near_duplicates(rows, "__key", text, k, percent).where("kept").groupBy("__key").agg(F.count("*").alias("__copies"), F.max("n_shingles").alias("__n")))
    out = rows.join(found, "__key", "left_semi")
    again = found.where("__copies > 1 and __n > 0").select("__key")
    if not again.isEmpty():  # repeated rows
        again = saved(again)
        out = out.join(again, "__key", "left_anti").unionByName(out.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return out.select(*df.columns)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: query() by comparing all pairs of documents that share a shingle.
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON doc_id = id
"""
