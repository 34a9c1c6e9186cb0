"""Near-duplicate vectors: codes by iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, saved, table
from .neardup import forest

#: Codes are learned on at most SAMPLE vectors, those whose hash is least. Substrings of BITS to MOST_BITS bits are looked up: TABLES of BITS, more of longer ones.
SAMPLE, ITERATIONS, TABLES, BITS, MOST_BITS = 8_192, 30, 32, 10, 24
COSINE, BLOCK = 0.95, 512


def rotation(x: np.ndarray, bits: int, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """dim x bits projection: principal directions, rotated until codes lose least.

    In turn the codes are the signs of the rotated projections, and the rotation is the orthogonal one
    that takes the projections nearest the codes (Procrustes). Another seed starts from another rotation and so
    ends with other codes. If the sample has fewer directions than bits, random ones fill up. Vectors aren't centred: planes go
    through the origin, where cosines are measured. Around the mean of vectors that all lie one way, near ones would be torn apart.
    """
    draw = np.random.default_rng(seed)
    v = np.linalg.svd(x, full_matrices=False)[2] if len(x) else np.zeros((0, x.shape[1]))
    p = v[:bits].T
    if p.shape[1] < bits:
        p = np.concatenate([p, draw.normal(size=(x.shape[1], bits - p.shape[1])) / np.sqrt(x.shape[1])], 1)
    r, _ = np.linalg.qr(draw.normal(size=(bits, bits)))
    projected = x @ p
    for _ in range(iterations if len(x) else 0):
        codes = np.where(projected @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(codes.T @ projected)
        r = (u @ w).T
    return p @ r


class Codes:
    """Several rotations whose bits are cut into the tables' keys."""

    def __init__(self, sample: np.ndarray, dim: int, tables: int = TABLES, bits: int = BITS):
        self.tables, self.bits = tables, bits
        each = max(1, dim // bits)  # tables that one rotation feeds
        self.parts = []
        for k in range(0, tables, each):
            columns = bits * min(each, tables - k)
            # all directions are rotated, so that a pair that differs most in some of them isn't missed by every table
            self.parts.append(rotation(sample, max(dim, columns), seed=k)[:, :columns])

    def keys(self, x: np.ndarray) -> np.ndarray:
        return keys_of(x, self.parts, self.tables, self.bits)


def keys_of(x: np.ndarray, parts: list[np.ndarray], tables: int, bits: int) -> np.ndarray:
    """A key for each row and table."""
    bit = np.concatenate([x @ p >= 0 for p in parts], 1)
    return bit.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def tables_for(bits: int, tables: int, least: float) -> int:
    """How many tables of ``bits`` bits miss a pair at cosine ``least`` no more often than ``tables`` tables of BITS bits."""
    same = 1 - np.arccos(least) / np.pi  # the probability that a bit is
    if not 0 < same < 1:
        return tables
    return max(tables, int(np.ceil(tables * np.log1p(-(same**BITS)) / np.log1p(-(same**bits)))))


def _unit(vectors, width: int) -> np.ndarray:
    """Rows of unit length, shorter vectors with zeros behind. They are scaled by their largest component first, so squares neither over- nor underflow."""
    m = np.zeros((len(vectors), width))
    for row, v in zip(m, vectors, strict=True):
        row[: len(v)] = v
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def near_vectors(df: DataFrame, key: str, vector: str, least: float = COSINE, sample: int = SAMPLE, tables: int = TABLES, bits: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for each row; keys are whole numbers.

    Two rows are linked if the cosine of their vectors, in double precision, is ``least`` or more and they share one
    of the tables' keys; n_links is the number of other rows linked directly, component_id the least key
    reached. Every vector is in every table; with an angle of 18 degrees (0.95) and 10 bits a pair shares
    none of 32 keys with probability 1e-6 or so, nearer pairs far less. bits grow with the number of vectors, so that a bucket
    keeps its size, and tables with bits, so that this probability stays (54 at 14 bits, 171 at 24); ``tables`` is their number at 10 bits. A bucket beyond BLOCK members is compared in blocks; links are counted at the first table where
    a pair meets, and leave a block as counts and as a spanning forest, never as pairs.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are their own
    component. Vectors of different lengths aren't linked; their codes count a shorter one's missing components as zeros. Equal vectors are compared once and counted. Rows with a null key are kept and have no links; rows that repeat a key count as links of each other if
    their vectors are near. Other columns are left out. An empty table gives no rows.
    """
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    kind = df.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    # vectors move as they are stored, which for FLOAT is half of DOUBLE, and are compared in DOUBLE
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v")).withColumn("ok", F.coalesce(usable, F.lit(False)) & F.col("id").isNotNull())
    rows = saved(rows.withColumn("digest", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))))
    good = rows.where("ok")
    classes = saved(good.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    reps = saved(good.join(classes, "digest").where("id = rep").dropDuplicates(["rep", "digest"]).select("rep", "copies", "v"))
    n = reps.count()
    if not n:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = reps.agg(F.max(F.size("v"))).first()[0]
    width = bits or min(MOST_BITS, max(BITS, int(np.log2(n)) - 5), dim)
    tables = tables_for(width, tables, least)
    drawn = sorted((r["rep"], r["v"]) for r in reps.orderBy(F.xxhash64("rep")).limit(sample).collect())
    codes = Codes(_unit([r[1] for r in drawn], dim), dim, tables, width)
    sent = df.sparkSession.sparkContext.broadcast(codes.parts)  # arrays alone, as broadcasts name classes and don't carry them

    def code(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"rep": b["rep"], "keys": list(keys_of(_unit(b["v"], dim), sent.value, tables, width).astype(np.int32))})

    coded = saved(reps.mapInPandas(code, "rep long, keys array<int>"))
    entries = coded.select("rep", F.posexplode("keys").alias("table", "bucket"))
    sizes = entries.groupBy("table", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = entries.join(sizes, ["table", "bucket"]).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("table", "bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "rep")
    full = reps.join(coded, "rep")
    # buckets are gathered in runs of a few hundred rows, so that a Python call serves many small ones
    dealt = met.withColumn("part", F.pmod(F.xxhash64("table", "bucket", "x", "y"), F.lit(max(64, n * tables // 20_000)))).join(full, "rep")

    def compare(pdf):
        edges, ids, counts = [], [], []
        unit, sizes = _unit(pdf["v"], dim), pdf["v"].map(len).to_numpy()
        keys = np.array(pdf["keys"].tolist())
        rep, copies, mine = (pdf[c].to_numpy(np.int64) for c in ("rep", "copies", "mine"))
        order = np.lexsort([pdf[c].to_numpy() for c in ("y", "x", "bucket", "table")])
        group = pdf[["table", "bucket", "x", "y"]].to_numpy(np.int64)[order]
        cuts = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
        for at in np.split(order, cuts):
            t, x, y = int(pdf["table"].iat[at[0]]), int(pdf["x"].iat[at[0]]), int(pdf["y"].iat[at[0]])
            i, j = at[mine[at] == x], at[mine[at] == y]
            if not len(i) or not len(j):
                continue
            linked = unit[i] @ unit[j].T >= least
            linked &= (rep[i][:, None] != rep[j][None, :]) & (sizes[i][:, None] == sizes[j][None, :])
            if not linked.any():
                continue
            a, b = np.nonzero(linked)
            first = (keys[i[a], :t] != keys[j[b], :t]).all(1) if t else np.ones(len(a), bool)
            a, b = a[first], b[first]
            ids.append(rep[i])
            counts.append(np.bincount(a, copies[j[b]], minlength=len(i)))
            if x != y:
                ids.append(rep[j])
                counts.append(np.bincount(b, copies[i[a]], minlength=len(j)))
            linked[:] = False
            linked[a, b] = True
            edges += forest(linked, rep[i], rep[j])
        out = pd.DataFrame({"a": np.concatenate(ids) if ids else np.zeros(0, np.int64), "n": (np.concatenate(counts) if ids else np.zeros(0)).astype(np.int64)}).groupby("a", as_index=False).sum()
        out["b"] = out["a"]
        more = pd.DataFrame(edges, columns=["a", "b"], dtype="int64").drop_duplicates()
        return pd.concat([out[out["n"] > 0], more.assign(n=0)], ignore_index=True)[["a", "b", "n"]]

    found = saved(dealt.groupBy("part").applyInPandas(compare, "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    linked = components(found.where("a <> b").select("a", "b"))
    known = classes.join(links, "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "digest").join(known, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir):
    """op7: all vectors by cosine at 0.95: vec_id, n_links, component_id, kept."""
    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


#: query() by comparing all pairs of vectors.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= {COSINE}),
r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = id
"""
