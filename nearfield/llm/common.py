"""What several operators of this subpackage need: tables, shared storage, worker caches, components."""

from __future__ import annotations

import gc
import sys
import tempfile
from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: texts may be long, and both the JVM and Python hold a batch whole.
BATCH_ROWS = 2_000


def in_small_batches(spark: SparkSession) -> None:
    """The session hands rows to Python in batches of BATCH_ROWS at most; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    in_small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids and texts, dealt anew if their files give fewer partitions than there are cores, as a small file does. Larger tables aren't moved."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only on a single machine, as in tests, a temporary one stands in where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="nearfield-")


def saved(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that the cluster shares; its lineage ends there.

    The folder is the session's (shared_folder()). The files go when the
    DataFrame is no longer referred to, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = df.sparkSession
    in_small_batches(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Lets go of shuffle files that nothing refers to any more, as after saved(): Spark deletes them when the driver's garbage is collected.

    Two things would keep the files until the next call. Spark's listeners hold the last job's plan until another job, an empty one here,
    follows. Java objects that Python no longer has are only noted down by Py4J, and a thread that looks once a second tells the JVM; here it is told at once.
    """
    spark.sparkContext._jsc.emptyRDD().count()
    gc.collect()
    noted = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while noted:
        try:
            task = noted.pop()
        except IndexError:  # that thread was quicker
            break
        if not isinstance(task, tuple):  # the gateway is closing
            noted.append(task)
            break
        task[0].garbage_collect_object(task[1], False)
    spark.sparkContext._jvm.System.gc()


def on_worker(key: tuple, make: Callable[[], object]) -> object:
    """make()'s value, made once for each Python worker; sys outlives the functions sent for a task."""
    kept = sys.__dict__.setdefault("_nearfield_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def shrunk(raw: bytes) -> bytes:
    """Bytes as they travel between steps, compressed."""
    return on_worker(("shrink",), lambda: zstandard.ZstdCompressor(level=3)).compress(raw)


def grown(z: bytes) -> bytes:
    return on_worker(("grow",), zstandard.ZstdDecompressor).decompress(z)


def md5_int(key: Column, first: int, digits: int) -> Column:
    """An integer from hexadecimal digits of md5(key), the first of them being 1."""
    return F.conv(F.substring(F.md5(key), first, digits), 16, 10).cast("long")


def spread(df: DataFrame, rows_each: int, least: int = 16) -> int:
    """Number of parts so that rows_each rows fall to each on average."""
    return max(least, -(-df.count() // rows_each))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component), the smallest id reached.

    Alternating star contraction: larger neighbours are linked to the smallest one known,
    then smaller ones, until every edge is a star around its component's smallest id. Each
    round keeps at most the edges it got, groups are reduced by partial minima, and no
    neighbourhood is gathered. Minima are written before they are joined, so that both sides of a join are exchanges
    and the edges of a star's centre can be split. Ids without an edge aren't in the result. Null ends, loops and
    repeated edges are dropped; no edges give no rows.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))

    def least(e: DataFrame) -> DataFrame:
        return saved(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))

    def sums(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = sums(now)
    if not before[0]:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(rounds):
        e = both(now)
        large = e.join(least(e), "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = saved(large.select(F.col("a").alias("u"), F.col("b").alias("v")))  # v < u throughout
        small = down.join(least(down), "u")
        now = saved(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        after = sums(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: no fixed point; raise rounds")
    star = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return star.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def string_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string array's bytes and its len + 1 offsets into them; nulls count as empty."""
    import pyarrow as pa

    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    array = (array.fill_null("") if array.null_count else array).cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, 8 * array.offset)
    data = array.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, column: int, most_bytes: int = 8 << 20, most_rows: int = 512):
    """The Arrow batch in parts of most_rows rows at most, whose strings or bytes in a column, or sizes if it holds numbers, come to about most_bytes; a longer one is a part of its own."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = batch.column(column)
    sizes = pc.fill_null(held if pa.types.is_integer(held.type) else pc.binary_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, min(int(np.searchsorted(ends, before + most_bytes, "right")), low + most_rows))
        yield batch.slice(low, high - low)
        low = high
