"""Measurements with warm-up and repeats: notes into an index, and an index into its formats."""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Callable
from statistics import fmean

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import lifecycle
from .operators import prepare as PR
from .operators.ranking import saved, shared_folder
from .sources import sidecar, synthetic
from .sources.store import Store

ITERATIONS, WARM_UP, INDEX, NOTE_CHARS, DIM = 5, 1, 500, (500, 2400, 4800), 384


def summary(values: list[float]) -> dict[str, float]:
    """mean, median, p95, min and max; quantiles are the sorted values at index floor(q (n - 1)), and all are 0 without values."""
    if not values:
        return dict.fromkeys(("mean", "median", "p95", "min", "max"), 0.0)
    at = sorted(values)
    pick = lambda q: at[int(q * (len(at) - 1))]
    return {"mean": fmean(at), "median": pick(0.5), "p95": pick(0.95), "min": at[0], "max": at[-1]}


def measure(run: Callable[[], object], iterations: int = ITERATIONS, warm_up: int = WARM_UP) -> dict[str, float]:
    """Milliseconds of run(), which is first called warm_up times."""
    taken = []
    for k in range(warm_up + iterations):
        start = time.perf_counter()
        run()
        if k >= warm_up:
            taken.append((time.perf_counter() - start) * 1000)
    return summary(taken)


def memory_mb() -> float:
    """The driver's largest resident set so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def ms(value: float) -> str:
    return f"{value:.2f}ms"


def kb(size: float) -> str:
    return f"{size / 1024:.1f}KB"


def row(cells: list[tuple[str, int]]) -> str:
    """Cells, each at the right of its width."""
    return "  " + "".join(text.rjust(width) for text, width in cells)


def indexing(spark: SparkSession, sizes: tuple[int, ...] = NOTE_CHARS, entries: int = INDEX, iterations: int = ITERATIONS, warm_up: int = WARM_UP) -> list[dict]:
    """A note that is new, changed or unchanged, by its size, against an index of so many entries: each phase's and the whole's median, in ms."""
    out = []
    rules = spark.createDataFrame([], "rule string")
    index = saved(synthetic.seed_index(spark, entries, len(PR.LETTERS)))
    for chars in sizes:
        note = saved(synthetic.synthetic_notes(spark, 1, chars))
        ready = saved(PR.prepare(note.select("id"), note).select("id", T.content_hash("prepared_text").alias("content_hash")))
        own = ready.select("id", F.array(*[F.lit(1.0)] * len(PR.LETTERS)).alias("embedding"), "content_hash", F.lit("t").alias("updated_at"), F.lit(entries).cast("long").alias("position"))
        cases = {"insert": index, "update": saved(index.unionByName(own.withColumn("content_hash", F.lit("deadbeef")))), "unchanged": saved(index.unionByName(own))}
        for case, held in cases.items():
            store = Store(spark, f"{shared_folder(spark)}/bench-{chars}-{case}")
            phases = {
                "prepare": lambda: PR.prepare(note.select("id"), note).collect(),  # noqa: B023
                "lookup": lambda: held.join(note.select("id"), "id", "left_semi").collect(),  # noqa: B023
                "embed": lambda: PR.letter_vectors(PR.prepare(note.select("id"), note)).collect(),  # noqa: B023
                "store": lambda: (store.rewrite(held), store.flush()),  # noqa: B023
            }

            def whole():
                outcomes = saved(lifecycle.processed(note.select("id"), note, held, rules, PR.Settings(), PR.letters_tried))  # noqa: B023
                if outcomes.first()["outcome"] == "indexed":
                    store.rewrite(lifecycle.applied(held, outcomes, "now"))  # noqa: B023
                    store.flush()  # noqa: B023

            timed = {name: measure(run, iterations, warm_up)["median"] for name, run in phases.items()}
            out.append({"case": case, "chars": chars, "entries": entries, **timed, "total": measure(whole, iterations, warm_up)["median"]})
    return out


def formats(spark: SparkSession, entries: int, dim: int = DIM, iterations: int = ITERATIONS, warm_up: int = WARM_UP) -> dict:
    """An index as inline JSON, as int8 sidecar with its root, and as a Parquet version: bytes, and median ms to write and to read; and of the codecs by themselves."""
    index = saved(synthetic.seed_index(spark, entries, dim))
    vectors = np.array([r["embedding"] for r in index.select("embedding").orderBy("position").collect()])  # a benchmark's own, a few thousand
    folder = f"{shared_folder(spark)}/formats-{entries}-{time.time_ns()}"
    text, binary = json.dumps(vectors.tolist()).encode(), sidecar.encode(vectors, dim)

    def legacy():
        held = [r.asDict() for r in index.select("id", "embedding", F.col("content_hash").alias("contentHash"), F.col("updated_at").alias("updatedAt")).collect()]
        sidecar._put(spark, f"{folder}/old/data.json", [json.dumps({"schemaVersion": 1, "index": held}).encode()])

    count = lambda df: df.agg(F.sum(F.size("embedding"))).collect()
    ways = {
        "json": (legacy, lambda: count(sidecar.read_legacy(spark, f"{folder}/old/data.json")), "old"),
        "sidecar": (lambda: sidecar.write(index, f"{folder}/new"), lambda: count(sidecar.read(spark, f"{folder}/new")), "new"),
        "parquet": (lambda: sidecar.write_version(index, f"{folder}/versions", 1), lambda: count(sidecar.read_version(spark, f"{folder}/versions", 1)), "versions"),
    }
    fs, path = spark._jvm.org.apache.hadoop.fs.FileSystem, spark._jvm.org.apache.hadoop.fs.Path
    out: dict = {"entries": entries, "dim": dim, "encode_ms": {}, "decode_ms": {}, "bytes": {}, "write_ms": {}, "read_ms": {}}
    out["encode_ms"] = {"json": measure(lambda: json.dumps(vectors.tolist()), iterations, warm_up)["median"], "int8": measure(lambda: sidecar.encode(vectors, dim), iterations, warm_up)["median"]}
    out["decode_ms"] = {"json": measure(lambda: np.array(json.loads(text)), iterations, warm_up)["median"], "int8": measure(lambda: sidecar.decode(binary), iterations, warm_up)["median"]}
    out["vector_bytes"] = {"json": len(text), "int8": len(binary), "float32": entries * dim * 4}
    for name, (write, read, where) in ways.items():
        out["write_ms"][name] = measure(write, iterations, warm_up)["median"]
        out["read_ms"][name] = measure(read, iterations, warm_up)["median"]
        out["bytes"][name] = fs.get(spark._jvm.java.net.URI(folder), spark._jsc.hadoopConfiguration()).getContentSummary(path(f"{folder}/{where}")).getLength()
    return out
