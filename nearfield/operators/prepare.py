"""From notes to prepared texts, chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from queue import Empty, Queue
from threading import Thread

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    ignored_paths: tuple[str, ...] = field(default_factory=tuple)
    initial_index_completed: bool = False
    advanced_open: bool = False
    max_raw_chars: int = 20000
    max_extracted_chars: int = 4800
    max_chunks: int = 32
    title_weight: int = 3


def prepare(ids: DataFrame, notes: DataFrame, settings: Settings = Settings(), extract: Callable[[Column], Column] = T.markdown_to_text, rejected_text: bool = False) -> DataFrame:
    """(id, status, reason, prepared_text, chunks, warnings) for each of ids(id), from notes(id, title, markdown).

    An id without a note is rejected as missing-note, one without text, or with a null one, as empty-content, one without a letter
    or digit as non-semantic-content. The limits depend on columns known before any vector is made, so
    a vector is computed only for rows that are ready. With ``rejected_text``, rejected notes too have the text
    that was judged, title included; it is null only without a note or with a null one.
    """
    df = ids.select("id").join(notes.select("id", "title", "markdown", F.lit(True).alias("__found")), "id", "left")
    title = T.normalize_whitespace(F.coalesce("title", F.lit("")))
    weigh = lambda body: T.let(T.title_weight(body, title, settings.title_weight), lambda w: cut(body, w))

    def cut(body: Column, weighted: Column) -> Column:
        return T.let(T.truncate(weighted, settings.max_extracted_chars), lambda t: F.struct(body.alias("body"), T.is_truncated(weighted, settings.max_extracted_chars).alias("cut"), t.alias("text"), T.chunks(t).alias("chunks")))

    body = T.normalize_whitespace(extract(T.truncate(F.coalesce("markdown", F.lit("")), settings.max_raw_chars)))
    df = T.computed(df, "__p", T.let(body, weigh))
    df = df.select("*", *[F.col(f"__p.{c}").alias(f"__{c}") for c in ("body", "cut", "text", "chunks")])
    reason = (
        F.when(F.col("__found").isNull(), "missing-note")
        .when(F.col("__body") == "", "empty-content")
        .when(~T.has_semantic_content(F.col("__body")), "non-semantic-content")
        .when(F.size("__chunks") == 0, "empty-content")
    )
    raw = F.coalesce(T.is_truncated(F.col("markdown"), settings.max_raw_chars), F.lit(False))
    ready = F.col("reason").isNull()
    warnings = F.array_compact(
        F.array(
            F.when(raw, "raw-markdown-truncated"),
            F.when(ready & F.col("__cut"), "prepared-text-truncated"),
            F.when(ready & (F.size("__chunks") > settings.max_chunks), "chunk-limit-reached"),
        )
    )
    return df.withColumn("reason", reason).select(
        "id",
        F.when(ready, "ready").otherwise("reject").alias("status"),
        "reason",
        F.when(F.col("markdown").isNotNull() if rejected_text else ready, F.col("__text")).alias("prepared_text"),
        F.when(ready, F.slice("__chunks", 1, settings.max_chunks)).alias("chunks"),
        warnings.alias("warnings"),
    )


def letter_vectors(prepared: DataFrame, key: str = "id", chunks: str = "chunks") -> DataFrame:
    """(key, embedding) by a stand-in embedder: how often each letter of a-z occurs in a chunk, averaged over a row's chunks. Rows without chunks are left out."""
    rows = prepared.select(key, F.explode(chunks).alias("__c"))
    counts = [F.avg(F.length("__c") - F.length(F.replace(F.col("__c"), F.lit(c), F.lit("")))).alias(f"__{c}") for c in LETTERS]
    return rows.groupBy(key).agg(*counts).select(key, F.array(*[f"__{c}" for c in LETTERS]).alias("embedding"))


def within(seconds: float | None, call: Callable, *args):
    """call(*args), or TimeoutError after so many seconds; the call itself can't be stopped and is left to end by itself."""
    if seconds is None:
        return call(*args)
    box: Queue = Queue()

    def run():
        try:
            box.put((True, call(*args)))
        except Exception as e:  # handed to the caller below
            box.put((False, e))

    Thread(target=run, daemon=True).start()
    try:
        ok, value = box.get(timeout=seconds)
    except Empty:
        raise TimeoutError(f"no answer in {seconds} s") from None
    if not ok:
        raise value
    return value


def _attempt(model: Callable[[list[str]], list], texts: list[str], attempts: int, seconds: float | None) -> list:
    for left in reversed(range(attempts)):
        try:
            return within(seconds, model, texts) if texts else []
        except Exception:
            if not left:
                raise
    raise ValueError("attempts must be 1 or more")


def embed_udf(load: Callable[[], Callable[[list[str]], list]], attempts: int = 3, seconds: float | None = 10):
    """A pandas UDF, text -> array<double>, around a model. load() runs once for each task and returns a batch function; a batch that fails or takes longer than ``seconds`` is tried again, up to attempts times. Blank texts give null."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            known = texts[texts.fillna("").str.strip() != ""]
            vectors = dict(zip(known.index, _attempt(model, known.tolist(), attempts, seconds), strict=True))
            yield pd.Series([vectors.get(i) for i in texts.index], dtype=object)

    return embed


def tried_udf(load: Callable[[], Callable[[list[str]], list]], attempts: int = 3, seconds: float | None = 10):
    """A pandas UDF, text -> (vector, error): as embed_udf(), but a text that fails by itself has an error, and the others of its batch their vectors."""

    @F.pandas_udf("vector array<double>, error string")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            try:
                out = [(v, None) for v in _attempt(model, texts.tolist(), attempts, seconds)]
            except Exception:
                out = []
                for t in texts:
                    try:
                        out.append((_attempt(model, [t], attempts, seconds)[0], None))
                    except Exception as e:
                        out.append((None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["vector", "error"])

    return embed


def letters_tried(chunk: Column) -> Column:
    """The stand-in embedder of letter_vectors() in the form of tried_udf(), by expressions."""
    vector = F.array(*[(F.length(chunk) - F.length(F.replace(chunk, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    return F.struct(vector.alias("vector"), F.lit(None).cast("string").alias("error"))


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, value): the mean of each component over a key's vectors, which weigh the same. Null and empty vectors don't count.

    Components are summed within each partition before the shuffle, which moves a row for each key, component and partition.
    """
    rows = df.where(F.size(vector) > 0).select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    return rows.groupBy(key, "pos").agg(F.avg("x").alias("value"))


def embed_chunks(prepared: DataFrame, embed, key: str = "id", chunks: str = "chunks") -> DataFrame:
    """(key, embedding): pooled vectors of a per-chunk embedder such as embed_udf()'s."""
    vectors = prepared.select(key, F.explode(chunks).alias("chunk")).select(key, embed("chunk").alias("v"))
    pooled = mean_pool(vectors, key, "v").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return pooled.select(key, F.transform("v", lambda x: x["value"]).alias("embedding"))
