"""Notes, candidates and other views over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame) -> DataFrame:
    """df, dealt anew if its files give fewer partitions than there are cores, as a small file does. Larger tables aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "documents").select("doc_id", "text"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, markdown): documents as notes, their source being the folder."""
    d = spread_out(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return d.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("id"), F.col("doc_id").cast("string").alias("title"), F.col("text").alias("markdown"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id) with basenames that repeat and several extensions."""
    d = table(spark, sf_dir, "documents")
    ending = F.when(F.col("doc_id") % 7 == 0, ".MD").when(F.col("doc_id") % 11 == 0, ".txt").otherwise(".md")
    return d.select(F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 100), F.lit("/n"), F.col("doc_id") % 400, ending).alias("id"))


def index_candidates(files: DataFrame, recent: DataFrame) -> DataFrame:
    """files(id, modified_at) with recent_open_rank, an id's place in the list recent(id, recent_open_rank)."""
    return files.join(recent.groupBy("id").agg(F.min("recent_open_rank").alias("recent_open_rank")), "id", "left")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("id"), "doc_id", "n_chars")
    recent = d.where("doc_id < 20").select("id", F.col("doc_id").cast("int").alias("recent_open_rank"))
    return index_candidates(d.select("id", F.col("n_chars").alias("modified_at")), recent)


def indexed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): labelled documents, ids without a document, and some ids again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    known = table(spark, sf_dir, "labels").select("doc_id").join(d, "doc_id")
    ids = known.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("id"))
    again = known.where("doc_id % 10 = 0").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("id"))
    return ids.unionByName(again).unionByName(known.where("doc_id % 9 = 0").select(F.concat(F.lit("gone/"), "doc_id", F.lit(".md")).alias("id")))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("n"), F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(".md")).alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.lpad(F.lower(F.hex(F.col("vec_id"))), 8, "0").alias("content_hash"),
        F.lit("1970-01-01T00:00:00.000Z").alias("updated_at"),
        F.col("vec_id").alias("position"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, reason, seq): events as queue calls."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    reason = F.when(kind == "click", "open").when(kind == "error", "edit").when(kind == "purchase", "manual").otherwise("seed")
    return e.select(F.col("user_id").cast("string").alias("id"), reason.alias("reason"), F.col("event_id").alias("seq"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("src1",), ("src2/",), ("\\src3\\",), ("/src4/4.md",), ("  ",), ("src5/5.md",)], "rule string")


def lookup(notes_df: DataFrame, note_id: str) -> DataFrame:
    return notes_df.where(F.col("id") == note_id)
