"""Settings documents: defaults for what is missing or wrong, checks and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prepare import Settings

SCHEMA_VERSION = 2
#: Messages of the checks.
MESSAGES = [
    ("max_raw_chars", "Max raw markdown characters must be greater than 0."),
    ("max_extracted_chars", "Max extracted characters must be greater than 0."),
    ("max_chunks", "Max chunks must be greater than 0."),
    ("title_weight", "Title weight cannot be negative."),
]


def normalize_settings(df: DataFrame, defaults: Settings = Settings()) -> DataFrame:
    positive = lambda name: F.when(F.col(name) > 0, F.col(name)).otherwise(getattr(defaults, name))
    return df.withColumns(
        {
            "initial_index_completed": F.coalesce("initial_index_completed", F.lit(False)),
            "advanced_open": F.coalesce("advanced_open", F.lit(defaults.advanced_open)),
            **{name: positive(name) for name in ("max_raw_chars", "max_extracted_chars", "max_chunks")},
            "title_weight": F.when(F.col("title_weight") >= 0, F.col("title_weight")).otherwise(defaults.title_weight),
        }
    )


def normalize_plugin_data(df: DataFrame) -> DataFrame:
    """schema_version (1 if missing, 2 at most), embedding_dim (0 if missing or negative), and the completed flag, which an index without one implies."""
    return df.withColumns(
        {
            "schema_version": F.least(F.coalesce("schema_version", F.lit(1)), F.lit(SCHEMA_VERSION)),
            "embedding_dim": F.when(F.col("embedding_dim") >= 0, F.col("embedding_dim")).otherwise(0),
            "initial_index_completed": F.coalesce("initial_index_completed", F.col("n_index") > 0),
        }
    )


def validation_error() -> Column:
    """The first check that fails, else null."""
    out = F.lit(None).cast("string")
    for name, message in reversed(MESSAGES):
        out = F.when(F.col(name) < 0 if name == "title_weight" else F.col(name) <= 0, message).otherwise(out)
    return out


def error_of(settings: Settings) -> str | None:
    """validation_error() for one set of settings."""
    return next((message for name, message in MESSAGES if getattr(settings, name) < (0 if name == "title_weight" else 1)), None)


def parse_integer(text: Column) -> Column:
    """The whole number a text starts with, null without one."""
    return F.try_to_number(F.nullif(F.regexp_replace(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), r"^\+", ""), F.lit("")), F.lit("S999999999999999999")).cast("long")
