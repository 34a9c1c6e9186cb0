"""Synthetic inputs that a seed repeats: numbers, unit vectors, indexes and notes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Words of the filler text.
FILLER = (
    "river stone lantern harbour meadow copper window ladder garden market winter signal paper engine valley bridge candle forest island mirror "
    "narrow quiet heavy bright hollow early distant simple careful open turns keeps holds finds leaves brings carries follows answers measures "
    "under over beside without during before after between and of with to from into the a every some"
).split()


def numbers(seed: int, first: int, count: int) -> np.ndarray:
    """Numbers first to first + count of the mulberry32 stream of a seed, from 0 to below 1.

    Its state is a counter with a fixed step, so any stretch can be made on its own, all at once.
    """
    with np.errstate(over="ignore"):
        state = np.uint32(seed & 0xFFFFFFFF) + np.uint32(0x6D2B79F5) * np.arange(first + 1, first + count + 1, dtype=np.uint32)
        x = (state ^ (state >> np.uint32(15))) * (state | np.uint32(1))
        x ^= x + (x ^ (x >> np.uint32(7))) * (x | np.uint32(61))
        return (x ^ (x >> np.uint32(14))) / 4294967296.0


def random_numbers(spark: SparkSession, seed: int, count: int) -> DataFrame:
    """(i, x): the first count numbers of the stream."""

    def run(batches):
        for b in batches:
            i = b["id"].to_numpy()
            cuts = np.flatnonzero(np.diff(i) != 1) + 1
            for part in np.split(i, cuts) if len(i) else []:
                yield pd.DataFrame({"i": part, "x": numbers(seed, int(part[0]), len(part))})

    return spark.range(count).mapInPandas(run, "i long, x double")


def seed_index(spark: SparkSession, count: int, dim: int = 384, seed: int = 0x5EED) -> DataFrame:
    """An index of random unit vectors; each row takes its dim + 1 numbers of one stream."""

    def run(batches):
        for b in batches:
            rows = []
            for i in b["id"]:
                x = numbers(seed, int(i) * (dim + 1), dim + 1)
                v = x[:dim] * 2 - 1
                rows.append((f"seed-{i}.md", v / (np.sqrt((v * v).sum()) or 1), f"{int(x[dim] * 0xFFFFFFFF):08x}", "1970-01-01T00:00:00.000Z", i))
            yield pd.DataFrame(rows, columns=["id", "embedding", "content_hash", "updated_at", "position"])

    return spark.range(count).mapInPandas(run, "id string, embedding array<double>, content_hash string, updated_at string, position long")


def body(chars: int, seed: int) -> str:
    """Sentences of 8 to 19 words, one in seven or so ending a paragraph, cut at chars."""
    x = iter(numbers(seed, 0, 16 * (chars // 20 + 40)))
    parts, length = [], 0
    while length < chars:
        words = [FILLER[int(next(x) * len(FILLER))] for _ in range(8 + int(next(x) * 12))]
        parts.append(" ".join(words) + ". " + ("\n\n" if next(x) < 0.15 else ""))
        length += len(parts[-1])
    return "".join(parts)[:chars]


def synthetic_notes(spark: SparkSession, count: int, chars: int = 1200, seed: int = 0x2000) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = [f"note-{i}.md" for i in b["id"]]
            yield pd.DataFrame({"id": ids, "title": [f"Synthetic note {i}" for i in ids], "markdown": ["# Synthetic note\n\n" + body(chars, seed + int(i)) for i in b["id"]]})

    return spark.range(count).mapInPandas(run, "id string, title string, markdown string")
