"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embdup, media, mixing, neardup, packing, passages, pii, quality, sharding, substrings


def queries() -> dict:
    return {
        "op1_sharding": sharding.query,
        "op2_packing": packing.query,
        "op3_quality": quality.query,
        "op4_mixing": mixing.query,
        "op5_passages": passages.query,
        "op6_neardup": neardup.query,
        "op7_embdup": embdup.query,
        "op8_pii": pii.query,
        "op9_media": media.query,
        "op10_substrings": substrings.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.SQL, "op4_mixing": mixing.SQL, "op6_neardup": neardup.SQL, "op7_embdup": embdup.SQL}
