import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import text as T


def one(spark, value, use):
    return spark.createDataFrame([(value,)], "x string").select(use(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("value", "digits"), [("Sample text", "429b9d1e"), ("", "811c9dc5"), (None, None)])
def test_hash(spark, value, digits):
    assert one(spark, value, T.content_hash) == digits


def test_hash_counts_utf16_units(spark):
    def plain(s):
        h = 2166136261
        for u in np.frombuffer(s.encode("utf-16-le"), "<u2").tolist():
            h = (h ^ u) * 16777619 % 2**32
        return f"{h:08x}"

    values = ["a😀b", "é", "x" * 1000, "日本語", "𝒳"]
    got = spark.createDataFrame([(v,) for v in values], "x string").select("x", T.content_hash("x").alias("h")).collect()
    assert {r["x"]: r["h"] for r in got} == {v: plain(v) for v in values}


@pytest.mark.parametrize(("length", "count"), [(0, 0), (1, 1), (199, 1), (200, 1), (201, 2), (344, 2), (345, 3), (1200, 8), (2400, 17), (4664, 32), (4665, 33), (4800, 33)])
def test_chunk_counts(spark, length, count):
    assert len(one(spark, "x" * length, T.chunks)) == count


def test_chunks_overlap_and_are_trimmed(spark):
    text = "".join(chr(97 + i % 26) for i in range(500))
    got = one(spark, "  " + text + " ", T.chunks)
    assert got == [text[0:200], text[144:344], text[288:488], text[432:]]
    assert one(spark, None, T.chunks) == []
    with pytest.raises(ValueError):
        T.chunks(F.lit("x"), 10, 10)


def test_white_space(spark):
    assert one(spark, " a \tb﻿\n", T.normalize_whitespace) == "a b"
    assert one(spark, "a​b\u0085c", T.normalize_whitespace) == "a​b\u0085c"


def test_table(spark):
    table = "| Name | Age | City |\n|---|---|---|\n| Alice | 30 | Paris |\n| Bob | 25 | London |"
    said = "Name: Alice, Age: 30, City: Paris. Name: Bob, Age: 25, City: London"
    assert one(spark, table, T.table_to_text) == said
    assert one(spark, "before\n" + table + "\nafter", T.table_to_text) == f"before\n{said}\nafter"
    assert one(spark, "a | b", T.table_to_text) == "a | b"
    apart = "| a |\n\n|-|\n| $1 |"
    assert one(spark, apart, T.table_to_text) == apart
    assert one(spark, "| a |\n|-|\n| $1 |", T.table_to_text) == "a: $1"


def test_markdown(spark):
    note = "---\ntitle: x\n        ---\nThis is a **bold** line with an [[Internal Link]] and [[Alias|shown]]."
    assert one(spark, note, T.markdown_to_text) == "This is a bold line with an Internal Link and Alias."


@pytest.mark.parametrize(("path", "stripped", "name"), [("test.md", "test", "test"), ("dir/test.MD", "dir/test", "test"), ("dir/test", "dir/test", "test")])
def test_paths(spark, path, stripped, name):
    assert one(spark, path, T.strip_md) == stripped
    assert one(spark, path, T.basename) == name


def test_rules(spark):
    assert one(spark, "a/\n\\b\\c\n\n  \na\n/ d /", T.parse_ignored_paths) == ["a", "b/c", "d"]
