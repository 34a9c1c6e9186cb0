"""Every query of the library against its SQL in DuckDB, at the smallest size."""

import ast
from pathlib import Path

import duckdb
import pytest

from nearfield.plans import catalog
from nearfield.sources import synthetic

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def text_of(i, chars=1200):
    """The body of a synthetic note, with a stream of numbers made one by one."""
    state, parts = (0x2000 + i) % 2**32, []

    def draw():
        nonlocal state
        state = (state + 0x6D2B79F5) % 2**32
        t = (state ^ state >> 15) * (1 | state) % 2**32
        t ^= (t + (t ^ t >> 7) * (61 | t)) % 2**32
        return (t ^ t >> 14) / 2**32

    while len("".join(parts)) < chars:
        n = 8 + int(draw() * 12)
        parts.append(" ".join(synthetic.FILLER[int(draw() * len(synthetic.FILLER))] for _ in range(n)) + ". " + ("\n\n" if draw() < 0.15 else ""))
    return "".join(parts)[:chars]


def plain(rows):
    same = lambda v: round(float(v), 9) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return sorted((tuple(map(same, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name == "synthetic_notes":  # the one query without SQL; its numbers are prng_mulberry32's
        assert [r[0] for r in got] == sorted(f"note-{i}.md" for i in range(50)) and columns == ["id", "markdown", "title"]
        assert all(m == "# Synthetic note\n\n" + text_of(int(i[5:-3])) for i, m, _ in got)
        return
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    assert got == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", ["prepare_status", "index_outcome"])
def test_rejected_notes(spark, tmp_path, name):
    """Texts that are blank, null or without a letter or digit, some of them labelled and some ignored, give what the SQL says."""
    odd = ["--- !!", "", " \n", "**", None, "| | |\n|-|-|", "###", "plain words"]
    rows = [(500 + i, t, "en", f"src{i % 3 * 5}" if i % 2 else "src3", len(t or "")) for i, t in enumerate(odd * 3)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    docs.union(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(500 + i, 1, 0) for i in range(0, 24, 2)] + [(507, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    assert got == plain(c.sql(catalog.SQL[name]).project(", ".join(columns)).fetchall())


def test_legacy_root_has_all_rows(spark):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert n > 200
    assert catalog.QUERIES["read_legacy"](spark, DATA).count() == n
    assert catalog.QUERIES["migrate_v1"](spark, DATA).select("id").distinct().count() == n


def test_nothing_else_imports_llm():
    for path in (Path(__file__).parent.parent / "nearfield").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n or "corpus_pipeline" in n for n in names), path
