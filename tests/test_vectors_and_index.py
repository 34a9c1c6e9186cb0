import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import vector as V
from nearfield.operators import index as I
from nearfield.operators import search as S
from nearfield.sources import sidecar, synthetic

COLUMNS = "id string, embedding array<double>, content_hash string, updated_at string, position long"


def index(spark, *ids):
    return spark.createDataFrame([(i, [1.0, float(k)], f"h{k}", "t", k) for k, i in enumerate(ids)], COLUMNS)


def test_quantize_edges(spark):
    x = [0.5 / 127, -0.5 / 127, -1.5 / 127, 1.0, 9.0, -9.0, math.nan, math.inf, -math.inf]
    df = spark.createDataFrame([(x,)], "v array<double>")
    assert df.select(V.quantize(F.col("v"))).first()[0] == [1, 0, -1, 127, 127, -127, 0, 127, -127]
    assert list(sidecar.encode(np.array(x), 9)[16:]) == [b % 256 for b in (1, 0, -1, 127, 127, -127, 0, 127, -127)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0])], "a array<double>, z array<double>, s array<double>")
    assert df.select(V.cosine(F.col("a"), F.col("z"))).first()[0] == 0
    assert df.select(V.normalize(F.col("z"))).first()[0] == [0, 0]
    with pytest.raises(Exception, match="different lengths"):
        df.select(V.dot(F.col("a"), F.col("s"))).collect()


def test_related(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0, 1.0]), ("d", [-1.0, 0.0]), ("e", [math.nan, 0.0]), ("f", [1.0, 0.0])], "id string, embedding array<double>")
    got = [(r["id"], round(r["score"], 4)) for r in S.related_by_id(rows, "a", limit=10).collect()]
    assert got == [("b", 1), ("f", 1), ("c", 0.7071)]
    assert S.related_by_id(rows, "a", limit=0).count() == 0
    assert S.related_by_id(rows, "none").count() == 0
    with pytest.raises(ValueError):
        S.related_by_id(rows, "a", limit=-1)
    for block in (2, 4096):
        every = S.related_all(rows.where("id <> 'e'"), limit=2, block=block).where("query_id = 'a'").orderBy("rank").collect()
        assert [r["id"] for r in every] == ["b", "f"]


def test_upsert_keeps_places(spark):
    old = index(spark, "a", "b", "a")
    new = spark.createDataFrame([("b", [0.0], "n1", "t", 0), ("c", [0.0], "n2", "t", 1), ("b", [0.0], "n3", "t", 2)], COLUMNS)
    got = I.upsert(old, new).orderBy("position").select("id", "content_hash").collect()
    assert [tuple(r) for r in got] == [("a", "h2"), ("b", "n3"), ("c", "n2")]
    again = I.upsert(I.upsert(old, new), new).orderBy("position").select("id", "content_hash").collect()
    assert got == again


@pytest.mark.parametrize(("old", "new", "want"), [("a", "c", ["b", "c"]), ("x", "y", ["a", "b", "c"]), ("a", "a", ["a", "b", "c"]), ("a", "z", ["b", "c", "z"])])
def test_rename(spark, old, new, want):
    got = I.rename(index(spark, "a", "b", "c"), old, new).orderBy("position")
    assert [r["id"] for r in got.collect()] == want


def test_pack_rows(spark):
    got = I.pack_rows(index(spark, "n2", "a", "n10", "n1")).orderBy("row").collect()
    assert [(r["id"], r["row"]) for r in got] == [("a", 0), ("n1", 1), ("n10", 2), ("n2", 3)]


def test_sidecar(spark, tmp_path):
    folder = str(tmp_path / "s")
    sidecar.write(index(spark, "b", "a"), folder)
    data = (tmp_path / "s" / "embeddings.bin").read_bytes()
    assert data[:4].hex() == "424d4953" and len(data) == 16 + 2 * 2
    assert [(r["id"], r["content_hash"], r["position"]) for r in sidecar.read(spark, folder).orderBy("position").collect()] == [("a", "h1", 0), ("b", "h0", 1)]
    assert not sidecar.needs_rebuild(spark, folder).first()[0]
    (tmp_path / "s" / ".embeddings.bin.crc").unlink()
    (tmp_path / "s" / "embeddings.bin").write_bytes(data[:-1])
    assert sidecar.needs_rebuild(spark, folder).first()[0] and sidecar.read(spark, folder).count() == 0
    (tmp_path / "s" / "embeddings.bin").unlink()
    assert sidecar.needs_rebuild(spark, folder).first()[0] and sidecar.read(spark, folder).count() == 0
    assert sidecar.decode(b"") is None and sidecar.decode(data[:17]) is None


def test_header_only_for_no_rows():
    assert len(sidecar.encode(np.zeros(0), 4)) == 16
    with pytest.raises(ValueError):
        sidecar.encode(np.zeros(5), 4)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=20))
def test_round_trip_is_stable(values):
    once = sidecar.decode(sidecar.encode(np.array(values), len(values)))
    assert (sidecar.decode(sidecar.encode(once, len(values))) == once).all()


def test_numbers():
    def stream(a, n):
        out = []
        for _ in range(n):
            a = (a + 0x6D2B79F5) % 2**32
            t = (a ^ a >> 15) * (1 | a) % 2**32
            t ^= (t + (t ^ t >> 7) * (61 | t)) % 2**32
            out.append((t ^ t >> 14) / 2**32)
        return out

    assert synthetic.numbers(0x5EED, 0, 50).tolist() == stream(0x5EED, 50)
    assert synthetic.numbers(0x5EED, 20, 30).tolist() == stream(0x5EED, 50)[20:]
    assert len(synthetic.body(500, 3)) == 500 and synthetic.body(500, 3) == synthetic.body(500, 3)
