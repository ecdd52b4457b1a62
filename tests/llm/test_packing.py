from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from telar.llm.packing import fill_report, harmonic, pack


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.lists(st.integers(1, 300), max_size=120))
def test_harmonic_never_overfills(capacity, sizes):
    sizes = np.array([min(s, capacity) for s in sizes], np.int64)
    bins = harmonic(sizes, capacity)
    used = defaultdict(int)
    for b, s in zip(bins, sizes):
        used[b] += s
    assert all(b >= 0 for b in bins) and all(u <= capacity for u in used.values())


def test_little_room_is_left():
    rng = np.random.default_rng(5)
    for capacity in (512, 2048, 8192):
        sizes = np.minimum(rng.lognormal(5.4, 0.8, 20_000).astype(np.int64) + 1, capacity)
        assert sizes.sum() / (len(set(harmonic(sizes, capacity))) * capacity) > 0.98


def test_pieces(spark):
    docs = spark.createDataFrame([(1, 5, "a"), (2, 25, "b"), (3, 10, None), (4, 0, "c"), (5, None, "d"), (6, 5, "e"), (6, 5, "e")], "id long, size int, bin string")
    boxes = spark.createDataFrame([("caja", 10), ("caja", 10), ("nula", None), ("cero", 0), ("gran", 1000)], "nombre string, cap int")
    rows = pack(docs, boxes, "id", "size", "nombre", "cap").collect()
    assert {r.container for r in rows} == {"caja", "gran"}
    used, tokens = defaultdict(int), defaultdict(int)
    for r in rows:
        used[r.container, r.bin] += r.size
        tokens[r.container, r.id] += r.size
        assert r.to_token - r.from_token == r["size"] > 0
    assert all(u <= (10 if c == "caja" else 1000) for (c, _), u in used.items())
    for c in ("caja", "gran"):
        assert {i: tokens[c, i] for i in (1, 2, 3, 6)} == {1: 5, 2: 25, 3: 10, 6: 10}
    cut = sorted((r.part, r.from_token, r.to_token) for r in rows if r.container == "caja" and r.id == 2)
    assert cut == [(0, 0, 10), (1, 10, 20), (2, 20, 25)]
    assert [r.part for r in rows if r.container == "gran" and r.id == 2] == [0]
    report = {r.container: r for r in fill_report(pack(docs, boxes, "id", "size", "nombre", "cap"), boxes.where("cap > 0"), "nombre", "cap").collect()}
    assert report["caja"].tokens == 50 and report["caja"].fullest == 10


def test_empty(spark):
    docs = spark.createDataFrame([], "id long, size int")
    boxes = spark.createDataFrame([("caja", 10)], "nombre string, cap int")
    assert pack(docs, boxes, "id", "size", "nombre", "cap").count() == 0
    assert pack(spark.createDataFrame([(1, 3)], "id long, size int"), boxes.limit(0), "id", "size", "nombre", "cap").count() == 0


def test_a_very_long_item_is_many_buckets(spark):
    """An item of 5 * 10^7 tokens among small ones: every token once, no container too full, no bucket of all its parts."""
    docs = spark.createDataFrame([(0, 50_000_000)] + [(i, 100 + i) for i in range(1, 101)], "id long, size long")
    boxes = spark.createDataFrame([("corto", 512), ("largo", 8192)], "nombre string, cap int")
    packed = pack(docs, boxes, "id", "size", "nombre", "cap").cache()
    buckets = packed.selectExpr("container", "split(bin, '-')[0] as b").groupBy("container", "b").count().collect()
    assert max(r["count"] for r in buckets) < 50_000 and len([r for r in buckets if r.container == "corto"]) >= 4
    bins = packed.groupBy("container", "bin").agg({"size": "sum"}).groupBy("container").max("sum(size)").collect()
    assert {r[0]: r[1] for r in bins} == {"corto": 512, "largo": 8192}
    whole = packed.groupBy("container", "id").agg({"size": "sum", "from_token": "min", "to_token": "max"}).collect()
    sizes = {r.id: r["size"] for r in docs.collect()}
    assert len(whole) == 202 and all(r["sum(size)"] == r["max(to_token)"] == sizes[r.id] and r["min(from_token)"] == 0 for r in whole)


def test_every_token_of_the_test_table_once(spark):
    from pathlib import Path

    import pytest

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test tables")
    from telar.llm.queries import _tokens, p8_contenedores

    tokens = {r.doc_id: r.tokens for r in _tokens(spark, data).where("tokens > 0").collect()}
    room = {r.nombre: r.capacidad_tokens for r in spark.read.parquet(f"{data}/contenedores.parquet").collect()}
    placed, used = defaultdict(int), defaultdict(int)
    for r in p8_contenedores(spark, data).collect():
        placed[r.nombre, r.doc_id] += r.tokens
        used[r.nombre, r.contenedor] += r.tokens
        assert r.hasta - r.desde == r.tokens and (r.parte == 0 or tokens[r.doc_id] > room[r.nombre])
    assert placed == {(n, d): t for n in room for d, t in tokens.items()}
    assert all(u <= room[n] for (n, _), u in used.items())
