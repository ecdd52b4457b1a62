import random

import pytest
from pyspark.sql import functions as F

from telar.operators import governance as ops
from telar.operators import vectors


def test_checks(spark, rows):
    d = spark.createDataFrame([("a", 1), (None, 2), ("c", None)], "k string, n int")
    assert rows(ops.check_rows(d, {"k": F.col("k").isNotNull(), "n": F.col("n") > 0, "todo": F.lit(True)})) == [("k", 1, 3, "error"), ("n", 1, 3, "error"), ("todo", 0, 3, "ok")]
    assert rows(ops.check_rows(d.limit(0), {"k": F.col("k").isNotNull()})) == [("k", 0, 0, "ok")]
    sets = {"x": spark.createDataFrame([("a",), ("b",), (None,)], "v string"), "y": spark.createDataFrame([("b",), ("c",)], "w string")}
    assert rows(ops.set_differences(sets)) == [("x", "y", "a"), ("y", "x", "c")]


def test_fixpoint_and_closure(spark, rows):
    claims = spark.createDataFrame([(i, i == 1) for i in range(1, 9)], "id int, f boolean")
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (6, 7), (7, 6), (8, 99)], "claim int, base int")
    assert rows(ops.fallen(claims, edges, "id", "f")) == [(1, True), (2, True), (3, True), (4, False), (5, False), (6, False), (7, False), (8, True)]
    assert rows(ops.bases(spark.createDataFrame([(3, 2), (2, 1), (4, 3), (6, 7), (7, 6)], "claim int, base int"))) == [
        (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3), (6, 6), (6, 7), (7, 6), (7, 7),
    ]
    assert ops.bases(edges.limit(0)).count() == 0 and ops.fallen(claims.limit(0), edges.limit(0), "id", "f").count() == 0


def test_long_chains_and_random_graphs(spark, rows):
    n = 1500
    claims = spark.range(n).select("id", (F.col("id") == 100).alias("f"))
    got = rows(ops.fallen(claims, spark.range(1, n).select(F.col("id").alias("claim"), (F.col("id") - 1).alias("base")), "id", "f").where("falls").agg(F.count("id"), F.min("id")))
    assert got == [(n - 100, 100)]
    rng = random.Random(3)
    for most in (1, 2):
        nodes = range(60)
        edges = {(i, rng.randrange(62)) for i in nodes for _ in range(rng.randint(0, most)) if rng.random() < 0.8}
        bad = set(rng.sample(nodes, 2))
        want = bad | {i for i, b in edges if b >= 60}
        while more := {i for i, b in edges if b in want} - want:
            want |= more
        got = ops.fallen(spark.createDataFrame([(i, i in bad) for i in nodes], "id int, f boolean"), spark.createDataFrame(sorted(edges), "claim int, base int"), "id", "f")
        assert {r.id for r in got.where("falls").collect()} == want


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.range(1, 40).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    with pytest.raises(RuntimeError):
        vectors.components(edges, spark.range(40), "id", 1)
    with pytest.raises(RuntimeError):
        ops.bases(edges.toDF("base", "claim"), 1)


def test_windows_caps_and_logs(spark, rows):
    d = spark.createDataFrame([(1, "2026-06-30"), (2, "2026-06-01"), (3, None), (4, "2026-01-01"), (5, "2026-08-01")], "id int, s string").withColumns({"f": F.to_timestamp("s"), "fin": F.lit("2026-07-01").cast("timestamp")})
    pick = lambda least: rows(ops.widened_window(d, F.col("f"), F.col("fin"), 3, 40, least).select("id", "used_days", "excluded"))
    assert pick(1) == [(1, 3, None), (2, 3, "fuera_de_ventana"), (3, 3, "sin_fecha"), (4, 3, "fuera_de_ventana"), (5, 3, "fuera_de_ventana")]
    assert [r[2] for r in pick(2)] == [None, None, "sin_fecha", "fuera_de_ventana", "fuera_de_ventana"]
    log = spark.createDataFrame([("c", 1, "nuevo", 4.0), ("c", 2, "listo", 4.0), ("c", 3, "nuevo", 4.0)], "k string, o int, s string, x double")
    assert rows(ops.transitions(log, ["k"], ["o"], "s", [("nuevo", "listo")]).select("o", "allowed")) == [(1, True), (2, True), (3, False)]
    assert rows(ops.under_cap(log, ["k"], ["o"], "x", 8.0).select("o", "allowed")) == [(1, True), (2, True), (3, False)]
    r = spark.createDataFrame([("a", "parcial"), ("a", "vacio"), ("b", "otro"), ("b", "parcial"), ("c", None)], "k string, r string")
    assert rows(ops.first_reason(r, ["k"], "r", ["vacio", "parcial"])) == [("a", "vacio"), ("b", "parcial")]


def test_conflicts_scans_and_injection(spark, rows):
    d = spark.createDataFrame([("g", "famil", 12.0), ("g", "famil", 12.0), ("g", "famil", 40.0), ("g", "casas", 1.0), ("h", "famil", 5.0), ("g", "", 9.0), ("g", "famil", None)], "k string, u string, v double")
    assert rows(ops.conflicting_values(d, ["k"], "u", "v")) == [("g", "famil", 12.0, 2, 40.0, 1)]
    t = spark.createDataFrame([("clave=abc", None), ("x", "clave=1")], "a string, b string")
    assert rows(ops.secret_scan(t, ["a", "b"], {"clave": "clave=", "nada": "zz"})) == [("a", "clave", 1), ("b", "clave", 1)]
    n, extra = spark.createDataFrame([("N-1", 1), ("SYN-1", 9), (None, 2)], "id string, v int"), spark.createDataFrame([("SYN-1", 5)], "id string, v int")
    once = ops.inject(n, extra, "id", "SYN-")
    assert rows(once) == rows(ops.inject(once, extra, "id", "SYN-")) == [("N-1", 1), ("SYN-1", 5), (None, 2)]
    assert ops.new_rejections(spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(1,), (1,), (3,)], "x int")).count() == 2
