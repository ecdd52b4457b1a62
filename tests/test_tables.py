import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.operators import tables as ops


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_merging(spark, rows):
    d = df(spark, [("a", 2, None, "x"), ("a", 1, None, None), ("a", 3, "p", "y"), ("b", 1, None, None)], "k string, o int, u string, v string")
    assert rows(ops.merge_first_non_null(d, ["k"], [F.col("o")], ["u", "v"])) == [("a", "p", "x"), ("b", None, None)]
    assert rows(ops.keep_fullest(d, ["k"], ["o"])) == [("a", 3, "p", "y"), ("b", 1, None, None)]
    t = df(spark, [("k", "b| a"), ("k", "c||a"), ("k", None)], "k string, t string")
    assert t.groupBy("k").agg(ops.union_tokens(F.col("t"), "|", ["c"]).alias("t")).first().t == "c|a|b"


def test_counts(spark, rows):
    d = df(spark, [("a", "x"), ("a", "y"), ("a", None), ("b", "y")], "k string, v string")
    assert rows(ops.modal(d, ["k"], "v")) == [("a", "x", 1), ("b", "y", 1)]
    assert rows(ops.zero_filled(d, "k", df(spark, [("a",), ("z",)], "k string"))) == [("a", 3), ("z", 0)]
    assert rows(ops.null_profile(d)) == [("k", 4, 0, 2), ("v", 4, 1, 2)]
    assert [(r.v, r.n) for r in ops.concentration(d, "v", 2).collect()] == [("y", 2), ("(nulo)", 1)]
    assert rows(ops.cross_counts(d, "k", "v", ["x", "y"])) == [("a", 1, 1), ("b", 0, 1)]


def test_versions(spark, rows):
    old, new = df(spark, [(1, "a", None), (2, "b", "x"), (3, "c", "z")], "k int, u string, v string"), df(spark, [(1, "a", "q"), (2, "b", "x"), (4, "d", "w")], "k int, u string, v string")
    assert rows(ops.changed_values(old, new, ["k"], ["u", "v"])) == [(1, "v", None, "q")]
    assert rows(ops.version_diff(old.withColumn("h", F.coalesce("v", F.lit(""))), new.withColumn("h", F.coalesce("v", F.lit(""))), "k", "h")) == [(1, "changed"), (2, "equal"), (3, "missing"), (4, "new")]
    assert sorted(r.k for r in ops.upsert(old, new.drop("u"), ["k"]).collect()) == [1, 2, 3, 4]
    assert rows(ops.update_columns(old, new, ["k"], ["v"])) == [(1, "a", "q"), (2, "b", "x"), (3, "c", "z")]
    wider = ops.evolve(old, T.StructType().add("k", T.IntegerType()).add("w", T.DoubleType()))
    assert wider.columns == ["k", "u", "v", "w"] and wider.first().w is None
    assert rows(ops.first_valid(df(spark, [(1, "a", False), (2, "a", True), (3, "a", True)], "o int, k string, ok boolean"), F.col("ok"), ["k"], "o").select("o", "repeated")) == [(1, False), (2, False), (3, True)]


def test_anchored_split_is_not_a_session(spark, rows):
    day = lambda n: datetime(2026, 1, 1) + timedelta(days=n)
    d = df(spark, [("g", i, day(n)) for i, n in enumerate([1, 6, 11, 13, 8])] + [("g", 9, None), ("h", 1, None)], "k string, id int, t timestamp")
    assert rows(ops.anchored_split(d, ["k"], "t", "id", 7)) == [("g", 0, 1), ("g", 1, 1), ("g", 2, 2), ("g", 3, 2), ("g", 4, 1), ("g", 9, 1), ("h", 1, 1)]


def test_ranks(spark, rows):
    d = df(spark, [(1, 50.04, 0.2), (2, 49.96, 0.9), (3, 70.0, 0.1), (4, 10.0, None), (5, None, 0.5)], "id int, p double, u double")
    assert rows(ops.rank_with_ties(d, "p", "u", "id").select("id", "position", "ties")) == [(1, 3, 1), (2, 2, 1), (3, 1, 0), (4, 4, 0), (5, 5, 0)]
    assert rows(ops.tie_at_cut(df(spark, [(1,), (2,), (2,), (2,), (3,)], "x int"), "x", 2)) == [(2, 3, 1, 2)]
    assert rows(ops.average_rank(df(spark, [(5,), (7,), (7,), (9,)], "x int"), "x", "r")) == [(5, 1.0), (7, 2.5), (7, 2.5), (9, 4.0)]
    assert rows(ops.day_islands(df(spark, [("a", datetime(2026, 1, d)) for d in (1, 2, 2, 5)], "k string, d timestamp"), ["k"], "d").select("k", "days")) == [("a", 1), ("a", 2)]


def test_within_interval_against_brute_force(spark):
    rng = random.Random(4)
    t0 = datetime(2026, 1, 1)
    a = [(i, rng.choice("xy"), t0 + timedelta(seconds=rng.randrange(50_000))) for i in range(120)]
    b = [(i, rng.choice("xy"), t0 + timedelta(seconds=rng.randrange(50_000))) for i in range(80)]
    got = ops.within_interval(df(spark, a, "i int, k string, s timestamp"), df(spark, b, "j int, k string, t timestamp"), "k", "s", "t", 900)
    want = sorted((i, j) for i, k, s in a for j, m, t in b if k == m and abs(s - t) <= timedelta(seconds=900))
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_empty(spark):
    d = df(spark, [], "k string, id int, t timestamp, p double, u double")
    assert ops.anchored_split(d, ["k"], "t", "id", 7).count() == 0
    assert ops.rank_with_ties(d, "p", "u", "id").count() == 0
    assert ops.modal(d, ["k"], "id").count() == 0 and ops.tie_at_cut(d, "p", 3).count() == 0


def test_running_totals_and_places(spark):
    from telar.operators.prefix import places, running_before

    rng = random.Random(8)
    data = [(i, rng.randrange(50), rng.randrange(5)) for i in range(500)]
    d = df(spark, data, "id int, x int, v int")
    got = {r.id: r.b for r in running_before(d, [F.col("x"), F.col("id")], F.col("v"), "b").collect()}
    total = 0
    for i, _, v in sorted(data, key=lambda r: (r[1], r[0])):
        assert got[i] == total
        total += v
    assert sorted((r.id, r.p) for r in places(d, [-F.col("x"), F.col("id")], "p").collect()) == sorted((r[0], n) for n, r in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1))
    assert places(d.limit(0), [F.col("x")], "p").count() == 0


def test_percentiles_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), (None, 101), ("c", 40)) for v in rng.integers(0, 30, n)] + [("a", None), ("d", None)]
    got = {r.g: (r.p50, r.p9) for r in ops.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"p50": 0.5, "p9": 0.9}).collect()}
    for g in ("a", "b", "c", None):
        own = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(got[g], (np.quantile(own, 0.5), np.quantile(own, 0.9)))
    assert set(got) == {"a", "b", "c", None}
    assert ops.percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", {"p": 0.5}).count() == 0


def test_anchored_split_against_a_fold(spark):
    import random

    rng = random.Random(3)
    day = 86_400
    rows = [(rng.choice(["a", "b", None]), i, int(rng.choice([rng.random() * 90 * day, (rng.randrange(90) + 0.0) * day, rng.expovariate(1) * 5 * day]))) for i in range(300)]
    rows += [("c", 900 + i, i * 7 * day) for i in range(40)] + [("d", 950 + i, i * (7 * day + 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, id int, s long").withColumn("t", F.timestamp_seconds("s"))
    want = {}
    for k in {r[0] for r in rows}:
        anchor, part = None, 0
        for _, i, s in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]):
            if anchor is None or s - anchor > 7 * day:
                anchor, part = s, part + 1
            want[i] = part
    assert {r.id: r.part for r in ops.anchored_split(df, ["k"], "t", "id", 7).collect()} == want
