import numpy as np
import pytest
from pyspark.sql import functions as F

from telar.functions import dates, text
from telar.operators import metrics, records, vectors


def test_dates_are_refused_with_a_reason(spark):
    given = {
        "2026-06-02T13:15:17Z": ("2026-06-02T13:15:17Z", None), "2022-07-26 02:37:10-05:00": ("2022-07-26T07:37:10Z", None), "20260602T082358Z": ("2026-06-02T08:23:58Z", None),
        "2026-07-28 09:49:15": (None, "fecha_sin_zona_horaria"), "2026-07-25": (None, "fecha_sin_zona_horaria"), "2026-02-30T00:00:00Z": (None, "fecha_ilegible"), "2026-02-30": (None, "fecha_ilegible"),
        "ayer": (None, "fecha_ilegible"), "  ": (None, None), None: (None, None),
    }
    moment, reason = dates.zoned(F.col("t"))
    df = spark.createDataFrame([(t,) for t in given], "t string").select("t", dates.utc_text(moment).alias("f"), reason.alias("r"))
    assert {r.t: (r.f, r.r) for r in df.collect()} == given
    value, why = dates.number(F.col("t"))
    rows = spark.createDataFrame([("1.5e3",), ("inf",), (" -.5 ",), ("1d",), ("",), (None,)], "t string").select(value.alias("v"), why.alias("w")).collect()
    assert [(r.v, r.w) for r in rows] == [(1500.0, None), (None, "no_numerico"), (-0.5, None), (None, "no_numerico"), (None, None), (None, None)]


def test_identifiers_are_resolved_by_prefix(spark):
    a = spark.createDataFrame([("A-1", 2, "u2", "dos"), ("A-1", 1, "u1", "uno"), ("A-2", 1, None, None)], "k string, o int, u string, l string")
    b = spark.createDataFrame([("B-1", 1, "w", "be"), ("A-9", 1, "x", "ajena")], "k string, o int, u string, l string")
    make = lambda n, p, d: records.Source(n, p, d, F.col("k"), F.col("o"), F.col("u"), F.col("l"))
    ids = spark.createDataFrame([("A-1",), ("A-1",), ("A-2",), ("A-9",), ("B-1",), ("C-1",), (None,)], "id string")
    got = sorted((r.id, r.source, r.url, r.label, r.found) for r in records.resolve(ids, "id", [make("a", "A-", a), make("b", "B-", b)]).collect())
    assert got == [("A-1", "a", "u1", "uno", True), ("A-2", "a", None, None, True), ("A-9", "a", None, None, False), ("B-1", "b", "w", "be", True), ("C-1", None, None, None, False)]
    assert records.resolve(ids.limit(0), "id", [make("a", "A-", a)]).count() == 0


def test_nested_records(spark):
    texts = ['{"k": 1, "p": {"m": 2.5}}', '{"k": null}', "{roto", None, '{"k": 7, "p": {"m": -1}}', '{"k": "x"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.errors for r in records.validate_json(df, "t", "k bigint, p struct<m:double>", {"k": lambda r: r["k"].isNotNull(), "m": lambda r: r["p"]["m"] >= 0}).collect()}
    assert got[0] == [] and got[1] == ["k"] and got[2] == ["json_invalido"] and got[3] == ["json_invalido"] and got[4] == ["m"] and got[5] == ["json_invalido"]
    nested = df.select(F.struct(F.col("i").alias("a"), F.struct(F.col("t").alias("b")).alias("c")).alias("s"), F.array(F.struct(F.col("i").alias("z"))).alias("l"))
    assert records.flatten(nested).columns == ["s_a", "s_c_b", "l"]
    assert [p for p, _ in records.key_paths(nested.schema)] == ["s.a", "s.c.b", "l[].z"]


def test_edits_choices_and_steps(spark):
    rows = records.elements(spark.createDataFrame([(1, "a", None), (2, "b", "y")], "id int, t string, u string"), ["id"], ["t", "u"])
    edits = spark.createDataFrame([(1, "u", "z")], "id int, campo string, nuevo string")
    assert sorted((r.id, r.campo, r.valor, r.editado) for r in records.apply_edits(rows, edits, ["id"]).collect()) == [(1, "t", "a", False), (1, "u", "z", True), (2, "t", "b", False), (2, "u", "y", False)]
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("e", "f")], "a string, b string")
    assert [(r.orden, r.a, r.b) for r in records.greedy_pairs(pairs, "a", "b", 5).collect()] == [(1, "a", "b"), (2, "c", "d"), (3, "e", "f")]
    with pytest.raises(ValueError):
        records.greedy_pairs(pairs, "a", "b", 1000)
    report = records.run_steps([records.Step("uno", lambda: 1), records.Step("dos", lambda: 1 / 0), records.Step("tres", lambda: 1)])
    assert [(r["step"], r["state"]) for r in report] == [("uno", "ok"), ("dos", "error"), ("tres", "omitido")] and "ZeroDivisionError" in report[1]["error"]


def test_names_and_percentages(spark):
    df = spark.createDataFrame([("El alcalde de Villa Roja habló con Ana. Luego salió",), ("Juan Pérez llega",), ("",), (None,), ("Última hora: Panamá gana",)], "t string")
    got = [r.n for r in df.select(text.proper_names(F.col("t")).alias("n")).collect()]
    assert got[:3] == [["Villa", "Roja", "Ana"], ["Juan", "Pérez"], []] and got[4] == []
    say = ["los precios subieron 36 por ciento", "los precios cayeron 2,5 %", "el precio cayó a 4 %", "los precios subieron casi 3 %", "los precios subieron 3 % y bajaron 4 %", "una ocupación del 51 por ciento", None]
    value, kind = text.bound_percentage(F.col("t"), ("precios", "precio"))
    assert [(r.v, r.k) for r in spark.createDataFrame([(s,) for s in say], "t string").select(value.alias("v"), kind.alias("k")).collect()] == [
        (36.0, "variacion"), (-2.5, "variacion"), (4.0, "nivel"), (None, None), (None, None), (None, None), (None, None)]


def test_resampling_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), int(rng.integers(3)), int(rng.integers(3))) for i in range(300)]
    rows = [(i, t, t if rng.random() < 0.5 else a, t if rng.random() < 0.8 else b) for i, t, a, b in rows]
    df = spark.createDataFrame(rows, "id int, t int, a int, b int")
    h = np.array([r.h for r in df.select(F.xxhash64(F.lit(42), "id").alias("h")).collect()], np.int64).view(np.uint64)
    w = metrics.poisson_weights(h, 50)
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    got = {r.r: (r.w, r.s) for r in metrics.resample(df.repartition(5), "id", [], F.col("t"), 50, 42).collect()}
    t = np.array([r[1] for r in rows])
    assert all(got[r + 1] == (w[:, r].sum(), (w[:, r] * t).sum()) for r in range(50))

    def macro(guess, weight):
        scores = []
        for c in sorted(set(t)):
            tp, fp, fn = (weight * (t == c) * (guess == c)).sum(), (weight * (t != c) * (guess == c)).sum(), (weight * (t == c) * (guess != c)).sum()
            scores.append(2 * tp / (2 * tp + fp + fn))
        return np.mean(scores)

    a, b = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    d = [macro(b, w[:, r]) - macro(a, w[:, r]) for r in range(50)]
    row = metrics.compare_macro_f1(df, "id", "t", "a", "b", resamples=50).first()
    assert row.f1_a == pytest.approx(macro(a, np.ones(300))) and row.difference == pytest.approx(macro(b, np.ones(300)) - macro(a, np.ones(300)))
    assert row.d_low == pytest.approx(np.quantile(d, 0.025)) and row.d_high == pytest.approx(np.quantile(d, 0.975)) and row.decision == "b"
    p = metrics.proportion(df, "id", F.col("t") == F.col("a"), 50).first()
    assert p.low <= p.mean <= p.high and p.wilson_low < p.mean < p.wilson_high and not p.degenerate
    pairs = {r.metric: r for r in metrics.resampled_pairs(df, "id", "t", "a", resamples=50).collect()}

    def precision(weight):
        def count(*keys):
            k = np.array([hash(x) for x in zip(*keys)])
            return sum((weight[k == x].sum() ** 2 - (weight[k == x] ** 2).sum()) / 2 for x in set(k))

        return count(t, a) / count(a)

    drawn = [precision(w[:, r]) for r in range(50)]
    assert pairs["precision"].value == pytest.approx(precision(np.ones(300))) and pairs["precision"].low == pytest.approx(np.quantile(drawn, 0.025))
    assert metrics.bootstrap_mean(df.limit(0), "id", F.col("t")).first().n == 0


def test_encoders_and_centroids_are_checked(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    got = {r.id: list(r.embedding) for r in vectors.encode(df, "t", lambda ts: [[len(x), 1.0] for x in ts], 2).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}
    with pytest.raises(Exception, match="instead of 3"):
        vectors.encode(df, "t", lambda ts: [[1.0]] * len(ts), 3).collect()
    many = spark.range(20).select(F.col("id").alias("label"), F.array(F.lit(1.0)).alias("centroid"))
    with pytest.raises(ValueError):
        vectors.with_centroids(df, many, "label", most=10)


def test_leave_one_out_against_refitting(spark):
    rng = np.random.default_rng(5)
    rows = [(float(np.round(x, 1)), bool(x + rng.normal() > 0)) for x in rng.normal(size=60)]
    schema = "x double, y boolean"
    wrong = 0
    for i, (x, y) in enumerate(rows[:12]):
        cut = metrics.best_threshold(spark.createDataFrame(rows[:i] + rows[i + 1 : 12], schema), "x", F.col("y")).first().cut
        wrong += (x >= cut) != y
    got = metrics.leave_one_out(spark.createDataFrame(rows[:12], schema), "x", F.col("y")).first()
    assert (got.n, got.errors) == (12, wrong)
    whole = metrics.leave_one_out(spark.createDataFrame(rows + [(None, True)], schema), "x", F.col("y")).first()
    assert whole.n == 60 and 0.5 < whole.accuracy <= 1
    assert metrics.leave_one_out(spark.createDataFrame([], schema), "x", F.col("y")).first().n == 0
    with pytest.raises(ValueError):
        metrics.leave_one_out(spark.createDataFrame(rows, schema), "x", F.col("y"), most=3)
