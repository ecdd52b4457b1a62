import random

import pytest
from pyspark.sql import functions as F

from telar.llm.consensus import closed, latest_labels, open_values

CLASSES = ["agua", "luz", "peaje"]


def simulated(n=300, seed=1):
    """Items whose text hints at their class; good, careless and biased annotators."""
    rng = random.Random(seed)
    truth = {f"i{i}": rng.choice(CLASSES) for i in range(n)}
    good, careless, biased = ["ana", "bea"], ["ciro", "dora"], ["eva", "fito"]
    labels = []
    for item, t in truth.items():
        labels += [(item, a, t if rng.random() < 0.9 else rng.choice(CLASSES)) for a in good]
        labels += [(item, a, t if rng.random() < 0.4 else rng.choice(CLASSES)) for a in careless]
        labels += [(item, a, "agua" if rng.random() < 0.8 else t) for a in biased]
    items = [(item, f"noticia sobre {t} numero {rng.randrange(9)}", None if rng.random() < 0.5 else t) for item, t in truth.items()]
    return truth, labels, items


@pytest.mark.parametrize("most", [20_000, 0])
def test_closed_beats_the_majority(spark, most):
    truth, labels, items = simulated()
    lab = spark.createDataFrame(labels, "item string, annotator string, value string")
    it = spark.createDataFrame(items, "item string, text string, hint string")
    agreed, who = closed(lab, it, CLASSES, max_annotators=most)
    got = {r.item: r for r in agreed.collect()}
    votes = {}
    for item, _, v in labels:
        votes.setdefault(item, []).append(v)
    majority = sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in votes.items())
    right = sum(r.value == truth[i] for i, r in got.items())
    assert len(got) == 300 and right > 290 and right > majority
    reliability = {r.annotator: r.reliability for r in who.collect()}
    assert min(reliability["ana"], reliability["bea"]) > max(reliability[a] for a in ("ciro", "dora", "eva", "fito"))
    assert all(r.n_labels == 6 and 0 <= r.agreement <= 1 for r in got.values())


@pytest.mark.parametrize("most", [20_000, 0])
def test_open_values(spark, most):
    rng = random.Random(2)
    places = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(20)]
    truth, labels, items = {}, [], []
    for i in range(200):
        t = f"agua-{rng.choice(places)}"
        truth[f"i{i}"] = t
        items.append((f"i{i}", f"Sin agua en {t.split('-')[1].title()}"))
        labels += [(f"i{i}", "bueno", t if rng.random() < 0.9 else "agua-" + rng.choice(places)), (f"i{i}", "vago", "varios"), (f"i{i}", "azar", "agua-" + rng.choice(places))]
    agreed, who = open_values(spark.createDataFrame(labels, "item string, annotator string, value string"), spark.createDataFrame(items, "item string, text string"), max_annotators=most)
    right = sum(r.value == truth[r.item] for r in agreed.collect() if truth[r.item] in {v for i, _, v in labels if i == r.item})
    assert right >= 175
    reliability = {r.annotator: r.reliability for r in who.collect()}
    assert reliability["bueno"] > 0.8 > 0.2 > reliability["vago"]


def test_latest_labels(spark, rows):
    data = [
        ("a", " Ana ", "2026-01-01", "agua", "x"), ("a", "ANA", "2026-01-03", None, "y"), ("a", "ana", "2026-01-02", "luz", "z"), ("a", "bea", None, "luz", "z"),
        ("b", None, "2026-01-01", "agua", "x"), ("b", " ", "2026-01-01", "agua", "x"), (None, "ana", "2026-01-01", "agua", "x"), ("c", "ana", "2026-01-01", "agua", "x"), ("c", "ana", "2026-01-01", "luz", "x"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in data], "item string, annotator string, t string, v string, w string, r string")
    assert rows(latest_labels(df, "item", "annotator", "t", ["v", "w"])) == [("a", "ana", None, "y"), ("a", "bea", "luz", "z"), ("c", "ana", "luz", "x")]


def test_edges(spark):
    lab = spark.createDataFrame([("a", "ana", "agua"), ("a", "ana", None), ("b", "ana", "otra")], "item string, annotator string, value string")
    items = spark.createDataFrame([("a", None, None), ("a", "x" * 200_000, "h"), ("z", "luz", None)], "item string, text string, hint string")
    agreed, who = closed(lab, items, CLASSES)
    assert [(r.item, r.value, r.n_labels) for r in agreed.collect()] == [("a", "agua", 1)] and who.count() == 1
    none = closed(lab.limit(0), items, CLASSES)
    assert none[0].count() == 0 and none[1].count() == 0
    agreed, who = open_values(lab, items)
    assert sorted((r.item, r.value) for r in agreed.collect()) == [("a", "agua"), ("b", "otra")]
    none = open_values(lab.limit(0), items)
    assert none[0].count() == 0 and none[1].count() == 0
    assert [x.count() for x in closed(lab, items, [])] == [0, 0]
    tie = spark.createDataFrame([("a", "ana", "luz"), ("a", "bea", "agua")], "item string, annotator string, value string")
    assert closed(tie, items.limit(0), CLASSES)[0].first().value == "agua"


def test_both_ways_give_the_same_rows(spark):
    """Matrices sent with each round, or joined as a table: the same values, confidences and reliabilities."""
    truth, labels, items = simulated(120, seed=5)
    lab = spark.createDataFrame(labels, "item string, annotator string, value string")
    it = spark.createDataFrame(items, "item string, text string, hint string")
    for make in (lambda most: closed(lab, it, CLASSES, max_annotators=most), lambda most: open_values(lab, it, max_annotators=most)):
        (a, who_a), (b, who_b) = make(20_000), make(0)
        x, y = ({r.item: r for r in agreed.collect()} for agreed in (a, b))
        assert {i: r.value for i, r in x.items()} == {i: r.value for i, r in y.items()}
        assert all(abs(x[i].confidence - y[i].confidence) < 1e-6 and abs(x[i].agreement - y[i].agreement) < 1e-12 and x[i].n_labels == y[i].n_labels for i in x)
        p, q = ({r.annotator: r.reliability for r in w.collect()} for w in (who_a, who_b))
        assert p.keys() == q.keys() and all(abs(p[k] - q[k]) < 1e-6 for k in p)
