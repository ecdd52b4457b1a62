import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from telar.llm.language import Model, SuffixAutomaton, clean_sample, fit, language_runs, plain

DATA = "/root/testdata/sf0.01"
TEXTS = {
    "es": ["el alcalde dijo que las obras del puente siguen", "la lluvia dañó las casas cerca del río", "los vecinos piden agua para las familias del barrio", "una avería dejó sin luz a la ciudad durante la noche"],
    "en": ["the mayor said that the works on the bridge go on", "heavy rain damaged the homes near the river", "the neighbours ask for water for the families", "a fault left the city without power during the night"],
    "de": ["der bürgermeister sagte dass die arbeiten an der brücke weitergehen", "der regen beschädigte die häuser am fluss", "die nachbarn bitten um wasser für die familien", "ein fehler liess die stadt in der nacht ohne strom"],
}


@pytest.fixture(scope="module")
def model():
    return Model.train({k: "\n".join(plain(t) for t in v) for k, v in TEXTS.items()}, change_bits=25.0)


def test_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        text, query = ("".join(rng.choice("abc") for _ in range(n)) for n in (40, 25))
        m = Model.train({"x": text})
        codes = np.array([[m.codes.get(c, 0) for c in query]])
        got = m.matches(codes)[0, 0]
        want = [max(k for k in range(i + 2) if query[i + 1 - k : i + 1] in text) for i in range(len(query))]
        assert got.tolist() == want
    assert len(SuffixAutomaton("aaaa").next) == 5


def test_costs_are_the_fewest_phrases(model):
    text = plain("los vecinos dijo que casas")
    codes = np.array([[model.codes.get(c, 0) for c in text]])
    longest = model.matches(codes)
    total = model.costs(longest, np.array([len(text)]))[:, 0, -1]
    for i in range(len(model.languages)):
        n, at = 0, len(text) - 1
        while at >= 0:
            n, at = n + model.bits[i] + (8 if longest[i, 0, at] == 0 else 0), at - max(int(longest[i, 0, at]), 1)
        assert total[i] == pytest.approx(n, rel=1e-4)


def test_runs(model):
    runs = lambda t: [r[0] for r in model.runs([plain(t)])[0]]
    assert runs("La lluvia dañó las casas cerca del puente") == ["es"]
    assert runs("THE MAYOR SAID THAT THE HOMES NEAR THE RIVER") == ["en"]
    assert runs("los vecinos piden agua para las familias del barrio — heavy rain damaged the homes near the river") == ["es", "en"]
    assert runs("la lluvia dañó las casas cerca del río / die nachbarn bitten um wasser für die familien / los vecinos piden agua para las familias") == ["es", "de", "es"]
    batch = model.runs(["", plain("agua"), "", plain("water for the families")])
    assert [len(r) for r in batch] == [0, 1, 0, 1] and all(0 <= r[1] <= 1 for runs_ in batch for r in runs_)
    assert Model.train({}).runs([plain("agua")]) == [[]]


def test_long_and_odd_texts(model):
    long = plain("la lluvia dañó las casas cerca del río " * 3000)
    assert [r[0] for r in model.runs([long, plain("日本語 текст 🙂"), plain("x" * 5000)])[0]] == ["es"]


def test_plain():
    assert plain("¡Última&nbsp;hora: 12.500 casas!") == " última hora 0 0 casas "
    assert plain("…") == ""


def test_clean_sample_mends_labels():
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        label = rng.choice(list(TEXTS))
        words = " ".join(rng.choice(TEXTS[label]) for _ in range(1))
        rows.append((f"{words} {rng.random()}".replace(".", "") + "".join(rng.choice("abcdefgh") for _ in range(6)), label if rng.random() > 0.15 else "es"))
    mixed = TEXTS["es"][0] + " " + TEXTS["en"][0]
    cleaned = clean_sample([*rows, (mixed, "es")])
    assert plain(mixed) not in cleaned["es"]
    assert all(any(plain(t).strip()[:12] in x for t in TEXTS["de"]) for x in cleaned["de"])
    assert not any(" the " in x or " der " in x for x in cleaned["es"])


def test_fit_and_frame(spark):
    rows = [(i, t, k) for k, v in TEXTS.items() for i, t in enumerate(v * 3)] + [(99, None, "es"), (98, "", "es"), (97, "agua", None)]
    df = spark.createDataFrame(rows, "language long, text string, k string")
    model = fit(df, "text", "k")
    got = df.select("text", language_runs(df, model, F.col("text")).alias("r")).collect()
    assert all(len(x.r) == 0 for x in got if not x.text) and {x.r[0].language for x in got if x.text} == set(TEXTS)
    assert df.limit(0).select(language_runs(df, model, F.col("text"))).count() == 0
    empty = fit(df.limit(0), "text", "k")
    assert [len(x.r) for x in df.limit(2).select(language_runs(df, empty, F.col("text")).alias("r")).collect()] == [0, 0]


def test_a_long_text_does_not_use_up_the_budget(spark):
    from telar.llm.language import hash_of

    rows = [(t, k) for k, v in TEXTS.items() for t in v]
    least = min(hash_of(plain(t)) for t in TEXTS["de"])
    long = next(t for t in (f"{'die nachbarn bitten um wasser ' * 1000}{'x' * i}" for i in range(1, 5000)) if hash_of(plain(t)) < least)
    query = "bitten um wasser für die familien"
    for texts in ([*rows, (long, "de")], [r for r in rows if r[1] != "de"] + [(long, "de")]):
        model = fit(spark.createDataFrame(texts, "text string, k string"), "text", "k", change_bits=25.0)
        assert model.languages == ["de", "en", "es"]
    model = fit(spark.createDataFrame([*rows, (long, "de")], "text string, k string"), "text", "k", change_bits=25.0)
    assert [r[0] for r in model.runs([plain(query)])[0]] == ["de"]


def test_matches_longer_than_a_byte_counts():
    """A line of 700 characters is matched whole, against brute force."""
    rng = random.Random(9)
    line = " " + "".join(rng.choice("ab") for _ in range(700)) + " "
    m = Model.train({"x": line + "\n b ", "y": " ab "})
    codes = np.array([[m.codes.get(c, 0) for c in line]])
    assert m.matches(codes)[m.languages.index("x"), 0].tolist() == list(range(1, 703))
    assert [r[0] for r in m.runs([line])[0]] == ["x"]


def test_scripts_of_thousands_of_characters():
    """Characters beyond those with a number of their own share some; words of scripts without spaces are characters."""
    rng = random.Random(7)
    han = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(12)) for _ in range(80)]
    kana = ["".join(chr(0x3041 + rng.randrange(80)) for _ in range(12)) for _ in range(80)]
    texts = {"ja": kana, "zh": han, "es": TEXTS["es"]}
    m = Model.train({k: "\n".join(plain(t) for t in v) for k, v in texts.items()}, change_bits=25.0)
    assert m.table.shape[1] <= 257 and len(m.codes) > 600
    assert [[r[0] for r in runs] for runs in m.runs([plain(han[3]), plain(kana[5]), plain(TEXTS["es"][1]), plain(kana[1] + " " + TEXTS["es"][2])])] == [["zh"], ["ja"], ["es"], ["ja", "es"]]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_held_out_labels(spark):
    """Headlines whose label names a language mostly have that language: labels are right far more often than not."""
    from telar.llm.queries import _languages

    rows = [r for r in _languages(spark, DATA).where("nombrado is not null").collect() if r.tramos]
    assert len(rows) > 100 and sum(len(r.tramos) > 1 or r.tramos[0].language == r.nombrado for r in rows) > 0.8 * len(rows)
