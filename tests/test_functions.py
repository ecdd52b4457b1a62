import pytest
from pyspark.sql import functions as F

from telar.functions import stats, text, urls


def value(spark, column, *args, types="string"):
    names = [f"c{i}" for i in range(len(args))]
    return spark.createDataFrame([args], ", ".join(f"{n} {t}" for n, t in zip(names, [types] * len(args)))).select(column(*map(F.col, names)).alias("v")).first().v


@pytest.mark.parametrize("raw, bare, key", [("Álvaro Núñez", "alvaro nunez", "alvaronunez"), ("STRASSE ß", "strasse ss", "strassess"), ("él", "el", "el"), ("", "", ""), (None, None, None)])
def test_normal_forms(spark, raw, bare, key):
    assert value(spark, text.bare, raw) == bare and value(spark, text.alnum_key, raw) == key


def test_title_and_suffix(spark):
    assert value(spark, text.clean_title, "  Agua &amp; luz  “hoy” ") == 'Agua & luz "hoy"' and value(spark, text.clean_title, "  ") is None
    assert value(spark, text.without_suffix, "Corte de agua - La Voz", "La  Voz") == "Corte de agua"
    assert value(spark, text.without_suffix, "Corte - La Voz", "La Voz") == "Corte - La Voz"
    assert value(spark, text.without_suffix, "Corte de agua - hoy", "La Voz") == "Corte de agua - hoy"


def test_words(spark):
    assert value(spark, lambda c: text.has_word(c, "Agua"), "sin ÁGUA hoy") and not value(spark, lambda c: text.has_word(c, "agua"), "aguacate")
    assert value(spark, lambda c: text.has_acronym(c, "ONU"), "la ONU.") and not value(spark, lambda c: text.has_acronym(c, "ONU"), "onu")
    assert not value(spark, lambda c: text.has_term(c, "agua", before=("sin",)), "vive sin agua") and value(spark, lambda c: text.has_term(c, "agua", before=("sin",)), "siguensin agua")
    assert value(spark, lambda c: text.words(c, ("de",)), "Corte de Agua, a 5") == ["corte", "agua"]
    assert value(spark, text.shape, "AB-2026x") == "a-9a" and value(spark, lambda c: text.shorten(c, 5), "abcdefg") == "abcd…"
    assert value(spark, lambda c: text.without_delimiters(c, "dato"), "<Dato x>a</dato >") == "a"
    assert value(spark, text.holds, "a  b\nc", "b c") and not value(spark, text.holds, "abc", " ")
    assert text.any_of(["a", "b c"]) == '(a OR "b c")'


@pytest.mark.parametrize("raw, number", [("1.234", 1234.0), ("1,234", 1234.0), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("12,5", 12.5), ("3.14159", 3.14159), ("x", None)])
def test_numerals(spark, raw, number):
    assert value(spark, text.numeral, raw) == number


def test_figures(spark):
    got = value(spark, text.figures, "En 2026, 3.520 familias y 12,5 metros el 01/02/2026 a las 10:30")
    assert [(f.value, f.unit) for f in got] == [(3520.0, "famil"), (12.5, "metro")]


def test_urls(spark):
    assert value(spark, urls.canonical_url, "HTTP://www.D.example:80/a/amp/?b=2&utm_x=1&a=1#z") == "https://d.example/a?a=1&b=2"
    assert value(spark, urls.host, "https://user@M.d.example:8080/x") == "d.example" and value(spark, urls.host, "nada") is None
    assert value(spark, urls.section, "https://d.example/notas/1") == "notas" and value(spark, urls.section, "https://d.example") is None
    assert value(spark, lambda c: urls.short_id("X-", c), "abc") == "X-a9993e3647" and value(spark, lambda c: urls.fold(c, 5), "abc") in range(5)


def test_statistics(spark):
    low, high = spark.range(1).select(*stats.wilson(F.lit(8), F.lit(10))).first()
    assert abs(low - 0.4902) < 1e-3 and abs(high - 0.9433) < 1e-3
    assert tuple(spark.range(1).select(*stats.wilson(F.lit(0), F.lit(5))).first())[0] == 0.0
    assert tuple(spark.range(1).select(*stats.wilson(F.lit(0), F.lit(0))).first()) == (None, None)
    assert spark.range(1).select(stats.f1(F.lit(0), F.lit(0), F.lit(0))).first()[0] is None
    assert spark.range(1).select(stats.ramp(F.lit(35.0), 10.0, 60.0)).first()[0] == 0.5
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = v.select(stats.unit(F.col("a")), stats.unit(F.col("b")), stats.cosine(F.col("a"), F.col("a")), stats.cosine(F.col("a"), F.col("b"))).first()
    assert got[0] == [0.6, 0.8] and got[1] == [0.0, 0.0] and abs(got[2] - 1) < 1e-12 and got[3] is None
