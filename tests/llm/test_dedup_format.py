from hypothesis import given, settings
from hypothesis import strategies as st

from telar.llm.dedup_format import canonical_text, canonical_url, duplicate_records, duplicate_rows

COLUMNS = {"titulo": canonical_text, "url": canonical_url}


def test_canonical_text():
    same = ["Agua en Alto Río: 5", "  AGUA EN ALTO RÍO – 5!!", "agua&nbsp;en alto r&iacute;o 5", "agua en alto río, 5", "&amp;quot;Agua en alto río&amp;quot; 5"]
    assert len({canonical_text(t) for t in same}) == 1
    assert canonical_text("año") != canonical_text("ano")
    assert canonical_text("Straße") == canonical_text("STRASSE")
    assert canonical_text("") == canonical_text("¡…!") == ""


def test_canonical_url():
    same = [
        "https://www.Diario.example/a/B-1", "http://m.diario.example:80/a/B-1/amp/?utm_source=x&ref=y#top", " https://diario.example:443/a/B-1/?amp=1&fbclid=3 ", "//diario.example/a/B-1?outputType=amp",
    ]
    assert len({canonical_url(u) for u in same}) == 1
    assert canonical_url("https://d.example/n?id=1&sec=2") == canonical_url("https://d.example/n?sec=2&utm_medium=rss&id=1")
    assert canonical_url("https://d.example/a") != canonical_url("https://d.example/A")
    assert canonical_url("https://d.example/n?id=1") != canonical_url("https://d.example/n?id=2")
    assert canonical_url("https://d.example:8080/n") != canonical_url("https://d.example/n")


@settings(max_examples=100)
@given(st.text(max_size=40))
def test_canonical_text_is_stable(text):
    once = canonical_text(text)
    assert canonical_text(once) == once and canonical_text(text.upper().lower()) == canonical_text(text.upper().lower().upper().lower())


def test_rows_and_counts(spark, rows):
    long = "palabra " * 20_000
    data = [
        (5, "Agua en Río", "https://d.example/1"), (3, "agua en río!", "http://www.d.example/1/"), (9, "Agua en rio", "https://d.example/1"), (2, None, "https://d.example/1"),
        (4, "Agua en Río", None), (7, long, "https://d.example/2"), (8, long.upper(), "https://d.example/2#x"), (10, "", "https://d.example/3"), (11, " ", "https://d.example/3"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in data], "fila long, titulo string, url string, record string, first string")
    assert rows(duplicate_rows(df, "fila", COLUMNS)) == [(10, 11), (3, 5), (7, 8)]
    assert sorted((r["first"], r.copies) for r in duplicate_records(df, "fila", COLUMNS).collect()) == [(3, 2), (7, 2), (9, 1), (10, 2)]


def test_hot_record_and_empty(spark, rows):
    df = spark.range(3000).selectExpr("id as fila", "case when id % 3 = 0 then 'Uno' else concat('T', id) end as titulo", "'https://d.example/x' as url")
    assert len(rows(duplicate_rows(df, "fila", COLUMNS))) == 999
    assert rows(duplicate_rows(df.limit(0), "fila", COLUMNS)) == []
