"""The queries over the smallest tables, and the isolation of the subpackage."""

import re
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "telar").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "telar").parts:
            assert not re.search(r"telar\.llm|from telar import llm", p.read_text()), p


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "p7_found", "p8_llenado", "p9_reparto", "p10_found"])
def test_queries_run(spark, name):
    from telar.llm.queries import QUERIES

    rows = QUERIES[name](spark, DATA).collect()
    assert len(rows) == len(set(rows)) > 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_records_against_another_canonical_form(spark):
    """Categories of characters and a parsed address instead of the operator's patterns."""
    import html
    import unicodedata
    from collections import defaultdict
    from urllib.parse import urlsplit

    from telar.llm.queries import QUERIES
    from telar.session import table

    def letters(t):
        t = unicodedata.normalize("NFC", html.unescape(html.unescape(t))).casefold()
        return "".join(c for c in unicodedata.normalize("NFC", t) if unicodedata.category(c)[0] in "LNM")

    def page(u):
        s = urlsplit(u.strip())
        host = re.sub(r"^(www\.|m\.)", "", re.sub(r":(80|443)$", "", s.netloc.lower()))
        path = re.sub(r"/amp$", "", s.path.rstrip("/")).rstrip("/")
        tracks = re.compile(r"(fbclid|gclid|igshid|mc_cid|mc_eid|ref|ref_src)(=|$)|utm_|outputType=amp$|amp=(1|true)$")
        return host + path + "?" + "&".join(sorted(q for q in s.query.split("&") if q and not tracks.match(q)))

    groups = defaultdict(list)
    for r in table(spark, DATA, "noticias").where("titulo is not null and url is not null").collect():
        groups[letters(r.titulo), page(r.url)].append(r.fila)
    want = sorted((min(g), f) for g in groups.values() for f in g if f != min(g))
    assert sorted((r.fila_a, r.fila_b) for r in QUERIES["p7_found"](spark, DATA).collect()) == want


def test_tokens(spark):
    from pyspark.sql import functions as F

    from telar.llm.tokens import VOCABULARY, token_count

    if not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary")
    rows = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("a" * 50_000,)], "t string").select(token_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows][:3] == [2, 0, 0] and rows[3].n > 1 and rows[4].n > 1000


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_found", "p1_pares", "p7_found", "p7_registros"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    from telar.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, DATA)
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall())
    assert want and sorted(map(tuple, df.collect())) == want


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_events_and_consensus_agree(spark):
    """Groups found from headlines alone against those that people agree on: two ways that share nothing but the truth."""
    from itertools import combinations

    from telar.llm.queries import p4_found, p5_found

    data = "/root/testdata/sf0.01"
    agreed = {r.id_noticia: re.sub("-(2|bis|nota)$", "", r.valor) for r in p4_found(spark, data).where("campo = 'grupo'").collect()}
    want = {p for p in combinations(sorted(agreed), 2) if agreed[p[0]] == agreed[p[1]]}
    got = {(r.id_a, r.id_b) for r in p5_found(spark, data).collect() if r.id_a in agreed and r.id_b in agreed}
    assert len(want) > 50 and len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
