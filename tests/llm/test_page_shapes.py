import random
import re
from pathlib import Path

import pytest

from telar.llm.page_shapes import judge_pages

DATA = "/root/testdata/sf0.01"
PROSE = (
    "El alcalde explicó ayer que las obras del puente costarán más de lo previsto. La asociación pidió calma mientras siguen las inspecciones. "
    "Tres cuadrillas trabajan desde el martes en la vía principal, según los datos revisados."
)


def pages():
    rng = random.Random(1)
    keys = ["hotel barato", "vuelos baratos", "envío gratis", "tour del canal"]
    links = "\n".join(f"https://sitio{i}.example/p/{i}" for i in range(12))
    return {
        1: PROSE, 2: " ".join(rng.choice(keys) for _ in range(200)), 3: links, 4: " ".join(f"#Hotel{i} #Oferta{i}" for i in range(40)),
        5: ", ".join(rng.choice(keys) for _ in range(150)), 6: PROSE + "\n\nEnlaces:\n" + links[:60], 7: PROSE + "\n#Uno #Dos #Tres",
        8: "\n".join(f"Caudal en Punta Rosa {i}: {i},3 m (sube)" for i in range(30)),
        9: "\n".join(f"0{i % 9}:1{i % 5} El río bajó {i} centímetros durante la noche, según el informe." for i in range(20)),
        10: "\n".join(f"— ¿Cuánto cuesta el peaje de la zona {i}?\nLa tarifa sube {i} centavos, explicó la oficina." for i in range(20)),
        11: " ".join("Compre " + " ".join(rng.choice(keys) for _ in range(6)) + "." for _ in range(30)),
        12: (PROSE + " ") * 30, 13: "", 14: None, 15: "   \n\t", 16: PROSE + "\n" + " ".join(rng.choice(keys) for _ in range(400)),
        17: "hotel barato " * 60_000, 18: "\n".join(f"zapatos Nuevo{i} ref. {i} USD {i}.50 outlet" for i in range(20)),
    }


def test_pages(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in pages().items()], "doc long, text string, kind string")
    got = {r.id: r for r in judge_pages(df, "doc", "text").collect()}
    assert {i for i, r in got.items() if r.flagged} == {2, 3, 4, 5, 11, 16, 17, 18}
    assert [got[i].chars for i in (13, 14, 15)] == [0, 0, 0] and len(got) == 18


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, PROSE), (1, PROSE)], "doc long, text string")
    assert judge_pages(df, "doc", "text").count() == 2
    assert judge_pages(df.limit(0), "doc", "text").count() == 0


def test_repeats_count_by_their_own_kind(spark):
    line = "hotel barato " * 20
    price = "La entrada cuesta USD 5 por persona, según la oficina. "
    df = spark.createDataFrame(
        [(1, "\n".join([line] * 100) + "\n" + PROSE * 2), (2, (PROSE + " " + price) * 30), (3, "\n".join([PROSE, "#Uno #Dos #Tres #Hotel #Vuelo #Tour #Canal #Oferta"] * 30)), (4, "\n".join([line, PROSE * 4] * 30))],
        "doc long, text string",
    )
    got = {r.id: r for r in judge_pages(df, "doc", "text").collect()}
    assert {i for i, r in got.items() if r.flagged} == {1} and got[1].odd_share > 0.97
    # A sentence that names a price is a sentence.
    assert got[2].chars > 30 * len(PROSE) and got[2].odd_share == 0
    assert 0.1 < got[3].odd_share < 0.25 and 0.15 < got[4].odd_share < 0.35


def test_by_shape_alone(spark):
    rng = random.Random(2)
    tails = "hoy ya si no mas luego casi bien mal poco".split()
    forms = ["Ver {0} en https://a{1}.example/{1}", "{0} » http://b{1}.example/x/{1}", "[{0}](https://c{1}.example/{1})", "https://d{1}.example/{0}/{1}"]
    nouns = "zapato mesa silla cama lámpara reloj bolso camisa falda pantalón gorra cinturón anillo collar pulsera taza plato vaso sartén olla cuchillo tenedor cuchara manta cojín alfombra espejo cuadro vela jarrón"
    texts = {
        1: "Comprar zapatos baratos en la tienda online con descuento. " * 60,
        2: " ".join(f"Comprar zapatos baratos en la tienda online con descuento {tails[i % 10]}." for i in range(60)),
        3: nouns, 4: "\n".join(rng.choice(forms).format(rng.choice("abcdefgh"), i) for i in range(40)),
        5: "El precio del café fue de USD 3 la libra en enero, según la cámara. En marzo subió a USD 4 y los productores de la zona piden que el banco baje el interés.",
        6: "La sesión terminó sin acuerdo y con la sala casi vacía. " * 3 + PROSE * 2, 7: "Oferta\nde\nhoy", 8: "\x00 \u200b ¿?", 9: "#" * 5000,
    }
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc long, text string, chars int, odd string")
    got = {r.id: r for r in judge_pages(df, "doc", "text").collect()}
    assert {i for i, r in got.items() if r.flagged} == {1, 2, 3, 4}
    assert got[1].chars > 0.99 * len(texts[1])


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_on_the_test_table(spark):
    """Pages of links or hash marks, told by plain counts, are found; pages of long sentences with many short words aren't."""
    from telar.session import table

    docs = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}
    got = {r.id for r in judge_pages(table(spark, DATA, "documents"), "doc_id", "text").where("flagged").collect()}
    share = lambda t, p: len("".join(re.findall(p, t))) / max(len(t), 1)
    sure = {i for i, t in docs.items() if share(t, r"https?://\S+") > 0.6 or share(t, r"#\w+") > 0.8}
    prose = {i for i, t in docs.items() if t and share(t, r"[A-ZÀ-Ý][^.!?\n#|]{40,200}[.!?]") > 0.95 and len(set(re.findall(r"\b[a-zà-ÿ]{4,}", t))) > 0.6 * len(re.findall(r"\b[a-zà-ÿ]{4,}", t))}
    assert sure and sure <= got and len(prose) > 20 and not prose & got
