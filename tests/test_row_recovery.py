import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from telar.operators.row_recovery import INDICATORS, NEWS, Fault, Grammar, load_lines, parse_lines, parse_text, read_files

GOOD = 'NOT-0123456789,"Agua, ""luz"" y más",https://d.example/a,Diario,es,2026-06-01T00:00:00Z,,2026-06-02T00:00:00Z,agua,RSS,titular'
IND = "IND-PAN-IX.A-2020,PAN,IX.A,2020,1.5e3,%,https://d.example/b,2026-06-02T00:00:00Z,CC"


def lines(spark, rows):
    return spark.createDataFrame([(i, *r, "z") for i, r in enumerate(rows, 1)], "id_linea long, contrato string, archivo string, fila int, linea string, errors string")


def loaded(spark, rows):
    return load_lines(lines(spark, rows), "id_linea", "contrato", "archivo", "fila", "linea")


def kinds(spark, rows):
    return sorted((r.id, r.tipo_error) for r in loaded(spark, rows).errors.collect())


@settings(max_examples=200)
@given(st.lists(st.text(alphabet='ab,"\n é', max_size=8), min_size=1, max_size=5))
def test_round_trip_with_the_csv_writer(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    if fields != [""]:
        assert Grammar(out.getvalue()).record(0)[0] == [f.strip() or None for f in fields]


@pytest.mark.parametrize("text, at", [('a,"b', 2), ('a,b"c', 3), ('"a"b,c', 3), ('"a" ,b', 3), ('a, "b"', 3), ('"', 0), ('a,""",b', 2)])
def test_faults_are_located(text, at):
    with pytest.raises(Fault) as fault:
        Grammar(text).record(0)
    assert fault.value.at == at


def test_one_error_kind_each(spark):
    bad = lambda old, new: GOOD.replace(old, new)
    rows = [
        GOOD, bad("titular", "titular,otro"), bad('"Agua, ""luz"" y más"', '"Agua'), bad("Diario", " "), bad("NOT-0123456789", "NOT-0123"), bad("https://d.example/a", "ftp://d"),
        bad("2026-06-02T", "2026-02-30T"), bad("2026-06-01T00:00:00Z", ""), GOOD + "\r", None, bad("NOT-0123456789", "SYN-AB1-7"), "",
    ]
    got = kinds(spark, [("noticias", f"f{i}", 1, r) for i, r in enumerate(rows)])
    assert got == [
        (2, "estructura_invalida"), (3, "estructura_invalida"), (4, "obligatorio_vacio"), (5, "id_formato_invalido"), (6, "url_mal_formada"),
        (7, "fecha_invalida"), (8, "obligatorio_vacio"), (10, "estructura_invalida"), (12, "estructura_invalida"),
    ]


def test_indicators(spark):
    bad = lambda old, new: IND.replace(old, new)
    rows = [IND, bad("1.5e3", ""), bad("1.5e3", "inf"), bad("1.5e3", "1,5"), bad("PAN,", "pan,"), bad(",2020,", ",1959,"), bad(",2020,", ",020,"), bad("IND-PAN-IX.A-2020", ""), bad(",CC", ", "), bad("1.5e3", "-.5")]
    got = kinds(spark, [("indicadores", f"f{i}", 1, r) for i, r in enumerate(rows)])
    assert got == [(3, "valor_invalido"), (4, "estructura_invalida"), (5, "valor_invalido"), (6, "valor_invalido"), (7, "valor_invalido"), (9, "obligatorio_vacio")]
    typed = {r.id_linea: r for r in loaded(spark, [("indicadores", f"f{i}", 1, r) for i, r in enumerate(rows)]).valid("indicadores").collect()}
    assert typed[1].valor == 1500.0 and typed[2].valor is None and typed[10].valor == -0.5 and typed[1].anio == 2020


def test_duplicates_count_valid_lines_only(spark):
    wrong = GOOD.replace("https://d.example/a", "nada")
    other = GOOD.replace("0123456789", "aaaaaaaaaa")
    rows = [("noticias", "f", 2, wrong), ("noticias", "f", 3, GOOD), ("noticias", "f", 5, GOOD), ("noticias", "f", 4, other), ("noticias", "g", 9, GOOD), ("noticias", "f", 3, GOOD), ("noticias", None, 1, GOOD), ("noticias", None, 2, GOOD)]
    assert kinds(spark, rows) == [(1, "url_mal_formada"), (3, "id_duplicado"), (8, "id_duplicado")]
    found = loaded(spark, rows)
    assert found.valid("noticias").count() == 5 and found.valid("indicadores").count() == 0


def test_unknown_contract_long_line_and_empty(spark):
    long = GOOD.replace("más", "más" * 100_000)
    assert kinds(spark, [("otro", "f", 1, GOOD), (None, "f", 2, GOOD), ("noticias", "f", 3, long)]) == [(1, "estructura_invalida"), (2, "estructura_invalida")]
    assert kinds(spark, []) == []


def test_whole_files_account_for_every_line():
    short, odd = "NOT-4,dos,campos", GOOD.replace("NOT-0123456789", "X-1")
    second = GOOD.replace("0123456789", "1123456789")
    find = lambda *ls: [(o, f[0] if f else None, r) for o, f, _, r in parse_text("\n".join(ls), len(NEWS.columns), NEWS.anchor)]
    # Neighbouring lines of another width each give a fault, and a record without a right id after them is read.
    assert [x[1:] for x in find(short, short, odd, "", short, second)] == [
        (None, "3 campos en vez de 11"), (None, "3 campos en vez de 11"), ("X-1", None), (None, "3 campos en vez de 11"), ("NOT-1123456789", None),
    ]
    # After a broken quote every line up to the anchor is named.
    broken = 'NOT-3123456789,"sin cerrar,https://d.example/c'
    got = find(GOOD, broken, "resto uno", "", odd, second)
    skipped = "línea saltada tras un registro roto"
    assert [x[1] for x in got] == ["NOT-0123456789", None, None, None, "NOT-1123456789"] and [x[2] for x in got][2:4] == [skipped, skipped]
    assert got[2][0] == len(GOOD) + len(broken) + 2
    # A record that runs over a good line only by its quotes, and one that ends the file.
    plain = GOOD.replace('"Agua, ""luz"" y más"', "Agua")
    assert [x[1:] for x in find('NOT-3123456789,"abre', plain, 'cierra",fin', second)] == [
        (None, "3 campos en vez de 11"), ("NOT-0123456789", None), (None, "comillas dentro de un campo sin comillas"), ("NOT-1123456789", None),
    ]
    assert [x[1] for x in find(GOOD, broken, "cola", "otra\r", "\r")] == ["NOT-0123456789", None, None, None]


def test_recovery_in_whole_files(spark, tmp_path):
    second, third = GOOD.replace("0123456789", "1123456789"), GOOD.replace("0123456789", "2123456789").replace("más", "más\nNOT-x")
    broken = 'NOT-3123456789,"sin cerrar,https://d.example/c,Diario'
    text = "\n".join([GOOD, broken, second, third, "", IND])
    found = list(parse_text(text, len(NEWS.columns), NEWS.anchor))
    assert [f[1][0] if f[1] else None for f in found] == ["NOT-0123456789", None, "NOT-1123456789", "NOT-2123456789", None]
    # The quote is closed by the next record's: the fault lies there, yet that record is read whole.
    assert found[1][3] == "texto tras las comillas de cierre" and found[1][0] == len(GOOD) + 1
    (tmp_path / "a.csv").write_text("cabecera\r\n" + text + "\r\n")
    rows = read_files(spark, str(tmp_path / "a.csv"), NEWS, header=True).collect()
    assert [r.fields[0] if r.fields else None for r in rows][:4] == ["NOT-0123456789", None, "NOT-1123456789", "NOT-2123456789"]
    assert len(INDICATORS.columns) == 9


def test_a_quote_over_several_lines_costs_its_own_line_only(spark):
    broken, odd = GOOD.replace('"Agua, ""luz"" y más"', '"Agua'), GOOD.replace("NOT-0123456789", "X-1")
    inside = GOOD.replace("0123456789", "2123456789").replace("y más", "y\nNOT-9123456789,más")
    rows = [broken, odd, 'tres,"campos",x"', inside, broken + '"', GOOD]
    assert kinds(spark, [("noticias", "f", i, r) for i, r in enumerate(rows)]) == [
        (1, "estructura_invalida"), (2, "id_formato_invalido"), (3, "estructura_invalida"), (5, "estructura_invalida"),
    ]
    motives = {r.id: r.motivo for r in loaded(spark, [("noticias", "f", i, r) for i, r in enumerate(rows)]).errors.collect()}
    assert motives[1] == "comillas sin cerrar en el carácter 16" and motives[3] == "comillas dentro de un campo sin comillas en el carácter 16"


@settings(max_examples=300)
@given(st.lists(st.one_of(st.none(), st.text(alphabet='ab,"\n\r\x1e é', max_size=12)), max_size=6))
def test_a_block_reads_each_line_as_it_would_be_read_alone(block):
    def alone(line):
        if line is None:
            return None, 0
        try:
            return Grammar(line.removesuffix("\r")).record(0)[0], None
        except Fault as fault:
            return None, fault.at

    assert [(fields, at) for fields, at, _ in parse_lines(block)] == [alone(line) for line in block]
