"""Queries of the problems of training data over the project's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm import consensus
from telar.llm.dedup_format import canonical_text, canonical_url, duplicate_records, duplicate_rows
from telar.llm.event_clusters import event_clusters
from telar.llm.language import fit, language_runs
from telar.llm.mixing import mix
from telar.llm.nearest_time import instant, nearest_in_time
from telar.llm.packing import fill_report, pack
from telar.llm.page_shapes import judge_pages
from telar.llm.tokens import token_count
from telar.plans.scalars import CANONICAL
from telar.session import cut, table


def _quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each quake, if it has a magnitude and isn't withdrawn."""
    versions = table(spark, sf_dir, "sismos").where("id_sismo is not null")
    latest = versions.groupBy("id_sismo").agg(F.max(F.struct("updated", "hora_utc", "zona", "magnitud", "estado")).alias("v"))
    return latest.select("id_sismo", "v.*").where("magnitud is not null and coalesce(estado, '') <> 'deleted'")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "noticias").where("zona is not null").select("fila", "zona", instant(F.col("fecha_publicacion")).alias("t"))
    return nearest_in_time(news, _quakes(spark, sf_dir), "fila", "zona", "t", "id_sismo", "zona", "hora_utc", tolerance_s=48 * 3600)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each news row about a quake with the quake of its zone nearest in time, within 48 hours."""
    return _pairs(spark, sf_dir).select(F.col("row_id").alias("fila"), F.col("match_id").alias("id_sismo")).distinct()


def p1_pares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p1_found with their distance in seconds."""
    return _pairs(spark, sf_dir).select(
        F.col("row_id").alias("fila"), F.col("match_id").alias("id_sismo"), (F.col("distance_us") / 1e6).alias("distancia_s")
    )


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fila, the language its label names or null, and the runs of its headline."""
    forms = table(spark, sf_dir, "idiomas").where("forma is not null").groupBy("forma").agg(F.min("idioma").alias("nombrado"))
    news = table(spark, sf_dir, "noticias").select("fila", "titulo", F.lower(F.trim("idioma")).alias("etiqueta"))
    named = news.join(forms, F.col("etiqueta") == F.col("forma"), "left").select("fila", "titulo", "nombrado")
    model = fit(named, "titulo", "nombrado")
    return named.select("fila", "nombrado", language_runs(named, model, F.col("titulo")).alias("tramos"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the headlines that mix languages or whose label is missing or wrong."""
    rows = _languages(spark, sf_dir)
    case = (F.size("tramos") > 1) | F.col("nombrado").isNull() | (F.col("nombrado") != F.get("tramos", F.lit(0))["language"])
    return rows.where(case).select("fila", F.posexplode("tramos").alias("k", "t")).select("fila", (F.col("k") + 1).alias("segmento"), F.col("t.language").alias("idioma"))


def p3_idiomas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every headline's runs with language, confidence and text."""
    rows = _languages(spark, sf_dir).select("fila", "nombrado", F.posexplode("tramos").alias("k", "t"))
    return rows.select("fila", "nombrado", (F.col("k") + 1).alias("segmento"), F.col("t.language").alias("idioma"), F.col("t.confidence").alias("confianza"), F.col("t.text").alias("texto"))


_MOST_CLASSES = 1000
# Fixed value: letters with accents and what they are without.
_ACCENTED, _PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"


def _loose(column: str) -> Column:
    """Lower case without accents, underscores, hyphens and blanks."""
    return F.regexp_replace(F.translate(F.lower(F.col(column)), _ACCENTED, _PLAIN), r"[\u0300-\u036f_\-\s]+", "")


def _annotations(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(consensus, annotators) of each field."""
    sheet = table(spark, sf_dir, "hoja_preetiquetado")
    themes = table(spark, sf_dir, "temas").where("tema is not null")
    rows = sheet.withColumn("cuando", F.struct(instant(F.col("fecha_etiquetado")), F.col("fecha_etiquetado")))
    # Values of plain letters, figures, blanks, hyphens and underscores need no search through Unicode's classes.
    plain, low = F.col("grupo").rlike("^[A-Za-z0-9 _-]*$"), F.lower(F.trim("grupo"))
    joined = F.when(plain, F.regexp_replace(F.translate(low, " _", "--"), "--+", "-")).otherwise(F.regexp_replace(low, r"[^\p{L}\p{N}\p{M}]+", "-"))
    latest = consensus.latest_labels(rows, "id_noticia", "etiquetado_por", "cuando", ["tema_humano", "grupo"])
    # Written with the forms made, so that filters on them don't make them again; a blank form is no label.
    latest = cut(latest.select("item", "annotator", _loose("tema_humano").alias("forma"), F.regexp_replace(joined, "^-|-$", "").alias("grupo")))
    items = cut(sheet.where("id_noticia is not null").groupBy(F.col("id_noticia").alias("item")).agg(F.min("titulo").alias("text"), F.min("propuesta_tema").alias("hint")))
    keys = themes.select(_loose("tema").alias("forma"), "tema").union(themes.select(_loose("nombre").alias("forma"), "tema"))
    keys = keys.where("forma <> ''").groupBy("forma").agg(F.min("tema").alias("value"))
    tema = latest.join(keys, "forma").select("item", "annotator", "value")
    grupo = latest.select("item", "annotator", F.col("grupo").alias("value"))
    classes = sorted(r.tema for r in themes.select("tema").distinct().limit(_MOST_CLASSES + 1).collect())
    if len(classes) > _MOST_CLASSES:
        raise ValueError(f"more than {_MOST_CLASSES} values of temas.tema")
    return {"tema_humano": consensus.closed(tema, items, classes), "grupo": consensus.open_values(grupo, items)}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agreed value of each headline and field with labels from at least three annotators."""
    fields = [
        agreed.where("n_labels >= 3").select(F.col("item").alias("id_noticia"), F.lit(field).alias("campo"), F.col("value").alias("valor"))
        for field, (agreed, _) in _annotations(spark, sf_dir).items()
    ]
    return fields[0].unionByName(fields[1])


def p4_consenso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled headline and field: agreed value, confidence and agreement."""
    fields = [
        agreed.select(F.col("item").alias("id_noticia"), F.lit(field).alias("campo"), F.col("value").alias("valor"), F.col("confidence").alias("confianza"), F.col("agreement").alias("acuerdo"), F.col("n_labels").alias("n_etiquetas"))
        for field, (agreed, _) in _annotations(spark, sf_dir).items()
    ]
    return fields[0].unionByName(fields[1])


def p4_anotadores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each annotator in each field."""
    fields = [
        who.select(F.col("annotator").alias("anotador"), F.lit(field).alias("campo"), F.col("reliability").alias("fiabilidad"), F.col("n_labels").alias("n_etiquetas"))
        for field, (_, who) in _annotations(spark, sf_dir).items()
    ]
    return fields[0].unionByName(fields[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of headlines that report one event; a large event's pairs are made in parts of its first members."""
    groups = cut(event_clusters(table(spark, sf_dir, "hoja_preetiquetado"), "id_noticia", "titulo").where("size > 1").select("id", "cluster", "size"))
    parts = F.ceil(F.col("size") / 1000).cast("int")
    first = groups.select(F.col("id").alias("id_a"), "cluster", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    second = groups.select(F.col("id").alias("id_b"), "cluster", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return first.join(second.hint("merge"), ["cluster", "part"]).where("id_a < id_b").select("id_a", "id_b")


def p5_grupos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each headline's group with its size and most typical headline."""
    groups = event_clusters(table(spark, sf_dir, "hoja_preetiquetado"), "id_noticia", "titulo")
    return groups.select(F.col("id").alias("id_noticia"), F.col("cluster").alias("grupo"), F.col("size").alias("n_titulares"), F.col("typical").alias("titular_tipico"))


_P7 = {"titulo": canonical_text, "url": canonical_url}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repeated news row with the first row of its record."""
    rows = duplicate_rows(table(spark, sf_dir, "noticias"), "fila", _P7)
    return rows.select(F.col("first").alias("fila_a"), F.col("row").alias("fila_b"))


def p7_registros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its first row and its number of copies."""
    return duplicate_records(table(spark, sf_dir, "noticias"), "fila", _P7).select(F.col("first").alias("fila"), F.col("copies").alias("copias"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and tokens of each document, counted once."""
    documents = table(spark, sf_dir, "documents")
    return cut(documents.select("doc_id", "source", token_count(F.col("text")).alias("tokens")))


def p8_contenedores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents and the container each is put in, for each capacity."""
    boxes = table(spark, sf_dir, "contenedores")
    packed = pack(_tokens(spark, sf_dir), boxes, "doc_id", "tokens", "nombre", "capacidad_tokens")
    return packed.select(
        F.col("container").alias("nombre"), F.col("bin").alias("contenedor"), F.col("id").alias("doc_id"), F.col("part").alias("parte"),
        F.col("from_token").alias("desde"), F.col("to_token").alias("hasta"), F.col("size").alias("tokens"),
    )


def p8_llenado(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, for each capacity."""
    boxes = table(spark, sf_dir, "contenedores")
    packed = pack(_tokens(spark, sf_dir), boxes, "doc_id", "tokens", "nombre", "capacidad_tokens")
    return fill_report(packed, boxes, "nombre", "capacidad_tokens")


def _mixed(spark: SparkSession, sf_dir: str, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix at which every source has its weight; ``full``: of as many tokens as the target sources hold."""
    targets, tokens = table(spark, sf_dir, "mezcla_objetivo"), _tokens(spark, sf_dir)
    total = None
    if full:
        wanted = tokens.join(targets.select("source").distinct(), "source", "left_semi")
        total = float(wanted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    return mix(tokens, targets, "doc_id", "source", "tokens", "source", "peso_objetivo", "max_repeticiones", total=total)


def _mix_rows(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "source", "tokens", F.col("mix_copy").alias("copia"), F.col("mix_order").alias("orden"))


def p9_mezcla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: a row per use of a document, in shuffled order."""
    return _mix_rows(_mixed(spark, sf_dir)[0])


def p9_reparto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, effective and actual shares of the sources of the mix, and what is left out."""
    return _mixed(spark, sf_dir)[1]


def p9_mezcla_plena(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of as many tokens as the target sources hold: short sources go to their caps, the others share the rest."""
    return _mix_rows(_mixed(spark, sf_dir, full=True)[0])


def p9_reparto_pleno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, effective and actual shares of the sources of the full mix, and what is left out."""
    return _mixed(spark, sf_dir, full=True)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly keywords, links or tags."""
    return judge_pages(table(spark, sf_dir, "documents"), "doc_id", "text").where("flagged").select(F.col("id").alias("doc_id")).distinct()


def p10_paginas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of non-sentence shapes of every document."""
    return judge_pages(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


_P1_SQL = r"""
WITH v AS (SELECT * FROM sismos WHERE id_sismo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id_sismo ORDER BY updated DESC NULLS LAST, hora_utc DESC) = 1),
q AS (SELECT id_sismo, zona, hora_utc FROM v WHERE magnitud IS NOT NULL AND coalesce(estado, '') <> 'deleted'),
n AS (SELECT fila, zona, trim(fecha_publicacion) AS f FROM noticias WHERE zona IS NOT NULL),
t AS (SELECT fila, zona, CASE
  WHEN regexp_full_match(f, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})') THEN try_cast(f AS TIMESTAMPTZ)
  WHEN regexp_full_match(f, '\d{8}T\d{6}Z') THEN try_strptime(f || '+0000', '%Y%m%dT%H%M%SZ%z')
  WHEN regexp_full_match(f, '[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} GMT') THEN try_strptime(replace(f[6:], 'GMT', '+0000'), '%d %b %Y %H:%M:%S %z')
  END AS t FROM n),
p AS (SELECT t.fila, q.id_sismo, abs(epoch_us(t.t) - epoch_us(q.hora_utc)) AS d, q.hora_utc FROM t JOIN q USING (zona)),
b AS (SELECT * FROM p WHERE d <= 48 * 3600 * 1000000::BIGINT QUALIFY row_number() OVER (PARTITION BY fila ORDER BY d, hora_utc, id_sismo) = 1)
"""

# Escapes of letters become the letter and its combining mark, which NFC composes; the others stand for punctuation.
_PLAIN_TITLE = "replace(replace(replace(titulo, '&amp;', '&'), '&amp;', '&'), '&szlig;', 'ß')"
for _name, _mark in {"acute": 0x301, "grave": 0x300, "circ": 0x302, "tilde": 0x303, "uml": 0x308, "cedil": 0x327, "ring": 0x30A}.items():
    _PLAIN_TITLE = f"regexp_replace({_PLAIN_TITLE}, '&([A-Za-z]){_name};', '\\1' || chr({_mark}), 'g')"
for _form, _value in (("&#[0-9]+;", "m[3:-2]"), ("&#[xX][0-9a-fA-F]+;", "('0x' || m[4:-2])")):
    _PLAIN_TITLE = f"list_reduce(list_prepend({_PLAIN_TITLE}, regexp_extract_all({_PLAIN_TITLE}, '{_form}')), lambda a, m: replace(a, m, chr(CAST({_value} AS INTEGER))))"
_PLAIN_TITLE = f"regexp_replace({_PLAIN_TITLE}, '&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z]+);', ' ', 'g')"
_P7_SQL = f"""
WITH n AS (SELECT fila, regexp_replace(replace(lower(nfc_normalize({_PLAIN_TITLE})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\x{{300}}-\\x{{36f}}]+', '', 'g') AS k, {CANONICAL} AS u FROM noticias WHERE titulo IS NOT NULL AND url IS NOT NULL),
g AS (SELECT k, u, min(fila) AS primera, count(*) AS copias FROM n GROUP BY 1, 2)
"""

QUERIES = {
    "p1_found": p1_found, "p1_pares": p1_pares, "p3_found": p3_found, "p3_idiomas": p3_idiomas,
    "p4_found": p4_found, "p4_consenso": p4_consenso, "p4_anotadores": p4_anotadores,
    "p5_found": p5_found, "p5_grupos": p5_grupos,
    "p7_found": p7_found, "p7_registros": p7_registros,
    "p8_contenedores": p8_contenedores, "p8_llenado": p8_llenado, "p9_mezcla": p9_mezcla, "p9_reparto": p9_reparto,
    "p9_mezcla_plena": p9_mezcla_plena, "p9_reparto_pleno": p9_reparto_pleno,
    "p10_found": p10_found, "p10_paginas": p10_paginas,
}
ORACLE = {
    "p1_found": _P1_SQL + "SELECT fila, id_sismo FROM b",
    "p7_found": _P7_SQL + "SELECT primera AS fila_a, fila AS fila_b FROM n JOIN g USING (k, u) WHERE fila > primera",
    "p7_registros": _P7_SQL + "SELECT primera AS fila, copias FROM g",
    "p1_pares": _P1_SQL + "SELECT fila, id_sismo, d / 1e6 AS distancia_s FROM b",
}
