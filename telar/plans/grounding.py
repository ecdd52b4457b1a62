"""Queries over evidence and its evaluation: names, figures, sections, noise, methods compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telar.functions import stats, text, urls
from telar.operators import metrics, vectors
from telar.operators import records as rec
from telar.operators.intervals import merge_intervals
from telar.operators.topics import keyword_topic
from telar.plans.analytics import _CENTRES, _COS, _HITS, _RULES, _SHEET, _sheet
from telar.plans.problems import _P2_PERIODS, _utc
from telar.plans.registry import Registry, Tables
from telar.plans.scalars import bare, spaced
from telar.session import cut
from telar.streaming import windows

registry = Registry()
query = registry.query


def _names() -> str:
    """SQL for the proper names of a text split into words ``w`` with cores ``c``."""
    return rf"""list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN regexp_matches(c[i], '^\p{{Lu}}') AND length(c[i]) >= 3 AND (
      NOT (i = 1 OR regexp_matches(coalesce(w[i - 1], ''), '[.?!:;¿¡«"“(—\[-]$')) OR (regexp_matches(coalesce(c[i + 1], ''), '^\p{{Lu}}') AND length(coalesce(c[i + 1], '')) >= 3
      AND regexp_matches(w[i], '[\p{{L}}\p{{N}}]$') AND regexp_matches(coalesce(w[i + 1], ''), '^[\p{{L}}\p{{N}}]'))) THEN c[i] END), lambda x: x IS NOT NULL)"""


def _worded(source: str, columns: str) -> str:
    """SQL for rows with words ``w`` and their cores ``c`` of ``titulo``."""
    return rf"""SELECT *, list_transform(w, lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS c FROM (SELECT {columns}, string_split(trim(regexp_replace(titulo, '\s+', ' ', 'g'), ' '), ' ') AS w FROM {source} WHERE titulo IS NOT NULL)"""


@query("z099_nombres_propios", f"WITH n AS ({_worded('noticias', 'fila')}) SELECT fila, array_to_string({_names()}, '|') AS nombres FROM n")
def proper_names(t: Tables) -> DataFrame:
    """Names in the headlines, sentence openings handled."""
    return t.noticias.where("titulo is not null").select("fila", F.array_join(text.proper_names(F.col("titulo")), "|").alias("nombres"))


@query("v06_nombres_nuevos", f"""
WITH h AS (SELECT DISTINCT id_noticia, lower(unnest({_names()})) AS nombre FROM ({_worded('hoja_preetiquetado', 'id_noticia')})), m AS (SELECT DISTINCT tema, lower(unnest({_names()})) AS nombre FROM ({_worded("(SELECT * FROM noticias WHERE origen = 'RSS')", 'tema')}))
SELECT id_noticia, nombre FROM h WHERE nombre NOT IN (SELECT nombre FROM m WHERE nombre IS NOT NULL)""")
def new_names(t: Tables) -> DataFrame:
    """V6: names in the sheet's headlines that no headline of the evidence (here the feeds') holds."""
    each = lambda df, *keys: df.where("titulo is not null").select(*keys, F.explode(text.proper_names(F.col("titulo"))).alias("n")).select(*keys, F.lower("n").alias("nombre")).distinct()
    known = each(t.noticias.where("origen = 'RSS'"))
    return each(t.hoja_preetiquetado, "id_noticia").join(known, "nombre", "left_anti").select("id_noticia", "nombre")


@query("z100_transiciones", rf"""
WITH n AS ({_worded('noticias', 'fila, titulo')})
SELECT fila, concat_ws(', ', CASE WHEN len(w) > 12 THEN 'larga' END, CASE WHEN regexp_matches(titulo, '[0-9]') THEN 'cifras' END, CASE WHEN regexp_matches({bare('titulo')}, 'grave|historic|terrible') THEN 'juicio' END,
  CASE WHEN len({_names()}) > 0 THEN 'nombres' END) AS problemas FROM n""")
def transitions(t: Tables) -> DataFrame:
    """Z100: what keeps a sentence without a citation from being a mere transition."""
    title, words = F.col("titulo"), F.size(F.split(F.trim(F.regexp_replace("titulo", r"\s+", " ")), " "))
    problems = F.concat_ws(", ", F.when(words > 12, "larga"), F.when(title.rlike("[0-9]"), "cifras"), F.when(text.bare(title).rlike("grave|historic|terrible"), "juicio"), F.when(F.size(text.proper_names(title)) > 0, "nombres"))
    return t.noticias.where("titulo is not null").select("fila", problems.alias("problemas"))


@query("v07_reglas_de_seccion", r"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, len(list_filter(string_split(regexp_replace(p, '[ \t\n\r\f\v]+', ' ', 'g'), ' '), lambda x: x <> '')) AS palabras, len(list_filter(string_split(p, '. '), lambda x: trim(x, ' ') <> '')) AS oraciones FROM s)
SELECT doc_id, count(*) AS secciones, max(palabras) AS mayor, coalesce(bool_or(palabras > 80), false) AS larga, coalesce(bool_or(oraciones > 6), false) AS muchas, CAST(sum(palabras) AS BIGINT) AS palabras, sum(palabras) > 200 AS excede FROM k GROUP BY 1""")
def sections(t: Tables) -> DataFrame:
    """V7: rules for each section of a text (words, sentences) and one across all of them."""
    rows = t.documents.where("text is not null").select("doc_id", F.explode(F.split("text", "\n\n")).alias("p"))
    words = F.size(F.filter(F.split(F.regexp_replace("p", r"[ \t\n\r\f\x0b]+", " "), " "), lambda x: x != "")).cast("long")
    sentences = F.size(F.filter(F.split("p", r"\. "), lambda x: F.trim(x) != ""))
    each = rows.select("doc_id", words.alias("w"), sentences.alias("s"))
    return each.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("secciones"), F.max("w").alias("mayor"), F.bool_or(F.col("w") > 80).alias("larga"), F.bool_or(F.col("s") > 6).alias("muchas"), F.sum("w").alias("palabras"), (F.sum("w") > 200).alias("excede"))


@query("z102_tipos_permitidos", """
WITH a AS (SELECT id_noticia, list_sort(list(DISTINCT tema_humano)) AS citados FROM hoja_preetiquetado WHERE tema_humano IN (SELECT tema FROM temas) GROUP BY 1)
SELECT id_noticia, array_to_string(list_filter(citados, lambda x: x NOT IN ('economia', 'turismo', 'logistica', 'regulacion')), ', ') AS ajenos FROM a""")
def allowed(t: Tables) -> DataFrame:
    """Z102: of the types a statement rests on, those that it may not."""
    cited = _sheet(t).groupBy("id_noticia").agg(F.array_sort(F.collect_set("tema_humano")).alias("c"))
    other = F.array_except("c", F.array(*map(F.lit, ("economia", "turismo", "logistica", "regulacion"))))
    return cited.select("id_noticia", F.array_join(other, ", ").alias("ajenos"))


@query("z103_leyenda_de_alcance", f"""
WITH g AS (SELECT source, count(*) AS textos, count_if(contains({bare('text')}, 'segun los datos')) AS con_leyenda FROM documents GROUP BY 1) SELECT source, textos, con_leyenda, con_leyenda = textos AS completo FROM g""")
def legend(t: Tables) -> DataFrame:
    """Z103: whether each text of a package carries its legend, and the whole package."""
    with_it = F.count_if(text.bare(F.col("text")).contains("segun los datos"))
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("textos"), with_it.alias("con_leyenda")).withColumn("completo", F.col("con_leyenda") == F.col("textos"))


def _bound(words: str) -> str:
    num = r"(\d+(?:[.,]\d+)?)\s*(?:%|por ciento)"
    fall, rise = "(cayeron|cayó|bajaron|bajó)", "(subieron|subió|crecieron|creció)"
    return rf"""SELECT doc_id, '{words.split("|")[0]}' AS indicador, CASE WHEN NOT regexp_matches(b, '({fall}|{rise})\s+(a|hasta)\s*$') AND regexp_matches(b, '{fall}') THEN -v ELSE v END AS valor,
  CASE WHEN regexp_matches(b, '({fall}|{rise})\s+(a|hasta)\s*$') THEN 'nivel' WHEN regexp_matches(b, '{fall}|{rise}') THEN 'variacion' ELSE 'nivel' END AS clase
  FROM (SELECT doc_id, regexp_extract(s, '(?:{words})([^0-9%]{{0,40}}?){num}', 1) AS b, regexp_extract(s, '(?:{words})([^0-9%]{{0,40}}?){num}', 2) AS f, TRY_CAST(replace(regexp_extract(s, '(?:{words})([^0-9%]{{0,40}}?){num}', 2), ',', '.') AS DOUBLE) AS v,
    list_distinct(regexp_extract_all(s, '{num}', 1)) AS every FROM o) WHERE len(every) = 1 AND f <> '' AND f = every[1] AND NOT regexp_matches(b, '(casi|cerca de|menos de|más de|unos|unas)')"""


@query("f12_porcentaje_ligado", rf"""
WITH o AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s FROM documents WHERE text IS NOT NULL), x AS ({_bound('precios|precio')} UNION ALL {_bound('ocupación')})
SELECT doc_id, indicador, valor, clase, count(*) AS n FROM x GROUP BY ALL""")
def bound_percentages(t: Tables) -> DataFrame:
    """the percentage that a sentence gives for an indicator, and whether it is a level or a change."""
    rows = t.documents.where("text is not null").select("doc_id", F.explode(F.split("text", r"\. ")).alias("s"))
    parts = []
    for words in (("precios", "precio"), ("ocupación",)):
        value, kind = text.bound_percentage(F.col("s"), words)
        parts.append(rows.select("doc_id", F.lit(words[0]).alias("indicador"), value.alias("valor"), kind.alias("clase")).where("clase is not null"))
    return parts[0].union(parts[1]).groupBy("doc_id", "indicador", "valor", "clase").agg(F.count(F.lit(1)).alias("n"))


_QUESTIONS = [("q1", "¿Qué sismos hubo en 2019 y en 2026?"), ("q2", "Corte de agua en Colombia"), ("q3", "Sismos de 2026 en Panamá y Costa Rica"), ("q4", "")]
_ASKED = ", ".join(f"('{q}', '{x}')" for q, x in _QUESTIONS)


@query("q05_periodo_de_sismos", rf"""
WITH q AS (SELECT pregunta, texto FROM (VALUES {_ASKED}) v(pregunta, texto) WHERE regexp_matches({bare('texto')}, 'sismo')), c AS (SELECT year(min(hora_utc) AT TIME ZONE 'UTC') AS a, year(max(hora_utc) AT TIME ZONE 'UTC') AS z FROM sismos)
SELECT DISTINCT pregunta, CAST(y AS INTEGER) AS anio, CAST(y AS INTEGER) NOT BETWEEN a AND z AS fuera FROM (SELECT pregunta, unnest(regexp_extract_all(texto, '(19|20)[0-9][0-9]')) AS y FROM q), c""")
def quake_period(t: Tables) -> DataFrame:
    """Q5: years that a question about quakes asks for and the catalogue doesn't cover."""
    asked = t.spark.createDataFrame(_QUESTIONS, "pregunta string, texto string").where(text.bare(F.col("texto")).rlike("sismo"))
    years = asked.select("pregunta", F.explode(F.regexp_extract_all("texto", F.lit("(19|20)[0-9][0-9]"), F.lit(0))).alias("y")).select("pregunta", F.col("y").cast("int").alias("anio")).distinct()
    covered = t.sismos.agg(F.year(F.to_utc_timestamp(F.min("hora_utc"), F.current_timezone())).alias("a"), F.year(F.to_utc_timestamp(F.max("hora_utc"), F.current_timezone())).alias("z"))
    return years.crossJoin(F.broadcast(covered)).select("pregunta", "anio", (~F.col("anio").between(F.col("a"), F.col("z"))).alias("fuera"))


@query("z065_paises_no_cubiertos", f"""
WITH q AS (SELECT pregunta, ' ' || {spaced('texto')} || ' ' AS x FROM (VALUES {_ASKED}) v(pregunta, texto)), p AS (SELECT DISTINCT pais FROM fuentes WHERE pais IS NOT NULL), k AS (SELECT DISTINCT pais FROM fuentes WHERE condiciones = 'Uso con cita' AND pais = 'Panamá')
SELECT pregunta, p.pais, p.pais NOT IN (SELECT pais FROM k) AS fuera FROM q JOIN p ON contains(x, ' ' || {spaced('p.pais')} || ' ')""")
def uncovered(t: Tables) -> DataFrame:
    """Countries that a question names, and whether they aren't covered; the list of countries is fixed."""
    asked = t.spark.createDataFrame(_QUESTIONS, "pregunta string, texto string")
    words = asked.select("pregunta", F.concat(F.lit(" "), text.spaced_key(F.col("texto")), F.lit(" ")).alias("x"))
    countries = t.fuentes.where("pais is not null").groupBy("pais").agg(F.lit(True).alias("k"))
    covered = t.fuentes.where("condiciones = 'Uso con cita' and pais = 'Panamá'").select("pais").distinct().withColumn("c", F.lit(True))
    named = F.col("x").contains(F.concat(F.lit(" "), text.spaced_key(F.col("pais")), F.lit(" ")))
    return words.join(F.broadcast(countries), named).join(covered, "pais", "left").select("pregunta", "pais", F.col("c").isNull().alias("fuera"))


@query("q06_orden_de_decision", f"""
SELECT fila, CASE WHEN titulo IS NULL OR trim(titulo, ' ') = '' THEN 'vacia' WHEN regexp_matches({bare('titulo')}, 'ignora|instruccion') THEN 'regla' WHEN regexp_matches({bare('titulo')}, 'sismo') AND zona IS NOT NULL THEN 'sismo'
  WHEN regexp_matches(titulo, '[0-9]') THEN 'cifra' WHEN len(list_intersect(string_split({spaced('titulo')}, ' '), ['agua', 'luz', 'familias', 'incendio'])) >= 1 THEN 'parecido' ELSE 'se_abstiene' END AS decision FROM noticias""")
def decisions(t: Tables) -> DataFrame:
    """Q6: the order in which an answer is decided: empty, rules, official record, figure, similarity, abstention."""
    b = text.bare(F.col("titulo"))
    alike = F.size(F.array_intersect(F.split(text.spaced_key(F.col("titulo")), " "), F.array(*map(F.lit, ("agua", "luz", "familias", "incendio"))))) >= 1
    made = (
        F.when(F.col("titulo").isNull() | (F.trim("titulo") == ""), "vacia").when(b.rlike("ignora|instruccion"), "regla").when(b.rlike("sismo") & F.col("zona").isNotNull(), "sismo")
        .when(F.col("titulo").rlike("[0-9]"), "cifra").when(alike, "parecido").otherwise("se_abstiene")
    )
    return t.noticias.select("fila", made.alias("decision"))


@query("p14_sujeta_a_mencion", r"""
SELECT fila, coalesce(list_has_any(list_transform(string_split(n.origen, '·'), lambda x: trim(x, ' ')), ['GDELT']), false) AND coalesce(pais, '') <> 'Panamá' AND coalesce(regexp_extract(trim(n.url, ' '), '^[^:]+://[^/?#]+/([^/?#]+)', 1), '') <> 'economia' AS sujeta
FROM noticias n LEFT JOIN (SELECT nombre_legible, min(pais) AS pais FROM fuentes GROUP BY 1) ON nombre_legible = medio""")
def mention(t: Tables) -> DataFrame:
    """Rows that must name the country: by origin, unless the outlet's country or the section exempts them."""
    outlets = t.fuentes.groupBy(F.col("nombre_legible").alias("medio")).agg(F.min("pais").alias("pais"))
    origin = F.coalesce(F.arrays_overlap(F.transform(F.split("origen", "·"), lambda x: F.trim(x)), F.array(F.lit("GDELT"))), F.lit(False))
    rest = (F.coalesce("pais", F.lit("")) != "Panamá") & (F.coalesce(urls.section(F.col("url")), F.lit("")) != "economia")
    return t.noticias.join(outlets, "medio", "left").select("fila", (origin & rest).alias("sujeta"))


@query("p16_ruido_por_prototipo", _CENTRES + " SELECT vec_id, max(list_cosine_similarity(embedding::DOUBLE[], c)) < 0.25 AS ruido FROM embeddings, c GROUP BY vec_id")
def prototype_noise(t: Tables) -> DataFrame:
    """Rows that resemble no prototype; the prototypes are counted and bounded."""
    rows = vectors.with_centroids(t.embeddings, vectors.centroids(t.embeddings, ["label"], "embedding"), "label")
    return rows.select("vec_id", (F.array_max(F.transform("cs", lambda c: stats.cosine(F.col("embedding"), c["centroid"]))) < 0.25).alias("ruido"))


@query("p17_ruido_sin_tema", f"SELECT fila, coalesce(regexp_matches({bare('titulo')}, 'fotos'), false) AS base, coalesce(regexp_matches({bare('titulo')}, 'fotos'), false) OR tema IS NULL AS es_ruido, coalesce(regexp_matches({bare('titulo')}, 'sismo'), false) AND zona IS NULL AS sin_impacto FROM noticias")
def topicless(t: Tables) -> DataFrame:
    """Rows without a topic are noise besides those that are so by rule, which stay known; and regional ones without impact."""
    base = F.coalesce(text.bare(F.col("titulo")).rlike("fotos"), F.lit(False))
    return t.noticias.select("fila", base.alias("base"), (base | F.col("tema").isNull()).alias("es_ruido"), (F.coalesce(text.bare(F.col("titulo")).rlike("sismo"), F.lit(False)) & F.col("zona").isNull()).alias("sin_impacto"))


@query("z029_limpieza", r"""
SELECT fila, nullif(trim(regexp_replace(titulo, '\s+', ' ', 'g'), ' '), '') AS limpio, titulo IS NULL AS sin_titulo, CASE WHEN titulo IS NULL THEN NULL WHEN tema IS NULL THEN titulo ELSE titulo || '. ' || replace(tema, '|', ', ') END AS para_codificar FROM noticias""")
def cleaned(t: Tables) -> DataFrame:
    """A cleaning projection that drops no row, and the text to encode, with the description where there is one."""
    encoded = F.when(F.col("tema").isNull(), F.col("titulo")).otherwise(F.concat("titulo", F.lit(". "), F.replace("tema", F.lit("|"), F.lit(", "))))
    return t.noticias.select("fila", F.nullif(F.trim(F.regexp_replace("titulo", r"\s+", " ")), F.lit("")).alias("limpio"), F.col("titulo").isNull().alias("sin_titulo"), encoded.alias("para_codificar"))


@query("z014_firma_a_tipo", """
SELECT fila, CASE WHEN medio LIKE 'Radio %' THEN 'radio' WHEN medio LIKE 'Diario %' THEN 'diario' WHEN medio LIKE 'El Eco%' OR medio LIKE 'La Voz%' THEN 'semanario' WHEN medio IS NOT NULL THEN 'otro' END AS tipo, CASE WHEN medio IS NOT NULL THEN split_part(medio, ' ', 1) END AS agencia FROM noticias""")
def signature(t: Tables) -> DataFrame:
    """A signature as kind and agency by ordered rules; the name itself is let go."""
    m = F.col("medio")
    kind = F.when(m.like("Radio %"), "radio").when(m.like("Diario %"), "diario").when(m.like("El Eco%") | m.like("La Voz%"), "semanario").when(m.isNotNull(), "otro")
    return t.noticias.select("fila", kind.alias("tipo"), F.substring_index(m, " ", 1).alias("agencia"))


@query("x01_codificador_ajeno", "SELECT fila, CAST(length(titulo) AS FLOAT) AS largo, CAST(length(regexp_replace(titulo, '[^aeiou]', '', 'g')) AS FLOAT) AS vocales FROM noticias WHERE titulo IS NOT NULL")
def foreign_encoder(t: Tables) -> DataFrame:
    """Any encoder of a list of texts as a matrix, run in Arrow batches."""
    found = vectors.encode(t.noticias.where("titulo is not null").select("fila", "titulo"), "titulo", lambda texts: [[len(x), sum(c in "aeiou" for c in x)] for x in texts], 2)
    return found.select("fila", F.get("embedding", F.lit(0)).alias("largo"), F.get("embedding", F.lit(1)).alias("vocales"))


@query("x03_validador", """
WITH c AS (SELECT DISTINCT id_noticia, tema_humano FROM hoja_preetiquetado WHERE tema_humano IS NOT NULL), m AS (SELECT DISTINCT id_noticia FROM noticias), k AS (SELECT DISTINCT id_noticia, trim(unnest(string_split(tema, '|')), ' ') AS tema FROM noticias WHERE tema IS NOT NULL)
SELECT c.id_noticia, tema_humano, CASE WHEN m.id_noticia IS NULL THEN 'no_existe' ELSE 'tema_ajeno' END AS problema FROM c LEFT JOIN m ON m.id_noticia = c.id_noticia LEFT JOIN k ON k.id_noticia = c.id_noticia AND k.tema = c.tema_humano WHERE k.tema IS NULL""")
def validator(t: Tables) -> DataFrame:
    """A validator of claims against a corpus, as a table of problems."""
    claims = t.hoja_preetiquetado.where("tema_humano is not null").select("id_noticia", "tema_humano").distinct()
    there = t.noticias.select("id_noticia").distinct().withColumn("m", F.lit(True))
    topics = t.noticias.where("tema is not null").select("id_noticia", F.explode(F.split("tema", r"\|")).alias("x")).select("id_noticia", F.trim("x").alias("tema_humano")).distinct()
    wrong = claims.join(topics, ["id_noticia", "tema_humano"], "left_anti").join(there, "id_noticia", "left")
    return wrong.select("id_noticia", "tema_humano", F.when(F.col("m").isNull(), "no_existe").otherwise("tema_ajeno").alias("problema"))


@query("x07_filas_por_enlace", """
WITH v AS (SELECT id_sismo, max(updated) AS u FROM sismos GROUP BY 1), s AS (SELECT DISTINCT s.id_sismo, zona, magnitud FROM sismos s JOIN v ON s.id_sismo = v.id_sismo AND updated = u)
SELECT id_sismo, unnest(['propio', 'zona']) AS papel, unnest([id_sismo, zona]) AS destino FROM s WHERE magnitud IS NOT NULL""")
def link_rows(t: Tables) -> DataFrame:
    """A function from one record to several rows: its links by role."""
    last = t.sismos.groupBy(F.col("id_sismo").alias("i")).agg(F.max("updated").alias("u"))
    rows = t.sismos.join(last, (F.col("id_sismo") == F.col("i")) & (F.col("updated") == F.col("u"))).where("magnitud is not null").select("id_sismo", "zona", "magnitud").distinct()
    each = F.array(F.struct(F.lit("propio").alias("papel"), F.col("id_sismo").alias("destino")), F.struct(F.lit("zona").alias("papel"), F.col("zona").alias("destino")))
    return rows.select("id_sismo", F.explode(each).alias("e")).select("id_sismo", "e.*")


@query("t07_huecos_del_flujo", _P2_PERIODS + """
SELECT DISTINCT tema, coalesce(pata, '') AS pata, strftime(antes AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS ini, strftime(ini AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS fin FROM h WHERE antes IS NOT NULL""")
def stream_gaps(t: Tables) -> DataFrame:
    """Intervals that a stream of responses has left uncovered, reported over what its sink holds."""
    stream = windows.file_stream(t.spark, f"{t.dir}/crudos_gdelt.parquet").where("clase = 'ok'").select("tema", "pata", "ini", "fin")
    merged = merge_intervals(windows.run_once(stream, "append"), ["tema", "pata"], "ini", "fin").where("kind = 'gap'")
    return merged.select("tema", F.coalesce("pata", F.lit("")).alias("pata"), _utc("start").alias("ini"), _utc("end").alias("fin")).distinct()


# Evaluation


@query("e04_macro_f1_por_metodo", f"""
WITH s AS (SELECT t, g, first_value(tema) OVER (ORDER BY tema) AS fijo FROM ({_SHEET}), (SELECT min(tema) AS tema FROM temas) WHERE g IS NOT NULL), m AS (SELECT 'propuesta' AS metodo, t, g FROM s UNION ALL SELECT 'fijo', t, fijo FROM s),
k AS (SELECT metodo, tema AS cls, count_if(t = tema AND g = tema) AS tp, count_if(t <> tema AND g = tema) AS fp, count_if(t = tema AND g <> tema) AS fn FROM temas, m GROUP BY 1, 2)
SELECT metodo, round(avg(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0)), 9) AS macro_f1, count(*) AS clases FROM k WHERE tp + fn > 0 GROUP BY 1""")
def macro_by_method(t: Tables) -> DataFrame:
    """Macro F1 of two methods over the same rows."""
    rows, fixed = _sheet(t).where("propuesta_tema is not null"), t.temas.agg(F.min("tema").alias("fijo"))
    both = [("propuesta", rows, "propuesta_tema"), ("fijo", rows.crossJoin(F.broadcast(fixed)), "fijo")]
    parts = [metrics.macro_f1(metrics.per_class(r, "tema_humano", g)).select(F.lit(n).alias("metodo"), F.round("macro_f1", 9).alias("macro_f1"), F.col("n_classes").alias("clases")) for n, r, g in both]
    return parts[0].union(parts[1])


@query("e04_diferencia_pareada")
def paired(t: Tables) -> DataFrame:
    """Macro F1 of keyword rules and of the proposals, their paired difference with its interval, and the decision."""
    rows = _sheet(t).withColumn("id", F.concat_ws("|", "id_noticia", "etiquetado_por", "fecha_etiquetado")).withColumn("reglas", F.coalesce(keyword_topic("titulo", _RULES), F.lit("ninguna")))
    return metrics.compare_macro_f1(rows, "id", "tema_humano", "reglas", "propuesta_tema", resamples=500)


@query("e11_pares_remuestreados")
def resampled_pairs(t: Tables) -> DataFrame:
    """Intervals of pair precision and recall when the headlines are resampled."""
    rows = t.hoja_preetiquetado.withColumn("g", F.lower(F.trim("grupo"))).withColumn("id", F.concat_ws("|", "id_noticia", "etiquetado_por", "fecha_etiquetado"))
    return metrics.resampled_pairs(rows, "id", "g", "id_grupo")


_FOUND = f"""WITH f AS (SELECT a.vec_id AS q, a.label, b.label AS l, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS k, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS j FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id),
h AS (SELECT q, count_if(k <= 5 AND l = label) AS ia, count_if(j <= 5 AND l = label) AS base, least(count_if(l = label), 5) AS posibles FROM f GROUP BY q)"""


def _hits(t: Tables) -> DataFrame:
    """Per query vector: hits among its five nearest others, among the five of smallest id, and the most there can be."""
    asked = t.embeddings.where("vec_id % 20 = 0")
    near = vectors.nearest(asked, t.embeddings, "vec_id", "embedding", 6).where("query <> id").withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where("k <= 5").select("query", "id")
    first = t.embeddings.select("vec_id", "label").orderBy("vec_id").limit(6)
    a, b = t.embeddings.select(F.col("vec_id").alias("query"), F.col("label").alias("x")), t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("y"))
    good = near.join(a, "query").join(b, "id").groupBy("query").agg(F.count_if(F.col("x") == F.col("y")).alias("ia"))
    order = Window.partitionBy("query").orderBy("vec_id")
    base = asked.select(F.col("vec_id").alias("query"), F.col("label").alias("x")).join(F.broadcast(first), F.col("query") != F.col("vec_id")).withColumn("j", F.row_number().over(order)).where("j <= 5")
    base = base.groupBy("query").agg(F.count_if(F.col("x") == F.col("label")).alias("base"))
    sizes = t.embeddings.groupBy(F.col("label").alias("x")).agg(F.least(F.count(F.lit(1)) - 1, F.lit(5)).alias("posibles"))
    return good.join(base, "query").join(a, "query").join(sizes, "x").select(F.col("query").alias("q"), "ia", "base", "posibles")


@query("z078_ganador_por_consulta", _FOUND + " SELECT q, ia, base, CASE WHEN ia > base THEN 'gana_ia' WHEN ia < base THEN 'gana_base' WHEN ia = posibles THEN 'empate_completo' ELSE 'empate_incompleto' END AS categoria FROM h")
def winners(t: Tables) -> DataFrame:
    """Which of two methods finds more of what a query expects."""
    ia, base = F.col("ia"), F.col("base")
    won = F.when(ia > base, "gana_ia").when(ia < base, "gana_base").when(ia == F.col("posibles"), "empate_completo").otherwise("empate_incompleto")
    return _hits(t).select("q", "ia", "base", won.alias("categoria"))


@query("e07_consultas_falladas", _FOUND + " SELECT q, posibles - ia AS faltan FROM h WHERE ia < posibles")
def failures(t: Tables) -> DataFrame:
    """Queries that miss something they expect, and how much."""
    return _hits(t).where("ia < posibles").select("q", (F.col("posibles") - F.col("ia")).alias("faltan"))


@query("e07_recuerdo_remuestreado")
def recall_interval(t: Tables) -> DataFrame:
    """Micro recall with an interval over resampled queries."""
    rows = _hits(t)
    w = metrics.resample(rows, "q", [], F.col("ia"), 1000, 42).select("r", F.col("s").alias("a")).join(metrics.resample(rows, "q", [], F.col("posibles"), 1000, 42).select("r", F.col("s").alias("b")), "r")
    point = rows.agg((F.sum("ia") / F.sum("posibles")).alias("recuerdo"), F.count(F.lit(1)).alias("consultas"))
    return point.crossJoin(metrics.interval(w.select((F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("x")), "x"))


@query("e13_regla_percentil", """
WITH c AS (SELECT quantile_cont(p_retailprice, 0.9) AS cut FROM part WHERE NOT p_size > 25) SELECT round(cut, 6) AS cut, count_if(p_retailprice > cut AND p_size > 25) AS tp, count_if(p_retailprice > cut AND NOT p_size > 25) AS fp, count_if(p_retailprice <= cut AND p_size > 25) AS fn FROM part, c GROUP BY cut""")
def percentile_rule(t: Tables) -> DataFrame:
    """The threshold that lets a tenth of the negatives through, and who reaches it."""
    yes, score = F.col("p_size") > 25, F.col("p_retailprice")
    cut = t.part.where(~yes).agg(F.percentile(score, F.lit(0.9)).alias("cut"))
    rows = t.part.crossJoin(F.broadcast(cut))
    return rows.groupBy("cut").agg(F.count_if((score > F.col("cut")) & yes).alias("tp"), F.count_if((score > F.col("cut")) & ~yes).alias("fp"), F.count_if((score <= F.col("cut")) & yes).alias("fn")).withColumn("cut", F.round("cut", 6))


@query("e22_umbral_por_pliegues", f"""
WITH p AS (SELECT a.label % 5 AS fold, floor(round({_COS} / 0.05, 9))::INT AS cell, a.label = b.label AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} > 0.2),
k AS (SELECT fold, cell, count_if(s) AS t, count_if(NOT s) AS f FROM p GROUP BY 1, 2), g AS (SELECT DISTINCT cell FROM k), d AS (SELECT DISTINCT fold FROM k),
m AS (SELECT d.fold, g.cell, sum(coalesce(t, 0)) OVER w AS tp, sum(coalesce(f, 0)) OVER w AS fp, sum(coalesce(t, 0)) OVER (PARTITION BY d.fold) AS true_ FROM d CROSS JOIN g LEFT JOIN k ON k.fold = d.fold AND k.cell = g.cell WINDOW w AS (PARTITION BY d.fold ORDER BY g.cell DESC)),
e AS (SELECT *, sum(tp) OVER (PARTITION BY cell) - tp AS otp, sum(fp) OVER (PARTITION BY cell) - fp AS ofp, sum(true_) OVER (PARTITION BY cell) - true_ AS ot FROM m)
SELECT fold, round(cell * 0.05, 9) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (true_ - tp)::BIGINT AS fn FROM e QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(2 * otp / nullif((otp + ofp + ot)::DOUBLE, 0), 12) DESC NULLS LAST, cell) = 1""")
def folded(t: Tables) -> DataFrame:
    """A threshold chosen on the other folds of events and judged on its own."""
    edges = vectors.similar_edges(t.embeddings, "vec_id", "embedding", 0.2)
    a, b = t.embeddings.select(F.col("vec_id").alias("a"), F.col("label").alias("x")), t.embeddings.select(F.col("vec_id").alias("b"), F.col("label").alias("y"))
    return metrics.cross_validated_threshold(edges.join(a, "a").join(b, "b"), "similarity", F.col("x") == F.col("y"), F.col("x") % 5, 0.05)


@query("z083_pares_mas_parecidos", f"""
SELECT a.vec_id AS prueba, b.vec_id AS referencia, round({_COS}, 6) AS similitud FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a, (SELECT * FROM embeddings WHERE vec_id % 20 <> 0) b ORDER BY round({_COS}, 9) DESC, a.vec_id, b.vec_id LIMIT 20""")
def closest(t: Tables) -> DataFrame:
    """The twenty most similar pairs of a test set (ids divisible by 20) and all other vectors (a top-k report)."""
    found = vectors.nearest(t.embeddings.where("vec_id % 20 = 0"), t.embeddings.where("vec_id % 20 <> 0"), "vec_id", "embedding", 20)
    best = found.orderBy(F.desc(F.round("similarity", 9)), "query", "id").limit(20)
    return best.select(F.col("query").alias("prueba"), F.col("id").alias("referencia"), F.round("similarity", 6).alias("similitud"))


@query("z106_predicciones", f"""
WITH b AS (SELECT id_noticia, tema_humano, propuesta_tema, {bare('titulo')} AS b FROM hoja_preetiquetado WHERE tema_humano IN (SELECT tema FROM temas)), h AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _HITS.items())} FROM b),
m AS (SELECT tema_humano, 'reglas' AS metodo, CASE WHEN greatest({", ".join(_HITS)}) = 0 THEN NULL {" ".join(f"WHEN {k} = greatest({', '.join(_HITS)}) THEN '{k}'" for k in _HITS)} END AS prediccion FROM h UNION ALL SELECT tema_humano, 'propuesta', propuesta_tema FROM h)
SELECT metodo, prediccion, count(*) AS n, count_if(coalesce(prediccion = tema_humano, false)) AS aciertos FROM m GROUP BY ALL""")
def predictions(t: Tables) -> DataFrame:
    """Z106: predictions of all methods for the same texts, in one table."""
    rows = _sheet(t).select("tema_humano", keyword_topic("titulo", _RULES).alias("reglas"), F.col("propuesta_tema").alias("propuesta"))
    long = rows.unpivot(["tema_humano"], ["reglas", "propuesta"], "metodo", "prediccion")
    return long.groupBy("metodo", "prediccion").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("prediccion") == F.col("tema_humano"), F.lit(False))).alias("aciertos"))


_PAIRS = "WITH m AS (SELECT DISTINCT id_grupo, id_noticia FROM hoja_preetiquetado WHERE id_grupo IS NOT NULL), p AS (SELECT DISTINCT min(id_noticia) OVER (PARTITION BY id_grupo) AS a, id_noticia AS b FROM m), q AS (SELECT a, b FROM p WHERE a <> b)"


@query("k07_seleccion_sin_repetir", _PAIRS + "".join(
    f", s{i} AS (SELECT {i} AS orden, min((a, b)) AS p FROM q WHERE true" + "".join(f" AND NOT coalesce(a IN (SELECT unnest([p[1], p[2]]) FROM s{j}), false) AND NOT coalesce(b IN (SELECT unnest([p[1], p[2]]) FROM s{j}), false)" for j in range(1, i)) + ")" for i in range(1, 6)
) + " SELECT orden, p[1] AS a, p[2] AS b FROM (" + " UNION ALL ".join(f"FROM s{i}" for i in range(1, 6)) + ") WHERE p IS NOT NULL")
def greedy(t: Tables) -> DataFrame:
    """The first five pairs of headlines of one group in which no headline comes twice."""
    members = t.hoja_preetiquetado.where("id_grupo is not null").select("id_grupo", "id_noticia").distinct()
    first = members.groupBy("id_grupo").agg(F.min("id_noticia").alias("a"))
    pairs = members.join(first, "id_grupo").where("a <> id_noticia").select("a", F.col("id_noticia").alias("b")).distinct()
    return rec.greedy_pairs(pairs, "a", "b", 5)


@query("z088_etiquetas_reunidas", """
WITH a AS (SELECT DISTINCT id_noticia, tema_humano FROM hoja_preetiquetado WHERE bloque LIKE 'A%' AND tema_humano IS NOT NULL), b AS (SELECT DISTINCT id_noticia, propuesta_tema FROM hoja_preetiquetado WHERE bloque LIKE 'B%' AND propuesta_tema IS NOT NULL)
SELECT id_noticia, tema_humano AS tema, 'persona' AS de FROM a UNION ALL SELECT id_noticia, propuesta_tema, 'hoja' FROM b WHERE id_noticia NOT IN (SELECT id_noticia FROM a)""")
def gathered(t: Tables) -> DataFrame:
    """people's labels, and confirmed rows of the sheet for what they haven't labelled."""
    own = t.hoja_preetiquetado.where("bloque like 'A%' and tema_humano is not null").select("id_noticia", F.col("tema_humano").alias("tema")).distinct()
    rest = t.hoja_preetiquetado.where("bloque like 'B%' and propuesta_tema is not null").select("id_noticia", F.col("propuesta_tema").alias("tema")).distinct()
    return own.withColumn("de", F.lit("persona")).union(rest.join(own.select("id_noticia").distinct(), "id_noticia", "left_anti").withColumn("de", F.lit("hoja")))


@query("e13_uno_fuera")
def left_out(t: Tables) -> DataFrame:
    """How the quakes' chosen cut does on each zone's share of reviewed quakes left out of its choice."""
    zones = t.sismos.where("zona is not null").groupBy("zona").agg(F.round(F.avg(F.coalesce(F.col("estado") == "reviewed", F.lit(False)).cast("int")), 3).alias("x"), (F.avg("magnitud") > 3).alias("y")).where("y is not null")
    return metrics.leave_one_out(zones, "x", F.col("y"))


_CUTS = (0.42, 0.5)


@query("z092_reagrupado", "WITH RECURSIVE " + ", ".join(
    f"""g{i} AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} > {c}), e{i} AS (SELECT a, b FROM g{i} UNION SELECT b, a FROM g{i}),
r{i} AS (SELECT vec_id AS id, vec_id AS x FROM embeddings UNION SELECT r{i}.id, e{i}.b FROM r{i} JOIN e{i} ON r{i}.x = e{i}.a), c{i} AS (SELECT m, count(*) AS n FROM (SELECT id, min(x) AS m FROM r{i} GROUP BY id) GROUP BY m)""" for i, c in enumerate(_CUTS)
) + " " + " UNION ALL ".join(f"SELECT {c}::DOUBLE AS umbral, count(*) AS grupos, max(n) AS mayor, count(*) FILTER (WHERE n = 1) AS solos FROM c{i}" for i, c in enumerate(_CUTS)))
def regrouped(t: Tables) -> DataFrame:
    """The grouping again under varied rules, and the figures that hang on it; edges are found once."""
    edges = cut(vectors.similar_edges(t.embeddings, "vec_id", "embedding", min(_CUTS)))
    parts = []
    for c in _CUTS:
        found = vectors.components(edges.where(F.col("similarity") > c), t.embeddings, "vec_id").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        parts.append(found.agg(F.lit(c).alias("umbral"), F.count(F.lit(1)).alias("grupos"), F.max("n").alias("mayor"), F.count_if(F.col("n") == 1).alias("solos")).select("umbral", "grupos", "mayor", "solos"))
    return parts[0].union(parts[1])


@query("m04_con_descripcion", """
WITH d AS (SELECT tema, nombre AS x FROM temas UNION ALL SELECT tema_humano, titulo FROM hoja_preetiquetado WHERE titulo IS NOT NULL AND tema_humano IN (SELECT tema FROM temas)),
v AS (SELECT tema, length(x)::DOUBLE AS a, length(regexp_replace(x, '[^aeiou]', '', 'g'))::DOUBLE AS b FROM d), u AS (SELECT tema, a / sqrt(a * a + b * b) AS a, b / sqrt(a * a + b * b) AS b FROM v WHERE a > 0), m AS (SELECT tema, count(*) AS textos, avg(a) AS a, avg(b) AS b FROM u GROUP BY tema)
SELECT tema, textos, round(a / sqrt(a * a + b * b), 6) AS c1, round(b / sqrt(a * a + b * b), 6) AS c2 FROM m""")
def described(t: Tables) -> DataFrame:
    """M4: topic centroids of their description together with examples, by an encoder put in."""
    examples = _sheet(t).where("titulo is not null").select(F.col("tema_humano").alias("tema"), F.col("titulo").alias("x"))
    rows = t.temas.select("tema", F.col("nombre").alias("x")).union(examples).where("length(x) > 0")
    coded = vectors.encode(rows, "x", lambda texts: [[len(x), sum(c in "aeiou" for c in x)] for x in texts], 2).withColumn("u", stats.unit(F.col("embedding")))
    sizes = coded.groupBy("tema").agg(F.count(F.lit(1)).alias("textos"))
    return vectors.centroids(coded, ["tema"], "u").join(sizes, "tema").select("tema", "textos", F.round(F.get("centroid", F.lit(0)), 6).alias("c1"), F.round(F.get("centroid", F.lit(1)), 6).alias("c2"))


QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
