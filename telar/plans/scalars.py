"""Queries over scalar functions: text, addresses, dates, figures, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.functions import stats, text, urls
from telar.plans.registry import Registry, Tables

registry = Registry()
query = registry.query

# DuckDB's counterparts of the functions used here.
_M, _U = text.MARKED, text.UNMARKED
BARE = f"regexp_replace(translate(replace(lower(#), 'ß', 'ss'), '{_M}', '{_U}'), '[\\x{{300}}-\\x{{36f}}]+', '', 'g')"


def bare(c: str) -> str:
    return BARE.replace("#", c)


def spaced(c: str) -> str:
    return f"trim(regexp_replace({bare(c)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def alnum(c: str) -> str:
    return f"regexp_replace({bare(c)}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query("f01_forma_normal", f"SELECT fila, {bare('titulo')} AS llano, {alnum('titulo')} AS clave, {spaced('titulo')} AS separada FROM noticias")
def normal_forms(t: Tables) -> DataFrame:
    """Bare, alphanumeric and spaced forms of every headline."""
    return t.noticias.select("fila", text.bare(F.col("titulo")).alias("llano"), text.alnum_key(F.col("titulo")).alias("clave"), text.spaced_key(F.col("titulo")).alias("separada"))


_ENT, _STRAIGHT = "titulo", '"' * 5 + "''" * 2
for _e, _p in text.ENTITIES.items():
    _ENT = f"replace({_ENT}, '{_e}', '{_p.replace(chr(39), chr(39) * 2)}')"


@query("f04_titulo_limpio", f"""SELECT fila, nullif(trim(regexp_replace(regexp_replace(translate({_ENT}, '“”„«»‘’', '{_STRAIGHT}'), '\\s*\\(fotos\\)\\s*$', '', 'g'), '\\s+', ' ', 'g'), ' '), '') AS limpio FROM noticias""")
def clean_titles(t: Tables) -> DataFrame:
    """resolved, straightened and collapsed headlines."""
    return t.noticias.select("fila", text.clean_title(F.col("titulo"), {r"\s*\(fotos\)\s*$": ""}).alias("limpio"))


@query("f05_sin_sufijo", f"""
WITH a AS (SELECT fila, medio, coalesce(titulo || ' | ' || medio, titulo) AS titulo FROM noticias),
b AS (SELECT *, regexp_extract(titulo, '(?s)^(.*) \\| (.*)$', 1) AS frente, regexp_extract(titulo, '(?s)^(.*) \\| (.*)$', 2) AS cola FROM a)
SELECT fila, CASE WHEN contains(titulo, ' | ') AND {alnum("cola")} = {alnum('medio')} AND len(string_split(frente, ' ')) >= 3 THEN frente ELSE titulo END AS sin_medio FROM b""")
def no_suffix(t: Tables) -> DataFrame:
    """headlines without a final outlet name, which is added here first."""
    named = F.coalesce(F.concat("titulo", F.lit(" | "), "medio"), "titulo")
    return t.noticias.withColumn("t", named).select("fila", text.without_suffix(F.col("t"), F.col("medio"), (" | ",)).alias("sin_medio"))


@query("f06_contiene_palabra", f"SELECT fila, regexp_matches({bare('titulo')}, '(^|[^\\p{{L}}\\p{{N}}_])agua($|[^\\p{{L}}\\p{{N}}_])') AS agua, regexp_matches({bare('titulo')}, '(^|[^\\p{{L}}\\p{{N}}_])camara del istmo($|[^\\p{{L}}\\p{{N}}_])') AS camara FROM noticias")
def words_in(t: Tables) -> DataFrame:
    """whole words and phrases in headlines."""
    return t.noticias.select("fila", text.has_word(F.col("titulo"), "agua").alias("agua"), text.has_word(F.col("titulo"), "Cámara del Istmo").alias("camara"))


@query("f07_sigla", "SELECT fila, regexp_matches(titulo, '(^|[^\\p{L}\\p{N}_])La($|[^\\p{L}\\p{N}_])') AS sigla FROM noticias")
def acronyms(t: Tables) -> DataFrame:
    """a form whose case counts."""
    return t.noticias.select("fila", text.has_acronym(F.col("titulo"), "La").alias("sigla"))


@query("f08_termino_condicionado", f"""
WITH w AS (SELECT fila, titulo, string_split({bare("regexp_replace(titulo, '[^\\p{L}\\p{N} ]+', '', 'g')")}, ' ') AS w FROM noticias)
SELECT fila, CASE WHEN titulo IS NOT NULL THEN len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'agua' AND coalesce(w[i - 1], '') <> 'sin' AND coalesce(w[i + 1], '') <> 'potable')) > 0 END AS termino FROM w""")
def conditional_terms(t: Tables) -> DataFrame:
    """F8: a term with words it may not follow or precede."""
    plain = F.regexp_replace("titulo", r"[^\p{L}\p{N} ]+", "")
    return t.noticias.select("fila", text.has_term(plain, "agua", before=("sin",), not_after=("potable",)).alias("termino"))


@query("f09_mas_largo", f"SELECT fila, regexp_extract({bare('titulo')}, '(autoridad de riesgos|autoridad|mesa de precios|mesa)') AS organo FROM noticias")
def longest(t: Tables) -> DataFrame:
    """the longest of several terms at the first place where one stands."""
    terms = sorted(["autoridad", "autoridad de riesgos", "mesa", "mesa de precios"], key=len, reverse=True)
    return t.noticias.select("fila", F.regexp_extract(text.bare(F.col("titulo")), "(" + "|".join(terms) + ")", 1).alias("organo"))


_NUM = r"\d+(?:[.,]\d{3})*(?:[.,]\d+)?"


@query("f11_numeral", f"""
WITH n AS (SELECT fila, unnest(regexp_extract_all(titulo, '{_NUM}')) AS n FROM noticias)
SELECT fila, n AS texto, CASE WHEN regexp_matches(n, '^\\d{{1,3}}([.,]\\d{{3}})+$') THEN TRY_CAST(regexp_replace(n, '[.,]', '', 'g') AS DOUBLE)
  WHEN regexp_matches(n, '^\\d{{1,3}}(\\.\\d{{3}})+,\\d+$') THEN TRY_CAST(replace(replace(n, '.', ''), ',', '.') AS DOUBLE)
  WHEN regexp_matches(n, '^\\d{{1,3}}(,\\d{{3}})+\\.\\d+$') THEN TRY_CAST(replace(n, ',', '') AS DOUBLE) ELSE TRY_CAST(replace(n, ',', '.') AS DOUBLE) END AS valor FROM n""")
def numerals(t: Tables) -> DataFrame:
    """every figure of the headlines and its value."""
    found = t.noticias.select("fila", F.explode(F.regexp_extract_all("titulo", F.lit(_NUM), F.lit(0))).alias("texto"))
    return found.withColumn("valor", text.numeral(F.col("texto")))


def sql_figures(c: str) -> str:
    """SQL for the array of (value, unit) of ``text.figures``: runs of digits and separators, read whole or not at all."""
    runs = rf"regexp_extract_all({bare(c)}, '[:./-]?[0-9][0-9.,:/-]*(?:\s+\p{{L}}+)?')"
    run = r"regexp_extract(m, '^([:./-]?[0-9][0-9.,:/-]*)', 1)"
    kept = rf"regexp_replace({run}, '[.,]+$', '')"
    value = rf"""CASE WHEN regexp_full_match({kept}, '[0-9]{{1,3}}([.,][0-9]{{3}})+') THEN TRY_CAST(regexp_replace({kept}, '[.,]', '', 'g') AS DOUBLE)
      WHEN regexp_full_match({kept}, '[0-9]{{1,3}}(\.[0-9]{{3}})+,[0-9]+') THEN TRY_CAST(replace(replace({kept}, '.', ''), ',', '.') AS DOUBLE)
      WHEN regexp_full_match({kept}, '[0-9]{{1,3}}(,[0-9]{{3}})+\.[0-9]+') THEN TRY_CAST(replace({kept}, ',', '') AS DOUBLE) WHEN regexp_full_match({kept}, '[0-9]+([.,][0-9]+)*') THEN TRY_CAST(replace({kept}, ',', '.') AS DOUBLE) END"""
    unit = rf"CASE WHEN {kept} = {run} THEN regexp_extract(m, '\s(\p{{L}}+)$', 1)[1:5] ELSE '' END"
    pairs = f"list_transform({runs}, lambda m: {{'value': {value}, 'unit': {unit}}})"
    return f"list_filter({pairs}, lambda s: s.value IS NOT NULL AND NOT (s.value >= 1900 AND s.value <= 2100 AND s.value = floor(s.value)))"


@query("f10_cifras_con_unidad", f"SELECT fila, n FROM (SELECT fila, len(list_filter({sql_figures('titulo')}, lambda s: s.unit <> '')) AS n FROM noticias) WHERE n > 0")
def figures_with_unit(t: Tables) -> DataFrame:
    """number of figures with a unit per headline; years are left out."""
    f = F.filter(text.figures(F.col("titulo")), lambda s: s["unit"] != "")
    return t.noticias.select("fila", F.size(f).cast("long").alias("n")).where("n > 0")


@query("f13_tokens", f"""
SELECT fila, len(list_filter(string_split({spaced('titulo')}, ' '), lambda w: length(w) >= 2 AND w NOT IN ('de', 'la', 'el', 'en', 'y', 'a'))) AS n,
  array_to_string(list_filter(string_split({spaced('titulo')}, ' '), lambda w: length(w) >= 2 AND w NOT IN ('de', 'la', 'el', 'en', 'y', 'a')), ' ') AS palabras FROM noticias WHERE titulo IS NOT NULL""")
def tokens(t: Tables) -> DataFrame:
    """words of the headlines without stop words."""
    w = text.words(F.col("titulo"), stop=("de", "la", "el", "en", "y", "a"))
    return t.noticias.where("titulo is not null").select("fila", F.size(w).cast("long").alias("n"), F.array_join(w, " ").alias("palabras"))


@query("f14_formato", "SELECT forma, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(fecha_publicacion, '[0-9]+', '9', 'g'), '\\p{L}+', 'a', 'g') AS forma FROM noticias) GROUP BY forma")
def formats(t: Tables) -> DataFrame:
    """formats of the publication dates with their counts."""
    return t.noticias.select(text.shape(F.col("fecha_publicacion")).alias("forma")).groupBy("forma").agg(F.count(F.lit(1)).alias("n"))


@query("f17_recorte", "SELECT fila, CASE WHEN length(titulo) > 60 THEN rtrim(titulo[1:59], ' ') || '…' ELSE titulo END AS corto FROM noticias")
def shortened(t: Tables) -> DataFrame:
    """headlines of at most 60 characters."""
    return t.noticias.select("fila", text.shorten(F.col("titulo"), 60).alias("corto"))


@query("f18_sin_delimitadores", "SELECT fila, regexp_replace('<dato>' || titulo || '</ Dato x>', '</?\\s*dato\\b[^>]*>', '', 'gi') AS texto FROM noticias")
def undelimited(t: Tables) -> DataFrame:
    """quoted passages without the delimiters that they mustn't hold."""
    return t.noticias.select("fila", text.without_delimiters(F.concat(F.lit("<dato>"), "titulo", F.lit("</ Dato x>")), "dato").alias("texto"))


@query("f19_literal", """
SELECT a.doc_id, contains(trim(regexp_replace(a.text, '\\s+', ' ', 'g')), trim(regexp_replace(substr(a.text, 20, 40), '\\s+', ' ', 'g'))) AND trim(substr(a.text, 20, 40)) <> '' AS propio,
  contains(trim(regexp_replace(a.text, '\\s+', ' ', 'g')), 'según los datos') AS ajeno FROM documents a""")
def literal(t: Tables) -> DataFrame:
    """passages that stand literally in the text."""
    return t.documents.select("doc_id", text.holds(F.col("text"), F.substring("text", 20, 40)).alias("propio"), text.holds(F.col("text"), F.lit("según los datos")).alias("ajeno"))


@query("f20_consulta_or", "SELECT origen, '(' || string_agg(CASE WHEN nombre_legible LIKE '% %' THEN '\"' || nombre_legible || '\"' ELSE nombre_legible END, ' OR ' ORDER BY nombre_legible) || ')' AS consulta FROM fuentes GROUP BY origen")
def or_query(t: Tables) -> DataFrame:
    """a search expression of the outlets of each origin."""
    term = F.when(F.col("nombre_legible").contains(" "), F.concat(F.lit('"'), "nombre_legible", F.lit('"'))).otherwise(F.col("nombre_legible"))
    terms = F.transform(F.array_sort(F.collect_list(F.struct("nombre_legible", term.alias("t")))), lambda s: s["t"])
    return t.fuentes.groupBy("origen").agg(F.concat(F.lit("("), F.array_join(terms, " OR "), F.lit(")")).alias("consulta"))


@query("f21_markdown", "SELECT fila, regexp_replace(regexp_replace(titulo, '([\\\\`*_{}\\[\\]()#+!|<>~-])', '\\\\\\1', 'g'), '[\\r\\n]+', ' ', 'g') AS escapado FROM noticias")
def markdown(t: Tables) -> DataFrame:
    """headlines with Markdown's characters escaped."""
    return t.noticias.select("fila", text.escape_markdown(F.col("titulo")).alias("escapado"))


@query("f22_cifra_legible", "SELECT o_orderkey, regexp_replace(format('{:,.2f}', o_totalprice), '\\.?0+$', '') AS cifra FROM orders")
def readable(t: Tables) -> DataFrame:
    """prices with thousands in groups and without final zeros."""
    return t.orders.select("o_orderkey", text.number_text(F.col("o_totalprice")).alias("cifra"))


_FRONT = r"split_part(regexp_replace(split_part(trim(url), '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '?', 1)"
_QUERY = r"regexp_replace(split_part(trim(url), '#', 1), '^[^?]*\??', '')"
CANONICAL = rf"""'https://' || regexp_replace(regexp_replace(lower(split_part({_FRONT}, '/', 1)), ':(80|443)$', ''), '^(www\.|m\.)', '')
  || regexp_replace(regexp_replace(regexp_replace({_FRONT}, '^[^/]*', ''), '/+$', ''), '(/amp)?/*$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{urls.TRACKING}'))), '&'), ''), '')"""


@query("f23_url_canonica", f"SELECT fila, {CANONICAL} AS canonica FROM noticias")
def canonical(t: Tables) -> DataFrame:
    """canonical address of every news row."""
    return t.noticias.select("fila", urls.canonical_url(F.col("url")).alias("canonica"))


_HOST = r"nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '^(www\.|m\.)', ''), '')"


@query("f24_host", f"SELECT {_HOST} AS host, nullif(regexp_extract(trim(url), '^[^:]+://[^/?#]+/([^/?#]+)', 1), '') AS seccion, count(*) AS n FROM noticias GROUP BY ALL")
def hosts(t: Tables) -> DataFrame:
    """news rows per host and first part of the path."""
    return t.noticias.groupBy(urls.host(F.col("url")).alias("host"), urls.section(F.col("url")).alias("seccion")).agg(F.count(F.lit(1)).alias("n"))


@query("f26_identificador", f"SELECT fila, 'NOT-' || substr(sha1({CANONICAL}), 1, 10) AS id, sha256(url) AS huella FROM noticias")
def identifiers(t: Tables) -> DataFrame:
    """identifiers from canonical addresses, and digests."""
    return t.noticias.select("fila", urls.short_id("NOT-", urls.canonical_url(F.col("url"))).alias("id"), F.sha2("url", 256).alias("huella"))


@query("f27_pliegues", "SELECT CAST(('0x' || substr(sha1(id_noticia), 1, 8))::BIGINT % 5 AS INTEGER) AS pliegue, count(*) AS n FROM noticias GROUP BY 1")
def folds(t: Tables) -> DataFrame:
    """rows per stable fold."""
    return t.noticias.groupBy(urls.fold(F.col("id_noticia"), 5).alias("pliegue")).agg(F.count(F.lit(1)).alias("n"))


_ISO = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$'"


def iso(c: str):
    """Strict UTC text as a timestamp, else null."""
    return F.when(F.col(c).rlike(_ISO.strip("'")), F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def sql_iso(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {_ISO}) THEN TRY_CAST({c} AS TIMESTAMPTZ) END"


@query("f28_fecha_preferida", f"SELECT fila, coalesce(fecha_publicacion, fecha_deteccion) AS fecha, CASE WHEN fecha_publicacion IS NOT NULL THEN 'fecha_publicacion' WHEN fecha_deteccion IS NOT NULL THEN 'fecha_deteccion' END AS campo FROM noticias")
def preferred_date(t: Tables) -> DataFrame:
    """the date by priority of fields, and the field it is from."""
    fields = ["fecha_publicacion", "fecha_deteccion"]
    return t.noticias.select("fila", F.coalesce(*fields).alias("fecha"), F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields]).alias("campo"))


@query("f29_recirculada", f"SELECT fila, floor((epoch({sql_iso('fecha_deteccion')}) - epoch({sql_iso('fecha_publicacion')})) / 86400.0) > 30 AS recirculada FROM noticias")
def recirculated(t: Tables) -> DataFrame:
    """Detected more than 30 whole days after publication; null where a date is missing."""
    days = F.floor((F.unix_timestamp(iso("fecha_deteccion")) - F.unix_timestamp(iso("fecha_publicacion"))) / 86400)
    return t.noticias.select("fila", (days > 30).alias("recirculada"))


@query("f30_edad_horas", f"SELECT fila, round((epoch({sql_iso('fecha_extraccion')}) - epoch({sql_iso('fecha_publicacion')})) / 3600.0, 6) AS horas FROM noticias")
def ages(t: Tables) -> DataFrame:
    """age in hours at extraction."""
    return t.noticias.select("fila", F.round((F.unix_timestamp(iso("fecha_extraccion")) - F.unix_timestamp(iso("fecha_publicacion"))) / 3600.0, 6).alias("horas"))


@query("f31_hora_local", "SELECT id_sismo, strftime(hora_utc AT TIME ZONE 'America/Panama', '%Y-%m-%d %H:%M') AS local, updated FROM sismos")
def local_time(t: Tables) -> DataFrame:
    """local time for display only."""
    return t.sismos.select("id_sismo", F.date_format(F.from_utc_timestamp("hora_utc", "America/Panama"), "yyyy-MM-dd HH:mm").alias("local"), "updated")


@query("f32_epoca_a_iso", "SELECT id_sismo, strftime(make_timestamp(((epoch_us(hora_utc) // 1000) * 1000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM sismos")
def epoch_iso(t: Tables) -> DataFrame:
    """F32: milliseconds since the epoch as text."""
    return t.sismos.select("id_sismo", F.date_format(F.timestamp_millis(F.unix_millis("hora_utc")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("f33_fecha_en_nombre", "SELECT archivo, regexp_extract(archivo, '_([0-9]{8}T[0-9]{6}Z)\\.', 1) AS extraida, regexp_extract(archivo, '^gdelt_([a-z_]+?)(__|_[a-z]{3}_)', 1) AS tema_archivo FROM crudos_gdelt")
def name_dates(t: Tables) -> DataFrame:
    """Time and subject in file names."""
    return t.crudos_gdelt.select("archivo", F.regexp_extract("archivo", r"_([0-9]{8}T[0-9]{6}Z)\.", 1).alias("extraida"), F.regexp_extract("archivo", "^gdelt_([a-z_]+?)(__|_[a-z]{3}_)", 1).alias("tema_archivo"))


@query("f34_rejilla", """
SELECT tema, unnest(generate_series((floor(epoch(a) / 259200) * 259200)::BIGINT, epoch(z)::BIGINT, 259200)) AS inicio
FROM (SELECT tema, min(ini) AS a, max(fin) AS z FROM crudos_gdelt WHERE ini IS NOT NULL AND fin IS NOT NULL GROUP BY tema)""")
def grid(t: Tables) -> DataFrame:
    """ranges of three days, aligned to the epoch, over each subject's span."""
    span = t.crudos_gdelt.where("ini is not null and fin is not null").groupBy("tema").agg(F.min("ini").alias("a"), F.max("fin").alias("z"))
    start = (F.floor(F.unix_timestamp("a") / 259200) * 259200).cast("long")
    return span.select("tema", F.explode(F.sequence(start, F.unix_timestamp("z"), F.lit(259200).cast("long"))).alias("inicio"))


@query("f35_fecha_parcial", "SELECT fila, TRY_CAST(nullif(regexp_extract(fecha_publicacion, '^([0-9]{4})', 1), '') AS INTEGER) AS anio, TRY_CAST(nullif(regexp_extract(fecha_publicacion, '^[0-9]{4}-([0-9]{2})', 1), '') AS INTEGER) AS mes, TRY_CAST(nullif(regexp_extract(fecha_publicacion, '^[0-9]{4}-[0-9]{2}-([0-9]{2})', 1), '') AS INTEGER) AS dia FROM noticias")
def partial_date(t: Tables) -> DataFrame:
    """year, month and day as far as a date text gives them."""
    parts = {"anio": "^([0-9]{4})", "mes": "^[0-9]{4}-([0-9]{2})", "dia": "^[0-9]{4}-[0-9]{2}-([0-9]{2})"}
    return t.noticias.select("fila", *[F.regexp_extract("fecha_publicacion", p, 1).try_cast("int").alias(n) for n, p in parts.items()])


@query("f36_horizonte", f"SELECT horizonte, count(*) AS n FROM (SELECT CASE WHEN d <= 7 THEN 'reciente' WHEN d <= 56 THEN 'medio' WHEN d IS NOT NULL THEN 'lejano' END AS horizonte FROM (SELECT (epoch(TIMESTAMPTZ '2026-09-01 00:00:00+00') - epoch({sql_iso('fecha_publicacion')})) / 86400.0 AS d FROM noticias)) GROUP BY 1")
def horizon(t: Tables) -> DataFrame:
    """rows by how far back their date lies."""
    d = (F.lit(1788220800) - F.unix_timestamp(iso("fecha_publicacion"))) / 86400
    bucket = F.when(d <= 7, "reciente").when(d <= 56, "medio").when(d.isNotNull(), "lejano")
    return t.noticias.groupBy(bucket.alias("horizonte")).agg(F.count(F.lit(1)).alias("n"))


@query("f37_wilson", """
WITH g AS (SELECT medio, count(*) AS n, count(*) FILTER (WHERE tema IS NULL) AS k FROM noticias GROUP BY medio),
x AS (SELECT *, k / n::DOUBLE AS p, 1 + 1.96 * 1.96 / n AS d FROM g)
SELECT medio, n, k, CASE WHEN k = 0 THEN 0.0 ELSE round(greatest(((p + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / d, 0.0), 9) END AS bajo,
  CASE WHEN k = n THEN 1.0 ELSE round(least(((p + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / d, 1.0), 9) END AS alto FROM x""")
def wilson(t: Tables) -> DataFrame:
    """Share of rows without subject per outlet, with its interval."""
    g = t.noticias.groupBy("medio").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tema").isNull()).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("medio", "n", "k", F.round(low, 9).alias("bajo"), F.round(high, 9).alias("alto"))


@query("f38_decaimiento", "SELECT event_id, CASE WHEN value <= 10 THEN 1.0 WHEN value >= 60 THEN 0.0 WHEN value IS NOT NULL THEN (60 - value) / 50.0 END AS peso FROM events")
def decay(t: Tables) -> DataFrame:
    """piecewise-linear decay."""
    return t.events.select("event_id", stats.ramp(F.col("value"), 10.0, 60.0).alias("peso"))


@query("f40_truncado", "SELECT o_orderkey, floor(o_totalprice * 1e1) / 1e1 AS cortado FROM orders")
def truncated(t: Tables) -> DataFrame:
    """cut to one decimal."""
    return t.orders.select("o_orderkey", stats.truncate(F.col("o_totalprice"), 1).alias("cortado"))


@query("f45_lista_codificada", "SELECT fila, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(tema, '|'), lambda x: trim(x)), lambda x: x <> ''))), '|') AS temas FROM noticias WHERE tema IS NOT NULL")
def lists(t: Tables) -> DataFrame:
    """delimited lists without repeats, in order."""
    parts = F.filter(F.transform(F.split("tema", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return t.noticias.where("tema is not null").select("fila", F.array_join(F.array_sort(F.array_distinct(parts)), "|").alias("temas"))


_CHUNKS = ", '-', ".join(f"sum(('0x' || h[{12 * i + 1}:{12 * i + 12}])::BIGINT)" for i in range(5))


@query("f46_huella_filas", f"SELECT count(*) AS n, sha256(concat(count(*), '-', {_CHUNKS})) AS huella FROM (SELECT sha256(concat_ws('|', fila, titulo, coalesce(tema, '∅'))) AS h FROM noticias)")
def fingerprint(t: Tables) -> DataFrame:
    """A fingerprint of a table that doesn't depend on the order of its rows: sums of parts of the rows' hashes, no list of them."""
    rows = t.noticias.select(F.sha2(F.concat_ws("|", "fila", "titulo", F.coalesce("tema", F.lit("∅"))), 256).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 12 * i + 1, 12), 16, 10).cast("decimal(28,0)")).cast("string") for i in range(5)]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("-", F.count(F.lit(1)), *sums), 256).alias("huella"))


@query("f49_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_column(t: Tables) -> DataFrame:
    """a field of a JSON column."""
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("f50_mejor_y_segundo", "WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, j) AS k FROM e) SELECT vec_id, max(CASE WHEN k = 1 THEN j END) AS primero, max(CASE WHEN k = 2 THEN j END) AS segundo, round(max(CASE WHEN k = 1 THEN x END)::DOUBLE - max(CASE WHEN k = 2 THEN x END)::DOUBLE, 6) AS margen FROM r GROUP BY vec_id")
def two_best(t: Tables) -> DataFrame:
    """best and second-best place of a vector with the margin; ties go to the earlier place."""
    ranked = F.array_sort(F.transform("embedding", lambda x, j: F.struct((-x).alias("s"), j.alias("j"))))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return t.embeddings.select("vec_id", first["j"].cast("long").alias("primero"), second["j"].cast("long").alias("segundo"), F.round(second["s"].cast("double") - first["s"].cast("double"), 6).alias("margen"))


QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
