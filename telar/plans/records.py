"""Queries over single records: looking them up, validating them, reading them for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telar.functions import dates, text
from telar.operators import records as ops
from telar.operators.prefix import places
from telar.operators.row_recovery import CONTRACTS, load_lines
from telar.plans.problems import _P6, ORACLE as _PROBLEMS
from telar.plans.registry import Registry, Tables
from telar.plans.scalars import spaced

registry = Registry()
query = registry.query


def _lines(t: Tables):
    return load_lines(t.filas_crudas, "id_linea", "contrato", "archivo", "fila", "linea")


@query("s11_registro_por_id", f"""
WITH i AS MATERIALIZED (SELECT id_linea, 'IND-' || pais_iso3 || '-' || indicador_id || '-' || anio AS id, fuente_url AS url, unidad AS etiqueta FROM ({_PROBLEMS["p6_validas_indicadores"]})),
pedidos AS (SELECT id_noticia AS id FROM hoja_preetiquetado UNION SELECT id_sismo FROM sismos UNION SELECT id FROM i UNION SELECT 'NOT-ffffffffff' UNION SELECT 'SIS-nada' UNION SELECT 'XYZ-1'),
k AS (SELECT id_noticia AS id, min((fila, url, titulo)) AS r FROM noticias GROUP BY 1 UNION ALL SELECT id_sismo, min((-epoch_us(updated), url, place)) FROM sismos GROUP BY 1),
f AS (SELECT id, r[2] AS url, r[3] AS etiqueta FROM k UNION ALL SELECT id, min((id_linea, url, etiqueta))[2], min((id_linea, url, etiqueta))[3] FROM i GROUP BY 1)
SELECT p.id, CASE WHEN p.id LIKE 'NOT-%' THEN 'noticias' WHEN p.id LIKE 'SIS-%' THEN 'sismos' WHEN p.id LIKE 'IND-%' THEN 'indicadores' END AS source, url, etiqueta AS label, f.id IS NOT NULL AS found
FROM pedidos p LEFT JOIN f ON f.id = p.id WHERE p.id IS NOT NULL""")
def by_id(t: Tables) -> DataFrame:
    """Any cited identifier, of news, quakes or indicators, with its address and label, in one join."""
    indicators = _lines(t).valid("indicadores").withColumn("id", F.concat_ws("-", F.lit("IND"), "pais_iso3", "indicador_id", "anio"))
    sources = [
        ops.Source("noticias", "NOT-", t.noticias, F.col("id_noticia"), F.col("fila"), F.col("url"), F.col("titulo")),
        ops.Source("sismos", "SIS-", t.sismos, F.col("id_sismo"), F.struct(-F.unix_micros("updated"), "url", "place"), F.col("url"), F.col("place")),
        ops.Source("indicadores", "IND-", indicators, F.col("id"), F.col("id_linea"), F.col("fuente_url"), F.col("unidad")),
    ]
    absent = t.spark.createDataFrame([("NOT-ffffffffff",), ("SIS-nada",), ("XYZ-1",)], "id string")
    asked = t.hoja_preetiquetado.select(F.col("id_noticia").alias("id")).union(t.sismos.select("id_sismo")).union(indicators.select("id")).union(absent)
    return ops.resolve(asked, "id", sources)


_MOMENT = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"


@query("p08_fecha_con_zona", rf"""
WITH f AS (SELECT fila, nullif(trim(fecha_publicacion), '') AS f FROM noticias),
m AS (SELECT *, CASE WHEN regexp_full_match(f, '{_MOMENT}(Z|[+-]\d{{2}}:\d{{2}})') THEN TRY_CAST(f AS TIMESTAMPTZ) WHEN regexp_full_match(f, '\d{{8}}T\d{{6}}Z') THEN try_strptime(f || '+0000', '%Y%m%dT%H%M%SZ%z') END AS m FROM f)
SELECT fila, strftime(m AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS fecha, CASE WHEN f IS NULL OR m IS NOT NULL THEN NULL
  WHEN (regexp_full_match(f, '{_MOMENT}') OR regexp_full_match(f, '\d{{4}}-\d{{2}}-\d{{2}}')) AND TRY_CAST(f AS TIMESTAMP) IS NOT NULL THEN 'fecha_sin_zona_horaria' ELSE 'fecha_ilegible' END AS motivo FROM m""")
def zoned_dates(t: Tables) -> DataFrame:
    """Publication dates in UTC; those without a zone or unreadable are refused with the reason."""
    moment, reason = dates.zoned(F.col("fecha_publicacion"))
    return t.noticias.select("fila", dates.utc_text(moment).alias("fecha"), reason.alias("motivo"))


@query("p09_numero_con_motivo", _P6 + r"""
SELECT id_linea, f[5] AS texto, CASE WHEN regexp_full_match(f[5], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(f[5] AS DOUBLE) END AS valor,
  CASE WHEN f[5] IS NOT NULL AND NOT regexp_full_match(f[5], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'no_numerico' END AS motivo FROM n WHERE NOT es""")
def numbers(t: Tables) -> DataFrame:
    """Numbers of the indicator lines; what is no number is null, with the reason logged."""
    rows = _lines(t).rows.where((F.col("contract") == "indicadores") & (F.size("fields") == len(CONTRACTS["indicadores"].columns)))
    value, reason = dates.number(F.get("fields", F.lit(4)))
    return rows.select(F.col("id").alias("id_linea"), F.get("fields", F.lit(4)).alias("texto"), value.alias("valor"), reason.alias("motivo"))


@query("p03_registros_anidados", """
WITH e AS (SELECT id_sismo, strftime(updated AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS version, concat_ws(', ', CASE WHEN magnitud IS NULL THEN 'magnitud_vacia' END,
  CASE WHEN magnitud NOT BETWEEN 0 AND 3 THEN 'magnitud_fuera' END, CASE WHEN latitude NOT BETWEEN 7 AND 9.5 THEN 'latitud_fuera' END, CASE WHEN estado NOT IN ('automatic', 'reviewed') THEN 'estado_desconocido' END) AS errores FROM sismos)
SELECT version, errores, count(DISTINCT id_sismo) AS sismos FROM e WHERE errores <> '' GROUP BY ALL UNION ALL SELECT 'rota', 'json_invalido', count(DISTINCT id_sismo) FROM sismos""")
def nested(t: Tables) -> DataFrame:
    """Nested records read from their text and held against rules; empty optional fields are null and break none."""
    record = F.to_json(F.struct(
        F.col("id_sismo").alias("id"), F.struct(F.col("magnitud").alias("mag"), F.col("estado").alias("status")).alias("properties"),
        F.struct(F.array("longitude", "latitude", "profundidad_km").alias("coordinates")).alias("geometry"),
    ))
    rows = t.sismos.select("id_sismo", dates.utc_text(F.col("updated")).alias("version"), record.alias("texto"))
    broken = rows.select("id_sismo", F.lit("rota").alias("version"), F.concat(F.lit("{"), "texto").alias("texto"))
    found = ops.validate_json(rows.union(broken), "texto", "id string, properties struct<mag:double,status:string>, geometry struct<coordinates:array<double>>", {
        "magnitud_vacia": lambda r: r["properties"]["mag"].isNotNull(), "magnitud_fuera": lambda r: r["properties"]["mag"].between(0, 3),
        "latitud_fuera": lambda r: F.get(r["geometry"]["coordinates"], F.lit(1)).between(7, 9.5), "estado_desconocido": lambda r: r["properties"]["status"].isin("automatic", "reviewed"),
    })
    return found.where(F.size("errors") > 0).groupBy("version", F.array_join("errors", ", ").alias("errores")).agg(F.countDistinct("id_sismo").alias("sismos"))


@query("p04_errores_de_archivo", _P6 + """
SELECT archivo, contrato, count(*) AS lineas, count(DISTINCT CASE WHEN rota THEN fila END) AS rotas, coalesce(bool_and(coalesce(len(f) = ancho - 1, false)), false) AS falta_columna FROM a GROUP BY ALL""")
def file_errors(t: Tables) -> DataFrame:
    """Broken rows per file, each position once, and whether the whole file lacks a column, which is one error of the file."""
    rows = _lines(t).rows
    width = F.create_map(*[x for n, c in CONTRACTS.items() for x in (F.lit(n), F.lit(len(c.columns)))])
    broken = F.exists("errors", lambda e: e["tipo_error"] == "estructura_invalida")
    short = F.coalesce(F.size("fields") == F.element_at(width, F.col("contract")) - 1, F.lit(False))
    return rows.groupBy(F.col("file").alias("archivo"), F.col("contract").alias("contrato")).agg(
        F.count(F.lit(1)).alias("lineas"), F.countDistinct(F.when(broken, F.col("position"))).alias("rotas"), F.bool_and(short).alias("falta_columna"))


@query("p24_veredicto_por_fila", f"""
WITH e AS (SELECT id_linea, string_agg(DISTINCT tipo_error, ', ' ORDER BY tipo_error) AS errores FROM ({_PROBLEMS["p6_found"]}) GROUP BY 1), r AS ({_P6} SELECT id_linea, archivo, fila, ancho, len(f) AS hallado FROM a)
SELECT r.archivo, r.fila, r.id_linea, CASE WHEN errores IS NULL THEN 'valida' ELSE 'rechazada' END AS veredicto, errores, ancho AS esperado, hallado FROM r LEFT JOIN e ON e.id_linea = r.id_linea""")
def verdicts(t: Tables) -> DataFrame:
    """A verdict for each row of an uploaded file, at its position, with what was expected and found."""
    width = F.create_map(*[x for n, c in CONTRACTS.items() for x in (F.lit(n), F.lit(len(c.columns)))])
    found = F.when(F.col("fields").isNotNull(), F.size("fields").cast("long"))
    kinds = F.nullif(F.array_join(F.array_sort(F.transform("errors", lambda e: e["tipo_error"])), ", "), F.lit(""))
    return _lines(t).rows.select(
        F.col("file").alias("archivo"), F.col("position").alias("fila"), F.col("id").alias("id_linea"), F.when(kinds.isNull(), "valida").otherwise("rechazada").alias("veredicto"),
        kinds.alias("errores"), F.element_at(width, F.col("contract")).alias("esperado"), found.alias("hallado"))


@query("p21_etiquetas_de_persona", """
SELECT id_noticia, lower(trim(etiquetado_por)) AS anotador, CASE WHEN ruido_humano <> 'ninguno' THEN 'sin_tema' ELSE nullif(lower(trim(tema_humano)), '') END AS clase, count(*) AS n
FROM hoja_preetiquetado WHERE origen IN ('asistente_provisional') GROUP BY ALL""")
def human_rows(t: Tables) -> DataFrame:
    """P21, Z107: labels of the given origins; noise is the class of abstention, a blank label is none."""
    rows = t.hoja_preetiquetado.where(F.col("origen").isin("asistente_provisional"))
    label = F.when(F.col("ruido_humano") != "ninguno", "sin_tema").otherwise(F.nullif(F.lower(F.trim("tema_humano")), F.lit("")))
    return rows.groupBy("id_noticia", F.lower(F.trim("etiquetado_por")).alias("anotador"), label.alias("clase")).agg(F.count(F.lit(1)).alias("n"))


@query("z114_propiedades", """
SELECT fila, 'titulo' AS propiedad, 'texto' AS tipo, trim(titulo, ' ') AS valor FROM noticias WHERE trim(titulo, ' ') <> '' UNION ALL SELECT fila, 'url', 'enlace', trim(url, ' ') FROM noticias WHERE trim(url, ' ') <> ''
UNION ALL SELECT fila, 'tema', 'opciones', trim(tema, ' ') FROM noticias WHERE trim(tema, ' ') <> '' UNION ALL SELECT fila, 'fecha_publicacion', 'fecha', trim(fecha_publicacion, ' ') FROM noticias WHERE trim(fecha_publicacion, ' ') <> ''""")
def properties(t: Tables) -> DataFrame:
    """Z114: fields as typed properties; a blank one is no value."""
    kinds = {"titulo": "texto", "url": "enlace", "tema": "opciones", "fecha_publicacion": "fecha"}
    cells = F.array(*[F.struct(F.lit(c).alias("propiedad"), F.lit(k).alias("tipo"), F.nullif(F.trim(c), F.lit("")).alias("valor")) for c, k in kinds.items()])
    return t.noticias.select("fila", F.explode(cells).alias("p")).where("p.valor is not null").select("fila", "p.*")


@query("j24_arreglos_alineados", f"""
WITH w AS (SELECT fila, string_split({spaced('titulo')}, ' ') AS w FROM noticias WHERE titulo IS NOT NULL)
SELECT fila, unnest(range(1, len(w) + 1)) AS lugar, unnest(w) AS palabra, unnest(list_transform(w, lambda x: length(x))) AS letras FROM w""")
def aligned(t: Tables) -> DataFrame:
    """Arrays of one row put together by place; the place is kept as a key."""
    w = F.split(text.spaced_key(F.col("titulo")), " ")
    rows = t.noticias.where("titulo is not null").select("fila", w.alias("w")).withColumn("n", F.transform("w", lambda x: F.length(x).cast("long")))
    each = rows.select("fila", F.posexplode(F.arrays_zip("w", "n")).alias("p", "e"))
    return each.select("fila", (F.col("p") + 1).cast("long").alias("lugar"), F.col("e.w").alias("palabra"), F.col("e.n").alias("letras"))


@query("z060_lista_y_prefijo", "SELECT fila, id_noticia, medio FROM noticias WHERE origen IN ('RSS', 'RSS · GDELT') OR id_noticia LIKE 'NOT-00%'")
def list_or_prefix(t: Tables) -> DataFrame:
    """Rows of a list of values together with those of a prefix."""
    return t.noticias.where(F.col("origen").isin("RSS", "RSS · GDELT") | F.startswith("id_noticia", F.lit("NOT-00"))).select("fila", "id_noticia", "medio")


@query("z055_candidatas", """
SELECT id_grupo, count(DISTINCT h.id_noticia) AS titulares, count(*) AS etiquetas, bool_or(EXISTS (SELECT 1 FROM noticias n WHERE n.id_noticia = h.id_noticia AND n.zona IS NOT NULL)) AS con_sismo
FROM hoja_preetiquetado h WHERE id_grupo IS NOT NULL GROUP BY 1""")
def candidates(t: Tables) -> DataFrame:
    """Groups with their size and whether an official record exists for one of their members."""
    quake = t.noticias.where("zona is not null").select("id_noticia").distinct().withColumn("q", F.lit(True))
    rows = t.hoja_preetiquetado.where("id_grupo is not null").join(quake, "id_noticia", "left")
    return rows.groupBy("id_grupo").agg(F.countDistinct("id_noticia").alias("titulares"), F.count(F.lit(1)).alias("etiquetas"), F.bool_or(F.coalesce("q", F.lit(False))).alias("con_sismo"))


@query("z057_detalle_de_grupo", """
WITH m AS (SELECT id_grupo, id_noticia, min(titulo) AS titulo, min(fecha_etiquetado) AS desde FROM hoja_preetiquetado WHERE id_grupo IS NOT NULL GROUP BY 1, 2), g AS (SELECT id_grupo, count(*) AS n FROM m GROUP BY 1)
SELECT id_grupo, n, id_noticia, titulo, desde, row_number() OVER (PARTITION BY id_grupo ORDER BY desde NULLS LAST, id_noticia) AS orden FROM m JOIN g USING (id_grupo)""")
def group_detail(t: Tables) -> DataFrame:
    """Each group's members in order of date, null last, then id."""
    members = t.hoja_preetiquetado.where("id_grupo is not null").groupBy("id_grupo", "id_noticia").agg(F.min("titulo").alias("titulo"), F.min("fecha_etiquetado").alias("desde"))
    sizes = members.groupBy("id_grupo").agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("id_grupo").orderBy(F.col("desde").asc_nulls_last(), "id_noticia")).cast("long")
    return members.join(sizes, "id_grupo").select("id_grupo", "n", "id_noticia", "titulo", "desde", order.alias("orden"))


@query("z058_enlaces", """
WITH n AS (SELECT id_noticia, min(medio) AS medio, bool_or(zona IS NOT NULL) AS enlace FROM noticias GROUP BY 1), h AS (SELECT DISTINCT id_grupo, id_noticia FROM hoja_preetiquetado WHERE id_grupo IS NOT NULL),
j AS (SELECT h.id_grupo, coalesce(enlace, false) AS enlace, coalesce(condiciones, '') <> 'Pendiente de verificar' AS visible FROM h LEFT JOIN n USING (id_noticia) LEFT JOIN fuentes ON nombre_legible = medio)
SELECT id_grupo, count_if(enlace AND visible) AS visibles, count_if(enlace AND NOT visible) AS ocultos, NOT bool_or(enlace) AS sin_enlace FROM j GROUP BY 1""")
def links(t: Tables) -> DataFrame:
    """Links of each group that its outlets let be seen, those they hide, and groups that have none."""
    news = t.noticias.groupBy("id_noticia").agg(F.min("medio").alias("medio"), F.bool_or(F.col("zona").isNotNull()).alias("enlace"))
    sheet = t.hoja_preetiquetado.where("id_grupo is not null").select("id_grupo", "id_noticia").distinct()
    rows = sheet.join(news, "id_noticia", "left").join(t.fuentes, F.col("nombre_legible") == F.col("medio"), "left")
    link, seen = F.coalesce("enlace", F.lit(False)), F.coalesce("condiciones", F.lit("")) != "Pendiente de verificar"
    return rows.groupBy("id_grupo").agg(F.count_if(link & seen).alias("visibles"), F.count_if(link & ~seen).alias("ocultos"), (~F.bool_or(link)).alias("sin_enlace"))


@query("z063_orden_guardado", """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS guardado, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS calculado FROM orders)
SELECT o_orderkey, guardado, calculado FROM o WHERE guardado <> calculado""")
def stored_order(t: Tables) -> DataFrame:
    """Rows whose stored place isn't the one computed again; places come from ranges, not from one window."""
    rows = places(t.orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderkey")], "guardado")
    return places(rows, [F.col("o_orderdate"), F.col("o_orderkey")], "calculado").where("guardado <> calculado").select("o_orderkey", "guardado", "calculado")


@query("z064_ediciones", """
WITH e AS (SELECT id_noticia, min(tema_humano) AS nuevo FROM hoja_preetiquetado WHERE nota = 'revisar' AND tema_humano IS NOT NULL GROUP BY 1),
c AS (SELECT fila, id_noticia, 'titulo' AS campo, titulo AS valor FROM noticias UNION ALL SELECT fila, id_noticia, 'tema', tema FROM noticias)
SELECT fila, c.id_noticia, campo, CASE WHEN campo = 'tema' AND e.id_noticia IS NOT NULL THEN nuevo ELSE valor END AS valor, campo = 'tema' AND e.id_noticia IS NOT NULL AS editado FROM c LEFT JOIN e ON e.id_noticia = c.id_noticia""")
def edited(t: Tables) -> DataFrame:
    """Records as editable elements, with the reviewers' edits put in."""
    edits = t.hoja_preetiquetado.where("nota = 'revisar' and tema_humano is not null").groupBy("id_noticia").agg(F.min("tema_humano").alias("nuevo"))
    rows = ops.elements(t.noticias, ["fila", "id_noticia"], ["titulo", "tema"])
    return ops.apply_edits(rows, edits.withColumn("campo", F.lit("tema")), ["id_noticia"]).select("fila", "id_noticia", "campo", "valor", "editado")


@query("z050_medios_de_referencia", """
WITH n AS (SELECT DISTINCT id_noticia, medio FROM noticias WHERE medio IN (SELECT nombre_legible FROM fuentes WHERE condiciones = 'Uso con cita')), h AS (SELECT DISTINCT id_grupo, id_noticia FROM hoja_preetiquetado WHERE id_grupo IS NOT NULL)
SELECT id_grupo, count(n.id_noticia) > 0 AS cubierto, count(DISTINCT n.id_noticia) AS titulares, min(n.id_noticia) AS primero FROM h LEFT JOIN n ON n.id_noticia = h.id_noticia GROUP BY 1""")
def reference_outlets(t: Tables) -> DataFrame:
    """Whether outlets of reference cover a group, and by which headlines."""
    outlets = t.fuentes.where("condiciones = 'Uso con cita'").select(F.col("nombre_legible").alias("medio")).distinct()
    news = t.noticias.join(outlets, "medio", "left_semi").select("id_noticia").distinct().withColumn("cita", F.col("id_noticia"))
    sheet = t.hoja_preetiquetado.where("id_grupo is not null").select("id_grupo", "id_noticia").distinct().join(news, "id_noticia", "left")
    return sheet.groupBy("id_grupo").agg((F.count("cita") > 0).alias("cubierto"), F.countDistinct("cita").alias("titulares"), F.min("cita").alias("primero"))


_ASKS = {"eventos_naturales": ["sismologia", "bomberos"], "economia": ["estadistica"]}


@query("z048_fuentes_sugeridas", """
WITH r AS (SELECT DISTINCT id_noticia, propuesta_tema AS t FROM hoja_preetiquetado WHERE propuesta_tema IS NOT NULL)
SELECT id_noticia, t AS tema, CASE t WHEN 'eventos_naturales' THEN 'sismologia, bomberos, prensa' WHEN 'economia' THEN 'estadistica, prensa' WHEN 'prensa' THEN 'prensa' ELSE t || ', prensa' END AS fuentes FROM r""")
def suggested(t: Tables) -> DataFrame:
    """Sources to ask: those of the rule for the topic, else the topic itself, and the extra ones, each once."""
    rule = F.create_map(*[x for k, v in _ASKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = t.hoja_preetiquetado.where("propuesta_tema is not null").select("id_noticia", F.col("propuesta_tema").alias("tema")).distinct()
    found = F.array_distinct(F.concat(F.coalesce(F.element_at(rule, F.col("tema")), F.array("tema")), F.array(F.lit("prensa"))))
    return rows.select("id_noticia", "tema", F.array_join(found, ", ").alias("fuentes"))


@query("z036_filas_de_grupo", """
WITH m AS (SELECT DISTINCT id_grupo, id_noticia FROM hoja_preetiquetado WHERE id_grupo IS NOT NULL)
SELECT 'grupos' AS tabla, id_grupo AS clave, CAST(count(*) AS VARCHAR) AS valor FROM m GROUP BY 2 UNION ALL SELECT 'miembros', id_noticia, id_grupo FROM m
UNION ALL SELECT 'sueltas', id_noticia, NULL FROM (SELECT id_noticia FROM hoja_preetiquetado EXCEPT SELECT id_noticia FROM m)""")
def group_rows(t: Tables) -> DataFrame:
    """The rows of a clustering for three tables: groups, members, and records in no group."""
    members = t.hoja_preetiquetado.where("id_grupo is not null").select("id_grupo", "id_noticia").distinct()
    groups = members.groupBy("id_grupo").agg(F.count(F.lit(1)).cast("string").alias("valor"))
    alone = t.hoja_preetiquetado.select("id_noticia").distinct().join(members.select("id_noticia").distinct(), "id_noticia", "left_anti")
    return (
        groups.select(F.lit("grupos").alias("tabla"), F.col("id_grupo").alias("clave"), "valor")
        .union(members.select(F.lit("miembros"), "id_noticia", "id_grupo")).union(alone.select(F.lit("sueltas"), "id_noticia", F.lit(None).cast("string")))
    )


@query("z054_registro_plano", "SELECT id_sismo, place AS lugar_nombre, zona AS lugar_zona, magnitud AS medida_magnitud, profundidad_km AS medida_profundidad FROM sismos")
def flat(t: Tables) -> DataFrame:
    """A nested record as flat columns, by a walk over its schema."""
    lugar, medida = F.struct(F.col("place").alias("nombre"), F.col("zona").alias("zona")), F.struct(F.col("magnitud").alias("magnitud"), F.col("profundidad_km").alias("profundidad"))
    return ops.flatten(t.sismos.select("id_sismo", lugar.alias("lugar"), medida.alias("medida")))


@query("f48_claves", "SELECT 'props.' || k AS clave, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def keys(t: Tables) -> DataFrame:
    """keys of nested texts with their counts."""
    return t.events.select(F.explode(F.json_object_keys("props")).alias("k")).groupBy(F.concat(F.lit("props."), "k").alias("clave")).agg(F.count(F.lit(1)).alias("n"))


@query("z110_por_elemento", "SELECT event_type, 'ok' AS motivo, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT event_type, 'elemento_roto', count(*) FROM events GROUP BY 1")
def per_item(t: Tables) -> DataFrame:
    """Z110: items of an array read one by one: a malformed one is dropped with its reason, the others survive."""
    items = t.events.select("event_type", F.explode(F.array("props", F.concat(F.lit("{"), "props"))).alias("texto"))
    found = ops.validate_json(items, "texto", "k bigint", {"elemento_vacio": lambda r: r["k"].isNotNull()})
    reason = F.when(F.size("errors") == 0, "ok").when(F.array_contains("errors", "json_invalido"), "elemento_roto").otherwise("elemento_vacio")
    return found.groupBy("event_type", reason.alias("motivo")).agg(F.count(F.lit(1)).alias("n"))


@query("z111_plan_por_accion", "SELECT event_id, CASE WHEN value IS NULL OR value < 1 THEN 'nada' WHEN event_type = 'purchase' THEN 'verificar' WHEN event_type = 'click' THEN 'ampliar' ELSE 'nada' END AS plan FROM events")
def plans(t: Tables) -> DataFrame:
    """Z111: a plan by action; nothing for rows without records and for unknown actions."""
    actions = F.create_map(*map(F.lit, ("purchase", "verificar", "click", "ampliar")))
    known = F.coalesce(F.element_at(actions, F.col("event_type")), F.lit("nada"))
    return t.events.select("event_id", F.when(F.col("value").isNull() | (F.col("value") < 1), "nada").otherwise(known).alias("plan"))


@query("z112_registro_de_evidencias", """
WITH c AS (SELECT id_noticia, fila, url, unnest(string_split(tema, '|')) AS campo, unnest(range(1, len(string_split(tema, '|')) + 1)) AS lugar FROM noticias WHERE tema IS NOT NULL)
SELECT id_noticia, trim(campo) AS campo, min((fila, lugar, url))[3] AS cita FROM c GROUP BY 1, 2""")
def evidence(t: Tables) -> DataFrame:
    """Z112: of the lines that cite a field of a record the first one wins."""
    each = t.noticias.where("tema is not null").select("id_noticia", "fila", "url", F.posexplode(F.split("tema", r"\|")).alias("lugar", "campo"))
    first = each.groupBy("id_noticia", F.trim("campo").alias("campo")).agg(F.min(F.struct("fila", "lugar", "url")).alias("r"))
    return first.select("id_noticia", "campo", F.col("r.url").alias("cita"))


@query("z115_proporciones", r"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '/50' WHEN 1 THEN p_size || ' de 50' ELSE p_size || ' %' END AS texto FROM part),
k AS (SELECT *, regexp_extract(texto, '^(\d+)(?:/| de )(\d+)$', 1) AS a, regexp_extract(texto, '^(\d+)(?:/| de )(\d+)$', 2) AS b FROM p)
SELECT p_partkey, texto, CASE WHEN b <> '' THEN a::BIGINT END AS casos, CASE WHEN b <> '' THEN b::BIGINT END AS n, CASE WHEN b <> '' THEN a::DOUBLE / b::DOUBLE END AS parte, CASE WHEN b = '' THEN 'sin_n' END AS motivo FROM k""")
def proportions(t: Tables) -> DataFrame:
    """Z115: proportions in several notations; a share without its number of cases is refused."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    shown = F.when(kind == 0, F.concat(size, F.lit("/50"))).when(kind == 1, F.concat(size, F.lit(" de 50"))).otherwise(F.concat(size, F.lit(" %")))
    part = lambda i: F.nullif(F.regexp_extract("texto", r"^(\d+)(?:/| de )(\d+)$", i), F.lit("")).cast("long")
    rows = t.part.select("p_partkey", shown.alias("texto")).withColumns({"casos": part(1), "n": part(2)})
    return rows.select("p_partkey", "texto", "casos", "n", (F.col("casos") / F.col("n")).alias("parte"), F.when(F.col("n").isNull(), "sin_n").alias("motivo"))


@query("z091_hoja_de_seleccion", """
WITH k AS (SELECT bloque, id_noticia, lower(trim(etiquetado_por)) AS quien, count(*) AS n FROM hoja_preetiquetado GROUP BY ALL), m AS (SELECT DISTINCT id_noticia FROM noticias)
SELECT bloque, count(*) AS filas, count_if(n > 1) AS repetidas, count(DISTINCT k.id_noticia) AS elegidas, count(DISTINCT k.id_noticia) = 100 AS exacta, count_if(m.id_noticia IS NULL) AS ajenas FROM k LEFT JOIN m ON m.id_noticia = k.id_noticia GROUP BY 1""")
def selection(t: Tables) -> DataFrame:
    """A selection sheet: repeated rows, whether exactly as many as asked are chosen, and which are no members."""
    rows = t.hoja_preetiquetado.groupBy("bloque", "id_noticia", F.lower(F.trim("etiquetado_por")).alias("quien")).agg(F.count(F.lit(1)).alias("n"))
    known = t.noticias.select("id_noticia").distinct().withColumn("m", F.lit(True))
    chosen = F.countDistinct("id_noticia")
    return rows.join(known, "id_noticia", "left").groupBy("bloque").agg(
        F.count(F.lit(1)).alias("filas"), F.count_if(F.col("n") > 1).alias("repetidas"), chosen.alias("elegidas"), (chosen == 100).alias("exacta"), F.count_if(F.col("m").isNull()).alias("ajenas"))


@query("z093_pesos_repartidos", """
SELECT a.source AS cambiada, b.source, round(CASE WHEN a.source = b.source THEN b.peso_objetivo + 0.05 ELSE b.peso_objetivo * (1 - a.peso_objetivo - 0.05) / (1 - a.peso_objetivo) END, 9) AS peso FROM mezcla_objetivo a, mezcla_objetivo b""")
def weights(t: Tables) -> DataFrame:
    """A weight raised by a step and the others scaled so that the total stays; the table of weights is fixed."""
    rows = t.mezcla_objetivo.agg(F.collect_list(F.struct("source", "peso_objetivo")).alias("p")).select("p", F.explode("p").alias("a")).select("a", F.explode("p").alias("b"))
    own, other = F.col("a.peso_objetivo"), F.col("b.peso_objetivo")
    new = F.when(F.col("a.source") == F.col("b.source"), other + 0.05).otherwise(other * (1 - own - 0.05) / (1 - own))
    return rows.select(F.col("a.source").alias("cambiada"), F.col("b.source").alias("source"), F.round(new, 9).alias("peso"))


@query("z040_limites_del_catalogo", """
SELECT zona, strftime(min(hora_utc) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS desde, strftime(max(hora_utc) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS hasta, count(magnitud) AS con_magnitud, count_if(magnitud IS NULL) AS sin_magnitud FROM sismos GROUP BY 1""")
def bounds(t: Tables) -> DataFrame:
    """What a catalogue covers; events without magnitude are counted apart."""
    return t.sismos.groupBy("zona").agg(
        dates.utc_text(F.min("hora_utc")).alias("desde"), dates.utc_text(F.max("hora_utc")).alias("hasta"), F.count("magnitud").alias("con_magnitud"), F.count_if(F.col("magnitud").isNull()).alias("sin_magnitud"))


@query("z042_entradas_coherentes", """
WITH d AS (SELECT id_noticia, count(*) AS declarado FROM noticias GROUP BY 1), r AS (SELECT id_noticia, count(DISTINCT url) AS real FROM noticias GROUP BY 1)
SELECT id_noticia, declarado, real, declarado = real AS coincide FROM d JOIN r USING (id_noticia)""")
def consistent(t: Tables) -> DataFrame:
    """The number of rows a record is declared with against the number there are of it."""
    found = t.noticias.groupBy("id_noticia").agg(F.count(F.lit(1)).alias("declarado"), F.countDistinct("url").alias("real"))
    return found.withColumn("coincide", F.col("declarado") == F.col("real"))


@query("z044_identificable", "SELECT fila, coalesce(medio IN (SELECT nombre_legible FROM fuentes WHERE nombre_legible IS NOT NULL), false) AND fecha_publicacion IS NOT NULL AS identificable FROM noticias")
def identifiable(t: Tables) -> DataFrame:
    """Headlines with a known outlet and a date."""
    outlets = t.fuentes.where("nombre_legible is not null").select(F.col("nombre_legible").alias("medio"), F.lit(True).alias("k")).distinct()
    return t.noticias.join(outlets, "medio", "left").select("fila", (F.coalesce("k", F.lit(False)) & F.col("fecha_publicacion").isNotNull()).alias("identificable"))


@query("z046_estado_de_anotacion", """
WITH p AS (SELECT id_noticia, count(DISTINCT lower(trim(etiquetado_por))) FILTER (WHERE nullif(trim(tema_humano), '') IS NOT NULL) AS n FROM hoja_preetiquetado GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'pendiente' WHEN n < 3 THEN 'parcial' ELSE 'completa' END AS estado, count(*) AS titulares FROM p GROUP BY 1""")
def annotation_state(t: Tables) -> DataFrame:
    """How far the annotation of the headlines has come."""
    who = F.when(F.nullif(F.trim("tema_humano"), F.lit("")).isNotNull(), F.lower(F.trim("etiquetado_por")))
    per = t.hoja_preetiquetado.groupBy("id_noticia").agg(F.countDistinct(who).alias("n"))
    state = F.when(F.col("n") == 0, "pendiente").when(F.col("n") < 3, "parcial").otherwise("completa")
    return per.groupBy(state.alias("estado")).agg(F.count(F.lit(1)).alias("titulares"))


@query("z056_cifra_mostrada", r"""
SELECT doc_id, TRY_CAST(regexp_extract(url, '/([0-9]+)$', 1) AS BIGINT) AS mostrada, coalesce(abs(TRY_CAST(regexp_extract(url, '/([0-9]+)$', 1) AS BIGINT) - doc_id) <= 0, false) AS igual FROM documents""")
def shown(t: Tables) -> DataFrame:
    """A figure read out of what is shown against the one that is stored."""
    found = F.regexp_extract("url", "/([0-9]+)$", 1).try_cast("bigint")
    return t.documents.select("doc_id", found.alias("mostrada"), F.coalesce(F.abs(found - F.col("doc_id")) <= 0, F.lit(False)).alias("igual"))


@query("z053_lineas_por_rol", """
WITH r AS (SELECT id_sismo, unnest([('magnitud', magnitud, 1), ('profundidad', profundidad_km, 2), ('latitud', latitude, 3)]) AS c, max(updated) OVER (PARTITION BY id_sismo) AS u, updated FROM sismos)
SELECT DISTINCT id_sismo, c[1] AS rol, c[2] AS valor, CAST(c[3] AS BIGINT) AS orden FROM r WHERE updated = u AND c[2] IS NOT NULL""")
def role_lines(t: Tables) -> DataFrame:
    """Values of a record's latest version by role, in the order of the roles, one line per value."""
    last = t.sismos.groupBy(F.col("id_sismo").alias("i")).agg(F.max("updated").alias("u"))
    rows = t.sismos.join(last, (F.col("id_sismo") == F.col("i")) & (F.col("updated") == F.col("u")))
    cells = F.array(*[F.struct(F.lit(r).alias("rol"), F.col(c).alias("valor"), F.lit(k).cast("long").alias("orden")) for k, (r, c) in enumerate((("magnitud", "magnitud"), ("profundidad", "profundidad_km"), ("latitud", "latitude")), 1)])
    return rows.select("id_sismo", F.explode(cells).alias("c")).where("c.valor is not null").select("id_sismo", "c.rol", "c.valor", "c.orden").distinct()


QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
