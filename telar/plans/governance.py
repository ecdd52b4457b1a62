"""Queries over checks, dependencies, logs, coverage and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telar.functions import text
from telar.operators import governance as ops
from telar.operators import tables
from telar.plans.registry import Registry, Tables
from telar.plans.scalars import CANONICAL, bare, iso, sql_figures, sql_iso
from telar.functions.urls import canonical_url

registry = Registry()
query = registry.query

_URL = "^https?://[^/?# ]+([/?#].*)?$"


@query("val01_reglas_de_fila", f"""
WITH r AS (SELECT 'id' AS "check", count_if(NOT coalesce(regexp_matches(id_noticia, '^NOT-[0-9a-f]{{10}}$'), false)) AS broken FROM noticias
UNION ALL SELECT 'url', count_if(NOT coalesce(regexp_matches(trim(url), '{_URL}'), false)) FROM noticias UNION ALL SELECT 'titulo', count_if(titulo IS NULL) FROM noticias
UNION ALL SELECT 'fecha', count_if(fecha_publicacion IS NULL AND fecha_deteccion IS NULL) FROM noticias UNION ALL SELECT 'extraida', count_if(({sql_iso('fecha_extraccion')}) IS NULL) FROM noticias)
SELECT "check", broken, (SELECT count(*) FROM noticias) AS n, CASE WHEN broken = 0 THEN 'ok' ELSE 'error' END AS state FROM r""")
def checks(t: Tables) -> DataFrame:
    """Rules over a whole table in one pass."""
    return ops.check_rows(t.noticias, {
        "id": F.col("id_noticia").rlike("^NOT-[0-9a-f]{10}$"), "url": F.trim("url").rlike(_URL), "titulo": F.col("titulo").isNotNull(),
        "fecha": F.col("fecha_publicacion").isNotNull() | F.col("fecha_deteccion").isNotNull(), "extraida": iso("fecha_extraccion").isNotNull(),
    })


@query("val10_ventana_ampliada", f"""
WITH a AS (SELECT fila, {sql_iso('fecha_publicacion')} AS f, TIMESTAMPTZ '2026-07-01 00:00:00+00' AS fin FROM noticias), b AS (SELECT *, (epoch(fin) - epoch(f)) / 86400.0 AS edad FROM a),
u AS (SELECT CASE WHEN count_if(edad >= 0 AND edad <= 3) >= 1000 THEN 3 ELSE 20 END AS used_days FROM b)
SELECT fila, used_days, CASE WHEN f IS NULL THEN 'sin_fecha' WHEN edad < 0 OR edad > used_days THEN 'fuera_de_ventana' END AS excluded FROM b, u""")
def widened(t: Tables) -> DataFrame:
    """A window that widens when it holds too few rows, with the reason of each exclusion."""
    rows = t.noticias.select("fila", iso("fecha_publicacion").alias("f"), F.timestamp_seconds(F.lit(1782864000)).alias("fin"))
    return ops.widened_window(rows, F.col("f"), F.col("fin"), 3, 20, 1000).select("fila", "used_days", "excluded")


@query("val15_patrones_sospechosos", f"SELECT fila, regexp_matches({bare('titulo')}, 'ignora|instrucciones|system prompt') AS inyeccion, regexp_matches({bare('titulo')}, '^(en video|fotos)|\\(fotos\\)\\s*$') AS promocional, {bare('titulo')} = {bare('medio')} AS es_el_medio FROM noticias")
def suspicious(t: Tables) -> DataFrame:
    """Flags that mark rows and drop none."""
    b = text.bare(F.col("titulo"))
    return t.noticias.select("fila", b.rlike("ignora|instrucciones|system prompt").alias("inyeccion"), b.rlike(r"^(en video|fotos)|\(fotos\)\s*$").alias("promocional"), (b == text.bare(F.col("medio"))).alias("es_el_medio"))


@query("v01_citas", "SELECT h.id_noticia, n.id IS NOT NULL AS existe, h.n FROM (SELECT id_noticia, count(*) AS n FROM hoja_preetiquetado GROUP BY 1) h LEFT JOIN (SELECT DISTINCT id_noticia AS id FROM noticias) n ON n.id = h.id_noticia")
def citations(t: Tables) -> DataFrame:
    """Cited records that exist."""
    cited = t.hoja_preetiquetado.groupBy("id_noticia").agg(F.count(F.lit(1)).alias("n"))
    there = t.noticias.select(F.col("id_noticia").alias("id")).distinct()
    return cited.join(there, F.col("id") == F.col("id_noticia"), "left").select("id_noticia", F.col("id").isNotNull().alias("existe"), "n")


_CHAIN = "SELECT fila, lag(fila) OVER (PARTITION BY id_noticia ORDER BY fila) AS base, titulo IS NULL OR fecha_publicacion IS NULL AS falla FROM noticias"


def _chain(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each version of a record rests on the one before it."""
    claims = t.noticias.select("fila", "id_noticia", (F.col("titulo").isNull() | F.col("fecha_publicacion").isNull()).alias("falla"))
    edges = claims.select(F.col("fila").alias("claim"), F.lag("fila").over(Window.partitionBy("id_noticia").orderBy("fila")).alias("base")).where("base is not null")
    return claims, edges


@query("v02_caida_en_cadena", f"""
WITH RECURSIVE c AS MATERIALIZED ({_CHAIN}), g AS (SELECT fila FROM c WHERE falla UNION SELECT c.fila FROM c JOIN g ON c.base = g.fila)
SELECT fila, fila IN (SELECT fila FROM g) AS falls FROM c""")
def chain(t: Tables) -> DataFrame:
    """V2: versions that fall because one that they rest on falls, to the fixpoint."""
    claims, edges = _chain(t)
    return ops.fallen(claims, edges, "fila", "falla")


@query("v03_cierre_transitivo", f"""
WITH RECURSIVE c AS MATERIALIZED ({_CHAIN}), g AS (SELECT fila AS claim, base FROM c WHERE base IS NOT NULL UNION SELECT g.claim, c.base FROM g JOIN c ON g.base = c.fila WHERE c.base IS NOT NULL) SELECT claim, base FROM g""")
def closure(t: Tables) -> DataFrame:
    """V3: all versions that a version rests on."""
    return ops.bases(_chain(t)[1])


@query("v04_cifras_sustentadas", f"""
WITH h AS (SELECT DISTINCT id_grupo, id_noticia, unnest({sql_figures('titulo')}).value AS v FROM hoja_preetiquetado WHERE titulo IS NOT NULL AND id_grupo IS NOT NULL), k AS (SELECT id_grupo, v, count(DISTINCT id_noticia) AS n FROM h GROUP BY 1, 2)
SELECT DISTINCT id_noticia, v FROM h JOIN k USING (id_grupo, v) WHERE n = 1""")
def supported(t: Tables) -> DataFrame:
    """Figures of a headline that no other headline of its group supports."""
    rows = t.hoja_preetiquetado.where("titulo is not null and id_grupo is not null").select("id_grupo", "id_noticia", F.explode(text.figures(F.col("titulo"))).alias("f"))
    each = rows.select("id_grupo", "id_noticia", F.col("f.value").alias("v")).distinct()
    alone = each.groupBy("id_grupo", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id_noticia").alias("id_noticia")).where("n = 1")
    return alone.select("id_noticia", "v").distinct()


@query("v05_fuga_de_ngramas", f"""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace({bare('text')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, len(list_filter(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ') IN ('segun los datos revisados por', 'los datos revisados por la', 'according to figures seen by'))) AS fugas FROM w""")
def leak(t: Tables) -> DataFrame:
    """Five-word passages of a forbidden text in each document."""
    w = F.split(text.spaced_key(F.col("text")), " ")
    rows = t.documents.select("doc_id", w.alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 5), " "))
    bad = F.array(*map(F.lit, ("segun los datos revisados por", "los datos revisados por la", "according to figures seen by")))
    return rows.select("doc_id", F.size(F.filter(grams, lambda g: F.array_contains(bad, g))).cast("long").alias("fugas"))


@query("r14_cifras_en_conflicto", f"""
WITH h AS (SELECT id_grupo, unnest({sql_figures('titulo')}) AS f FROM (SELECT DISTINCT id_grupo, id_noticia, titulo FROM hoja_preetiquetado WHERE id_grupo IS NOT NULL AND titulo IS NOT NULL)),
c AS (SELECT id_grupo, f.unit AS unidad, f.value AS valor, count(*) AS n FROM h WHERE f.unit <> '' GROUP BY ALL)
SELECT a.id_grupo, a.unidad, a.valor, a.n, b.valor AS other, b.n AS n_other FROM c a JOIN c b USING (id_grupo, unidad) WHERE a.valor < b.valor AND abs(a.valor - b.valor) > 1e-9 * greatest(abs(a.valor), abs(b.valor))""")
def conflicts(t: Tables) -> DataFrame:
    """Different figures of one unit within a group of headlines, by value, not by headline."""
    rows = t.hoja_preetiquetado.where("id_grupo is not null and titulo is not null").select("id_grupo", "id_noticia", "titulo").distinct()
    each = rows.select("id_grupo", F.explode(text.figures(F.col("titulo"))).alias("f")).select("id_grupo", F.col("f.unit").alias("unidad"), F.col("f.value").alias("valor"))
    return ops.conflicting_values(each, ["id_grupo"], "unidad", "valor")


@query("z101_contradiccion_cubierta", f"""
WITH t AS (SELECT DISTINCT id_grupo, id_noticia, {sql_figures('titulo')} AS fs FROM hoja_preetiquetado WHERE id_grupo IS NOT NULL AND titulo IS NOT NULL), h AS (SELECT id_grupo, unnest(fs) AS f FROM t), g AS (SELECT id_grupo, f.unit AS unidad, count(DISTINCT f.value) AS valores FROM h WHERE f.unit <> '' GROUP BY ALL),
m AS (SELECT id_grupo, unidad, max(n) AS juntas FROM (SELECT id_grupo, id_noticia, f.unit AS unidad, count(DISTINCT f.value) AS n FROM (SELECT id_grupo, id_noticia, unnest(fs) AS f FROM t) WHERE f.unit <> '' GROUP BY ALL) GROUP BY ALL)
SELECT id_grupo, unidad, valores, juntas >= 2 AS cubierta FROM g JOIN m USING (id_grupo, unidad) WHERE valores > 1""")
def covered(t: Tables) -> DataFrame:
    """Z101, Z49: groups with contradicting figures of one unit, and whether one headline names both sides."""
    rows = t.hoja_preetiquetado.where("id_grupo is not null and titulo is not null").select("id_grupo", "id_noticia", F.explode(text.figures(F.col("titulo"))).alias("f"))
    each = rows.select("id_grupo", "id_noticia", F.col("f.unit").alias("unidad"), F.col("f.value").alias("v")).where("unidad <> ''").distinct()
    sides = each.groupBy("id_grupo", "unidad").agg(F.countDistinct("v").alias("valores")).where("valores > 1")
    most = each.groupBy("id_grupo", "unidad", "id_noticia").agg(F.count(F.lit(1)).alias("n")).groupBy("id_grupo", "unidad").agg(F.max("n").alias("juntas"))
    return sides.join(most, ["id_grupo", "unidad"]).select("id_grupo", "unidad", "valores", (F.col("juntas") >= 2).alias("cubierta"))


@query("l03_versiones_nuevas", f"""
WITH h AS (SELECT fila, id_noticia, sha256(concat_ws('|', coalesce(titulo, '∅'), coalesce(tema, '∅'))) AS h FROM noticias), p AS (SELECT *, lag(h) OVER (PARTITION BY id_noticia ORDER BY fila) AS antes FROM h)
SELECT id_noticia, fila, row_number() OVER (PARTITION BY id_noticia ORDER BY fila) AS version FROM p WHERE antes IS NULL OR antes <> h""")
def new_versions(t: Tables) -> DataFrame:
    """L3: a version is kept only when its content differs from the one before."""
    w = Window.partitionBy("id_noticia").orderBy("fila")
    h = F.sha2(F.concat_ws("|", F.coalesce("titulo", F.lit("∅")), F.coalesce("tema", F.lit("∅"))), 256)
    rows = t.noticias.select("id_noticia", "fila", h.alias("h")).withColumn("antes", F.lag("h").over(w)).where("antes is null or antes <> h")
    return rows.select("id_noticia", "fila", F.row_number().over(w).alias("version"))


@query("l06_transiciones", """
WITH e AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before, before IS NULL OR (before, event_type) IN (('view', 'click'), ('click', 'purchase'), ('view', 'view')) AS allowed FROM e""")
def steps(t: Tables) -> DataFrame:
    """Changes of state that a table of transitions allows."""
    log = t.events.select("user_id", "ts", "event_id", "event_type")
    return ops.transitions(log, ["user_id"], ["ts", "event_id"], "event_type", [("view", "click"), ("click", "purchase"), ("view", "view")]).select("event_id", "before", "allowed")


@query("l08_rechazos_nuevos", "SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice > 300000 EXCEPT ALL SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice > 310000")
def rejections(t: Tables) -> DataFrame:
    """Rejections that a second validation adds, as a multiset."""
    pick = lambda limit: t.orders.where(F.col("o_totalprice") > limit).select("o_orderpriority", "o_orderstatus")
    return ops.new_rejections(pick(310_000), pick(300_000))


@query("z005_motivo_por_dia", """
SELECT tema, CAST(ini AS DATE) AS dia, arg_min(clase, (CASE clase WHEN 'vacio' THEN 0 WHEN 'invalido' THEN 1 WHEN 'truncado' THEN 2 ELSE 3 END, clase)) AS clase FROM crudos_gdelt WHERE ini IS NOT NULL AND clase IS NOT NULL GROUP BY 1, 2""")
def reason_per_day(t: Tables) -> DataFrame:
    """The reason of highest precedence per day."""
    rows = t.crudos_gdelt.where("ini is not null").withColumn("dia", F.to_date("ini"))
    return ops.first_reason(rows, ["tema", "dia"], "clase", ["vacio", "invalido", "truncado"])


@query("z011_cobertura_de_fechas", """
SELECT 'noticias' AS base, min(fecha_extraccion) AS desde, max(fecha_extraccion) AS hasta, count(*) AS n FROM noticias WHERE fecha_extraccion <> ''
UNION ALL SELECT 'sismos', strftime(min(hora_utc) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), strftime(max(hora_utc) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), count(*) FROM sismos WHERE hora_utc IS NOT NULL""")
def coverage(t: Tables) -> DataFrame:
    """First and last date and rows of each base."""
    stamp = F.date_format("hora_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    a = t.noticias.where("fecha_extraccion <> ''").select(F.lit("noticias").alias("base"), F.col("fecha_extraccion").alias("f"))
    b = t.sismos.where("hora_utc is not null").select(F.lit("sismos").alias("base"), stamp.alias("f"))
    return a.union(b).groupBy("base").agg(F.min("f").alias("desde"), F.max("f").alias("hasta"), F.count(F.lit(1)).alias("n"))


@query("z023_sinteticas_sin_repetir", "SELECT medio, count(*) AS n FROM (SELECT medio FROM noticias UNION ALL SELECT 'Demo' UNION ALL SELECT 'Demo') GROUP BY medio")
def synthetic(t: Tables) -> DataFrame:
    """Synthetic rows put in twice are there once."""
    extra = t.spark.createDataFrame([("SYN-A-1", "Demo"), ("SYN-A-2", "Demo")], "id_noticia string, medio string")
    once = ops.inject(t.noticias.select("id_noticia", "medio"), extra, "id_noticia", "SYN-")
    return ops.inject(once, extra, "id_noticia", "SYN-").groupBy("medio").agg(F.count(F.lit(1)).alias("n"))


@query("z034_despivotado", "SELECT s_suppkey, 'saldo' AS campo, s_acctbal AS valor FROM supplier UNION ALL SELECT s_suppkey, 'nacion', s_nationkey::DOUBLE FROM supplier")
def unpivoted(t: Tables) -> DataFrame:
    """Columns turned into rows."""
    rows = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("saldo"), F.col("s_nationkey").cast("double").alias("nacion"))
    return rows.unpivot("s_suppkey", ["saldo", "nacion"], "campo", "valor")


@query("z104_coherencia_de_reglas", """
WITH a AS (SELECT DISTINCT tema AS value FROM temas), b AS (SELECT DISTINCT trim(unnest(string_split(tema, '|'))) AS value FROM noticias WHERE tema IS NOT NULL), c AS (SELECT DISTINCT tema AS value FROM crudos_gdelt WHERE tema IS NOT NULL)
SELECT 'temas' AS only_in, 'noticias' AS not_in, value FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'temas', 'consultas', value FROM (FROM a EXCEPT FROM c) UNION ALL SELECT 'noticias', 'temas', value FROM (FROM b EXCEPT FROM a)
UNION ALL SELECT 'noticias', 'consultas', value FROM (FROM b EXCEPT FROM c) UNION ALL SELECT 'consultas', 'temas', value FROM (FROM c EXCEPT FROM a) UNION ALL SELECT 'consultas', 'noticias', value FROM (FROM c EXCEPT FROM b)""")
def coherence(t: Tables) -> DataFrame:
    """Z104, U4: values that one rule table has and another lacks."""
    news = t.noticias.where("tema is not null").select(F.explode(F.split("tema", r"\|")).alias("v")).select(F.trim("v").alias("tema"))
    return ops.set_differences({"temas": t.temas.select("tema"), "noticias": news, "consultas": t.crudos_gdelt.select("tema")})


@query("z109_tope_de_gasto", """
WITH b AS (SELECT event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS antes FROM events) SELECT event_id, antes < 500 AS allowed FROM b""")
def capped(t: Tables) -> DataFrame:
    """Z109: rows allowed while the running total before them is below a cap."""
    rows = t.events.select("user_id", "ts", "event_id", "value")
    return ops.under_cap(rows, ["user_id"], ["ts", "event_id"], "value", 500.0).select("event_id", "allowed")


@query("z117_campos_reservados", r"""
WITH c AS (SELECT 'titulo' AS "column", titulo AS v FROM noticias UNION ALL SELECT 'url', url FROM noticias), p AS (SELECT "column", v, unnest([CASE WHEN regexp_matches(v, '[0-9]{5,}') THEN 'cifra_larga' END, CASE WHEN regexp_matches(v, 'utm_[a-z]+=') THEN 'rastreo' END]) AS pattern FROM c)
SELECT "column", pattern, count(*) AS hits FROM p WHERE pattern IS NOT NULL GROUP BY ALL""")
def reserved(t: Tables) -> DataFrame:
    """Z117: patterns that mustn't be published, by column."""
    return ops.secret_scan(t.noticias, ["titulo", "url"], {"cifra_larga": "[0-9]{5,}", "rastreo": "utm_[a-z]+="})


@query("z016_noticias_normalizadas", f"""
WITH n AS (SELECT *, {CANONICAL} AS canonica FROM noticias), g AS (SELECT canonica, count(*) AS filas, min(fila) AS primera, min(fecha_deteccion) AS detectada, min(fecha_extraccion) AS extraida,
  (list(titulo ORDER BY fila) FILTER (WHERE titulo IS NOT NULL))[1] AS titulo, (list(medio ORDER BY fila) FILTER (WHERE medio IS NOT NULL))[1] AS medio FROM n GROUP BY canonica)
SELECT 'NOT-' || substr(sha1(canonica), 1, 10) AS id, filas, primera, detectada, extraida, titulo, coalesce(nombre_legible, medio) AS medio, pais FROM g LEFT JOIN fuentes ON medio = nombre_legible""")
def normalised(t: Tables) -> DataFrame:
    """One record per page: merged fields, identifier, outlet's country."""
    rows = t.noticias.withColumn("canonica", canonical_url(F.col("url")))
    merged = tables.merge_first_non_null(rows, ["canonica"], [F.col("fila")], ["titulo", "medio"])
    facts = rows.groupBy("canonica").agg(F.count(F.lit(1)).alias("filas"), F.min("fila").alias("primera"), F.min("fecha_deteccion").alias("detectada"), F.min("fecha_extraccion").alias("extraida"))
    outlets = t.fuentes.select("nombre_legible", "pais")
    joined = facts.join(merged, "canonica").join(outlets, F.col("medio") == F.col("nombre_legible"), "left")
    return joined.select(F.concat(F.lit("NOT-"), F.substring(F.sha1("canonica"), 1, 10)).alias("id"), "filas", "primera", "detectada", "extraida", "titulo", F.coalesce("nombre_legible", "medio").alias("medio"), "pais")


QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
