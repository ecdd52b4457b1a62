"""Queries over reviews: rules kept as data, errors taken apart, work shared out, groups renamed, traces checked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telar.functions import stats, text, urls
from telar.operators import governance as ops
from telar.operators import metrics
from telar.operators.prefix import places
from telar.plans import analytics
from telar.plans.analytics import ORACLE as _SQL, _SHEET, _sheet
from telar.plans.governance import _CHAIN, _chain
from telar.plans.registry import Registry, Tables
from telar.plans.scalars import alnum, bare, iso, sql_iso
from telar.sources.readers import response_state

registry = Registry()
query = registry.query

_RULES = [
    ("causalidad", "por culpa de|debido a|a causa de"), ("acusacion", "corrupt|roba|culpable"), ("frase_prohibida", "esto se sabe|ultima hora"), ("cita", '["“«].+["”»]'),
    ("secreto", "clave|contrasena|token"), ("instruccion", "ignora|instrucciones|system prompt"), ("multa", "multa con|recibe multa"),
]
_RULE_ROWS = ", ".join(f"('{n}', '{p}')" for n, p in _RULES)


@query("v05_reglas_en_tabla", f"""
SELECT regla, count(*) AS titulares, min(fila) AS primera FROM noticias, (VALUES {_RULE_ROWS}) v(regla, patron) WHERE titulo IS NOT NULL AND regexp_matches({bare('titulo')}, patron) GROUP BY regla""")
def rules_as_data(t: Tables) -> DataFrame:
    """Rules kept as a table of patterns and held against every headline; the table of rules is fixed and small."""
    rules = t.spark.createDataFrame(_RULES, "regla string, patron string")
    rows = t.noticias.where("titulo is not null").select("fila", text.bare(F.col("titulo")).alias("b"))
    hits = rows.join(F.broadcast(rules), F.expr("b rlike patron"))
    return hits.groupBy("regla").agg(F.count(F.lit(1)).alias("titulares"), F.min("fila").alias("primera"))


@query("v08_trazabilidad", r"""
WITH h AS (SELECT DISTINCT id_noticia, trim(regexp_replace(titulo, '\s+', ' ', 'g'), ' ') AS cita, tema_humano FROM hoja_preetiquetado WHERE titulo IS NOT NULL), n AS (SELECT DISTINCT id_noticia, trim(regexp_replace(titulo, '\s+', ' ', 'g'), ' ') AS cita FROM noticias WHERE titulo IS NOT NULL),
i AS (SELECT DISTINCT id_noticia FROM noticias) SELECT h.id_noticia, h.cita, h.tema_humano, i.id_noticia IS NOT NULL AS existe, n.cita IS NOT NULL AS literal, coalesce(h.tema_humano IN (SELECT tema FROM temas), false) AS tipo_conocido
FROM h LEFT JOIN i ON i.id_noticia = h.id_noticia LEFT JOIN n ON n.id_noticia = h.id_noticia AND n.cita = h.cita""")
def traces(t: Tables) -> DataFrame:
    """V8, V1, Q7: each cited passage: its record exists, holds it literally once white space is collapsed, and its type is known."""
    quote = F.trim(F.regexp_replace("titulo", r"\s+", " ")).alias("cita")
    cited = t.hoja_preetiquetado.where("titulo is not null").select("id_noticia", quote, "tema_humano").distinct()
    there = t.noticias.select("id_noticia").distinct().withColumn("e", F.lit(True))
    held = t.noticias.where("titulo is not null").select("id_noticia", quote).distinct().withColumn("l", F.lit(True))
    kinds = t.temas.select(F.col("tema").alias("tema_humano")).distinct().withColumn("k", F.lit(True))
    rows = cited.join(there, "id_noticia", "left").join(held, ["id_noticia", "cita"], "left").join(kinds, "tema_humano", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("id_noticia", "cita", "tema_humano", yes("e").alias("existe"), yes("l").alias("literal"), yes("k").alias("tipo_conocido"))


_AGENCIES = "(autoridad de riesgos|camara del istmo|comite de tarifas|consejo vial|direccion de aguas|ente regulador|instituto de puertos|junta maritima|mesa de precios|oficina de turismo)"
_OUTLET = "CASE WHEN medio LIKE 'Radio %' OR medio LIKE 'Agencia %' THEN medio END"


@query("m12_reglas_de_procedencia", rf"""
WITH n AS (SELECT fila, zona, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '^(www\.|m\.)', ''), '') AS sitio, nullif({alnum('titulo')}, '') AS texto,
  nullif(regexp_extract({bare('titulo')}, '{_AGENCIES}'), '') AS mencionada, {_OUTLET} AS campo FROM noticias WHERE zona IS NOT NULL),
v AS (SELECT zona, fila, unnest(['mismo_sitio', 'mismo_texto', 'agencia_mencionada', 'agencia_campo', 'agencia_sitio', 'misma_red']) AS regla,
  unnest([sitio, texto, mencionada, campo, regexp_extract(sitio, '^(radio|agencia)[a-z]*'), regexp_extract(sitio, '([a-z]+\.example)$')]) AS valor FROM n)
SELECT regla, count(*) AS grupos, CAST(sum(k) AS BIGINT) AS filas FROM (SELECT zona, regla, valor, count(*) AS k FROM v WHERE valor IS NOT NULL AND valor <> '' GROUP BY ALL HAVING count(*) > 1) GROUP BY regla""")
def provenance_rules(t: Tables) -> DataFrame:
    """The six rules by which two headlines of a zone have one source, each as groups of rows that share its value."""
    host, b = urls.host(F.col("url")), text.bare(F.col("titulo"))
    values = {
        "mismo_sitio": host, "mismo_texto": text.alnum_key(F.col("titulo")), "agencia_mencionada": F.regexp_extract(b, _AGENCIES, 1),
        "agencia_campo": F.when(F.col("medio").like("Radio %") | F.col("medio").like("Agencia %"), F.col("medio")),
        "agencia_sitio": F.regexp_extract(host, "^((radio|agencia)[a-z]*)", 1), "misma_red": F.regexp_extract(host, r"([a-z]+\.example)$", 1),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("regla"), v.alias("valor")) for n, v in values.items()])
    rows = t.noticias.where("zona is not null").select("zona", F.explode(cells).alias("c")).where("c.valor is not null and c.valor <> ''")
    groups = rows.groupBy("zona", "c.regla", "c.valor").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return groups.groupBy("regla").agg(F.count(F.lit(1)).alias("grupos"), F.sum("k").alias("filas"))


@query("e21_descomposicion", f"""
SELECT CASE WHEN g IS NULL THEN 'sin_propuesta' WHEN g = t THEN 'acierto' WHEN g = 'sin_tema' THEN 'calla_de_mas' WHEN t = 'sin_tema' THEN 'habla_de_mas' ELSE 'otro_tema' END AS clase, count(*) AS n, count(DISTINCT id_noticia) AS titulares FROM ({_SHEET}) GROUP BY 1""")
def errors(t: Tables) -> DataFrame:
    """Errors taken apart: nothing proposed, silent or speaking without need, another topic."""
    g, h = F.col("propuesta_tema"), F.col("tema_humano")
    kind = F.when(g.isNull(), "sin_propuesta").when(g == h, "acierto").when(g == "sin_tema", "calla_de_mas").when(h == "sin_tema", "habla_de_mas").otherwise("otro_tema")
    return _sheet(t).groupBy(kind.alias("clase")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id_noticia").alias("titulares"))


@query("e23_ruido_por_motivo", """
WITH h AS (SELECT coalesce(nota, 'sin_nota') AS motivo, coalesce(ruido_humano, 'ninguno') <> 'ninguno' AS real, coalesce(propuesta_tema = 'sin_tema', false) AS dicho FROM hoja_preetiquetado)
SELECT motivo, count(*) FILTER (WHERE real AND dicho) AS tp, count(*) FILTER (WHERE NOT real AND dicho) AS fp, count(*) FILTER (WHERE real AND NOT dicho) AS fn,
  round(count(*) FILTER (WHERE real AND dicho) / nullif(count(*) FILTER (WHERE dicho), 0)::DOUBLE, 9) AS precision, round(count(*) FILTER (WHERE real AND dicho) / nullif(count(*) FILTER (WHERE real), 0)::DOUBLE, 9) AS recall FROM h GROUP BY 1""")
def noise_by_reason(t: Tables) -> DataFrame:
    """Precision and recall of a noise filter for each reason."""
    real, said = F.coalesce("ruido_humano", F.lit("ninguno")) != "ninguno", F.coalesce(F.col("propuesta_tema") == "sin_tema", F.lit(False))
    rows = t.hoja_preetiquetado.groupBy(F.coalesce("nota", F.lit("sin_nota")).alias("motivo")).agg(F.count_if(real & said).alias("tp"), F.count_if(~real & said).alias("fp"), F.count_if(real & ~said).alias("fn"))
    part = lambda of: F.round(F.col("tp") / F.nullif(F.col("tp") + F.col(of), F.lit(0)), 9)
    return rows.select("motivo", "tp", "fp", "fn", part("fp").alias("precision"), part("fn").alias("recall"))


@query("e24_costes", "SELECT event_type, count(*) AS llamadas, round(sum(value), 4) AS coste, round(avg(value), 9) AS medio, max(value) AS mayor FROM events GROUP BY 1")
def costs(t: Tables) -> DataFrame:
    """Number, sum, mean and largest cost of calls; their percentiles are ``e06_percentiles``."""
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("llamadas"), F.round(F.sum("value"), 4).alias("coste"), F.round(F.avg("value"), 9).alias("medio"), F.max("value").alias("mayor"))


@query("z075_texto_identico", f"""
WITH s AS (SELECT lower(trim(grupo)) AS g, {alnum('titulo')} AS k FROM hoja_preetiquetado WHERE grupo IS NOT NULL AND titulo IS NOT NULL),
n AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM s GROUP BY g, k)) AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM s GROUP BY g)) AS t, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM s GROUP BY k)) AS p)
SELECT tp, p - tp AS fp, t - tp AS fn, round(tp / p, 9) AS precision, round(tp / t, 9) AS recall, round(2 * tp / (p + t), 9) AS f1 FROM n""")
def identical_text(t: Tables) -> DataFrame:
    """The baseline that puts together headlines of the same text, as pair metrics."""
    rows = t.hoja_preetiquetado.where("titulo is not null").select(F.lower(F.trim("grupo")).alias("g"), text.alnum_key(F.col("titulo")).alias("k"))
    return metrics.pair_metrics(rows, "g", "k").select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("z076_separados_y_juntados", """
WITH s AS (SELECT lower(trim(grupo)) AS g, id_grupo AS p, count(DISTINCT id_noticia) AS n FROM hoja_preetiquetado WHERE grupo IS NOT NULL AND id_grupo IS NOT NULL GROUP BY 1, 2)
SELECT 'separado' AS error, g AS grupo, count(*) AS partes, CAST(sum(n) AS BIGINT) AS titulares FROM s GROUP BY g HAVING count(*) > 1 UNION ALL SELECT 'juntado', p, count(*), CAST(sum(n) AS BIGINT) FROM s GROUP BY p HAVING count(*) > 1""")
def apart_and_together(t: Tables) -> DataFrame:
    """Groups whose members were kept apart, and those that hold members of several, class by class and not pair by pair."""
    rows = t.hoja_preetiquetado.where("grupo is not null and id_grupo is not null").groupBy(F.lower(F.trim("grupo")).alias("g"), F.col("id_grupo").alias("p")).agg(F.countDistinct("id_noticia").alias("n"))
    side = lambda c, name: rows.groupBy(F.lit(name).alias("error"), F.col(c).alias("grupo")).agg(F.count(F.lit(1)).alias("partes"), F.sum("n").alias("titulares")).where("partes > 1")
    return side("g", "separado").union(side("p", "juntado"))


@query("z086_reparto_de_trabajo", """
WITH h AS (SELECT DISTINCT id_noticia, min(nota) OVER (PARTITION BY id_noticia) IS NOT NULL AS doble FROM hoja_preetiquetado), r AS (SELECT id_noticia, doble, row_number() OVER (PARTITION BY doble ORDER BY id_noticia) - 1 AS k FROM h)
SELECT id_noticia, p AS parte, doble FROM r, (VALUES (0), (1), (2)) v(p) WHERE doble OR k % 3 = p""")
def shared_work(t: Tables) -> DataFrame:
    """Doubtful items go to everybody, the rest by place to one of three; places come from ranges."""
    items = t.hoja_preetiquetado.groupBy("id_noticia").agg((F.count("nota") > 0).alias("doble"))
    rest = places(items.where("not doble"), [F.col("id_noticia")], "k").select("id_noticia", F.pmod(F.col("k") - 1, F.lit(3)).cast("int").alias("parte"), "doble")
    return items.where("doble").select("id_noticia", F.explode(F.array(*map(F.lit, range(3)))).alias("parte"), "doble").union(rest)


@query("z087_grupos_renombrados", """
WITH h AS (SELECT id_noticia, regexp_replace(regexp_replace(lower(trim(grupo)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-(2|bis|nota)$', '') AS g FROM hoja_preetiquetado WHERE grupo IS NOT NULL) SELECT g AS grupo, count(*) AS usos, count(DISTINCT id_noticia) AS titulares FROM h GROUP BY 1""")
def renamed(t: Tables) -> DataFrame:
    """Groups after a renaming rule, with how often each name is used."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim("grupo")), r"[^\p{L}\p{N}]+", "-"), "-(2|bis|nota)$", "")
    return t.hoja_preetiquetado.where("grupo is not null").groupBy(name.alias("grupo")).agg(F.count(F.lit(1)).alias("usos"), F.countDistinct("id_noticia").alias("titulares"))


@query("z084_acierto_ponderado", f"""
WITH s AS ({_SHEET}), w AS (SELECT t, 1.0 / count(*) AS w FROM s WHERE g IS NOT NULL GROUP BY t) SELECT round(sum(CASE WHEN s.g = s.t THEN w ELSE 0 END) / sum(w), 9) AS acierto, count(*) AS n FROM s JOIN w ON w.t = s.t WHERE s.g IS NOT NULL""")
def weighted(t: Tables) -> DataFrame:
    """Accuracy in which every class weighs the same."""
    rows = _sheet(t).where("propuesta_tema is not null")
    per = rows.groupBy("tema_humano").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tema_humano") == F.col("propuesta_tema")).alias("k"))
    return per.agg(F.round(F.avg(F.col("k") / F.col("n")), 9).alias("acierto"), F.sum("n").alias("n"))


@query("z030_ruido_con_intervalos", """
WITH g AS (SELECT coalesce(nota, 'sin_nota') AS motivo, count(*) AS n, count(*) FILTER (WHERE ruido_humano = 'fuera_de_temas') AS k FROM hoja_preetiquetado GROUP BY 1), x AS (SELECT *, k / n::DOUBLE AS p, 1 + 1.96 * 1.96 / n AS d FROM g)
SELECT motivo, n, k, CASE WHEN k = 0 THEN 0.0 ELSE round(greatest(((p + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / d, 0.0), 9) END AS bajo,
  CASE WHEN k = n THEN 1.0 ELSE round(least(((p + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / d, 1.0), 9) END AS alto FROM x""")
def noise_report(t: Tables) -> DataFrame:
    """Noise for each reason with its Wilson interval."""
    g = t.hoja_preetiquetado.groupBy(F.coalesce("nota", F.lit("sin_nota")).alias("motivo")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruido_humano") == "fuera_de_temas").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("motivo", "n", "k", F.round(low, 9).alias("bajo"), F.round(high, 9).alias("alto"))


@query("z073_muestra_con_objetivo", """
WITH r AS (SELECT DISTINCT id_noticia, tema_humano FROM hoja_preetiquetado WHERE tema_humano IN (SELECT tema FROM temas)), k AS (SELECT *, row_number() OVER (PARTITION BY tema_humano ORDER BY sha256('42|' || id_noticia), id_noticia) AS k FROM r), m AS (SELECT * FROM k WHERE k <= 20)
SELECT tema_humano AS tema, count(*) AS muestra, round(count(*) / (SELECT count(*) FROM m)::DOUBLE, 9) AS cuota, count(*) = 20 AS alcanza FROM m GROUP BY 1""")
def sampled(t: Tables) -> DataFrame:
    """A seeded sample per class, the shares it has and whether each reaches its target (a sampling operator)."""
    rows = metrics.stratified_sample(_sheet(t).select("id_noticia", "tema_humano").distinct(), ["tema_humano"], "id_noticia", 20)
    per = rows.groupBy(F.col("tema_humano").alias("tema")).agg(F.count(F.lit(1)).alias("muestra"))
    total = per.agg(F.sum("muestra").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("tema", "muestra", F.round(F.col("muestra") / F.col("t"), 9).alias("cuota"), (F.col("muestra") == 20).alias("alcanza"))


@query("z012_manifiesto", """
WITH b AS (SELECT 'noticias' AS base, fecha_extraccion AS f, medio AS fuente FROM noticias WHERE fecha_extraccion <> '' UNION ALL SELECT 'hoja', fecha_etiquetado, origen FROM hoja_preetiquetado WHERE fecha_etiquetado <> ''
  UNION ALL SELECT 'busquedas', strftime(fecha_extraccion AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), clase FROM crudos_gdelt WHERE clase IN ('ok', 'vacio') AND fecha_extraccion IS NOT NULL)
SELECT base, count(*) AS filas, count(DISTINCT fuente) AS fuentes, min(f) AS desde, max(f) AS corte FROM b GROUP BY 1""")
def manifest(t: Tables) -> DataFrame:
    """One line per base: rows, sources, first date and cut; failed responses don't count."""
    moment = F.date_format(F.to_utc_timestamp("fecha_extraccion", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = [
        t.noticias.where("fecha_extraccion <> ''").select(F.lit("noticias").alias("base"), F.col("fecha_extraccion").alias("f"), F.col("medio").alias("fuente")),
        t.hoja_preetiquetado.where("fecha_etiquetado <> ''").select(F.lit("hoja"), "fecha_etiquetado", "origen"),
        t.crudos_gdelt.where("clase in ('ok', 'vacio') and fecha_extraccion is not null").select(F.lit("busquedas"), moment, "clase"),
    ]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.groupBy("base").agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("fuente").alias("fuentes"), F.min("f").alias("desde"), F.max("f").alias("corte"))


@query("p13_ruido_con_motivo", f"""
WITH n AS (SELECT fila, zona, {bare('titulo')} AS b FROM noticias) SELECT fila, CASE WHEN regexp_matches(b, 'equipo|aficionados') THEN 'deporte' WHEN regexp_matches(b, 'crucero|festival') THEN 'promocion' WHEN regexp_matches(b, 'fotos|en video') THEN 'formato' END AS motivo,
  zona IS NOT NULL OR coalesce(regexp_matches(b, 'isla|puerto'), false) AS regional FROM n""")
def noise_reason(t: Tables) -> DataFrame:
    """The first noise rule that holds, together with whether the headline is regional."""
    b = text.bare(F.col("titulo"))
    reason = F.when(b.rlike("equipo|aficionados"), "deporte").when(b.rlike("crucero|festival"), "promocion").when(b.rlike("fotos|en video"), "formato")
    return t.noticias.select("fila", reason.alias("motivo"), (F.col("zona").isNotNull() | F.coalesce(b.rlike("isla|puerto"), F.lit(False))).alias("regional"))


@query("p23_niveles_de_validacion", """
WITH c AS (SELECT medio, count(*) AS n, count(*) FILTER (WHERE titulo IS NULL) AS a, count(*) FILTER (WHERE fecha_publicacion IS NULL) AS b, count(*) FILTER (WHERE tema IS NULL) AS d FROM noticias GROUP BY 1)
SELECT medio, unnest(['titulo', 'fecha', 'tema']) AS regla, unnest([a, b, d]) AS incumplen, unnest([CASE WHEN a = 0 THEN 'ok' ELSE 'error' END, CASE WHEN b = 0 THEN 'ok' WHEN b * 10 <= n THEN 'aviso' ELSE 'error' END, CASE WHEN d = 0 THEN 'ok' ELSE 'aviso' END]) AS nivel FROM c""")
def levels(t: Tables) -> DataFrame:
    """Rules over a snapshot, per source, each ok, a warning or an error by its own limit."""
    c = t.noticias.groupBy("medio").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(x).isNull()).alias(k) for k, x in (("a", "titulo"), ("b", "fecha_publicacion"), ("d", "tema"))])
    row = lambda rule, k, level: F.struct(F.lit(rule).alias("regla"), F.col(k).alias("incumplen"), level.alias("nivel"))
    rows = F.array(
        row("titulo", "a", F.when(F.col("a") == 0, "ok").otherwise("error")), row("fecha", "b", F.when(F.col("b") == 0, "ok").when(F.col("b") * 10 <= F.col("n"), "aviso").otherwise("error")),
        row("tema", "d", F.when(F.col("d") == 0, "ok").otherwise("aviso")),
    )
    return c.select("medio", F.explode(rows).alias("r")).select("medio", "r.*")


@query("l07_foto_y_version", """
WITH h AS (SELECT fila, id_noticia, sha256(concat_ws('|', coalesce(titulo, '∅'), coalesce(tema, '∅'))) AS h FROM noticias), v AS (SELECT id_noticia, h, min(fila) AS fila, count(*) AS vistas FROM h GROUP BY 1, 2)
SELECT id_noticia, h AS huella, fila, vistas, fila = max(fila) OVER (PARTITION BY id_noticia) AS actual FROM v""")
def snapshots(t: Tables) -> DataFrame:
    """Each content of a record once, when it was first seen, how often, and which is the current one."""
    h = F.sha2(F.concat_ws("|", F.coalesce("titulo", F.lit("∅")), F.coalesce("tema", F.lit("∅"))), 256)
    versions = t.noticias.groupBy("id_noticia", h.alias("huella")).agg(F.min("fila").alias("fila"), F.count(F.lit(1)).alias("vistas"))
    last = versions.groupBy("id_noticia").agg(F.max("fila").alias("m"))
    return versions.join(last, "id_noticia").select("id_noticia", "huella", "fila", "vistas", (F.col("fila") == F.col("m")).alias("actual"))


@query("z035_informe_de_grupos", """
WITH g AS (SELECT id_grupo, count(DISTINCT id_noticia) AS n, count(DISTINCT propuesta_tema) AS temas FROM hoja_preetiquetado WHERE id_grupo IS NOT NULL GROUP BY 1)
SELECT count(*) AS grupos, CAST(sum(n) AS BIGINT) AS titulares, max(n) AS mayor, count(*) FILTER (WHERE n = 1) AS solos, count(*) FILTER (WHERE temas > 1) AS mezclados, round(avg(n), 9) AS media FROM g""")
def group_report(t: Tables) -> DataFrame:
    """A clustering in figures: groups, members, the largest, singles and groups of several topics."""
    g = t.hoja_preetiquetado.where("id_grupo is not null").groupBy("id_grupo").agg(F.countDistinct("id_noticia").alias("n"), F.countDistinct("propuesta_tema").alias("k"))
    return g.agg(F.count(F.lit(1)).alias("grupos"), F.sum("n").alias("titulares"), F.max("n").alias("mayor"), F.count_if(F.col("n") == 1).alias("solos"), F.count_if(F.col("k") > 1).alias("mezclados"), F.round(F.avg("n"), 9).alias("media"))


@query("z047_informe_de_posiciones", """
WITH r AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_totalprice) AS iguales FROM orders)
SELECT o_orderstatus, min(k) AS primera, max(k) AS ultima, count(*) AS filas, count(*) FILTER (WHERE k <= 100) AS entre_cien, count(*) FILTER (WHERE iguales > 1) AS empatadas FROM r GROUP BY 1""")
def rank_report(t: Tables) -> DataFrame:
    """A ranking in figures for each class: first and last place, how many come high, how many are tied."""
    rows = places(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), [-F.col("o_totalprice"), F.col("o_orderkey")], "k")
    ties = t.orders.groupBy("o_totalprice").agg(F.count(F.lit(1)).alias("iguales")).where("iguales > 1")
    joined = rows.join(ties, "o_totalprice", "left")
    return joined.groupBy("o_orderstatus").agg(F.min("k").alias("primera"), F.max("k").alias("ultima"), F.count(F.lit(1)).alias("filas"), F.count_if(F.col("k") <= 100).alias("entre_cien"), F.count_if(F.col("iguales").isNotNull()).alias("empatadas"))


@query("z080_comparacion_compuesta", f"""
SELECT 'clasificacion' AS tarea, 'macro_f1' AS medida, macro_f1 AS valor FROM ({_SQL["e03_macro_f1"]}) UNION ALL SELECT 'agrupacion', 'f1', f1 FROM ({_SQL["e09_pares"]}) UNION ALL SELECT 'agrupacion_por_texto', 'f1', f1 FROM ({registry.ORACLE["z075_texto_identico"]})
UNION ALL SELECT 'busqueda', 'precision_5', precision_5 FROM ({_SQL["e08_recuerdo"]}) UNION ALL SELECT 'acuerdo', 'kappa', kappa FROM ({_SQL["e16_kappa"]})""")
def composite(t: Tables) -> DataFrame:
    """The measures of several tasks and of their baselines side by side."""
    run = lambda name: analytics.QUERIES[name](t.spark, t.dir)
    parts = [("clasificacion", "macro_f1", run("e03_macro_f1")), ("agrupacion", "f1", run("e09_pares")), ("agrupacion_por_texto", "f1", identical_text(t)), ("busqueda", "precision_5", run("e08_recuerdo")), ("acuerdo", "kappa", run("e16_kappa"))]
    rows = [d.select(F.lit(task).alias("tarea"), F.lit(m).alias("medida"), F.col(m).cast("double").alias("valor")) for task, m, d in parts]
    return reduce(DataFrame.union, rows)


@query("z085_filas_de_etiqueta", r"""
WITH h AS (SELECT *, CASE WHEN nullif(trim(etiquetado_por, ' '), '') IS NULL THEN 'sin_anotador' WHEN NOT coalesce(regexp_full_match(id_noticia, 'NOT-[0-9a-f]{10}'), false) THEN 'id_malo' WHEN NOT coalesce(regexp_full_match(fecha_etiquetado, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z'), false) THEN 'fecha_mala'
  WHEN nullif(trim(tema_humano, ' '), '') IS NULL THEN 'sin_decision' WHEN tema_humano NOT IN (SELECT tema FROM temas) THEN 'tema_desconocido' ELSE 'ok' END AS estado FROM hoja_preetiquetado)
SELECT estado, count(*) AS filas, count(DISTINCT id_noticia) AS titulares FROM h GROUP BY 1""")
def label_rows(t: Tables) -> DataFrame:
    """Label rows by the first check they fail."""
    known = t.temas.select(F.col("tema").alias("tema_humano"), F.lit(True).alias("k")).distinct()
    blank = lambda c: F.nullif(F.trim(c), F.lit("")).isNull()
    fits = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    state = (
        F.when(blank("etiquetado_por"), "sin_anotador").when(~fits("id_noticia", "^NOT-[0-9a-f]{10}$"), "id_malo").when(~fits("fecha_etiquetado", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), "fecha_mala")
        .when(blank("tema_humano"), "sin_decision").when(F.col("k").isNull(), "tema_desconocido").otherwise("ok")
    )
    return t.hoja_preetiquetado.join(known, "tema_humano", "left").groupBy(state.alias("estado")).agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("id_noticia").alias("titulares"))


@query("z074_banco_de_pruebas", """
WITH n AS (SELECT DISTINCT id_noticia FROM noticias), b AS (SELECT bloque AS tipo, id_noticia, nullif(trim(titulo, ' '), '') AS consulta, propuesta_tema FROM hoja_preetiquetado)
SELECT tipo, count(*) AS filas, count(DISTINCT b.id_noticia) AS casos, count(*) FILTER (WHERE consulta IS NULL) AS sin_consulta, count(*) FILTER (WHERE n.id_noticia IS NULL) AS sin_evidencia, count(*) FILTER (WHERE propuesta_tema = 'sin_tema') AS se_abstiene, count(*) > count(DISTINCT b.id_noticia) AS repetidos
FROM b LEFT JOIN n ON n.id_noticia = b.id_noticia GROUP BY 1""")
def benchmark(t: Tables) -> DataFrame:
    """A benchmark file checked: counts for each type, empty questions, evidence that doesn't exist, repeated cases."""
    known = t.noticias.select("id_noticia").distinct().withColumn("n", F.lit(True))
    cases = F.countDistinct("id_noticia")
    return t.hoja_preetiquetado.join(known, "id_noticia", "left").groupBy(F.col("bloque").alias("tipo")).agg(
        F.count(F.lit(1)).alias("filas"), cases.alias("casos"), F.count_if(F.nullif(F.trim("titulo"), F.lit("")).isNull()).alias("sin_consulta"), F.count_if(F.col("n").isNull()).alias("sin_evidencia"),
        F.count_if(F.col("propuesta_tema") == "sin_tema").alias("se_abstiene"), (F.count(F.lit(1)) > cases).alias("repetidos"))


@query("z116_coherencia_de_artefactos", """
WITH a AS (SELECT count(DISTINCT id_noticia) AS ids, max(fecha_extraccion) AS corte, count(DISTINCT tema) AS temas FROM noticias), b AS (SELECT count(DISTINCT id_noticia) AS ids, max(fecha_etiquetado) AS corte, count(DISTINCT propuesta_tema) AS temas FROM hoja_preetiquetado)
SELECT unnest(['titulares', 'corte', 'temas']) AS comprobacion, unnest([a.ids::VARCHAR, a.corte, a.temas::VARCHAR]) AS uno, unnest([b.ids::VARCHAR, b.corte, b.temas::VARCHAR]) AS otro, unnest([a.ids = b.ids, a.corte = b.corte, a.temas = b.temas]) AS coincide FROM a, b""")
def coherent(t: Tables) -> DataFrame:
    """Z116: figures that two artefacts should share, as warnings where they differ."""
    def facts(df: DataFrame, moment: str, topic: str, side: str) -> DataFrame:
        row = df.agg(F.countDistinct("id_noticia").cast("string").alias("i"), F.max(moment).alias("c"), F.countDistinct(topic).cast("string").alias("k"))
        cells = F.array(*[F.struct(F.lit(n).alias("comprobacion"), F.col(c).alias(side)) for n, c in (("titulares", "i"), ("corte", "c"), ("temas", "k"))])
        return row.select(F.explode(cells).alias("x")).select("x.*")

    both = facts(t.noticias, "fecha_extraccion", "tema", "uno").join(facts(t.hoja_preetiquetado, "fecha_etiquetado", "propuesta_tema", "otro"), "comprobacion")
    return both.withColumn("coincide", F.col("uno") == F.col("otro"))


_FAMILIES = {"deporte": "equipo|aficionados", "farandula": "festival|crucero", "empleo": "feria de empleo|plazas", "formato": "en video|fotos", "tiempo": "pronostico|horoscopo"}


@query("z028_fuera_de_tema", f"SELECT fila, {', '.join(f"coalesce(regexp_matches({bare('titulo')}, '{p}'), false) AS {n}" for n, p in _FAMILIES.items())}, coalesce(regexp_matches({bare('titulo')}, '{'|'.join(_FAMILIES.values())}'), false) AS alguna FROM noticias")
def off_topic(t: Tables) -> DataFrame:
    """Five families of patterns and whether any holds; rows are marked, none is dropped."""
    b = text.bare(F.col("titulo"))
    holds = lambda p: F.coalesce(b.rlike(p), F.lit(False))
    return t.noticias.select("fila", *[holds(p).alias(n) for n, p in _FAMILIES.items()], holds("|".join(_FAMILIES.values())).alias("alguna"))


@query("z038_sismo_o_contexto", f"""
WITH q AS (SELECT zona, CAST(hora_utc AT TIME ZONE 'UTC' AS DATE) AS dia, min(id_sismo) AS id_sismo, count(DISTINCT id_sismo) AS n FROM sismos WHERE zona IS NOT NULL GROUP BY 1, 2), z AS (SELECT zona, count(DISTINCT id_sismo) AS n FROM sismos WHERE zona IS NOT NULL GROUP BY 1),
m AS (SELECT fila, zona, CAST(({sql_iso('fecha_publicacion')}) AT TIME ZONE 'UTC' AS DATE) AS dia FROM noticias WHERE zona IS NOT NULL)
SELECT fila, CASE WHEN q.n = 1 THEN 'enlazado' WHEN q.n > 1 THEN 'ambiguo' WHEN z.n > 0 THEN 'contexto' ELSE 'sin_datos' END AS estado, CASE WHEN q.n = 1 THEN id_sismo END AS id_sismo, coalesce(z.n, 0) AS historicos FROM m LEFT JOIN q ON q.zona = m.zona AND q.dia = m.dia LEFT JOIN z ON z.zona = m.zona""")
def quake_or_context(t: Tables) -> DataFrame:
    """A headline's quake of its zone and day: one is linked, several are ambiguous, none falls back to the zone's history."""
    day = lambda c: F.to_date(F.to_utc_timestamp(c, F.current_timezone()))
    quakes = t.sismos.where("zona is not null")
    per_day = quakes.groupBy("zona", day(F.col("hora_utc")).alias("dia")).agg(F.min("id_sismo").alias("id_sismo"), F.countDistinct("id_sismo").alias("n"))
    per_zone = quakes.groupBy("zona").agg(F.countDistinct("id_sismo").alias("historicos"))
    news = t.noticias.where("zona is not null").select("fila", "zona", day(iso("fecha_publicacion")).alias("dia"))
    rows = news.join(per_day, ["zona", "dia"], "left").join(per_zone, "zona", "left")
    state = F.when(F.col("n") == 1, "enlazado").when(F.col("n") > 1, "ambiguo").when(F.col("historicos") > 0, "contexto").otherwise("sin_datos")
    return rows.select("fila", state.alias("estado"), F.when(F.col("n") == 1, F.col("id_sismo")).alias("id_sismo"), F.coalesce("historicos", F.lit(0)).cast("long").alias("historicos"))


@query("z043_nombrado_por_si_mismo", f"""
WITH w AS (SELECT fila, string_split({bare("regexp_replace(titulo, '[^\\p{L}\\p{N} ]+', '', 'g')")}, ' ') AS w FROM noticias WHERE titulo IS NOT NULL)
SELECT fila, len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'istmo' AND coalesce(w[i - 1], '') <> 'del')) > 0 OR len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'canal' AND coalesce(w[i - 1], '') <> 'del' AND coalesce(w[i + 1], '') <> 'seco')) > 0 AS nombrado FROM w""")
def named_as_itself(t: Tables) -> DataFrame:
    """A place named as itself: not within longer names, not by its look-alikes."""
    plain = F.regexp_replace("titulo", r"[^\p{L}\p{N} ]+", "")
    named = text.has_term(plain, "istmo", before=("del",)) | text.has_term(plain, "canal", before=("del",), not_after=("seco",))
    return t.noticias.where("titulo is not null").select("fila", named.alias("nombrado"))


@query("z051_enlaces_oficiales", """
WITH u AS (SELECT id_sismo, max(updated) AS u FROM sismos GROUP BY 1), s AS (SELECT DISTINCT s.id_sismo, zona, magnitud, estado FROM sismos s JOIN u ON s.id_sismo = u.id_sismo AND updated = u)
SELECT zona, id_sismo, estado FROM s WHERE magnitud IS NOT NULL AND estado IN ('reviewed', 'automatic')""")
def official_links(t: Tables) -> DataFrame:
    """Official links that have data and an accepted state."""
    last = t.sismos.groupBy(F.col("id_sismo").alias("i")).agg(F.max("updated").alias("u"))
    rows = t.sismos.join(last, (F.col("id_sismo") == F.col("i")) & (F.col("updated") == F.col("u"))).select("id_sismo", "zona", "magnitud", "estado").distinct()
    return rows.where("magnitud is not null and estado in ('reviewed', 'automatic')").select("zona", "id_sismo", "estado")


@query("z001_estado_de_respuesta", """
SELECT archivo, fecha_extraccion, CASE WHEN n_articulos IS NULL THEN 'invalido' WHEN n_articulos = 0 THEN 'vacio' WHEN n_articulos >= 250 AND (epoch(fin) - epoch(ini)) / 2 >= 3600 THEN 'truncado' ELSE 'ok' END AS estado, count(*) AS n FROM crudos_gdelt GROUP BY ALL""")
def response_states(t: Tables) -> DataFrame:
    """The state of each search response read from its text: empty, invalid, or truncated at the cap if its range can be halved."""
    count = F.col("n_articulos")
    full = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.struct(i.cast("string").alias("url"))).alias("articles")))
    body = F.when(count == 0, " ").when(count.isNotNull(), full)
    seconds = (F.unix_micros("fin") - F.unix_micros("ini")) / 1e6
    rows = t.crudos_gdelt.select("archivo", "fecha_extraccion", body.alias("texto"), seconds.alias("s"))
    return rows.groupBy("archivo", "fecha_extraccion", response_state(F.col("texto"), 250, F.col("s"), 3600).alias("estado")).agg(F.count(F.lit(1)).alias("n"))


_REPORTS = "segun|informa|dice|advierte|reporta|celebra|confirma|anuncia"


@query("v01_atribucion", f"""
SELECT fila, coalesce(regexp_matches({bare('titulo')}, '(^|[^a-z])({_REPORTS})($|[^a-z])'), false) OR coalesce(contains({bare('titulo')}, {bare('medio')}), false) AS atribuida, coalesce(contains(titulo, '"'), false) AS declaracion FROM noticias""")
def attribution(t: Tables) -> DataFrame:
    """V1: whether a statement carries its attribution, a verb of reporting or the outlet's name, and whether it is a quotation."""
    b = text.bare(F.col("titulo"))
    said = F.coalesce(b.rlike(f"(^|[^a-z])({_REPORTS})($|[^a-z])"), F.lit(False)) | F.coalesce(F.contains(b, text.bare(F.col("medio"))), F.lit(False))
    return t.noticias.select("fila", said.alias("atribuida"), F.coalesce(F.col("titulo").contains('"'), F.lit(False)).alias("declaracion"))


@query("v02_recorte_por_tope", f"""
WITH RECURSIVE c AS MATERIALIZED ({_CHAIN}), g AS (SELECT fila FROM c WHERE falla UNION SELECT c.fila FROM c JOIN g ON c.base = g.fila), k AS (SELECT id_noticia, fila FROM noticias WHERE fila NOT IN (SELECT fila FROM g))
SELECT id_noticia, fila, row_number() OVER (PARTITION BY id_noticia ORDER BY fila) AS orden FROM k QUALIFY row_number() OVER (PARTITION BY id_noticia ORDER BY fila) <= 2""")
def trimmed(t: Tables) -> DataFrame:
    """V2: of the claims that don't fall at most two stay for each record, the first ones (the cap is the feature)."""
    claims, edges = _chain(t)
    kept = ops.fallen(claims, edges, "fila", "falla").where("not falls").select("fila").join(t.noticias.select("fila", "id_noticia"), "fila")
    order = F.row_number().over(Window.partitionBy("id_noticia").orderBy("fila"))
    return kept.withColumn("orden", order.cast("long")).where("orden <= 2").select("id_noticia", "fila", "orden")


QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
