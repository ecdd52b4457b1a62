"""Queries over aggregation, joins, windows, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telar.operators import tables as ops
from telar.operators.intervals import merge_intervals
from telar.operators.prefix import places
from telar.plans.registry import Registry, Tables
from telar.plans.scalars import sql_iso, iso

registry = Registry()
query = registry.query


# Aggregations

@query("a01_por_categoria", "SELECT coalesce(origen, '(nulo)') AS origen, coalesce(tema, '(nulo)') AS tema, count(*) AS n FROM noticias GROUP BY 1, 2")
def per_category(t: Tables) -> DataFrame:
    """Rows per category, null under its own name."""
    return t.noticias.groupBy(*[F.coalesce(c, F.lit("(nulo)")).alias(c) for c in ("origen", "tema")]).agg(F.count(F.lit(1)).alias("n"))


@query("a02_concentracion", """
WITH c AS (SELECT coalesce(medio, '(nulo)') AS medio, count(*) AS n FROM noticias GROUP BY 1), t AS (SELECT count(*) AS total FROM noticias),
b AS (SELECT medio, n, total, n / total::DOUBLE AS share FROM c, t ORDER BY n DESC, medio LIMIT 10)
SELECT medio, n, total, round(share, 9) AS share, round((share + 1.9208 / total - 1.96 * sqrt(share * (1 - share) / total + 0.9604 / (total::DOUBLE * total))) / (1 + 3.8416 / total), 9) AS low FROM b""")
def concentration(t: Tables) -> DataFrame:
    """A2: the ten outlets with most rows, their share and its lower bound (a top-k report)."""
    return ops.concentration(t.noticias, "medio", 10).select("medio", "n", "total", F.round("share", 9).alias("share"), F.round("low", 9).alias("low"))


@query("a03_conteo_condicionado", "SELECT count(*) AS filas, count(*) FILTER (WHERE tema IS NULL) AS sin_tema, count(titulo) AS con_titulo, coalesce(sum(length(titulo)), 0) AS letras, coalesce(max(length(titulo)), 0) AS mas_largo FROM noticias")
def conditional_count(t: Tables) -> DataFrame:
    """Filtered counts and sums that are 0 on an empty table."""
    size = F.length("titulo")
    return t.noticias.agg(
        F.count(F.lit(1)).alias("filas"), F.count_if(F.col("tema").isNull()).alias("sin_tema"), F.count("titulo").alias("con_titulo"),
        F.coalesce(F.sum(size), F.lit(0)).alias("letras"), F.coalesce(F.max(size), F.lit(0)).alias("mas_largo"),
    )


@query("a06_dimension_completa", "SELECT tema, count(x) AS n FROM temas LEFT JOIN (SELECT tema AS k, 1 AS x FROM noticias) ON tema = k GROUP BY tema")
def zero_filled(t: Tables) -> DataFrame:
    """Rows of each known subject, 0 where there is none."""
    return ops.zero_filled(t.noticias, "tema", t.temas)


_COLUMNS = ["fila", "id_noticia", "titulo", "url", "medio", "idioma", "fecha_publicacion", "tema", "zona"]


@query("a07_nulos", "\nUNION ALL ".join(f"SELECT '{c}' AS columna, count(*) AS filas, count(*) - count({c}) AS nulos, count(DISTINCT {c}) AS distintos FROM noticias" for c in _COLUMNS))
def nulls(t: Tables) -> DataFrame:
    """Nulls and distinct values of every column."""
    return ops.null_profile(t.noticias.select(*_COLUMNS))


@query("a08_informe_calidad", "SELECT coalesce(archivo, '(todos)') AS archivo, contrato, count(*) AS n, count(DISTINCT fila) AS filas FROM filas_crudas GROUP BY GROUPING SETS ((archivo, contrato), (contrato), ())")
def quality(t: Tables) -> DataFrame:
    """Totals per file, per contract and over all, in one pass of grouping sets."""
    rows = t.filas_crudas.groupingSets([["archivo", "contrato"], ["contrato"], []], "archivo", "contrato")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fila").alias("filas")).withColumn("archivo", F.coalesce("archivo", F.lit("(todos)")))


@query("a09_fusion_primer_no_nulo", """
SELECT id_noticia, (list(titulo ORDER BY fecha_extraccion, fila) FILTER (WHERE titulo IS NOT NULL))[1] AS titulo, (list(tema ORDER BY fecha_extraccion, fila) FILTER (WHERE tema IS NOT NULL))[1] AS tema,
  (list(idioma ORDER BY fecha_extraccion, fila) FILTER (WHERE idioma IS NOT NULL))[1] AS idioma FROM (SELECT * FROM noticias WHERE fecha_extraccion IS NOT NULL) GROUP BY id_noticia""")
def merged(t: Tables) -> DataFrame:
    """First value that isn't null, by extraction."""
    rows = t.noticias.where("fecha_extraccion is not null")
    return ops.merge_first_non_null(rows, ["id_noticia"], [F.col("fecha_extraccion"), F.col("fila")], ["titulo", "tema", "idioma"])


@query("a10_menos_nulos", """
SELECT id_noticia, fila, titulo, tema FROM (SELECT *, row_number() OVER (PARTITION BY id_noticia ORDER BY (titulo IS NULL)::INT + (tema IS NULL)::INT, fila) AS k
FROM (SELECT id_noticia, fila, titulo, tema FROM noticias)) WHERE k = 1""")
def fullest(t: Tables) -> DataFrame:
    """The whole row with the fewest nulls per key."""
    return ops.keep_fullest(t.noticias.select("id_noticia", "fila", "titulo", "tema"), ["id_noticia"], ["fila"])


@query("a11_union_tokens", """
WITH x AS (SELECT medio, trim(unnest(string_split(tema, '|'))) AS v FROM noticias WHERE medio IS NOT NULL),
d AS (SELECT DISTINCT medio, v FROM x WHERE v <> '')
SELECT m.medio, coalesce(string_agg(v, '|' ORDER BY CASE v WHEN 'turismo' THEN 1 WHEN 'economia' THEN 2 ELSE 99 END, v), '') AS temas FROM (SELECT DISTINCT medio FROM noticias WHERE medio IS NOT NULL) m LEFT JOIN d ON m.medio = d.medio GROUP BY m.medio""")
def token_union(t: Tables) -> DataFrame:
    """Subjects per outlet, without repeats and in a preferred order."""
    return t.noticias.where("medio is not null").groupBy("medio").agg(ops.union_tokens(F.col("tema"), "|", ["turismo", "economia"]).alias("temas"))


@query("a12_extremos_de_texto", "SELECT id_noticia, min(fecha_extraccion) AS primera, max(fecha_extraccion) AS ultima, min(fecha_deteccion) AS detectada FROM noticias GROUP BY 1")
def extremes(t: Tables) -> DataFrame:
    """Earliest and latest of ISO texts."""
    return t.noticias.groupBy("id_noticia").agg(F.min("fecha_extraccion").alias("primera"), F.max("fecha_extraccion").alias("ultima"), F.min("fecha_deteccion").alias("detectada"))


@query("a13_fusion_por_url", """
SELECT url, min(fecha_deteccion) AS detectada, count(*) AS veces, coalesce(array_to_string(list_sort(list_distinct(list(origen) FILTER (WHERE origen IS NOT NULL))), ','), '') AS origenes,
  arg_min(fila, CASE origen WHEN 'RSS' THEN 0 ELSE 1000000000000 END + fila) AS fila FROM noticias GROUP BY url""")
def by_url(t: Tables) -> DataFrame:
    """One row per address, first detection, number of visits, source by priority."""
    return t.noticias.groupBy("url").agg(
        F.min("fecha_deteccion").alias("detectada"), F.count(F.lit(1)).alias("veces"), F.array_join(F.array_sort(F.collect_set("origen")), ",").alias("origenes"),
        F.min_by("fila", F.struct(F.when(F.col("origen") == "RSS", 0).otherwise(1), "fila")).alias("fila"),
    )


@query("a14_tema_modal", """
SELECT medio, tema, n FROM (SELECT medio, tema, count(*) AS n, row_number() OVER (PARTITION BY medio ORDER BY count(*) DESC, tema) AS k FROM noticias WHERE tema IS NOT NULL GROUP BY 1, 2) WHERE k = 1""")
def modal(t: Tables) -> DataFrame:
    """The most frequent subject per outlet, ties to the first in the alphabet."""
    return ops.modal(t.noticias, ["medio"], "tema")


@query("a19_grupo_armado", f"""
SELECT zona, count(*) AS n, count(DISTINCT medio) AS medios, min({sql_iso('fecha_publicacion')}) AS desde, max({sql_iso('fecha_publicacion')}) AS hasta,
  coalesce(array_to_string(list_sort(list_distinct(list(idioma) FILTER (WHERE idioma IS NOT NULL))), ','), '') AS idiomas FROM noticias GROUP BY zona""")
def assembled(t: Tables) -> DataFrame:
    """Size, exact distinct outlets, dates and languages of each group."""
    return t.noticias.groupBy("zona").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("medio").alias("medios"), F.min(iso("fecha_publicacion")).alias("desde"), F.max(iso("fecha_publicacion")).alias("hasta"),
        F.array_join(F.array_sort(F.collect_set("idioma")), ",").alias("idiomas"),
    )


@query("a21_banderas", "SELECT zona, bool_or(estado = 'reviewed') AS revisado, bool_and(magnitud IS NOT NULL) AS con_magnitud, count(*) FILTER (WHERE estado = 'deleted') AS retirados, min(CASE WHEN magnitud IS NULL THEN id_sismo END) AS primero_sin FROM sismos GROUP BY zona")
def flags(t: Tables) -> DataFrame:
    """Flags and first reasons per group."""
    return t.sismos.groupBy("zona").agg(
        F.bool_or(F.col("estado") == "reviewed").alias("revisado"), F.bool_and(F.col("magnitud").isNotNull()).alias("con_magnitud"),
        F.count_if(F.col("estado") == "deleted").alias("retirados"), F.min(F.when(F.col("magnitud").isNull(), F.col("id_sismo"))).alias("primero_sin"),
    )


@query("a23_contingencia", "SELECT tema, count(*) FILTER (WHERE clase = 'ok') AS ok, count(*) FILTER (WHERE clase = 'vacio') AS vacio, count(*) FILTER (WHERE clase = 'truncado') AS truncado FROM crudos_gdelt GROUP BY tema")
def contingency(t: Tables) -> DataFrame:
    """A contingency table with named columns."""
    return ops.cross_counts(t.crudos_gdelt, "tema", "clase", ["ok", "vacio", "truncado"])


@query("a25_resumen", "SELECT event_type, count(value) AS n, min(value) AS min, quantile_cont(value, 0.5) AS median, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def summary(t: Tables) -> DataFrame:
    """Summary with exact median and population deviation."""
    return ops.summary(t.events, ["event_type"], "value").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("a27_histograma", "SELECT CASE WHEN magnitud IS NULL THEN 'sin dato' WHEN magnitud < 3 THEN '<3' WHEN magnitud < 4 THEN '3-4' WHEN magnitud < 5 THEN '4-5' ELSE '5+' END AS tramo, count(*) AS n, coalesce(count_if(magnitud >= 3), 0) AS desde_3 FROM sismos GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    """Quakes by magnitude class."""
    m = F.col("magnitud")
    bin_ = F.when(m.isNull(), "sin dato").when(m < 3, "<3").when(m < 4, "3-4").when(m < 5, "4-5").otherwise("5+")
    return t.sismos.groupBy(bin_.alias("tramo")).agg(F.count(F.lit(1)).alias("n"), F.count_if(m >= 3).alias("desde_3"))


@query("a28_tasas_por_grupo", "SELECT bloque, origen, count(*) AS filas, count(DISTINCT id_noticia) AS titulares, round(count(*) FILTER (WHERE tema_humano IS NULL) / count(*)::DOUBLE, 9) AS sin_decidir FROM hoja_preetiquetado GROUP BY GROUPING SETS ((bloque), (bloque, origen))")
def rates(t: Tables) -> DataFrame:
    """Rates with the right denominators, by two groupings at once."""
    rows = t.hoja_preetiquetado.groupingSets([["bloque"], ["bloque", "origen"]], "bloque", "origen")
    return rows.agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("id_noticia").alias("titulares"), F.round(F.count_if(F.col("tema_humano").isNull()) / F.count(F.lit(1)), 9).alias("sin_decidir"))


@query("a30_listas", "SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ',') AS partes, len(list_distinct(list(l_suppkey))) AS proveedores FROM lineitem GROUP BY l_orderkey")
def ordered_lists(t: Tables) -> DataFrame:
    """Ordered list and number of distinct values per group."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string"))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(ordered, ",").alias("partes"), F.countDistinct("l_suppkey").alias("proveedores"))


@query("a31_mayor_con_desempate", "SELECT zona, coalesce(count_if(magnitud >= 3), 0) AS n3, (list(id_sismo ORDER BY magnitud DESC NULLS LAST, hora_utc, id_sismo, updated))[1] AS mayor FROM sismos GROUP BY zona")
def argmax(t: Tables) -> DataFrame:
    """Strongest quake per zone with ties by time and id."""
    order = F.struct(F.coalesce(-F.col("magnitud"), F.lit(float("inf"))), "hora_utc", "id_sismo", "updated")
    return t.sismos.groupBy("zona").agg(F.count_if(F.col("magnitud") >= 3).alias("n3"), F.min_by("id_sismo", order).alias("mayor"))


@query("a33_cobertura_por_dia", """
WITH d AS (SELECT DISTINCT tema, unnest(generate_series((ini AT TIME ZONE 'UTC')::DATE, ((fin - INTERVAL 1 MICROSECOND) AT TIME ZONE 'UTC')::DATE, INTERVAL 1 DAY))::DATE AS dia FROM crudos_gdelt WHERE clase = 'ok' AND ini < fin)
SELECT tema, count(*) AS dias_tocados, min(dia) AS primero, max(dia) AS ultimo FROM d GROUP BY tema""")
def coverage(t: Tables) -> DataFrame:
    """Days that the covered periods of a subject touch."""
    periods = merge_intervals(t.crudos_gdelt.where("clase = 'ok'"), ["tema"], "ini", "fin").where("kind = 'period'")
    last = F.to_date(F.col("end") - F.expr("interval 1 microsecond"))
    days = periods.select("tema", F.explode(F.sequence(F.to_date("start"), last)).alias("dia")).distinct()
    return days.groupBy("tema").agg(F.count(F.lit(1)).alias("dias_tocados"), F.min("dia").alias("primero"), F.max("dia").alias("ultimo"))


# Joins

@query("j01_tres_tablas", "SELECT n_name, count(*) AS pedidos, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def three_way(t: Tables) -> DataFrame:
    """Inner joins of three tables; the fact table is aggregated before it meets the names."""
    per_customer = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    joined = per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("n").alias("pedidos"), F.round(F.sum("s"), 2).alias("total"))


@query("j02_existe", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pendiente FROM customer")
def exists(t: Tables) -> DataFrame:
    """Existence as a boolean."""
    hit = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    return t.customer.join(hit, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("pendiente"))


@query("j03_no_existe", "SELECT DISTINCT id_noticia FROM noticias n WHERE NOT EXISTS (SELECT 1 FROM hoja_preetiquetado h WHERE h.id_noticia = n.id_noticia)")
def not_exists(t: Tables) -> DataFrame:
    """Anti-join; records that the sheet lacks."""
    return t.noticias.select("id_noticia").distinct().join(t.hoja_preetiquetado, "id_noticia", "left_anti")


@query("j04_escalar_correlado", "SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS ultimo FROM customer")
def scalar(t: Tables) -> DataFrame:
    """A correlated scalar as a grouped left join."""
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("ultimo"))
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "ultimo")


@query("j06_condicion_en_on", "SELECT o_orderkey, count(l_orderkey) AS lineas, coalesce(round(sum(l_extendedprice), 2), 0.0) AS importe FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND NOT (l_returnflag = 'R') GROUP BY o_orderkey")
def on_condition(t: Tables) -> DataFrame:
    """An extra predicate in the join condition; lines are aggregated before the join."""
    lines = t.lineitem.where("not l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("s"))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lineas"), F.coalesce(F.round("s", 2), F.lit(0.0)).alias("importe"))


@query("j08_dimension", "SELECT n.fila, n.medio, f.pais, coalesce(f.origen, n.origen) AS origen FROM noticias n LEFT JOIN fuentes f ON n.medio = f.nombre_legible")
def dimension(t: Tables) -> DataFrame:
    """Dimension lookup that overrides only where it matches; the fixed table is broadcast by its size."""
    f = t.fuentes.select(F.col("nombre_legible").alias("medio"), "pais", F.col("origen").alias("o"))
    return t.noticias.join(f, "medio", "left").select("fila", "medio", "pais", F.coalesce("o", "origen").alias("origen"))


@query("j09_explode_y_une", "SELECT n.fila, t.tema, t.nombre FROM (SELECT fila, unnest(string_split(tema, '|')) AS k FROM noticias WHERE tema IS NOT NULL) n JOIN temas t ON trim(n.k) = t.tema")
def exploded(t: Tables) -> DataFrame:
    """Members of a delimited list joined to their names."""
    each = t.noticias.where("tema is not null").select("fila", F.explode(F.split("tema", r"\|")).alias("k")).select("fila", F.trim("k").alias("tema"))
    return each.join(t.temas, "tema").select("fila", "tema", "nombre")


@query("j10_reglas", """
WITH r(regla, tema, patron, excluye) AS (VALUES ('agua', 'servicios_publicos', 'agua|familias', 'inunda'), ('peaje', 'regulacion', 'peaje', 'transportistas'), ('multa', 'regulacion', 'multa', '^$'))
SELECT fila, regla FROM noticias n JOIN r ON n.tema = r.tema AND regexp_matches(lower(titulo), patron) AND NOT regexp_matches(lower(titulo), excluye)""")
def rules(t: Tables) -> DataFrame:
    """Rows and rules joined on subject, then by patterns; the rules are fixed."""
    rows = [("agua", "servicios_publicos", "agua|familias", "inunda"), ("peaje", "regulacion", "peaje", "transportistas"), ("multa", "regulacion", "multa", "^$")]
    rules = t.spark.createDataFrame(rows, "regla string, tema string, patron string, excluye string")
    low = F.lower("titulo")
    return t.noticias.join(F.broadcast(rules), "tema").where(F.expr("lower(titulo) rlike patron and not lower(titulo) rlike excluye")).select("fila", "regla")


@query("j11_intervalo", f"""
SELECT n.fila, s.id_sismo, s.updated FROM (SELECT fila, zona, {sql_iso('fecha_publicacion')} AS f FROM noticias WHERE zona IS NOT NULL) n JOIN sismos s ON n.zona = s.zona AND abs(epoch_us(n.f) - epoch_us(s.hora_utc)) <= 172800000000""")
def interval(t: Tables) -> DataFrame:
    """Quakes of the zone within two days, by time cells."""
    news = t.noticias.where("zona is not null").select("fila", "zona", iso("fecha_publicacion").alias("f")).where("f is not null")
    return ops.within_interval(news, t.sismos.select("zona", "id_sismo", "hora_utc", "updated"), "zona", "f", "hora_utc", 172_800).select("fila", "id_sismo", "updated")


@query("j12_ultimo_no_nulo", "SELECT zona, arg_max(magnitud, (hora_utc, id_sismo, updated)) FILTER (WHERE magnitud IS NOT NULL) AS ultima, max(hora_utc) FILTER (WHERE magnitud IS NOT NULL) AS cuando FROM sismos GROUP BY zona")
def last_known(t: Tables) -> DataFrame:
    """The latest value that isn't null."""
    known = F.when(F.col("magnitud").isNotNull(), F.struct("hora_utc", "id_sismo", "updated", "magnitud"))
    return t.sismos.groupBy("zona").agg(F.max(known).alias("k")).select("zona", F.col("k.magnitud").alias("ultima"), F.col("k.hora_utc").alias("cuando"))


@query("j14_ventana_hasta_ultimo", """
WITH m AS (SELECT o_custkey, max(year(o_orderdate)) AS y FROM orders GROUP BY 1)
SELECT o.o_custkey, year(o_orderdate) AS anio, count(*) AS n FROM orders o JOIN m ON o.o_custkey = m.o_custkey AND year(o_orderdate) <= y AND year(o_orderdate) > y - 3 GROUP BY 1, 2""")
def trailing(t: Tables) -> DataFrame:
    """The last three years up to each key's own latest; counts per year come first, so one shuffle does."""
    years = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("anio")).agg(F.count(F.lit(1)).alias("n"))
    last = F.max("anio").over(Window.partitionBy("o_custkey"))
    return years.withColumn("y", last).where("anio > y - 3").select("o_custkey", "anio", "n")


@query("j19_rejilla_completa", """
WITH k AS (SELECT DISTINCT c_mktsegment FROM customer), y AS (SELECT DISTINCT year(o_orderdate) AS anio FROM orders), v AS (SELECT c_mktsegment, year(o_orderdate) AS anio, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_totalprice > 400000 GROUP BY 1, 2)
SELECT k.c_mktsegment, y.anio, v.n FROM k CROSS JOIN y LEFT JOIN v USING (c_mktsegment, anio)""")
def full_grid(t: Tables) -> DataFrame:
    """A grid of two small dimensions; what is missing stays null."""
    orders = t.orders.withColumn("anio", F.year("o_orderdate"))
    values = orders.where("o_orderstatus = 'P' and o_totalprice > 400000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "anio").agg(F.count(F.lit(1)).alias("n"))
    return ops.complete_grid([t.customer.select("c_mktsegment").distinct(), orders.select("anio").distinct()], values, ["c_mktsegment", "anio"])


@query("j20_valores_cambiados", """
WITH a AS (SELECT id_noticia, arg_min(titulo, fila) AS titulo, arg_min(tema, fila) AS tema FROM (SELECT id_noticia, fila, coalesce(titulo, '∅') AS titulo, coalesce(tema, '∅') AS tema FROM noticias) GROUP BY 1),
b AS (SELECT id_noticia, arg_max(titulo, fila) AS titulo, arg_max(tema, fila) AS tema FROM (SELECT id_noticia, fila, coalesce(titulo, '∅') AS titulo, coalesce(tema, '∅') AS tema FROM noticias) GROUP BY 1)
SELECT id_noticia, 'titulo' AS "column", a.titulo AS old, b.titulo AS new FROM a JOIN b USING (id_noticia) WHERE a.titulo IS DISTINCT FROM b.titulo
UNION ALL SELECT id_noticia, 'tema', a.tema, b.tema FROM a JOIN b USING (id_noticia) WHERE a.tema IS DISTINCT FROM b.tema""")
def changes(t: Tables) -> DataFrame:
    """Values that differ between the first and the last version of a record."""
    rows = t.noticias.select("id_noticia", "fila", *[F.coalesce(c, F.lit("∅")).alias(c) for c in ("titulo", "tema")])
    pick = lambda f: rows.groupBy("id_noticia").agg(f(F.struct("titulo", "tema"), "fila").alias("r")).select("id_noticia", "r.*")
    return ops.changed_values(pick(F.min_by), pick(F.max_by), ["id_noticia"], ["titulo", "tema"])


@query("j21_comparacion_externa", """
WITH a AS (SELECT tema, count(*) AS n FROM crudos_gdelt GROUP BY 1), b AS (SELECT tema, count(*) AS n FROM noticias GROUP BY 1)
SELECT coalesce(a.tema, b.tema) AS tema, coalesce(a.n, 0) AS izquierda, coalesce(b.n, 0) AS derecha FROM a FULL JOIN b ON a.tema = b.tema""")
def side_by_side(t: Tables) -> DataFrame:
    """Two sets of counts side by side, absent as 0."""
    a = t.crudos_gdelt.groupBy("tema").agg(F.count(F.lit(1)).alias("a"))
    b = t.noticias.groupBy("tema").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "tema", "full").select("tema", F.coalesce("a", F.lit(0)).alias("izquierda"), F.coalesce("b", F.lit(0)).alias("derecha"))


@query("j22_dos_rangos", """
WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS b FROM part)
SELECT p_partkey, a, b, a - b AS cambio, (a <= 50) AND NOT (b <= 50) AS sale, NOT (a <= 50) AND (b <= 50) AS entra FROM r""")
def two_rankings(t: Tables) -> DataFrame:
    """Places in two rankings, movement, and who enters or leaves the top."""
    rows = t.part.select("p_partkey", "p_retailprice", "p_size")
    r = places(places(rows, [-F.col("p_retailprice"), F.col("p_partkey")], "a"), [-F.col("p_size"), F.col("p_partkey")], "b")
    return r.select("p_partkey", "a", "b", (F.col("a") - F.col("b")).alias("cambio"), ((F.col("a") <= 50) & (F.col("b") > 50)).alias("sale"), ((F.col("a") > 50) & (F.col("b") <= 50)).alias("entra"))


# Windows, ranking, runs

@query("w01_posiciones", """
SELECT o_orderkey, row_number() OVER (ORDER BY round(o_totalprice / 1000, 1) DESC, round(epoch(o_orderdate), 9) DESC, o_orderkey) AS position, count(*) OVER (PARTITION BY round(o_totalprice / 1000, 1)) - 1 AS ties
FROM orders WHERE o_orderstatus = 'P'""")
def positions(t: Tables) -> DataFrame:
    """Contiguous places by shown score, second score and id, with the size of each tie."""
    rows = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("p"), F.unix_timestamp("o_orderdate").cast("double").alias("u"))
    return ops.rank_with_ties(rows, "p", "u", "o_orderkey").select("o_orderkey", "position", "ties")


@query("w03_empate_en_corte", """
WITH c AS (SELECT p_size AS value FROM part ORDER BY p_size DESC LIMIT 25), m AS (SELECT min(value) AS value FROM c)
SELECT value, (SELECT count(*) FROM part WHERE p_size = value) AS tied, (SELECT count(*) FROM c WHERE c.value = m.value) AS inside, (SELECT count(*) FROM part WHERE p_size = value) - (SELECT count(*) FROM c WHERE c.value = m.value) AS outside FROM m""")
def cut(t: Tables) -> DataFrame:
    """The tie at the cut of a top-k list."""
    return ops.tie_at_cut(t.part, "p_size", 25)


@query("w04_corte_anclado", """
WITH RECURSIVE d AS (SELECT DISTINCT user_id, ts::DATE AS dia FROM events), o AS (SELECT user_id, dia, row_number() OVER (PARTITION BY user_id ORDER BY dia) AS k FROM d),
r AS (SELECT user_id, dia, k, dia AS ancla, 1 AS parte FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.dia, o.k, CASE WHEN o.dia - r.ancla > 7 THEN o.dia ELSE r.ancla END, CASE WHEN o.dia - r.ancla > 7 THEN r.parte + 1 ELSE r.parte END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT e.event_id, r.parte AS part FROM events e JOIN r ON e.user_id = r.user_id AND e.ts::DATE = r.dia""")
def anchored(t: Tables) -> DataFrame:
    """Parts anchored at their first day, at most seven days long."""
    rows = t.events.withColumn("dia", F.to_date("ts").cast("timestamp"))
    return ops.anchored_split(rows, ["user_id"], "dia", "event_id", 7).select("event_id", "part")


@query("w06_rachas", """
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS dia FROM events), g AS (SELECT user_id, dia, dia - row_number() OVER (PARTITION BY user_id ORDER BY dia)::INT AS g FROM d)
SELECT user_id, min(dia) AS first, max(dia) AS last, count(*) AS days FROM g GROUP BY user_id, g""")
def islands(t: Tables) -> DataFrame:
    """Runs of consecutive days per user."""
    return ops.day_islands(t.events, ["user_id"], "ts")


@query("w07_primera_valida", "SELECT fila, coalesce(v AND fila > min(CASE WHEN v THEN fila END) OVER (PARTITION BY url), false) AS repeated FROM (SELECT fila, url, titulo IS NOT NULL AND medio IS NOT NULL AS v FROM noticias)")
def first_valid(t: Tables) -> DataFrame:
    """Valid rows whose key an earlier valid row has."""
    valid = F.col("titulo").isNotNull() & F.col("medio").isNotNull()
    return ops.first_valid(t.noticias.select("fila", "url", "titulo", "medio"), valid, ["url"], "fila").select("fila", "repeated")


@query("w08_estado_actual", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def current(t: Tables) -> DataFrame:
    """The last event of each user as its state."""
    return ops.latest_per_key(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("w11_bloques", """
WITH r AS (SELECT p_partkey, p_brand, p_retailprice, max(p_retailprice) OVER (PARTITION BY p_brand) AS tope, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part)
SELECT p_brand, p_partkey, tope, k FROM r WHERE k <= 3""")
def blocks(t: Tables) -> DataFrame:
    """The three best of each block, with the block's best."""
    w = Window.partitionBy("p_brand")
    ranked = t.part.withColumn("k", F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey"))).where("k <= 3")
    return ranked.withColumn("tope", F.max("p_retailprice").over(w)).select("p_brand", "p_partkey", "tope", "k")


@query("w12_fila_anterior", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS cambio FROM events")
def previous(t: Tables) -> DataFrame:
    """Change against the row before."""
    return t.events.select("event_id", F.round(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), 6).alias("cambio"))


@query("w14_rango_medio", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rango FROM part")
def mean_rank(t: Tables) -> DataFrame:
    """Fractional ranks."""
    return ops.average_rank(t.part, "p_size", "rango").select("p_partkey", "rango")


@query("w16_orden_ciego", "SELECT p_partkey, row_number() OVER (ORDER BY sha256('7|' || p_partkey)) AS orden FROM part")
def blind(t: Tables) -> DataFrame:
    """An order by salted hash that tells nothing."""
    return places(t.part.select("p_partkey"), [F.sha2(F.concat_ws("|", F.lit("7"), "p_partkey"), 256)], "orden")


# Top-k

@query("k01_mejores", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def best(t: Tables) -> DataFrame:
    """K1-K4: the twenty highest, ties by id (a top-k report)."""
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("k05_nulos_al_final", "SELECT fila, fecha_publicacion FROM noticias ORDER BY fecha_publicacion DESC NULLS LAST, fila LIMIT 30")
def nulls_last(t: Tables) -> DataFrame:
    """K2, K3, K5: the thirty newest, null dates last (a top-k report)."""
    return t.noticias.orderBy(F.col("fecha_publicacion").desc_nulls_last(), "fila").limit(30).select("fila", "fecha_publicacion")


@query("k06_orden_configurado", "SELECT l_orderkey, (list(l_returnflag ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 9 END, l_returnflag))[1] AS principal FROM lineitem GROUP BY 1")
def configured(t: Tables) -> DataFrame:
    """K6: first by a configured order, unknown values last."""
    order = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(9)
    return t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct(order.alias("o"), F.col("l_returnflag").alias("v")))["v"].alias("principal"))


# Sets

@query("u01_corpus", """
SELECT 'noticia' AS tipo, fila::VARCHAR AS id, titulo AS texto FROM noticias WHERE titulo IS NOT NULL UNION ALL SELECT 'documento', doc_id::VARCHAR, text FROM documents UNION ALL SELECT DISTINCT 'sismo', id_sismo, place FROM sismos""")
def corpus(t: Tables) -> DataFrame:
    """One corpus of three kinds of record."""
    news = t.noticias.where("titulo is not null").select(F.lit("noticia").alias("tipo"), F.col("fila").cast("string").alias("id"), F.col("titulo").alias("texto"))
    documents = t.documents.select(F.lit("documento").alias("tipo"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("texto"))
    return news.unionByName(documents).unionByName(t.sismos.select(F.lit("sismo").alias("tipo"), F.col("id_sismo").alias("id"), F.col("place").alias("texto")).distinct())


@query("u03_conjuntos", """
WITH a AS (SELECT DISTINCT medio FROM noticias WHERE origen = 'RSS'), b AS (SELECT DISTINCT medio FROM noticias WHERE tema = 'turismo')
SELECT 'ambos' AS lado, medio FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'solo_a', medio FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'solo_b', medio FROM (FROM b EXCEPT FROM a)""")
def sets(t: Tables) -> DataFrame:
    """Intersection and differences of two sets."""
    a, b = t.noticias.where("origen = 'RSS'").select("medio").distinct(), t.noticias.where("tema = 'turismo'").select("medio").distinct()
    parts = {"ambos": a.intersect(b), "solo_a": a.subtract(b), "solo_b": b.subtract(a)}
    rows = [d.select(F.lit(n).alias("lado"), "medio") for n, d in parts.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("u04_diferencia_multiconjunto", "SELECT o_orderstatus, o_orderpriority FROM orders EXCEPT ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice < 490000")
def multiset(t: Tables) -> DataFrame:
    """Difference that counts repeats."""
    pairs = t.orders.select("o_orderstatus", "o_orderpriority")
    return pairs.exceptAll(t.orders.where("o_totalprice < 490000").select("o_orderstatus", "o_orderpriority"))


@query("u06_distinto_ordenado", "SELECT url, min(fila) AS fila FROM noticias GROUP BY url")
def first_seen(t: Tables) -> DataFrame:
    """Distinct values with the place at which each is first seen."""
    return ops.ordered_distinct(t.noticias, "url", "fila")


@query("u07_esperado_menos_hallado", """
WITH e AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS x FROM orders GROUP BY 1), h AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT e.o_custkey, array_to_string(list_filter(x, lambda v: NOT list_contains(coalesce(y, []), v)), ',') AS faltan FROM e LEFT JOIN h USING (o_custkey)""")
def missing(t: Tables) -> DataFrame:
    """Expected minus found, as arrays."""
    found = F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_except(F.collect_set("o_orderpriority"), found)), ",").alias("faltan"))


@query("u08_versiones", """
WITH a AS (SELECT id_noticia, min(sha256(coalesce(titulo, ''))) AS h FROM noticias WHERE fecha_extraccion < '2026-07-20' GROUP BY 1), b AS (SELECT id_noticia, min(sha256(coalesce(titulo, ''))) AS h FROM noticias WHERE fecha_extraccion > '2026-07-10' GROUP BY 1)
SELECT id_noticia, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'missing' WHEN a.h <> b.h THEN 'changed' ELSE 'equal' END AS state FROM a FULL JOIN b USING (id_noticia)""")
def versions(t: Tables) -> DataFrame:
    """U8, L3, L4: new, missing and changed records between two versions of a table (the news before one date and after another)."""
    h = F.sha2(F.coalesce("titulo", F.lit("")), 256)
    pick = lambda c: t.noticias.where(c).groupBy("id_noticia").agg(F.min(h).alias("h"))
    return ops.version_diff(pick("fecha_extraccion < '2026-07-20'"), pick("fecha_extraccion > '2026-07-10'"), "id_noticia", "h")


QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
