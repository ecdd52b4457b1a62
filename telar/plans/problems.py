"""Queries of the general data problems (2 and 6) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.operators.intervals import coverage_report, merge_intervals
from telar.operators.row_recovery import load_lines
from telar.session import table


def _utc(column: str):
    """yyyyMMddHHmmss in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.col(column), F.current_timezone()), "yyyyMMddHHmmss")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered periods and gaps of the search responses of each (tema, pata)."""
    rows = table(spark, sf_dir, "crudos_gdelt").where("clase = 'ok'")
    merged = merge_intervals(rows, ["tema", "pata"], "ini", "fin")
    return merged.select(
        "tema", F.coalesce("pata", F.lit("")).alias("pata"),
        F.when(F.col("kind") == "period", "periodo").otherwise("hueco").alias("tipo"),
        _utc("start").alias("ini"), _utc("end").alias("fin"),
    ).distinct()


def p2_cobertura(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage figures of each (tema, pata)."""
    rows = table(spark, sf_dir, "crudos_gdelt").where("clase = 'ok'")
    return coverage_report(rows, ["tema", "pata"], "ini", "fin").withColumn("pata", F.coalesce("pata", F.lit("")))


_P2_PERIODS = """
WITH r AS (SELECT tema, pata, ini, fin FROM crudos_gdelt WHERE clase = 'ok' AND ini IS NOT NULL AND fin IS NOT NULL AND fin > ini),
b AS (SELECT *, max(fin) OVER (PARTITION BY tema, pata ORDER BY ini, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ini > prev THEN 1 ELSE 0 END)
        OVER (PARTITION BY tema, pata ORDER BY ini, fin ROWS UNBOUNDED PRECEDING) AS k FROM b),
p AS (SELECT tema, pata, k, min(ini) AS ini, max(fin) AS fin FROM g GROUP BY tema, pata, k),
h AS (SELECT *, lag(fin) OVER (PARTITION BY tema, pata ORDER BY k) AS antes FROM p)
"""

ORACLE = {
    "p2_found": _P2_PERIODS + """
SELECT DISTINCT tema, coalesce(pata, '') AS pata, tipo, strftime(a AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS ini, strftime(z AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS fin
FROM (SELECT tema, pata, 'periodo' AS tipo, ini AS a, fin AS z FROM h
      UNION ALL SELECT tema, pata, 'hueco', antes, ini FROM h WHERE antes IS NOT NULL)
""",
    "p2_cobertura": _P2_PERIODS + """
SELECT tema, coalesce(pata, '') AS pata, count(*) AS n_periods, count(antes) AS n_gaps,
       sum(epoch_us(fin) - epoch_us(ini)) / 1000000.0 AS covered_s,
       coalesce(sum(epoch_us(ini) - epoch_us(antes)) / 1000000.0, 0.0) AS gap_s,
       coalesce(max(epoch_us(ini) - epoch_us(antes)) / 1000000.0, 0.0) AS longest_gap_s
FROM h GROUP BY tema, pata
""",
}


_FIELD = '("([^"]|"")*"|[^",]*)'
_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(8195) || chr(8239) || chr(12288)"
_P6 = """
WITH l AS (SELECT id_linea, contrato, archivo, fila, linea, regexp_replace(linea, '\\r$', '') AS t FROM filas_crudas),
s AS (SELECT *, CASE contrato WHEN 'noticias' THEN 11 ELSE 9 END AS ancho,
        coalesce(regexp_full_match(t, '(?s)FIELD(,FIELD)*'), false) AS bien FROM l),
x AS (SELECT *, CASE WHEN bien THEN list_transform(regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
        lambda v: nullif(trim(CASE WHEN v LIKE '"%' THEN replace(v[2:-2], '""', '"') ELSE v END, BLANK), '')) END AS f FROM s),
a AS (SELECT *, coalesce(len(f) <> ancho, true) AS rota FROM x),
n AS (SELECT *, contrato = 'noticias' AS es FROM a WHERE NOT rota),
c AS (SELECT *,
  CASE WHEN es THEN f[1] IS NULL OR f[2] IS NULL OR f[3] IS NULL OR f[4] IS NULL OR (f[6] IS NULL AND f[7] IS NULL)
       ELSE f[2] IS NULL OR f[3] IS NULL OR f[4] IS NULL OR f[6] IS NULL OR f[7] IS NULL OR f[8] IS NULL OR f[9] IS NULL END AS e1,
  coalesce(NOT CASE WHEN es THEN regexp_full_match(f[1], 'NOT-[0-9a-f]{10}|SYN-[A-Z0-9]+-[0-9]+') ELSE regexp_full_match(f[1], 'IND-[A-Z]{3}-[A-Za-z0-9._]+-[0-9]{4}') END, false) AS e2,
  coalesce(NOT regexp_full_match(CASE WHEN es THEN f[3] ELSE f[7] END, 'https?://[^\\s/?#]+([/?#]\\S*)?'), false) AS e3,
  len(list_filter(CASE WHEN es THEN [f[6], f[7], f[8]] ELSE [f[8]] END, lambda d: d IS NOT NULL AND NOT (regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z') AND d NOT LIKE '0000%' AND d[18:19] < '60' AND d[12:13] < '24' AND try_strptime(d, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL))) > 0 AS e4,
  NOT es AND (coalesce(NOT regexp_full_match(f[2], '[A-Z]{3}'), false) OR coalesce(NOT (regexp_full_match(f[4], '[0-9]{4}') AND f[4] BETWEEN '1960' AND '2100'), false)
    OR coalesce(NOT regexp_full_match(f[5], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'), false)) AS e5 FROM n),
ok AS (SELECT *, CASE WHEN es THEN [f[1]] ELSE [f[2], f[3], f[4]] END AS k FROM c WHERE NOT (e1 OR e2 OR e3 OR e4 OR e5)),
d AS (SELECT *, min(fila) OVER (PARTITION BY contrato, archivo, k) < fila AS dup FROM ok)
""".replace("FIELD", _FIELD).replace("BLANK", _BLANK)

ORACLE["p6_found"] = _P6 + """
SELECT DISTINCT id_linea, tipo_error FROM (
  SELECT id_linea, 'estructura_invalida' AS tipo_error FROM a WHERE rota
  UNION ALL SELECT id_linea, 'obligatorio_vacio' FROM c WHERE e1 UNION ALL SELECT id_linea, 'id_formato_invalido' FROM c WHERE e2
  UNION ALL SELECT id_linea, 'url_mal_formada' FROM c WHERE e3 UNION ALL SELECT id_linea, 'fecha_invalida' FROM c WHERE e4
  UNION ALL SELECT id_linea, 'valor_invalido' FROM c WHERE e5 UNION ALL SELECT id_linea, 'id_duplicado' FROM d WHERE dup)
"""
_P6_COLUMNS = {
    "es": "id_noticia titulo url medio idioma fecha_publicacion fecha_deteccion fecha_extraccion tema origen alcance_texto".split(),
    "NOT es": "id_indicador pais_iso3 indicador_id anio valor unidad fuente_url fecha_extraccion licencia".split(),
}
_WRONG_DATE = "(f[{i}] IS NOT NULL AND NOT (regexp_full_match(f[{i}], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z') AND f[{i}] NOT LIKE '0000%' AND f[{i}][18:19] < '60' AND f[{i}][12:13] < '24' AND try_strptime(f[{i}], '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL))"


def _motives(test: str, *columns: str) -> str:
    """SQL for the names, in order, of the columns for which a test (of ``f[i]``) holds, by contract."""
    each = [f"CASE WHEN {which} AND {test.format(i=names.index(c) + 1)} THEN '{c}' END" for which, names in _P6_COLUMNS.items() for c in columns if c in names]
    return f"concat_ws(', ', {', '.join(each)})"


ORACLE["p6_errores"] = _P6 + f""",
r AS (SELECT *, regexp_extract(t, '(?s)^((?:{_FIELD},)*)', 1) AS antes FROM a WHERE rota),
o AS (SELECT *, t[length(antes) + 1:] AS resto FROM r),
m AS (SELECT id_linea, archivo, fila, 'estructura_invalida' AS tipo_error, CASE
    WHEN linea IS NULL THEN 'línea nula en el carácter 1'
    WHEN contrato IS NULL OR contrato NOT IN ('noticias', 'indicadores') THEN 'contrato desconocido'
    WHEN bien THEN len(f) || ' campos en vez de ' || ancho
    WHEN resto NOT LIKE '"%' THEN 'comillas dentro de un campo sin comillas en el carácter ' || (length(antes) + instr(resto, '"'))
    WHEN regexp_full_match(resto, '(?s)"([^"]|"")*') THEN 'comillas sin cerrar en el carácter ' || (length(antes) + 1)
    ELSE 'texto tras las comillas de cierre en el carácter ' || (length(antes) + length(regexp_extract(resto, '(?s)^"([^"]|"")*"')) + 1) END AS motivo
  FROM o),
q AS (SELECT * FROM m
  UNION ALL SELECT id_linea, archivo, fila, 'obligatorio_vacio', concat_ws(', ', nullif({_motives("f[{i}] IS NULL", "id_noticia", "titulo", "url", "medio", "pais_iso3", "indicador_id", "anio", "unidad", "fuente_url")}, ''),
      CASE WHEN NOT es AND f[8] IS NULL THEN 'fecha_extraccion' END, CASE WHEN NOT es AND f[9] IS NULL THEN 'licencia' END,
      CASE WHEN es AND f[6] IS NULL AND f[7] IS NULL THEN 'fecha_publicacion y fecha_deteccion' END) FROM c WHERE e1
  UNION ALL SELECT id_linea, archivo, fila, 'id_formato_invalido', CASE WHEN es THEN 'id_noticia' ELSE 'id_indicador' END FROM c WHERE e2
  UNION ALL SELECT id_linea, archivo, fila, 'url_mal_formada', CASE WHEN es THEN 'url' ELSE 'fuente_url' END FROM c WHERE e3
  UNION ALL SELECT id_linea, archivo, fila, 'fecha_invalida', {_motives(_WRONG_DATE, "fecha_publicacion", "fecha_deteccion", "fecha_extraccion")} FROM c WHERE e4
  UNION ALL SELECT id_linea, archivo, fila, 'valor_invalido', concat_ws(', ', CASE WHEN NOT regexp_full_match(f[2], '[A-Z]{{3}}') THEN 'pais_iso3' END,
      CASE WHEN NOT regexp_full_match(f[5], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'valor' END, CASE WHEN NOT (regexp_full_match(f[4], '[0-9]{{4}}') AND f[4] BETWEEN '1960' AND '2100') THEN 'anio' END) FROM c WHERE e5
  UNION ALL SELECT id_linea, archivo, fila, 'id_duplicado', 'ya está en la fila ' || primera FROM (SELECT *, min(fila) OVER (PARTITION BY contrato, archivo, k) AS primera FROM ok) WHERE primera < fila)
SELECT * FROM q
"""
ORACLE["p6_validas_indicadores"] = _P6 + """
SELECT id_linea, archivo, fila, f[1] AS id_indicador, f[2] AS pais_iso3, f[3] AS indicador_id, CAST(f[4] AS INTEGER) AS anio, CAST(f[5] AS DOUBLE) AS valor,
  f[6] AS unidad, f[7] AS fuente_url, CAST(f[8] AS TIMESTAMPTZ) AS fecha_extraccion, f[9] AS licencia FROM d WHERE NOT dup AND NOT es
"""
ORACLE["p6_validas_noticias"] = _P6 + """
SELECT id_linea, archivo, fila, f[1] AS id_noticia, f[2] AS titulo, f[3] AS url, f[4] AS medio, f[5] AS idioma, CAST(f[6] AS TIMESTAMPTZ) AS fecha_publicacion,
  CAST(f[7] AS TIMESTAMPTZ) AS fecha_deteccion, CAST(f[8] AS TIMESTAMPTZ) AS fecha_extraccion, f[9] AS tema, f[10] AS origen, f[11] AS alcance_texto FROM d WHERE NOT dup AND es
"""


def _lines(spark: SparkSession, sf_dir: str):
    return load_lines(table(spark, sf_dir, "filas_crudas"), "id_linea", "contrato", "archivo", "fila", "linea")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrong lines with their kinds of error."""
    return _lines(spark, sf_dir).errors.select(F.col("id").alias("id_linea"), "tipo_error").distinct()


def p6_errores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrong lines with file, position, kind and motive."""
    return _lines(spark, sf_dir).errors.select(F.col("id").alias("id_linea"), F.col("file").alias("archivo"), F.col("position").alias("fila"), "tipo_error", "motivo")


def p6_validas_noticias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news lines that load, typed."""
    return _lines(spark, sf_dir).valid("noticias")


def p6_validas_indicadores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicator lines that load, typed."""
    return _lines(spark, sf_dir).valid("indicadores")


def q04_dato_oficial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value of each country and indicator, the year before's, and how many years are null."""
    rows = _lines(spark, sf_dir).valid("indicadores")
    years = rows.groupBy("pais_iso3", "indicador_id", "anio").agg(F.min("valor").alias("valor"))
    last = years.groupBy("pais_iso3", "indicador_id").agg(
        F.max(F.when(F.col("valor").isNotNull(), F.struct("anio", "valor"))).alias("u"), F.count_if(F.col("valor").isNull()).alias("nulos"), F.count(F.lit(1)).alias("anios")
    )
    before = years.select("pais_iso3", "indicador_id", (F.col("anio") + 1).alias("a"), F.col("valor").alias("anterior"))
    found = last.select("pais_iso3", "indicador_id", F.col("u.anio").alias("anio"), F.col("u.valor").alias("valor"), "nulos", "anios")
    joined = found.join(before.withColumnRenamed("a", "anio"), ["pais_iso3", "indicador_id", "anio"], "left")
    return joined.select("pais_iso3", "indicador_id", "anio", "valor", "anterior", "nulos", "anios")


ORACLE["q04_dato_oficial"] = _P6 + """,
y AS (SELECT f[2] AS pais_iso3, f[3] AS indicador_id, CAST(f[4] AS INTEGER) AS anio, min(CAST(f[5] AS DOUBLE)) AS valor FROM d WHERE NOT dup AND NOT es GROUP BY 1, 2, 3),
u AS (SELECT pais_iso3, indicador_id, max(anio) FILTER (WHERE valor IS NOT NULL) AS anio, arg_max(valor, anio) FILTER (WHERE valor IS NOT NULL) AS valor, coalesce(count_if(valor IS NULL), 0) AS nulos, count(*) AS anios FROM y GROUP BY 1, 2)
SELECT u.pais_iso3, u.indicador_id, u.anio, u.valor, b.valor AS anterior, nulos, anios FROM u LEFT JOIN y b ON b.pais_iso3 = u.pais_iso3 AND b.indicador_id = u.indicador_id AND b.anio = u.anio - 1
"""

QUERIES = {
    "q04_dato_oficial": q04_dato_oficial,
    "p2_found": p2_found, "p2_cobertura": p2_cobertura, "p6_found": p6_found, "p6_errores": p6_errores,
    "p6_validas_noticias": p6_validas_noticias, "p6_validas_indicadores": p6_validas_indicadores,
}
