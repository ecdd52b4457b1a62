"""Queries that compose other operators into reports and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.functions import stats, text
from telar.operators import vectors
from telar.plans.analytics import _CENTRES, _SHEET, _sheet
from telar.plans.registry import Registry, Tables
from telar.plans.scalars import alnum, bare

registry = Registry()
query = registry.query


@query("f16_clave_contenida", f"""
WITH k AS (SELECT DISTINCT medio, {alnum('titulo')} AS k FROM noticias WHERE titulo IS NOT NULL AND medio IS NOT NULL), l AS (SELECT * FROM k WHERE length(k) >= 25)
SELECT b.medio, b.k AS larga, min_by(a.k, (length(a.k), a.k)) AS base FROM l a JOIN l b ON a.medio = b.medio AND a.k[1:25] = b.k[1:25] AND length(a.k) < length(b.k) AND starts_with(b.k, a.k) GROUP BY 1, 2""")
def contained(t: Tables) -> DataFrame:
    """Headlines of an outlet that begin with a shorter one; joined on the outlet and the first letters."""
    keys = t.noticias.where("titulo is not null and medio is not null").select("medio", text.alnum_key(F.col("titulo")).alias("k")).distinct().where("length(k) >= 25")
    keys = keys.withColumn("head", F.substring("k", 1, 25))
    longer = keys.select("medio", "head", F.col("k").alias("larga"))
    pairs = keys.join(longer, ["medio", "head"]).where((F.length("k") < F.length("larga")) & F.startswith(F.col("larga"), F.col("k")))
    return pairs.groupBy("medio", "larga").agg(F.min_by("k", F.struct(F.length("k"), "k")).alias("base"))


# Fixed value: number words of the two most frequent languages.
_WORDS = {"un": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "half": 0.5, "medio": 0.5}
_LIST = ", ".join(f"('{w}', {float(v)})" for w, v in _WORDS.items())


@query("f42_numeros_en_palabras", f"""
WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace({bare('text')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) AS w FROM documents)
SELECT doc_id, count(*) AS n, sum(v) AS suma FROM w JOIN (VALUES {_LIST}) x(k, v) ON w = k GROUP BY doc_id""")
def number_words(t: Tables) -> DataFrame:
    """Number words of each document and their sum."""
    table = F.create_map(*[x for w, v in _WORDS.items() for x in (F.lit(w), F.lit(float(v)))])
    each = t.documents.select("doc_id", F.explode(F.split(text.spaced_key(F.col("text")), " ")).alias("w")).select("doc_id", F.try_element_at(table, F.col("w")).alias("v"))
    return each.where("v is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("suma"))


@query("f43_igualdad_decimal", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 0) = round(l_extendedprice * (1 - l_discount), 0) AS igual, abs(l_extendedprice - l_extendedprice * (1 - l_discount)) <= 0.05 * l_extendedprice + 1e-9 AS cerca FROM lineitem")
def equal_enough(t: Tables) -> DataFrame:
    """equality after rounding, and within a tolerance."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    near = F.abs(F.col("l_extendedprice") - net) <= F.col("l_extendedprice") * 0.05 + 1e-9
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.round("l_extendedprice", 0) == F.round(net, 0)).alias("igual"), near.alias("cerca"))


@query("f44_mcnemar", f"""
WITH s AS ({_SHEET}), m AS (SELECT mode(g) AS g FROM (SELECT g FROM s ORDER BY g)), d AS (SELECT count_if(s.g = t AND m.g <> t) AS b, count_if(s.g <> t AND m.g = t) AS c, count(*) AS n FROM s, m)
SELECT b, c, n FROM d""")
def discordant(t: Tables) -> DataFrame:
    """Rows on which only one of two methods is right (proposal against the commonest proposal)."""
    counts = _sheet(t).where("propuesta_tema is not null").groupBy("propuesta_tema").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("propuesta_tema").alias("g")))["g"].alias("comun"))
    a, b = F.col("propuesta_tema") == F.col("tema_humano"), F.col("comun") == F.col("tema_humano")
    return _sheet(t).crossJoin(F.broadcast(best)).agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count(F.lit(1)).alias("n"))


@query("f47_sin_campos", "SELECT event_id, json_object('k', CAST(json_extract(props, '$.k') AS BIGINT))::VARCHAR AS limpio FROM events")
def dropped(t: Tables) -> DataFrame:
    """a nested document without some of its fields."""
    nested = F.struct(F.from_json("props", "k bigint").alias("p"), F.col("ts"), F.col("user_id"))
    return t.events.select("event_id", nested.dropFields("ts", "user_id").alias("d")).select("event_id", F.to_json("d.p").alias("limpio"))


@query("k09_cola_de_duda", _CENTRES + """,
s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], c) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], c) DESC, c.label) AS k FROM embeddings, c)
SELECT vec_id, round(max(CASE WHEN k = 1 THEN s END) - max(CASE WHEN k = 2 THEN s END), 6) AS margen FROM s GROUP BY vec_id ORDER BY round(max(CASE WHEN k = 1 THEN s END) - max(CASE WHEN k = 2 THEN s END), 6), vec_id LIMIT 50""")
def doubtful(t: Tables) -> DataFrame:
    """The fifty vectors that are least sure of their label (a top-k report)."""
    centre = vectors.centroids(t.embeddings, ["label"], "embedding")
    scores = F.array_sort(F.transform("cs", lambda c: -stats.cosine(F.col("embedding"), c["centroid"])))
    margin = vectors.with_centroids(t.embeddings, centre, "label").select("vec_id", F.round(F.get(scores, F.lit(1)) - F.get(scores, F.lit(0)), 6).alias("margen"))
    return margin.orderBy("margen", "vec_id").limit(50)


@query("m16_reserva_de_entrenamiento", f"""
WITH e AS (SELECT DISTINCT {alnum('titulo')} AS k FROM hoja_preetiquetado WHERE titulo IS NOT NULL), p AS (SELECT fila, titulo, tema, {alnum('titulo')} AS k FROM noticias),
r AS (SELECT p.*, e.k IS NOT NULL AS evaluada, min(fila) OVER (PARTITION BY p.k) AS primera FROM p LEFT JOIN e ON p.k = e.k)
SELECT CASE WHEN titulo IS NULL THEN 'sin_titular' WHEN tema IS NULL THEN 'sin_tema' WHEN evaluada THEN 'en_evaluacion' WHEN fila > primera THEN 'repetida' ELSE 'usada' END AS motivo, count(*) AS n FROM r GROUP BY 1""")
def pool(t: Tables) -> DataFrame:
    """Rows for training, with the reason why each other row is left out."""
    key = text.alnum_key(F.col("titulo"))
    judged = t.hoja_preetiquetado.where("titulo is not null").select(key.alias("k")).distinct().withColumn("evaluada", F.lit(True))
    rows = t.noticias.select("fila", "titulo", "tema", key.alias("k"))
    firsts = rows.where("k is not null").groupBy("k").agg(F.min("fila").alias("primera"))
    reason = (
        F.when(F.col("titulo").isNull(), "sin_titular").when(F.col("tema").isNull(), "sin_tema").when(F.col("evaluada"), "en_evaluacion")
        .when(F.col("fila") > F.col("primera"), "repetida").otherwise("usada")
    )
    return rows.join(judged, "k", "left").join(firsts, "k", "left").groupBy(reason.alias("motivo")).agg(F.count(F.lit(1)).alias("n"))


@query("w09_siguiente_version", "SELECT id_noticia, count(*) + 1 AS siguiente, max(fila) AS ultima FROM noticias GROUP BY id_noticia")
def next_version(t: Tables) -> DataFrame:
    """Next version number of each record."""
    return t.noticias.groupBy("id_noticia").agg((F.count(F.lit(1)) + 1).alias("siguiente"), F.max("fila").alias("ultima"))


@query("e14_por_mitades", f"""
WITH s AS (SELECT g, t, CAST(('0x' || substr(sha1(id_noticia), 1, 8))::BIGINT % 2 AS INTEGER) AS mitad FROM ({_SHEET}) WHERE g IS NOT NULL)
SELECT coalesce(mitad::VARCHAR, 'todas') AS mitad, count_if(g = 'sin_tema' AND t = 'sin_tema') AS calla_bien, count_if(g = 'sin_tema' AND t <> 'sin_tema') AS calla_mal, count_if(g <> 'sin_tema' AND t = 'sin_tema') AS habla_mal, count(*) AS n FROM s GROUP BY GROUPING SETS ((mitad), ())""")
def halves(t: Tables) -> DataFrame:
    """Abstention right and wrong, by stable halves and over all."""
    from telar.functions.urls import fold

    rows = _sheet(t).where("propuesta_tema is not null").withColumn("mitad", fold(F.col("id_noticia"), 2))
    g, h = F.col("propuesta_tema") == "sin_tema", F.col("tema_humano") == "sin_tema"
    sets = rows.groupingSets([["mitad"], []], "mitad").agg(F.count_if(g & h).alias("calla_bien"), F.count_if(g & ~h).alias("calla_mal"), F.count_if(~g & h).alias("habla_mal"), F.count(F.lit(1)).alias("n"))
    return sets.withColumn("mitad", F.coalesce(F.col("mitad").cast("string"), F.lit("todas")))


@query("z033_reparto_de_temas", """
WITH s AS (SELECT coalesce(propuesta_tema, 'ninguno') AS propuesta_tema, tema_humano IS NOT DISTINCT FROM propuesta_tema AS igual, length(titulo) AS l FROM hoja_preetiquetado)
SELECT propuesta_tema, count(*) AS n, round(count(*) / (SELECT count(*) FROM s)::DOUBLE, 9) AS cuota, count_if(igual) AS iguales, min(l) AS minimo, quantile_cont(l, 0.5) AS mediana, max(l) AS maximo FROM s GROUP BY propuesta_tema""")
def distribution(t: Tables) -> DataFrame:
    """Share, agreement and spread of each subject."""
    rows = t.hoja_preetiquetado
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    same, size = F.col("tema_humano").eqNullSafe(F.col("propuesta_tema")), F.length("titulo")
    by = rows.groupBy(F.coalesce("propuesta_tema", F.lit("ninguno")).alias("propuesta_tema")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("iguales"), F.min(size).alias("minimo"), F.percentile(size, F.lit(0.5)).alias("mediana"), F.max(size).alias("maximo")
    )
    return by.crossJoin(F.broadcast(total)).select("propuesta_tema", "n", F.round(F.col("n") / F.col("total"), 9).alias("cuota"), "iguales", "minimo", "mediana", "maximo")


@query("z026_estimacion_de_terminos", f"""
WITH d AS (SELECT DISTINCT {alnum('titulo')} AS k, {bare('titulo')} AS b FROM noticias WHERE titulo IS NOT NULL), u AS (SELECT k, min(b) AS b FROM d GROUP BY k)
SELECT termino, count_if(contains(b, termino)) AS aciertos, count(*) AS titulares, round(count_if(contains(b, termino)) / count(*)::DOUBLE, 9) AS cuota FROM u, (VALUES ('agua'), ('peaje'), ('crucero'), ('nada')) v(termino) GROUP BY termino""")
def term_hits(t: Tables) -> DataFrame:
    """Share of different headlines that a search term would hit."""
    b, terms = text.bare(F.col("titulo")), ["agua", "peaje", "crucero", "nada"]
    heads = t.noticias.where("titulo is not null").select(text.alnum_key(F.col("titulo")).alias("k"), b.alias("b")).groupBy("k").agg(F.min("b").alias("b"))
    facts = heads.agg(F.count(F.lit(1)).alias("titulares"), *[F.count_if(F.contains(F.col("b"), F.lit(w))).alias(w) for w in terms])
    rows = facts.select("titulares", F.explode(F.array(*[F.struct(F.lit(w).alias("termino"), F.col(w).alias("aciertos")) for w in terms])).alias("r"))
    return rows.select("r.termino", "r.aciertos", "titulares", F.round(F.col("r.aciertos") / F.col("titulares"), 9).alias("cuota"))


@query("z041_par_sin_orden", """
WITH p AS (SELECT DISTINCT least(a.medio, b.medio) AS x, greatest(a.medio, b.medio) AS y, a.zona FROM noticias a JOIN noticias b ON a.zona = b.zona AND a.medio <> b.medio) SELECT x, y, count(*) AS zonas FROM p GROUP BY x, y""")
def pairs(t: Tables) -> DataFrame:
    """Outlets that report on the same zones, each pair once whatever its order, by outlet and not by news row."""
    seen = t.noticias.where("zona is not null and medio is not null").select("zona", "medio").distinct()
    other = seen.select("zona", F.col("medio").alias("y"))
    return seen.withColumnRenamed("medio", "x").join(other, "zona").where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("zonas"))


@query("z052_frases_comunes", """
WITH f AS (SELECT source, doc_id, unnest(list_distinct(string_split(text, '. '))) AS f FROM documents WHERE source IS NOT NULL), c AS (SELECT source, f, count(DISTINCT doc_id) AS n FROM f WHERE length(f) >= 20 GROUP BY 1, 2)
SELECT source, count(*) AS frases, max(n) AS mas_repetida FROM c WHERE n > 1 GROUP BY source""")
def common_sentences(t: Tables) -> DataFrame:
    """Sentences that several documents of a source share."""
    each = t.documents.where("source is not null").select("source", "doc_id", F.explode(F.array_distinct(F.split("text", r"\. "))).alias("f")).where("length(f) >= 20")
    shared = each.groupBy("source", "f").agg(F.countDistinct("doc_id").alias("n")).where("n > 1")
    return shared.groupBy("source").agg(F.count(F.lit(1)).alias("frases"), F.max("n").alias("mas_repetida"))


QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
