"""Queries over vectors, clusters, graphs, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telar.functions import stats, text, urls
from telar.operators import metrics, retrieval, tables, vectors
from telar.plans.registry import Registry, Tables
from telar.plans.scalars import bare, spaced

registry = Registry()
query = registry.query

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("m01_norma", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / greatest(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 1e-30), 6) AS norma, round((embedding[1]::DOUBLE) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS primero FROM embeddings")
def norm(t: Tables) -> DataFrame:
    """M1: vectors of length 1."""
    u = t.embeddings.select("vec_id", stats.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(stats.dot(F.col("u"), F.col("u")), 6).alias("norma"), F.round(F.get("u", F.lit(0)), 6).alias("primero"))


@query("m03_vecinos", f"""
SELECT a.vec_id AS query, b.vec_id AS id, round({_COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a, embeddings b QUALIFY rank <= 5""")
def neighbours(t: Tables) -> DataFrame:
    """M3, Q1, K1: the five nearest of every vector whose id is divisible by 20, searched among all rows."""
    found = vectors.nearest(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 5)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


_CENTRES = """WITH p AS (SELECT label, j, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM embeddings) GROUP BY label, j),
c AS (SELECT label, list(x ORDER BY j) AS c FROM p GROUP BY label)"""


@query("m04_centroides", _CENTRES + " SELECT label, round(c[1] / sqrt(list_dot_product(c, c)), 6) AS c1, round(c[64] / sqrt(list_dot_product(c, c)), 6) AS c64 FROM c")
def centres(t: Tables) -> DataFrame:
    """Mean vector of each label, of length 1."""
    c = vectors.centroids(t.embeddings, ["label"], "embedding")
    return c.select("label", F.round(F.get("centroid", F.lit(0)), 6).alias("c1"), F.round(F.get("centroid", F.lit(63)), 6).alias("c64"))


@query("m05_decision", _CENTRES + """,
s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], c) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], c) DESC, c.label) AS k FROM embeddings, c)
SELECT vec_id, CASE WHEN max(CASE WHEN k = 1 THEN s END) >= 0.3 THEN max(CASE WHEN k = 1 THEN label END) END AS elegido,
  CASE WHEN max(CASE WHEN k = 2 THEN s END) >= 0.3 AND max(CASE WHEN k = 1 THEN s END) - max(CASE WHEN k = 2 THEN s END) <= 0.1 THEN max(CASE WHEN k = 2 THEN label END) END AS segundo FROM s GROUP BY vec_id""")
def decide(t: Tables) -> DataFrame:
    """M5: most similar label, none under a threshold, and a second within a margin; the centroids are as many as labels."""
    centre = vectors.centroids(t.embeddings, ["label"], "embedding")
    scored = vectors.with_centroids(t.embeddings, centre, "label").select("vec_id", F.array_sort(F.transform("cs", lambda c: F.struct((-stats.cosine(F.col("embedding"), c["centroid"])).alias("s"), c["label"].alias("label")))).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    near = (-second["s"] >= 0.3) & (second["s"] - first["s"] <= 0.1)
    return scored.select("vec_id", F.when(-first["s"] >= 0.3, first["label"]).alias("elegido"), F.when(near, second["label"]).alias("segundo"))


@query("a16_medoide", """
WITH s AS (SELECT a.label, a.vec_id, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY 1, 2),
m AS (SELECT label, max(s) AS top FROM s GROUP BY label) SELECT s.label, min(vec_id) AS vec_id FROM s JOIN m ON s.label = m.label AND s >= top - 1e-9 GROUP BY s.label""")
def medoids(t: Tables) -> DataFrame:
    """Most typical vector of each label, without forming pairs."""
    return vectors.medoid(t.embeddings, ["label"], "vec_id", "embedding")


_GRAPH = f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} > 0.42"


@query("m15_aristas", _GRAPH)
def edges(t: Tables) -> DataFrame:
    """Pairs of vectors above a similarity, by products of blocks."""
    return vectors.similar_edges(t.embeddings, "vec_id", "embedding", 0.42).select("a", "b")


@query("m13_componentes", f"""
WITH RECURSIVE g AS MATERIALIZED ({_GRAPH}), e AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
r AS (SELECT vec_id AS id, vec_id AS x FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a)
SELECT id AS vec_id, min(x) AS component FROM r GROUP BY id""")
def parts(t: Tables) -> DataFrame:
    """Connected components of the similarity graph."""
    return vectors.components(vectors.similar_edges(t.embeddings, "vec_id", "embedding", 0.42), t.embeddings, "vec_id")


@query("m09_enlace_medio")
def linkage(t: Tables) -> DataFrame:
    """Average-linkage clusters, exact within similarity components."""
    return vectors.average_linkage(t.embeddings, "vec_id", "embedding", 0.6)


@query("x02_codificador", f"SELECT doc_id, len(list_filter(string_split({spaced('text')}, ' '), lambda w: length(w) >= 2)) AS palabras FROM documents")
def encoder(t: Tables) -> DataFrame:
    """The hashed bag of words; its sum is the number of words of a text."""
    w = text.words(F.col("text"))
    bag = vectors.hashed_words(w, 64)
    return t.documents.select("doc_id", F.aggregate(bag, F.lit(0.0), lambda s, x: s + x).cast("long").alias("palabras"))


_ASKED = [("q1", "corte de agua para familias"), ("q2", "incendio forestal hectáreas"), ("q3", "cruise ship visitors")]
_VALUES = ", ".join(f"('{q}', '{t}')" for q, t in _ASKED)


@query("q02_bm25", f"""
WITH c AS (SELECT fila, list_filter(string_split({spaced('titulo')}, ' '), lambda w: length(w) >= 2) AS ws FROM noticias WHERE titulo IS NOT NULL),
f AS (SELECT count(*) AS n, avg(len(ws)) AS media FROM c), q AS (SELECT DISTINCT query, unnest(string_split({spaced('t')}, ' ')) AS w FROM (VALUES {_VALUES}) v(query, t)),
tf AS (SELECT fila, len(ws) AS l, w, count(*) AS tf FROM (SELECT fila, ws, unnest(ws) AS w FROM c) WHERE w IN (SELECT w FROM q) GROUP BY 1, 2, 3),
d AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
s AS (SELECT q.query, fila AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / media))) AS score FROM tf JOIN d USING (w) JOIN q USING (w), f GROUP BY 1, 2)
SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def bm25(t: Tables) -> DataFrame:
    """Q2: the ten best headlines for three questions (a top-k report)."""
    corpus = t.noticias.where("titulo is not null").select(F.col("fila").alias("id"), text.words(F.col("titulo")).alias("ws"))
    asked = t.spark.createDataFrame(_ASKED, "query string, t string").select("query", text.words(F.col("t")).alias("words"))
    return retrieval.bm25(corpus, asked, "id", "ws", "query", 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("q03_reglas_en_orden", f"""
SELECT regla, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, 'ignora|instruccion') THEN 'inyeccion' WHEN regexp_matches(t, 'sismo') AND regexp_matches(t, 'comunidades') THEN 'sismo' WHEN regexp_matches(t, 'agua') THEN 'agua' WHEN regexp_matches(t, 'familias') THEN 'familias' ELSE 'ninguna' END AS regla FROM (SELECT {bare('titulo')} AS t FROM noticias)) GROUP BY regla""")
def ordered_rules(t: Tables) -> DataFrame:
    """Q3: ordered rules, some of two patterns; the first that holds decides."""
    b = text.bare(F.col("titulo"))
    rule = (
        F.when(b.rlike("ignora|instruccion"), "inyeccion").when(b.rlike("sismo") & b.rlike("comunidades"), "sismo")
        .when(b.rlike("agua"), "agua").when(b.rlike("familias"), "familias").otherwise("ninguna")
    )
    return t.noticias.select(rule.alias("regla")).groupBy("regla").agg(F.count(F.lit(1)).alias("n"))


# Evaluation

_SHEET = "SELECT propuesta_tema AS g, tema_humano AS t, id_grupo, grupo, id_noticia, etiquetado_por FROM hoja_preetiquetado WHERE tema_humano IN (SELECT tema FROM temas)"


def _sheet(t: Tables) -> DataFrame:
    return t.hoja_preetiquetado.join(t.temas, F.col("tema_humano") == F.col("tema"), "left_semi")


@query("e01_confusion", f"SELECT t AS tema_humano, " + ", ".join(f"count(*) FILTER (WHERE g = '{c}') AS {c}" for c in ("economia", "turismo", "regulacion", "logistica")) + f" FROM ({_SHEET}) GROUP BY t")
def confusion(t: Tables) -> DataFrame:
    """Confusion matrix of proposed and human subject."""
    return _sheet(t).groupBy("tema_humano").pivot("propuesta_tema", ["economia", "turismo", "regulacion", "logistica"]).agg(F.count(F.lit(1))).fillna(0)


@query("e01_matriz", f"SELECT t AS tema_humano, g AS propuesta_tema, count(*) AS n FROM ({_SHEET}) GROUP BY t, g")
def whole_confusion(t: Tables) -> DataFrame:
    """The whole confusion matrix in long form, every proposed subject and null included; ``e01_confusion`` has four columns of it."""
    return _sheet(t).groupBy("tema_humano", "propuesta_tema").agg(F.count(F.lit(1)).alias("n"))


_CLASS = f"""WITH s AS ({_SHEET}), k AS (SELECT tema AS cls, count_if(t = tema AND g = tema) AS tp, count_if(t <> tema AND g = tema) AS fp, count_if(t = tema AND g <> tema) AS fn FROM temas, s GROUP BY tema)"""


@query("e02_por_clase", _CLASS + " SELECT cls, tp, fp, fn, round(tp / nullif((tp + fp)::DOUBLE, 0), 9) AS precision, round(tp / nullif((tp + fn)::DOUBLE, 0), 9) AS recall, round(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0), 9) AS f1 FROM k WHERE tp + fp + fn > 0")
def classes(t: Tables) -> DataFrame:
    """Precision, recall and F1 of each subject."""
    return metrics.per_class(_sheet(t), "tema_humano", "propuesta_tema").select("cls", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("e03_macro_f1", _CLASS + " SELECT round(avg(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0)), 9) AS macro_f1, count(*) AS n_classes FROM k WHERE tp + fn > 0")
def macro(t: Tables) -> DataFrame:
    """Macro F1."""
    return metrics.macro_f1(metrics.per_class(_sheet(t), "tema_humano", "propuesta_tema")).withColumn("macro_f1", F.round("macro_f1", 9))


@query("e04_remuestreo")
def bootstrap(t: Tables) -> DataFrame:
    """E5: share of proposals that are right, with bootstrap and Wilson intervals and whether it is degenerate."""
    rows = _sheet(t).withColumn("id", F.concat_ws("|", "id_noticia", "etiquetado_por", "fecha_etiquetado"))
    return metrics.proportion(rows, "id", F.col("tema_humano") == F.col("propuesta_tema"))


@query("e06_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentiles(t: Tables) -> DataFrame:
    """Exact interpolated percentiles."""
    return tables.percentiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("e08_recuerdo", f"""
WITH f AS (SELECT a.vec_id AS q, a.label, b.label AS l, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS k FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT count(DISTINCT q) AS consultas, round(avg((l = label)::INT), 9) AS precision_5 FROM f WHERE k <= 5""")
def recall(t: Tables) -> DataFrame:
    """Share of the five nearest other vectors that have the label of the query."""
    found = vectors.nearest(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 6).where("query <> id")
    five = found.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where("k <= 5")
    a, b = t.embeddings.select(F.col("vec_id").alias("query"), F.col("label").alias("x")), t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("y"))
    return five.join(a, "query").join(b, "id").agg(F.countDistinct("query").alias("consultas"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 9).alias("precision_5"))


@query("e09_pares", """
WITH s AS (SELECT id_grupo, lower(trim(grupo)) AS g FROM hoja_preetiquetado WHERE id_grupo IS NOT NULL AND grupo IS NOT NULL),
n AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM s GROUP BY g, id_grupo)) AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM s GROUP BY g)) AS t, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM s GROUP BY id_grupo)) AS p)
SELECT tp, p - tp AS fp, t - tp AS fn, round(tp / p, 9) AS precision, round(tp / t, 9) AS recall, round(2 * tp / (p + t), 9) AS f1 FROM n""")
def pair_scores(t: Tables) -> DataFrame:
    """Pair metrics of the pipeline's groups against the human ones, in closed form."""
    rows = t.hoja_preetiquetado.withColumn("g", F.lower(F.trim("grupo")))
    return metrics.pair_metrics(rows, "g", "id_grupo").select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("e16_kappa", f"""
WITH s AS ({_SHEET}), n AS (SELECT count(*) AS n, count_if(t = g) AS same FROM s WHERE g IS NOT NULL), e AS (SELECT sum(x * y) AS xy FROM (SELECT t, count(*) AS x FROM s WHERE g IS NOT NULL GROUP BY t) JOIN (SELECT g, count(*) AS y FROM s WHERE g IS NOT NULL GROUP BY g) ON t = g)
SELECT n, round(same / n, 9) AS observed, round(xy / (n::DOUBLE * n), 9) AS expected, round((same / n - xy / (n::DOUBLE * n)) / (1 - xy / (n::DOUBLE * n)), 9) AS kappa FROM n, e""")
def agreement(t: Tables) -> DataFrame:
    """Cohen's kappa of proposal and human label."""
    return metrics.kappa(_sheet(t), "tema_humano", "propuesta_tema").select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


@query("e17_muestra_estratificada", """
WITH s AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber AS id FROM lineitem), u AS (SELECT DISTINCT l_returnflag, id FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY sha256('42|' || id), id) AS k, count(*) OVER (PARTITION BY l_returnflag) AS population FROM u)
SELECT l_returnflag, id, population, population / least(population, 40)::DOUBLE AS weight FROM r WHERE k <= 40""")
def sample(t: Tables) -> DataFrame:
    """Forty rows per stratum by salted hash, with weights (a sampling operator)."""
    rows = t.lineitem.select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")).distinct()
    return metrics.stratified_sample(rows, ["l_returnflag"], "id", 40).select("l_returnflag", "id", "population", "weight")


@query("e17_kish", "SELECT l_returnflag, round(sum(l_quantity) ^ 2 / sum(l_quantity ^ 2), 6) AS n_efectivo FROM lineitem GROUP BY 1")
def kish(t: Tables) -> DataFrame:
    """Effective number of rows under weights."""
    w = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(w) * F.sum(w) / F.sum(w * w), 6).alias("n_efectivo"))


@query("e18_mayoria", """
WITH c AS (SELECT id_noticia, tema_humano AS v, count(*) AS n FROM hoja_preetiquetado WHERE tema_humano IS NOT NULL GROUP BY 1, 2), b AS (SELECT id_noticia, max((n, v)) AS b, sum(n)::BIGINT AS total FROM c GROUP BY 1)
SELECT id_noticia, CASE WHEN 2 * b[1] > total THEN b[2] END AS value, total AS labels, 2 * b[1] <= total AS disputed FROM b""")
def majority(t: Tables) -> DataFrame:
    """Majority label of each headline, and disputes."""
    return metrics.majority(t.hoja_preetiquetado, "id_noticia", "tema_humano")


@query("e19_auc", """
WITH x AS (SELECT value, event_type = 'purchase' AS p, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events WHERE value IS NOT NULL)
SELECT count_if(p) AS positives, count_if(NOT p) AS negatives, round((sum(CASE WHEN p THEN r END) - count_if(p) * (count_if(p) + 1) / 2.0) / nullif(count_if(p)::DOUBLE * count_if(NOT p), 0), 9) AS auc FROM x""")
def auc(t: Tables) -> DataFrame:
    """Chance that a purchase has a higher value than another event."""
    return metrics.auc(t.events, F.col("event_type") == "purchase", "value").withColumn("auc", F.round("auc", 9))


@query("e20_dos_niveles", "SELECT round(avg(m), 9) AS media_de_medias, count(*) AS grupos FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id)")
def two_level(t: Tables) -> DataFrame:
    """Mean of the means of groups."""
    return t.events.groupBy("user_id").agg(F.avg("value").alias("m")).agg(F.round(F.avg("m"), 9).alias("media_de_medias"), F.count(F.lit(1)).alias("grupos"))


@query("e25_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def spearman(t: Tables) -> DataFrame:
    """Rank correlation of quantity and price."""
    return metrics.spearman(t.lineitem, "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@query("w13_meseta", """
WITH x AS (SELECT p_size AS x, round(count(*) / 40, 0) AS s FROM part GROUP BY p_size), k AS (SELECT *, row_number() OVER (ORDER BY x) AS k, max(s) OVER () AS top FROM x),
r AS (SELECT x, s, k - row_number() OVER (ORDER BY x) AS g FROM k WHERE s = top), l AS (SELECT g, list(x ORDER BY x) AS xs, max(s) AS s FROM r GROUP BY g ORDER BY len(list(x)) DESC, min(x) LIMIT 1)
SELECT xs[1] AS first, xs[-1] AS last, xs[(len(xs) - 1) // 2 + 1] AS middle, s AS score FROM l""")
def plateau(t: Tables) -> DataFrame:
    """The longest run of thresholds with the best score."""
    sizes = t.part.groupBy("p_size").agg(F.round(F.count(F.lit(1)) / 40, 0).alias("s"))
    return metrics.plateau(sizes, "p_size", "s")


@query("z105_solape_de_palabras", f"""
WITH w AS (SELECT DISTINCT id_noticia, list_distinct(string_split({spaced('titulo')}, ' ')) AS w, list_distinct(string_split(replace({spaced('grupo')}, '  ', ' '), ' ')) AS g FROM hoja_preetiquetado WHERE titulo IS NOT NULL AND grupo IS NOT NULL)
SELECT id_noticia, array_to_string(list_sort(g), ' ') AS grupo, round(len(list_intersect(w, g)) / len(list_distinct(list_concat(w, g)))::DOUBLE, 9) AS jaccard FROM (SELECT DISTINCT id_noticia, list_sort(w) AS w, list_sort(g) AS g FROM w)""")
def overlap(t: Tables) -> DataFrame:
    """Z105: overlap of the words of a headline and of its group's name."""
    w = lambda c: F.array_sort(F.array_distinct(F.split(text.spaced_key(F.col(c)), " ")))
    rows = t.hoja_preetiquetado.where("titulo is not null and grupo is not null").select("id_noticia", w("titulo").alias("w"), w("grupo").alias("g")).distinct()
    return rows.select("id_noticia", F.array_join("g", " ").alias("grupo"), F.round(F.size(F.array_intersect("w", "g")) / F.size(F.array_union("w", "g")), 9).alias("jaccard"))


@query("j16_novedad", f"""
SELECT a.vec_id AS id, b.vec_id AS earlier, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id AND b.vec_id >= a.vec_id - 168
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 12) DESC, b.vec_id DESC) = 1""")
def novelty(t: Tables) -> DataFrame:
    """The most similar earlier vector within seven days; vectors are dated by hour of their id here."""
    dated = t.embeddings.withColumn("t", F.timestamp_seconds(F.col("vec_id") * 3600))
    found = vectors.most_similar_before(dated, "vec_id", "embedding", "t", 7)
    return found.select("id", "earlier", F.round("similarity", 6).alias("similarity"))


_HOST = r"regexp_replace(regexp_extract(lower(trim(url)), '^[a-z]+://([^/:?#]+)', 1), '^(www\.|m\.)', '')"


@query("m12_procedencias", f"""
WITH RECURSIVE n AS MATERIALIZED (SELECT fila, zona, nullif({_HOST}, '') AS h, nullif({spaced('titulo')}, '') AS k FROM noticias WHERE zona IS NOT NULL),
e AS MATERIALIZED (SELECT a.fila AS a, b.fila AS b FROM n a JOIN n b ON a.zona = b.zona AND (a.h = b.h OR a.k = b.k)),
r AS (SELECT fila AS id, fila AS x FROM n UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a), c AS (SELECT id, min(x) AS x FROM r GROUP BY id)
SELECT zona, count(*) AS filas, count(DISTINCT x) AS procedencias FROM n JOIN c ON n.fila = c.id GROUP BY zona""")
def provenance(t: Tables) -> DataFrame:
    """Independent sources behind the news of each zone; same site or same headline is one source."""
    rows = t.noticias.where("zona is not null")
    key = F.nullif(text.spaced_key(F.col("titulo")), F.lit(""))
    found = vectors.independent_sources(rows, "zona", "fila", {"sitio": urls.host(F.col("url")), "titular": key})
    return found.groupBy("zona").agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("source").alias("procedencias"))


@query("m06_regresion_logistica")
def logistic(t: Tables) -> DataFrame:
    """M6, M7: penalties of a logistic topic model by cross-validated macro F1."""
    from telar.operators import topics

    rows = _sheet(t).groupBy("id_noticia").agg(F.min("titulo").alias("titulo"), F.min("tema_humano").alias("tema_humano"))
    return topics.cross_validate(rows, "id_noticia", "titulo", "tema_humano", [0.01, 0.1])


_RULES = {"servicios_publicos": ["agua", "apagon", "luz"], "eventos_naturales": ["sismo", "incendio", "inundacion"], "regulacion": ["peaje", "multa"], "turismo": ["crucero", "festival", "turistas"]}
_HITS = {k: " + ".join(f"regexp_matches(b, '\\b{w}\\b')::INT" for w in ws) for k, ws in _RULES.items()}


@query("m08_palabras_clave", f"""
WITH b AS (SELECT fila, regexp_replace({bare('titulo')}, 'direccion de aguas', ' ', 'g') AS b FROM noticias), h AS (SELECT fila, {", ".join(f"{v} AS {k}" for k, v in _HITS.items())} FROM b)
SELECT fila, CASE WHEN greatest({", ".join(_HITS)}) = 0 THEN NULL {" ".join(f"WHEN {k} = greatest({', '.join(_HITS)}) THEN '{k}'" for k in _HITS)} END AS tema FROM h""")
def keywords(t: Tables) -> DataFrame:
    """M8: topic by most different keywords, with a phrase that doesn't count."""
    from telar.operators import topics

    return t.noticias.select("fila", topics.keyword_topic("titulo", _RULES, {"organo": "direccion de aguas"}).alias("tema"))


@query("e10_barrido", f"""
WITH p AS (SELECT floor(round({_COS} / 0.05, 9))::INT AS c, a.label = b.label AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} > 0.2),
n AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)), k AS (SELECT c, count_if(s) AS x, count_if(NOT s) AS y FROM p GROUP BY c),
r AS (SELECT c, sum(x) OVER (ORDER BY c DESC) AS tp, sum(y) OVER (ORDER BY c DESC) AS fp FROM k)
SELECT round(c * 0.05, 9) AS threshold, tp, fp, t - tp AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / t, 9) AS recall, round(2 * tp / (2 * tp + fp + t - tp), 9) AS f1 FROM r, n""")
def sweep(t: Tables) -> DataFrame:
    """Pair precision and recall over a grid of thresholds."""
    edges = vectors.similar_edges(t.embeddings, "vec_id", "embedding", 0.2)
    a, b = t.embeddings.select(F.col("vec_id").alias("a"), F.col("label").alias("x")), t.embeddings.select(F.col("vec_id").alias("b"), F.col("label").alias("y"))
    pairs = edges.join(a, "a").join(b, "b")
    positives = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("n"))
    found = metrics.threshold_sweep(pairs, "similarity", F.col("x") == F.col("y"), positives, 0.05)
    return found.select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("e13_umbral_de_margen", """
WITH l AS (SELECT p_retailprice AS s, count_if(p_size > 25) AS p, count_if(NOT p_size > 25) AS n FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1),
c AS (SELECT s, lag(s) OVER (ORDER BY s) AS low, coalesce(sum(p) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(n) OVER () - coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS errors FROM l)
SELECT (s + low) / 2 AS cut, errors, (s - low) / 2 AS margin FROM c WHERE low IS NOT NULL ORDER BY errors, margin DESC, cut LIMIT 1""")
def margin(t: Tables) -> DataFrame:
    """The cut with fewest errors and the widest margin."""
    return metrics.best_threshold(t.part, "p_retailprice", F.col("p_size") > 25)


QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
