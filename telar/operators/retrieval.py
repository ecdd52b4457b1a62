"""Full-text retrieval with BM25 over a table of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bm25(corpus: DataFrame, queries: DataFrame, id: str, words: str, query: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query``, ``id``, ``score``, ``rank``: the best ``k`` rows per query; idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    Only the words of the queries are kept of the corpus before anything is shuffled. A word repeated in a query counts
    once. Ties go to the smaller id; rows that share no word with a query aren't returned.
    """
    facts = corpus.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size(words)).alias("avg"))
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct("words")).alias("w"))
    wanted = asked.select("w").distinct()
    each = corpus.select(id, F.size(words).alias("len"), F.explode(words).alias("w"))
    tf = each.join(wanted, "w", "left_semi").groupBy("w", id, "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = tf.join(df, "w").crossJoin(facts).select("w", id, weight.alias("x")).join(asked, "w").groupBy("query", id).agg(F.sum("x").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
