"""Topics of short texts: logistic regression over hashed words with cross-validation, and keyword rules."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.functions import text
from telar.functions.urls import fold
from telar.operators.metrics import macro_f1, per_class
from telar.session import cut


def labelled(df: DataFrame, column: str, label: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & F.col(label).isNotNull())


def featurise(df: DataFrame, id: str, column: str, label: str, size: int = 4096, folds: int = 3) -> tuple[DataFrame, list[str]]:
    """(id, label, index, features, fold, weight) and the labels in order of their index; classes weigh the same in all."""
    rows = labelled(df, column, label).select(F.col(id).alias("id"), F.col(label).alias("label"), text.words(F.col(column), least=3).alias("words"))
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=size, binary=True).transform(rows)
    indexer = StringIndexer(inputCol="label", outputCol="index", stringOrderType="alphabetAsc").fit(hashed)
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    weighed = counts.crossJoin(F.broadcast(facts)).select("label", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))
    out = indexer.transform(hashed).join(weighed, "label").withColumn("fold", fold(F.col("id").cast("string"), folds))
    return cut(out.select("id", "label", "index", "features", "fold", "weight")), list(indexer.labels)


def train(data: DataFrame, penalty: float):
    return LogisticRegression(featuresCol="features", labelCol="index", weightCol="weight", regParam=penalty, maxIter=40).fit(data)


def predict(model, data: DataFrame, labels: list[str], least: float = 0.0, margin: float = 0.0) -> DataFrame:
    """id, label, guess (null under ``least``), second (null unless within ``margin`` of the best), probability."""
    names = F.array(*map(F.lit, labels))
    scored = model.transform(data).withColumn("p", vector_to_array("probability"))
    ranked = F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("m"), i.alias("i"))))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return scored.select(
        "id", "label", F.when(-first["m"] >= least, F.get(names, first["i"])).alias("guess"),
        F.when((-second["m"] >= least) & (second["m"] - first["m"] <= margin), F.get(names, second["i"])).alias("second"), (-first["m"]).alias("probability"),
    )


def cross_validate(df: DataFrame, id: str, column: str, label: str, penalties: list[float], folds: int = 3) -> DataFrame:
    """``penalty``, ``macro_f1`` over the held-out folds and ``chosen``: the best, of equals the strongest penalty.

    Without labelled rows, or where a fold leaves nothing to train on, the score is null and nothing is chosen.
    """
    schema = "penalty double, macro_f1 double, chosen boolean"
    sizes = labelled(df, column, label).groupBy(fold(F.col(id).cast("string"), folds).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    if len(sizes) < 2:
        return df.sparkSession.createDataFrame([(float(p), None, False) for p in penalties], schema)
    data, labels = featurise(df, id, column, label, folds=folds)
    scores = []
    for penalty in penalties:
        held = [predict(train(data.where(F.col("fold") != k), penalty), data.where(F.col("fold") == k), labels) for k in range(folds)]
        every = held[0]
        for part in held[1:]:
            every = every.union(part)
        scores.append((float(penalty), macro_f1(per_class(every, "label", "guess")).first()["macro_f1"]))
    best = max(scores, key=lambda s: (-1.0 if s[1] is None else round(s[1], 9), s[0])) if scores else None
    return df.sparkSession.createDataFrame([(p, f, p == best[0]) for p, f in scores], schema)


def keyword_topic(column: str, rules: dict[str, list[str]], annul: dict[str, str] | None = None):
    """The topic with most different terms found, ties to the first named; null if none. ``annul``: patterns taken out first."""
    plain = text.bare(F.col(column))
    for pattern in (annul or {}).values():
        plain = F.regexp_replace(plain, pattern, " ")
    hits = [F.struct((-sum((plain.rlike(rf"\b{t}\b").cast("int") for t in terms), F.lit(0))).alias("n"), F.lit(i).alias("i"), F.lit(topic).alias("topic")) for i, (topic, terms) in enumerate(rules.items())]
    best = F.array_min(F.array(*hits))
    return F.when(best["n"] < 0, best["topic"])
