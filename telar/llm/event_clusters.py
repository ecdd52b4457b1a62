"""Clusters of mutually similar records: parallel pivot correlation clustering, and headlines that report one event.

Records share block keys with those they may be similar to. In each round a record whose hash is the smallest in all
its blocks becomes a pivot and absorbs the similar records of its blocks; rounds go on until none is left, after the
first ones with several pivots a block, so that a block of many events doesn't take a round for each. Members
then move to the closest pivot, each cluster's medoid is found, and a pass over the medoids, largest cluster first,
joins what a poor pivot had kept apart. Records are compared with pivots only, never with each other.

What headlines have in common is weighed by the table's own document frequencies: its rare words, and those whose
headlines agree on a figure, are the names of what is reported; its frequent ones say what kind of thing happened, each
the more the rarer it is. No list of words is used.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.session import cut

Similarity = Callable[[Column, Column], Column]


def _join(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides grow with the data: never by broadcast, whatever the size estimate of a checkpoint says."""
    return a.join(b.hint("merge"), on, how)


def pivot_clusters(df: DataFrame, similarity: Similarity, threshold: float, single_rounds: int = 8) -> DataFrame:
    """``id``, ``pivot`` of each row of ``df`` (id, order, keys, f): one round after another until every row has one.

    ``order`` (any orderable, smallest first) decides who is pivot, ties go to the smaller id. A row without keys is a
    pivot on its own. ``similarity`` of two ``f`` values counts from ``threshold`` on. A block that holds a third of
    all rows is reduced to its minimum by partial aggregation; each row of it meets that one pivot per round. What
    ``single_rounds`` leave goes on with several pivots per block and round; no row is left out.
    """
    alive = cut(df.select("id", F.struct("order", "id").alias("o"), "keys", "f"))
    done: list[DataFrame] = []
    for _ in range(single_rounds):
        blocks = alive.select("id", "o", F.explode_outer("keys").alias("key"))
        least = blocks.where("key is not null").groupBy("key").agg(F.min("o").alias("m"))
        seen = _join(blocks, least, "key", "left").select("id", "m", F.coalesce(F.col("m") == F.col("o"), F.lit(True)).alias("first"))
        tops = seen.groupBy("id").agg(F.bool_and("first").alias("pivot"), F.collect_set("m.id").alias("near"))
        state = cut(_join(alive, tops, "id"))
        pivots = state.where("pivot").select(F.col("id").alias("p"), "o", F.col("f").alias("g"))
        near = _join(state.where("not pivot").select("id", "f", F.explode("near").alias("p")), pivots, "p")
        close = near.withColumn("s", similarity(F.col("f"), F.col("g"))).where(F.col("s") >= threshold)
        absorbed = close.groupBy("id").agg(F.min(F.struct(-F.col("s"), "o", "p")).alias("b")).select("id", F.col("b.p").alias("pivot"))
        taken = cut(absorbed.union(state.where("pivot").select("id", F.col("id").alias("pivot"))))
        done.append(taken)
        alive = cut(_join(alive, taken, "id", "left_anti"))
        if alive.isEmpty():
            break
    else:
        done.append(_several_pivots(alive, similarity, threshold))
    return reduce(DataFrame.union, done)


def _several_pivots(rows: DataFrame, similarity: Similarity, threshold: float, listed: int = 16, most: int = 1000) -> DataFrame:
    """``id``, ``pivot`` of ``rows`` (id, o, keys, f), the pivots those of one a round in order.

    The smallest ``listed`` rows of each block, twice as many each round up to ``most``, are compared with each other: a
    row that is listed in all its blocks and similar to no smaller one is a pivot. The smallest row of all always is, so
    the rounds end. A row goes to the smallest pivot it is similar to.
    """
    rows = whole = cut(rows.withColumn("keys", F.coalesce(F.array_distinct(F.filter("keys", lambda k: k.isNotNull())), F.array())))
    found: list[DataFrame] = []
    while True:
        blocks = rows.select("id", "o", F.explode("keys").alias("key"))
        place = F.row_number().over(Window.partitionBy("key").orderBy("o"))
        tops = cut(blocks.withColumn("place", place).where(F.col("place") <= listed).drop("place"))
        counts = tops.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        known = _join(rows, counts, "id", "left").where(F.coalesce("n", F.lit(0)) == F.size("keys")).drop("n")
        smaller = tops.select("key", F.col("id").alias("p"), F.col("o").alias("q"))
        pairs = _join(_join(tops, known.select("id"), "id", "left_semi"), smaller, "key").where("q < o").select("id", "p").distinct()
        taken = _similar(pairs, rows, rows, similarity, threshold).select("id").distinct()
        pivots = cut(_join(known, taken, "id", "left_anti"))
        met = _join(blocks.drop("o"), pivots.select(F.explode("keys").alias("key"), F.col("id").alias("p")), "key")
        near = _similar(met.where("id <> p").select("id", "p").distinct(), rows, pivots, similarity, threshold)
        rows = cut(_join(rows, near.select("id").union(pivots.select("id")).distinct(), "id", "left_anti"))
        found.append(pivots)
        if rows.isEmpty():
            break
        if len(found) == 32:
            found = [cut(reduce(DataFrame.union, found))]
        listed = min(2 * listed, most)
    pivots = cut(reduce(DataFrame.union, found))
    members = _join(whole, pivots, "id", "left_anti")
    there = pivots.select(F.explode("keys").alias("key"), F.col("id").alias("p"))
    near = _join(members.select("id", F.explode("keys").alias("key")), there, "key").select("id", "p").distinct()
    first = _similar(near, members, pivots, similarity, threshold).groupBy("id").agg(F.min("q")["id"].alias("pivot"))
    return cut(first.union(pivots.select("id", F.col("id").alias("pivot"))))


def _similar(pairs: DataFrame, rows: DataFrame, others: DataFrame, similarity: Similarity, threshold: float) -> DataFrame:
    """The ``pairs`` (id, p) that are similar, with the order ``q`` of p."""
    sides = _join(_join(pairs, rows.select("id", "f"), "id"), others.select(F.col("id").alias("p"), F.col("o").alias("q"), F.col("f").alias("g")), "p")
    return sides.where(similarity(F.col("f"), F.col("g")) >= threshold).select("id", "p", "q")


def closest_pivot(df: DataFrame, clusters: DataFrame, similarity: Similarity, threshold: float) -> DataFrame:
    """``id``, ``pivot`` again, each row moved to the most similar pivot of its blocks; pivots stay."""
    pivots = _join(df, clusters.select(F.col("pivot").alias("id")).distinct(), "id")
    there = pivots.select(F.explode("keys").alias("key"), F.col("id").alias("p"))
    near = _join(df.select("id", F.explode("keys").alias("key")), there, "key").select("id", "p").distinct()
    pairs = _join(_join(near, df.select("id", "f"), "id"), pivots.select(F.col("id").alias("p"), F.col("order").alias("o"), F.col("f").alias("g")), "p")
    close = pairs.withColumn("s", similarity(F.col("f"), F.col("g"))).where((F.col("s") >= threshold) | (F.col("id") == F.col("p")))
    rank = F.struct(F.when(F.col("id") == F.col("p"), 0).otherwise(1), -F.col("s"), "o", "p")
    best = close.groupBy("id").agg(F.min(rank).alias("b")).select("id", F.col("b.p").alias("moved"))
    return _join(clusters, best, "id", "left").select("id", F.coalesce("moved", "pivot").alias("pivot"))


def medoids(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """``pivot``, ``medoid``, ``size`` of each cluster; the medoid's ``traits`` are those its members share most.

    A member's score is the number of the cluster's members that have each of its traits, averaged over its traits and
    shrunk for few. Counts per (cluster, trait) are aggregated, so the work is linear in the members.
    """
    words = _join(clusters, df, "id").select("pivot", "id", F.explode("traits").alias("w"))
    counts = words.groupBy("pivot", "w").agg(F.count(F.lit(1)).alias("n"))
    scores = _join(words, counts, ["pivot", "w"]).groupBy("pivot", "id").agg((F.sum("n") / (F.count(F.lit(1)) + 2)).alias("s"))
    sized = _join(_join(clusters, df.select("id", "weight"), "id"), scores.select("id", "s"), "id", "left")
    top = F.max(F.struct(F.coalesce("s", F.lit(0.0)), "weight", -F.xxhash64("id").cast("decimal(20,0)"), "id"))
    return sized.groupBy("pivot").agg(top["id"].alias("medoid"), F.sum("weight").alias("size"))


def cluster(df: DataFrame, similarity: Similarity, threshold: float) -> DataFrame:
    """``id``, ``medoid`` (the cluster's name), ``size`` for rows (id, weight, keys, f, traits); see the module."""
    df = cut(df.withColumn("order", F.xxhash64("id")))
    slim = df.select("id", "order", "keys", "f")
    first = cut(closest_pivot(slim, cut(pivot_clusters(slim, similarity, threshold)), similarity, threshold))
    centres = cut(medoids(df, first))
    upper = _join(slim.drop("order"), centres.select(F.col("medoid").alias("id"), (-F.col("size")).alias("order")), "id")
    joined = pivot_clusters(upper, similarity, threshold).select(F.col("id").alias("medoid"), F.col("pivot").alias("root"))
    merged = cut(_join(first, _join(centres, joined, "medoid"), "pivot").select("id", F.col("root").alias("pivot"), "medoid", "size"))
    # Only clusters that were joined have a new medoid.
    grown = merged.where("pivot <> medoid").select("pivot").distinct()
    again = _join(merged.select("id", "pivot"), grown, "pivot", "left_semi")
    new = _join(again, medoids(df, again), "pivot").select("id", "medoid", "size")
    return new.union(_join(merged, grown, "pivot", "left_anti").select("id", "medoid", "size"))


_FIGURE = re.compile(r"\d+(?:[.,]\d{3})*(?:[.,]\d+)?")
_WORD = re.compile(r"[^\W\d_]{2,}")
_READ = (
    T.StructType().add("form", T.StringType()).add("words", T.ArrayType(T.StringType()))
    .add("figures", T.ArrayType(T.DoubleType())).add("rounded", T.ArrayType(T.DoubleType()))
)
#: A frequent word is one integer: its number, and its weight in steps of 1 / _STEPS in the lowest _BITS.
_BITS, _STEPS = 10, 64.0


def _figure(text: str) -> float:
    whole = re.sub(r"[.,](?=\d{3}(?:\D|$))", "", text)
    return float(whole.replace(",", "."))


def _round(x: float, digits: int) -> float:
    return float(f"{x:.{digits - 1}e}")


def spellings(name: Column) -> Column:
    """The name and itself with one letter left out: what a dropped, doubled or swapped letter leaves in common."""
    n = F.length(name)
    shorter = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1, n)))
    return F.when(n > 3, F.array_distinct(F.concat(F.array(name), shorter))).otherwise(F.array(name))


def slip(x: Column, y: Column) -> Column:
    """Whether two names differ by one letter left out or put in, or by two neighbours swapped."""
    far = F.levenshtein(x, y, 2)
    return ((F.abs(F.length(x) - F.length(y)) == 1) & (far == 1)) | (
        (F.length(x) == F.length(y)) & (far == 2) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, "")))
    )


def headline(title: str) -> dict:
    """Form (its words in order), distinct words, figures, and the figures rounded to one and two digits."""
    while "&" in title and (resolved := html.unescape(title)) != title:
        title = resolved
    text = unicodedata.normalize("NFC", title).lower()
    figures = sorted({_figure(m) for m in _FIGURE.findall(text)})
    return {
        "form": " ".join(re.findall(r"\w+", text)), "words": sorted(set(_WORD.findall(text))), "figures": figures,
        "rounded": sorted({_round(x, d) for x in figures for d in (1, 2)}),
    }


def headlines(title: Column) -> Column:
    kind = pa.struct([("form", pa.string()), ("words", pa.list_(pa.string())), ("figures", pa.list_(pa.float64())), ("rounded", pa.list_(pa.float64()))])

    def convert(titles: pa.Array) -> pa.Array:
        return pa.array([headline(t or "") for t in titles.to_pylist()], kind)

    return F.arrow_udf(convert, _READ)(title)


def _mass(words: Column) -> Column:
    """Summed weight of coded words."""
    return F.aggregate(words, F.lit(0), lambda s, x: s + x.bitwiseAND(F.lit((1 << _BITS) - 1))) / F.lit(_STEPS)


def same_event(a: Column, b: Column) -> Column:
    """Similarity of two headlines: a name in common, agreeing figures, frequent words in common by weight.

    With a common name 0.7 and more if figures agree (equal within a hundredth, or one the other rounded to one or two
    digits), 0.5 and more if one of them has none; the rest comes from the share of the lighter one's words that both
    have (of its names, where one has no frequent words). Without names: the share of all their words. Figures that disagree, or names of which none is common: 0.
    """
    none = (F.size(a["figures"]) == 0) | (F.size(b["figures"]) == 0)
    near = F.exists(a["figures"], lambda p: F.exists(b["figures"], lambda q: F.abs(p - q) <= F.greatest(p, q) * 0.01))
    agree = near | F.arrays_overlap(a["figures"], b["rounded"]) | F.arrays_overlap(a["rounded"], b["figures"])
    shared = _mass(F.array_intersect(a["words"], b["words"]))
    names = F.size(F.array_intersect(a["names"], b["names"])) / F.greatest(F.least(F.size(a["names"]), F.size(b["names"])), F.lit(1))
    lighter = F.least(a["mass"], b["mass"])
    part = F.when(lighter > 0, shared / F.greatest(lighter, F.lit(1e-9))).otherwise(names)
    whole = shared / F.greatest(a["mass"] + b["mass"] - shared, F.lit(1e-9))
    common = F.arrays_overlap(a["names"], b["names"])
    nameless = (F.size(a["names"]) == 0) & (F.size(b["names"]) == 0)
    known = F.when(agree, 0.7 + 0.3 * F.least(part / 0.4, F.lit(1.0))).when(none, 0.5 + 0.5 * F.least(part / 0.8, F.lit(1.0)))
    return F.coalesce(F.when(common, known).when(nameless & (none | agree), 0.1 + whole), F.lit(0.0))


def _frequent(rows: DataFrame, n: int, share: float, least: int, most: int) -> dict[str, int]:
    """Code of the words that more than ``share`` of the rows have; the weight is the logarithm of inverse frequency.

    There are at most (distinct words of a row on average) / ``share`` of them, whatever the table's size; checked.
    A word whose rows mostly agree on one figure is not among them: it names one event that many headlines report.
    """
    each = rows.select(F.explode("words").alias("w"), "rounded")
    found = each.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(least, share * n)).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} frequent words")
    counts = {r.w: r.c for r in found}
    known = rows.sparkSession.createDataFrame([(w,) for w in counts], "w string")
    agreed = each.join(F.broadcast(known), "w").select("w", F.explode("rounded").alias("x")).groupBy("w", "x").agg(F.count(F.lit(1)).alias("c"))
    top = {r.w: r.c for r in agreed.groupBy("w").agg(F.max("c").alias("c")).collect()}
    kept = sorted(w for w, c in counts.items() if 2 * top.get(w, 0) <= c)
    return {w: i << _BITS | min(round(_STEPS * math.log(n / counts[w])), (1 << _BITS) - 1) for i, w in enumerate(kept)}


def _split(words: Column, frequent) -> tuple[Column, Column]:
    """The words that aren't frequent, and the codes of those that are, the heaviest first."""

    def names(lists: pa.Array) -> pa.Array:
        known = frequent.value
        return pa.array([[w for w in ws if w not in known] for ws in lists.to_pylist()], pa.list_(pa.string()))

    def coded(lists: pa.Array) -> pa.Array:
        known, low = frequent.value, (1 << _BITS) - 1
        return pa.array([sorted((known[w] for w in ws if w in known), key=lambda c: (-(c & low), c)) for ws in lists.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(names, T.ArrayType(T.StringType()))(words), F.arrow_udf(coded, T.ArrayType(T.IntegerType()))(words)


def _prefix(words: Column, mass: Column, threshold: float) -> Column:
    """The heaviest words of a headline, as many as leave the others less than ``threshold`` of its weight.

    Two headlines that share that much of all their words share one of these (prefix filtering).
    """
    weight = lambda x: x.bitwiseAND(F.lit((1 << _BITS) - 1)) / F.lit(_STEPS)
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("k"))
    step = lambda a, x: F.struct((a["s"] + weight(x)).alias("s"), F.when(mass - a["s"] >= threshold * mass, F.array_append(a["k"], x)).otherwise(a["k"]).alias("k"))
    return F.aggregate(F.filter(words, lambda x: weight(x) > 0), start, step)["k"]


def name_codes(rows: DataFrame) -> DataFrame:
    """``id``, ``names``: hashes of the rare words of each row and, for each, of the more frequent ones it may be a slip of.

    Each distinct name is spelled once. Of the names of one spelling the most frequent is what the others may mean.
    """
    each = rows.select("id", F.explode("rare").alias("t"))
    counts = each.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    spelled = counts.select("t", "c", F.explode(spellings(F.col("t"))).alias("s")).withColumn("s", F.xxhash64("s"))
    # At most as many names share a spelling as there are letters to put in.
    best = F.max(F.struct("c", "t")).over(Window.partitionBy("s"))
    pairs = spelled.withColumn("b", best).where(F.struct("c", "t") < F.col("b")).select("t", F.col("b.t").alias("u")).distinct()
    meant = pairs.where(slip(F.col("t"), F.col("u"))).groupBy("t").agg(F.collect_set(F.xxhash64("u")).alias("u"))
    coded = _join(each, meant, "t", "left").select("id", F.array_append(F.coalesce("u", F.array().cast("array<bigint>")), F.xxhash64("t")).alias("n"))
    return coded.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("n"))).alias("names"))


def event_clusters(
    df: DataFrame, id: str, title: str, threshold: float = 0.8, frequent_share: float = 0.01, least_frequent: int = 5, max_frequent: int = 100_000
) -> DataFrame:
    """``id``, ``cluster``, ``size`` (number of ids) and ``typical`` (the medoid's title) of each id with a title.

    * Titles that are the same words are one record of the clustering, so copies cost nothing. The cluster's name is
      its medoid's smallest id.
    * Ids without title, and titles without words, are in no cluster. An id with several titles takes the smallest.
    * Repeated rows change nothing. An empty table gives an empty result; other columns are ignored.
    * A word is frequent if more than ``frequent_share`` of the distinct titles, and more than ``least_frequent``, have
      it, unless half of these have one figure in common; the others are names. Blocks are names: one of many rows is
      an event of that size. Headlines without names meet by their heaviest words. Very long titles are read whole.
    """
    spark = df.sparkSession
    one = df.where(F.col(id).isNotNull() & F.col(title).isNotNull()).groupBy(F.col(id).alias("item")).agg(F.min(title).alias("title"))
    codes = [F.xxhash64("h.form").alias("form"), F.xxhash64(F.lit(2), "h.form").alias("form2")]
    read = cut(one.withColumn("h", headlines(F.col("title"))).where("h.form <> ''").select("item", "title", *codes, "h.words", "h.figures", "h.rounded"))
    forms = read.groupBy("form", "form2").agg(
        F.min(F.struct("item", "title", "words", "figures", "rounded")).alias("r"), F.count(F.lit(1)).alias("weight")
    )
    rows = cut(forms.select(F.col("r.item").alias("id"), "form", "form2", "weight", "r.title", "r.words", "r.figures", "r.rounded"))
    frequent = spark.sparkContext.broadcast(_frequent(rows, rows.count(), frequent_share, least_frequent, max_frequent))
    rare, weighed = _split(F.col("words"), frequent)
    parts = cut(rows.select("id", "weight", rare.alias("rare"), weighed.alias("words"), "figures", "rounded"))
    named = _join(parts, name_codes(parts), "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<bigint>")))
    ready = named.withColumn("mass", _mass(F.col("words"))).select(
        "id", "weight", F.struct("names", "words", "mass", "figures", "rounded").alias("f"),
        F.when(F.size("names") > 0, F.col("names")).otherwise(F.transform(_prefix(F.col("words"), F.col("mass"), threshold - 0.1), lambda c: c.cast("bigint"))).alias("keys"),
        F.concat("names", F.transform(F.slice("words", 1, 6), lambda x: F.xxhash64(x)), F.transform("figures", lambda x: F.xxhash64(x))).alias("traits"),
    )
    found = cluster(ready, same_event, threshold)
    typical = _join(found, rows.select(F.col("id").alias("medoid"), F.col("title").alias("typical")), "medoid")
    by_form = _join(typical, rows.select("id", "form", "form2"), "id").select("form", "form2", F.col("medoid").alias("cluster"), "size", "typical")
    return _join(read.select("item", "form", "form2"), by_form, ["form", "form2"]).select(F.col("item").alias("id"), "cluster", "size", "typical")
