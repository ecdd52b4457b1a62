"""Evaluation: classification, clustering, ranking, agreement, resampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.functions.stats import f1, wilson
from telar.operators.prefix import places, running_before


def per_class(df: DataFrame, truth: str, guess: str, weight: Column | None = None) -> DataFrame:
    """``cls``, tp, fp, fn, precision, recall, f1 (null where undefined), support. Rows with a null on a side are left out."""
    w = weight if weight is not None else F.lit(1)
    pairs = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.sum(w).alias("n"))
    sides = F.array(F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("tp"), F.when(F.col("t") != F.col("g"), F.col("n")).otherwise(0).alias("fn"), F.lit(0).alias("fp")),
                    F.struct(F.col("g").alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("fn"), F.when(F.col("t") != F.col("g"), F.col("n")).otherwise(0).alias("fp")))
    counts = pairs.select(F.explode(sides).alias("s")).groupBy(F.col("s.c").alias("cls")).agg(*[F.sum(f"s.{x}").alias(x) for x in ("tp", "fp", "fn")])
    zero = lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("cls", "tp", "fp", "fn", (tp / zero(tp + fp)).alias("precision"), (tp / zero(tp + fn)).alias("recall"), f1(tp, fp, fn).alias("f1"), (tp + fn).alias("support"))


def macro_f1(classes: DataFrame) -> DataFrame:
    """Mean F1 over the classes that occur in the truth; undefined ones count as missing."""
    return classes.where("support > 0").agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed and expected agreement and Cohen's kappa (null where agreement by chance is sure)."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("N"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("x")), cells.groupBy("b").agg(F.sum("n").alias("y"))
    chance = rows.join(columns, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    po, pe = F.col("same") / F.col("N"), F.col("xy") / (F.col("N").cast("double") * F.col("N"))
    return total.crossJoin(chance).select(F.col("N").alias("n"), po.alias("observed"), pe.alias("expected"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def pair_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Pairs of members put together rightly, wrongly and not, and their precision, recall and F1.

    Closed form from group sizes: n(n-1)/2 summed over groups of both, of the truth and of the guess; no pairs are made.
    """
    rows = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    pairs = lambda *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("p"))
    joint = pairs(truth, guess).select(F.col("p").alias("tp")).crossJoin(pairs(truth).select(F.col("p").alias("t"))).crossJoin(pairs(guess).select(F.col("p").alias("g")))
    tp, fp, fn = F.col("tp"), F.col("g") - F.col("tp"), F.col("t") - F.col("tp")
    return joint.select(tp, fp.alias("fp"), fn.alias("fn"), (tp / F.nullif(F.col("g"), F.lit(0.0))).alias("precision"), (tp / F.nullif(F.col("t"), F.lit(0.0))).alias("recall"), f1(tp, fp, fn).alias("f1"))


def auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """n of each side and the chance that a positive scores higher, ties half: from ranks of counted scores."""
    levels = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    won = running_before(levels, [F.col(score)], F.col("n"), "below").withColumn("won", F.col("p") * (F.col("below") + F.col("n") / 2))
    both = F.nullif(F.sum("p").cast("double") * F.sum("n"), F.lit(0.0))
    return won.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), (F.sum("won") / both).alias("auc"))


# The Poisson distribution function of mean 1 at 0, 1, ... 6.
_POISSON = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119])


def poisson_weights(hashes: np.ndarray, resamples: int) -> np.ndarray:
    """[row, resample] weights of a Poisson bootstrap, by mixing each row's hash with the number of the resample."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53).astype(np.float64)


def resample(df: DataFrame, id: str, keys: list[str], value: Column, resamples: int, seed: int, chunk: int = 2000, most: int = 10_000) -> DataFrame:
    """``keys``, ``r``, ``w``, ``s``: sums of weights and of weighted values in each resample, for each of a few keys.

    Weights hang on the row's ``id``, the seed and the resample alone, so that results don't depend on how rows are
    spread. Each task draws them batch by batch and gives one row per key and resample; rows are never multiplied. More
    than ``most`` keys in a task raise.
    """
    rows = df.select(F.xxhash64(F.lit(seed), F.col(id)).alias("h"), value.cast("double").alias("v"), *[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]).where("v is not null")
    names = [f"k{i}" for i in range(len(keys))]

    def draw(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            h, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            key = list(zip(*[batch.column(2 + i).to_pylist() for i in range(len(names))])) if names else [()] * len(h)
            number = {k: i for i, k in enumerate(dict.fromkeys(key))}
            which = np.array([number[k] for k in key], np.int64)
            sums = np.zeros((len(number), 2, resamples))
            for i in range(0, len(h), chunk):
                w = poisson_weights(h[i : i + chunk].astype(np.int64).view(np.uint64), resamples)
                np.add.at(sums, (which[i : i + chunk], 0), w)
                np.add.at(sums, (which[i : i + chunk], 1), w * v[i : i + chunk, None])
            for k, i in number.items():
                total[k] = total.get(k, 0) + sums[i]
            if len(total) > most:
                raise ValueError(f"more than {most} keys to resample")
        for k, x in total.items():
            yield pa.RecordBatch.from_pydict({**{n: pa.array([z] * resamples, pa.string()) for n, z in zip(names, k)}, "r": pa.array(range(1, resamples + 1), pa.int32()), "w": x[0], "s": x[1]})

    found = rows.mapInArrow(draw, ", ".join([*[f"{n} string" for n in names], "r int, w double, s double"]))
    return found.groupBy(*names, "r").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "r", "w", "s")


def interval(df: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """``low``, ``high``: percentiles of a statistic over its resamples; resamples in which it isn't defined are left out."""
    tail = (1 - level) / 2
    return df.agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def bootstrap_mean(df: DataFrame, id: str, value: Column, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean of a 0/1 or numeric column with its percentile interval by a Poisson bootstrap; only sums per resample move."""
    rows = df.select(value.cast("double").alias("v")).where("v is not null")
    means = resample(df, id, [], value, resamples, seed).select((F.col("s") / F.nullif(F.col("w"), F.lit(0.0))).alias("m"))
    return rows.agg(F.avg("v").alias("mean"), F.count("v").alias("n")).crossJoin(interval(means, "m", level))


def proportion(df: DataFrame, id: str, hit: Column, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """A share with bootstrap and Wilson intervals; ``degenerate`` where all or none are hits and the bootstrap says nothing."""
    found = bootstrap_mean(df, id, hit.cast("double"), resamples, seed)
    low, high = wilson(F.round(F.col("mean") * F.col("n")), F.col("n"))
    return found.withColumns({"wilson_low": low, "wilson_high": high, "degenerate": F.col("mean").isin(0.0, 1.0)})


def _macro(cells: DataFrame, truth: str, guess: str, keys: list[str]) -> DataFrame:
    """``keys``, ``macro_f1`` from weighted cells (keys, truth, guess, w), over the classes that occur in the truth of all cells."""
    t, g, w = F.col(truth), F.col(guess), F.col("w")
    sides = F.array(
        F.struct(t.alias("c"), F.when(t == g, w).otherwise(0.0).alias("tp"), F.lit(0.0).alias("fp"), F.when(t != g, w).otherwise(0.0).alias("fn"), F.lit(True).alias("there")),
        F.struct(g.alias("c"), F.lit(0.0).alias("tp"), F.when(t != g, w).otherwise(0.0).alias("fp"), F.lit(0.0).alias("fn"), F.lit(False).alias("there")),
    )
    each = cells.select(*keys, F.explode(sides).alias("x")).groupBy(*keys, F.col("x.c").alias("c")).agg(*[F.sum(f"x.{n}").alias(n) for n in ("tp", "fp", "fn")], F.bool_or("x.there").alias("there"))
    return each.where("there").groupBy(*keys).agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))


def compare_macro_f1(df: DataFrame, id: str, truth: str, a: str, b: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: macro F1 of two predictors with intervals, their paired difference ``b - a`` with its own, and ``decision``.

    Both are resampled together. ``b`` is chosen only if the interval of the difference lies above 0. Rows with a null
    on any side are left out.
    """
    rows = df.where(F.col(truth).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    drawn = resample(rows, id, [truth, a, b], F.lit(1.0), resamples, seed)
    per = _macro(drawn, truth, a, ["r"]).withColumnRenamed("macro_f1", "a").join(_macro(drawn, truth, b, ["r"]).withColumnRenamed("macro_f1", "b"), "r").withColumn("d", F.col("b") - F.col("a"))
    cells = rows.groupBy(truth, a, b).agg(F.count(F.lit(1)).cast("double").alias("w"))
    out = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(_macro(cells, truth, a, []).withColumnRenamed("macro_f1", "f1_a")).crossJoin(_macro(cells, truth, b, []).withColumnRenamed("macro_f1", "f1_b"))
    out = out.withColumn("difference", F.col("f1_b") - F.col("f1_a"))
    for name in ("a", "b", "d"):
        out = out.crossJoin(interval(per, name).toDF(f"{name}_low", f"{name}_high"))
    return out.withColumn("decision", F.when(F.col("d_low") > 0, "b").otherwise("a"))


def resampled_pairs(df: DataFrame, id: str, truth: str, guess: str, resamples: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Intervals of pair precision and recall when the records themselves are resampled: ``metric``, ``value``, ``low``, ``high``.

    In a resample a group holds (sum of weights squared - sum of squared weights) / 2 pairs. Rows are sorted by group
    within their partition and the sums run along, so that a group of any size takes one row of sums.
    """
    rows = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).select(F.xxhash64(F.lit(seed), id).alias("h"), F.col(truth).alias("t"), F.col(guess).alias("g"))

    def pairs(keys: list[str], name: str) -> DataFrame:
        def run(batches):
            total, now, w1, w2 = np.zeros(resamples), None, np.zeros(resamples), np.zeros(resamples)
            for batch in batches:
                k, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                bounds = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
                for i, j in zip(bounds, bounds[1:]):
                    if i == j:
                        continue
                    if k[i] != now:
                        total, now, w1, w2 = total + (w1 * w1 - w2) / 2, k[i], np.zeros(resamples), np.zeros(resamples)
                    for at in range(i, j, 2000):
                        w = poisson_weights(h[at : min(at + 2000, j)].astype(np.int64).view(np.uint64), resamples)
                        w1, w2 = w1 + w.sum(0), w2 + (w * w).sum(0)
            total = total + (w1 * w1 - w2) / 2
            yield pa.RecordBatch.from_pydict({"r": pa.array(range(resamples), pa.int32()), "p": total})

        placed = rows.select(F.xxhash64(*keys).alias("k"), "h").repartition("k").sortWithinPartitions("k")
        return placed.mapInArrow(run, "r int, p double").groupBy("r").agg(F.sum("p").alias(name))

    drawn = pairs(["t", "g"], "tp").join(pairs(["t"], "t"), "r").join(pairs(["g"], "g"), "r")
    share = lambda by: F.col("tp") / F.nullif(F.col(by), F.lit(0.0))
    per = drawn.select(share("g").alias("precision"), share("t").alias("recall"))
    point = pair_metrics(df, truth, guess)
    parts = [point.select(F.lit(m).alias("metric"), F.col(m).alias("value")).crossJoin(interval(per, m, level)) for m in ("precision", "recall")]
    return parts[0].union(parts[1])


def cross_validated_threshold(pairs: DataFrame, similarity: str, same: Column, fold: Column, step: float) -> DataFrame:
    """``fold``, ``threshold``, tp, fp, fn: for each fold the threshold with the best F1 on the others, and what it does on this one.

    Pairs are counted once per fold and step of the grid; all else is sums over that small table. Of equal thresholds the
    lowest is taken; true pairs below the lowest threshold of ``pairs`` aren't known here and don't count.
    """
    cell = F.floor(F.round(F.col(similarity) / step, 9)).cast("int")
    cells = pairs.groupBy(fold.alias("fold"), cell.alias("cell")).agg(F.count_if(same).alias("t"), F.count_if(~same).alias("f"))
    folds, grid = cells.select("fold").distinct(), cells.select("cell").distinct()
    own = folds.join(grid, F.lit(True)).join(cells, ["fold", "cell"], "left").fillna(0, subset=["t", "f"])
    above = Window.partitionBy("fold").orderBy(F.desc("cell"))
    mine = own.select("fold", "cell", F.sum("t").over(above).alias("tp"), F.sum("f").over(above).alias("fp"), F.sum("t").over(Window.partitionBy("fold")).alias("true"))
    every = mine.groupBy("cell").agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "true")])
    rest = mine.join(every, "cell").withColumns({f"o_{c}": F.col(f"all_{c}") - F.col(c) for c in ("tp", "fp", "true")})
    score = F.round(f1(F.col("o_tp"), F.col("o_fp"), F.col("o_true") - F.col("o_tp")), 12)
    best = rest.withColumn("score", score).groupBy("fold").agg(F.max(F.struct(F.coalesce("score", F.lit(-1.0)).alias("s"), (-F.col("cell")).alias("c"), "tp", "fp", "true")).alias("b"))
    return best.select("fold", F.round(-F.col("b.c") * step, 9).alias("threshold"), "b.tp", "b.fp", (F.col("b.true") - F.col("b.tp")).alias("fn"))


def stratified_sample(df: DataFrame, strata: list[str], id: str, quota: int, seed: str = "42") -> DataFrame:
    """Up to ``quota`` rows per stratum in the order of a salted hash, each with the weight that stands for its stratum."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(id).cast("string")), 256)
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("population"))
    picked = df.withColumn("__h", order).withColumn("k", F.row_number().over(Window.partitionBy(*strata).orderBy("__h", id))).where(F.col("k") <= quota).drop("__h")
    return picked.join(sizes, strata).withColumn("weight", F.col("population") / F.least("population", F.lit(quota)))


def majority(df: DataFrame, item: str, value: str) -> DataFrame:
    """Per item the value more than half of its labels agree on, else null and disputed."""
    counts = df.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(item).agg(F.max(F.struct("n", F.col(value).alias("v"))).alias("b"), F.sum("n").alias("total"))
    return best.select(item, F.when(2 * F.col("b.n") > F.col("total"), F.col("b.v")).alias("value"), F.col("total").alias("labels"), (2 * F.col("b.n") <= F.col("total")).alias("disputed"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with mean ranks for ties."""
    from telar.operators.tables import average_rank

    rows = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_rank(average_rank(rows, a, "ra"), b, "rb")
    return ranked.agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def plateau(df: DataFrame, x: str, score: str) -> DataFrame:
    """Of the thresholds with the best score the longest run in a row and its lower middle."""
    df = df.where(F.col(x).isNotNull() & F.col(score).isNotNull())
    best = df.agg(F.max(score).alias("__best"))
    at = places(df, [F.col(x)], "__k").crossJoin(F.broadcast(best)).where(F.col(score) == F.col("__best"))
    runs = places(at, [F.col(x)], "__j").withColumn("__g", F.col("__k") - F.col("__j")).groupBy("__g").agg(F.array_sort(F.collect_list(x)).alias("xs"), F.max(score).alias("score"))
    longest = runs.orderBy(F.desc(F.size("xs")), F.get("xs", F.lit(0))).limit(1)
    return longest.select(F.get("xs", F.lit(0)).alias("first"), F.element_at("xs", -1).alias("last"), F.get("xs", ((F.size("xs") - 1) / 2).cast("int")).alias("middle"), "score")


def threshold_sweep(pairs: DataFrame, similarity: str, same: Column, positives: DataFrame, step: float) -> DataFrame:
    """``threshold``, tp, fp, fn, precision, recall, f1 where a pair counts from the threshold on, on a grid of ``step``.

    ``pairs`` holds all pairs above the lowest threshold and ``positives`` one row with ``n``, the number of true ones.
    Pairs are counted once per step of the grid and the counts summed from the top, so pairs never meet thresholds.
    """
    cells = pairs.groupBy(F.floor(F.round(F.col(similarity) / step, 9)).cast("int").alias("cell")).agg(F.count_if(same).alias("t"), F.count_if(~same).alias("f"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell"))
    sums = cells.select("cell", F.sum("t").over(above).alias("tp"), F.sum("f").over(above).alias("fp")).crossJoin(F.broadcast(positives.select(F.col("n").alias("true"))))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("true") - F.col("tp")
    return sums.select(
        F.round(F.col("cell") * step, 9).alias("threshold"), "tp", "fp", fn.alias("fn"), (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"), (tp / F.nullif(F.col("true"), F.lit(0))).alias("recall"), f1(tp, fp, fn).alias("f1")
    )


def best_threshold(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """The cut between two neighbouring scores with the fewest errors, of several the widest gap, then the lowest: cut, errors, margin."""
    levels = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    totals = levels.agg(F.sum("n").alias("negatives"))
    upto = running_before(running_before(levels, [F.col("s")], F.col("p"), "pb"), [F.col("s")], F.col("n"), "nb")
    # Cutting just below s: positives below it and negatives from it on are errors.
    errors = upto.crossJoin(F.broadcast(totals)).withColumn("errors", F.col("pb") + F.col("negatives") - F.col("nb"))
    before = places(levels.select("s"), [F.col("s")], "k")
    lower = before.select((F.col("k") + 1).alias("k"), F.col("s").alias("low"))
    gaps = before.join(lower, "k").select("s", "low")
    return errors.join(gaps, "s").select(((F.col("s") + F.col("low")) / 2).alias("cut"), "errors", ((F.col("s") - F.col("low")) / 2).alias("margin")).orderBy("errors", F.desc("margin"), "cut").limit(1)


def leave_one_out(df: DataFrame, score: str, positive: Column, most: int = 5000) -> DataFrame:
    """One row: ``n``, ``errors`` and ``accuracy`` when each row is judged by the cut that ``best_threshold`` finds without it.

    Rows of one score and class are alike and judged once. For sets of labelled cases: more than ``most`` different
    scores raise, as the cuts are tried on the driver. Without a second score there is no cut and every row is an error.
    """
    levels = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).limit(most + 1).collect()
    if len(levels) > most:
        raise ValueError(f"more than {most} different scores")
    levels = sorted((r.s, r.p, r.n) for r in levels)
    total = wrong = 0
    for i, (s, p, n) in enumerate(levels):
        for count, side in ((p, 1), (n, 0)):
            if count:
                total += count
                rest = [(a, b - (side if j == i else 0), c - (1 - side if j == i else 0)) for j, (a, b, c) in enumerate(levels)]
                cut = _best_cut(np.array([r for r in rest if r[1] + r[2]]))
                wrong += count * (cut is None or (s >= cut) != bool(side))
    return df.sparkSession.createDataFrame([(total, wrong, 1 - wrong / total if total else None)], "n bigint, errors bigint, accuracy double")


def _best_cut(levels: np.ndarray) -> float | None:
    """The cut with the fewest errors, of several the widest gap, then the lowest."""
    if len(levels) < 2:
        return None
    s, p, n = levels.T
    errors = np.cumsum(p)[:-1] + n.sum() - np.cumsum(n)[:-1]
    gaps, cuts = s[1:] - s[:-1], (s[1:] + s[:-1]) / 2
    return float(cuts[np.lexsort((cuts, -gaps, errors))[0]])
