"""Operators on keyed tables: merging, deduplication, completion, comparison, modal values, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.functions.stats import wilson
from telar.operators.prefix import places, running_before
from telar.session import cut


def merge_first_non_null(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key: of each column the first value that isn't null in the given order.

    A minimum over (order, value) structs per column: partial aggregation, no sort of a key's rows.
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(c).alias("v"))))["v"]
    return df.groupBy(*keys).agg(*[first(c).alias(c) for c in columns])


def keep_fullest(df: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """Of each key the whole row with the fewest nulls; ties by the given columns, nulls last. Nothing is cross-filled."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    order = [nulls.alias("n")] + [x for i, c in enumerate(ties) for x in (F.col(c).isNull().alias(f"t{i}"), F.col(c).alias(f"v{i}"))]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def union_tokens(column: Column, separator: str, preferred: list[str] | None = None) -> Column:
    """Aggregate: all tokens of a delimited column without repeats, preferred ones first, then in order."""
    tokens = F.array_distinct(F.flatten(F.collect_set(F.split(column, f"[{separator}]"))))
    clean = F.filter(F.transform(tokens, lambda x: F.trim(x)), lambda x: x != "")
    rank = F.array(*map(F.lit, preferred or []))
    place = lambda x: F.coalesce(F.nullif(F.array_position(rank, x), F.lit(0)), F.lit(1 << 30)) if preferred else F.lit(0)
    ordered = F.array_sort(F.transform(F.array_distinct(clean), lambda x: F.struct(place(x).alias("p"), x.alias("x"))))
    return F.array_join(F.transform(ordered, lambda s: s["x"]), separator)


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent non-null value per key, ties to the smallest, with its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(*keys, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def zero_filled(df: DataFrame, key: str, dimension: DataFrame) -> DataFrame:
    """Counts over a fixed dimension, 0 where there is no row."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dimension.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls and distinct values, all columns in one pass."""
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns], *[F.countDistinct(c).alias(f"d_{c}") for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("columna"), F.col(f"n_{c}").alias("nulos"), F.col(f"d_{c}").alias("distintos")) for c in df.columns])
    return facts.select("rows", F.explode(rows).alias("r")).select("r.columna", F.col("rows").alias("filas"), "r.nulos", "r.distintos")


def concentration(df: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` most frequent values with count, share of all rows and Wilson interval; ties by value."""
    counts = df.groupBy(F.coalesce(F.col(key), F.lit("(nulo)")).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    low, high = wilson(F.col("n"), F.col("total"))
    best = counts.orderBy(F.desc("n"), key).limit(top)
    return best.crossJoin(total).select(key, "n", "total", (F.col("n") / F.col("total")).alias("share"), low.alias("low"), high.alias("high"))


def complete_grid(dimensions: list[DataFrame], values: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of the (small, fixed) dimensions with its values; what is missing is null, never 0."""
    return reduce(DataFrame.crossJoin, dimensions).join(values, keys, "left")


def changed_values(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both versions whose values differ, null-safely: key, column, old and new value as text."""
    both = old.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns]).join(new.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns]), keys)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("string").alias("old"), F.col(f"b_{c}").cast("string").alias("new")) for c in columns])
    return both.select(*keys, F.explode(pairs).alias("p")).where(~F.col("p.old").eqNullSafe(F.col("p.new"))).select(*keys, "p.*")


def version_diff(old: DataFrame, new: DataFrame, key: str, print_column: str) -> DataFrame:
    """Full outer comparison of fingerprints: key and ``new``, ``missing``, ``changed`` or ``equal``."""
    a, b = old.select(key, F.col(print_column).alias("a")), new.select(key, F.col(print_column).alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed").otherwise("equal")
    return a.join(b, key, "full").select(key, state.alias("state"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by the given columns: a maximum, not a window."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def first_valid(df: DataFrame, valid: Column, keys: list[str], order: str) -> DataFrame:
    """``df`` with ``repeated``: a valid row whose key an earlier valid row has; invalid rows use no key up."""
    firsts = df.where(valid).groupBy(*keys).agg(F.min(order).alias("__first"))
    return df.join(firsts, keys, "left").withColumn("repeated", F.coalesce(valid & (F.col(order) > F.col("__first")), F.lit(False))).drop("__first")


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place at which each is first seen."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; columns missing on one side are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update_columns(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with the given columns taken from ``changes`` where there is a row for the key."""
    renamed = changes.select(*keys, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(renamed, keys, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def evolve(df: DataFrame, schema) -> DataFrame:
    """Additive schema evolution: missing columns come as typed nulls, at the end and in the schema's order."""
    missing = [f for f in schema.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def cross_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Contingency table with one column per value, 0 where there is none."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0, subset=values)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, minimum, median, maximum, mean and population deviation per key."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def anchored_split(df: DataFrame, keys: list[str], time: str, id: str, days: int) -> DataFrame:
    """``keys``, ``id``, ``part``: a new part begins where a row lies more than ``days`` days after the part's first row.

    The border is inclusive. Rows without time are in part 1. Time is cut into cells of ``days`` days. Each distinct moment
    points to the first one more than ``days`` days later, which lies in the next cell or opens the one after; the parts'
    first moments are those reached from a key's first by such steps, found by doubling them. A task holds one key's
    moments in one cell; windows over a key see one row per cell.
    """
    span = days * 86_400_000_000
    names = [f"__a{i}" for i in range(len(keys))]
    cell = lambda t: F.floor(F.col(t) / span).cast("long")
    rows = df.select(*keys, id, F.struct(*[F.col(k).alias(n) for k, n in zip(keys, names)]).alias("__k"), F.unix_micros(F.col(time)).alias("__t")).withColumn("__c", cell("__t"))
    moments = cut(rows.where("__t is not null").select("__k", "__t", "__c").distinct())
    by_key = Window.partitionBy("__k").orderBy("__c")
    cells = cut(
        moments.groupBy("__k", "__c").agg(F.min("__t").alias("__first"))
        .withColumn("__far", F.when(F.lead("__c").over(by_key) > F.col("__c") + 1, F.lead("__first").over(by_key)).otherwise(F.lead("__first", 2).over(by_key)))
    )
    # In order of falling time the last moment seen before a row that asks is the first one after it.
    asks = moments.select("__k", (F.col("__t") + span).alias("__at"), (F.col("__c") + 1).alias("__c"), F.lit(0).alias("__m"), "__t")
    both = asks.union(moments.select("__k", F.col("__t").alias("__at"), "__c", F.lit(1).alias("__m"), "__t"))
    down = Window.partitionBy("__k", "__c").orderBy(F.desc("__at"), "__m")
    near = both.withColumn("__near", F.min(F.when(F.col("__m") == 1, F.col("__t"))).over(down.rowsBetween(Window.unboundedPreceding, 0))).where("__m = 0")
    far = cells.select("__k", (F.col("__c") + 1).alias("__c"), "__far")
    steps = cut(near.join(far, ["__k", "__c"]).select("__k", "__t", F.coalesce("__near", "__far").alias("__to")).where("__to is not null"))
    reached = cut(moments.groupBy("__k").agg(F.min("__t").alias("__t")))
    while True:
        new = cut(reached.join(steps, ["__k", "__t"]).select("__k", F.col("__to").alias("__t")).join(reached, ["__k", "__t"], "left_anti").distinct())
        if new.isEmpty():
            break
        reached = cut(reached.union(new))
        ahead = steps.select("__k", F.col("__t").alias("__to"), F.col("__to").alias("__next"))
        steps = cut(steps.join(ahead, ["__k", "__to"]).select("__k", "__t", F.col("__next").alias("__to")))
    # A cell holds one beginning at most.
    begun = cells.select("__k", "__c").join(reached.select("__k", F.col("__t").alias("__begin"), cell("__t").alias("__c")), ["__k", "__c"], "left")
    before = F.coalesce(F.count("__begin").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(begun.withColumn("__before", before), ["__k", "__c"], "left")
    part = F.col("__before") + F.coalesce((F.col("__begin") <= F.col("__t")).cast("int"), F.lit(0))
    return placed.select(*keys, id, F.when(F.col("__t").isNull(), 1).otherwise(part.cast("int")).alias("part"))


def day_islands(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive days per key: first and last day and length."""
    w = Window.partitionBy(*keys).orderBy(day)
    days = df.select(*keys, F.to_date(day).alias(day)).where(F.col(day).isNotNull()).distinct()
    run = days.withColumn("__g", F.date_sub(F.col(day), F.row_number().over(w)))
    return run.groupBy(*keys, "__g").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("days")).drop("__g")


def within_interval(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Inner join on key and times at most so many seconds apart: an equi-join on time cells of that width, three per row.

    Each left row is sent to its own cell and both neighbours, so that a hot key spreads over its cells.
    """
    cell = lambda c: F.floor(F.unix_timestamp(F.col(c)) / seconds).cast("long")
    a = left.withColumn("__cell", F.explode(F.sequence(cell(left_time) - 1, cell(left_time) + 1)))
    b = right.withColumn("__cell", cell(right_time))
    near = F.abs(F.unix_micros(F.col(left_time)) - F.unix_micros(F.col(right_time))) <= seconds * 1_000_000
    return a.join(b, [key, "__cell"]).where(near).drop("__cell")


def rank_with_ties(df: DataFrame, score: str, second: str, id: str, decimals: int = 1, second_decimals: int = 9) -> DataFrame:
    """``position`` by rounded score and second score, both descending, then id; ``ties``: others with the same rounded score. A null score comes last.

    Positions are places in ranges of the whole order and ties counts per rounded score, so that no task sees the whole
    table or all rows of one score.
    """
    shown, then = F.coalesce(F.round(F.col(score).cast("double"), decimals), F.lit(float("-inf"))), F.round(F.col(second), second_decimals)
    levels = df.groupBy(shown.alias("__s")).agg((F.count(F.lit(1)) - 1).alias("ties"))
    last = F.coalesce(-then, F.lit(float("inf")))
    return places(df.withColumn("__s", shown), [-shown, last, F.col(id)], "position").join(levels, "__s").drop("__s")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and interpolated percentiles by name, exact: from counts per value, so that no task holds a group's values.

    Null values are left out; a group without others gives no row. Equal values are one row from the start.
    """
    names = [f"__g{i}" for i in range(len(keys))]
    levels = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    order = [o for n in names for o in (F.col(n).isNull(), F.col(n))]
    at = cut(running_before(levels, [*order, F.col("__v")], F.col("__n"), "__b"))
    sizes = at.groupBy(*names).agg(F.min("__b").alias("__first"), F.sum("__n").alias("__all")).select(*[F.col(n).alias(f"j{n}") for n in names], "__first", "__all")
    same = reduce(lambda c, n: c & F.col(n).eqNullSafe(F.col(f"j{n}")), names, F.lit(True))
    rows = at.join(sizes, same).withColumn("__from", F.col("__b") - F.col("__first"))
    place = lambda q: (F.col("__all") - 1) * F.lit(q)
    here = lambda i: F.when((F.col("__from") <= i) & (i < F.col("__from") + F.col("__n")), F.col("__v"))
    ends = [F.max(here(end(place(q)))).alias(f"{n}_{k}") for n, q in shares.items() for k, end in (("low", F.floor), ("high", F.ceil))]
    found = rows.groupBy(*names).agg(F.first("__all").alias("__all"), *ends)
    between = lambda n, p: (F.ceil(p) - p) * F.col(f"{n}_low") + (p - F.floor(p)) * F.col(f"{n}_high")
    value_at = lambda n, q: F.when(F.col(f"{n}_low") == F.col(f"{n}_high"), F.col(f"{n}_low")).otherwise(between(n, place(q)))
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[value_at(n, q).alias(n) for n, q in shares.items()])


def tie_at_cut(df: DataFrame, score: str, k: int) -> DataFrame:
    """Value at the k-th place, rows with that value, and how many of them lie inside and outside of the cut."""
    best = df.orderBy(F.desc(score)).limit(k)
    edge = best.agg(F.min(score).alias("value"))
    inside = best.join(F.broadcast(edge), F.col(score) == F.col("value")).groupBy("value").agg(F.count(F.lit(1)).alias("inside"))
    every = df.join(F.broadcast(edge), F.col(score) == F.col("value")).groupBy("value").agg(F.count(F.lit(1)).alias("tied"))
    return every.join(inside, "value").withColumn("outside", F.col("tied") - F.col("inside"))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with fractional ranks: ties share the mean of their places; rows of null value are left out. Ranks come from counts per value."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running_before(counts, [F.col("__v")], F.col("__n"), "__before").select("__v", (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("__v")).drop("__v")
