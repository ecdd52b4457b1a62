"""Checks, dependencies between claims, review logs, cost caps, coverage accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.session import cut


def check_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check with the number of rows that break it and its state, all in one pass; null counts as broken."""
    broken = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"b{i}") for i, c in enumerate(checks.values())], F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"b{i}").alias("broken")) for i, name in enumerate(checks)])
    return broken.select("n", F.explode(rows).alias("r")).select("r.check", F.coalesce("r.broken", F.lit(0)).alias("broken"), "n", F.when(F.coalesce("r.broken", F.lit(0)) == 0, "ok").otherwise("error").alias("state"))


def set_differences(sets: dict[str, DataFrame]) -> DataFrame:
    """``only_in``, ``not_in``, ``value`` for each two of several one-column sets."""
    named = {n: d.select(F.col(d.columns[0]).alias("value")).where("value is not null").distinct() for n, d in sets.items()}
    out = [a.subtract(b).select(F.lit(x).alias("only_in"), F.lit(y).alias("not_in"), "value") for x, a in named.items() for y, b in named.items() if x != y]
    return reduce(DataFrame.union, out)


def fallen(claims: DataFrame, edges: DataFrame, id: str, fails: str) -> DataFrame:
    """``id``, ``falls``: claims that fail themselves, or whose base (``edges``: claim, base) falls, to the fixpoint.

    A base that isn't there falls. Claims with one base are followed by pointer doubling, so rounds grow as the logarithm
    of the chain; only claims with several bases take a round for each one that rests on another. Rounds have no limit,
    and cycles end too.
    """
    ids = claims.select(F.col(id).alias("claim")).distinct()
    edges = cut(edges.select("claim", "base").distinct())
    missing = edges.join(ids.select(F.col("claim").alias("base")), "base", "left_anti").select("base")
    own = claims.where(F.col(fails)).select(F.col(id).alias("claim")).union(missing).distinct().withColumn("bad", F.lit(True))
    alone = edges.groupBy("claim").agg(F.min("base").alias("top"), F.count(F.lit(1)).alias("n"))
    single = alone.where("n = 1").select("claim", "top")
    ends = single.select(F.col("claim").alias("top"), F.lit(True).alias("more"))
    # bad: something from the claim up to, but without, its top fails; more: the top has one base itself.
    paths = cut(
        single.join(own, "claim", "left").join(ends, "top", "left")
        .select("claim", "top", F.coalesce("bad", F.lit(False)).alias("bad"), F.coalesce("more", F.lit(False)).alias("more"))
    )
    # After as many doublings as the number of claims has bits, a path without end is a cycle that has been seen whole.
    for _ in range(paths.count().bit_length()):
        going = paths.where("more")
        if going.isEmpty():
            break
        on = paths.select(F.col("claim").alias("top"), F.col("top").alias("next"), F.col("bad").alias("b"), F.col("more").alias("m"))
        ahead = going.join(on, "top").select("claim", F.col("next").alias("top"), (F.col("bad") | F.col("b")).alias("bad"), F.col("m").alias("more"))
        paths = cut(paths.where("not more").union(ahead))
    # What is left: claims with several bases, each base replaced by its path's top.
    several = edges.join(alone.where("n > 1").select("claim"), "claim", "left_semi")
    met = several.join(paths.select(F.col("claim").alias("base"), "top", F.col("bad").alias("b")), "base", "left")
    met = cut(met.select("claim", F.coalesce("top", "base").alias("base"), F.coalesce("b", F.lit(False)).alias("b")))
    new = cut(own.select("claim").union(met.where("b").select("claim")).distinct())
    gone = new
    while not met.isEmpty():
        reached = met.join(new.select(F.col("claim").alias("base")), "base").select("claim").distinct()
        new = cut(reached.join(gone, "claim", "left_anti"))
        if new.isEmpty():
            break
        gone = cut(gone.union(new))
    down = paths.join(gone.select(F.col("claim").alias("top"), F.lit(True).alias("hit")), "top", "left").where("bad or hit").select("claim")
    gone = gone.select("claim").union(down).distinct()
    return ids.join(gone.withColumn("hit", F.lit(True)), "claim", "left").select(F.col("claim").alias(id), F.coalesce("hit", F.lit(False)).alias("falls"))


def bases(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``claim``, ``base``: the transitive closure, by joining paths with themselves, so that rounds grow as the logarithm of the depth."""
    paths = cut(edges.select("claim", "base").distinct())
    size = paths.count()
    for _ in range(max_rounds):
        longer = paths.join(paths.select(F.col("claim").alias("base"), F.col("base").alias("b2")), "base").select("claim", F.col("b2").alias("base"))
        paths = cut(paths.union(longer).distinct())
        grown = paths.count()
        if grown == size:
            return paths
        size = grown
    raise RuntimeError(f"no closure after {max_rounds} rounds")


def widened_window(df: DataFrame, base: Column, end: Column, days: int, wider: int, least: int) -> DataFrame:
    """``df`` with ``used_days`` and ``excluded`` (null, ``sin_fecha``, ``fuera_de_ventana``): the wider window where the first holds too few rows."""
    age = (F.unix_timestamp(end) - F.unix_timestamp(base)) / 86400
    enough = df.agg((F.count_if((age >= 0) & (age <= days)) >= least).alias("e"))
    used = F.when(F.col("e"), F.lit(days)).otherwise(F.lit(wider))
    reason = F.when(base.isNull(), "sin_fecha").when((age < 0) | (age > used), "fuera_de_ventana")
    return df.crossJoin(F.broadcast(enough)).withColumn("used_days", used).withColumn("excluded", reason).drop("e")


def under_cap(df: DataFrame, keys: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """``df`` with ``spent_before`` and ``allowed``: a row is allowed while what was spent before it is below the cap."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("spent_before", before).withColumn("allowed", before < cap)


def first_reason(df: DataFrame, keys: list[str], reason: str, precedence: list[str]) -> DataFrame:
    """The reason of highest precedence per key; reasons that aren't listed come last, in order."""
    rank = reduce(lambda c, p: F.when(F.col(reason) == p[1], p[0]).otherwise(c), reversed(list(enumerate(precedence))), F.lit(len(precedence)))
    return df.where(F.col(reason).isNotNull()).groupBy(*keys).agg(F.min(F.struct(rank.alias("r"), F.col(reason).alias("v")))["v"].alias(reason))


def transitions(log: DataFrame, keys: list[str], order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Rows of an append-only log with the state before and whether that change is allowed; the first may be any."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    fits = reduce(lambda c, p: c | ((before == p[0]) & (F.col(state) == p[1])), allowed, before.isNull())
    return log.withColumn("before", before).withColumn("allowed", F.coalesce(fits, F.lit(False)))


def new_rejections(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rejections that are new, as a difference of multisets."""
    return after.exceptAll(before.select(*after.columns))


def inject(df: DataFrame, extra: DataFrame, key: str, prefix: str) -> DataFrame:
    """Synthetic rows (keys with the prefix) put in anew: those that are there are replaced, so running twice changes nothing."""
    return df.where(F.col(key).isNull() | ~F.startswith(F.col(key), F.lit(prefix))).unionByName(extra, allowMissingColumns=True)


def secret_scan(df: DataFrame, columns: list[str], patterns: dict[str, str]) -> DataFrame:
    """``column``, ``pattern``, ``hits`` of text columns that hold something like a secret."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    rows = df.select(F.explode(cells).alias("c")).where("c.v is not null")
    found = F.array_compact(F.array(*[F.when(F.col("c.v").rlike(p), F.lit(n)) for n, p in patterns.items()]))
    return rows.select("c.column", F.explode(found).alias("pattern")).groupBy("column", "pattern").agg(F.count(F.lit(1)).alias("hits"))


def conflicting_values(df: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """Pairs of different values of one unit within a group, one row per pair of values with how many rows stand behind each.

    Equal values are one class first, so copies are no pairs.
    """
    classes = df.where(F.col(value).isNotNull() & (F.col(unit) != "")).groupBy(*keys, unit, value).agg(F.count(F.lit(1)).alias("n"))
    other = classes.select(*keys, unit, F.col(value).alias("other"), F.col("n").alias("n_other"))
    apart = F.abs(F.col(value) - F.col("other")) > 1e-9 * F.greatest(F.abs(F.col(value)), F.abs(F.col("other")))
    return classes.join(other, [*keys, unit]).where((F.col(value) < F.col("other")) & apart)
