"""Continuous periods and gaps of overlapping time ranges.

``session_window`` with a duration of its own per row merges overlapping and nested ranges natively. It runs
within (key, slice of time), so that a key that holds a third of all rows spreads over as many tasks as it has
slices; what crosses the border of a slice is carried over in one small row per (key, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.session import cut

MICROS_DAY = 86_400_000_000


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, slice_days: int = 7) -> DataFrame:
    """Maximal covered periods and the gaps between consecutive ones, per key.

    Returns ``keys``, ``kind`` (``period`` or ``gap``) and the timestamps ``start`` and ``end``.

    * Ranges that overlap, nest or touch belong to one period; a gap is what lies between two consecutive periods.
    * Rows without start or end, or whose end isn't after the start, are left out. A null key is a key of its own.
    * Ranges with the same start are reduced to the longest before the shuffle; repeated rows change nothing.
    * An empty table gives an empty result; other columns of ``df`` are ignored, whatever their names.

    ``slice_days`` bounds what one task holds: the distinct starts of one key within one slice. The windows by key
    alone see one row per slice, not per range. Merged ranges are written to the checkpoint folder twice, so that each
    step reads them instead of merging again.
    """
    # One key that is never null: its fields may be, and two nulls are equal, so that joins need no other key.
    ranges = (
        df.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"))
        .where("__s is not null and __e is not null and __e > __s")
        .groupBy("__k", "__s")
        .agg(F.max("__e").alias("__e"))
        .withColumn("__slice", F.floor(_micros("__s") / (slice_days * MICROS_DAY)).cast("long"))
    )
    span = (_micros("__e") - _micros("__s")).cast("decimal(24,6)") / F.lit(1_000_000)
    in_slice = Window.partitionBy("__k", "__slice").orderBy("__s")
    by_key = Window.partitionBy("__k").orderBy("__slice")
    before = in_slice.rowsBetween(Window.unboundedPreceding, -1)
    # Touching sessions stay apart in some releases: the running end within the slice joins them.
    local = cut(
        ranges.withColumn("__gap", F.make_interval(secs=span.cast("decimal(18,6)")))
        .groupBy("__k", "__slice", F.session_window("__s", F.col("__gap")).alias("__w"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__k", "__slice", F.col("__w.start").alias("__s"), F.col("__w.end").alias("__e"))
        .withColumn("__before", F.max("__e").over(before))
    )
    carried = (
        local.groupBy("__k", "__slice").agg(F.max("__e").alias("__max"))
        .withColumn("__carry", F.max("__max").over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
    )
    opened = cut(
        local.join(carried.hint("merge"), ["__k", "__slice"])
        .withColumn("__prev", F.greatest("__before", "__carry"))
        .withColumn("__top", F.greatest("__max", "__carry"))
        .withColumn("__opens", F.col("__prev").isNull() | (F.col("__s") > F.col("__prev")))
        .select("__k", "__slice", "__s", "__prev", "__top", "__opens")
    )
    # A slice that opens no period passes on; __first is the end of the period before the slice's first opening.
    slices = (
        opened.groupBy("__k", "__slice")
        .agg(F.min(F.when(F.col("__opens"), F.struct("__s", "__prev"))).alias("__first"), F.max("__top").alias("__top"))
        .withColumn("__next", F.first("__first", ignorenulls=True).over(by_key.rowsBetween(1, Window.unboundedFollowing)))
        .withColumn("__last", F.max("__top").over(by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("__k", "__slice", F.coalesce("__next.__prev", "__last").alias("__after"))
    )
    periods = opened.where("__opens").withColumn("__here", F.lead("__prev").over(in_slice)).join(slices.hint("merge"), ["__k", "__slice"])
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("__s").alias("start"), F.coalesce("__here", "__after").alias("end")),
        F.struct(F.lit("gap").alias("kind"), F.col("__prev").alias("start"), F.col("__s").alias("end")),
    )
    return (
        periods.select("__k", F.explode(rows).alias("__r"))
        .where("__r.start is not null")
        .select(*[F.col(f"__k.k{i}").alias(k) for i, k in enumerate(keys)], "__r.kind", "__r.start", "__r.end")
    )


def coverage_report(df: DataFrame, keys: list[str], start: str, end: str, **options: int) -> DataFrame:
    """Per key: number of periods and gaps, covered and uncovered seconds, and the longest gap in seconds."""
    seconds = (F.unix_micros("end") - F.unix_micros("start")) / 1_000_000
    return merge_intervals(df, keys, start, end, **options).groupBy(*keys).agg(
        F.count_if(F.col("kind") == "period").alias("n_periods"),
        F.count_if(F.col("kind") == "gap").alias("n_gaps"),
        F.coalesce(F.sum(F.when(F.col("kind") == "period", seconds)), F.lit(0.0)).alias("covered_s"),
        F.coalesce(F.sum(F.when(F.col("kind") == "gap", seconds)), F.lit(0.0)).alias("gap_s"),
        F.coalesce(F.max(F.when(F.col("kind") == "gap", seconds)), F.lit(0.0)).alias("longest_gap_s"),
    )
