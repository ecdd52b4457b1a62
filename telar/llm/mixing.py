"""Mixing sources to target weights by Poisson replication.

Each document draws its number of copies by inverting, at a uniform number hashed from its id, the Poisson
distribution whose mean is its source's repetition rate, capped at the source's maximum. The rate of each source, and
the seed by which its numbers are shifted, are calibrated on sums over all its documents, so that the drawn tokens meet
the target and not just their expectation, however few and uneven the documents are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _uniform(seed: int, *columns: str) -> Column:
    """A hash-seeded number in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_inverse(u: np.ndarray, rate: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """min(cap, smallest k whose Poisson(rate) distribution function reaches u); an infinite rate gives the cap."""
    u, rate, cap = np.broadcast_arrays(u, rate, cap)
    with np.errstate(invalid="ignore"):
        term = np.exp(-np.where(np.isfinite(rate), rate, 0.0))
        below, k = term.copy(), np.zeros(u.shape, np.int64)
        for step in range(1, int(cap.max(initial=0)) + 1):
            k += (u > below) & (k == step - 1)
            term = term * np.where(np.isfinite(rate), rate, 0.0) / step
            below = below + term
    return np.where(np.isfinite(rate), np.minimum(k, cap), cap)


def _expected(rate: np.ndarray, cap: int) -> np.ndarray:
    """Mean of min(cap, Poisson(rate)): the sum over k < cap of P(X > k)."""
    term, below, mean = np.exp(-rate), np.exp(-rate), np.zeros_like(rate)
    for k in range(cap):
        mean += 1 - below
        term = term * rate / (k + 1)
        below = below + term
    return mean


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose draw, capped, has the given mean; infinite if that takes every copy allowed."""
    if mean >= cap * (1 - 1e-9):
        return float("inf")
    low, high = 0.0, 1.0
    while _expected(np.array([high]), cap)[0] < mean:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _expected(np.array([middle]), cap)[0] < mean else (low, middle)
    return high


def plan(sources: pd.DataFrame, total: float | None = None) -> pd.DataFrame:
    """Target tokens, rate and what limits each source, from ``tokens``, ``weight`` and ``cap``.

    Sources without tokens can't contribute: the weights of the others are scaled up to one. ``total`` defaults to the
    largest size at which every other source meets its weight within its cap. At a larger one the sources that don't
    reach theirs are used up to their caps, and the others share the rest by their weights, as far as their caps go.
    ``limit`` is ``empty``, ``weight`` or ``cap`` for sources that can't meet their share, and null for the others.
    """
    out = sources.copy()
    able = (out["tokens"] > 0) & (out["weight"] > 0) & (out["cap"] > 0)
    share = out["weight"].where(able, 0.0)
    share = share / share.sum() if share.sum() > 0 else share
    room = (out["cap"] * out["tokens"]).where(able, 0.0)
    if total is None:
        total = float((room / share.where(able)).min()) if able.any() else 0.0
    target, open_, left = np.zeros(len(out)), able.to_numpy().copy(), float(min(total, room.sum()))
    while open_.any():
        each = np.where(open_, share / share[open_].sum() * left, 0.0)
        full = open_ & (each > room.to_numpy() * (1 + 1e-12))
        if not full.any():
            target[open_] = each[open_]
            break
        target[full] = room[full]
        left -= float(room[full].sum())
        open_ &= ~full
    out["target"] = np.minimum(target, room)
    out["rate"] = [rate_for(t / n, int(c)) if t > 0 else 0.0 for t, n, c in zip(out["target"], out["tokens"], out["cap"])]
    out["limit"] = np.where(out["tokens"] <= 0, "empty", np.where(~able, "weight", np.where(out["target"] < share * total * (1 - 1e-9), "cap", "")))
    return out


def mix(
    df: DataFrame, targets: DataFrame, id: str, source: str, size: str, target_source: str, weight: str, cap: str,
    total: float | None = None, seed: int = 17, steps: int = 33, rounds: int = 3, shifts: int = 8, max_sources: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """(mixed rows, report). Rows: the columns of ``df`` plus ``mix_copy`` (from 1) and ``mix_order``, globally shuffled.

    * A source contributes its weight of all tokens; no row is used more than its source's cap. See ``plan`` for sources
      without documents and for the default total.
    * Rows of other sources, of null source, and of null or no size take no part. Repeated rows draw the same number
      of copies. Repeated targets of a source count once, by the largest weight. An empty table gives an empty mix.
    * The report has a row per target source: its weight (``target_share``), the share it can have of this mix
      (``effective_share``), the one it has (``actual_share``), what keeps it from its weight (``reason``: ``empty``,
      ``weight`` or ``cap``), tokens, documents, copies and largest repetition, and documents and tokens not used.

    Only totals per target source (at most ``max_sources``, checked) come to the driver. Each calibration round is one
    aggregation that tries ``steps`` rates per source over all its rows, the first one at ``shifts`` seeds.
    """
    spark = df.sparkSession
    wanted = (
        targets.where(F.col(target_source).isNotNull()).groupBy(F.col(target_source).alias("mix_source"))
        .agg(F.max(F.col(weight)).alias("mix_weight"), F.max(F.col(cap)).cast("int").alias("mix_cap"))
    )
    known = wanted.limit(max_sources + 1).toPandas()
    if len(known) > max_sources:
        raise ValueError(f"more than {max_sources} target sources")
    names = known["mix_source"].tolist()
    drawn = df.where(F.col(source).isin(names) & (F.col(size) > 0)).withColumn("mix_u", _uniform(seed, id)) if names else df.where("false").withColumn("mix_u", F.lit(0.5))
    slim = drawn.select(F.col(source).alias("s"), F.col(size).cast("double").alias("n"), "mix_u")
    totals = slim.groupBy("s").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")).toPandas()
    state = known.merge(totals, how="left", left_on="mix_source", right_on="s").fillna({"tokens": 0.0, "docs": 0, "mix_weight": 0.0, "mix_cap": 0})
    state = state.rename(columns={"mix_weight": "weight", "mix_cap": "cap"})
    state = plan(state, total)
    finite = np.isfinite(state["rate"]) & (state["rate"] > 0)
    low, high = state["rate"] * 0.0, state["rate"] * 2.0
    state["shift"] = 0.0
    # Fixed value: the golden ratio's fraction spreads the seeds evenly.
    tried = [i * 0.6180339887498949 % 1 for i in range(max(shifts, 1))]
    for turn in range(rounds):
        trial = {
            r.mix_source: (np.linspace(l, h, steps), np.array(tried if turn == 0 else [r.shift]), int(r.cap))
            for r, l, h, ok in zip(state.itertuples(), low, high, finite) if ok
        }
        if not trial:
            break
        sums = _trial_sums(slim.where(F.col("s").isin(list(trial))), trial)
        for i, name in enumerate(state["mix_source"]):
            if name not in trial:
                continue
            rates, seeds, _ = trial[name]
            got = sums.get(name, np.zeros((len(seeds), steps)))
            best = np.unravel_index(np.argmin(np.abs(got - state.at[i, "target"])), got.shape)
            state.at[i, "shift"], state.at[i, "rate"] = seeds[best[0]], rates[best[1]]
            low[i], high[i] = rates[max(best[1] - 1, 0)], rates[min(best[1] + 1, steps - 1)]
    rates = spark.createDataFrame(
        [
            (r.mix_source, float(r.rate), float(r.shift), int(r.cap), float(r.weight), float(r.target / max(state["target"].sum(), 1.0)), r.limit or None, int(r.docs), int(r.tokens))
            for r in state.itertuples()
        ],
        "mix_source string, mix_rate double, mix_shift double, mix_cap int, mix_weight double, mix_share double, mix_limit string, mix_docs bigint, mix_tokens bigint",
    )

    def copies(u: pa.Array, rate: pa.Array, most: pa.Array) -> pa.Array:
        return pa.array(poisson_inverse(*(x.to_numpy(zero_copy_only=False) for x in (u, rate, most))).astype("int32"), pa.int32())

    known_rates = rates.select("mix_source", "mix_rate", "mix_shift", "mix_cap")
    counted = drawn.join(F.broadcast(known_rates), F.col(source) == F.col("mix_source")).withColumn(
        "mix_copies", F.arrow_udf(copies, T.IntegerType())((F.col("mix_u") + F.col("mix_shift")) % 1, "mix_rate", "mix_cap")
    )
    used = counted.where("mix_copies > 0")
    actual = used.groupBy("mix_source").agg(
        F.sum(F.col(size) * F.col("mix_copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"),
        F.sum("mix_copies").alias("copies"), F.max("mix_copies").alias("most_copies"), F.sum(size).alias("once"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    report = (
        rates.join(actual, "mix_source", "left")
        .select(
            F.col("mix_source").alias("source"), F.col("mix_weight").alias("target_share"), F.col("mix_share").alias("effective_share"), F.col("mix_limit").alias("reason"),
            zero("tokens"), zero("documents"), zero("copies"), zero("most_copies"), F.col("mix_cap").alias("cap"),
            (F.col("mix_docs") - F.coalesce("documents", F.lit(0))).alias("unused_documents"), (F.col("mix_tokens") - F.coalesce("once", F.lit(0))).cast("bigint").alias("unused_tokens"),
        )
        .withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)), F.lit(0.0)))
    )
    rows = (
        used.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
        .withColumn("mix_order", F.xxhash64(F.lit(seed), F.lit("order"), id, "mix_copy"))
        .select(*[F.col(c) for c in df.columns], "mix_copy", "mix_order").sort("mix_order")
    )
    return rows, report


def _trial_sums(slim: DataFrame, trial: dict[str, tuple[np.ndarray, np.ndarray, int]]) -> dict[str, np.ndarray]:
    """[seed, rate] tokens each source would give at each of its trial seeds and rates, summed over all rows in one pass."""

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            s = batch.column(0)
            n, u = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for name in pc.unique(s).to_pylist():
                own = pc.equal(s, name).to_numpy(zero_copy_only=False)
                rates, seeds, cap = trial[name]
                each = [n[own] @ poisson_inverse((u[own][:, None] + shift) % 1, rates[None, :], np.array(cap)) for shift in seeds]
                total[name] = total.get(name, 0) + np.stack(each)
        if total:
            yield pa.RecordBatch.from_pydict({"s": list(total), "sums": [v.reshape(-1).tolist() for v in total.values()]})

    partial = slim.select("s", "n", "mix_u").mapInArrow(sums, "s string, sums array<double>")
    each = partial.select("s", F.posexplode("sums").alias("i", "v")).groupBy("s", "i").agg(F.sum("v").alias("v")).toPandas()
    out = {name: np.zeros((len(seeds), len(rates))) for name, (rates, seeds, _) in trial.items()}
    for r in each.itertuples():
        out[r.s].reshape(-1)[r.i] = r.v
    return out
