"""Filling containers of fixed capacity: harmonic packing, with the gaps put to use.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k], of which any k fill one
container. Each worker takes a hash bucket of the items and fills its own containers without looking at the rest: k
items of class k each, the longest first. What k items of a class leave free is smaller than C/(k+1); it takes the
longest unplaced items of the smaller classes that fit, so that little room is left.
"""

from __future__ import annotations

import json
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def harmonic(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; no container's sum exceeds the capacity. Sizes lie in 1..capacity."""
    lengths, counts = np.unique(sizes, return_counts=True)
    order, ends = np.argsort(sizes, kind="stable").tolist(), np.cumsum(counts).tolist()
    lengths, left = lengths.tolist(), counts.tolist()
    below = list(range(-1, len(lengths) - 1))
    bins = np.full(len(sizes), -1, np.int64)

    def largest(most: int) -> int:
        """Place of the longest length up to ``most`` that an unplaced item has, -1 if there is none."""
        at = top = bisect_right(lengths, most) - 1
        while top >= 0 and not left[top]:
            top = below[top]
        while at > top:
            below[at], at = top, below[at]
        return top

    def take(place: int, number: int) -> int:
        bins[order[ends[place] - left[place]]] = number
        left[place] -= 1
        return lengths[place]

    number, k = 0, 1
    while (place := largest(capacity // k)) >= 0:
        k = capacity // lengths[place]
        gap = capacity
        # As many items of the class as any of them fit, then what smaller classes put in the gap.
        for _ in range(k):
            if (place := largest(capacity // k)) < 0 or lengths[place] * (k + 1) <= capacity:
                break
            gap -= take(place, number)
        while gap and (place := largest(gap)) >= 0:
            gap -= take(place, number)
        number += 1
    return bins


def pack(
    items: DataFrame, containers: DataFrame, id: str, size: str, name: str, capacity: str, bucket_pieces: int = 20_000, max_kinds: int = 1000,
) -> DataFrame:
    """``container`` (of ``containers.name``), ``bin``, ``id``, ``part``, ``from_token``, ``to_token``, ``size`` of each piece.

    * An item is whole unless it is longer than the capacity; then it is cut into full containers and one rest, which
      is packed like any other piece. Parts are numbered from 0.
    * Items of null or no size are left out: there is nothing to place. Repeated ids are items of their own.
    * Containers without a positive capacity take nothing. An empty table gives an empty result.

    Buckets are hashes of the id and part. Their number follows the number of pieces, summed once for each kind of
    container, so that one bucket holds about ``bucket_pieces``, be they many items or one very long one's parts.
    ``max_kinds`` bounds the kinds of container and is checked.
    """
    sized = items.select(F.col(id).alias("id"), F.col(size).cast("bigint").alias("size")).where("size > 0")
    boxes = containers.select(F.col(name).alias("container"), F.col(capacity).cast("bigint").alias("capacity")).where("capacity > 0").distinct()
    known = boxes.limit(max_kinds + 1).collect()
    if len(known) > max_kinds:
        raise ValueError(f"more than {max_kinds} kinds of container")
    parts = F.ceil(F.col("size") / F.col("capacity"))

    def each(kinds: list[dict], fields: str) -> DataFrame:
        return sized.withColumn("box", F.explode(F.from_json(F.lit(json.dumps(kinds)), f"array<struct<{fields}>>"))).select("id", "size", "box.*")

    kinds = [r.asDict() for r in known]
    counts = {(r.container, r.capacity): r.n for r in each(kinds, "container:string,capacity:bigint").groupBy("container", "capacity").agg(F.sum(parts).alias("n")).collect()}
    kinds = [k | {"buckets": max(1, counts.get((k["container"], k["capacity"]), 0) // bucket_pieces)} for k in kinds]
    pieces = (
        each(kinds, "container:string,capacity:bigint,buckets:bigint").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        .withColumn("from_token", F.col("part") * F.col("capacity"))
        .withColumn("to_token", F.least((F.col("part") + 1) * F.col("capacity"), "size"))
        .withColumn("size", F.col("to_token") - F.col("from_token"))
        .withColumn("bucket", F.pmod(F.xxhash64("id", "part"), F.col("buckets")).cast("int"))
    )
    columns = ["container", "bin", "id", "part", "from_token", "to_token", "size"]

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "part"], ignore_index=True)
        numbers = harmonic(group["size"].to_numpy(), int(group["capacity"].iloc[0]))
        group["bin"] = [f"{key[1]}-{b}" for b in numbers]
        return group[columns]

    kind = items.schema[id].dataType.simpleString()
    schema = f"container string, bin string, id {kind}, part bigint, from_token bigint, to_token bigint, size bigint"
    return pieces.groupBy("container", "bucket").applyInPandas(fill, schema)


def fill_report(packed: DataFrame, containers: DataFrame, name: str, capacity: str) -> DataFrame:
    """Per container kind: bins, pieces, tokens placed, share of the room used, and the fullest bin."""
    bins = packed.groupBy("container", "bin").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    total = bins.groupBy("container").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")
    )
    boxes = containers.select(F.col(name).alias("container"), F.col(capacity).cast("bigint").alias("capacity")).distinct()
    return total.join(boxes, "container").withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity")))
