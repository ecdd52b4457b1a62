"""Vectors, similarity graphs, clusters and components."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.functions.stats import dot, unit
from telar.session import cut


def _units(rows: list) -> np.ndarray:
    """Rows as a matrix of vectors of length 1; vectors of zeros stay."""
    m = np.array(rows, np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def hashed_words(words: Column, size: int = 256) -> Column:
    """A bag of words of fixed size by CRC-32, the encoder that needs no model; an empty bag is a vector of zeros."""

    def encode(lists: pa.Array) -> pa.Array:
        out = np.zeros((len(lists), size), np.float32)
        for i, row in enumerate(lists.to_pylist()):
            for w in row or ():
                out[i, zlib.crc32(w.encode()) % size] += 1
        return pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), size).cast(pa.list_(pa.float32()))

    return F.arrow_udf(encode, T.ArrayType(T.FloatType()))(words)


def centroids(df: DataFrame, keys: list[str], vector: str, normalise: bool = True) -> DataFrame:
    """Element-wise mean per key, of length 1 unless told otherwise; vectors are never gathered."""
    parts = df.select(*keys, F.posexplode(vector).alias("j", "x")).groupBy(*keys, "j").agg(F.avg("x").alias("x"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"])
    return parts.groupBy(*keys).agg((unit(mean) if normalise else mean).alias("centroid"))


def with_centroids(df: DataFrame, centres: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """``df`` with ``cs``, an array of (key, centroid) in order of key; more than ``most`` centroids raise, so the array is bounded."""
    if len(centres.select(key).limit(most + 1).collect()) > most:
        raise ValueError(f"more than {most} centroids to send to every row: use nearest()")
    every = centres.agg(F.array_sort(F.collect_list(F.struct(key, "centroid"))).alias("cs"))
    return df.crossJoin(F.broadcast(every))


def encode(df: DataFrame, text: str, encoder, size: int, column: str = "embedding") -> DataFrame:
    """``df`` with the vector of a text by any ``encoder`` (list of texts to matrix of ``size`` columns); null texts are empty.

    The encoder is built once per task and gets whole Arrow batches; a matrix of another shape raises.
    """

    def run(texts: pa.Array) -> pa.Array:
        found = np.asarray(encoder([t or "" for t in texts.to_pylist()]), np.float32).reshape(len(texts), -1) if len(texts) else np.zeros((0, size), np.float32)
        if found.shape[1] != size:
            raise ValueError(f"the encoder gives {found.shape[1]} numbers instead of {size}")
        return pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), size).cast(pa.list_(pa.float32()))

    return df.withColumn(column, F.arrow_udf(run, T.ArrayType(T.FloatType()))(text))


def medoid(df: DataFrame, keys: list[str], id: str, vector: str, epsilon: float = 1e-9) -> DataFrame:
    """Per key the member with the highest mean similarity to its members; within ``epsilon`` the smallest id.

    The mean similarity of a unit vector to all members is its product with their mean: no pairs are formed.
    """
    units = df.select(*keys, id, unit(F.col(vector)).alias("u"))
    scored = units.join(centroids(units, keys, "u", normalise=False), keys).select(*keys, id, dot(F.col("u"), F.col("centroid")).alias("s"))
    best = scored.groupBy(*keys).agg(F.max("s").alias("top"))
    return scored.join(best, keys).where(F.col("s") >= F.col("top") - epsilon).groupBy(*keys).agg(F.min(id).alias(id))


def nearest(queries: DataFrame, corpus: DataFrame, id: str, vector: str, k: int, query_block: int = 2048, corpus_block: int = 8192) -> DataFrame:
    """``query``, ``id``, ``similarity``, ``rank``: exact top-k by cosine of a stated query set against all rows.

    Both sides are cut into blocks; each block of queries meets each block of the corpus in one task, a product of two
    matrices, and keeps its own top-k, so what is shuffled on is k rows per query and block. Neither side is broadcast
    or gathered. Ties go to the smaller id; null vectors take no part.
    """
    kind = queries.schema[id].dataType.simpleString()
    q, c = (d.where(F.col(id).isNotNull() & F.col(vector).isNotNull()) for d in (queries, corpus))
    blocks = [max(1, -(-d.count() // size)) for d, size in ((q, query_block), (c, corpus_block))]
    number = lambda n: F.pmod(F.xxhash64(id), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(F.col(id).alias("id"), F.col(vector).alias("v"), number(blocks[0]).alias("qb"), every(blocks[1]).alias("cb"))
    right = c.select(F.col(id).alias("id"), F.col(vector).alias("v"), every(blocks[0]).alias("qb"), number(blocks[1]).alias("cb"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query": [], "id": [], "similarity": []})
        m = [np.stack(f["v"].to_numpy()).astype(np.float64) for f in (a, b)]
        m = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in m]
        s = m[0] @ m[1].T
        n = min(k, s.shape[1])
        i, j = np.nonzero(s >= -np.partition(-s, n - 1, axis=1)[:, n - 1 : n])
        found = pd.DataFrame({"query": a["id"].to_numpy()[i], "id": b["id"].to_numpy()[j], "similarity": s[i, j]})
        return found.sort_values(["query", "similarity", "id"], ascending=[True, False, True]).groupby("query").head(k)

    local = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(search, f"query {kind}, id {kind}, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_edges(df: DataFrame, id: str, vector: str, threshold: float, chunk: int = 1000, max_pivots: int = 1000) -> DataFrame:
    """``a`` < ``b`` with cosine above the threshold: exact, by products of blocks of rows that may hold such a pair.

    An index of pivots says which: each row goes to the pivot at the smallest angle, and two blocks whose pivots lie
    further apart than their radii and the threshold's angle together hold no pair (triangle inequality), so nothing is
    missed. Pivots, one per ``chunk`` rows and at most ``max_pivots``, are the rows of smallest hash; every row is
    indexed. Blocks of more than ``chunk`` rows are split by hash, so that no task holds more than two parts. What
    comes to the driver is one row per pivot. Rows without id or vector have no edges.
    """
    kind = df.schema[id].dataType.simpleString()
    df = df.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("v"))
    spark, n = df.sparkSession, df.count()
    chosen = df.orderBy(F.xxhash64("id"), "id").limit(min(max_pivots, max(1, -(-n // chunk)))).select("v").collect()
    pivots = _units([r.v for r in chosen])
    shared = spark.sparkContext.broadcast(pivots)

    def place(vectors: pa.Array) -> pa.Array:
        rows = vectors.to_pylist()
        cos = np.clip(_units(rows) @ shared.value.T, -1.0, 1.0) if rows else np.zeros((0, 1))
        best = cos.argmax(1)
        return pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(np.arccos(cos[np.arange(len(rows)), best]))], ["block", "angle"])

    placed = cut(df.withColumn("p", F.arrow_udf(place, "struct<block:int,angle:double>")("v")).select("id", "v", "p.block", "p.angle"))
    blocks = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect()
    number, radius = np.array([r.block for r in blocks], int), np.array([r.r for r in blocks])
    apart = np.arccos(np.clip(pivots[number] @ pivots[number].T, -1.0, 1.0)) if blocks else np.zeros((0, 0))
    i, j = np.nonzero(apart - radius[:, None] - radius[None] <= np.arccos(np.clip(threshold, -1.0, 1.0)) + 1e-6)
    parts = {r.block: -(-r.n // chunk) for r in blocks}
    meets = spark.createDataFrame([(int(number[x]), int(number[y]), parts[int(number[x])], parts[int(number[y])]) for x, y in zip(i, j)], "block int, other int, own bigint, parts bigint")
    code = lambda block, part: F.shiftleft(F.col(block).cast("bigint"), 32) + part
    each = placed.join(F.broadcast(meets), "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    each = each.withColumns({"block": code("block", F.pmod(F.xxhash64("id"), F.col("own"))), "with": code("other", F.col("part"))})
    spread = each.withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")}).select("id", "v", "block", "lo", "hi")

    def edges(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame[frame["block"] == key[0]], frame[frame["block"] == key[1]]
        if lo.empty or hi.empty:
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        s = _units(lo["v"].tolist()) @ _units(hi["v"].tolist()).T
        i, j = np.nonzero(s > threshold)
        x, y = lo["id"].to_numpy()[i], hi["id"].to_numpy()[j]
        keep = x < y if key[0] == key[1] else x != y
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "similarity": s[i, j][keep]})

    return spread.groupBy("lo", "hi").applyInPandas(edges, f"a {kind}, b {kind}, similarity double")


def components(edges: DataFrame, nodes: DataFrame, id: str, max_rounds: int = 50) -> DataFrame:
    """``id``, ``component`` (its smallest id) of an undirected graph: alternating large-star and small-star rounds.

    Each round points nodes to smaller neighbours; the number of rounds grows with the logarithm of the longest path.
    The edges are written to the checkpoint folder each round, and nothing but their change comes to the driver.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.*")
        new = cut(small.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        same = new.count() == e.count() and new.join(e, ["a", "b"], "left_anti").isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = e.groupBy(F.col("b").alias(id)).agg(F.min("a").alias("root"))
    return nodes.select(id).where(F.col(id).isNotNull()).distinct().join(roots, id, "left").select(id, F.coalesce("root", id).alias("component"))


def upgma(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Average-linkage clusters of unit vectors: the pair of highest mean similarity merges while it is above the threshold."""
    n = len(vectors)
    sums, sizes, label = vectors.astype(np.float64) @ vectors.T.astype(np.float64), np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    mean = sums.copy()
    np.fill_diagonal(mean, -np.inf)
    while alive.sum() > 1:
        i, j = divmod(int(mean.argmax()), n)
        if mean[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        sizes[i] += sizes[j]
        label[label == j] = i
        alive[j] = False
        mean[j], mean[:, j] = -np.inf, -np.inf
        row = np.where(alive, sums[i] / (sizes * sizes[i]), -np.inf)
        row[i] = -np.inf
        mean[i], mean[:, i] = row, row
    return label


def average_linkage(df: DataFrame, id: str, vector: str, threshold: float) -> DataFrame:
    """``id``, ``cluster`` (its smallest id) by average linkage, cut where the mean similarity isn't above the threshold.

    A merge needs one pair above the threshold, so no cluster crosses a component of that similarity graph: splitting
    by components is exact. Within a component the merges are global, so a component is one task; its square in memory
    is what bounds it. A row without vector is a cluster of its own.
    """
    kind = df.schema[id].dataType.simpleString()
    parts = components(similar_edges(df, id, vector, threshold), df, id)
    placed = df.select(id, vector).join(parts, id)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(id, ignore_index=True)
        m = np.stack(frame[vector].to_numpy()).astype(np.float64)
        labels = upgma(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300), threshold)
        return pd.DataFrame({id: frame[id], "cluster": frame[id].to_numpy()[labels]})

    merged = placed.where(F.col(vector).isNotNull()).groupBy("component").applyInPandas(merge, f"{id} {kind}, cluster {kind}")
    return merged.union(df.where(F.col(vector).isNull()).select(id, F.col(id).alias("cluster")))


def most_similar_before(df: DataFrame, id: str, vector: str, time: str, days: int, block: int = 4096) -> DataFrame:
    """``id``, ``earlier``, ``similarity``: of the rows strictly earlier (by time, then id) and within ``days`` days the most similar.

    Rows are cut into cells of ``days`` days; each meets its own cell and the one before it, in blocks of about
    ``block`` rows, so that a crowded cell is many tasks. At equal similarity the larger id wins; rows with none before
    them, or without vector or time, give no row.
    """
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(F.col(id).alias("id"), F.col(vector).alias("v"), F.unix_micros(F.col(time)).alias("t")).where("v is not null and t is not null")
    rows = rows.withColumn("cell", F.floor(F.col("t") / (days * 86_400_000_000)).cast("long"))
    crowd = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    sized = rows.join(crowd, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # A row as the earlier one goes to its cell and the next; as the later one it meets every part of its cell and the one before.
    earlier = sized.select("id", "v", "t", F.explode(F.array("cell", F.col("cell") + 1)).alias("at"), F.col("cell").alias("of"), "part")
    later = sized.select("id", "v", "t", F.col("cell").alias("at"), F.explode(F.array("cell", F.col("cell") - 1)).alias("of"), F.col("part").alias("own"))
    reach = crowd.select(F.col("cell").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    later = later.join(reach, "of")
    span = days * 86_400_000_000

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": [], "earlier": [], "similarity": []})
        if a.empty or b.empty:
            return none
        b = b.rename(columns=lambda c: c.removeprefix("e_")).sort_values("id", ascending=False)
        m = [np.stack(f["v"].to_numpy()).astype(np.float64) for f in (a, b)]
        m = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in m]
        s = np.round(m[0] @ m[1].T, 12)
        ta, tb, ia, ib = a["t"].to_numpy()[:, None], b["t"].to_numpy()[None], a["id"].to_numpy()[:, None], b["id"].to_numpy()[None]
        s[~(((tb < ta) | ((tb == ta) & (ib < ia))) & (ta - tb <= span))] = -np.inf
        best = s.argmax(1)
        top = s[np.arange(len(s)), best]
        found = pd.DataFrame({"id": a["id"].to_numpy(), "earlier": b["id"].to_numpy()[best], "similarity": top})
        return found[np.isfinite(top)]

    meets = earlier.join(sized.select(F.col("cell").alias("at"), F.col("part").alias("own")).distinct(), "at").toDF(*[f"e_{c}" for c in ("at", "id", "v", "t", "of", "part", "own")])
    local = later.groupBy("at", "of", "part", "own").cogroup(meets.groupBy("e_at", "e_of", "e_part", "e_own")).applyInPandas(search, f"id {kind}, earlier {kind}, similarity double")
    return local.groupBy("id").agg(F.max(F.struct("similarity", "earlier")).alias("b")).select("id", "b.earlier", "b.similarity")


def independent_sources(df: DataFrame, group: str, id: str, rules: dict[str, Column]) -> DataFrame:
    """``group``, ``id``, ``source`` (its smallest id): records of a group that share the value of a rule are of one source.

    Each rule links the records of a (group, value) to the smallest of them, so copies make stars and no pairs; what is
    joined over several rules is found as components. A null value links nothing.
    """
    ids = F.col(id)
    values = F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("string").alias("value")) for n, c in rules.items()])
    shared = df.select(F.col(group).alias("g"), ids.alias("id"), F.explode(values).alias("r")).where("r.value is not null")
    stars = shared.groupBy("g", "r").agg(F.min("id").alias("a"))
    edges = shared.join(stars, ["g", "r"]).where("id <> a").select("a", F.col("id").alias("b"))
    parts = components(edges, df.select(ids.alias("id")), "id").select(F.col("id").alias("pid"), "component")
    return df.select(F.col(group).alias(group), ids.alias(id)).join(parts, F.col(id) == F.col("pid")).select(group, id, F.col("component").alias("source"))
