"""Consensus of several annotators' labels, helped by what the items look like.

A regularised classifier over item features and the annotators' confusion are fitted together by
expectation-maximisation: the classifier's output is the prior of an item's label, the annotators' confusion turns
their labels into evidence, and the posteriors train both anew.

Two forms. ``closed``: a fixed set of classes, a full confusion matrix per annotator. ``open``: any number of values;
the candidates of an item are the labels it was given, and an annotator's confusion is their accuracy together with
the values their errors fall on.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.session import cut

_WORD = re.compile(r"[^\W\d_]+")


_ACCENTS = {ord(c): unicodedata.normalize("NFKD", c)[0] for c in "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"}


def bare(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii() or (text := text.translate(_ACCENTS)).isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def latest_labels(df: DataFrame, item: str, annotator: str, time: str, values: list[str]) -> DataFrame:
    """One row per item and annotator, the latest; annotators are trimmed and compared without case.

    Rows without item or annotator are left out. Rows of the same time are ordered by their values; a null time is the
    earliest. A blank value in the latest row is no label, even if an older row has one.
    """
    who = F.lower(F.trim(annotator))
    newest = F.max(F.struct(F.col(time).alias("__t"), *[F.col(v).alias(v) for v in values]))
    return (
        df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item"), who.alias("annotator")).agg(newest.alias("r"))
        .where("annotator is not null and annotator <> ''").select("item", "annotator", *[F.col(f"r.{v}").alias(v) for v in values])
    )


def _features(text: str | None, hint: str | None, width: int) -> list[int]:
    """Hashed words of a text and a hint, without repeats; 0 is the bias."""
    import zlib

    words = set(_WORD.findall(bare(text))) if text else set()
    marks = [f"w {w}" for w in words] + ([f"h {hint}"] if hint else [])
    return [0, *sorted({1 + zlib.crc32(m.encode()) % (width - 1) for m in marks})]


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and each row's length; nothing is turned into Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _ints(column) -> tuple[np.ndarray, np.ndarray]:
    values, lengths = _flat(column)
    return values.to_numpy(zero_copy_only=False).astype(np.int64), lengths


def _blobs(packed: DataFrame, columns: list[str], read: Callable[..., tuple[np.ndarray, ...]], names: list[str]) -> DataFrame:
    """A row of flat arrays per batch of items, written once: the rounds read arrays and no lists."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                arrays = read(*batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays], names)

    return cut(packed.select(*columns).mapInArrow(pack, ", ".join(f"{n} binary" for n in names)))


def _arrays(batches, kinds: list) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(c[i].as_buffer(), k) for c, k in zip(batch.columns, kinds)]


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _log_prior(weights: np.ndarray, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log of the classifier's output; each row has a feature at least, the bias."""
    if not len(lengths):
        return np.zeros((0, weights.shape[1]))
    out = np.add.reduceat(weights[features], _starts(lengths), axis=0)
    out -= out.max(1, keepdims=True)
    return out - np.log(np.exp(out).sum(1, keepdims=True))


def _prior(weights: np.ndarray, x: Column) -> Column:
    def prior(rows: pa.Array) -> pa.Array:
        return pa.array(list(_log_prior(weights, *_ints(rows))), pa.list_(pa.float64()))

    return F.arrow_udf(prior, T.ArrayType(T.DoubleType()))(x)


def _fit_classifier(feature: np.ndarray, lengths: np.ndarray, target: np.ndarray, width: int, weights: np.ndarray, decay: float = 1.0, steps: int = 100) -> np.ndarray:
    """Multinomial logistic regression on soft targets with an L2 penalty, by gradient steps per feature within the curvature's bound."""
    if not len(lengths):
        return weights
    row, starts = np.repeat(np.arange(len(lengths)), lengths), _starts(lengths)
    scale = 1.0 / (np.bincount(feature, np.repeat(lengths, lengths) / 2, minlength=width) + decay)[:, None]
    order = np.argsort(feature, kind="stable")
    by_feature, bounds = row[order], np.searchsorted(feature[order], np.arange(width + 1))
    present = np.flatnonzero(np.diff(bounds))
    for _ in range(steps):
        logit = np.add.reduceat(weights[feature], starts, axis=0)
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        slope = np.zeros_like(weights)
        slope[present] = np.add.reduceat((target - p)[by_feature], bounds[present], axis=0)
        weights = weights + scale * (slope - decay * weights * (np.bincount(feature, minlength=width) > 0)[:, None])
    return weights


def closed(
    labels: DataFrame, items: DataFrame, classes: list[str], rounds: int = 6, sample_items: int = 20_000, width: int = 4096, smoothing: float = 4.0,
    max_annotators: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """(consensus, annotators) for labels (item, annotator, value) out of ``classes`` and items (item, text, hint).

    Consensus: item, value, confidence, agreement (share of its labels that equal it), n_labels. Annotators: annotator,
    reliability (expected share of right labels), n_labels. Ties go to the class named first in ``classes``.

    Labels of no class are no labels, and without classes there is no row; items without labels give no row; a null text or hint has no features. Confusion
    and reliability cover all labels; the classifier alone is fitted on the ``sample_items`` items of smallest hash.

    Up to ``max_annotators`` (counted) the confusion matrices go to the workers with each round, which is one job: it
    weighs the items and sums the counts per annotator. Beyond that they are a table and joined; the result is the same.
    """
    spark = labels.sparkSession
    if not classes:
        kind = labels.schema["item"].dataType.simpleString()
        return spark.createDataFrame([], f"item {kind}, value string, confidence double, agreement double, n_labels bigint"), spark.createDataFrame([], "annotator string, reliability double, n_labels bigint")
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("value")).cast("int") - 1
    lab = cut(labels.where(F.col("value").isin(classes)).select("item", "annotator", code.alias("v")))

    def features(text: pa.Array, hint: pa.Array) -> pa.Array:
        return pa.array([_features(t, h, width) for t, h in zip(text.to_pylist(), hint.to_pylist())], pa.list_(pa.int32()))

    known = lab.select("item").distinct()
    described = items.groupBy("item").agg(F.min("text").alias("text"), F.min("hint").alias("hint"))
    x = cut(known.join(described, "item", "left").select("item", F.arrow_udf(features, T.ArrayType(T.IntegerType()))("text", "hint").alias("x")))
    names = _names(lab, max_annotators)
    if names is None:
        return _closed_joined(lab, x, classes, rounds, sample_items, width, smoothing)
    k = len(classes)
    packed = cut(_numbered(lab, names).groupBy("item").agg(F.collect_list(F.struct("a", "v")).alias("g")).join(x, "item").select("item", "x", F.col("g.a").alias("a"), F.col("g.v").alias("v")))
    rounds_read = _blobs(packed, ["x", "a", "v"], lambda x, a, v: (*_ints(x), *_ints(a), _ints(v)[0]), ["x", "nx", "a", "na", "v"])
    sample = packed.withColumn("h", F.xxhash64("item")).orderBy("h", "item").limit(sample_items).select("x", "a", "v").toArrow()
    held = _ints(sample["x"]), _ints(sample["a"]), _ints(sample["v"])[0]
    share = smoothing * np.where(np.eye(k, dtype=bool), 0.7, 0.3 / max(k - 1, 1))
    confusion = np.repeat(np.log(share / smoothing).T[None], max(len(names), 1), 0)
    weights, counts = np.zeros((width, k)), np.zeros((len(names), k, k))
    for r in range(rounds):
        counts = _confusion_counts(rounds_read, confusion, weights)
        final = (confusion, weights)
        if r == rounds - 1:
            break
        post = _weigh(*held, confusion, weights)
        weights = _fit_classifier(*held[0], post, width, weights)
        confusion = np.log((counts + share.T[None]) / (counts.sum(1, keepdims=True) + smoothing))
    consensus = _agreed(packed, final, classes)
    total = counts.sum((1, 2))
    right = np.einsum("avv->a", counts)
    annotators = lab.sparkSession.createDataFrame(
        [(n, float(right[i] / total[i]), int(round(total[i]))) for n, i in names.items() if total[i] > 0], "annotator string, reliability double, n_labels bigint"
    )
    return consensus, annotators


def _names(lab: DataFrame, most: int) -> dict[str, int] | None:
    """Numbers of the annotators; None if there are more than ``most``."""
    found = lab.select("annotator").distinct().limit(most + 1).collect()
    return {n: i for i, n in enumerate(sorted(r.annotator for r in found))} if len(found) <= most else None


def _numbered(lab: DataFrame, names: dict[str, int]) -> DataFrame:
    numbers = lab.sparkSession.createDataFrame(list(names.items()), "annotator string, a int")
    return lab.join(F.broadcast(numbers), "annotator").drop("annotator")


def _weigh(x: tuple, annotator: tuple, given: np.ndarray, confusion: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[item, class] posterior of items with at least one label each; ``x`` and ``annotator`` are values and lengths."""
    if not len(x[1]):
        return np.zeros((0, weights.shape[1]))
    score = _log_prior(weights, *x) + np.add.reduceat(confusion[annotator[0], given], _starts(annotator[1]), axis=0)
    odds = np.exp(score - score.max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True)


def _confusion_counts(blobs: DataFrame, confusion: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[annotator, given, class] summed posteriors over all items."""
    n, k, _ = confusion.shape

    def count(batches):
        total = np.zeros((n, k, k))
        for x, nx, a, na, v in _arrays(batches, [np.int64] * 5):
            np.add.at(total, (a, v), np.repeat(_weigh((x, nx), (a, na), v, confusion, weights), na, 0))
        i, j = np.nonzero(total.any(2))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(total[i, j, t]) for t in range(k)]], ["a", "v", *[f"p{t}" for t in range(k)]])

    columns = [f"p{t}" for t in range(k)]
    partial = blobs.mapInArrow(count, "a int, v int, " + ", ".join(f"{c} double" for c in columns))
    found = partial.groupBy("a", "v").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out = np.zeros((n, k, k))
    if found.num_rows:
        out[found["a"].to_numpy(), found["v"].to_numpy()] = np.stack([found[c].to_numpy() for c in columns], 1)
    return out


def _agreed(packed: DataFrame, final: tuple[np.ndarray, np.ndarray], classes: list[str]) -> DataFrame:
    names = np.array(classes, object)

    def decide(batches):
        for batch in batches:
            x, a, v = _ints(batch.column(1)), _ints(batch.column(2)), _ints(batch.column(3))[0]
            post, many = _weigh(x, a, v, *final), a[1]
            best = post.argmax(1) if len(post) else np.zeros(0, int)
            same = np.add.reduceat((v == np.repeat(best, many)).astype(float), _starts(many)) / many if len(many) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(post.max(1, initial=0)), pa.array(same), pa.array(many)],
                ["item", "value", "confidence", "agreement", "n_labels"],
            )

    kind = packed.schema["item"].dataType.simpleString()
    return packed.select("item", "x", "a", "v").mapInArrow(decide, f"item {kind}, value string, confidence double, agreement double, n_labels bigint")


def _closed_joined(lab: DataFrame, x: DataFrame, classes: list[str], rounds: int, sample_items: int, width: int, smoothing: float) -> tuple[DataFrame, DataFrame]:
    """``closed`` for any number of annotators: their confusion is a table that the labels are joined to."""
    k = len(classes)
    p, l = [f"p{t}" for t in range(k)], [f"l{t}" for t in range(k)]

    sample = x.withColumn("h", F.xxhash64("item")).orderBy("h", "item").limit(sample_items).select("item", "x").collect()
    lengths = np.array([len(r.x) for r in sample], np.int64)
    features = np.array([f for r in sample for f in r.x], np.int64)
    chosen = lab.sparkSession.createDataFrame([(r.item,) for r in sample], x.select("item").schema)
    weights = np.zeros((width, k))
    share = smoothing * np.where(np.eye(k, dtype=bool), 0.7, 0.3 / max(k - 1, 1))
    params, post = None, None
    for _ in range(rounds):
        if params is None:
            base = np.log(share / smoothing)
            table = F.array(*[F.array(*[F.lit(float(base[t, v])) for t in range(k)]) for v in range(k)])
            evidence = lab.withColumn("row", F.get(table, F.col("v"))).select("item", *[F.get("row", F.lit(t)).alias(l[t]) for t in range(k)])
        else:
            evidence = lab.join(params, ["annotator", "v"]).select("item", *l)
        summed = evidence.groupBy("item").agg(*[F.sum(c).alias(c) for c in l])
        scored = summed.join(x, "item").withColumn("prior", _prior(weights, F.col("x")))
        scored = scored.select("item", *[(F.col(l[t]) + F.get("prior", F.lit(t))).alias(l[t]) for t in range(k)]).withColumn("top", F.greatest(*l) if k > 1 else F.col(l[0]))
        weighed = scored.select("item", *[F.exp(F.col(c) - F.col("top")).alias(c) for c in l])
        total = sum((F.col(c) for c in l[1:]), F.col(l[0]))
        post = cut(weighed.select("item", *[(F.col(c) / total).alias(q) for c, q in zip(l, p)]))
        counts = lab.join(post, "item").groupBy("annotator", "v").agg(*[F.sum(c).alias(c) for c in p])
        given = counts.groupBy("annotator").agg(*[F.sum(c).alias(f"s{c}") for c in p])
        own = F.array(*[F.array(*[F.lit(float(share[t, v])) for t in range(k)]) for v in range(k)])
        rated = counts.join(given, "annotator").withColumn("own", F.get(own, F.col("v")))
        params = cut(rated.select("annotator", "v", *[
            F.log((F.col(p[t]) + F.get("own", F.lit(t))) / (F.col(f"s{p[t]}") + smoothing)).alias(l[t]) for t in range(k)
        ]))
        found = post.join(chosen, "item").collect() if sample else []
        targets = {r.item: [r[c] for c in p] for r in found}
        if targets:
            weights = _fit_classifier(features, lengths, np.array([targets[r.item] for r in sample]), width, weights)
    best = F.greatest(*p) if k > 1 else F.col(p[0])
    value = F.coalesce(*[F.when(F.col(p[t]) == best, F.lit(t)) for t in range(k)])
    agreed = post.select("item", value.alias("t"), best.alias("confidence"))
    matched = lab.join(agreed, "item").groupBy("item").agg(
        F.first("t").alias("t"), F.first("confidence").alias("confidence"), F.avg((F.col("v") == F.col("t")).cast("int")).alias("agreement"), F.count(F.lit(1)).alias("n_labels")
    )
    consensus = matched.select("item", F.get(F.array(*map(F.lit, classes)), F.col("t")).alias("value"), "confidence", "agreement", "n_labels")
    right = F.get(F.array(*p), F.col("v"))
    annotators = lab.join(post, "item").groupBy("annotator").agg(F.avg(right).alias("reliability"), F.count(F.lit(1)).alias("n_labels"))
    return consensus, annotators


@lru_cache(maxsize=4096)
def _words_of(text: str) -> tuple[set[str], set[str]]:
    """The words of a text, and what those of four letters and more become with one letter left out."""
    tokens = set(_WORD.findall(bare(text)))
    return tokens, {t[:i] + t[i + 1 :] for t in tokens if len(t) >= 4 for i in range(len(t))} | {t for t in tokens if len(t) >= 4}


def _match_features(text: str | None, value: str) -> list[float]:
    """How well a value's words are found in the item's text: share found, its longest word found, words not found.

    The value's longest word counts by itself: of a composed value it is the one that names something.
    """
    words = [w for w in re.split(r"[^\w]+", bare(value)) if w]
    tokens, shorter = _words_of(text) if text else (set(), set())
    if not words:
        return [0.0, 0.0, 0.0]
    near = [1.0 if w in tokens else 0.75 * _one_apart(w, shorter) for w in words]
    return [sum(near) / len(words), near[max(range(len(words)), key=lambda i: len(words[i]))], float(len(words) - sum(near))]


def _one_apart(word: str, shorter: set[str]) -> bool:
    """A letter dropped, doubled or swapped in words of five letters and more: they share a spelling with one letter left out."""
    return len(word) >= 5 and (word in shorter or any(word[:i] + word[i + 1 :] in shorter for i in range(len(word))))


BUCKETS = 128
START = np.array([2.0, 0.5, -1.0, 0.1])


def _bucket(value: str) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def open_values(
    labels: DataFrame, items: DataFrame, rounds: int = 6, sample_items: int = 20_000, decay: float = 0.05, max_annotators: int = 20_000
) -> tuple[DataFrame, DataFrame]:
    """(consensus, annotators) as ``closed`` gives them, for labels (item, annotator, value) of any values.

    An item's candidates are its labels. The features of a candidate are how its words are found in the item's text and
    how common it is among the labels; ties go to the smallest value. Null and blank labels are none. The values that
    an annotator's errors fall on are kept in ``BUCKETS`` hash buckets.
    """
    lab = cut(labels.where("value is not null and value <> ''").select("item", "annotator", "value"))
    common = lab.groupBy("value").agg(F.countDistinct("item").alias("items"))
    described = items.groupBy("item").agg(F.min("text").alias("text"))

    def features(text: pa.Array, value: pa.Array) -> pa.Array:
        return pa.array([_match_features(t, v) for t, v in zip(text.to_pylist(), value.to_pylist())], pa.list_(pa.float64()))

    pairs = lab.groupBy("item", "value").agg(F.count(F.lit(1)).alias("n")).join(described, "item", "left").join(common, "value")
    x = F.concat(F.arrow_udf(features, T.ArrayType(T.DoubleType()))("text", "value"), F.array(F.log1p(F.col("items").cast("double"))))
    cand = cut(pairs.select("item", "value", "n", x.alias("x")))
    names = _names(lab, max_annotators)
    if names is None:
        return _open_joined(lab, cand, rounds, sample_items, decay)
    who = _numbered(lab, names).groupBy("item", "value").agg(F.collect_list("a").alias("a"))
    each = F.array_sort(F.collect_list(F.struct("value", _bucket("value").alias("b"), "x", "a")))
    packed = cut(cand.join(who, ["item", "value"]).groupBy("item").agg(each.alias("c")).select("item", "c.value", "c.b", "c.x", "c.a"))
    rounds_read = _blobs(packed, ["b", "x", "a"], _candidates, list(_Candidates._fields))
    sample = packed.withColumn("h", F.xxhash64("item")).orderBy("h", "item").limit(sample_items).select("b", "x", "a").toArrow()
    held = _candidates(*[sample[c] for c in ("b", "x", "a")])
    gain, weights = np.full((max(len(names), 1), BUCKETS), 3.0), START
    sums = np.zeros((len(names), 2))
    for r in range(rounds):
        right, wrong = _choice_counts(rounds_read, gain, weights)
        sums = np.stack([right, right + wrong.sum(1)], 1)
        final = (gain, weights)
        if r == rounds - 1:
            break
        weights = _fit_packed(held, _choose(held, gain, weights), weights, decay)
        sure = (right + 3.0) / (sums[:, 1] + 4.0)
        slip = np.minimum((wrong + 2.0 / BUCKETS) / (wrong.sum(1, keepdims=True) + 2.0), 0.999)
        gain = np.log(1 + sure[:, None] / ((1 - sure[:, None]) * slip))
    annotators = lab.sparkSession.createDataFrame(
        [(n, float(sums[i, 0] / sums[i, 1]), int(round(sums[i, 1]))) for n, i in names.items() if sums[i, 1] > 0], "annotator string, reliability double, n_labels bigint"
    )
    return _chosen(packed, final), annotators


class _Candidates(NamedTuple):
    """Candidates of a batch of items, one item after another."""

    bucket: np.ndarray  # of each candidate
    sizes: np.ndarray  # candidates of each item
    features: np.ndarray  # [candidate, feature]
    owners: np.ndarray  # annotators of each candidate, one after another
    many: np.ndarray  # annotators of each candidate


def _candidates(b, x, a) -> _Candidates:
    bucket, sizes = _ints(b)
    features = _flat(_flat(x)[0])[0].to_numpy(zero_copy_only=False).reshape(-1, len(START))
    owners, many = _ints(_flat(a)[0])
    return _Candidates(bucket, sizes, features, owners, many)


def _choose(c: _Candidates, gain: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Posterior of every candidate; each has an annotator at least."""
    if not len(c.sizes):
        return np.zeros(0)
    evidence = np.add.reduceat(gain[c.owners, np.repeat(c.bucket, c.many)], _starts(c.many))
    score, starts = c.features @ weights + evidence, _starts(c.sizes)
    odds = np.exp(score - np.repeat(np.maximum.reduceat(score, starts), c.sizes))
    return odds / np.repeat(np.add.reduceat(odds, starts), c.sizes)


def _choice_counts(blobs: DataFrame, gain: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[annotator] expected right labels, [annotator, bucket] expected wrong ones, over all items."""
    n = gain.shape[0]

    def count(batches):
        right, wrong = np.zeros(n), np.zeros((n, BUCKETS))
        for arrays in _arrays(batches, [np.int64, np.int64, np.float64, np.int64, np.int64]):
            c = _Candidates(*arrays)._replace(features=arrays[2].reshape(-1, len(START)))
            post = np.repeat(_choose(c, gain, weights), c.many)
            np.add.at(right, c.owners, post)
            np.add.at(wrong, (c.owners, np.repeat(c.bucket, c.many)), 1 - post)
        i, j = np.nonzero(wrong)
        k = np.flatnonzero(right)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([i, k]), pa.int32()), pa.array(np.concatenate([j, np.full(len(k), -1)]), pa.int32()), pa.array(np.concatenate([wrong[i, j], right[k]]), pa.float64())
        ], ["a", "b", "s"])

    found = blobs.mapInArrow(count, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).toArrow()
    right, wrong = np.zeros(n), np.zeros((n, BUCKETS))
    a, b, s = (found[c].to_numpy() for c in ("a", "b", "s"))
    right[a[b < 0]] = s[b < 0]
    wrong[a[b >= 0], b[b >= 0]] = s[b >= 0]
    return right, wrong


def _chosen(packed: DataFrame, final: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def decide(batches):
        for batch in batches:
            c = _candidates(*[batch.column(i) for i in (2, 3, 4)])
            post, starts = _choose(c, *final), _starts(c.sizes)
            # The first candidate, by value, of those with the item's highest posterior.
            top = np.repeat(np.maximum.reduceat(post, starts), c.sizes) if len(post) else post
            place = np.where(post >= top, np.arange(len(post)), len(post))
            best = np.minimum.reduceat(place, starts) if len(post) else np.zeros(0, np.int64)
            labels = np.add.reduceat(c.many, starts) if len(post) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _flat(batch.column(1))[0].take(pa.array(best)).cast(pa.string()), pa.array(post[best]), pa.array(c.many[best] / np.maximum(labels, 1)), pa.array(labels)],
                ["item", "value", "confidence", "agreement", "n_labels"],
            )

    kind = packed.schema["item"].dataType.simpleString()
    return packed.select("item", "value", "b", "x", "a").mapInArrow(decide, f"item {kind}, value string, confidence double, agreement double, n_labels bigint")


def _fit_packed(c: _Candidates, post: np.ndarray, weights: np.ndarray, decay: float) -> np.ndarray:
    if not len(c.sizes):
        return weights
    return _ascend(c.features, post, _starts(c.sizes), np.repeat(np.arange(len(c.sizes)), c.sizes), weights, decay)


def _open_joined(lab: DataFrame, cand: DataFrame, rounds: int, sample_items: int, decay: float) -> tuple[DataFrame, DataFrame]:
    """``open_values`` for any number of annotators: their accuracy and errors are tables that the labels are joined to."""
    size = 4
    chosen = cut(cand.select("item").distinct().withColumn("h", F.xxhash64("item")).orderBy("h", "item").limit(sample_items).select("item"))
    weights = START
    power, post = None, None
    for _ in range(rounds):
        if power is None:
            each = cand.withColumn("w", F.col("n") * F.lit(3.0))
        else:
            each = lab.withColumn("bucket", _bucket("value")).join(power, "annotator").join(errors, ["annotator", "bucket"], "left")
            slip = (F.coalesce("wrong", F.lit(0.0)) + F.lit(2.0 / BUCKETS)) / (F.col("all_wrong") + 2.0)
            gain = F.log(1 + F.col("right") / ((1 - F.col("right")) * F.least(slip, F.lit(0.999))))
            each = each.groupBy("item", "value").agg(F.sum(gain).alias("w")).join(cand, ["item", "value"])
        prior = sum((F.get("x", F.lit(j)) * F.lit(float(weights[j])) for j in range(size)), F.lit(0.0))
        scored = each.select("item", "value", "x", (F.col("w") + prior).alias("score"))
        tops = scored.groupBy("item").agg(F.max("score").alias("top"))
        odds = scored.join(tops, "item").withColumn("e", F.exp(F.col("score") - F.col("top")))
        totals = odds.groupBy("item").agg(F.sum("e").alias("total"))
        post = cut(odds.join(totals, "item").select("item", "value", "x", (F.col("e") / F.col("total")).alias("p")))
        rated = lab.join(post, ["item", "value"])
        power = cut(rated.groupBy("annotator").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("c"), F.sum(1 - F.col("p")).alias("all_wrong")).select(
            "annotator", ((F.col("s") + 3.0) / (F.col("c") + 4.0)).alias("right"), "all_wrong"
        ))
        errors = cut(rated.groupBy("annotator", _bucket("value").alias("bucket")).agg(F.sum(1 - F.col("p")).alias("wrong")))
        weights = _fit_choice(post.join(chosen, "item").select("item", "x", "p").collect(), weights, decay)
    best = post.groupBy("item").agg(F.max(F.struct("p", F.col("value"))).alias("b"), F.max("p").alias("confidence"))
    tied = post.join(best, "item").where(F.col("p") == F.col("confidence")).groupBy("item").agg(F.min("value").alias("value"), F.first("confidence").alias("confidence"))
    consensus = (
        lab.select("item", "annotator", F.col("value").alias("given")).join(tied, "item").groupBy("item", "value", "confidence")
        .agg(F.avg((F.col("given") == F.col("value")).cast("int")).alias("agreement"), F.count(F.lit(1)).alias("n_labels"))
    )
    annotators = lab.join(post, ["item", "value"]).groupBy("annotator").agg(F.avg("p").alias("reliability"), F.count(F.lit(1)).alias("n_labels"))
    return consensus, annotators


def _fit_choice(rows: list, weights: np.ndarray, decay: float) -> np.ndarray:
    if not rows:
        return weights
    rows = sorted(rows, key=lambda r: str(r["item"]))
    names = np.array([str(r["item"]) for r in rows])
    first = np.concatenate([[True], names[1:] != names[:-1]])
    return _ascend(np.array([r["x"] for r in rows]), np.array([r["p"] for r in rows]), np.flatnonzero(first), np.cumsum(first) - 1, weights, decay)


def _ascend(x: np.ndarray, p: np.ndarray, starts: np.ndarray, group: np.ndarray, weights: np.ndarray, decay: float, steps: int = 40) -> np.ndarray:
    """Conditional logistic regression: the weights by which an item's candidates would be chosen as the posteriors say."""
    start = weights
    for _ in range(steps):
        score = x @ weights
        odds = np.exp(score - np.maximum.reduceat(score, starts)[group])
        q = odds / np.add.reduceat(odds, starts)[group]
        weights = weights + 2.0 * (((p - q) @ x) / len(starts) - decay * (weights - start))
    return weights
