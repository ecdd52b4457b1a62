"""Keyword-stuffed pages, link lists and tag pages, found by the shapes of their lines.

Each line (long ones in windows of about 40 words) is reduced to a shape: in coarse steps its number of words and the
shares of capitals, separators, links, short words, figures and distinct words, and its sentence ends. Shapes are
grouped per page. The numbers of a shape say whether a sentence can look like that: sentences of the languages here
have many short words, few separators and few repeats. A page is flagged if more than half of its whole text lies in
shapes that no sentence has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINK = re.compile(r"https?://\S+")
_WORD = re.compile(r"#?[^\W_]+(?:['’.,-][^\W_]+)*")
_SEPARATOR = re.compile(r"[;|·»•/>#]|,(?!\d)|\s[-–—*]\s")
_STOP = re.compile(r"\w{4}[.!?…][\"»”)]*(?=\s+[^\sa-zà-ÿ]|$)")
_SHORTENED = re.compile(r"\b[a-z]{1,3}\.(?=\s)")
_SENTENCE = re.compile(r"(?<=[.!?])[\"»”)]*\s+")

WINDOW_WORDS, SHARE = 40, 0.5
#: Steps of a twentieth. A sentence has at least SHORT short words (one step more where nothing ends in a stop), fewer
#: than LISTED separators and LINKED links, and more than DISTINCT different ones of its lower-case words.
STEPS, SHORT, LISTED, LINKED, DISTINCT, NONE = 20, 2, 5, 2, 11, 99


class Shape(NamedTuple):
    words: int
    capitals: int
    separators: int
    links: int
    short: int
    figures: int
    distinct: int
    stops: int


def _step(part: int, whole: int) -> int:
    return min(STEPS - 1, STEPS * max(part, 0) // whole) if whole else STEPS - 1 if part else 0


def _windows(line: str) -> Iterator[str]:
    words = line.split()
    if words:
        step = -(-len(words) // max(1, round(len(words) / WINDOW_WORDS)))
        for i in range(0, len(words), step):
            yield " ".join(words[i : i + step])


def _once(window: str) -> str:
    """A window in which a sentence that stands there up to three times counts once: prose said again isn't a list of phrases."""
    parts = _SENTENCE.split(window)
    counts = Counter(parts)
    return " ".join(p for p, n in counts.items() for _ in range(n if n > 3 else 1)) if len(counts) < len(parts) else window


def shape_of(window: str) -> Shape:
    links = window.count("://")
    rest = _LINK.sub(" ", window) if links else window
    words = _WORD.findall(rest)
    capitals = opening = short = figures = lower = distinct = 0
    for word, k in Counter(words).items():
        first = word[0]
        if first.isdigit():
            figures += k
        elif first.islower():
            lower += k
            distinct += 1
            if len(word) <= 3:
                short += k
        else:
            capitals += k
            if len(word) <= 3 and not word.isupper():
                opening += k
    if lower >= 8 and STEPS * distinct < DISTINCT * lower and (once := _once(rest)) != rest:
        few = [w for w in _WORD.findall(once) if w[0].islower()]
        lower, distinct = len(few), len(set(few))
    stops = len(_STOP.findall(rest))
    # A short word that opens a sentence is one though its first letter is a capital; a shortened word is none.
    short += min(opening, stops + 1) - len(_SHORTENED.findall(rest))
    n = len(words)
    return Shape(
        n if n < 4 else 4 + n // 12, _step(capitals, n), _step(len(_SEPARATOR.findall(rest)), n), _step(links, max(n, 1)), _step(short, n), _step(figures, n),
        _step(distinct, lower) if lower >= 8 else NONE, min(stops, 5),
    )


def kind_of(shape: Shape) -> str:
    """What a shape is instead of a sentence; empty where a sentence or a reading may look like that."""
    if shape.links >= LINKED:
        return "links"
    if not shape.words:
        return ""
    if shape.separators >= 2 * LISTED:
        return "tags"
    if shape.words >= 3 and shape.short < SHORT + (not shape.stops):
        return "keywords"
    if shape.distinct < DISTINCT:
        return "repeated"
    if shape.words >= 3 and shape.separators >= LISTED - (not shape.stops):
        return "list"
    return ""


def shapes(text: str) -> list[tuple[str, str, int]]:
    """(kind, shape, characters) of a page, grouped by shape.

    Short lines without figures and without a stop are judged together: if half of their lower-case words or more are
    words that they have four times and more, they are ``fragments``, one phrase in many lines.
    """
    chars: Counter[Shape] = Counter()
    loose: Counter[str] = Counter()
    for line in text.splitlines():
        for window in _windows(line):
            shape = shape_of(window)
            chars[shape] += len(window)
            if _is_loose(shape) and not kind_of(shape):
                loose.update(w for w in _WORD.findall(window) if w[0].islower())
    total = sum(loose.values())
    phrase = total >= 12 and 2 * sum(k for k in loose.values() if k >= 4) >= total
    return [(kind_of(s) or ("fragments" if phrase and _is_loose(s) else ""), ":".join(map(str, s)), n) for s, n in chars.items()]


def _is_loose(shape: Shape) -> bool:
    return 0 < shape.words <= 4 and not shape.stops and not shape.figures


_SHAPES = T.ArrayType(T.StructType().add("kind", T.StringType()).add("shape", T.StringType()).add("chars", T.LongType()))


def page_shapes(text: Column) -> Column:
    """Array of (kind, shape, chars) of a text; empty for null and blank texts."""

    def convert(values: pa.Array) -> pa.Array:
        rows = [[dict(zip(("kind", "shape", "chars"), s)) for s in shapes(v)] if v else [] for v in values.to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("shape", pa.string()), ("chars", pa.int64())]))
        return pa.array(rows, kind)

    return F.arrow_udf(convert, _SHAPES)(text)


def judge_pages(df: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``chars``, ``odd_chars`` (in non-sentence shapes), ``main_kind``, ``odd_shapes``, ``odd_share``, ``flagged``.

    * Every page gives a row; null, empty and blank texts have no characters and aren't flagged.
    * Repeated rows each give a row. Long texts are read whole. An empty table gives an empty result.
    * Characters are those of the lines' windows, without surplus white space; every window counts.
    """
    pages = df.select(F.col(id).alias("id"), page_shapes(F.col(text)).alias("s"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, s: x + s["chars"])
    odd = F.array_sort(F.filter("s", lambda s: s["kind"] != ""), lambda a, b: (b["chars"] - a["chars"]).cast("int"))
    return (
        pages.select("id", total(F.col("s")).alias("chars"), odd.alias("odd"))
        .select("id", "chars", total(F.col("odd")).alias("odd_chars"), F.get("odd", F.lit(0))["kind"].alias("main_kind"), F.size("odd").alias("odd_shapes"))
        .withColumn("odd_share", F.when(F.col("chars") > 0, F.col("odd_chars") / F.col("chars")).otherwise(F.lit(0.0)))
        .withColumn("flagged", F.col("odd_share") > SHARE)
    )
