"""Records: resolving identifiers, nested validation, flattening, edits, greedy choices, runs of steps."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Source:
    """Where records of an identifier's prefix are: of several rows with one ``key`` the first by ``order`` counts."""

    name: str
    prefix: str
    rows: DataFrame
    key: Column
    order: Column
    url: Column
    label: Column


def resolve(ids: DataFrame, id: str, sources: list[Source]) -> DataFrame:
    """``id``, ``source``, ``url``, ``label``, ``found`` of each distinct identifier; one join for all, whatever their number.

    The first source whose prefix fits is asked; an identifier that none fits has a null source, one that isn't there
    is not found. Null identifiers are left out.
    """
    known = reduce(DataFrame.unionByName, [
        s.rows.select(s.key.alias("id"), s.order.alias("o"), s.url.alias("url"), s.label.alias("label")).where(F.startswith("id", F.lit(s.prefix)))
        .groupBy("id").agg(F.min_by(F.struct("url", "label"), "o").alias("r")).select("id", F.lit(s.name).alias("source"), "r.url", "r.label", F.lit(True).alias("hit"))
        for s in sources
    ])
    route = reduce(lambda c, s: F.when(F.startswith("id", F.lit(s.prefix)), F.lit(s.name)).otherwise(c), reversed(sources), F.lit(None).cast("string"))
    asked = ids.select(F.col(id).alias("id")).where("id is not null").distinct().withColumn("source", route)
    return asked.join(known, ["id", "source"], "left").select("id", "source", "url", "label", F.coalesce("hit", F.lit(False)).alias("found"))


def validate_json(df: DataFrame, text: str, schema: str, checks: dict[str, Callable[[Column], Column]], column: str = "errors") -> DataFrame:
    """``df`` with an array of the rules that a nested record breaks; a text that is no such record breaks ``json_invalido``.

    A rule gets the parsed record and says whether it holds; a null answer counts as holding, as empty optional fields do.
    """
    parsed = df.withColumn("__r", F.from_json(F.col(text), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule(F.col("__r")), F.lit(True)), F.lit(name)) for name, rule in checks.items()]))
    bad = F.col("__r").isNull() | F.col("__r._bad").isNotNull()
    return parsed.withColumn(column, F.when(bad, F.array(F.lit("json_invalido"))).otherwise(broken)).drop("__r")


def key_paths(schema: T.StructType, prefix: str = "") -> Iterator[tuple[str, T.DataType]]:
    """Dotted path and type of every leaf of a nested schema; elements of arrays are ``path[]``."""
    for field in schema.fields:
        yield from _paths(field.dataType, f"{prefix}{field.name}")


def _paths(kind: T.DataType, path: str) -> Iterator[tuple[str, T.DataType]]:
    if isinstance(kind, T.StructType):
        yield from key_paths(kind, f"{path}.")
    elif isinstance(kind, T.ArrayType):
        yield from _paths(kind.elementType, f"{path}[]")
    else:
        yield path, kind


def flatten(df: DataFrame) -> DataFrame:
    """One column per leaf of nested structs, named by its path with ``_``; arrays stay as they are."""
    leaves = dict.fromkeys(p.split("[]")[0] for p, _ in key_paths(df.schema))
    return df.select(*[F.col(p).alias(p.replace(".", "_")) for p in leaves])


def elements(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys``, ``campo``, ``valor``: a row per editable element, null ones too."""
    cells = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("e")).select(*keys, "e.*")


def apply_edits(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Elements with the values of ``edits`` (``keys``, ``campo``, ``nuevo``) put in, and whether each was edited."""
    joined = rows.join(edits.withColumn("__hit", F.lit(True)), [*keys, "campo"], "left")
    hit = F.coalesce("__hit", F.lit(False))
    others = [c for c in rows.columns if c not in (*keys, "campo", "valor")]
    return joined.select(*keys, *others, "campo", F.when(hit, F.col("nuevo")).otherwise(F.col("valor")).alias("valor"), hit.alias("editado"))


def greedy_pairs(pairs: DataFrame, a: str, b: str, k: int, most: int = 100) -> DataFrame:
    """The first ``k`` pairs in order of their ids none of which repeats an id: ``orden``, ``a``, ``b``.

    One minimum per pair picked; ``k`` is at most ``most``, so that what is excluded stays a short list.
    """
    if k > most:
        raise ValueError(f"more than {most} pairs to pick one by one")
    used: list = []
    picked = []
    for i in range(1, k + 1):
        left = pairs.where(~F.col(a).isin(used) & ~F.col(b).isin(used)) if used else pairs
        best = left.agg(F.min(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias("p")).first()["p"]
        if best is None:
            break
        picked.append((i, best["a"], best["b"]))
        used += [best["a"], best["b"]]
    kinds = pairs.schema[a].dataType.simpleString()
    return pairs.sparkSession.createDataFrame(picked, f"orden int, a {kinds}, b {kinds}")


@dataclass
class Step:
    name: str
    run: Callable[[], object]


def run_steps(steps: list[Step]) -> list[dict]:
    """Runs steps in order: name, state (``ok``, ``error``, ``omitido``), seconds and error; after a failure the rest is left out."""
    report, failed = [], False
    for step in steps:
        if failed:
            report.append({"step": step.name, "state": "omitido", "seconds": 0.0, "error": None})
            continue
        began = time.perf_counter()
        try:
            step.run()
            error = None
        except Exception as e:  # noqa: BLE001 - any failure of a step is reported
            error, failed = f"{type(e).__name__}: {e}"[:500], True
        report.append({"step": step.name, "state": "error" if error else "ok", "seconds": round(time.perf_counter() - began, 3), "error": error})
    return report
