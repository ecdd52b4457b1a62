"""Records that differ only in dress: dictionary encoding of canonical values and grouping of integer tuples.

Each distinct value of a column is canonicalised once and gets an integer identifier of 128 bits, two hashes of its
canonical form: the same on every worker and when a lost partition is computed again, with no pass to number values.
(Of 10^12 distinct values two share an identifier with a probability of 10^-15.) Records become integer tuples
sorted by field, which are what is grouped.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.session import cut

_DRESS = re.compile(r"[^\w\u0300-\u036f]+|_+")


def canonical_text(text: str) -> str:
    """Letters and digits in order: HTML escapes resolved, composed, without case, white space and punctuation."""
    while "&" in text and (plain := html.unescape(text)) != text:
        text = plain
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        folded = text.casefold()
        text = unicodedata.normalize("NFC", folded) if not folded.isascii() else folded
    else:
        text = text.lower()
    return _DRESS.sub("", text)


# What a page's address may carry without being another page.
TRACKING = frozenset("fbclid gclid igshid mc_cid mc_eid ref ref_src".split())
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://|^//")
_AMP = re.compile(r"(?:^|/)amp$")


def _is_tracking(parameter: str) -> bool:
    name, _, value = parameter.partition("=")
    return (
        not parameter or name in TRACKING or name.startswith("utm_")
        or (name == "outputType" and value == "amp") or (name == "amp" and value.lower() in ("1", "true"))
    )


def canonical_url(url: str) -> str:
    """The page an address names: no scheme, host case, www. or m., default port, fragment, tracking, final / or /amp."""
    rest = _SCHEME.sub("", url.strip(), count=1).partition("#")[0]
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    host = host.lower()
    name, colon, port = host.rpartition(":")
    if colon and port in ("80", "443", ""):
        host = name
    for prefix in ("www.", "m."):
        if host.startswith(prefix):
            host = host[len(prefix):]
            break
    path = path.rstrip("/")
    path = _AMP.sub("", path).rstrip("/")
    kept = sorted(p for p in query.split("&") if not _is_tracking(p)) if query else []
    return f"{host}/{path}" + ("?" + "&".join(kept) if kept else "")


def _udf(canonical: Callable[[str], str]):
    def convert(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else canonical(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(convert, T.StringType())


def _identifier(value: Column, name: str) -> list[Column]:
    """128 bits of a text as two integers."""
    return [F.xxhash64(F.lit(1), value).alias(f"{name}h"), F.xxhash64(F.lit(2), value).alias(f"{name}l")]


def dictionary(df: DataFrame, column: str, canonical: Callable[[str], str]) -> DataFrame:
    """Identifiers of each distinct non-null value (``rh``, ``rl``) and of its canonical form (``ch``, ``cl``)."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    canon = values.withColumn("canon", _udf(canonical)("value"))
    return canon.select(*_identifier(F.col("value"), "r"), *_identifier(F.col("canon"), "c"))


def encode(df: DataFrame, row: str, columns: dict[str, Callable[[str], str]]) -> DataFrame:
    """``row`` and ``record``: the integers of the record's canonical values, in the order of the fields.

    Records with a null field are left out. Rows meet the dictionaries by the identifiers of their raw values, so each
    distinct text is shuffled once, for its dictionary, and rows are integers from the start.
    """
    kept = df.select(F.col(row).alias("__row"), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        kept = kept.where(F.col(f"__v{i}").isNotNull())
    coded = kept.select("__row", *[x for i in range(len(columns)) for x in _identifier(F.col(f"__v{i}"), f"__r{i}")])
    for i, canonical in enumerate(columns.values()):
        codes = dictionary(kept, f"__v{i}", canonical).toDF(f"__d{i}h", f"__d{i}l", f"__c{i}h", f"__c{i}l")
        same = (F.col(f"__r{i}h") == F.col(f"__d{i}h")) & (F.col(f"__r{i}l") == F.col(f"__d{i}l"))
        coded = coded.join(codes, same).drop(f"__r{i}h", f"__r{i}l", f"__d{i}h", f"__d{i}l")
    return coded.select(F.col("__row").alias(row), F.array(*[f"__c{i}{x}" for i in range(len(columns)) for x in "hl"]).alias("record"))


def duplicate_records(df: DataFrame, row: str, columns: dict[str, Callable[[str], str]]) -> DataFrame:
    """``record``, ``first`` (its smallest row) and ``copies`` of each record.

    * Two rows are one record if every field of ``columns`` has the same canonical value. Copies may be any number,
      a third of all rows too: they are counted by partial aggregation and never gathered.
    * Rows in which one of the fields is null are no record. Empty texts are values like any other.
    * ``row`` must be unique. An empty table gives an empty result; other columns are ignored.
    """
    return encode(df, row, columns).groupBy("record").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"))


def duplicate_rows(df: DataFrame, row: str, columns: dict[str, Callable[[str], str]]) -> DataFrame:
    """``first`` and ``row`` of each row that repeats an earlier record; each copy is linked to the first only.

    The compact tuples are written to the checkpoint folder once: grouping and linking both read them.
    """
    encoded = cut(encode(df, row, columns))
    groups = (
        encoded.groupBy("record").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select(F.col("record").alias("r"), "first")
    )
    return encoded.join(groups, F.col("record") == F.col("r")).where(F.col(row) > F.col("first")).select("first", F.col(row).alias("row"))
