"""Jobs over files: raw to contract, valid rows per contract, run folders, exports, encoder measurements."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.functions import dates
from telar.functions.urls import canonical_url, host, short_id
from telar.operators.records import Step, run_steps
from telar.operators.row_recovery import Loaded
from telar.operators.tables import latest_per_key
from telar.operators.vectors import encode
from telar.session import cut
from telar.sources import readers, writers


def write_valid(loaded: Loaded, path: str) -> list[str]:
    """The valid rows of each contract as a table of its own under ``path``, and the errors of all as ``errores``."""
    written = []
    for name in loaded.contracts:
        writers.write_table(loaded.valid(name), f"{path}/{name}")
        written.append(name)
    writers.write_table(loaded.errors, f"{path}/errores")
    return written


def news_from_articles(articles: DataFrame, detected: str) -> DataFrame:
    """News of the contract from articles of search responses: identifier by address, dates in UTC, host as outlet."""
    moment, reason = dates.zoned(F.col("seendate"))
    page = canonical_url(F.col("url"))
    rows = articles.where("url is not null").select(
        short_id("NOT-", page).alias("id_noticia"), F.col("title").alias("titulo"), "url", F.coalesce("domain", host(F.col("url"))).alias("medio"), F.lower("language").alias("idioma"),
        dates.utc_text(moment).alias("fecha_publicacion"), reason.alias("motivo_fecha"), F.lit(detected).alias("fecha_deteccion"), F.col("subject").alias("tema"), F.lit("GDELT").alias("origen"),
    )
    first = F.min_by(F.struct(*[c for c in rows.columns if c != "id_noticia"]), F.struct(F.col("fecha_publicacion").isNull(), "fecha_publicacion", "url"))
    return rows.groupBy("id_noticia").agg(first.alias("r")).select("id_noticia", "r.*")


def convert_all(spark: SparkSession, raw: dict[str, str], out: str, detected: str) -> list[dict]:
    """Every raw source that is there to its contract table under ``out``, step by step with times; a failure stops the rest.

    ``raw`` names the paths of ``articulos``, ``sismos`` and ``indicadores``; a source without a path is no step.
    """
    made: dict[str, Callable[[str], DataFrame]] = {
        "articulos": lambda p: news_from_articles(readers.read_articles(spark, p), detected),
        "sismos": lambda p: readers.read_features(spark, p).where("id is not null").dropDuplicates(["id", "updated"]),
        "indicadores": lambda p: readers.read_indicator_responses(spark, p).withColumn("id_indicador", F.concat_ws("-", F.lit("IND"), "country", "indicator", "year")),
    }
    return run_steps([Step(n, lambda n=n, make=make: writers.write_table(make(raw[n]), f"{out}/{n}")) for n, make in made.items() if n in raw])


def keep_last_runs(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete all but the last ``keep`` run folders, by name, which begins with their time; returns what went."""
    files, place = writers._there(spark, path)
    runs = sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory())
    gone = runs[: max(len(runs) - max(keep, 0), 0)]
    for name in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return gone


def table_key(spark: SparkSession, path: str) -> str:
    """Size and last change of a table's files, which say whether a copy made from it still holds."""
    files, place = writers._there(spark, path)
    found = [s for s in files.listStatus(place) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return f"{sum(s.getLen() for s in found)}-{max((s.getModificationTime() for s in found), default=0)}-{len(found)}"


def derived_copy(spark: SparkSession, source: str, out: str, variant: str, make: Callable[[DataFrame], DataFrame]) -> tuple[str, bool]:
    """(path, made): the copy of a table for one variant, made anew only if the table has changed since."""
    path = f"{out}/{variant}/{table_key(spark, source)}"
    if writers.exists(spark, path):
        return path, False
    writers.write_table(make(spark.read.parquet(source)), path)
    return path, True


def newest_reports(spark: SparkSession, path: str, reports: dict[str, str]) -> dict[str, str]:
    """The newest file of each report by the time in its name; none of them if one is missing."""
    files, place = writers._there(spark, path)
    names = sorted(s.getPath().toString() for s in files.listStatus(place) if s.isFile())
    found = {r: [n for n in names if p in n.rsplit("/", 1)[-1]] for r, p in reports.items()}
    return {r: n[-1] for r, n in found.items()} if all(found.values()) else {}


def read_failure_log(spark: SparkSession, path: str) -> DataFrame:
    """Failures of extraction logs whose root is an array or an object that holds one: ``file``, ``url``, ``reason``."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("t"))
    kind = "array<struct<url:string,reason:string>>"
    rows = F.coalesce(F.when(F.ltrim("t").startswith("["), F.from_json("t", kind)), F.from_json("t", f"struct<failures:{kind}>")["failures"])
    return texts.select("file", F.explode(rows).alias("r")).select("file", "r.*")


def export_last(df: DataFrame, path: str, keys: list[str], order: list[str], reviewed: str) -> None:
    """JSON lines of the last row of each case that was reviewed, sorted by key."""
    writers.write_json(latest_per_key(df.where(F.col(reviewed)), keys, order), path, keys)


def encode_cached(df: DataFrame, text: str, encoder: Callable[[list[str]], object], size: int, model: str, path: str, column: str = "embedding") -> DataFrame:
    """``df`` with the vector of a text, each text encoded once per ``model`` (name and revision) and kept under ``path``.

    Entries are keyed by a hash of model and text; the text itself isn't stored. Null texts have no vector.
    """
    spark = df.sparkSession
    key = F.sha2(F.concat_ws("|", F.lit(model), F.col(text)), 256)
    keyed = df.withColumn("__key", F.when(F.col(text).isNotNull(), key))
    asked = keyed.where("__key is not null").select("__key", F.col(text).alias("__t")).dropDuplicates(["__key"])
    if writers.exists(spark, path):
        asked = asked.join(spark.read.parquet(path).select("__key"), "__key", "left_anti")
    fresh = cut(encode(asked, "__t", encoder, size, "__v").drop("__t"))
    if not fresh.isEmpty() or not writers.exists(spark, path):
        fresh.write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path).withColumnRenamed("__v", column), "__key", "left").drop("__key")


def measure_encoder(build: Callable[[], Callable[[list[str]], object]], texts: list[str], batch: int = 32) -> dict:
    """Seconds to build an encoder, texts a second, and the process's largest memory in bytes."""
    began = time.perf_counter()
    encode = build()
    loaded = time.perf_counter()
    for i in range(0, len(texts), batch):
        encode(texts[i : i + batch])
    spent = time.perf_counter() - loaded
    return {"load_s": loaded - began, "texts": len(texts), "texts_per_s": len(texts) / max(spent, 1e-9), "max_rss": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024}
