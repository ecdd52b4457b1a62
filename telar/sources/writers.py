"""Writers: deterministic text, partition replacement, upserts, append-only logs, fingerprints of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.operators.tables import upsert
from telar.session import cut


def write_csv(df: DataFrame, path: str, columns: list[str], key: list[str], parts: int | None = None) -> None:
    """Sorted CSV with a fixed order of columns, null as empty, LF ends. Sorted over all parts, one part where asked."""
    sorted_ = df.select(*columns).sort(*[F.col(k).asc_nulls_last() for k in key])
    (sorted_.coalesce(parts) if parts else sorted_).write.mode("overwrite").options(header=True, nullValue="", emptyValue="", lineSep="\n").csv(path)


def write_json(df: DataFrame, path: str, key: list[str]) -> None:
    """Sorted JSON lines with keys in order; null fields are written."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], line.alias("value")).sort(*[F.col(f"__k{i}").asc_nulls_last() for i in range(len(key))]).select("value").write.mode("overwrite").text(path)


def _there(spark: SparkSession, path: str):
    """(file system, path) of a Hadoop path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _there(spark, path)
    return bool(files.exists(place))


def write_table(df: DataFrame, path: str) -> None:
    """The whole table at once: written beside the old one, which makes room only when all files are there.

    A job that fails leaves the old table; one that dies between the two renames leaves both, the old one as
    ``path.old-…``. ``df`` may read from ``path``.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    beside, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    df.write.parquet(beside)
    files, place = _there(spark, path)
    new, gone = _there(spark, beside)[1], _there(spark, old)[1]
    if files.exists(place) and not files.rename(place, gone):
        raise OSError(f"{path} can't be moved")
    if not files.rename(new, place):
        files.rename(gone, place)
        raise OSError(f"{beside} can't be moved to {path}")
    files.delete(gone, True)


def replace_source(df: DataFrame, path: str, source: str) -> None:
    """Replace the partitions of the sources that ``df`` has and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Rows of ``new`` replace those of the same key; the merged table is written beside the old one and takes its place."""
    write_table(upsert(spark.read.parquet(path), new, keys), path)


def append_log(df: DataFrame, path: str) -> None:
    """Append JSON lines; nothing that is there is touched."""
    df.write.mode("append").json(path)


def file_prints(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``bytes`` and SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def put_in_cache(spark: SparkSession, path: str, entries: DataFrame, request: str) -> DataFrame:
    """Content-addressed store: ``key`` is the SHA-256 of the request; entries that are there are kept. Returns what was added."""
    keyed = entries.withColumn("key", F.sha2(F.col(request), 256)).dropDuplicates(["key"])
    known = spark.read.parquet(path).select("key") if exists(spark, path) else spark.createDataFrame([], "key string")
    fresh = cut(keyed.join(known, "key", "left_anti"))
    fresh.write.mode("append").parquet(path)
    return fresh


def get_from_cache(spark: SparkSession, path: str, requests: DataFrame, request: str) -> DataFrame:
    """Requests with their stored entry, null where there is none."""
    stored = spark.read.parquet(path).drop(request)
    return requests.withColumn("key", F.sha2(F.col(request), 256)).join(stored, "key", "left")


def prune_cache(spark: SparkSession, path: str, keep: DataFrame, request: str) -> int:
    """Drop the stored entries that no row of ``keep`` asks for; returns how many went."""
    stored = spark.read.parquet(path)
    asked = keep.select(F.sha2(F.col(request), 256).alias("key")).distinct()
    left = cut(stored.join(asked, "key", "left_semi"))
    gone = stored.count() - left.count()
    if gone:
        write_table(left, path)
    return gone


def append_positional(df: DataFrame, path: str) -> None:
    """Append rows by the position of their columns: names may differ, number and types must fit the table's."""
    schema = df.sparkSession.read.parquet(path).schema
    if len(schema) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns for a table of {len(schema)}")
    df.toDF(*schema.names).select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str, filled: str) -> bool:
    """Write a sheet unless one is there in which ``filled`` has a value: somebody's verdicts are never overwritten."""
    spark = df.sparkSession
    if exists(spark, path) and not spark.read.parquet(path).where(F.col(filled).isNotNull()).isEmpty():
        return False
    write_table(df, path)
    return True


def tree_changes(before: DataFrame, after: DataFrame, skip: str | None = None) -> DataFrame:
    """``file``, ``state`` (new, missing, changed) of two results of ``file_prints``; paths that match ``skip`` are left out."""
    state = F.when(F.col("a.sha256").isNull(), "new").when(F.col("b.sha256").isNull(), "missing").otherwise("changed")
    both = before.alias("a").join(after.alias("b"), "file", "full").where(~F.col("a.sha256").eqNullSafe(F.col("b.sha256")))
    return both.select("file", state.alias("state")).where(~F.col("file").rlike(skip) if skip else F.lit(True))
