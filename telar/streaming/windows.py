"""Structured Streaming: windows over event time, late rows, deduplication and state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.session import checkpoint_dir


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a folder of Parquet files, immutable ones that accumulate, or of one file.

    The schema is the one they have now; timestamps without a zone become instants, which event time needs.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        stream = reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    else:
        stream = reader.parquet(path)
    local = [f.name for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else stream


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows and sum per window and key; windows tumble, or slide where told."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "1 day") -> DataFrame:
    """Sessions per key, closed by a gap."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "90 days") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def last_state(events: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The last row per key, folded over the stream."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("s")).select(*keys, "s.*")


def run_once(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and return the table its batches leave.

    Batches are written to the checkpoint folder by ``foreachBatch``, each to a directory of its own number, so a batch
    that is run again replaces itself. In ``append`` mode the table is all of them: windows come out when the watermark
    has passed them, their state goes, and rows later than that are dropped. In ``update`` mode a later batch's row
    replaces the earlier one of the same ``keys``. In ``complete`` mode, for small states only, it is the last batch.
    """
    spark = stream.sparkSession
    home = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/batches/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    rows = spark.read.parquet(f"{home}/batches")
    if mode != "update":
        return rows.drop("batch")
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("s")).select(*keys, "s.*")
