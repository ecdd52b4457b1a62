"""Readers of the raw formats: text CSV, keyed JSON, GeoJSON, feeds, indicator and article responses, tables in text."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_to_null(column: Column) -> Column:
    """Trimmed text; blank is null, never a value."""
    return F.nullif(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""), F.lit(""))


def read_csv_text(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): every cell as trimmed text, blank as null; lines of another width apart, none fails the load."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_line", T.StringType())])
    options = {"header": header, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", "quote": '"', "escape": '"', "multiLine": True, "enforceSchema": True}
    read = spark.read.options(**options).schema(schema).csv(path)
    rows = read.where(F.col("_line").isNull()).select(*[blank_to_null(F.col(c)).alias(c) for c in columns])
    # The reader refuses a scan of the malformed lines alone; Python's identity keeps the other columns in the scan.
    kept = read.where(F.col("_line").isNotNull()).mapInArrow(lambda batches: batches, schema)
    return rows, kept.select(F.col("_line").alias("line"))


def read_json_rows(spark: SparkSession, path: str, schema: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of files that hold an array, or an object with an array under ``key``; a bad file is a row, not an error."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    kind = f"array<struct<{schema}>>"
    body = F.from_json("text", f"struct<`{key}`:{kind}>")[key] if key else F.from_json("text", kind)
    parsed = texts.select("file", body.alias("rows"))
    rows = parsed.select("file", F.explode("rows").alias("r")).where("r is not null").select("file", "r.*")
    return rows, parsed.where("rows is null").select("file", F.lit("json ilegible").alias("reason"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank lines are skipped and unreadable ones are rows of nulls with ``_line``."""
    return spark.read.schema(f"{schema}, _line string").option("columnNameOfCorruptRecord", "_line").json(path)


_FEATURE = "type string, properties struct<id:string,mag:double,place:string,time:bigint,updated:bigint,status:string,url:string>, geometry struct<coordinates:array<double>>, id string"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of a collection of point features: times as UTC text, coordinates as longitude, latitude and depth."""
    rows, _ = read_json_rows(spark, path, ", ".join(_named(_FEATURE)), key="features")
    moment = lambda c: F.date_format(F.to_utc_timestamp(F.timestamp_millis(F.col(c)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    place = lambda i: F.get("geometry.coordinates", F.lit(i))
    return rows.select(
        F.coalesce("id", "properties.id").alias("id"), F.col("properties.mag").alias("magnitude"), moment("properties.time").alias("time"), moment("properties.updated").alias("updated"),
        place(0).alias("longitude"), place(1).alias("latitude"), place(2).alias("depth"), F.col("properties.place").alias("place"), F.col("properties.status").alias("status"), F.col("properties.url").alias("url"),
    )


def _named(ddl: str) -> list[str]:
    """``a int, b struct<...>`` as ``a:int`` parts, commas inside brackets left alone."""
    parts, depth, word = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(word.strip())
            word = ""
        else:
            word += c
    return [p.replace(" ", ":", 1) for p in [*parts, word.strip()]]


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link, pubDate, category and description as text."""
    schema = "title string, link string, pubDate string, category array<string>, description string"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).select(
        *[blank_to_null(F.col(c)).alias(c) for c in ("title", "link", "pubDate", "description")], "category"
    )


def read_articles(spark: SparkSession, path: str, name_pattern: str = r"gdelt_(.+?)(?:__|_[0-9]{14})") -> DataFrame:
    """Articles of search responses; the subject is read from the file's name."""
    rows, _ = read_json_rows(spark, path, "url:string, title:string, seendate:string, domain:string, language:string, sourcecountry:string", key="articles")
    return rows.select(F.regexp_extract("file", name_pattern, 1).alias("subject"), *[blank_to_null(F.col(c)).alias(c) for c in ("url", "title", "seendate", "domain", "language", "sourcecountry")])


def read_indicator_responses(spark: SparkSession, path: str, stamp: str = r"([0-9]{8}T[0-9]{6}Z)") -> DataFrame:
    """Values of ``[meta, rows]`` responses; of each indicator only the newest file by the time in its name counts."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    kind = "array<struct<indicator:struct<id:string>,countryiso3code:string,date:string,value:double>>"
    rows = texts.select(F.regexp_extract("file", stamp, 1).alias("stamp"), F.explode(F.from_json(F.get_json_object("text", "$[1]"), kind)).alias("r"))
    flat = rows.select("stamp", F.col("r.indicator.id").alias("indicator"), F.col("r.countryiso3code").alias("country"), F.col("r.date").try_cast("int").alias("year"), F.col("r.value").alias("value"))
    newest = flat.groupBy("indicator").agg(F.max("stamp").alias("stamp"))
    return flat.join(newest, ["indicator", "stamp"]).select("indicator", "country", "year", "value")


def read_markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the pipe tables of text files that have as many cells as ``columns``; header and rule lines are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|.*\|\s*$") & ~F.col("value").rlike(r"^[\s|:-]+$"))
    cells = F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"(?<!\\)\|")
    rows = lines.select(cells.alias("c")).where(F.size("c") == len(columns))
    named = rows.select(*[blank_to_null(F.get("c", F.lit(i))).alias(c) for i, c in enumerate(columns)])
    return named.where(~(F.lower(F.col(columns[0])) == columns[0].lower()) | F.col(columns[0]).isNull())


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """Counts of test suites: name, tests, failures, errors, skipped, seconds."""
    schema = "_name string, _tests int, _failures int, _errors int, _skipped int, _time double"
    read = spark.read.format("xml").option("rowTag", "testsuite").schema(schema).load(path)
    return read.select(*[F.col(f"_{c}").alias(n) for c, n in zip(("name", "tests", "failures", "errors", "skipped", "time"), ("suite", "tests", "failures", "errors", "skipped", "seconds"))])


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_cells(content: bytes) -> Iterator[tuple[str, str | None]]:
    """(reference, text) of the cells of a workbook's first sheet, with shared texts resolved."""
    import io

    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(x.text or "" for x in item.iter(f"{{{_NS['m']}}}t")) for item in root.findall("m:si", _NS)]
        sheet = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
        for cell in sheet.iter(f"{{{_NS['m']}}}c"):
            value, inline = cell.find("m:v", _NS), cell.find("m:is/m:t", _NS)
            text = inline.text if inline is not None else value.text if value is not None else None
            yield cell.get("r", ""), shared[int(text)] if cell.get("t") == "s" and text is not None else text


def read_workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``row``, ``col``, ``text`` of every cell of workbooks' first sheets, one task per file."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(sheet_cells(content))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["file", "ref", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    raw = files.mapInArrow(cells, "file string, ref string, text string")
    return raw.select("file", F.regexp_extract("ref", "([0-9]+)", 1).cast("int").alias("row"), F.regexp_extract("ref", "([A-Z]+)", 1).alias("col"), blank_to_null(F.col("text")).alias("text"))


def read_series(spark: SparkSession, path: str, label: str, header_row: int, label_row: int) -> DataFrame:
    """``period``, ``value`` of the series in one row under a row of periods (YYYY-MM); its label is checked."""
    cells = read_workbook_cells(spark, path)
    named = cells.where(F.col("row") == label_row)
    if named.where(F.col("col") == "A").where(F.col("text") == label).isEmpty():
        raise ValueError(f"row {label_row} isn't the series {label!r}")
    periods = cells.where((F.col("row") == header_row) & F.col("text").rlike(r"^\d{4}-\d{2}$")).select("file", "col", F.col("text").alias("period"))
    return periods.join(named.select("file", "col", F.col("text").try_cast("double").alias("value")), ["file", "col"], "left").select("period", "value")


def route_files(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """``file``, ``kind`` by name pattern, first match; a file that none matches has the kind ``desconocido``."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length"))
    kind = F.lit("desconocido")
    for name, pattern in reversed(patterns.items()):
        kind = F.when(F.col("file").rlike(pattern), F.lit(name)).otherwise(kind)
    return files.withColumn("kind", kind)


def response_state(text: Column, cap: int, seconds: Column, least: int) -> Column:
    """State of a search response: ok, empty (unresolved, never zero), invalid, or truncated at the cap if its range can be halved."""
    articles = F.from_json(text, "struct<articles:array<struct<url:string>>>")["articles"]
    return (
        F.when(F.trim(text) == "", "vacio").when(text.isNull() | articles.isNull(), "invalido")
        .when((F.size(articles) >= cap) & (seconds / 2 >= least), "truncado").otherwise("ok")
    )
