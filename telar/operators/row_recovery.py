"""Rows that break their file contract: a grammar that recovers from errors, typed rows and located faults.

The grammar is read by recursive descent::

    text   := record (newline record)*
    record := field ("," field)*
    field  := '"' (any character but '"' | '""')* '"'  |  (any character but '"' and ",")*

After a broken quote the parser resumes at the next record-start anchor. In whole files (``parse_text``) that is a line
that begins like a record and reads as a whole record of the expected width, and each line between is a fault with its
place and reason; in tables of lines (``parse_lines``) a block of lines is one text and its lines' beginnings are the
anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.session import cut


class Fault(Exception):
    def __init__(self, at: int, reason: str):
        super().__init__(reason)
        self.at, self.reason = at, reason


@dataclass
class Grammar:
    """Recursive descent over one text. ``newline`` ends a record outside quotes; None: the text is one record.

    ``limit`` is where the next record is known to begin: a quote that isn't closed before it is never closed.
    """

    text: str
    newline: str | None = None
    limit: int | None = None

    def __post_init__(self) -> None:
        self.stops = re.compile('[",]' if self.newline is None else f'[",{self.newline}]')

    def record(self, at: int) -> tuple[list[str | None], int]:
        value, at = self.field(at)
        values = [value]
        while at < len(self.text) and self.text[at] == ",":
            value, at = self.field(at + 1)
            values.append(value)
        return values, at

    def field(self, at: int) -> tuple[str | None, int]:
        value, at = self.quoted(at) if self.text.startswith('"', at) else self.bare(at)
        return value.strip() or None, at

    def quoted(self, at: int) -> tuple[str, int]:
        opened, parts, at = at, [], at + 1
        while True:
            close = self.text.find('"', at, self.limit)
            if close < 0:
                raise Fault(opened, "comillas sin cerrar")
            parts.append(self.text[at:close])
            if self.text.startswith('""', close):
                parts.append('"')
                at = close + 2
                continue
            at = close + 1
            rest = self.text[at : at + 2]
            returned = self.newline == "\n" and rest == "\r\n"
            if rest[:1] not in ("", ",", self.newline) and not returned:
                raise Fault(at, "texto tras las comillas de cierre")
            return "".join(parts), at + returned

    def bare(self, at: int) -> tuple[str, int]:
        found = self.stops.search(self.text, at)
        end = found.start() if found else len(self.text)
        if found and found.group() == '"':
            raise Fault(end, "comillas dentro de un campo sin comillas")
        return self.text[at:end], end


def parse_text(text: str, width: int, anchor: str) -> Iterator[tuple[int, list[str | None] | None, int, str | None]]:
    """(offset, fields or None, offset of the fault or -1, reason) of each record of a whole file's text.

    ``anchor`` is a pattern for the beginning of a record. After a broken quote the next line that matches it and reads as
    a record of ``width`` fields is where parsing resumes, so that a quote that is never closed costs one record; each
    line skipped on the way is a fault of its own. After a wrong number of fields parsing goes on at the record's end,
    unless such a line lies within the record, which then has a broken quote too. Empty lines are no records.
    """
    grammar, start = Grammar(text, "\n"), re.compile(r"(?:^|(?<=\n))(?=" + anchor + ")")
    at = 0
    while at < len(text):
        if blank := _BLANK.match(text, at):
            at = blank.end()
            continue
        end = None
        try:
            values, end = grammar.record(at)
            if len(values) == width:
                yield at, values, -1, None
                at = end + 1
                continue
            place, reason = at, f"{len(values)} campos en vez de {width}"
        except Fault as fault:
            place, reason = fault.at, fault.reason
        yield at, None, place, reason
        resume = _resume(grammar, start, at, width, len(text) if end is None else end)
        if resume is None and end is not None:
            at = end + 1
            continue
        resume = len(text) if resume is None else resume
        for line in _LINE.finditer(text, _line_end(text, at), resume):
            yield line.start(), None, line.start(), "línea saltada tras un registro roto"
        at = resume


_BLANK, _LINE = re.compile(r"\r?(?:\n|\Z)"), re.compile(r"(?!\r?(?:\n|\Z))[^\n]+")


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end + 1


def _resume(grammar: Grammar, start: re.Pattern, at: int, width: int, limit: int) -> int | None:
    """The next anchored line before ``limit`` that reads as a record of ``width`` fields."""
    for found in start.finditer(grammar.text, at + 1, limit):
        try:
            if len(grammar.record(found.start())[0]) == width:
                return found.start()
        except Fault:
            continue
    return None


@dataclass(frozen=True)
class Contract:
    """What a file promises. Patterns are whole-value; ``checks`` maps a fault to its (column, pattern) pairs."""

    columns: tuple[str, ...]
    required: tuple[str, ...]
    key: tuple[str, ...]
    either: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    years: tuple[tuple[str, int, int], ...] = ()
    types: dict[str, str] = field(default_factory=dict)
    anchor: str = ".+,"


DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
URL = r"(?U)^https?://[^\s/?#]+([/?#]\S*)?$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# The two file contracts.
NEWS = Contract(
    columns=("id_noticia", "titulo", "url", "medio", "idioma", "fecha_publicacion", "fecha_deteccion", "fecha_extraccion", "tema", "origen", "alcance_texto"),
    required=("id_noticia", "titulo", "url", "medio"),
    either=(("fecha_publicacion", "fecha_deteccion"),),
    key=("id_noticia",),
    checks={
        "id_formato_invalido": (("id_noticia", r"^(NOT-[0-9a-f]{10}|SYN-[A-Z0-9]+-[0-9]+)$"),),
        "url_mal_formada": (("url", URL),),
    },
    dates=("fecha_publicacion", "fecha_deteccion", "fecha_extraccion"),
    types=dict.fromkeys(("fecha_publicacion", "fecha_deteccion", "fecha_extraccion"), "timestamp"),
    anchor=r'"?\s*(?:NOT-|SYN-)',
)
INDICATORS = Contract(
    columns=("id_indicador", "pais_iso3", "indicador_id", "anio", "valor", "unidad", "fuente_url", "fecha_extraccion", "licencia"),
    required=("pais_iso3", "indicador_id", "anio", "unidad", "fuente_url", "fecha_extraccion", "licencia"),
    key=("pais_iso3", "indicador_id", "anio"),
    checks={
        "id_formato_invalido": (("id_indicador", r"^IND-[A-Z]{3}-[A-Za-z0-9._]+-[0-9]{4}$"),),
        "url_mal_formada": (("fuente_url", URL),),
        "valor_invalido": (("pais_iso3", r"^[A-Z]{3}$"), ("valor", NUMBER)),
    },
    dates=("fecha_extraccion",),
    years=(("anio", 1960, 2100),),
    types={"anio": "int", "valor": "double", "fecha_extraccion": "timestamp"},
    anchor=r'"?\s*(?:IND-|,)',
)
CONTRACTS = {"noticias": NEWS, "indicadores": INDICATORS}

def parse_lines(lines: list[str | None]) -> Iterator[tuple[list[str | None] | None, int | None, str | None]]:
    """(fields or None, place of the fault in the line, reason) of each line of a block, read as one text.

    The lines' beginnings are the record-start anchors. An anchor is valid if the record before it ends there; after a
    broken quote parsing resumes at the next one, so that a quote costs its own line only. A final carriage return is
    ignored, line breaks inside quotes are data.
    """
    texts = [(line or "").removesuffix("\r") for line in lines]
    whole = "".join(texts)
    # Records end with a character that no line holds.
    end = next(c for c in map(chr, range(0x1E, 0x110000)) if c not in whole and c not in '",]\\^-')
    grammar, at = Grammar(end.join([*texts, ""]), end), 0
    for line, text in zip(lines, texts):
        grammar.limit = at + len(text)
        try:
            if line is None:
                raise Fault(at, "línea nula")
            values, stop = grammar.record(at)
            if stop != grammar.limit:
                raise Fault(stop, "texto tras el registro")
            yield values, None, None
        except Fault as fault:
            yield None, fault.at - at, fault.reason
        at = grammar.limit + 1


_PARSED = T.StructType().add("fields", T.ArrayType(T.StringType())).add("at", T.IntegerType()).add("reason", T.StringType())
BLOCK_LINES = 2000


@F.arrow_udf(_PARSED)
def _parse_block(lines: pa.Array) -> pa.Array:
    """The records of a batch of lines, in blocks of at most ``BLOCK_LINES``."""
    every, found = lines.to_pylist(), []
    for i in range(0, len(every), BLOCK_LINES):
        found.extend(parse_lines(every[i : i + BLOCK_LINES]))
    fields, places, reasons = zip(*found) if found else ((), (), ())
    return pa.StructArray.from_arrays(
        [pa.array(fields, pa.list_(pa.string())), pa.array(places, pa.int32()), pa.array(reasons, pa.string())], ["fields", "at", "reason"]
    )


def _instant(value: Column) -> Column:
    """The timestamp of a strict UTC text, null if it isn't a real date and time."""
    real = value.rlike(DATE) & ~value.startswith("0000")
    return F.when(real, F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def _checks(contract: Contract, fields: Column) -> Column:
    """Array of (tipo_error, motivo) of a record of the right width."""
    at = {c: F.get(fields, F.lit(i)) for i, c in enumerate(contract.columns)}
    wrong: dict[str, list[Column]] = {}

    def add(kind: str, condition: Column, motive: str) -> None:
        wrong.setdefault(kind, []).append(F.when(condition, F.lit(motive)))

    for c in contract.required:
        add("obligatorio_vacio", at[c].isNull(), c)
    for group in contract.either:
        missing = F.lit(True)
        for c in group:
            missing = missing & at[c].isNull()
        add("obligatorio_vacio", missing, " y ".join(group))
    for kind, pairs in contract.checks.items():
        for c, pattern in pairs:
            add(kind, ~at[c].rlike(pattern), c)
    for c in contract.dates:
        add("fecha_invalida", at[c].isNotNull() & _instant(at[c]).isNull(), c)
    for c, low, high in contract.years:
        good = at[c].rlike("^[0-9]{4}$") & at[c].try_cast("int").between(low, high)
        add("valor_invalido", at[c].isNotNull() & ~F.coalesce(good, F.lit(False)), c)
    found = []
    for kind, motives in wrong.items():
        motive = F.concat_ws(", ", *motives)
        found.append(F.when(motive != "", F.struct(F.lit(kind).alias("tipo_error"), motive.alias("motivo"))))
    return F.array_compact(F.array(*found))


@dataclass
class Loaded:
    """``rows``: each line with its fields and errors; ``errors``: a row per line and fault; ``valid(name)``: typed rows."""

    rows: DataFrame
    contracts: dict[str, Contract]

    @property
    def errors(self) -> DataFrame:
        return self.rows.where("size(errors) > 0").select("id", "file", "position", F.explode("errors").alias("e")).select("id", "file", "position", "e.*")

    def valid(self, name: str) -> DataFrame:
        contract = self.contracts[name]
        columns = []
        for i, c in enumerate(contract.columns):
            value, kind = F.get("fields", F.lit(i)), contract.types.get(c, "string")
            columns.append((_instant(value) if kind == "timestamp" else value.try_cast(kind)).alias(c))
        good = self.rows.where((F.col("contract") == name) & (F.size("errors") == 0))
        return good.select(F.col("id").alias("id_linea"), F.col("file").alias("archivo"), F.col("position").alias("fila"), *columns)


def load_lines(df: DataFrame, id: str, contract: str, file: str, position: str, line: str, contracts: dict[str, Contract] = CONTRACTS) -> Loaded:
    """Separate the lines that break their contract, with the reasons, from the rows that load.

    * A line of another width or with broken quoting has only ``estructura_invalida``; the motive says what and where.
    * A null line, or one whose contract is null or unknown, is ``estructura_invalida`` too.
    * A line without other errors is ``id_duplicado`` if an earlier error-free line of its file has the same key;
      lines at the same position don't exclude each other. Repeated rows keep their ids and are judged by position.
    * Very long lines are parsed whole. An empty table gives empty results; other columns are ignored.

    Each Arrow batch is read by the recovering grammar in blocks of lines (``parse_lines``). The first position per (file, key) is found by a grouped minimum, so a key that fills a third of the rows is
    reduced before the shuffle. The parsed lines are written to the checkpoint folder once: both passes read them.
    """
    lines = df.select(
        F.col(id).alias("id"), F.col(contract).alias("contract"), F.col(file).alias("file"), F.col(position).alias("position"), _parse_block(F.col(line)).alias("p")
    )
    checked = F.array(F.struct(F.lit("estructura_invalida").alias("tipo_error"), F.lit("contrato desconocido").alias("motivo")))
    key = F.lit(None).cast("array<string>")
    for name, c in contracts.items():
        width = F.size("p.fields")
        broken = F.when(
            F.col("p.fields").isNull(), F.concat("p.reason", F.lit(" en el carácter "), F.col("p.at") + 1)
        ).when(width != len(c.columns), F.concat(width, F.lit(f" campos en vez de {len(c.columns)}")))
        structure = F.array(F.struct(F.lit("estructura_invalida").alias("tipo_error"), broken.alias("motivo")))
        is_it = F.col("contract") == name
        checked = F.when(is_it, F.when(broken.isNotNull(), structure).otherwise(_checks(c, F.col("p.fields")))).otherwise(checked)
        key = F.when(is_it, F.array(*[F.get("p.fields", F.lit(c.columns.index(k))) for k in c.key])).otherwise(key)
    parsed = cut(lines.select("id", "contract", "file", "position", F.col("p.fields").alias("fields"), checked.alias("errors"), key.alias("key")))
    clean = parsed.where("size(errors) = 0")
    firsts = (
        clean.groupBy("contract", "file", "key").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("contract").alias("c"), F.col("file").alias("f"), F.col("key").alias("k"), "first")
    )
    repeated = F.array(F.struct(F.lit("id_duplicado").alias("tipo_error"), F.concat(F.lit("ya está en la fila "), F.col("first")).alias("motivo")))
    same = (F.col("contract") == F.col("c")) & F.col("file").eqNullSafe(F.col("f")) & (F.col("key") == F.col("k")) & (F.size("errors") == 0)
    rows = parsed.join(firsts, same, "left").select(
        "id", "contract", "file", "position", "fields", F.when(F.col("position") > F.col("first"), repeated).otherwise(F.col("errors")).alias("errors")
    )
    return Loaded(rows, contracts)


def read_files(spark: SparkSession, path: str, contract: Contract, header: bool = False) -> DataFrame:
    """Rows of whole CSV files, across broken quotes: file, offset, fields, and place and reason of a fault.

    Each file is read as one text, so files must fit a task; ``load_lines`` takes tables of lines of any size.
    """
    width, anchor = len(contract.columns), contract.anchor

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = text.find("\n") + 1 if header else 0
                rows = [(name, at + o, f, e if e < 0 else at + e, r) for o, f, e, r in parse_text(text[at:], width, anchor)]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())],
                    ["file", "offset", "fields", "fault_at", "reason"],
                )

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return texts.mapInArrow(parse, "file string, offset long, fields array<string>, fault_at long, reason string")
