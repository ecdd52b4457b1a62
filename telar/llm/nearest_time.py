"""Pairing records of two tables with the nearest in time of the same entity, within a tolerance.

Rows are cut into cells of (entity, day) and the cells hash-partitioned into Arrow groups. Inside each group DuckDB
runs a backward and a forward ASOF join; of the two candidates the nearer one within the tolerance stays.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.session import cut

_ASOF = """
WITH q AS MATERIALIZED (SELECT *, row_number() OVER () AS n FROM l),
     b AS (SELECT q.n, q.__row AS k, q.__key AS key, q.__copies AS copies, r.__id AS id, r.__t AS t, q.__t - r.__t AS d FROM q ASOF JOIN r ON q.__cell = r.__cell AND q.__t >= r.__t),
     f AS (SELECT q.n, q.__row AS k, q.__key AS key, q.__copies AS copies, r.__id AS id, r.__t AS t, r.__t - q.__t AS d FROM q ASOF JOIN r ON q.__cell = r.__cell AND q.__t <= r.__t),
     x AS (SELECT coalesce(b.k, f.k) AS row_id, coalesce(b.key, f.key) AS key, coalesce(b.copies, f.copies) AS copies, f.d IS NULL OR b.d <= f.d AS before,
                  b.id AS bid, f.id AS fid, b.t AS bt, f.t AS ft, CAST(least(b.d, f.d) AS BIGINT) AS distance_us FROM b FULL JOIN f ON b.n = f.n)
SELECT row_id, CASE WHEN before THEN bid ELSE fid END AS match_id, distance_us, CASE WHEN before THEN bt ELSE ft END AS match_t, key, copies
FROM x WHERE distance_us <= {tolerance}
"""


@lru_cache(maxsize=1)
def _connection():
    """One DuckDB per Python worker, which never spills: its groups are bounded."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def nearest_in_time(
    left: DataFrame, right: DataFrame, row: str, entity: str, time: str, right_id: str, right_entity: str, right_time: str,
    tolerance_s: int, cell_s: int = 86_400, cell_rows: int = 100_000, group_rows: int = 100_000,
) -> DataFrame:
    """``row_id``, ``match_id`` and ``distance_us`` of each left row that has a right row of its entity within ``tolerance_s``.

    * The nearest right row wins, before or after; at equal distance the earlier one, at one instant the smallest id.
    * The tolerance is inclusive. Rows without row, id, entity or time on either side take part in no pair.
    * Repeated left rows each give a row. Empty tables give an empty result. Other columns are ignored.

    A right row is sent to the cells it can reach, ``2 * tolerance / cell + 1`` of them. The rows of each cell are
    counted on both sides: a cell of more than ``cell_rows`` left rows (an entity that holds a third of all rows, a
    burst) is split by a hash of the row and gets its right rows in each part; one of more than ``cell_rows`` right rows
    is split by a hash of these, its left rows go to each part, and the nearest of the parts' answers is taken. There is
    a group for every ``group_rows`` rows counted, so that a task's size doesn't depend on the table's. Both sides are
    written to the checkpoint folder once, as key and time: counting and pairing read them.
    """
    size, reach = cell_s * 1_000_000, tolerance_s * 1_000_000

    def cell(micros: Column) -> Column:
        return F.floor(micros / size).cast("long")

    queries = cut(
        left.select(F.col(row).alias("__row"), F.col(entity).alias("__e"), F.unix_micros(F.col(time)).alias("__t"))
        .where("__row is not null and __e is not null and __t is not null").withColumn("__c", cell(F.col("__t")))
    )
    points = cut(
        right.select(F.col(right_id).alias("__id"), F.col(right_entity).alias("__e"), F.unix_micros(F.col(right_time)).alias("__t"))
        .where("__id is not null and __e is not null and __t is not null").groupBy("__e", "__t").agg(F.min("__id").alias("__id"))
    ).withColumn("__c", F.explode(F.sequence(cell(F.col("__t") - reach), cell(F.col("__t") + reach))))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = queries.select("__e", "__c", one.alias("l"), none.alias("r")).union(points.select("__e", "__c", none.alias("l"), one.alias("r")))
    counts = cut(both.groupBy("__e", "__c").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l > 0 and r > 0"))
    total = counts.agg(F.coalesce(F.sum(F.col("l") + F.col("r")), none)).first()[0]
    groups = max(1, -(-total // group_rows))
    share = lambda n: F.greatest(F.ceil(F.col(n) / cell_rows).cast("int"), F.lit(1))
    # Cells that only one side has are left out here; the others know how they are split.
    split = counts.select("__e", "__c", share("l").alias("__lparts"), share("r").alias("__rparts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    queries = queries.join(split, ["__e", "__c"]).withColumn("__l", own("__row", "__lparts")).withColumn("__r", every("__rparts"))
    points = points.join(split, ["__e", "__c"]).withColumn("__r", own("__id", "__rparts")).withColumn("__l", every("__lparts"))

    def placed(df: DataFrame, *columns: str) -> DataFrame:
        key = F.xxhash64("__e", "__c", "__l", "__r")
        name = F.concat_ws("\u0001", F.col("__e").cast("string"), "__c", "__l", "__r")
        return df.select(*columns, "__t", name.alias("__cell"), F.pmod(key, F.lit(groups)).alias("__group"))

    query = _ASOF.format(tolerance=reach)

    def asof(l: pa.Table, r: pa.Table) -> pa.Table:
        con = _connection()
        con.register("l", l)
        con.register("r", r)
        found = con.sql(query).to_arrow_table()
        con.unregister("l")
        con.unregister("r")
        return found.cast(schema)

    from pyspark.sql.pandas.types import to_arrow_type

    types = {"row_id": left.schema[row].dataType, "match_id": right.schema[right_id].dataType}
    extra = {"match_t": "bigint", "key": "bigint", "copies": "bigint"}
    schema = pa.schema([(n, to_arrow_type(t)) for n, t in types.items()] + [("distance_us", pa.int64()), *[(n, pa.int64()) for n in extra]])
    ddl = ", ".join([f"{n} {t.simpleString()}" for n, t in types.items()] + ["distance_us bigint", *[f"{n} {k}" for n, k in extra.items()]])

    def pairs(queries: DataFrame, points: DataFrame) -> DataFrame:
        left_side, right_side = placed(queries, "__row", "__key", "__copies"), placed(points, "__id")
        return left_side.groupBy("__group").cogroup(right_side.groupBy("__group")).applyInArrow(asof, ddl)

    plain = queries.where("__rparts = 1").withColumns({"__key": none, "__copies": one})
    found = pairs(plain, points.where("__rparts = 1")).select("row_id", "match_id", "distance_us")
    if counts.where(F.col("r") > cell_rows).isEmpty():
        return found
    # Cells of many right rows: left rows that repeat are one until the parts' answers have been compared.
    crowded = queries.where("__rparts > 1").groupBy("__row", "__e", "__t", "__c", "__l", "__r").agg(F.count(one).alias("__copies"))
    parts = pairs(crowded.withColumn("__key", F.xxhash64("__e", "__t")), points.where("__rparts > 1"))
    nearest = F.min(F.struct("distance_us", "match_t", "match_id"))
    best = parts.groupBy("row_id", "key").agg(nearest.alias("b"), F.max("copies").alias("n"))
    return found.union(best.select("row_id", "b.match_id", "b.distance_us", F.explode(F.sequence(one, F.col("n"))).alias("k")).drop("k"))


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_ISO = r"^(\d{4})-?(\d{2})-?(\d{2})[Tt ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?\s*([Zz]|GMT|UTC|[+-]\d{2}(?::?\d{2})?)$"
_PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:[0-5]\dZ$"
_RFC = r"^(?:[A-Za-z]{3,},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{2}):(\d{2})(?::(\d{2}))?()\s*([Zz]|GMT|UTC|UT|[+-]\d{2}:?\d{2})$"


def instant(text: Column) -> Column:
    """The instant a date text names, as a timestamp; null unless it has a time of day and a Z, GMT or UTC offset.

    Understood are ISO 8601 in extended and basic form and the dates of mail headers. Impossible dates give null. The
    commonest form is read by a cast, the others by their parts.
    """
    text = F.trim(text)
    return F.when(text.rlike(_PLAIN), text.try_cast("timestamp")).otherwise(_by_parts(text))


def _by_parts(text: Column) -> Column:
    iso, rfc = (lambda i: F.regexp_extract(text, _ISO, i)), (lambda i: F.regexp_extract(text, _RFC, i))
    is_iso = text.rlike(_ISO)
    month = F.lit(None)
    for i, name in enumerate(_MONTHS, 1):
        month = F.when(F.lower(rfc(2)) == name, F.lit(str(i))).otherwise(month)

    def part(i: int, j: Column) -> Column:
        return F.when(is_iso, iso(i)).otherwise(j).try_cast("int")

    second = F.coalesce(F.when(is_iso, iso(6)).otherwise(rfc(6)).try_cast("int"), F.lit(0))
    fraction = F.coalesce(F.rpad(iso(7), 6, "0").try_cast("int"), F.lit(0))
    zone = F.when(is_iso, iso(8)).otherwise(rfc(8))
    digits = F.translate(zone, "+-:", "")
    minutes = F.when(zone.rlike("^[+-]"), F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))
    offset = F.coalesce(F.when(zone.startswith("-"), -minutes).otherwise(minutes), F.lit(0))
    made = F.try_make_timestamp(part(1, rfc(3)), part(2, month), part(3, rfc(1)), part(4, rfc(4)), part(5, rfc(5)), second.cast("decimal(16,6)"), F.lit("UTC"))
    micros = F.unix_micros(made) + fraction - offset.cast("bigint") * 60_000_000
    return F.when(is_iso | text.rlike(_RFC), F.timestamp_micros(micros))
