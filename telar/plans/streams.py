"""Queries that run as streams and must give what the batch gives (an extension: the pipeline itself is batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.plans.registry import Registry, Tables
from telar.streaming import windows

# What the watermark of a day has passed when all events are read.
_CLOSED = "date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 1 DAY"

registry = Registry()
query = registry.query


def _events(t: Tables) -> DataFrame:
    return windows.file_stream(t.spark, f"{t.dir}/events.parquet")


@query("t01_ventana_fija", f"SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) WHERE \"end\" <= {_CLOSED}")
def tumbling(t: Tables) -> DataFrame:
    """Daily windows per event type, as the watermark closes them."""
    return windows.run_once(windows.windowed_counts(_events(t), "ts", ["event_type"], "value", "1 day"), "append")


@query("t02_ventana_deslizante", f"""
WITH h AS (SELECT ts, value, event_type, unnest([0, 1]) AS k FROM events)
SELECT * FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS start, time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM h GROUP BY ALL) WHERE "end" <= {_CLOSED}""")
def sliding(t: Tables) -> DataFrame:
    """T4: windows of a day every twelve hours, as the watermark closes them."""
    return windows.run_once(windows.windowed_counts(_events(t), "ts", ["event_type"], "value", "1 day", "12 hours"), "append")


@query("t03_sesiones", f"""
WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nuevo FROM events), g AS (SELECT *, sum(nuevo) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}""")
def session(t: Tables) -> DataFrame:
    """T4: sessions per user, closed by six hours without events and by the watermark."""
    return windows.run_once(windows.sessions(_events(t), "ts", ["user_id"], "6 hours"), "append")


@query("t05_estado_por_clave", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def state(t: Tables) -> DataFrame:
    """Last event of each user as running state."""
    return windows.run_once(windows.last_state(_events(t), ["user_id"], F.struct("ts", "event_id"), ["event_id", "event_type"]), "update", ["user_id"])


@query("t02_primera_vez", "SELECT DISTINCT user_id, event_type FROM events")
def once(t: Tables) -> DataFrame:
    """Each user and type once, however often it comes."""
    return windows.run_once(windows.first_seen(_events(t), "ts", ["user_id", "event_type"]), "append").select("user_id", "event_type")


QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
