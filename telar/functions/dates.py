"""Dates with their zone, and why others are refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOMENT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
_ZONED, _NAIVE, _BASIC, _DAY = _MOMENT + r"(Z|[+-]\d{2}:\d{2})$", _MOMENT + "$", r"^\d{8}T\d{6}Z$", r"^\d{4}-\d{2}-\d{2}$"


def zoned(text: Column) -> tuple[Column, Column]:
    """(timestamp, reason) of an ISO 8601 text. A date without a zone isn't guessed: ``fecha_sin_zona_horaria``.

    What isn't a real date is ``fecha_ilegible``; a null or blank text has neither.
    """
    value = F.nullif(F.trim(text), F.lit(""))
    moment = F.when(value.rlike(_ZONED), value.try_cast("timestamp")).when(value.rlike(_BASIC), F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmssX")))
    naive = (value.rlike(_NAIVE) | value.rlike(_DAY)) & value.try_cast("timestamp").isNotNull()
    reason = F.when(value.isNull() | moment.isNotNull(), None).when(naive, "fecha_sin_zona_horaria").otherwise("fecha_ilegible")
    return moment, reason


def utc_text(moment: Column) -> Column:
    """A timestamp as ISO text in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def number(text: Column) -> tuple[Column, Column]:
    """(double, reason) of a numeral; what is no number is null and ``no_numerico``, blank and null have neither."""
    value = F.nullif(F.trim(text), F.lit(""))
    found = F.when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))
    return found, F.when(value.isNotNull() & found.isNull(), "no_numerico")
