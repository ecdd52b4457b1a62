"""Addresses and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: parameters that only track.
TRACKING = "^(fbclid|gclid|igshid|mc_cid|mc_eid|ref|ref_src)(=|$)|^utm_|^outputType=amp$|^amp=(1|true)$"


def host(url: Column) -> Column:
    """Lower-case host without www. or m.; null if there is none."""
    name = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(name, r"^(www\.|m\.)", ""), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One address per page: host without www. or m. and default port, no fragment, tracking, final / or /amp; sorted query."""
    rest = F.regexp_replace(F.substring_index(F.trim(url), "#", 1), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    query = F.when(rest.contains("?"), F.substring(rest, F.instr(rest, "?") + 1, F.length(rest))).otherwise("")
    front = F.substring_index(rest, "?", 1)
    site = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(front, "/", 1)), r":(80|443)$", ""), r"^(www\.|m\.)", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(front, "^[^/]*", ""), "/+$", ""), "(/amp)?/*$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(F.lit("https://"), site, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def section(url: Column) -> Column:
    """First part of the path, null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(url), r"^[^:]+://[^/?#]+/([^/?#]+)", 1), F.lit(""))


def short_id(prefix: str, text: Column, digits: int = 10) -> Column:
    """The prefix and the first hexadecimal digits of the text's SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(text), 1, digits))


def fold(text: Column, folds: int) -> Column:
    """A stable fold from 0 of the first eight hexadecimal digits of the text's SHA-1."""
    return F.pmod(F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")
