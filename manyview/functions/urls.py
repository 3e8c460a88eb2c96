"""Canonical addresses. The rules are this library's: what is dropped are the
fragment and the parameters ``utm_*`` and ``ref``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = r"^(?:utm_[^=]*|ref)(?:=.*)?$"


def canonical(url: Column) -> Column:
    """The address without fragment and tracking; the other parameters keep their order."""
    bare = F.regexp_replace(url, "#.*$", "")
    path = F.regexp_extract(bare, r"^[^?]*", 0)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.when(kept != "", F.concat(path, F.lit("?"), kept)).otherwise(path)


def domain(url: Column) -> Column:
    """The host in lower case, without ``www.``; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))
