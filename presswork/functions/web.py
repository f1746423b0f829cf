"""Functions of addresses and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def netloc(url: Column) -> Column:
    """What stands between ``//`` and the path, lower case; empty without a scheme."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def domain(url: Column) -> Column:
    """Network place without one leading ``www.``; ``NA`` when there is none."""
    d = F.regexp_replace(netloc(url), r"^www\.", "")
    return F.when(d == "", "NA").otherwise(d)


def domain_bare(url: Column) -> Column:
    """Every ``www.`` taken out, empty allowed."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def quarter_bucket(date: Column) -> Column:
    """``YYYYQn`` of a text that starts like an ISO date; the month is not checked; else ``NA``."""
    m = F.when(F.substring(date, 6, 2).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(F.substring(date, 6, 2)).try_cast("int"))
    q = F.concat(F.left(date, F.lit(4)), F.lit("Q"), (F.floor((m - 1) / 3) + 1).cast("string"))
    return F.when(F.length(date) >= 7, F.coalesce(q, F.lit("NA"))).otherwise("NA")


def day(date: Column) -> Column:
    """Timestamp of a text in ISO form; other forms are null."""
    return F.try_to_timestamp(F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(date, F.lit(10))), F.lit("yyyy-MM-dd"))


def month(ts: Column) -> Column:
    """``yyyy-MM``; no time gives the text ``NaT``, which is not null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("NaT"))


def quarter(ts: Column) -> Column:
    return F.coalesce(F.concat(F.year(ts), F.lit("Q"), F.quarter(ts)), F.lit("NaT"))
