"""Expressions over dates and career entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(c: Column) -> Column:
    """``YYYY-MM`` or ``YYYY-MM-DD`` as months since year 0; null when not a month.

    The pattern admits months 1 to 12 only, so one match per value is enough.
    """
    t = F.regexp_extract(c, r"^\s*(\d{4}-(?:0[1-9]|1[0-2]|[1-9](?!\d)))", 1)
    return F.substring(t, 1, 4).try_cast("int") * 12 + F.substring(t, 6, 2).try_cast("int") - 1


def known(c: Column) -> Column:
    """A number, or null for a negative one: negative stands for "no data"."""
    return F.when(c >= 0, c)


def whole(c: Column) -> Column:
    """Cut the fraction off."""
    return c.cast("bigint")


def role_months(duration: Column) -> Column:
    return whole(known(duration))


def role_end(start: Column, end: Column, months: Column) -> Column:
    """Month index of the end of a dated role; one that goes on ends after its months."""
    return F.when(start.isNotNull(), F.coalesce(end, start + F.coalesce(months, F.lit(0))))


def years_of_experience(stated: Column, tenure_months: Column) -> Column:
    """Stated years, else the summed months of all roles in years."""
    return F.coalesce(known(stated), tenure_months / F.lit(12.0))


# The same figures over an array of roles inside one record: no shuffle, for ingested records.


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + x)


def months_in(history: Column) -> Column:
    """Whole months of every role that states a duration."""
    months = F.transform(history, lambda h: role_months(h["duration_months"]))
    return F.filter(months, lambda m: m.isNotNull())


def tenure_in(history: Column) -> Column:
    months = months_in(history)
    return F.when(F.size(months) > 0, _sum(months))


def mean_tenure_years_in(history: Column) -> Column:
    months = months_in(history)
    return F.when(F.size(months) > 0, _sum(months) / F.size(months) / F.lit(12.0))


def span_in(history: Column) -> Column:
    dated = F.transform(
        history,
        lambda h: F.struct(
            month_index(h["start_date"]).alias("start"),
            month_index(h["end_date"]).alias("end"),
            role_months(h["duration_months"]).alias("months"),
        ),
    )
    last = F.array_max(F.transform(dated, lambda d: role_end(d["start"], d["end"], d["months"])))
    return last - F.array_min(F.transform(dated, lambda d: d["start"]))


def companies_in(history: Column) -> Column:
    return F.filter(F.transform(history, lambda h: h["company"]), lambda c: c != "")
