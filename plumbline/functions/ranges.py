"""Date ranges, day spines and period arithmetic (naive UTC throughout)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def naive_utc(moment: dt.datetime) -> dt.datetime:
    if moment.tzinfo is not None:
        moment = moment.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return moment


def whole_days(start: dt.datetime | None, end: dt.datetime | None, now: dt.datetime | None = None):
    """Default to the last 30 days and widen both ends to whole days."""
    end = naive_utc(end) if end else naive_utc(now or dt.datetime.now(dt.timezone.utc))
    start = naive_utc(start) if start else end - dt.timedelta(days=30)
    return (
        start.replace(hour=0, minute=0, second=0, microsecond=0),
        end.replace(hour=23, minute=59, second=59, microsecond=999999),
    )


def ts(moment: dt.datetime) -> Column:
    """A text literal: the comparison takes the column's own timestamp kind, so it reaches the scan."""
    return F.lit(naive_utc(moment).isoformat(sep=" "))


def within(col: Column | str, start: dt.datetime | None, end: dt.datetime | None, now=None) -> Column:
    """Inclusive predicate on a timestamp column; literal bounds reach the scan."""
    lo, hi = whole_days(start, end, now)
    col = F.col(col) if isinstance(col, str) else col
    return (col >= ts(lo)) & (col <= ts(hi))


def previous_period(start: dt.datetime, end: dt.datetime):
    """The equally long period ending where this one starts."""
    return start - (end - start), start


def day_spine(spark: SparkSession, start, end, name: str = "day", most: int | None = None) -> DataFrame:
    """One row per calendar day; its size depends on the range, never on data."""
    lo, hi = whole_days(start, end)
    days = (hi.date() - lo.date()).days + 1
    days = min(days, most) if most else days
    return spark.range(days).select(F.date_add(F.lit(lo.date().isoformat()).cast("date"), F.col("id").cast("int")).alias(name))


def month_window(col: Column) -> tuple[Column, Column]:
    """First instant of the month of ``col`` and of the month after it."""
    first = F.date_trunc("month", col)
    return first, F.add_months(first, 1).cast("timestamp")
