"""Typing of landed columns and serial day numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days between 1899-12-30 and 1970-01-01, and a day in microseconds.
EPOCH_OFFSET_DAYS = 25_569.0
MICROS_PER_DAY = 86_400_000_000


def _finite(serial: Column, out: Column) -> Column:
    return F.when(~F.isnan(serial) & (F.abs(serial) != float("inf")), out)


def serial_to_date(serial: Column) -> Column:
    return _finite(serial, F.date_add(F.lit("1970-01-01").cast("date"), F.round(serial - EPOCH_OFFSET_DAYS).cast("int")))


def serial_to_micros(serial: Column) -> Column:
    return _finite(serial, F.round((serial - EPOCH_OFFSET_DAYS) * 86_400.0 * 1_000_000.0).cast("bigint"))


def serial_to_timestamp(serial: Column) -> Column:
    return F.timestamp_micros(serial_to_micros(serial))


def serial_to_time_micros(serial: Column) -> Column:
    """Microseconds since midnight, inside one day whatever the date part."""
    micros = F.round((serial - F.floor(serial)) * 86_400.0 * 1_000_000.0).cast("bigint")
    return _finite(serial, F.greatest(F.lit(0), F.least(micros, F.lit(MICROS_PER_DAY - 1))))


def infer_column_types(df: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """(column, type) of text columns from all their values, in one aggregation.

    Any text wins, then all-integer, else double; a tag (``timestamp``, ``time``
    or ``date``) counts only for an all-numeric column; an empty column is text.
    """
    tags = {k: v.lower().lstrip("$") for k, v in (tags or {}).items()}
    aggs, items = [], []
    for i, name in enumerate(df.columns):
        c = F.trim(F.col(f"`{name}`"))
        # one pattern per cell: an integer has nothing after its digits
        rest = F.regexp_extract(c, r"^[+-]?(?:\d+(\.?\d*(?:[eE][+-]?\d+)?)|(\.\d+(?:[eE][+-]?\d+)?))$", 0)
        aggs += [F.count(c).alias(f"n{i}"), F.bool_and(F.translate(c, "+-0123456789", "") == "").alias(f"i{i}"), F.bool_and(rest != "").alias(f"d{i}")]
        numeric = (F.col(f"n{i}") > 0) & F.col(f"d{i}")
        tag = tags.get(name)
        kind = F.when(~numeric, "text").when(F.lit(tag in ("timestamp", "time", "date")), F.lit(tag)).when(F.col(f"i{i}"), "int").otherwise("double")
        items.append(F.struct(F.lit(name).alias("column"), F.coalesce(kind, F.lit("text")).alias("type")))
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def cast_landed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Apply inferred types; serial numbers become dates, timestamps and microseconds."""
    def cell(name):
        c = F.col(f"`{name}`")
        n = F.trim(c).try_cast("double")
        return {"int": lambda: F.trim(c).try_cast("bigint"), "double": lambda: n, "date": lambda: serial_to_date(n),
                "timestamp": lambda: serial_to_timestamp(n), "time": lambda: serial_to_time_micros(n)}.get(types.get(name), lambda: c)().alias(name)
    return df.select(*[cell(n) for n in df.columns])
