"""JavaScript coercions as column expressions.

The dashboard compares values after coercion: null reads as the text ``null``,
as 0 in numbers and as the epoch in dates.  ``mode="sql"`` leaves nulls null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: texts that the number conversion accepts (after trimming).
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?Infinity$"


def js_string(c: Column, kind: T.DataType, mode: str = "reference") -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "0+$", ""), "\\.$", "")
        large = (F.abs(c) >= 1e7) & (F.abs(c) < 1e21)
        text = F.when(whole, c.cast("bigint").cast("string")).when(large, plain).otherwise(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null")) if mode == "reference" else text


def js_number(c: Column, kind: T.DataType, mode: str = "reference") -> Column:
    """Double; null stands for not-a-number, so it never matches."""
    if isinstance(kind, T.BooleanType):
        n = c.cast("int").cast("double")
    elif isinstance(kind, T.NumericType):
        n = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    elif isinstance(kind, T.StringType):
        t = F.trim(c)
        n = F.when(t == "", F.lit(0.0)).when(t.rlike(NUMBER_TEXT), t.try_cast("double"))
    else:
        n = F.lit(None).cast("double")
    return F.when(c.isNull(), F.lit(0.0)).otherwise(n) if mode == "reference" else n


def js_date(c: Column, kind: T.DataType, mode: str = "reference") -> Column:
    """Naive timestamp; a number is milliseconds since the epoch; unparsable gives null."""
    if isinstance(kind, T.NumericType):
        d = F.timestamp_millis(c.cast("bigint")).cast("timestamp_ntz")
    elif isinstance(kind, T.StringType):
        slashed = F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(c, F.lit("MM/dd/yyyy")))
        dashed = F.when(c.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}"), F.try_to_timestamp(F.regexp_replace(c, r"^(\d{4})/(\d{2})/(\d{2})", "$1-$2-$3")))
        d = F.coalesce(dashed, slashed).cast("timestamp_ntz")
    else:
        d = c.cast("timestamp_ntz")
    return F.when(c.isNull(), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).otherwise(d) if mode == "reference" else d
