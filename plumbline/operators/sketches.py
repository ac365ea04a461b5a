"""Profiles that merge: what a part of a table adds is sketched once and never read again.

Of every column a part leaves one row: counts, the sum of squared deviations,
extremes, a KLL sketch of its numbers and a theta sketch of its values.  Parts
merge in any order into the profile of the table that they make up, so a table
that grows by a part costs the part, and any set of parts (a period, a region)
has its profile without a scan.

Counts and extremes are exact, moments up to rounding.  A quantile's rank errs
by at most ``RANK_ERROR`` of the rows with 99 % confidence, and not at all below
``KLL_K`` numbers; a distinct count's standard error is ``DISTINCT_ERROR``, and
it is exact below ``2 ** THETA_LG`` values.  The bounds hold for merged sketches
as for those of one scan.  ``table_profile`` is the exact form.

Nulls and NaN count as missing and enter no sketch; a column without a value has
neither quantiles nor extremes; nested values are compared by their JSON text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import _is_number, _is_time, _missing, _number, _sorted_json

KLL_K = 2000
RANK_ERROR = 2.296 / KLL_K ** 0.9021
THETA_LG = 14
DISTINCT_ERROR = 1 / 2 ** (THETA_LG / 2)

_ROW = ("position int, column string, dtype string, non_null long, nulls long, mean double, m2 double, min double, max double, "
        "kll binary, theta binary")


def sketch(df: DataFrame) -> DataFrame:
    """One row for each column of a part; a single aggregation."""
    aggs, items = [], []
    null = F.lit(None)
    for i, f in enumerate(df.schema.fields):
        bad = _missing(f)
        value = F.when(~bad, _sorted_json(F.col(f"`{f.name}`"), f.dataType))
        number = F.when(~bad, _number(f)) if _is_number(f.dataType) or _is_time(f.dataType) else None
        aggs += [F.count_if(~bad).alias(f"n{i}"), F.count_if(bad).alias(f"z{i}"), F.theta_sketch_agg(value, THETA_LG).alias(f"t{i}")]
        if number is not None:
            aggs += [F.avg(number).alias(f"a{i}"), F.var_pop(number).alias(f"v{i}"), F.min(number).alias(f"l{i}"), F.max(number).alias(f"h{i}"), F.kll_sketch_agg_double(number, F.lit(KLL_K)).alias(f"k{i}")]
        of = (lambda k: F.col(f"{k}{i}")) if number is not None else (lambda k: null)  # noqa: B023
        items.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("non_null"), F.col(f"z{i}").alias("nulls"),
            of("a").cast("double").alias("mean"), (of("v").cast("double") * F.col(f"n{i}")).alias("m2"), of("l").cast("double").alias("min"), of("h").cast("double").alias("max"),
            F.when(F.col(f"n{i}") > 0, of("k").cast("binary")).alias("kll"), F.col(f"t{i}").alias("theta")))
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def add_part(df: DataFrame, root: str, part: str) -> None:
    """Sketch a part and store it; a part that comes again replaces itself."""
    sketch(df).write.mode("overwrite").parquet(f"{root}/part={part}")


def stored(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{_ROW}, part string").parquet(root)


def merge(rows: DataFrame, probs: list[float] | None = None) -> DataFrame:
    """The profile of all parts in ``rows`` together: (column, dtype, non_null, nulls, mean, std, min, max, distinct, quantiles).

    ``quantiles`` maps each of ``probs`` to its value.
    """
    probs = [0.25, 0.5, 0.75] if probs is None else probs
    # squared deviations add up around the common mean: each part's own, and those of its mean
    total = F.sum("non_null")
    whole = rows.groupBy("position", "column", "dtype").agg(
        total.alias("non_null"), F.sum("nulls").alias("nulls"), (F.sum(F.col("mean") * F.col("non_null")) / total).alias("mean"),
        F.collect_list(F.struct("non_null", "mean", "m2")).alias("parts"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("kll").alias("kll"), F.theta_union_agg("theta", THETA_LG).alias("theta"))
    spread = F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.coalesce(p["m2"] + p["non_null"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")), F.lit(0.0)))
    numbers = ~F.col("dtype").isin("timestamp", "timestamp_ntz", "date") & F.col("mean").isNotNull() & (F.col("non_null") > 1)
    at = F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit(float(p)) for p in probs])))
    named = F.map_from_arrays(F.array(*[F.lit(float(p)) for p in probs]), at)
    return whole.select(
        "column", "dtype", "non_null", "nulls", "mean", F.when(numbers, F.sqrt(spread / (F.col("non_null") - 1))).alias("std"), "min", "max",
        F.theta_sketch_estimate("theta").cast("long").alias("distinct"), named.alias("quantiles"))


# --- who was there in a period, and who came back -------------------------------------------------------------------


def member_sketches(events: DataFrame, member: str, unit: Column, by: list[str] | None = None) -> DataFrame:
    """(by, unit, members, n): a theta sketch of the members of each unit of time, and its events."""
    return events.groupBy(*(by or []), unit.alias("unit")).agg(F.theta_sketch_agg(member, THETA_LG).alias("members"), F.count(F.lit(1)).alias("n"))


def period_members(sketches: DataFrame, periods: dict[str, tuple], by: list[str] | None = None) -> DataFrame:
    """Events and distinct members of each period, from its units' sketches; ``returning``: members of both the first and the last period.

    ``periods``: name -> (first unit, last unit), both counted.
    """
    by = by or []
    inside = {name: F.col("unit").between(F.lit(a), F.lit(b)) for name, (a, b) in periods.items()}
    aggs = []
    for name, cond in inside.items():
        aggs += [F.theta_union_agg(F.when(cond, F.col("members")), THETA_LG).alias(f"_{name}"), F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(f"{name}_events")]
    some = reduce(lambda a, b: a | b, inside.values())
    out = sketches.where(some).groupBy(*by).agg(*aggs) if by else sketches.where(some).agg(*aggs)
    first, last = list(periods)[0], list(periods)[-1]
    both = F.theta_sketch_estimate(F.theta_intersection(f"_{first}", f"_{last}")).cast("long")
    return out.select(*by, *[F.theta_sketch_estimate(f"_{n}").cast("long").alias(f"{n}_members") for n in periods], *[f"{n}_events" for n in periods], both.alias("returning"))
