"""Join forms.  Strategies are left to Catalyst and AQE: no side is forced to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner_chain(fact: DataFrame, *links: tuple[DataFrame, str]) -> DataFrame:
    for dim, key in links:
        fact = fact.join(dim, key)
    return fact


def left_default(fact: DataFrame, dim: DataFrame, on: str, defaults: dict[str, str]) -> DataFrame:
    joined = fact.join(dim, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def semi_scope(fact: DataFrame, bridge: DataFrame, on: str, allowed: Column) -> DataFrame:
    """Facts linked to an allowed source; never multiplied."""
    return fact.join(bridge.where(allowed).select(on), on, "left_semi")


def self_parent(rows: DataFrame, key: str, parent: str, carry: list[str]) -> DataFrame:
    up = rows.select(F.col(key).alias(parent), *[F.col(c).alias(f"parent_{c}") for c in carry])
    return rows.join(up, parent, "left")


def suffix_match(short: DataFrame, qualified: DataFrame, name: str, full: str) -> DataFrame:
    """Match a name to a qualified one: equal, or ending in ``.name``, ignoring case.

    Candidates meet on the last dot part, an equality the shuffle can use; the
    suffix test is a residual filter, so no nested loop arises.
    """
    last = lambda c: F.element_at(F.split(F.lower(c), "\\."), -1)
    a = short.withColumn("_last", last(F.col(name)))
    b = qualified.withColumn("_last", last(F.col(full)))
    lo_n, lo_f = F.lower(F.col(name)), F.lower(F.col(full))
    return a.join(b, "_last").where((lo_n == lo_f) | F.endswith(lo_f, F.concat(F.lit("."), lo_n))).drop("_last")


def missing(known: DataFrame, current: DataFrame, on: list[str]) -> DataFrame:
    return known.join(current, on, "left_anti")


def full_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Added, removed and changed keys of two keyed snapshots."""
    o = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def lookup_first(fact: DataFrame, lookup: DataFrame, on: str, order: list[Column], columns: list[str]) -> DataFrame:
    from .activity import latest_per_key

    return fact.join(latest_per_key(lookup, on, order).select(on, *columns), on, "left")


def multi_left(fact: DataFrame, *dims: tuple[DataFrame, str]) -> DataFrame:
    for dim, key in dims:
        fact = fact.join(dim, key, "left")
    return fact


def access_intersect(requested: DataFrame, permitted: DataFrame, on: str) -> DataFrame:
    return requested.select(on).distinct().join(permitted, on, "left_semi")


def latest_rows_by_max(facts: DataFrame, key: str, ts: str) -> DataFrame:
    """All rows holding their group's latest timestamp (ties return several)."""
    newest = facts.groupBy(key).agg(F.max(ts).alias(ts))
    return facts.join(newest, [key, ts])
