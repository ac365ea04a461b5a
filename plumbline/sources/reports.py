"""Nested report responses to flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_flatten(response: DataFrame, group_keys: list[str], metrics: list[str]) -> DataFrame:
    """Period -> groups -> metrics: one row per group and one per period total.

    ``response(period_start, period_end, groups array<struct<keys, metrics map>>,
    total map)``; each metric is ``struct(Amount, Unit)``.
    """
    def flat(m):
        return [c for name in metrics for c in (m[name]["Amount"].alias(f"{name}.Amount"), m[name]["Unit"].alias(f"{name}.Unit"))]

    period = [F.col("period_start").alias("TimePeriod.Start"), F.col("period_end").alias("TimePeriod.End")]
    g = response.select("*", F.explode("groups").alias("g"))
    keys = [F.try_element_at(F.col("g.keys"), F.lit(i + 1)).alias(k) for i, k in enumerate(group_keys)]
    groups = g.select(*period, *keys, *flat(F.col("g.metrics")))
    none = [F.lit(None).cast("string").alias(k) for k in group_keys]
    totals = response.where("total IS NOT NULL").select(*period, *none, *flat(F.col("total")))
    return groups.unionByName(totals)


def header_rows_zip(response: DataFrame, columns: list[str], header: str = "columns", rows: str = "rows") -> DataFrame:
    """Table from a column-name array and an array of row arrays, matched by name."""
    cells = response.select("*", F.posexplode(rows).alias("row_pos", "_cells"))
    at = lambda name: F.try_element_at("_cells", F.array_position(header, F.lit(name)).cast("int"))
    keep = [c for c in response.columns if c not in (header, rows)]
    present = lambda n: F.when(F.array_contains(header, n), at(n)).alias(n)
    return cells.select(*keep, "row_pos", *[present(n) for n in columns])
