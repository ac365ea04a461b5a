"""Plan shapes: no products, filters at the scan, pruned columns, no Python where the JVM will do."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry

from .conftest import SF

BUILD = entry.queries()
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_reaches_the_scan(spark):
    text = plan(BUILD["cost_kpi"](spark, SF))
    pushed = text[text.index("PushedFilters"):]
    assert "GreaterThanOrEqual(l_shipdate,1997-03-01" in pushed and "LessThanOrEqual(l_shipda" in pushed


def test_columns_are_pruned(spark):
    text = plan(BUILD["feedback_summary"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "value" not in schema and "props" not in schema


def test_user_breakdown_sums_before_the_join(spark):
    """The records are aggregated per user before users are joined: a hot user is a few rows."""
    text = BUILD["cost_by_user"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Join LeftOuter, (user_id"):] if "Join LeftOuter, (user_id" in text else text[text.index("user_id"):]
    assert "Aggregate [user_id" in below


def test_latest_per_key_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(BUILD["latest_per_key"](spark, SF))


def test_spread_small_leaves_large_scans_alone(spark):
    from plumbline.session import spread_small

    many = spark.range(0, 1000, 1, 64).withColumn("x", F.col("id") * 2)
    assert "Exchange" not in plan(spread_small(many))
    assert "RoundRobin" in plan(spread_small(spark.range(0, 10, 1, 1)))
