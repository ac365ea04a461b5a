"""Spend: priced usage records, headline totals, dense daily series, breakdowns.

A breakdown first sums the records per (link key, provider) and only then meets
the dimension or bridge table, so one key holding a third of the records
reaches the join as a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..functions.ranges import day_spine, within

UNATTRIBUTED = "__unattributed__"
TOKENS = ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens")
SUMS = ("total_calls", *TOKENS, "total_tokens", "input_cost", "output_cost", "total_cost")


def priced(usage: DataFrame, models: DataFrame) -> DataFrame:
    """Add total tokens and the three costs to each record; unknown rates cost 0."""
    c = F.col
    rows = usage.join(models, "model_id", "left")
    rows = rows.withColumns({
        "total_tokens": money.total_tokens(c("provider"), *(c(t) for t in TOKENS)),
        "input_cost": money.input_cost(c("provider"), c("input_rate"), c("prompt_tokens"), c("cache_read_tokens"), c("cache_write_tokens")),
        "output_cost": money.output_cost(c("output_rate"), c("completion_tokens")),
    })
    return rows.withColumn("total_cost", (c("input_cost") + c("output_cost")).cast(money.COST_TYPE))


def _sums(df: DataFrame, *keys: str, merged: bool = False) -> DataFrame:
    calls = F.sum("total_calls") if merged else F.count(F.lit(1))
    rest = [F.sum(F.coalesce(F.col(s), F.lit(0))).alias(s) for s in SUMS[1:]]
    return df.groupBy(*keys).agg(calls.alias("total_calls"), *rest)


def cost_kpi(rows: DataFrame) -> DataFrame:
    """Headline totals from un-expanded records: exact whatever the grouping."""
    rest = [F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in (*TOKENS, "total_tokens")]
    return rows.agg(
        F.count(F.lit(1)).alias("total_calls"), *rest,
        F.coalesce(F.sum("total_cost").cast("double"), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.bool_or(money.is_estimated(F.col("provider"))), F.lit(False)).alias("has_estimated"),
    )


def cost_daily(rows: DataFrame, start, end, most: int | None = None) -> DataFrame:
    """One row per day of the range, zero-filled; the first ``most`` days only if asked for."""
    day = F.coalesce(F.to_date("created_at"), F.lit(end.date().isoformat()).cast("date"))
    daily = rows.groupBy(day.alias("day")).agg(F.sum("total_cost").alias("c"), F.sum("total_tokens").alias("t"))
    spine = day_spine(rows.sparkSession, start, end, most=most)
    return spine.join(daily, "day", "left").select(
        "day", F.coalesce(F.col("c").cast("double"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce("t", F.lit(0)).alias("tokens"),
    )


def _text(c):
    return F.col(c).cast("string")


def cost_by(rows: DataFrame, group_by: str, *, users=None, report_source=None, sources=None,
            group_membership=None, groups=None) -> DataFrame:
    """Break the spend down by model, provider, scope, user, data_source or group.

    Fan-out keys give each side the full value, so their sum may exceed the
    headline; rows without a key fall into a named bucket.
    """
    unattributed = F.lit(UNATTRIBUTED)
    if group_by == "model":
        part = _sums(rows, "model_id", "model_name", "provider")
        part = part.select(_text("model_id").alias("key"), F.coalesce("model_name", _text("model_id")).alias("label"), "provider", *SUMS)
    elif group_by == "provider":
        part = _sums(rows, "provider").withColumn("key", F.coalesce("provider", F.lit("unknown")))
        part = part.withColumn("label", F.initcap("key"))
    elif group_by == "scope":
        part = _sums(rows, "scope", "provider").withColumn("key", F.coalesce("scope", F.lit("unscoped")))
        part = part.withColumn("label", F.col("key"))
    elif group_by == "user":
        part = _sums(rows, "user_id", "provider").join(users, "user_id", "left")
        fallback = F.when(F.col("user_id").isNull(), "Unattributed").otherwise("Unknown user")
        part = part.withColumns({"key": F.coalesce(_text("user_id"), unattributed), "label": F.coalesce("user_name", fallback)})
    elif group_by == "data_source":
        part = fan_out(_sums(rows, "report_id", "provider"), report_source, "report_id", "source_id")
        part = _sums(part, "source_id", "provider", merged=True).join(sources.withColumn("source_id", _text("source_id")), "source_id", "left")
        part = part.withColumns({"key": F.col("source_id"), "label": F.coalesce("source_name", F.lit("Unattributed"))})
    elif group_by == "group":
        part = fan_out(_sums(rows, "user_id", "provider"), group_membership, "user_id", "group_id")
        part = _sums(part, "group_id", "provider", merged=True).join(groups, "group_id", "left")
        key = F.when(F.col("group_name").isNull(), unattributed).otherwise(F.col("group_id"))
        part = part.withColumns({"key": key, "label": F.coalesce("group_name", F.lit("Unattributed"))})
    else:
        raise ValueError(f"unknown grouping {group_by!r}")
    # provider names the item only when it is the single one seen
    lo, hi = F.min("provider"), F.max("provider")
    rest = [F.sum(s).alias(s) for s in SUMS]
    out = part.groupBy("key").agg(F.max("label").alias("label"), F.when(lo == hi, lo).alias("provider"), *rest)
    for c in ("input_cost", "output_cost", "total_cost"):
        out = out.withColumn(c, F.col(c).cast("double"))
    return out


def usage_by_model(rows: DataFrame) -> DataFrame:
    """Calls, token sums and cost sums per model and provider, dearest first."""
    out = _sums(rows, "model_id", "model_name", "provider")
    for c in ("input_cost", "output_cost", "total_cost"):
        out = out.withColumn(c, F.col(c).cast("double"))
    return out.orderBy(F.desc("total_cost"), "model_id", "provider")


def fan_out(facts: DataFrame, bridge: DataFrame, on: str, key: str) -> DataFrame:
    """Give each record to every linked key; unlinked ones to the unattributed bucket.

    An inner join plus the unlinked rest: unlike in an outer join, a hot key may
    be split on either side when it runs.
    """
    linked = facts.join(bridge, on).withColumn(key, F.coalesce(_text(key), F.lit(UNATTRIBUTED)))
    rest = facts.join(bridge.select(on).distinct(), on, "left_anti").withColumn(key, F.lit(UNATTRIBUTED))
    return linked.unionByName(rest, allowMissingColumns=True)


def in_range(rows: DataFrame, start, end) -> DataFrame:
    return rows.where(within("created_at", start, end))
