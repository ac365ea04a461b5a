"""Monthly quotas: effective limits, usage against them, first breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spread import running_total

METRICS = ("max_queries", "max_bytes", "max_tokens")


def _applicable(policies: DataFrame, principals: DataFrame) -> DataFrame:
    """(user, policy) rows that count: a user's own policies, else those of groups and roles."""
    linked = principals.join(policies, ["level", "principal_id"])
    direct = linked.groupBy("user_id").agg(F.bool_or(F.col("level") == "user").alias("direct"))
    return linked.join(direct, "user_id").where(~F.col("direct") | (F.col("level") == "user")).drop("level", "principal_id")


def limits_resolve(policies: DataFrame, principals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Most restrictive limit per user and metric, and per connection where a policy overrides it.

    The row without a connection holds the base; a user without policies is
    unlimited.  Null never restricts.  An override replaces its policy's base.
    """
    rows = _applicable(policies, principals)
    users = principals.select("user_id").distinct()
    base = rows.groupBy("user_id").agg(*[F.min(m).alias(m) for m in METRICS], F.max("direct").alias("direct"))
    source = F.when(F.col("direct").isNull(), "default").when(F.col("direct"), "direct").otherwise("inherited")
    base = users.join(base, "user_id", "left").select("user_id", F.lit(None).cast("bigint").alias("connection_id"), *METRICS, source.alias("source"))
    over = overrides.select("policy_id", "connection_id", F.col("max_queries").alias("o_q"), F.col("max_bytes").alias("o_b"), F.lit(True).alias("o"))
    touched = rows.join(over.select("policy_id", "connection_id"), "policy_id").select("user_id", "connection_id").distinct()
    full = touched.join(rows, "user_id").join(over, ["policy_id", "connection_id"], "left")
    pick = lambda o, b: F.when(F.col("o"), F.col(o)).otherwise(F.col(b))
    per = full.groupBy("user_id", "connection_id").agg(
        F.min(pick("o_q", "max_queries")).alias("max_queries"), F.min(pick("o_b", "max_bytes")).alias("max_bytes"),
        F.min("max_tokens").alias("max_tokens"), F.max("direct").alias("direct"))
    per = per.select("user_id", "connection_id", *METRICS, F.when(F.col("direct"), "direct").otherwise("inherited").alias("source"))
    return base.unionByName(per)


def connection_limits(limits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Limits of given (user, connection) pairs: the override where one exists, else the base."""
    base = limits.where("connection_id IS NULL").select("user_id", *[F.col(m).alias(f"b_{m}") for m in METRICS])
    own = limits.where("connection_id IS NOT NULL").select("user_id", "connection_id", *METRICS, F.lit(True).alias("_o"))
    rows = pairs.join(base, "user_id", "left").join(own, ["user_id", "connection_id"], "left")
    return rows.select("user_id", "connection_id", *[F.when(F.col("_o"), F.col(m)).otherwise(F.col(f"b_{m}")).alias(m) for m in METRICS])


def quota_metric(used: Column, limit: Column) -> tuple[Column, Column]:
    """Remaining (never negative) and percent; a limit of 0 counts as 100 % once used."""
    pct = F.when(limit > 0, F.bround(used / limit * 100, 2)).when(limit.isNotNull(), F.when(used > 0, 100.0).otherwise(0.0))
    return F.when(limit.isNotNull(), F.greatest(limit - used, F.lit(0))), pct


def quota_summary(events: DataFrame, limits: DataFrame, month: str) -> DataFrame:
    """Used, limit, remaining and percent per user, connection and metric in one month."""
    start = F.lit(month).cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    inside = events.where((ts >= start) & (ts < F.add_months(F.lit(month).cast("date"), 1).cast("timestamp_ntz")))
    used = inside.groupBy("user_id", "connection_id").agg(F.sum("queries").alias("u_queries"), F.sum("bytes").alias("u_bytes"))
    rows = used.join(connection_limits(limits, used.select("user_id", "connection_id")), ["user_id", "connection_id"])
    items = [F.struct(F.lit(m).alias("metric"), F.col(f"u_{m}").alias("used"), F.col(f"max_{m}").cast("bigint").alias("limit")) for m in ("queries", "bytes")]
    long = rows.select("user_id", "connection_id", F.inline(F.array(*items)))
    left, pct = quota_metric(F.col("used"), F.col("limit"))
    return long.select("user_id", "connection_id", "metric", "used", "limit", left.alias("remaining"), pct.alias("percent"))


def quota_breach(events: DataFrame, limits: DataFrame, keys: list[str], amount: str, order: tuple[str, str] = ("ts", "event_id"),
                 opening: DataFrame | None = None) -> DataFrame:
    """First event per key and month at which the running total passes the limit.

    Hourly sums find the one hour that holds the breach; only its events are
    ordered, and those by a spread running total.  ``limits(*keys, limit)``;
    ``opening(*keys, month, used)`` carries totals of earlier batches.
    """
    ts, tie = order
    rows = events.where(F.col(amount) > 0).withColumns({"month": F.date_trunc("month", F.col(ts)), "_hour": F.date_trunc("hour", F.col(ts))})
    by = [*keys, "month"]
    hourly = rows.groupBy(*by, "_hour").agg(F.sum(amount).alias("_sum")).join(limits.where("limit IS NOT NULL"), keys)
    if opening is not None:
        hourly = hourly.join(opening.select(*by, F.col("used").alias("_open")), by, "left").fillna(0, ["_open"])
    else:
        hourly = hourly.withColumn("_open", F.lit(0))
    upto = W.partitionBy(*by).orderBy("_hour").rowsBetween(W.unboundedPreceding, 0)
    hourly = hourly.withColumn("_cum", F.sum("_sum").over(upto) + F.col("_open")).where((F.col("_cum") > F.col("limit")) & (F.col("_cum") - F.col("_sum") <= F.col("limit")))
    target = hourly.select(*by, "_hour", "limit", (F.col("_cum") - F.col("_sum")).alias("_before"))
    inside = rows.join(target, [*by, "_hour"]).select(*by, ts, tie, F.col(amount).alias("_amount"), "limit", "_before")
    run = running_total(inside, by, [F.col(ts), F.col(tie)], "_amount", "_run").withColumn("_total", F.col("_run") + F.col("_before"))
    over = run.where(F.col("_total") > F.col("limit"))
    first = F.min_by(F.struct(F.col(tie), F.col(ts), F.col("_total").alias("used"), F.col("limit")), F.struct(ts, tie))
    return over.groupBy(*by).agg(first.alias("e")).select(*by, F.col(f"e.{tie}").alias(tie), F.col(f"e.{ts}").alias(ts), "e.used", "e.limit")
