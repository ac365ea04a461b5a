"""Usage, verdict and guidance counters, and small roll-ups per parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of a use or verdict by role; any other role weighs 1.
ROLE_WEIGHTS = {"admin": 1.5, "analyst": 1.2, "viewer": 0.8, "trusted": 1.5}
TRUSTED_ROLES = ("admin", "trusted")


def role_weight(role: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in ROLE_WEIGHTS.items() for x in kv])
    return F.coalesce(pairs[F.lower(role)], F.lit(1.0))


def one_event_per_step(usage: DataFrame) -> DataFrame:
    """Keep one event per (step, table): the first use, the successful one on a tie."""
    best = F.min_by(F.struct(*[c for c in usage.columns if c not in ("step_id", "table_fqn")]),
                    F.struct("used_at", ~F.col("success"), "source_id", "user_id", "role"))
    return usage.groupBy("step_id", "table_fqn").agg(best.alias("e")).select("step_id", "table_fqn", "e.*")


def usage_aggs() -> list[Column]:
    """The counter set; shared by the batch and the streaming form."""
    ok, role = F.col("success"), F.lower("role")
    return [
        F.count(F.lit(1)).alias("usage"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
        F.sum(F.when(ok, role_weight(F.col("role"))).otherwise(0.0).cast("decimal(18,1)")).cast("double").alias("weighted_usage"),
        F.count_if(ok & role.isin(*TRUSTED_ROLES)).alias("trusted_usage"),
        F.count_if(ok & F.col("user_id").isNotNull()).alias("user_uses"),
        F.max(F.when(ok, F.col("used_at"))).alias("last_used_at"),
    ]


def usage_stats(usage: DataFrame, keys=("source_id", "table_fqn")) -> DataFrame:
    """Counters per table.

    ``user_uses`` counts successful events with a user (the name kept by the
    studied platform suggests distinct users); ``distinct_users`` is the real one.
    """
    distinct = F.count_distinct(F.when(F.col("success"), F.col("user_id"))).alias("distinct_users")
    return usage.groupBy(*keys).agg(*usage_aggs(), distinct)


def feedback_stats(feedback: DataFrame, keys=("source_id", "table_fqn")) -> DataFrame:
    w = role_weight(F.col("role")).cast("decimal(18,1)")
    pos, neg = F.col("direction") > 0, F.col("direction") < 0

    def weighted(flag):
        return F.sum(F.when(flag, w).otherwise(0)).cast("double")

    return feedback.groupBy(*keys).agg(
        F.count_if(pos).alias("positive"), F.count_if(neg).alias("negative"),
        weighted(pos).alias("weighted_positive"), weighted(neg).alias("weighted_negative"),
        F.max("created_at").alias("last_feedback_at"))


def feedback_attribution(feedback: DataFrame, message_steps: DataFrame, usage: DataFrame) -> DataFrame:
    """A verdict reaches the tables its answer's steps used successfully, once per (source, table).

    Both link tables are made distinct before the join, so duplicate uses never
    multiply; the last step drops repeats across steps of one answer.
    """
    used = usage.where(F.col("success") & F.col("source_id").isNotNull()).select(
        "step_id", "source_id", F.lower("table_fqn").alias("table_fqn")).distinct()
    verdicts = feedback.select("feedback_id", "message_id", F.when(F.col("direction") == 1, "positive").otherwise("negative").alias("verdict"))
    return (
        verdicts.join(message_steps.select("message_id", "step_id").distinct(), "message_id")
        .join(used, "step_id").select("feedback_id", "step_id", "source_id", "table_fqn", "verdict")
    )


def instruction_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("usage"),
        F.count_if(F.col("load_mode") == "always").alias("always_loads"),
        F.count_if(F.col("load_mode") == "intelligent").alias("intelligent_loads"),
        F.count_if(F.col("load_reason") == "mentioned").alias("mentions"),
        F.sum(role_weight(F.col("role")).cast("decimal(18,1)")).cast("double").alias("weighted_usage"),
        F.count("user_id").alias("user_uses"), F.max("used_at").alias("last_used_at"))


def snippet_usage(usage: DataFrame, since: Column | None = None) -> DataFrame:
    """Per step: last use, successes, failures, attempts and whether any failed."""
    rows = usage if since is None else usage.where(F.col("used_at") >= since)
    bad = F.count_if(~F.col("success"))
    return rows.groupBy("step_id").agg(
        F.max("used_at").alias("last_used_at"), F.count_if("success").alias("successes"), bad.alias("failures"),
        F.count(F.lit(1)).alias("attempts"), (bad > 0).alias("had_failure"))


def eval_dashboard(results: DataFrame) -> DataFrame:
    """Cases, distinct runs and the latest result, overall and per suite, in one aggregation."""
    latest = F.struct("finished_at", "result_id")
    return results.groupingSets([["suite_id"], []], "suite_id").agg(
        F.grouping("suite_id").alias("overall"), F.count_distinct("case_id").alias("cases"),
        F.count_distinct("run_id").alias("runs"), F.max_by("run_id", latest).alias("last_run_id"),
        F.max_by("status", latest).alias("last_status"), F.max("finished_at").alias("last_result_at"))


def run_rollup(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status").isin("fail", "error")).alias("failed"))


def child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Counts of live linked rows per parent; a parent without children gets 0."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").fillna(0, [name])
    return out


def source_types(items: DataFrame) -> DataFrame:
    """Which kinds of guidance exist; two kinds are listed even when empty."""
    git, kind = F.col("source_type") == "git", F.col("resource_type")
    counted = items.agg(
        F.count_distinct(F.when(F.col("source_type") == "user", F.col("item_id"))).alias("user"),
        F.count_distinct(F.when(F.col("source_type") == "ai", F.col("item_id"))).alias("ai"),
        F.count_distinct(F.when(git, F.col("item_id"))).alias("git"),
        F.count_distinct(F.when(git & kind.like("dbt\\_%"), F.col("item_id"))).alias("dbt"),
        F.count_distinct(F.when(git & (kind == "markdown_document"), F.col("item_id"))).alias("markdown"))
    long = counted.unpivot([], counted.columns, "value", "items")
    return long.where((F.col("items") > 0) | F.col("value").isin("ai", "git"))
