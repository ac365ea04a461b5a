"""Activity, quality and diagnosis metrics over messages, steps, verdicts and executions.

Facts are reduced to per-day or per-key partial rows first and the partial rows
are unioned and summed: no fact is joined to another fact at row level unless
the key is the fact's own id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranges import day_spine, previous_period, ts, whole_days, within
from ..functions.text import clip, json_text
from ..session import cut_lineage
from .spread import running_total

SCORES = ("instructions_effectiveness", "context_effectiveness", "response_score")


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _message_aggs(flag: Column, tag: str = "") -> list[Column]:
    judged = flag & F.col("instructions_effectiveness").isNotNull()
    avgs = [F.avg(F.when(judged, F.col(s))).alias(f"avg_{s}{tag}") for s in SCORES]
    return [F.count_if(flag).alias(f"messages{tag}"), *avgs, F.sum(F.when(flag, F.col("response_score"))).alias(f"score_sum{tag}")]


def _percent(score_sum: Column, n: Column) -> Column:
    return F.when(n > 0, F.coalesce(score_sum, F.lit(0)) / n * 20).otherwise(F.lit(0.0))


def _metric_row(messages, steps, feedback, reports, periods: dict[str, tuple]) -> DataFrame:
    """One row holding every metric for every period; one scan per fact."""
    parts = []
    span = (min(p[0] for p in periods.values()), max(p[1] for p in periods.values()))
    for df, make in (
        (messages, _message_aggs),
        (steps, lambda flag, t: [F.count_if(flag).alias(f"queries{t}")]),
        (feedback, lambda flag, t: [F.count_if(flag).alias(f"feedbacks{t}")]),
        (reports, lambda flag, t: [F.count_distinct(F.when(flag, F.col("user_id"))).alias(f"active_users{t}")]),
    ):
        aggs = [a for tag, (lo, hi) in periods.items() for a in make(within("created_at", lo, hi), tag)]
        parts.append(df.where(within("created_at", *span)).agg(*aggs))
    wide = _stack(parts)
    return wide.agg(*[F.max(c).alias(c) for c in wide.columns])


def in_sources(messages, steps, feedback, reports, executions, bridge, sources: list) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Messages, steps, verdicts and reports that belong to reports of the given sources.

    Every metric below takes these in place of the whole frames.  Facts are
    kept by semi joins, so a report with several of the sources counts once:
    messages and reports by their report, steps by their execution's report,
    verdicts by their message's report.  No source gives no rows.
    """
    scope = bridge.where(F.col("source_id").isin(*sources) if sources else F.lit(False)).select("report_id").distinct()
    own = messages.join(scope, "report_id", "left_semi")
    ran = executions.join(scope, "report_id", "left_semi")
    return (own, steps.join(ran.select("execution_id"), "execution_id", "left_semi"),
            feedback.join(own.select("message_id"), "message_id", "left_semi"), reports.join(scope, "report_id", "left_semi"))


def org_metrics(messages, steps, feedback, reports, start, end) -> DataFrame:
    row = _metric_row(messages, steps, feedback, reports, {"": (start, end)})
    c = F.col
    return row.select(
        "messages", "queries", "feedbacks", "active_users",
        F.concat(F.format_string("%.1f", _percent(c("score_sum"), c("messages")).cast("double")), F.lit("%")).alias("accuracy"),
        *[F.round(F.coalesce(c(f"avg_{s}"), F.lit(0.0)) * 20, 6).alias(s) for s in SCORES],
    )


def period_compare(messages, steps, feedback, reports, start, end) -> DataFrame:
    """(metric, current, previous); the boundary day counts in both periods."""
    row = _metric_row(messages, steps, feedback, reports, {"_cur": (start, end), "_prev": previous_period(start, end)})
    names = ["messages", "queries", "feedbacks", "active_users", *SCORES]

    def val(n, t):
        return F.coalesce(F.col(f"avg_{n}{t}"), F.lit(0.0)) * 20 if n in SCORES else F.col(f"{n}{t}").cast("double")

    items = [F.struct(F.lit(n).alias("metric"), val(n, "_cur").alias("current"), val(n, "_prev").alias("previous")) for n in names]
    return row.select(F.inline(F.array(*items)))


def period_change(compared: DataFrame) -> DataFrame:
    diff = F.col("current") - F.col("previous")
    pct = F.when(F.col("previous") > 0, diff / F.col("previous") * 100).otherwise(F.lit(0.0))
    return compared.select("metric", F.bround(diff, 2).alias("absolute"), F.bround(pct, 1).alias("percentage"))


def _daily(messages, steps, feedback, start, end, keys) -> DataFrame:
    day = F.to_date("created_at").alias("day")

    def per_day(df, *aggs):
        return df.where(within("created_at", start, end)).groupBy(*keys, day).agg(*aggs)

    parts = _stack([
        per_day(messages, *_message_aggs(F.lit(True))),
        per_day(steps, F.count(F.lit(1)).alias("queries")),
        per_day(feedback, F.count(F.lit(1)).alias("feedbacks"), F.count_if(F.col("direction") > 0).alias("positive")),
    ])
    return parts.groupBy(*keys, "day").agg(*[F.max(c).alias(c) for c in parts.columns if c not in (*keys, "day")])


def daily_activity(messages, steps, feedback, start, end, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per-day counts, accuracy and positive rate for days with any activity."""
    d = _daily(messages, steps, feedback, start, end, keys)
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("messages", "queries", "feedbacks", "positive")}
    rate = F.when(n["feedbacks"] > 0, n["positive"] / n["feedbacks"] * 100).otherwise(F.lit(0.0))
    return d.where((n["messages"] > 0) | (n["queries"] > 0)).select(
        *keys, "day", n["messages"].alias("messages"), n["queries"].alias("queries"),
        F.round(_percent(F.col("score_sum"), n["messages"]), 6).alias("accuracy"), F.round(rate, 6).alias("positive_rate"),
    )


def carry_forward(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Replace non-positive values by the last positive one; leading ones become 0."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.last(F.when(F.col(c) > 0, F.col(c)), ignorenulls=True).over(w), F.lit(0.0)))
    return df


def daily_quality(messages, steps, feedback, start, end, keys: list[str]) -> DataFrame:
    """Judge scores per day, carried forward over a dense spine, active days only.

    The window runs over (key, day) rows: its size is days x keys, not messages.
    """
    d = _daily(messages, steps, feedback, start, end, keys)
    spark = messages.sparkSession
    days = F.sequence(*[F.lit(x.date().isoformat()).cast("date") for x in (start, end)])
    spine = d.select(*keys).distinct().select(*keys, F.explode(days).alias("day")) if keys else day_spine(spark, start, end)
    dense = spine.join(d, [*keys, "day"], "left").withColumns(
        {s: F.coalesce(F.col(f"avg_{s}") * 20, F.lit(0.0)) for s in SCORES})
    out = carry_forward(dense, list(keys), "day", list(SCORES))
    active = (F.coalesce("messages", F.lit(0)) > 0) | (F.coalesce("queries", F.lit(0)) > 0)
    return out.where(active).select(*keys, "day", *[F.round(s, 6).alias(s) for s in SCORES])


def table_totals(usage: DataFrame, start, end) -> DataFrame:
    """Uses per table in the range."""
    return usage.where(within("used_at", start, end)).groupBy("table_fqn").agg(F.count(F.lit(1)).alias("uses"))


def top_tables(usage: DataFrame, start, end, n: int = 10) -> DataFrame:
    totals = table_totals(usage, start, end).where("uses > 0")
    grand = totals.agg(F.sum("uses")).scalar()
    top = totals.orderBy(F.desc("uses"), "table_fqn").limit(n)
    return top.select("table_fqn", F.split("table_fqn", "\\.")[0].alias("database"), "uses", grand.alias("total_uses"))


def table_pairs(usage: DataFrame, start, end, n: int = 50) -> DataFrame:
    """How often two tables serve the same query, counting a query once per pair.

    Queries with the same table set collapse into one weighted row before any
    pair exists, so the expansion grows with distinct sets, not with queries.
    """
    sets = (
        usage.where(within("used_at", start, end)).groupBy("step_id")
        .agg(F.array_sort(F.collect_set("table_fqn")).alias("tables")).where(F.size("tables") > 1)
        .groupBy("tables").agg(F.count(F.lit(1)).alias("queries"))
    )
    analysed = sets.agg(F.sum("queries")).scalar()
    left = sets.select("queries", "tables", F.posexplode("tables").alias("i", "table_a"))
    pairs = left.select("queries", "table_a", F.explode(F.slice("tables", F.col("i") + 2, F.size("tables"))).alias("table_b"))
    counted = pairs.groupBy("table_a", "table_b").agg(F.sum("queries").alias("together"))
    top = counted.orderBy(F.desc("together"), "table_a", "table_b").limit(n)
    return top.select("table_a", "table_b", "together", analysed.alias("queries_analysed"))


#: Most used tables whose pairs are counted first, for a count to beat.
PROBE = 32


def top_pairs(usage: DataFrame, start, end, n: int = 50, probe: int = PROBE) -> DataFrame:
    """``table_pairs`` without making every pair: a pair is at most as common as its rarer table.

    Pairs among the ``probe`` most used tables give an n-th best count; a pair
    that reaches it has two tables that are used as often, so only those are
    paired.  Rare tables never meet, however many of them one query uses.  Where
    that count is 1, single pairs compete by name alone: of each query the first
    ``n`` by name can win, and they lie among its first ``n + 1`` tables.
    """
    uses = cut_lineage(usage.where(within("used_at", start, end) & F.col("table_fqn").isNotNull()).select("step_id", "table_fqn").distinct())
    analysed = uses.groupBy("step_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1)).scalar()
    support = cut_lineage(uses.groupBy("table_fqn").agg(F.count(F.lit(1)).alias("s")))

    def paired(rows: DataFrame) -> DataFrame:
        sets = rows.groupBy("step_id").agg(F.array_sort(F.collect_list("table_fqn")).alias("tables")).where(F.size("tables") > 1).groupBy("tables").agg(F.count(F.lit(1)).alias("queries"))
        left = sets.select("queries", "tables", F.posexplode("tables").alias("i", "table_a"))
        pairs = left.select("queries", "table_a", F.explode(F.slice("tables", F.col("i") + 2, F.size("tables"))).alias("table_b"))
        return pairs.groupBy("table_a", "table_b").agg(F.sum("queries").alias("together"))

    common = support.orderBy(F.desc("s"), "table_fqn").limit(probe)
    first = paired(uses.join(common, "table_fqn", "left_semi")).orderBy(F.desc("together")).limit(n)
    least = first.agg(F.when(F.count(F.lit(1)) == n, F.min("together")).otherwise(1)).first()[0]
    counted = paired(uses.join(support.where(F.col("s") >= max(least, 2)), "table_fqn", "left_semi"))
    if least <= 1:
        place = F.row_number().over(W.partitionBy("step_id").orderBy("table_fqn"))
        single = paired(uses.withColumn("p", place).where(F.col("p") <= n + 1))
        # what both count is whole in the first
        counted = counted.unionByName(single).groupBy("table_a", "table_b").agg(F.max("together").alias("together"))
    top = counted.orderBy(F.desc("together"), "table_a", "table_b").limit(n)
    return top.select("table_a", "table_b", "together", analysed.alias("queries_analysed"))


# Reported tools with their labels, and the tool merged into another.
TOOL_LABELS = {
    "create_data": "Create Data", "clarify": "Request Clarification", "create_dashboard": "Create Dashboard",
    "inspect_data": "Inspect Data", "describe_tables": "Describe Tables", "describe_entity": "Describe Entity",
}
MERGED_TOOLS = {"create_artifact": "create_dashboard"}


def tool_counts(calls: DataFrame, labels=TOOL_LABELS, merged=MERGED_TOOLS) -> DataFrame:
    """Counts for a fixed tool list, zero-filled."""
    name = reduce(lambda c, kv: c.when(F.col("tool_name") == kv[0], kv[1]), merged.items(), F).otherwise(F.col("tool_name"))
    spark = calls.sparkSession
    zero = spark.createDataFrame([(k, 0) for k in labels], "tool_name string, n bigint")
    counted = calls.where(F.col("tool_name").isin(*labels, *merged)).groupBy(name.alias("tool_name")).agg(F.count(F.lit(1)).alias("n"))
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return counted.unionByName(zero).groupBy("tool_name").agg(F.sum("n").alias("n")).withColumn("label", label[F.col("tool_name")])


def top_users(reports: DataFrame, users: DataFrame, messages: DataFrame, steps: DataFrame, start, end, n: int = 10) -> DataFrame:
    """Messages and queries per user through their reports, most messages first."""
    m = messages.groupBy("report_id").agg(F.count(F.lit(1)).alias("m"))
    q = steps.groupBy("report_id").agg(F.count(F.lit(1)).alias("q"))
    per_user = (
        reports.where(within("created_at", start, end)).join(m, "report_id", "left").join(q, "report_id", "left")
        .groupBy("user_id").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("messages"), F.coalesce(F.sum("q"), F.lit(0)).alias("queries"))
        .join(users, "user_id")
    )
    total = per_user.agg(F.count(F.lit(1))).scalar()
    top = per_user.orderBy(F.desc("messages"), "user_id").limit(n)
    return top.select("user_id", "user_name", "messages", "queries", total.alias("total_users"))


def execution_flags(executions, calls, feedback, messages) -> DataFrame:
    """Per execution: failed data step, negative verdict, weak parent score, weak parent coverage."""
    failed = calls.where(~F.col("success") & (F.col("tool_name") == "create_data")).select("execution_id").distinct().withColumn("failed_step", F.lit(True))
    negative = feedback.where("direction < 0").select("message_id").distinct().withColumn("negative", F.lit(True))
    child, parent = messages.select("message_id", "parent_id"), messages.select(
        F.col("message_id").alias("parent_id"), F.col("response_score").alias("p_score"), F.col("instructions_effectiveness").alias("p_cover"))
    scored = child.join(parent, "parent_id").select("message_id", "p_score", "p_cover")
    return (
        executions.join(failed, "execution_id", "left").join(negative, "message_id", "left").join(scored, "message_id", "left")
        .select("execution_id", "message_id", "report_id", "status", "started_at",
                F.coalesce("failed_step", F.lit(False)).alias("failed_step"), F.coalesce("negative", F.lit(False)).alias("negative"),
                F.coalesce(F.col("p_score") < 3, F.lit(False)).alias("low_score"), F.coalesce(F.col("p_cover") < 3, F.lit(False)).alias("low_coverage"))
    )


def diagnosis_counts(executions, calls, feedback, messages, start, end) -> DataFrame:
    f = execution_flags(executions.where(within("started_at", start, end)), calls, feedback, messages)
    names = ("failed_step", "negative", "low_score", "low_coverage")
    return f.agg(*[F.count_if(n).alias(n) for n in names], F.count(F.lit(1)).alias("total"))


def diagnosis_daily(executions, calls, start, end) -> DataFrame:
    """Success and error per day, every day present."""
    failed = calls.where(~F.col("success")).select("execution_id").distinct().withColumn("failed", F.lit(True))
    bad = (F.col("status") == "error") | F.coalesce("failed", F.lit(False))
    per_day = (
        executions.where(within("started_at", start, end)).join(failed, "execution_id", "left")
        .groupBy(F.to_date("started_at").alias("day")).agg(F.count_if(bad).alias("error"), F.count_if(~bad).alias("success"))
    )
    return day_spine(executions.sparkSession, start, end).join(per_day, "day", "left").select(
        "day", F.coalesce("success", F.lit(0)).alias("success"), F.coalesce("error", F.lit(0)).alias("error"))


def first_distinct(df: DataFrame, key: str, name: str, order: str, n: int, skip: tuple[str, ...] = ()) -> DataFrame:
    """Per key the first ``n`` distinct names by first appearance, as an array.

    Ranking before collecting keeps every collected list at ``n`` items, even
    for a key with a third of the rows.
    """
    named = df.where(F.col(name).isNotNull() & (F.col(name) != "") & ~F.col(name).isin(*skip) if skip else F.col(name).isNotNull())
    first = named.groupBy(key, name).agg(F.min(order).alias("_first"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("_first", name))
    kept = first.withColumn("_rank", rank).where(F.col("_rank") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", name))), lambda s: s[name]).alias(f"{name}s"))


# Tools left out of the per-execution tool list.
SKIP_TOOLS = ("list_agent_executions", "search_instructions", "edit_instruction", "create_instruction", "run_eval", "search_evals", "create_eval")


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per key in the given order (a group-limited window, no full sort per key)."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def head_prompts(messages: DataFrame, cut: int | None = None) -> DataFrame:
    """First user prompt per report, by an aggregate that needs no per-report order."""
    first = F.min_by(F.struct(json_text("prompt").alias("p")), F.struct("created_at", "message_id"))
    return messages.where("role = 'user'").groupBy("report_id").agg(first.alias("_f")).select(
        "report_id", clip(F.col("_f.p"), cut).alias("head_prompt"))


def prompts(executions: DataFrame, messages: DataFrame, cut: int | None = None) -> DataFrame:
    """Prompt per execution: that of its answer's parent, else the report's first one."""
    child = messages.select("message_id", F.col("parent_id").alias("_parent"))
    parent = messages.select(F.col("message_id").alias("_parent"), json_text("prompt").alias("_text"))
    rows = executions.select("execution_id", "message_id", "report_id").join(child, "message_id", "left").join(parent, "_parent", "left")
    rows = rows.join(head_prompts(messages, cut), "report_id", "left")
    blank = F.trim(F.coalesce("_text", F.lit(""))) == ""
    return rows.select("execution_id", clip(F.when(blank, F.coalesce("head_prompt", F.lit(""))).otherwise(F.col("_text")), cut).alias("prompt"))


def report_turns(executions, calls, feedback, messages, n: int = 6) -> DataFrame:
    """Every execution as a turn of its report: number, prompt, status, counts, verdict.

    Turn numbers come from a spread running count; the per-report counts of
    failed and negative turns are aggregated and joined back.
    """
    turns = execution_summary(executions, calls, feedback, messages, n)
    at = executions.select("execution_id", "report_id", "started_at").withColumn("_one", F.lit(1))
    numbered = running_total(at, ["report_id"], [F.col("started_at"), F.col("execution_id")], "_one", "turn").drop("_one", "started_at")
    rows = numbered.join(turns, "execution_id")
    totals = rows.groupBy("report_id").agg(
        F.count_if(F.col("status") == "error").alias("failed_turns"), F.count_if(F.col("feedback_status") == "negative").alias("negative_turns"))
    return rows.join(totals, "report_id")


def execution_summary(executions, calls, feedback, messages, n: int = 5, cut: int | None = None) -> DataFrame:
    counts = calls.groupBy("execution_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("ok"))
    tools = first_distinct(calls, "execution_id", "tool_name", "started_at", n, SKIP_TOOLS)
    titles = first_distinct(calls, "execution_id", "step_title", "started_at", n)
    last = latest_per_key(feedback, "message_id", [F.desc("created_at"), F.desc("feedback_id")]).select("message_id", "direction", "note")
    d = F.coalesce("direction", F.lit(0))
    total, ok = F.coalesce("total", F.lit(0)), F.coalesce("ok", F.lit(0))
    failed = F.greatest(total - ok, F.lit(0))
    asked = prompts(executions, messages, cut)
    joined = executions.join(asked, "execution_id").join(counts, "execution_id", "left").join(tools, "execution_id", "left") \
        .join(titles, "execution_id", "left").join(last, "message_id", "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        "execution_id", "prompt", total.alias("total_tools"), ok.alias("successful_tools"), failed.alias("failed_tools"),
        F.when(failed > 0, "error").otherwise(F.coalesce("status", F.lit("success"))).alias("status"),
        F.when(d > 0, "positive").when(d < 0, "negative").otherwise("none").alias("feedback_status"),
        F.col("note").alias("feedback_note"), F.coalesce("tool_names", empty).alias("tool_names"),
        F.coalesce("step_titles", empty).alias("step_titles"),
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    up, down = F.count_if(F.col("direction") > 0), F.count_if(F.col("direction") < 0)
    return feedback.groupBy("message_id").agg(up.alias("up"), down.alias("down"), (up - down).alias("net"), F.count(F.lit(1)).alias("total"))


def negative_recent(feedback: DataFrame, start, end, n: int = 20, strict: bool = False) -> DataFrame:
    """Latest negative verdicts with text; the total ignores the end bound unless ``strict``."""
    neg = feedback.where("direction = -1")
    inside = neg.where(within("created_at", start, end))
    counted = inside if strict else neg.where(F.col("created_at") >= ts(whole_days(start, end)[0]))
    total = counted.agg(F.count(F.lit(1))).scalar()
    top = inside.where(F.col("note").isNotNull()).orderBy(F.desc("created_at"), F.desc("feedback_id")).limit(n)
    return top.select("feedback_id", "message_id", "note", "created_at", total.alias("total"))


def timing_breakdown(executions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Setup, tool, model and data time per execution.

    Data time of a block: its execution time, else tool time less code
    generation, else tool time.
    """
    cg, ex = (F.get_json_object("timings", f"$.{k}").cast("double") for k in ("codegen_ms", "execution_ms"))
    tool = F.col("duration_ms").cast("double")
    data = F.coalesce(ex, tool - F.coalesce(cg, F.lit(0.0)))
    per = blocks.groupBy("execution_id").agg(
        F.min("started_at").alias("first_start"), F.sum(tool).alias("tool"), F.sum(cg).alias("model"), F.sum(data).alias("data"))

    def known(c):
        return F.when(F.coalesce(c, F.lit(0.0)) != 0, F.round(c, 1))

    setup = (F.unix_micros(F.col("first_start").cast("timestamp")) - F.unix_micros(F.col("e_start").cast("timestamp"))) / 1000.0
    return executions.select("execution_id", F.col("started_at").alias("e_start")).join(per, "execution_id", "left").select(
        "execution_id", F.round(setup, 1).alias("setup_ms"), known(F.col("tool")).alias("tool_ms"),
        known(F.col("model")).alias("model_ms"), known(F.col("data")).alias("data_ms"))


def trace_issue(calls: DataFrame, feedback: DataFrame, executions: DataFrame) -> DataFrame:
    """Classify each report: failed step, negative verdict, both or unknown."""
    by_report = executions.select("execution_id", "message_id", "report_id")
    failed = calls.groupBy("execution_id").agg(F.bool_or(~F.col("success")).alias("f"))
    negative = feedback.groupBy("message_id").agg(F.bool_or(F.col("direction") < 0).alias("n"))
    flags = by_report.join(failed, "execution_id", "left").join(negative, "message_id", "left") \
        .groupBy("report_id").agg(F.coalesce(F.bool_or("f"), F.lit(False)).alias("f"), F.coalesce(F.bool_or("n"), F.lit(False)).alias("n"))
    f, n = F.col("f"), F.col("n")
    return flags.select("report_id", F.when(f & n, "both").when(f, "failed_step").when(n, "negative_feedback").otherwise("unknown").alias("issue"))
