"""Queries for spend, activity, quality and counters (AGG, WIN-01/02/05/06)."""

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from ..operators import activity, cost, counters
from .registry import Tables, query

SPEND = (dt.datetime(1997, 3, 1), dt.datetime(1998, 2, 10))
LIVE = (dt.datetime(2024, 1, 8, 5), dt.datetime(2024, 1, 20, 7))
SPEND_SQL = "created_at BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1998-02-10 23:59:59.999999'"
LIVE_SQL = "BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20 23:59:59.999999'"

PRICED = """priced AS (
  SELECT u.*, m.model_name,
    CASE WHEN provider = 'anthropic' THEN prompt_tokens + completion_tokens + cache_read_tokens + cache_write_tokens
         ELSE prompt_tokens + completion_tokens END AS total_tokens,
    CAST(coalesce(greatest((prompt_tokens + CASE provider
        WHEN 'anthropic' THEN cache_read_tokens * 0.1::DOUBLE + cache_write_tokens * 1.25::DOUBLE
        WHEN 'openai' THEN cache_read_tokens * -0.5::DOUBLE WHEN 'azure' THEN cache_read_tokens * -0.5::DOUBLE
        WHEN 'google' THEN cache_read_tokens * -0.75::DOUBLE + cache_write_tokens ELSE 0 END) / 1e6::DOUBLE * m.input_rate, 0), 0) AS DECIMAL(18,6)) AS input_cost,
    CAST(coalesce(completion_tokens / 1e6::DOUBLE * m.output_rate, 0) AS DECIMAL(18,6)) AS output_cost
  FROM v_usage_records u LEFT JOIN v_models m USING (model_id) WHERE """ + SPEND_SQL + ")"
SUMS_SQL = """cast(count(*) AS BIGINT) AS total_calls, cast(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, cast(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  cast(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, cast(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens,
  cast(sum(total_tokens) AS BIGINT) AS total_tokens, cast(sum(input_cost) AS DOUBLE) AS input_cost, cast(sum(output_cost) AS DOUBLE) AS output_cost,
  cast(sum(input_cost + output_cost) AS DOUBLE) AS total_cost"""


def spend_rows(t: Tables):
    return cost.priced(cost.in_range(t("v_usage_records"), *SPEND), t("v_models"))


def _cost_by(t, key):
    dims = {"user": ("users",), "data_source": ("report_source", "sources"), "group": ("group_membership", "groups")}
    return cost.cost_by(spend_rows(t), key, **{n: t(f"v_{n}") for n in dims.get(key, ())})


def _cost_oracle(source, key, label):
    return f"""WITH {PRICED} SELECT {key} AS key, max({label}) AS label,
  CASE WHEN count(DISTINCT provider) = 1 THEN max(provider) END AS provider, {SUMS_SQL} FROM {source} GROUP BY 1"""


_UN = "'__unattributed__'"
_COST_SQL = {
    "model": _cost_oracle("priced", "cast(model_id AS VARCHAR)", "model_name"),
    "provider": _cost_oracle("priced", "provider", "upper(provider[1]) || provider[2:]"),
    "scope": _cost_oracle("priced", "coalesce(scope, 'unscoped')", "coalesce(scope, 'unscoped')"),
    "user": _cost_oracle("priced LEFT JOIN v_users USING (user_id)", f"coalesce(cast(user_id AS VARCHAR), {_UN})",
                         "coalesce(user_name, CASE WHEN user_id IS NULL THEN 'Unattributed' ELSE 'Unknown user' END)"),
    "data_source": _cost_oracle("priced LEFT JOIN v_report_source USING (report_id) LEFT JOIN v_sources USING (source_id)",
                                f"coalesce(cast(source_id AS VARCHAR), {_UN})", "coalesce(source_name, 'Unattributed')"),
    "group": _cost_oracle("priced LEFT JOIN v_group_membership USING (user_id) LEFT JOIN v_groups USING (group_id)",
                          f"CASE WHEN group_name IS NULL THEN {_UN} ELSE group_id END", "coalesce(group_name, 'Unattributed')"),
}
for _key, _sql in _COST_SQL.items():
    query(f"cost_by_{_key}", _sql)(lambda t, k=_key: _cost_by(t, k))


@query("cost_by", f"WITH {PRICED} " + " UNION ALL ".join(f"SELECT '{k}' AS group_by, * FROM ({q[len('WITH ') + len(PRICED):]})" for k, q in _COST_SQL.items()))
def cost_by(t):
    """All six breakdowns as one table."""
    parts = [_cost_by(t, k).withColumn("group_by", F.lit(k)) for k in _COST_SQL]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("token_cost", f"""WITH {PRICED} SELECT provider, model_id, cast(count(*) AS BIGINT) AS n, cast(sum(input_cost) AS DOUBLE) AS input_cost,
  cast(sum(output_cost) AS DOUBLE) AS output_cost, cast(max(input_cost) AS DOUBLE) AS dearest FROM priced GROUP BY 1, 2""")
def token_cost(t):
    return spend_rows(t).groupBy("provider", "model_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_cost").cast("double").alias("input_cost"),
        F.sum("output_cost").cast("double").alias("output_cost"), F.max("input_cost").cast("double").alias("dearest"))


@query("cost_kpi", f"""WITH {PRICED} SELECT cast(count(*) AS BIGINT) AS total_calls, cast(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  cast(sum(completion_tokens) AS BIGINT) AS completion_tokens, cast(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  cast(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, cast(sum(total_tokens) AS BIGINT) AS total_tokens,
  cast(sum(input_cost + output_cost) AS DOUBLE) AS total_cost_usd, bool_or(provider IN ('custom', 'azure', 'bedrock')) AS has_estimated FROM priced""")
def cost_kpi(t):
    return cost.cost_kpi(spend_rows(t))


@query("cost_daily_dense", f"""WITH {PRICED}, days AS (SELECT cast(unnest(generate_series(DATE '1997-03-01', DATE '1998-02-10', INTERVAL 1 DAY)) AS DATE) AS d),
  s AS (SELECT cast(created_at AS DATE) AS d, sum(input_cost + output_cost) AS c, sum(total_tokens) AS n FROM priced GROUP BY 1)
  SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(cast(c AS DOUBLE), 0) AS cost_usd, coalesce(cast(n AS BIGINT), 0) AS tokens FROM days LEFT JOIN s USING (d)""")
def cost_daily_dense(t):
    return cost.cost_daily(spend_rows(t), *SPEND).withColumn("day", F.col("day").cast("string"))


@query("llm_usage", f"WITH {PRICED} SELECT model_id, model_name, provider, {SUMS_SQL} FROM priced GROUP BY 1, 2, 3")
def llm_usage(t):
    return cost.usage_by_model(spend_rows(t))


# ---- activity -----------------------------------------------------------------
LIVE_CTE = """steps AS (SELECT call_id, execution_id, started_at AS created_at FROM v_tool_calls WHERE success),
  reports AS (SELECT report_id, user_id, started_at AS created_at FROM v_executions)"""


def _live(t):
    steps = t("v_tool_calls").where("success").withColumn("created_at", F.col("started_at"))
    reports = t("v_executions").withColumn("created_at", F.col("started_at"))
    return t("v_messages"), steps, t("v_feedback"), reports


def _metrics_sql(rng):
    return f"""SELECT (SELECT count(*) FROM v_messages WHERE created_at {rng}) AS messages,
  (SELECT count(*) FROM steps WHERE created_at {rng}) AS queries, (SELECT count(*) FROM v_feedback WHERE created_at {rng}) AS feedbacks,
  (SELECT count(DISTINCT user_id) FROM reports WHERE created_at {rng}) AS active_users,
  (SELECT sum(response_score) FROM v_messages WHERE created_at {rng}) AS score_sum, j.* FROM (
  SELECT avg(instructions_effectiveness) * 20 AS ie, avg(context_effectiveness) * 20 AS ce, avg(response_score) * 20 AS rs
  FROM v_messages WHERE created_at {rng} AND instructions_effectiveness IS NOT NULL) j"""


@query("org_metrics", f"""WITH {LIVE_CTE} SELECT messages, queries, feedbacks, active_users, printf('%.1f', score_sum / messages * 20) || '%' AS accuracy,
  round(ie, 6) AS instructions_effectiveness, round(ce, 6) AS context_effectiveness, round(rs, 6) AS response_score FROM ({_metrics_sql(LIVE_SQL)})""")
def org_metrics(t):
    return activity.org_metrics(*_live(t), *LIVE)


# the period before [8th 05:00, 20th 07:00] is 12 days 2 hours long: from the 27th 03:00 of December
PREV_SQL = "BETWEEN TIMESTAMP '2023-12-27' AND TIMESTAMP '2024-01-08 23:59:59.999999'"
_CMP = f"""WITH {LIVE_CTE}, cur AS ({_metrics_sql(LIVE_SQL)}), prev AS ({_metrics_sql(PREV_SQL)}), both_periods AS (
  SELECT unnest(['messages','queries','feedbacks','active_users','instructions_effectiveness','context_effectiveness','response_score']) AS metric,
    unnest([c.messages, c.queries, c.feedbacks, c.active_users, c.ie, c.ce, c.rs]::DOUBLE[]) AS current,
    unnest([p.messages, p.queries, p.feedbacks, p.active_users, p.ie, p.ce, p.rs]::DOUBLE[]) AS previous FROM cur c, prev p)"""


@query("period_compare", _CMP + " SELECT metric, round(current, 6) AS current, round(previous, 6) AS previous FROM both_periods")
def period_compare(t):
    out = activity.period_compare(*_live(t), *LIVE)
    return out.select("metric", F.round("current", 6).alias("current"), F.round("previous", 6).alias("previous"))


@query("period_change", _CMP + """ SELECT metric, round_even(current - previous, 2) AS absolute,
  round_even(CASE WHEN previous > 0 THEN (current - previous) / previous * 100 ELSE 0 END, 1) AS percentage FROM both_periods""")
def period_change(t):
    return activity.period_change(activity.period_compare(*_live(t), *LIVE))


_DAILY = f"""WITH {LIVE_CTE}, m AS (SELECT cast(created_at AS DATE) AS d, count(*) AS messages, sum(response_score) AS s,
    avg(instructions_effectiveness) * 20 AS ie, avg(context_effectiveness) FILTER (instructions_effectiveness IS NOT NULL) * 20 AS ce,
    avg(response_score) FILTER (instructions_effectiveness IS NOT NULL) * 20 AS rs FROM v_messages WHERE created_at {LIVE_SQL} GROUP BY 1),
  q AS (SELECT cast(created_at AS DATE) AS d, count(*) AS queries FROM steps WHERE created_at {LIVE_SQL} GROUP BY 1),
  f AS (SELECT cast(created_at AS DATE) AS d, count(*) AS n, count(*) FILTER (direction > 0) AS pos FROM v_feedback WHERE created_at {LIVE_SQL} GROUP BY 1)"""


@query("daily_activity", _DAILY + """ SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(messages, 0) AS messages, coalesce(queries, 0) AS queries,
  round(coalesce(s / messages * 20, 0), 6) AS accuracy, round(coalesce(pos / n * 100, 0), 6) AS positive_rate
  FROM m FULL JOIN q USING (d) LEFT JOIN f USING (d) WHERE messages > 0 OR queries > 0""")
def daily_activity(t):
    m, s, f, _ = _live(t)
    return activity.daily_activity(m, s, f, *LIVE).withColumn("day", F.col("day").cast("string"))


SCOPE = [1, 2, 3]
_SCOPED = f"""WITH scope AS (SELECT DISTINCT report_id FROM v_report_source WHERE source_id IN ({', '.join(map(str, SCOPE))})),
  s_messages AS (SELECT * FROM v_messages WHERE report_id IN (SELECT report_id FROM scope)), s_executions AS (SELECT * FROM v_executions WHERE report_id IN (SELECT report_id FROM scope)),
  s_tool_calls AS (SELECT * FROM v_tool_calls WHERE execution_id IN (SELECT execution_id FROM s_executions)), s_feedback AS (SELECT * FROM v_feedback WHERE message_id IN (SELECT message_id FROM s_messages)), """


def _scoped(t):
    return activity.in_sources(*_live(t), t("v_executions"), t("v_report_source"), SCOPE)


def scoped_sql(sql: str) -> str:
    """An oracle over the facts of some sources only."""
    for name in ("messages", "executions", "tool_calls", "feedback"):
        sql = sql.replace(f"FROM v_{name}", f"FROM s_{name}")
    return _SCOPED + sql.removeprefix("WITH ")


@query("org_metrics_scoped", scoped_sql(f"""WITH {LIVE_CTE} SELECT messages, queries, feedbacks, active_users, printf('%.1f', score_sum / messages * 20) || '%' AS accuracy,
  round(ie, 6) AS instructions_effectiveness, round(ce, 6) AS context_effectiveness, round(rs, 6) AS response_score FROM ({_metrics_sql(LIVE_SQL)})"""))
def org_metrics_scoped(t):
    return activity.org_metrics(*_scoped(t), *LIVE)


@query("period_compare_scoped", scoped_sql(_CMP + " SELECT metric, round(current, 6) AS current, round(previous, 6) AS previous FROM both_periods"))
def period_compare_scoped(t):
    out = activity.period_compare(*_scoped(t), *LIVE)
    return out.select("metric", F.round("current", 6).alias("current"), F.round("previous", 6).alias("previous"))


@query("daily_activity_scoped", scoped_sql(_DAILY + """ SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(messages, 0) AS messages, coalesce(queries, 0) AS queries,
  round(coalesce(s / messages * 20, 0), 6) AS accuracy, round(coalesce(pos / n * 100, 0), 6) AS positive_rate
  FROM m FULL JOIN q USING (d) LEFT JOIN f USING (d) WHERE messages > 0 OR queries > 0"""))
def daily_activity_scoped(t):
    m, s, f, _ = _scoped(t)
    return activity.daily_activity(m, s, f, *LIVE).withColumn("day", F.col("day").cast("string"))


@query("locf_nonzero", f"""WITH {LIVE_CTE}, m AS (SELECT user_id % 40 AS org, cast(created_at AS DATE) AS d, count(*) AS n, avg(instructions_effectiveness) * 20 AS ie
    FROM v_messages WHERE created_at {LIVE_SQL} GROUP BY 1, 2),
  q AS (SELECT execution_id % 40 AS org, cast(created_at AS DATE) AS d, count(*) AS queries FROM steps WHERE created_at {LIVE_SQL} GROUP BY 1, 2),
  f AS (SELECT DISTINCT user_id % 40 AS org FROM v_feedback WHERE created_at {LIVE_SQL}),
  spine AS (SELECT org, cast(unnest(generate_series(DATE '2024-01-08', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT org FROM m UNION SELECT org FROM q UNION SELECT org FROM f))
  SELECT org, strftime(d, '%Y-%m-%d') AS day, round(v, 6) AS instructions_effectiveness FROM (SELECT org, d, n, queries,
    coalesce(last_value(CASE WHEN ie > 0 THEN ie END IGNORE NULLS) OVER (PARTITION BY org ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS v
    FROM spine LEFT JOIN m USING (org, d) LEFT JOIN q USING (org, d)) WHERE n > 0 OR queries > 0""")
def locf_nonzero(t):
    m, s, f, _ = _live(t)
    by_user, by_run = (F.col("user_id") % 40).alias("org"), (F.col("execution_id") % 40).alias("org")
    out = activity.daily_quality(m.withColumn("org", by_user), s.withColumn("org", by_run), f.withColumn("org", by_user), *LIVE, ["org"])
    return out.select("org", F.col("day").cast("string").alias("day"), "instructions_effectiveness")


USED_SQL = "used_at BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1998-02-10 23:59:59.999999'"


@query("top_tables", f"""WITH x AS (SELECT table_fqn, count(*) AS uses FROM v_table_usage WHERE {USED_SQL} GROUP BY 1)
  SELECT table_fqn, split_part(table_fqn, '.', 1) AS database, uses, cast((SELECT sum(uses) FROM x) AS BIGINT) AS total_uses FROM x ORDER BY uses DESC, table_fqn LIMIT 10""")
def top_tables(t):
    return activity.top_tables(t("v_table_usage"), *SPEND)


@query("table_pairs", f"""WITH x AS (SELECT DISTINCT step_id, table_fqn FROM v_table_usage WHERE {USED_SQL}),
  n AS (SELECT count(*) AS analysed FROM (SELECT step_id FROM x GROUP BY 1 HAVING count(*) > 1))
  SELECT a.table_fqn AS table_a, b.table_fqn AS table_b, count(*) AS together, (SELECT analysed FROM n) AS queries_analysed
  FROM x a JOIN x b ON a.step_id = b.step_id AND a.table_fqn < b.table_fqn GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50""")
def table_pairs(t):
    return activity.table_pairs(t("v_table_usage"), *SPEND)


@query("table_pairs_bounded", like="table_pairs")
def table_pairs_bounded(t):
    return activity.top_pairs(t("v_table_usage"), *SPEND)


@query("tool_counts", """SELECT tool_name, cast(coalesce(n, 0) AS BIGINT) AS n, label FROM (VALUES ('create_data', 'Create Data'), ('clarify', 'Request Clarification'),
  ('create_dashboard', 'Create Dashboard'), ('inspect_data', 'Inspect Data'), ('describe_tables', 'Describe Tables'), ('describe_entity', 'Describe Entity')) l(tool_name, label)
  LEFT JOIN (SELECT CASE WHEN tool = 'create_artifact' THEN 'create_dashboard' ELSE tool END AS tool_name, count(*) AS n
    FROM (SELECT CASE WHEN tool_name = 'create_widget' THEN 'create_artifact' ELSE tool_name END AS tool FROM v_tool_calls) GROUP BY 1) USING (tool_name)""")
def tool_counts(t):
    calls = t("v_tool_calls").replace("create_widget", "create_artifact", ["tool_name"])
    return activity.tool_counts(calls)


@query("top_users", """WITH m AS (SELECT report_id, count(DISTINCT message_id) AS m FROM v_messages GROUP BY 1),
  q AS (SELECT step_id % 97 AS report_id, count(DISTINCT step_id) AS q FROM v_steps GROUP BY 1),
  r AS (SELECT report_id % 97 AS report_id, user_id FROM v_reports WHERE created_at BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1998-02-10 23:59:59.999999'),
  p AS (SELECT u.user_id, u.user_name, cast(coalesce(sum(m), 0) AS BIGINT) AS messages, cast(coalesce(sum(q), 0) AS BIGINT) AS queries
    FROM r LEFT JOIN m USING (report_id) LEFT JOIN q USING (report_id) JOIN v_users u ON u.user_id = r.user_id GROUP BY 1, 2)
  SELECT *, (SELECT count(*) FROM p) AS total_users FROM p ORDER BY messages DESC, user_id LIMIT 10""")
def top_users(t):
    reports = t("v_reports").withColumn("report_id", F.col("report_id") % 97)
    steps = t("v_steps").select((F.col("step_id") % 97).alias("report_id"))
    return activity.top_users(reports, t("v_users").select("user_id", "user_name"), t("v_messages"), steps, *SPEND)


_FLAGS = f"""e AS (SELECT * FROM v_executions WHERE started_at {LIVE_SQL}),
  flags AS (SELECT e.*, EXISTS (SELECT 1 FROM v_tool_calls c WHERE c.execution_id = e.execution_id AND NOT c.success AND c.tool_name = 'create_data') AS failed_step,
    EXISTS (SELECT 1 FROM v_feedback f WHERE f.message_id = e.message_id AND f.direction < 0) AS negative,
    coalesce(p.response_score < 3, false) AS low_score, coalesce(p.instructions_effectiveness < 3, false) AS low_coverage
    FROM e LEFT JOIN v_messages m ON m.message_id = e.message_id LEFT JOIN v_messages p ON p.message_id = m.parent_id)"""


@query("diagnosis_counts", f"""WITH {_FLAGS} SELECT count(*) FILTER (failed_step) AS failed_step, count(*) FILTER (negative) AS negative,
  count(*) FILTER (low_score) AS low_score, count(*) FILTER (low_coverage) AS low_coverage, count(*) AS total FROM flags""")
def diagnosis_counts(t):
    return activity.diagnosis_counts(t("v_executions"), t("v_tool_calls"), t("v_feedback"), t("v_messages"), *LIVE)


@query("diagnosis_daily", f"""WITH e AS (SELECT cast(started_at AS DATE) AS d, status = 'error' OR EXISTS (SELECT 1 FROM v_tool_calls c WHERE c.execution_id = x.execution_id AND NOT c.success) AS bad
    FROM v_executions x WHERE started_at BETWEEN TIMESTAMP '2023-12-28' AND TIMESTAMP '2024-01-05 23:59:59.999999')
  SELECT strftime(s.d, '%Y-%m-%d') AS day, count(*) FILTER (NOT bad) AS success, count(*) FILTER (bad) AS error
  FROM (SELECT cast(unnest(generate_series(DATE '2023-12-28', DATE '2024-01-05', INTERVAL 1 DAY)) AS DATE) AS d) s LEFT JOIN e USING (d) GROUP BY 1""")
def diagnosis_daily(t):
    out = activity.diagnosis_daily(t("v_executions"), t("v_tool_calls"), dt.datetime(2023, 12, 28), dt.datetime(2024, 1, 5))
    return out.withColumn("day", F.col("day").cast("string"))


PROMPTS = """pr AS (SELECT message_id, report_id, parent_id, created_at, role, CASE WHEN prompt LIKE '{%' THEN coalesce(json_extract_string(CASE WHEN prompt LIKE '{%' THEN prompt END, '$.content'), '') ELSE coalesce(prompt, '') END AS p FROM v_messages),
  hp AS (SELECT report_id, arg_min(p, (created_at, message_id)) AS head FROM pr WHERE role = 'user' GROUP BY 1),
  ask AS (SELECT e.execution_id, CASE WHEN trim(coalesce(q.p, '')) = '' THEN coalesce(head, '') ELSE q.p END AS prompt FROM v_executions e LEFT JOIN pr m ON m.message_id = e.message_id LEFT JOIN pr q ON q.message_id = m.parent_id LEFT JOIN hp ON hp.report_id = e.report_id)"""
_SUMMARY = f"""WITH {PROMPTS}, c AS (SELECT execution_id, count(*) AS total, count(*) FILTER (success) AS ok FROM v_tool_calls GROUP BY 1),
  tn AS (SELECT execution_id, string_agg(tool_name, '|' ORDER BY r) AS names FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY f, tool_name) AS r
     FROM (SELECT execution_id, tool_name, min(started_at) AS f FROM v_tool_calls GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1),
  st AS (SELECT execution_id, string_agg(step_title, '|' ORDER BY r) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY f, step_title) AS r
     FROM (SELECT execution_id, step_title, min(started_at) AS f FROM v_tool_calls WHERE step_title IS NOT NULL GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1),
  fb AS (SELECT * FROM v_feedback QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, feedback_id DESC) = 1)
  SELECT e.execution_id, prompt, coalesce(total, 0) AS total_tools, coalesce(ok, 0) AS successful_tools, coalesce(total - ok, 0) AS failed_tools,
    CASE WHEN total - ok > 0 THEN 'error' ELSE coalesce(status, 'success') END AS status,
    CASE WHEN direction > 0 THEN 'positive' WHEN direction < 0 THEN 'negative' ELSE 'none' END AS feedback_status, note AS feedback_note,
    coalesce(names, '') AS tool_names, coalesce(titles, '') AS step_titles
  FROM v_executions e JOIN ask USING (execution_id) LEFT JOIN c USING (execution_id) LEFT JOIN tn USING (execution_id) LEFT JOIN st USING (execution_id) LEFT JOIN fb USING (message_id)"""


@query("execution_summary", _SUMMARY)
def execution_summary(t):
    out = activity.execution_summary(t("v_executions"), t("v_tool_calls"), t("v_feedback"), t("v_messages"))
    return out.withColumns({c: F.array_join(c, "|") for c in ("tool_names", "step_titles")})


@query("report_turns", f"""WITH {PROMPTS}, fb AS (SELECT * FROM v_feedback QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, feedback_id DESC) = 1),
  x AS (SELECT e.report_id, e.execution_id, row_number() OVER (PARTITION BY e.report_id ORDER BY e.started_at, e.execution_id) AS turn, prompt,
    CASE WHEN EXISTS (SELECT 1 FROM v_tool_calls c WHERE c.execution_id = e.execution_id AND NOT success) THEN 'error' ELSE status END AS status,
    CASE WHEN direction > 0 THEN 'positive' WHEN direction < 0 THEN 'negative' ELSE 'none' END AS feedback_status FROM v_executions e JOIN ask USING (execution_id) LEFT JOIN fb USING (message_id))
  SELECT *, count(*) FILTER (status = 'error') OVER (PARTITION BY report_id) AS failed_turns, count(*) FILTER (feedback_status = 'negative') OVER (PARTITION BY report_id) AS negative_turns FROM x""")
def report_turns(t):
    out = activity.report_turns(t("v_executions"), t("v_tool_calls"), t("v_feedback"), t("v_messages"))
    return out.select("report_id", "execution_id", "turn", "prompt", "status", "feedback_status", "failed_turns", "negative_turns")


@query("head_prompts", f"WITH {PROMPTS} SELECT report_id, head AS head_prompt FROM hp")
def head_prompts(t):
    return activity.head_prompts(t("v_messages"))


@query("distinct_ordered", """SELECT execution_id, string_agg(tool_name, '|' ORDER BY r) AS tool_names FROM (
  SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY f, tool_name) AS r FROM (
    SELECT execution_id, tool_name, min(started_at) AS f FROM v_tool_calls WHERE tool_name NOT IN ('clarify') GROUP BY 1, 2)) WHERE r <= 2 GROUP BY 1""")
def distinct_ordered(t):
    out = activity.first_distinct(t("v_tool_calls"), "execution_id", "tool_name", "started_at", 2, ("clarify",))
    return out.select("execution_id", F.array_join("tool_names", "|").alias("tool_names"))


@query("latest_per_key", """SELECT message_id, feedback_id, direction FROM v_feedback
  QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, feedback_id DESC) = 1""")
def latest_per_key(t):
    out = activity.latest_per_key(t("v_feedback"), "message_id", [F.desc("created_at"), F.desc("feedback_id")])
    return out.select("message_id", "feedback_id", "direction")


@query("turns", """WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM v_turns WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, text AS prompt,
    trim(regexp_replace(regexp_replace(CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END, '[*_`#>]', '', 'g'), '\\s+', ' ', 'g')) AS answer,
    CASE WHEN next_role = 'assistant' THEN 'answered' ELSE 'open' END AS status,
    cast(sum(CASE WHEN next_role IS DISTINCT FROM 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS BIGINT) AS open_turns
  FROM n WHERE role = 'user'""")
def turns(t):
    from ..operators.conversation import pair_turns
    return pair_turns(t("v_turns"))


@query("feedback_summary", """SELECT message_id, count(*) FILTER (direction > 0) AS up, count(*) FILTER (direction < 0) AS down,
  count(*) FILTER (direction > 0) - count(*) FILTER (direction < 0) AS net, count(*) AS total FROM v_feedback GROUP BY 1""")
def feedback_summary(t):
    return activity.feedback_summary(t("v_feedback"))


def _neg_oracle(total):
    return f"""SELECT feedback_id, message_id, note, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  (SELECT count(*) FROM v_feedback WHERE direction = -1 AND created_at {total}) AS total
  FROM v_feedback WHERE direction = -1 AND note IS NOT NULL AND created_at {LIVE_SQL} ORDER BY v_feedback.created_at DESC, feedback_id DESC LIMIT 20"""


def _neg(t, strict):
    out = activity.negative_recent(t("v_feedback"), *LIVE, strict=strict)
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


query("negative_recent", _neg_oracle(">= TIMESTAMP '2024-01-08'"))(lambda t: _neg(t, False))
query("negative_recent_strict", _neg_oracle(LIVE_SQL))(lambda t: _neg(t, True))


@query("timing_breakdown", """WITH b AS (SELECT execution_id, started_at, duration_ms::DOUBLE AS tool,
    CASE WHEN call_id % 3 = 0 THEN NULL ELSE cast(json_extract(props, '$.k') AS DOUBLE) END AS cg,
    CASE WHEN call_id % 4 = 0 THEN cast(json_extract(props, '$.k') AS DOUBLE) * 2 END AS ex FROM v_tool_calls),
  a AS (SELECT execution_id, min(started_at) AS fs, sum(tool) AS tool, sum(cg) AS model, sum(coalesce(ex, tool - coalesce(cg, 0))) AS data FROM b GROUP BY 1)
  SELECT execution_id, round((epoch_us(fs) - epoch_us(started_at)) / 1000, 1) AS setup_ms, CASE WHEN tool <> 0 THEN round(tool, 1) END AS tool_ms,
    CASE WHEN model <> 0 THEN round(model, 1) END AS model_ms, CASE WHEN data <> 0 THEN round(data, 1) END AS data_ms
  FROM v_executions LEFT JOIN a USING (execution_id)""")
def timing_breakdown(t):
    k = F.get_json_object("props", "$.k").cast("int")
    timings = F.to_json(F.struct(
        F.when(F.col("call_id") % 3 != 0, k).alias("codegen_ms"), F.when(F.col("call_id") % 4 == 0, k * 2).alias("execution_ms")))
    return activity.timing_breakdown(t("v_executions"), t("v_tool_calls").withColumn("timings", timings))


@query("trace_issue", """SELECT report_id, CASE WHEN f AND n THEN 'both' WHEN f THEN 'failed_step' WHEN n THEN 'negative_feedback' ELSE 'unknown' END AS issue FROM (
  SELECT e.report_id * 50 + e.execution_id % 50 AS report_id, bool_or(EXISTS (SELECT 1 FROM v_tool_calls c WHERE c.execution_id = e.execution_id AND NOT success)) AS f,
    bool_or(EXISTS (SELECT 1 FROM v_feedback b WHERE b.message_id = e.message_id AND direction < 0)) AS n FROM v_executions e GROUP BY 1)""")
def trace_issue(t):
    ex = t("v_executions").withColumn("report_id", F.col("report_id") * 50 + F.col("execution_id") % 50)
    return activity.trace_issue(t("v_tool_calls"), t("v_feedback"), ex)


# ---- counters -------------------------------------------------------------------
WEIGHT_SQL = "CASE lower(role) WHEN 'admin' THEN 1.5 WHEN 'analyst' THEN 1.2 WHEN 'viewer' THEN 0.8 WHEN 'trusted' THEN 1.5 ELSE 1.0 END"


@query("usage_stats", f"""SELECT source_id, table_fqn, count(*) AS usage, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures,
  cast(coalesce(sum(CAST({WEIGHT_SQL} AS DECIMAL(18,1))) FILTER (success), 0) AS DOUBLE) AS weighted_usage, count(*) FILTER (success AND role IN ('admin', 'trusted')) AS trusted_usage,
  count(user_id) FILTER (success) AS user_uses, strftime(max(used_at) FILTER (success), '%Y-%m-%d %H:%M:%S') AS last_used_at,
  count(DISTINCT user_id) FILTER (success) AS distinct_users FROM v_table_usage GROUP BY 1, 2""")
def usage_stats(t):
    out = counters.usage_stats(t("v_table_usage"))
    return out.withColumn("last_used_at", F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss"))


@query("feedback_stats", f"""SELECT source_id, table_fqn, count(*) FILTER (direction > 0) AS positive, count(*) FILTER (direction < 0) AS negative,
  cast(coalesce(sum(CAST({WEIGHT_SQL} AS DECIMAL(18,1))) FILTER (direction > 0), 0) AS DOUBLE) AS weighted_positive,
  cast(coalesce(sum(CAST({WEIGHT_SQL} AS DECIMAL(18,1))) FILTER (direction < 0), 0) AS DOUBLE) AS weighted_negative,
  strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_feedback_at FROM v_table_feedback GROUP BY 1, 2""")
def feedback_stats(t):
    out = counters.feedback_stats(t("v_table_feedback"))
    return out.withColumn("last_feedback_at", F.date_format("last_feedback_at", "yyyy-MM-dd HH:mm:ss"))


@query("feedback_attribution", """SELECT DISTINCT feedback_id, step_id, source_id, lower(table_fqn) AS table_fqn, CASE WHEN direction = 1 THEN 'positive' ELSE 'negative' END AS verdict
  FROM v_feedback JOIN (SELECT message_id, message_id % 1499 AS step_id FROM v_messages) USING (message_id)
  JOIN (SELECT step_id, source_id, table_fqn FROM v_table_usage WHERE success) USING (step_id)""")
def feedback_attribution(t):
    steps = t("v_messages").select("message_id", (F.col("message_id") % 1499).alias("step_id"))
    return counters.feedback_attribution(t("v_feedback"), steps, t("v_table_usage"))


@query("instruction_stats", f"""WITH e AS (SELECT event_id % 211 AS item_id, CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS user_id, ts AS used_at,
    CASE event_type WHEN 'click' THEN 'admin' WHEN 'signup' THEN 'viewer' ELSE 'guest' END AS role,
    CASE WHEN event_id % 3 = 0 THEN 'always' ELSE 'intelligent' END AS load_mode, CASE WHEN event_id % 4 = 0 THEN 'mentioned' ELSE 'search_match' END AS load_reason FROM events)
  SELECT item_id, count(*) AS usage, count(*) FILTER (load_mode = 'always') AS always_loads, count(*) FILTER (load_mode = 'intelligent') AS intelligent_loads,
    count(*) FILTER (load_reason = 'mentioned') AS mentions, cast(sum(CAST({WEIGHT_SQL} AS DECIMAL(18,1))) AS DOUBLE) AS weighted_usage, count(user_id) AS user_uses,
    strftime(max(used_at), '%Y-%m-%d %H:%M:%S') AS last_used_at FROM e GROUP BY 1""")
def instruction_stats(t):
    e = t.sql("""SELECT event_id % 211 AS item_id, CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS user_id, ts AS used_at,
      CASE event_type WHEN 'click' THEN 'admin' WHEN 'signup' THEN 'viewer' ELSE 'guest' END AS role,
      CASE WHEN event_id % 3 = 0 THEN 'always' ELSE 'intelligent' END AS load_mode, CASE WHEN event_id % 4 = 0 THEN 'mentioned' ELSE 'search_match' END AS load_reason FROM {events}""")
    return counters.instruction_stats(e).withColumn("last_used_at", F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss"))


@query("snippet_usage", """SELECT step_id, strftime(max(used_at), '%Y-%m-%d') AS last_used_at, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures,
  count(*) AS attempts, bool_or(NOT success) AS had_failure FROM v_table_usage WHERE used_at >= TIMESTAMP '1997-03-01' GROUP BY 1""")
def snippet_usage(t):
    out = counters.snippet_usage(t("v_table_usage"), F.lit("1997-03-01").cast("timestamp"))
    return out.withColumn("last_used_at", F.date_format("last_used_at", "yyyy-MM-dd"))


@query("eval_dashboard", """SELECT suite_id, cast(grouping(suite_id) AS BIGINT) AS overall, count(DISTINCT case_id) AS cases, count(DISTINCT run_id) AS runs,
  max_by(run_id, (finished_at, result_id)) AS last_run_id, max_by(status, (finished_at, result_id)) AS last_status,
  strftime(max(finished_at), '%Y-%m-%d %H:%M:%S') AS last_result_at FROM v_results GROUP BY GROUPING SETS ((suite_id), ())""")
def eval_dashboard(t):
    out = counters.eval_dashboard(t("v_results"))
    return out.withColumns({"overall": F.col("overall").cast("bigint"), "last_result_at": F.date_format("last_result_at", "yyyy-MM-dd HH:mm:ss")})


@query("run_rollup", """SELECT run_id, count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status IN ('fail', 'error')) AS failed FROM v_results GROUP BY 1""")
def run_rollup(t):
    return counters.run_rollup(t("v_results"))


@query("child_counts", """SELECT r.report_id, coalesce(m.n, 0) AS messages, coalesce(e.n, 0) AS executions FROM v_reports r
  LEFT JOIN (SELECT report_id, count(*) AS n FROM v_messages WHERE response_score IS NOT NULL GROUP BY 1) m USING (report_id)
  LEFT JOIN (SELECT report_id, count(*) AS n FROM v_executions WHERE status <> 'error' GROUP BY 1) e USING (report_id)""")
def child_counts(t):
    live = t("v_messages").where("response_score IS NOT NULL")
    return counters.child_counts(t("v_reports").select("report_id"), "report_id", {"messages": live, "executions": t("v_executions").where("status <> 'error'")})


@query("source_types", """WITH i AS (SELECT doc_id AS item_id, CASE doc_id % 3 WHEN 0 THEN 'user' ELSE 'git' END AS st, CASE WHEN lang = 'en' THEN 'dbt_model' WHEN lang = 'fr' THEN 'markdown_document' ELSE 'dbtx' END AS rt FROM documents)
  SELECT * FROM (SELECT 'user' AS value, count(DISTINCT item_id) FILTER (st = 'user') AS items FROM i UNION ALL SELECT 'ai', count(DISTINCT item_id) FILTER (st = 'ai') FROM i
   UNION ALL SELECT 'git', count(DISTINCT item_id) FILTER (st = 'git') FROM i UNION ALL SELECT 'dbt', count(DISTINCT item_id) FILTER (st = 'git' AND rt LIKE 'dbt\\_%' ESCAPE '\\') FROM i
   UNION ALL SELECT 'markdown', count(DISTINCT item_id) FILTER (st = 'git' AND rt = 'markdown_document') FROM i) WHERE items > 0 OR value IN ('ai', 'git')""")
def source_types(t):
    items = t("documents").select(
        F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 3 == 0, "user").otherwise("git").alias("source_type"),
        F.when(F.col("lang") == "en", "dbt_model").when(F.col("lang") == "fr", "markdown_document").otherwise("dbtx").alias("resource_type"))
    return counters.source_types(items)
