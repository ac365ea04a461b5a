"""Queries for rules and quotas (RUL, QTA)."""

from pyspark.sql import functions as F

from ..operators import quota, rules
from .registry import query

TEXT_RULES = """SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN NULL ELSE text END AS value,
  CASE turn % 5 WHEN 0 THEN 'text.contains' WHEN 1 THEN 'text.not_contains' WHEN 2 THEN 'text.equals' WHEN 3 THEN 'text.regex' ELSE 'text.regex' END AS kind,
  CASE turn % 5 WHEN 0 THEN 'the' WHEN 1 THEN 'the' WHEN 2 THEN text WHEN 3 THEN '/THEN|de\\s/i' ELSE CASE conv_id % 3 WHEN 0 THEN '*' WHEN 1 THEN '(' ELSE 'on' END END AS wanted FROM {conversations}"""


@query("m_text", """SELECT conv_id, turn, coalesce(CASE WHEN turn % 7 = 6 THEN false ELSE CASE turn % 5 WHEN 0 THEN contains(text, 'the') WHEN 1 THEN NOT contains(text, 'the') WHEN 2 THEN true
  WHEN 3 THEN regexp_matches(text, '(?i)THEN|de\\s') ELSE CASE conv_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE contains(text, 'on') END END END, false) AS passed FROM conversations""")
def m_text(t):
    rows = t.sql(TEXT_RULES.replace("\\s", "\\\\s"))
    return rows.select("conv_id", "turn", rules.match_text(F.col("kind"), F.col("value"), F.col("wanted")).alias("passed"))


NUMBER_RULES = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE cast(cast(floor(value) AS bigint) AS string) END AS v,
  CASE event_id % 7 WHEN 0 THEN 'gt' WHEN 1 THEN 'gte' WHEN 2 THEN 'lt' WHEN 3 THEN 'lte' WHEN 4 THEN 'eq' WHEN 5 THEN 'ne' ELSE 'between' END AS op FROM {events}"""


@query("m_number", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN false ELSE CASE event_id % 7 WHEN 0 THEN v > 20 WHEN 1 THEN v >= 20 WHEN 2 THEN v < 20 WHEN 3 THEN v <= 20 WHEN 4 THEN v = 20 WHEN 5 THEN v <> 20 ELSE true END END AS passed
  FROM (SELECT event_id, floor(value) AS v FROM events)""")
def m_number(t):
    return t.sql(NUMBER_RULES).select("event_id", rules.match_number(F.col("op"), F.col("v"), F.lit("20")).alias("passed"))


@query("m_list", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN list_has_any(string_split(p_name, ' '), ['red', 'ring']) WHEN 1 THEN list_has_all(string_split(p_name, ' '), ['small', 'ring']) ELSE true END AS passed FROM part""")
def m_list(t):
    k, words = F.col("p_size") % 3, lambda *ws: F.array(*[F.lit(w) for w in ws])
    kind = F.when(k == 1, "list.contains_all").otherwise("list.contains_any")
    wanted = F.when(k == 0, words("red", "ring")).when(k == 1, words("small", "ring")).otherwise(F.array().cast("array<string>"))
    return t("part").select("p_partkey", rules.match_list(kind, F.split("p_name", " "), wanted).alias("passed"))


@query("m_length", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN length(text) > 300 WHEN 1 THEN length(text) <= 300 ELSE len(string_split(text, ' ')) >= 40 END AS passed FROM conversations""")
def m_length(t):
    k, words = F.col("turn") % 3, F.split("text", " ")
    hit = F.when(k == 0, rules.match_length(F.lit("gt"), F.col("text"), F.lit(300))).when(k == 1, rules.match_length(F.lit("lte"), F.col("text"), F.lit(300))) \
        .otherwise(rules.match_length(F.lit("gte"), words, F.lit(40), is_list=True))
    return t("conversations").select("conv_id", "turn", hit.alias("passed"))


CALLS = """SELECT call_id, execution_id % 300 AS case_id, tool_name, CASE WHEN attempt = 2 THEN 'knowledge' ELSE 'main' END AS phase, cast(1 + attempt AS int) AS turn, started_at FROM {v_tool_calls}"""
CALL_RULES = """SELECT c_custkey AS rule_id, c_custkey % 310 AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'create_data' WHEN 1 THEN 'clarify' ELSE 'no_such_tool' END AS tool, c_custkey % 9 AS min_calls,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 8 END AS max_calls, CASE c_custkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'knowledge' ELSE NULL END AS rule_phase, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE NULL END AS rule_turn FROM {customer}"""


@query("r_tool_calls", f"""WITH c AS ({CALLS.format(v_tool_calls='v_tool_calls')}), r AS ({CALL_RULES.format(customer='customer')}), n AS (SELECT rule_id, r.case_id, any_value(min_calls) AS lo, any_value(max_calls) AS hi, count(call_id) AS calls FROM r LEFT JOIN c ON c.case_id = r.case_id AND tool_name = tool
    AND (rule_phase IS NULL OR rule_phase = phase) AND (rule_turn IS NULL OR rule_turn = turn) GROUP BY 1, 2) SELECT rule_id, case_id, calls, calls >= lo AND (hi IS NULL OR calls <= hi) AS passed FROM n""")
def r_tool_calls(t):
    return rules.tool_call_rules(t.sql(CALL_RULES), t.sql(CALLS))


PHASE_RULES = """SELECT c_custkey AS rule_id, c_custkey % 310 AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'main' ELSE 'knowledge' END AS wanted_phase, c_custkey % 2 = 0 AS occurred, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE NULL END AS rule_turn FROM {customer}"""


@query("r_phase", f"""WITH c AS ({CALLS.format(v_tool_calls='v_tool_calls')}), r AS ({PHASE_RULES.format(customer='customer')})
  SELECT rule_id, case_id, EXISTS (SELECT 1 FROM c WHERE c.case_id = r.case_id AND c.phase = r.wanted_phase AND (rule_turn IS NULL OR rule_turn = c.turn)) = occurred AS passed FROM r""")
def r_phase(t):
    return rules.phase_rules(t.sql(PHASE_RULES), t.sql(CALLS))


ORDER_CALLS = "SELECT call_id, execution_id AS case_id, tool_name, started_at FROM {v_tool_calls}"
_T = ("create_widget", "create_data", "describe_tables", "answer_question", "clarify")


@query("r_ordering", f"""WITH c AS ({ORDER_CALLS.format(v_tool_calls='v_tool_calls')}), s AS (SELECT case_id, string_agg(tool_name, ',' ORDER BY started_at, call_id) AS calls FROM c GROUP BY 1),
  r AS (SELECT execution_id AS rule_id, execution_id AS case_id, CASE execution_id % 3 WHEN 0 THEN 'flexible' WHEN 1 THEN 'strict' ELSE 'exact' END AS mode, execution_id % 3 AS k FROM v_executions)
  SELECT rule_id, r.case_id, mode, CASE k WHEN 0 THEN regexp_matches(',' || calls || ',', ',create_data,(.*,)?clarify,(.*,)?create_widget,') WHEN 1 THEN contains(',' || calls || ',', ',create_data,clarify,')
    ELSE calls = 'create_data,clarify,create_widget,create_data,clarify' END AS passed FROM r JOIN s USING (case_id)""")
def r_ordering(t):
    k = F.col("execution_id") % 3
    seq = lambda *names: F.array(*[F.lit(n) for n in names])
    wanted = t("v_executions").select(
        F.col("execution_id").alias("rule_id"), F.col("execution_id").alias("case_id"), F.when(k == 0, "flexible").when(k == 1, "strict").otherwise("exact").alias("mode"),
        F.when(k == 0, seq("create_data", "clarify", "create_widget")).when(k == 1, seq("create_data", "clarify")).otherwise(seq("create_data", "clarify", "create_widget", "create_data", "clarify")).alias("sequence"))
    return rules.ordering_rules(wanted, t.sql(ORDER_CALLS))


@query("r_totals", """SELECT case_id, count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status IN ('fail', 'error')) AS failed, count(*) FILTER (status = 'skipped') AS skipped,
  CASE WHEN count(*) FILTER (status IN ('fail', 'error')) = 0 THEN 'pass' ELSE 'fail' END AS status FROM v_results GROUP BY 1""")
def r_totals(t):
    passed = F.when(F.col("status") == "pass", True).when(F.col("status").isin("fail", "error"), False)
    return rules.rule_totals(t("v_results").select("case_id", passed.alias("passed")))


_APPLY = """l AS (SELECT user_id, p.* FROM v_principals n JOIN v_policies p ON p.level = n.level AND p.principal_id = n.principal_id), a AS (SELECT * FROM l WHERE level = 'user' OR user_id NOT IN (SELECT user_id FROM l WHERE level = 'user')),
  base AS (SELECT u.user_id, min(max_queries)::BIGINT AS max_queries, min(max_bytes) AS max_bytes, min(max_tokens) AS max_tokens, CASE WHEN max(level) IS NULL THEN 'default' WHEN max(level) = 'user' THEN 'direct' ELSE 'inherited' END AS source FROM (SELECT DISTINCT user_id FROM v_principals) u LEFT JOIN a USING (user_id) GROUP BY 1),
  touched AS (SELECT DISTINCT user_id, connection_id FROM a JOIN v_policy_overrides USING (policy_id)),
  per AS (SELECT t.user_id, t.connection_id, min(CASE WHEN o.policy_id IS NOT NULL THEN o.max_queries ELSE a.max_queries END)::BIGINT AS max_queries, min(CASE WHEN o.policy_id IS NOT NULL THEN o.max_bytes ELSE a.max_bytes END) AS max_bytes, min(max_tokens) AS max_tokens,
    CASE WHEN max(level) = 'user' THEN 'direct' ELSE 'inherited' END AS source FROM touched t JOIN a USING (user_id) LEFT JOIN v_policy_overrides o ON o.policy_id = a.policy_id AND o.connection_id = t.connection_id GROUP BY 1, 2)"""


def _limits(t):
    return quota.limits_resolve(t("v_policies"), t("v_principals"), t("v_policy_overrides"))


@query("limits_resolve", f"WITH {_APPLY} SELECT user_id, NULL::BIGINT AS connection_id, max_queries, max_bytes, max_tokens, source FROM base UNION ALL SELECT * FROM per")
def limits_resolve(t):
    return _limits(t).withColumn("max_queries", F.col("max_queries").cast("bigint"))


_CONN = _APPLY + """, u AS (SELECT user_id, connection_id, sum(queries)::BIGINT AS q, sum(bytes)::BIGINT AS b FROM v_quota_events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2),
  lim AS (SELECT u.*, CASE WHEN per.user_id IS NOT NULL THEN per.max_queries ELSE base.max_queries END AS mq, CASE WHEN per.user_id IS NOT NULL THEN per.max_bytes ELSE base.max_bytes END AS mb
    FROM u LEFT JOIN base USING (user_id) LEFT JOIN per ON per.user_id = u.user_id AND per.connection_id = u.connection_id)"""


@query("quota_summary", f"""WITH {_CONN}, m AS (SELECT user_id, connection_id, 'queries' AS metric, q AS used, mq AS "limit" FROM lim UNION ALL SELECT user_id, connection_id, 'bytes', b, mb FROM lim)
  SELECT user_id, connection_id, metric, used, "limit", CASE WHEN "limit" IS NOT NULL THEN greatest("limit" - used, 0) END AS remaining, CASE WHEN "limit" > 0 THEN round_even(used / "limit" * 100, 2) WHEN "limit" IS NOT NULL THEN CASE WHEN used > 0 THEN 100 ELSE 0 END END AS percent FROM m""")
def quota_summary(t):
    return quota.quota_summary(t("v_quota_events"), _limits(t), "2024-01-01")


BREACH_SQL = f"""WITH {_CONN}, r AS (SELECT e.user_id, e.connection_id, event_id, ts, mb AS "limit", sum(bytes) OVER (PARTITION BY e.user_id, e.connection_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used
    FROM v_quota_events e JOIN lim ON lim.user_id = e.user_id AND lim.connection_id = e.connection_id WHERE bytes > 0)
  SELECT user_id, connection_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, used, "limit" FROM r WHERE used > "limit" QUALIFY row_number() OVER (PARTITION BY user_id, connection_id, date_trunc('month', r.ts) ORDER BY r.ts, event_id) = 1"""


def byte_limits(t):
    pairs = t("v_quota_events").select("user_id", "connection_id").distinct()
    return quota.connection_limits(_limits(t), pairs).select("user_id", "connection_id", F.col("max_bytes").alias("limit"))


@query("quota_breach", BREACH_SQL)
def quota_breach(t):
    out = quota.quota_breach(t("v_quota_events"), byte_limits(t), ["user_id", "connection_id"], "bytes")
    return out.drop("month").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
