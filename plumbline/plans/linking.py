"""Queries for join forms (JOI)."""

from pyspark.sql import functions as F

from ..operators import cost, joins
from ..session import shared_dir
from .registry import query


@query("j_inner_chain", """SELECT status, count(*) AS calls, count(DISTINCT r.user_id) AS owners FROM v_tool_calls c JOIN v_executions e USING (execution_id)
  JOIN (SELECT report_id, user_id FROM v_reports) r USING (report_id) GROUP BY 1""")
def j_inner_chain(t):
    ex = t("v_executions").select("execution_id", "report_id", "status")
    chain = joins.inner_chain(t("v_tool_calls"), (ex, "execution_id"), (t("v_reports").select("report_id", "user_id"), "report_id"))
    return chain.groupBy("status").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("user_id").alias("owners"))


@query("j_left_default", """SELECT message_id, coalesce(user_name, 'Unknown User') AS user_name, coalesce(email, '') AS email
  FROM (SELECT message_id, user_id * 40 AS user_id FROM v_messages) LEFT JOIN v_users USING (user_id)""")
def j_left_default(t):
    facts = t("v_messages").select("message_id", (F.col("user_id") * 40).alias("user_id"))
    return joins.left_default(facts, t("v_users"), "user_id", {"user_name": "Unknown User", "email": ""}).select("message_id", "user_name", "email")


@query("j_semi_scope", """SELECT report_id, status FROM v_reports WHERE report_id IN (SELECT report_id FROM v_report_source WHERE source_id IN (1, 2, 3))""")
def j_semi_scope(t):
    return joins.semi_scope(t("v_reports"), t("v_report_source"), "report_id", F.col("source_id").isin(1, 2, 3)).select("report_id", "status")


@query("j_fanout", """SELECT coalesce(cast(source_id AS VARCHAR), '__unattributed__') AS source_id, count(*) AS reports, round(sum(weight), 2) AS weight
  FROM (SELECT * FROM v_reports) LEFT JOIN v_report_source USING (report_id) GROUP BY 1""")
def j_fanout(t):
    out = cost.fan_out(t("v_reports"), t("v_report_source"), "report_id", "source_id")
    return out.groupBy("source_id").agg(F.count(F.lit(1)).alias("reports"), F.round(F.sum(F.col("weight").cast("decimal(18,2)")).cast("double"), 2).alias("weight"))


@query("j_self_parent", """SELECT m.message_id, p.response_score AS parent_response_score FROM v_messages m LEFT JOIN v_messages p ON p.message_id = m.parent_id""")
def j_self_parent(t):
    return joins.self_parent(t("v_messages"), "message_id", "parent_id", ["response_score"]).select("message_id", "parent_response_score")


@query("j_suffix_match", """SELECT n.short, c.table_fqn FROM (SELECT DISTINCT upper(p_brand) AS short FROM part UNION SELECT DISTINCT 'DB1.' || p_brand FROM part WHERE p_size < 9) n
  JOIN (SELECT DISTINCT table_fqn FROM v_table_usage) c ON lower(c.table_fqn) = lower(n.short) OR lower(c.table_fqn) LIKE '%.' || lower(n.short)""")
def j_suffix_match(t):
    part = t("part")
    short = part.select(F.upper("p_brand").alias("short")).union(part.where("p_size < 9").select(F.concat(F.lit("DB1."), "p_brand"))).distinct()
    return joins.suffix_match(short, t("v_table_usage").select("table_fqn").distinct(), "short", "table_fqn").select("short", "table_fqn")


@query("j_anti_missing", """SELECT DISTINCT table_name FROM v_columns_old WHERE table_name NOT IN (SELECT table_name FROM v_columns_new)""")
def j_anti_missing(t):
    return joins.missing(t("v_columns_old").select("table_name").distinct(), t("v_columns_new"), ["table_name"])


@query("j_full_diff", """WITH o AS (SELECT table_name, count(*) AS n FROM v_columns_old GROUP BY 1), n AS (SELECT table_name, count(*) AS n FROM v_columns_new GROUP BY 1)
  SELECT * FROM (SELECT table_name, CASE WHEN o.n IS NULL THEN 'added' WHEN n.n IS NULL THEN 'removed' WHEN o.n <> n.n THEN 'changed' END AS change
  FROM o FULL JOIN n USING (table_name)) WHERE change IS NOT NULL""")
def j_full_diff(t):
    count = lambda v: t(v).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    return joins.full_diff(count("v_columns_old"), count("v_columns_new"), "table_name", "n")


@query("j_lookup_first", """SELECT e.execution_id, c.tool_name, c.error_text FROM v_executions e LEFT JOIN (SELECT * FROM v_tool_calls WHERE NOT success
  QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY attempt DESC, started_at DESC) = 1) c USING (execution_id)""")
def j_lookup_first(t):
    out = joins.lookup_first(t("v_executions"), t("v_tool_calls").where(~F.col("success")), "execution_id",
                             [F.desc("attempt"), F.desc("started_at")], ["tool_name", "error_text"])
    return out.select("execution_id", "tool_name", "error_text")


@query("j_multi_left", """SELECT c.call_id, e.status, f.direction, r.title, u.user_name FROM v_tool_calls c LEFT JOIN v_executions e USING (execution_id)
  LEFT JOIN v_feedback f ON f.message_id = e.message_id LEFT JOIN v_reports r ON r.report_id = e.report_id LEFT JOIN v_users u ON u.user_id = r.user_id""")
def j_multi_left(t):
    ex = t("v_executions").select("execution_id", "message_id", "report_id", "status")
    return joins.multi_left(
        t("v_tool_calls"), (ex, "execution_id"), (t("v_feedback").select("message_id", "direction"), "message_id"),
        (t("v_reports").select("report_id", "title", "user_id"), "report_id"), (t("v_users"), "user_id"),
    ).select("call_id", "status", "direction", "title", "user_name")


@query("j_access_intersect", """SELECT DISTINCT l_suppkey AS source_id FROM lineitem INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000""")
def j_access_intersect(t):
    asked = t("lineitem").select(F.col("l_suppkey").alias("source_id"))
    allowed = t("supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("source_id"))
    return joins.access_intersect(asked, allowed, "source_id")


@query("j_cross_source", """SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def j_cross_source(t):
    """Parquet facts, a JSON dimension and a CSV dimension in one plan."""
    as_json, as_csv = shared_dir(t.spark, "nation-json"), shared_dir(t.spark, "region-csv")
    t("nation").write.json(as_json)
    t("region").write.option("header", True).csv(as_csv)
    nation = t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(as_json)
    region = t.spark.read.schema("r_regionkey int, r_name string").option("header", True).csv(as_csv)
    rows = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("balance"))


@query("j_latest_by_max", """SELECT c.query_id, c.step_id FROM v_steps c JOIN (SELECT query_id, max(created_at) AS created_at FROM v_steps GROUP BY 1) m USING (query_id, created_at)""")
def j_latest_by_max(t):
    return joins.latest_rows_by_max(t("v_steps").select("query_id", "step_id", "created_at"), "query_id", "created_at").select("query_id", "step_id")
