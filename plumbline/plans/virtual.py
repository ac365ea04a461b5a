"""Virtual tables: the platform's facts, derived from the given tables.

Every text is valid in Spark SQL and in DuckDB, so a query and its oracle read
the same rows.  ``{name}`` marks a dependency.  Integer arithmetic goes through
``floor`` because the two engines round casts differently.
"""

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # ---- spend ------------------------------------------------------------
    "v_usage_records": """
SELECT l_orderkey AS report_id,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_partkey END AS user_id,
       l_partkey % 7 AS model_id,
       CASE l_linenumber % 5 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'google'
            WHEN 3 THEN 'azure' ELSE 'custom' END AS provider,
       CASE l_returnflag WHEN 'A' THEN 'planner' WHEN 'N' THEN 'answer' ELSE NULL END AS scope,
       cast(floor(l_extendedprice) AS bigint) AS prompt_tokens,
       cast(floor(l_quantity) AS bigint) * 10 AS completion_tokens,
       cast(round(l_discount * 10000) AS bigint) AS cache_read_tokens,
       cast(round(l_tax * 10000) AS bigint) AS cache_write_tokens,
       l_shipdate AS created_at
FROM {lineitem}""",
    "v_models": """
SELECT p_partkey AS model_id, 'model-' || cast(p_partkey AS string) AS model_name,
       cast(1 + p_partkey AS double) AS input_rate,
       CASE WHEN p_partkey = 6 THEN NULL ELSE cast(4 * (1 + p_partkey) AS double) END AS output_rate
FROM {part} WHERE p_partkey < 7""",
    "v_reports": """
SELECT o_orderkey AS report_id, o_custkey AS user_id, o_orderdate AS created_at,
       CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'archived' END AS status,
       o_orderpriority || ' report ' || cast(o_orderkey AS string) AS title,
       o_totalprice AS weight
FROM {orders}""",
    "v_report_source": "SELECT DISTINCT l_orderkey AS report_id, l_suppkey AS source_id FROM {lineitem}",
    "v_sources": "SELECT s_suppkey AS source_id, s_name AS source_name FROM {supplier}",
    "v_users": """
SELECT c_custkey AS user_id, c_name AS user_name, lower(c_mktsegment) || '@example.org' AS email FROM {customer}""",
    "v_group_membership": """
SELECT c.c_custkey AS user_id, 'nation-' || cast(c.c_nationkey AS string) AS group_id FROM {customer} c
UNION ALL
SELECT c.c_custkey AS user_id, 'region-' || cast(n.n_regionkey AS string) AS group_id
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "v_groups": """
SELECT 'nation-' || cast(n_nationkey AS string) AS group_id, n_name AS group_name FROM {nation}
UNION ALL SELECT 'region-' || cast(r_regionkey AS string) AS group_id, r_name AS group_name FROM {region}""",
    # ---- conversations, verdicts, executions ------------------------------
    "v_messages": """
SELECT event_id AS message_id, event_id % 97 AS report_id, user_id, ts AS created_at,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(floor(value) AS bigint) % 6 END AS instructions_effectiveness,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(floor(value * 2) AS bigint) % 6 END AS context_effectiveness,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(floor(value * 3) AS bigint) % 6 END AS response_score,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id - (event_id % 6) END AS parent_id,
       CASE WHEN event_id % 6 = 0 THEN 'user' ELSE 'system' END AS role,
       CASE WHEN event_id % 18 = 0 THEN NULL WHEN event_id % 12 = 0 THEN chr(123) || '"content":"ask ' || event_type || ' ' || cast(event_id AS string) || '"' || chr(125)
            ELSE 'plain ' || event_type || ' ' || cast(event_id AS string) END AS prompt
FROM {events}""",
    "v_feedback": """
SELECT event_id AS feedback_id, event_id - (event_id % 3) AS message_id, user_id, ts AS created_at,
       CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS direction,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'note ' || event_type || ' ' || cast(event_id AS string) END AS note
FROM {events} WHERE event_type IN ('click', 'purchase')""",
    "v_tool_calls": """
SELECT event_id AS call_id, cast(floor(event_id / 5) AS bigint) AS execution_id,
       CASE event_type WHEN 'view' THEN 'create_widget' WHEN 'signup' THEN 'create_data'
            WHEN 'purchase' THEN 'describe_tables' WHEN 'click' THEN 'answer_question'
            ELSE 'clarify' END AS tool_name,
       event_id % 7 <> 0 AS success, event_id % 3 AS attempt, ts AS started_at,
       cast(floor(value * 10) AS bigint) AS duration_ms,
       CASE WHEN event_id % 7 = 0 THEN 'Failure ' || event_type || '\n  at line ' || cast(event_id AS string)
            ELSE NULL END AS error_text,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Step ' || cast(event_id % 11 AS string) END AS step_title,
       props
FROM {events}""",
    "v_executions": """
SELECT execution_id, message_id, message_id % 97 AS report_id, user_id, started_at,
       CASE WHEN message_id % 15 = 0 THEN 'error' WHEN message_id % 20 = 0 THEN 'in_progress' ELSE 'success' END AS status
FROM (SELECT cast(floor(event_id / 5) AS bigint) AS execution_id, min(event_id) AS message_id, min(user_id) AS user_id, min(ts) AS started_at
      FROM {events} GROUP BY cast(floor(event_id / 5) AS bigint)) x""",
    "v_turns": "SELECT conv_id, turn, role, text FROM {conversations}",
    "v_mixed": """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Abc' WHEN 3 THEN cast(user_id AS string)
         WHEN 4 THEN event_type ELSE ' 7 ' END AS txt,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS num,
       CASE WHEN event_id % 8 = 0 THEN NULL ELSE user_id END AS whole,
       CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'later' ELSE cast(cast(ts AS date) AS string) END AS day_text,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 2 = 0 END AS flag,
       CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' ELSE NULL END AS flag_text,
       event_id % 3 AS flag_num, ts
FROM {events}""",
    # ---- table usage ------------------------------------------------------
    "v_table_usage": """
SELECT l.l_orderkey AS step_id, 'db' || cast(p.p_size % 3 AS string) || '.' || p.p_brand AS table_fqn,
       l.l_suppkey % 5 AS source_id, l.l_returnflag <> 'R' AS success,
       CASE WHEN l.l_orderkey % 13 = 0 THEN NULL ELSE l.l_suppkey END AS user_id,
       CASE l.l_linenumber % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'analyst' WHEN 2 THEN 'viewer'
            WHEN 3 THEN 'trusted' ELSE 'guest' END AS role,
       l.l_shipdate AS used_at
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "v_table_feedback": """
SELECT 'db' || cast(event_id % 3 AS string) || '.Brand#' || cast(1 + user_id % 25 AS string) AS table_fqn,
       event_id % 5 AS source_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS direction,
       CASE event_type WHEN 'click' THEN 'admin' WHEN 'view' THEN 'analyst' ELSE 'guest' END AS role,
       ts AS created_at
FROM {events} WHERE event_type <> 'error'""",
    # ---- catalog ----------------------------------------------------------
    "v_columns_old": """
SELECT DISTINCT lower(p_type) || '.t' || cast(p_partkey AS string) AS table_name, 'c' || cast(l_linenumber AS string) AS col_name,
       CASE WHEN (p_partkey + l_linenumber) % 2 = 0 THEN 'bigint' ELSE 'string' END AS dtype,
       l_linenumber AS position, p_partkey AS table_id
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
WHERE p_size <> 4 AND (p_brand <> 'Brand#7' OR l_quantity < 14)""",
    "v_columns_new": """
SELECT DISTINCT lower(p_type) || '.t' || cast(p_partkey AS string) AS table_name, 'c' || cast(l_linenumber AS string) AS col_name,
       CASE WHEN p_type = 'ECONOMY' AND l_linenumber = 1 THEN 'double'
            WHEN (p_partkey + l_linenumber) % 2 = 0 THEN 'bigint' ELSE 'string' END AS dtype,
       8 - l_linenumber AS position, p_partkey AS table_id
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
WHERE p_size <> 5""",
    "v_catalog": """
SELECT p_partkey AS table_id, lower(p_type) || '.' || replace(p_name, ' ', '_') || '_' || cast(p_partkey AS string) AS table_name,
       p_size AS n_columns, p_partkey % 3 <> 0 AS is_active, 'conn' || cast(p_partkey % 3 AS string) AS connection,
       p_partkey % 4 AS in_degree, p_partkey % 5 AS out_degree, (p_partkey % 10) / 10.0E0 AS centrality,
       p_retailprice AS score
FROM {part}""",
    # ---- query log --------------------------------------------------------
    "v_query_log": """
SELECT event_id AS query_id, ts AS issued_at, user_id,
       CASE event_type
         WHEN 'view' THEN 'SELECT region, amt FROM orders_' || cast(user_id % 5 AS string)
         WHEN 'click' THEN 'select  REGION,  amt from orders_' || cast(user_id % 5 AS string) || ' '
         WHEN 'signup' THEN 'INSERT INTO audit_' || cast(user_id % 5 AS string) || ' VALUES (1)'
         WHEN 'purchase' THEN 'SELECT region, SUM(amt) FROM orders_' || cast(user_id % 5 AS string) || ' GROUP BY region'
         ELSE 'UPDATE orders_' || cast(user_id % 5 AS string) || ' SET amt = 0' END AS sql_text,
       CASE event_type WHEN 'view' THEN 'orders_' || cast(user_id % 5 AS string) WHEN 'click' THEN 'orders_' || cast(user_id % 5 AS string)
         WHEN 'purchase' THEN 'orders_' || cast(user_id % 5 AS string) ELSE NULL END AS base_table,
       event_type AS shape, 'src' || cast(user_id % 3 AS string) AS scope,
       cast(floor(value * 10) AS bigint) AS cost_ms, cast(floor(value * 1000) AS bigint) + 1 AS bytes,
       cast(floor(value) AS bigint) AS n_rows,
       CASE WHEN event_id % 7 = 0 THEN 'boom ' || event_type ELSE NULL END AS error_text,
       event_id % 3 = 0 AS cache_hit, event_id % 4 AS hits
FROM {events}""",
    # ---- saved results ----------------------------------------------------
    "v_saved": """
SELECT o_orderkey AS saved_id, 'r-' || cast(o_orderkey AS string) AS slug,
       o_orderpriority || ' ' || cast(o_custkey AS string) AS title,
       CASE WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'success' END AS status,
       o_orderkey % 2 = 0 AS is_default, o_orderdate AS created_at
FROM {orders}""",
    "v_saved_refs": """
SELECT c_custkey AS ref_id,
       CASE c_custkey % 4 WHEN 0 THEN cast(c_custkey AS string) WHEN 1 THEN 'R-' || cast(c_custkey AS string)
            WHEN 2 THEN '5-low ' || cast(c_custkey AS string) ELSE 'missing ' || cast(c_custkey AS string) END AS ref
FROM {customer}""",
    "v_steps": """
SELECT o_orderkey AS step_id, o_custkey AS query_id, o_orderdate AS created_at, o_orderkey % 4 AS org_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'success' END AS status,
       o_orderstatus = 'P' AS parent_shared, o_orderpriority AS title, o_totalprice AS payload,
       'load_step(''' || o_orderpriority || ''') + load_entity("E' || cast(o_custkey AS string) || '") + load_step(''' || o_orderpriority || ''') + load_step(x)' AS code
FROM {orders}""",
    # ---- guidance, rules, quotas ------------------------------------------
    "v_guidance": """
SELECT doc_id AS item_id, text, source AS category, lang, CASE WHEN doc_id % 10 = 0 THEN 'always' ELSE 'intelligent' END AS load_mode
FROM {documents}""",
    "v_results": """
SELECT event_id AS result_id, cast(floor(event_id / 10) AS bigint) AS case_id, cast(floor(event_id / 100) AS bigint) AS run_id,
       event_id % 7 AS suite_id, ts AS finished_at,
       CASE WHEN event_id % 9 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'fail' WHEN event_id % 11 = 0 THEN 'skipped' ELSE 'pass' END AS status
FROM {events}""",
    "v_policies": """
SELECT 'user' AS level, c_custkey AS policy_id, c_custkey AS principal_id,
       CASE WHEN c_custkey % 2 = 0 THEN 50 ELSE NULL END AS max_queries,
       cast(1000 + c_custkey AS bigint) AS max_bytes, cast(NULL AS bigint) AS max_tokens
FROM {customer} WHERE c_mktsegment = 'BUILDING'
UNION ALL
SELECT 'group' AS level, 1000000 + n_nationkey AS policy_id, n_nationkey AS principal_id,
       40 + n_nationkey AS max_queries, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE cast(2000 + n_nationkey AS bigint) END AS max_bytes,
       cast(100000 AS bigint) AS max_tokens
FROM {nation}
UNION ALL
SELECT 'role' AS level, 2000000 + r_regionkey AS policy_id, r_regionkey AS principal_id,
       cast(NULL AS bigint) AS max_queries, cast(2010 AS bigint) AS max_bytes, cast(90000 - r_regionkey AS bigint) AS max_tokens
FROM {region} WHERE r_regionkey < 3""",
    "v_principals": """
SELECT c.c_custkey AS user_id, 'user' AS level, c.c_custkey AS principal_id FROM {customer} c
UNION ALL SELECT c.c_custkey AS user_id, 'group' AS level, c.c_nationkey AS principal_id FROM {customer} c WHERE c.c_acctbal > 0
UNION ALL SELECT c.c_custkey AS user_id, 'role' AS level, n.n_regionkey AS principal_id
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal < 8000""",
    "v_policy_overrides": """
SELECT n_nationkey + 1000000 AS policy_id, cast(n_nationkey % 2 AS bigint) AS connection_id,
       CASE WHEN n_nationkey % 2 = 0 THEN 12 ELSE NULL END AS max_queries, cast(120 + n_nationkey % 2 AS bigint) AS max_bytes
FROM {nation} WHERE n_regionkey < 3
UNION ALL
SELECT n_nationkey + 1000000 AS policy_id, cast(1 AS bigint) AS connection_id, NULL AS max_queries, cast(121 AS bigint) AS max_bytes
FROM {nation} WHERE n_regionkey = 0 AND n_nationkey % 2 = 0""",
    "v_quota_events": """
SELECT event_id, user_id, event_id % 2 AS connection_id, ts,
       cast(1 AS bigint) AS queries, cast(floor(value) AS bigint) AS bytes
FROM {events}""",
}
