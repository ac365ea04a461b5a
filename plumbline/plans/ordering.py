"""Queries for sorting and pages (TOP)."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import paging, rankmap
from ..session import shared_dir
from .registry import query
from .usage import LIVE, LIVE_SQL, PROMPTS


@query("page", """WITH n AS (SELECT count(*) AS total FROM v_catalog) SELECT table_id, score, total, cast(ceil(total / 25) AS BIGINT) AS total_pages, total > 75 AS has_more
  FROM v_catalog, n ORDER BY score DESC NULLS LAST, table_id LIMIT 25 OFFSET 50""")
def page(t):
    out = paging.page(t("v_catalog").select("table_id", "score"), paging.sort_order("score", "desc", "table_id"), 3, 25)
    return out.withColumn("total_pages", F.col("total_pages").cast("bigint"))


@query("facets", """SELECT DISTINCT connection, split_part(table_name, '.', 1) AS schema, connection || ':' || split_part(table_name, '.', 1) AS facet FROM v_catalog""")
def facets(t):
    return paging.facets(t("v_catalog"))


_ISSUES = f"""WITH {PROMPTS}, f AS (SELECT * FROM v_tool_calls WHERE NOT success QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY attempt DESC, started_at DESC, call_id DESC) = 1),
  n AS (SELECT * FROM v_feedback WHERE direction = -1 QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, feedback_id DESC) = 1),
  x AS (SELECT m.message_id, m.created_at AS seen, CASE WHEN f.call_id IS NOT NULL THEN 'tool_error' WHEN n.feedback_id IS NOT NULL THEN 'negative_feedback' ELSE 'no_issue' END AS issue_type,
    CASE WHEN f.call_id IS NOT NULL THEN coalesce(nullif(split_part(f.error_text, chr(10), 1), ''), 'Error') WHEN n.feedback_id IS NOT NULL THEN coalesce(nullif(split_part(n.note, chr(10), 1), ''), 'Negative feedback')
      ELSE coalesce(nullif(pr.p, ''), upper(m.role[1]) || m.role[2:] || ' Completion') END AS summary, coalesce(head, '') AS head_prompt,
    f.tool_name, coalesce(u.user_name, 'Unknown User') AS user_name
    FROM v_messages m LEFT JOIN f ON f.execution_id = cast(floor(m.message_id / 5) AS BIGINT) LEFT JOIN n ON n.message_id = m.message_id LEFT JOIN v_users u ON u.user_id = m.user_id LEFT JOIN hp ON hp.report_id = m.report_id LEFT JOIN pr ON pr.message_id = m.message_id
    WHERE m.created_at {LIVE_SQL})"""


def _issues(t, kind, number, pager=paging.page):
    out = paging.issues(t("v_messages"), t("v_tool_calls").where(~F.col("success")), t("v_feedback"), t("v_users"), *LIVE, kind=kind, number=number, pager=pager)
    return out.withColumns({"created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), "total_pages": F.col("total_pages").cast("bigint")})


def _issues_sql(where, offset, upto):
    return _ISSUES + f""", y AS (SELECT * FROM x WHERE {where}), n2 AS (SELECT count(*) AS total FROM y)
  SELECT message_id, strftime(seen, '%Y-%m-%d %H:%M:%S') AS created_at, issue_type, summary, head_prompt, tool_name, user_name, total, cast(ceil(total / 50) AS BIGINT) AS total_pages, total > {upto} AS has_more
  FROM y, n2 ORDER BY seen DESC, message_id DESC LIMIT 50 OFFSET {offset}"""


query("issues", _issues_sql("issue_type <> 'no_issue'", 50, 100))(lambda t: _issues(t, "all", 2))
query("issues_by_type", _issues_sql("issue_type = 'negative_feedback'", 0, 50))(lambda t: _issues(t, "negative_feedback", 1))
query("issues_all_queries", _issues_sql("true", 0, 50))(lambda t: _issues(t, "all_queries", 1))


@query("table_sort", """SELECT table_id, 'score' AS sorted_by FROM (SELECT * FROM v_catalog ORDER BY score DESC, table_name LIMIT 30)
  UNION ALL SELECT table_id, 'centrality' FROM (SELECT * FROM v_catalog ORDER BY in_degree + out_degree + centrality DESC, table_name LIMIT 30)
  UNION ALL SELECT table_id, 'usage' FROM (SELECT * FROM v_catalog LEFT JOIN (SELECT l_partkey AS table_id, count(*) AS uses FROM lineitem GROUP BY 1) USING (table_id) ORDER BY uses DESC NULLS LAST, table_name LIMIT 30)
  UNION ALL SELECT table_id, 'name' FROM (SELECT * FROM v_catalog ORDER BY table_name LIMIT 30)""")
def table_sort(t):
    uses = t("lineitem").groupBy(F.col("l_partkey").alias("table_id")).agg(F.count(F.lit(1)).alias("uses"))
    catalog = t("v_catalog")
    with_uses = catalog.join(uses, "table_id", "left")
    parts = [paging.sort_tables(with_uses if by == "usage" else catalog, by, 30).select("table_id", F.lit(by).alias("sorted_by")) for by in ("score", "centrality", "usage", "name")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("page_after", """WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
  SELECT o_orderkey, o_totalprice FROM p WHERE r > 100 AND r <= 140""")
def page_after(t):
    """The third page of forty after the first hundred rows, reached by the last row seen."""
    order = [("o_totalprice", True), ("o_orderkey", False)]
    rows = t("orders").select("o_orderkey", "o_totalprice")
    last = paging.page_after(rows, order, None, 100).orderBy("o_totalprice", F.desc("o_orderkey")).first()
    return paging.page_after(rows, order, (last["o_totalprice"], last["o_orderkey"]), 40)


@query("view_table", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def view_table(t):
    return paging.view_table(t("orders"), {"columns": ["o_orderkey", "o_totalprice"], "sortBy": "o_totalprice", "sortOrder": "desc"}, "o_orderkey")


LOG = "SELECT event_id AS log_id, event_type AS action, 'table_' || cast(event_id % 9 AS string) AS resource, user_id, ts AS created_at FROM {events}"


@query("audit_page", f"""WITH l AS ({LOG.format(events='events')}), h AS (SELECT * FROM l WHERE action IN ('view', 'click') AND created_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-25 23:59:59.999999'
    AND (action ILIKE '%TABLE_4%' OR resource ILIKE '%TABLE_4%')), n AS (SELECT count(*) AS total FROM h)
  SELECT log_id, action, resource, total, cast(ceil(total / 20) AS BIGINT) AS total_pages, total > 40 AS has_more FROM h, n ORDER BY created_at DESC, log_id DESC LIMIT 20 OFFSET 20""")
def audit_page(t, pager=paging.page):
    out = paging.audit_page(t.sql(LOG), actions=["view", "click"], start=dt.datetime(2024, 1, 2), end=dt.datetime(2024, 1, 25), search="TABLE_4", number=2, size=20, pager=pager)
    return out.select("log_id", "action", "resource", "total", F.col("total_pages").cast("bigint").alias("total_pages"), "has_more")


@query("audit_actions", "SELECT DISTINCT event_type AS action FROM events")
def audit_actions(t):
    return t.sql(LOG).select("action").distinct()


@query("starred_first", "SELECT report_id FROM v_reports ORDER BY (report_id % 50 = 0) DESC, created_at DESC, report_id LIMIT 40 OFFSET 10")
def starred_first(t):
    starred = t("v_reports").withColumn("starred", F.col("report_id") % 50 == 0)
    return paging.starred_first(starred, "starred", "created_at", "report_id", 10, 40).select("report_id")


# ---- pages by rank: the same rows, from the parts of a stored order that hold them -----------------------

def _by_rank(t, rows_per_part=400):
    return rankmap.pager(shared_dir(t.spark, "ranks"), "1", rows_per_part)


query("page_ranked", like="page")(lambda t: _by_rank(t)(t("v_catalog").select("table_id", "score"), paging.sort_order("score", "desc", "table_id"), 3, 25))
query("issues_ranked", like="issues")(lambda t: _issues(t, "all", 2, _by_rank(t)))
query("audit_page_ranked", like="audit_page")(lambda t: audit_page(t, _by_rank(t)))


@query("starred_first_ranked", like="starred_first")
def starred_first_ranked(t):
    starred = t("v_reports").withColumn("starred", F.col("report_id") % 50 == 0)
    order = [F.desc("starred"), F.desc("created_at"), F.asc("report_id")]
    return rankmap.build(starred, order, shared_dir(t.spark, "ranks"), "1", 2000).slice(10, 40).select("report_id")


@query("page_deep", """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS r, count(*) OVER () AS total FROM orders)
  SELECT o_orderkey, o_totalprice, r AS rank FROM r WHERE r >= total // 2 AND r < total // 2 + 25""")
def page_deep(t):
    """Twenty-five rows from the middle of all orders by price, each with the rank that its own columns lead back to."""
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    ranked = rankmap.build(t("orders").select("o_orderkey", "o_totalprice"), order, shared_dir(t.spark, "ranks"), "1", 2000)
    page = ranked.slice(ranked.total // 2, 25)
    first, last = (page.agg(f("o_totalprice")).first()[0] for f in (F.min, F.max))
    found = ranked.ranks(F.col("o_totalprice").between(first, last))
    return page.join(found.select("o_orderkey", "rank"), "o_orderkey")
