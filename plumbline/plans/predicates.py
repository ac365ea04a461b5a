"""Queries for filters (FLT).  Rows are checked by id, on text, number, flag and date columns."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import filters
from .registry import query

TXT = "lower(coalesce(txt, 'null'))"
WHOLE = "lower(coalesce(cast(whole AS VARCHAR), 'null'))"
NUM = "CASE WHEN txt IS NULL OR trim(txt) = '' THEN 0 ELSE try_cast(trim(txt) AS DOUBLE) END"
N0 = "coalesce(num, 0)"
DAY = "CASE WHEN day_text IS NULL THEN TIMESTAMP '1970-01-01' ELSE try_cast(day_text AS TIMESTAMP) END"


def _case(key, conds, where):
    """One query per operator: rows kept by any of the conditions, tagged by condition."""
    sql = " UNION ALL ".join(f"SELECT {i} AS cond, event_id FROM v_mixed WHERE {w}" for i, w in enumerate(where))

    def build(t, conds=conds):
        df = t("v_mixed")
        # one scan: each row lists the conditions it meets
        hits = F.array_compact(F.array(*[F.when(filters.condition(df, c), F.lit(i)) for i, c in enumerate(conds)]))
        return df.select(F.explode(hits).alias("cond"), "event_id")

    query(key, f"SELECT cast(cond AS INTEGER) AS cond, event_id FROM ({sql})")(build)


def _cond(op, column, value=None, value2=None):
    return {"column": column, "operator": op, "value": value, "value2": value2}


_case("f_equals", [_cond("equals", "TXT", "ABC"), _cond("equals", "whole", 12), _cond("equals", "txt", None)],
      [f"{TXT} = 'abc'", f"{WHOLE} = '12'", f"{TXT} = 'null'"])
_case("f_not_equals", [_cond("not_equals", "txt", "abc"), _cond("not_equals", "whole", 12)], [f"{TXT} <> 'abc'", f"{WHOLE} <> '12'"])
_case("f_contains", [_cond("contains", "txt", "B"), _cond("contains", "whole", "1")], [f"{TXT} LIKE '%b%'", f"{WHOLE} LIKE '%1%'"])
_case("f_not_contains", [_cond("not_contains", "txt", "B"), _cond("not_contains", "whole", "1")], [f"{TXT} NOT LIKE '%b%'", f"{WHOLE} NOT LIKE '%1%'"])
_case("f_starts_with", [_cond("starts_with", "txt", "NU"), _cond("starts_with", "whole", "2")], [f"{TXT} LIKE 'nu%'", f"{WHOLE} LIKE '2%'"])
_case("f_ends_with", [_cond("ends_with", "txt", "C"), _cond("ends_with", "whole", "l")], [f"{TXT} LIKE '%c'", f"{WHOLE} LIKE '%l'"])
for _op, _sym in {"greater_than": ">", "less_than": "<", "gte": ">=", "lte": "<="}.items():
    _case(f"f_{_op}", [_cond(_op, "num", 50), _cond(_op, "txt", "7"), _cond(_op, "num", "")], [f"{N0} {_sym} 50", f"({NUM}) {_sym} 7", f"{N0} {_sym} 0"])
_case("f_between", [_cond("between", "num", 0, 25), _cond("between", "txt", "5", "9")], [f"{N0} BETWEEN 0 AND 25", f"({NUM}) BETWEEN 5 AND 9"])
for _op, _sym in {"before": "<", "after": ">"}.items():
    _case(f"f_{_op}", [_cond(_op, "day_text", "2024-01-15"), _cond(_op, "ts", "2024-01-15 12:00:00"), _cond(_op, "whole", "1970-01-01 00:00:00.050")],
          [f"({DAY}) {_sym} TIMESTAMP '2024-01-15'", f"ts {_sym} TIMESTAMP '2024-01-15 12:00:00'",
           f"coalesce(epoch_ms(whole), TIMESTAMP '1970-01-01') {_sym} TIMESTAMP '1970-01-01 00:00:00.050'"])
_case("f_is_empty", [_cond("is_empty", "txt"), _cond("is_empty", "num"), _cond("is_empty", "absent")], ["txt IS NULL OR txt = ''", "num IS NULL", "true"])
_case("f_is_not_empty", [_cond("is_not_empty", "txt"), _cond("is_not_empty", "num")], ["txt <> ''", "num IS NOT NULL"])
_case("f_is_true", [_cond("is_true", "flag"), _cond("is_true", "flag_text"), _cond("is_true", "flag_num")], ["flag", "flag_text = 'true'", "flag_num = 1"])
_case("f_is_false", [_cond("is_false", "flag"), _cond("is_false", "flag_text"), _cond("is_false", "flag_num")], ["NOT flag", "flag_text = 'false'", "flag_num = 0"])
_case("f_in", [_cond("in", "txt", ["ABC", None]), _cond("in", "whole", [1, 2, 3]), _cond("in", "txt", "Abc")],
      [f"{TXT} IN ('abc', 'null')", f"{WHOLE} IN ('1', '2', '3')", "false"])
_case("f_not_in", [_cond("not_in", "txt", ["ABC", None]), _cond("not_in", "txt", "Abc")], [f"{TXT} NOT IN ('abc', 'null')", "true"])

GROUPS = [
    [{"column": "a:txt", "operator": "equals", "value": "abc"}, {"column": "a:NUM", "operator": "gte", "value": 20}],
    [{"column": "a:whole", "operator": "less_than", "value": 10}, {"column": "b:num", "operator": "equals", "value": "never"}],
]


@query("f_groups", f"SELECT event_id FROM v_mixed WHERE ({TXT} = 'abc' AND {N0} >= 20) OR coalesce(whole, 0) < 10")
def f_groups(t):
    return filters.apply_filters(t("v_mixed"), GROUPS, chart="a").select("event_id")


@query("f_default", "SELECT event_id FROM v_mixed WHERE coalesce(num, 0) > 30 AND coalesce(flag, false)")
def f_default(t):
    view = {"defaultFilters": [{"conditions": [_cond("greater_than", "num", 30), _cond("is_true", "flag")]}]}
    return filters.default_filters(t("v_mixed"), view).select("event_id")


_OPS = {k: ",".join(v) for k, v in filters.OPERATORS.items()}


@query("f_type_infer", """WITH o(type, operators) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in _OPS.items()) + """),
  d AS (SELECT CASE WHEN bool_and(regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}')) THEN 'date' ELSE 'string' END AS type FROM (SELECT day_text AS v FROM v_mixed WHERE event_id % 5 > 2)),
  b AS (SELECT CASE WHEN bool_and(v IN ('true', 'false')) THEN 'boolean' ELSE 'string' END AS type FROM (SELECT flag_text AS v FROM v_mixed WHERE flag_text IS NOT NULL AND flag_text <> '1')),
  x AS (SELECT 'txt' AS "column", 'string' AS type UNION ALL SELECT 'day_only', type FROM d UNION ALL SELECT 'bool_only', type FROM b
    UNION ALL SELECT 'num_text', CASE WHEN count(try_cast(v AS DOUBLE)) = count(v) THEN 'number' ELSE 'string' END FROM (SELECT cast(user_id AS VARCHAR) AS v FROM events)
    UNION ALL SELECT 'num', 'number' UNION ALL SELECT 'ts', 'date' UNION ALL SELECT 'flag', 'boolean')
  SELECT * FROM x JOIN o USING (type)""")
def f_type_infer(t):
    df = t("v_mixed").join(t("events").select("event_id", F.col("user_id").cast("string").alias("num_text")), "event_id")
    df = df.withColumn("day_only", F.when(F.col("event_id") % 5 > 2, F.col("day_text"))) \
        .withColumn("bool_only", F.when(F.col("flag_text") != "1", F.col("flag_text")))
    return filters.infer_types(df, "event_id", ["txt", "day_only", "bool_only", "num_text", "num", "ts", "flag"])


@query("f_store", """SELECT doc_id FROM documents WHERE source >= 'src1' AND source <= 'src15' AND lang IN ('en', 'fr') AND lower(text) LIKE '%the%'""")
def f_store(t):
    chosen = {"source": {"from": "src1", "to": "src15"}, "language": ["en", "fr"], "text": "THE", "absent": "x", "doc_id": []}
    return filters.store_filter(t("documents"), chosen, {"language": "lang"}).select("doc_id")


@query("f_name_patterns", """SELECT table_id, table_name FROM v_catalog WHERE regexp_matches(table_name, '(?i)(?:^|[./])small_ring_0$')
  OR regexp_matches(table_name, '(?i)(economy|promo)\\..*_1[0-9]*$') OR table_name = 'small_ring_0' """)
def f_name_patterns(t):
    return filters.match_names(t("v_catalog"), "table_name", ["small_ring_0", "(economy|promo)\\..*_1[0-9]*$", "bad("]).select("table_id", "table_name")


@query("f_multi_search", """WITH h AS (SELECT item_id, category FROM v_guidance WHERE regexp_matches(text, '(?i)then\\s+and|retition') OR regexp_matches(category, '(?i)then\\s+and|retition')
   OR regexp_matches(cast(item_id AS VARCHAR), '(?i)then\\s+and|retition')) SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY item_id LIMIT 40""")
def f_multi_search(t):
    out = filters.multi_search(t("v_guidance"), ["then\\s+and", "retition", "broken("], ["text", "category", "item_id"], "item_id", 40)
    return out.select("item_id", "category", "total")


@query("f_ilike_recent", "SELECT report_id, title FROM v_reports WHERE title ILIKE '%URGENT report 1%' ORDER BY created_at DESC, report_id DESC LIMIT 25")
def f_ilike_recent(t):
    return filters.ilike_recent(t("v_reports"), "urgent REPORT 1", ["title"], "created_at", "report_id", 25).select("report_id", "title")


@query("f_date_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2023-12-14' AND TIMESTAMP '2024-01-13 23:59:59.999999'")
def f_date_range(t):
    now = dt.datetime(2024, 1, 14, 1, 30, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    return filters.date_range(t("events"), "ts", None, None, now).select("event_id")


@query("f_soft_scope", "SELECT table_id FROM v_catalog WHERE is_active AND table_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def f_soft_scope(t):
    overlay = t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("table_id"))
    return filters.soft_scope(t("v_catalog"), "table_id", "overlay", overlay, active=True).select("table_id")


@query("f_parent_or_child", """SELECT report_id FROM v_reports WHERE title ILIKE '%35%' OR report_id IN (SELECT report_id FROM v_executions e JOIN v_tool_calls c USING (execution_id)
  WHERE error_text ILIKE '%35%' OR step_title ILIKE '%35%')""")
def f_parent_or_child(t):
    children = t("v_executions").select("execution_id", "report_id").join(t("v_tool_calls"), "execution_id")
    return filters.parent_or_child(t("v_reports"), children, "report_id", "title", ["error_text", "step_title"], "35").select("report_id")
