"""Queries for chart data (CHT)."""

from pyspark.sql import functions as F

from ..operators import charts
from .registry import query


@query("c_pie", """SELECT coalesce(txt, '') AS name, round(avg(coalesce(num, 0)), 6) AS value, min(event_id) AS first_pos FROM v_mixed WHERE txt IS NOT NULL GROUP BY 1""")
def c_pie(t):
    return charts.pie(t("v_mixed"), "TXT", "num", "event_id", "avg").withColumn("value", F.round("value", 6))


@query("c_pie_raw", """SELECT txt AS name, v AS value, event_id AS first_pos FROM (SELECT *, CASE WHEN txt IS NULL OR trim(txt) = '' THEN 0 ELSE try_cast(trim(txt) AS DOUBLE) END AS v FROM v_mixed) WHERE txt IS NOT NULL AND v IS NOT NULL""")
def c_pie_raw(t):
    return charts.pie(t("v_mixed"), "txt", "txt", "event_id")


def _cell(g, agg):
    return f"""{agg} FILTER (txt = '{g}') AS "{g}" """


@query("c_cartesian_group", """SELECT coalesce(cast(whole % 10 AS VARCHAR), '') AS category, min(event_id) AS first_pos, round(sum(coalesce(num, 0)) FILTER (event_type = 'click'), 4) AS click,
  round(sum(coalesce(num, 0)) FILTER (event_type = 'error'), 4) AS error, arg_min(coalesce(num, 0), event_id) FILTER (event_type = 'purchase') AS purchase, cast(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS signup,
  round(sum(coalesce(num, 0)) FILTER (event_type = 'view'), 4) AS view FROM (SELECT * FROM v_mixed) JOIN (SELECT event_id, event_type FROM events) USING (event_id) GROUP BY 1""")
def c_cartesian_group(t):
    df = t("v_mixed").join(t("events").select("event_id", "event_type"), "event_id").withColumn("x", F.col("whole") % 10)
    fn = {"purchase": None, "signup": "count"}
    out = charts.matrix(df, "X", "EVENT_TYPE", "num", "event_id", lambda g, i: fn.get(g, "sum"))
    return out.withColumns({c: F.round(c, 4) for c in ("click", "error", "view")})


@query("c_cartesian_multi", """SELECT o_orderpriority AS category, min(o_orderkey) AS first_pos, round(sum(o_totalprice), 2) AS o_totalprice, cast(count(*) AS DOUBLE) AS o_custkey,
  arg_min(o_orderkey, o_orderkey)::DOUBLE AS o_orderkey FROM orders GROUP BY 1""")
def c_cartesian_multi(t):
    df = t("orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    out = charts.multi(df, "o_orderpriority", [("o_totalprice", "sum"), ("o_custkey", "count"), ("o_orderkey", None)], "o_orderkey")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("c_scatter", """SELECT coalesce(whole, 0)::DOUBLE AS x, round(max(coalesce(num, 0)), 4) AS y, 'max' AS variant FROM v_mixed GROUP BY 1
  UNION ALL SELECT coalesce(whole, 0)::DOUBLE, coalesce(num, 0), 'raw' FROM v_mixed""")
def c_scatter(t):
    df = t("v_mixed")
    agg = charts.scatter(df, "whole", "num", "event_id", "max").withColumns({"y": F.round("y", 4), "variant": F.lit("max")})
    return agg.unionByName(charts.scatter(df, "whole", "num", "event_id").withColumn("variant", F.lit("raw")))


@query("c_heatmap", """WITH c AS (SELECT txt AS x, cast(whole AS VARCHAR) AS y, round(avg(coalesce(num, 0)), 10) AS value FROM v_mixed WHERE txt <> '' AND whole IS NOT NULL GROUP BY 1, 2)
  SELECT *, (SELECT max(value) FROM c) AS max_value FROM c""")
def c_heatmap(t):
    out = charts.heatmap(t("v_mixed"), "txt", "whole", "num", "event_id", "avg")
    return out.withColumns({"value": F.round("value", 10), "max_value": F.round("max_value", 10)})


@query("c_candlestick", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS time, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close, min(value) AS low, max(value) AS high FROM events GROUP BY 1""")
def c_candlestick(t):
    daily = charts.ohlc_bucket(t("events"), "ts", "value", "event_id")
    return charts.candlestick(daily).withColumn("time", F.date_format("time", "yyyy-MM-dd"))


TREE = """SELECT 'r' || cast(r_regionkey AS string) AS id, cast(NULL AS string) AS parentid, r_name AS name, 0.0E0 AS value FROM {region}
UNION ALL SELECT 'n' || cast(n_nationkey AS string), CASE WHEN n_nationkey % 9 = 0 THEN 'gone' ELSE 'r' || cast(n_regionkey AS string) END, n_name, 1.0E0 FROM {nation}
UNION ALL SELECT 'c' || cast(c_custkey AS string), 'n' || cast(c_nationkey AS string), c_name, cast(round(c_acctbal) AS double) FROM {customer}"""


@query("c_treemap", f"""WITH RECURSIVE t AS ({TREE.replace('{', '').replace('}', '')}), l AS (SELECT t.id, p.id AS parent_id, t.name, t.value FROM t LEFT JOIN t p ON p.id = t.parentid),
  up AS (SELECT id AS node, id AS anc FROM l UNION ALL SELECT up.node, l.parent_id FROM up JOIN l ON l.id = up.anc WHERE l.parent_id IS NOT NULL),
  s AS (SELECT anc, sum(value) AS total FROM up JOIN l ON l.id = up.node GROUP BY 1), k AS (SELECT parent_id, count(*) AS children FROM l GROUP BY 1)
  SELECT l.id, l.parent_id, l.name, l.value, coalesce(k.children, 0) AS children, s.total FROM l JOIN s ON s.anc = l.id LEFT JOIN k ON k.parent_id = l.id""")
def c_treemap(t):
    return charts.treemap_totals(charts.treemap(t.sql(TREE), "id", "parentId", "name", "value"))


@query("c_view_treemap", like="c_treemap")
def c_view_treemap(t):
    """The hierarchy as a view built from its data model, names in any case."""
    tree = t.sql(TREE)
    view = charts.build_view({"type": "treemap", "series": [{"id": "ID", "parentId": "PARENTID", "key": "Name", "value": "VALUE"}]}, "Tree", tree.columns)
    return charts.run_view(tree, view, "id")


@query("c_radar", """WITH f AS (SELECT * FROM part ORDER BY p_partkey LIMIT 1), b AS (SELECT * FROM part WHERE p_brand = 'Brand#7' ORDER BY p_partkey LIMIT 1)
  SELECT 'Brand#7' AS name, 'P_SIZE' AS dimension, p_size::DOUBLE AS value FROM b UNION ALL SELECT 'Brand#7', 'P_RETAILPRICE', p_retailprice FROM b UNION ALL SELECT 'Brand#7', 'P_TYPE', 0 FROM b
  UNION ALL SELECT 'absent', 'P_SIZE', p_size FROM f UNION ALL SELECT 'absent', 'P_RETAILPRICE', p_retailprice FROM f UNION ALL SELECT 'absent', 'P_TYPE', 0 FROM f""")
def c_radar(t):
    return charts.radar(t("part"), [{"name": "Brand#7", "key": "p_brand"}, {"name": "absent", "key": "p_brand"}], ["p_size", "p_retailprice", "p_type"], "p_partkey")


@query("c_metric_card", """SELECT 'sum' AS fn, round(sum(coalesce(num, 0)), 2) AS value FROM v_mixed UNION ALL SELECT 'avg', round(avg(coalesce(num, 0)), 2) FROM v_mixed
  UNION ALL SELECT 'count', count(txt) FILTER (txt <> '') FROM v_mixed UNION ALL SELECT 'first', round(arg_min(num, event_id) FILTER (event_id > 0), 2) FROM v_mixed""")
def c_metric_card(t):
    df = t("v_mixed")
    money = df.withColumn("num", F.col("num").cast("decimal(18,2)"))
    cards = {"sum": charts.metric_card(money, "NUM", "event_id", "sum"), "avg": charts.metric_card(money, "num", "event_id", "avg"),
             "count": charts.metric_card(df, "txt", "event_id", "count"), "first": charts.metric_card(df.where("event_id > 0"), "num", "event_id")}
    out = None
    for fn, card in cards.items():
        row = card.select(F.lit(fn).alias("fn"), F.round("value", 2).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


@query("c_sparkline", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, o_totalprice AS value, o_orderkey AS tie FROM orders")
def c_sparkline(t):
    return charts.sparkline(t("orders"), "o_orderdate", "o_totalprice", "o_orderkey").withColumn("x", F.date_format("x", "yyyy-MM-dd"))


@query("c_infer_series", """SELECT event_type AS name, round(sum(value), 2) AS value, min(event_id) AS first_pos FROM events GROUP BY 1""")
def c_infer_series(t):
    """No encoding given: the text column and the column called value are picked."""
    df = t("events").select("event_id", "event_type", "user_id", F.col("value").cast("decimal(18,2)").alias("value"))
    s = charts.infer_series(df, "bar_chart")[0]
    return charts.pie(df, s["key"], s["value"], "event_id", "sum").withColumn("value", F.round("value", 2))


@query("c_view_build", """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS category, min(o_orderkey) AS first_pos, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F",
  round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O", round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P" FROM orders WHERE o_totalprice > 50000 GROUP BY 1""")
def c_view_build(t):
    df = t("orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    model = {"type": "bar_chart", "series": [{"name": "Total", "key": "Month", "value": "TOTAL", "aggregation": "sum"}], "group_by": ["o_orderstatus", "x"],
             "filters": [{"conditions": [{"column": "total", "operator": "greater_than", "value": 50000}]}]}
    out = charts.run_view(df, charts.build_view(model, "Totals", df.columns), "o_orderkey", model)
    return out.withColumns({c: F.round(c, 2) for c in ("F", "O", "P")})


_TRIM = lambda e: f"regexp_replace(regexp_replace({e}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_N2 = _TRIM("format('{:,.2f}', abs(v))")


@query("c_format", f"""WITH s AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE (value - 50) * (CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 100000 ELSE 1 END) END AS raw FROM events), x AS (SELECT event_id, round(raw, 2) AS v FROM s)
  SELECT event_id, coalesce(CASE WHEN v < 0 AND v <> 0 THEN '-' ELSE '' END || {_N2}, '—') AS plain, coalesce(CASE WHEN v < 0 THEN '-$' ELSE '$' END || {_N2}, '—') AS currency FROM x""")
def c_format(t):
    k = F.col("event_id") % 4
    raw = F.when(F.col("event_id") % 10 != 0, (F.col("value") - 50) * F.when(k == 1, 1000).when(k == 2, 100000).otherwise(1))
    v = F.round(raw, 2)
    return t("events").select("event_id", charts.format_value(v).alias("plain"), charts.format_value(v, "currency").alias("currency"))


@query("c_format_compact", """SELECT l_partkey, l_linenumber, v, CASE WHEN v >= 1000000 THEN cast(cast(v / 1000000 AS BIGINT) AS VARCHAR) || 'M' WHEN v >= 1000 THEN cast(cast(v / 1000 AS BIGINT) AS VARCHAR) || 'K' ELSE cast(v AS VARCHAR) END AS compact,
  CASE WHEN v >= 1000000 THEN cast(cast(v / 1000000 AS BIGINT) AS VARCHAR) || '.0M' WHEN v >= 1000 THEN cast(cast(v / 1000 AS BIGINT) AS VARCHAR) || '.0K' ELSE cast(v AS VARCHAR) END AS short,
  cast(v % 1000 AS VARCHAR) || '%' AS percent FROM (SELECT DISTINCT l_partkey, l_linenumber, (l_partkey % 999 + 1) * CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS v FROM lineitem)""")
def c_format_compact(t):
    k = F.col("l_linenumber") % 3
    v = (F.col("l_partkey") % 999 + 1) * F.when(k == 0, 1).when(k == 1, 1000).otherwise(1000000)
    rows = t("lineitem").select("l_partkey", "l_linenumber", v.alias("v")).distinct()
    d = F.col("v").cast("double")
    return rows.select("l_partkey", "l_linenumber", "v", charts.format_value(d, "compact").alias("compact"), charts.format_short(d).alias("short"),
                       charts.format_value(d % 1000, "percent").alias("percent"))


@query("c_map", """SELECT r_name AS name, round(sum(c_acctbal), 2) AS value, min(c_custkey) AS first_pos FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def c_map(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    return charts.region_map(rows, "r_name", "c_acctbal", "c_custkey").withColumn("value", F.round("value", 2))
