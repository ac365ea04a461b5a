"""Queries for catalogs, merges, selection and retention (SET, WIN-03, WIN-04)."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import catalog, counters
from .registry import query

_SIG = "sha256(string_agg(col_name || ':' || dtype, ',' ORDER BY col_name, dtype))"


@query("schema_signature", f"SELECT table_name, {_SIG} AS signature, count(*) AS n_columns FROM v_columns_old GROUP BY 1")
def schema_signature(t):
    return catalog.schema_signature(t("v_columns_old"))


@query("schema_drift", f"""WITH o AS (SELECT table_name, {_SIG} AS s FROM v_columns_old GROUP BY 1), n AS (SELECT table_name, {_SIG} AS s FROM v_columns_new GROUP BY 1)
  SELECT * FROM (SELECT table_name, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'changed' END AS change
  FROM o FULL JOIN n USING (table_name)) WHERE change IS NOT NULL""")
def schema_drift(t):
    return catalog.schema_drift(t("v_columns_old"), t("v_columns_new"))


EXISTING = """SELECT p_partkey AS row_id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey END AS link_id, 'tab_' || cast(p_partkey % 700 AS string) AS name,
  p_partkey % 3 = 0 AS is_active, 'old' AS signature FROM {part} WHERE p_size <> 2"""
INCOMING = """SELECT p_partkey AS table_id, 'tab_' || cast(p_partkey % 700 AS string) AS name, 'new' AS signature FROM {part} WHERE p_size <> 7 AND p_brand <> 'Brand#3'"""


@query("catalog_sync", f"""WITH e AS ({EXISTING.format(part='part')}), i AS ({INCOMING.format(part='part')}),
  pool AS (SELECT name, min(row_id) AS first_id, bool_or(is_active) AS any_active FROM e WHERE link_id IS NULL GROUP BY 1),
  b AS (SELECT coalesce(i.name, l.name) AS name, l.row_id, coalesce(l.link_id, i.table_id) AS link_id, l.is_active, l.signature, i.name AS in_name, i.signature AS in_sig
        FROM (SELECT * FROM e WHERE link_id IS NOT NULL) l FULL JOIN i ON l.link_id = i.table_id),
  r AS (SELECT b.*, p.first_id, p.any_active FROM b LEFT JOIN pool p USING (name))
  SELECT coalesce(row_id, first_id) AS row_id, link_id, name, CASE WHEN row_id IS NOT NULL AND in_name IS NOT NULL THEN is_active OR coalesce(any_active, false)
      WHEN row_id IS NOT NULL THEN false WHEN first_id IS NOT NULL THEN any_active ELSE true END AS is_active, coalesce(in_sig, signature) AS signature,
    CASE WHEN row_id IS NOT NULL AND in_name IS NOT NULL THEN 'refreshed' WHEN row_id IS NOT NULL THEN 'missing' WHEN first_id IS NOT NULL THEN 'adopted' ELSE 'inserted' END AS action FROM r
  UNION ALL SELECT row_id, link_id, name, is_active, signature, 'kept' FROM e WHERE link_id IS NULL AND name NOT IN (SELECT name FROM r)""")
def catalog_sync(t):
    return catalog.catalog_sync(t.sql(EXISTING), t.sql(INCOMING), activate_new=True)


RES_OLD = "SELECT 'res_' || cast(s_suppkey AS string) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'dbt_model' ELSE 'markdown' END AS type, s_nationkey % 3 AS org_id, 'v1' AS content, s_suppkey % 4 <> 0 AS is_active, 'day1' AS synced_at FROM {supplier} WHERE s_suppkey % 5 <> 0"
RES_NEW = "SELECT CASE WHEN s_suppkey = 7 THEN '' ELSE 'res_' || cast(s_suppkey AS string) END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'dbt_model' ELSE 'markdown' END AS type, s_nationkey % 3 AS org_id, 'v2' AS content FROM {supplier} WHERE s_suppkey % 3 <> 0"


@query("resource_upsert", f"""WITH o AS ({RES_OLD.format(supplier='supplier')}), n AS (SELECT *, true AS hit FROM ({RES_NEW.format(supplier='supplier')}) WHERE name <> '')
  SELECT name, type, org_id, CASE WHEN hit THEN n.content ELSE o.content END AS content, coalesce(is_active, false) AS is_active, CASE WHEN hit THEN 'day2' ELSE synced_at END AS synced_at
  FROM o FULL JOIN n USING (name, type, org_id)""")
def resource_upsert(t):
    return catalog.resource_upsert(t.sql(RES_OLD), t.sql(RES_NEW), F.lit("day2"), activate_new=False)


@query("event_dedupe", """SELECT step_id, table_fqn, source_id, success, user_id, role, strftime(used_at, '%Y-%m-%d') AS used_at FROM v_table_usage
  QUALIFY row_number() OVER (PARTITION BY step_id, table_fqn ORDER BY v_table_usage.used_at, NOT success, source_id, user_id NULLS FIRST, role) = 1""")
def event_dedupe(t):
    return counters.one_event_per_step(t("v_table_usage")).withColumn("used_at", F.date_format("used_at", "yyyy-MM-dd"))


@query("ds_overlap", """SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'ring'])""")
def ds_overlap(t):
    items = t("part").withColumn("sources", F.split("p_name", " "))
    return catalog.ds_overlap(items, "sources", ["red", "ring"]).select("p_partkey")


@query("stratified_pick", """WITH c AS (SELECT *, split_part(table_name, '.', 1) AS schema_name FROM v_catalog),
  a AS (SELECT schema_name, greatest(1, cast(round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM c) * 40) AS INTEGER)) AS allocation FROM c GROUP BY 1),
  r AS (SELECT c.*, row_number() OVER (PARTITION BY schema_name ORDER BY n_columns DESC, table_name) AS rk FROM c)
  SELECT table_id, schema_name, rk AS rank_in_schema FROM r JOIN a USING (schema_name) WHERE rk <= allocation ORDER BY n_columns DESC, table_name LIMIT 40""")
def stratified_pick(t):
    return catalog.stratified_pick(t("v_catalog"), 40).select("table_id", "schema_name", F.col("rank_in_schema").cast("bigint").alias("rank_in_schema"))


STEPS = """SELECT step_id, CASE WHEN step_id % 17 = 0 THEN NULL ELSE query_id END AS query_id, org_id, status, created_at, created_at AS updated_at, parent_shared AS shared,
  CASE WHEN step_id % 19 = 0 THEN 'published' ELSE 'draft' END AS parent_status, CASE WHEN step_id % 23 = 0 THEN NULL ELSE payload END AS payload FROM {v_steps}"""


@query("retention_rank", f"""WITH s AS ({STEPS.format(v_steps='v_steps')}), n AS (SELECT query_id, max_by(step_id, (updated_at, step_id)) AS step_id FROM s WHERE status = 'success' AND query_id IS NOT NULL GROUP BY 1),
  x AS (SELECT s.*, status = 'success' AND NOT shared AND parent_status <> 'published' AND payload IS NOT NULL AND ((query_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.step_id = s.step_id))
    OR created_at < TIMESTAMP '2001-01-01' - to_days(CASE org_id WHEN 0 THEN 30 WHEN 1 THEN 900 ELSE 365 END)) AS purged FROM s)
  SELECT step_id, purged, CASE WHEN purged THEN NULL ELSE payload END AS payload FROM x""")
def retention_rank(t):
    cutoffs = t("region").where("r_regionkey < 2").select(F.col("r_regionkey").cast("bigint").alias("org_id"), F.when(F.col("r_regionkey") == 0, 30).otherwise(900).alias("retention_days"))
    return catalog.retention_purge(t.sql(STEPS), cutoffs, 365, dt.datetime(2001, 1, 1), ["payload"]).select("step_id", "purged", "payload")
