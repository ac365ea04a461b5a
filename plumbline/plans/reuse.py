"""Queries for query entry, reuse and guard (QRY)."""

from pyspark.sql import functions as F

from ..operators import reuse
from ..session import shared_dir
from ..sources import snapshots
from .registry import query


@query("handle_sql", "SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def handle_sql(t):
    return reuse.handle_sql(t("orders").where("o_totalprice > 100000"), "SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top FROM data GROUP BY 1")


@query("handle_basics", "SELECT count(*) AS rows, 6 AS columns, true AS has_bytes, 10 AS head FROM orders")
def handle_basics(t):
    b = reuse.handle_basics(t("orders"))
    head = t("orders").limit(10).count()
    return t.spark.createDataFrame([(b["rows"], len(b["columns"]), b["bytes"] > 0, head)], "rows bigint, columns int, has_bytes boolean, head int")


@query("sql_readonly_flag", """SELECT query_id, NOT regexp_matches(sql_text, '(?i)\\b(INSERT|UPDATE|DELETE)\\b') AS read_only, NOT regexp_matches(sql_text, '(?i)\\b(INSERT\\s+INTO\\b|UPDATE\\s+\\w+\\s+SET\\b)') AS read_only_text,
  nullif(upper(regexp_extract(sql_text, '(?i)\\b(INSERT|UPDATE|DELETE)\\b', 1)), '') AS first_verb FROM v_query_log""")
def sql_readonly_flag(t):
    return reuse.readonly_flag(t("v_query_log")).select("query_id", "read_only", "read_only_text", "first_verb")


PLANS = """SELECT query_id, base_table, CASE query_id % 6
    WHEN 0 THEN NULL WHEN 1 THEN 'Relation, Statistics(sizeInBytes=8.0 EiB) PartitionFilters: []'
    WHEN 2 THEN 'Scan PartitionFilters: [isnotnull(dt), (dt = 1)] Statistics(sizeInBytes=' || cast(bytes AS string) || '.0 KiB)'
    WHEN 3 THEN 'a Statistics(sizeInBytes=1.5 GiB) b Statistics(sizeInBytes=3.0 TiB) c PartitionFilters: [x]'
    WHEN 4 THEN 'Statistics(sizeInBytes=2.0 MiB), PartitionFilters: [ ]' ELSE 'no sizes here' END AS plan FROM {v_query_log}"""


@query("scan_guard", f"""WITH p AS ({PLANS.format(v_query_log='v_query_log')}), j AS (SELECT p.*, s.is_partitioned, query_id % 6 AS k, b.bytes FROM p JOIN v_query_log b USING (query_id)
    LEFT JOIN (SELECT 'orders_' || cast(r_regionkey AS VARCHAR) AS base_table, r_regionkey % 2 = 0 AS is_partitioned FROM region) s ON s.base_table = p.base_table),
  z AS (SELECT *, CASE k WHEN 2 THEN bytes * 1024 WHEN 3 THEN 3 * 1024::BIGINT * 1024 * 1024 * 1024 WHEN 4 THEN 2097152 END AS scan_bytes FROM j)
  SELECT query_id, scan_bytes, CASE WHEN k IN (1, 4) AND coalesce(is_partitioned, false) THEN 'no_partition_filter' WHEN scan_bytes > 1000000000 THEN 'too_large' ELSE 'ok' END AS verdict FROM z""")
def scan_guard(t):
    tables = t("region").select(F.concat(F.lit("orders_"), F.col("r_regionkey").cast("string")).alias("base_table"), (F.col("r_regionkey") % 2 == 0).alias("is_partitioned"))
    return reuse.scan_guard(t.sql(PLANS), tables, 1_000_000_000).select("query_id", F.col("scan_bytes").cast("bigint").alias("scan_bytes"), "verdict")


@query("scan_subsume_run", """SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY 1""")
def scan_subsume_run(t):
    """The unchanged SQL of a narrower query, answered from a saved full scan."""
    snap = snapshots.snapshot_write(t("orders").select("o_orderstatus", "o_totalprice"), shared_dir(t.spark, "scan"))
    sql = "SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY 1"
    return reuse.answer_from_snapshot(t.spark, sql, "orders", snap, complete=False)


@query("query_log", """SELECT CASE WHEN cache_hit THEN 'hit' ELSE 'miss' END AS cache, CASE WHEN error_text IS NULL THEN 'none' ELSE split_part(error_text, ' ', 1) END AS error_type, count(*) AS calls,
  cast(sum(cost_ms) AS BIGINT) AS ms, max(cost_ms) AS max_ms, cast(sum(n_rows) AS BIGINT) AS rows, cast(sum(bytes) AS BIGINT) AS bytes FROM v_query_log GROUP BY 1, 2""")
def query_log(t):
    return reuse.log_summary(t("v_query_log"))


@query("query_log_rows", """SELECT query_id, cost_ms AS ms, n_rows AS rows, bytes, sql_text AS sql, CASE WHEN cache_hit THEN 'hit' ELSE 'miss' END AS cache, error_text AS error FROM v_query_log""")
def query_log_rows(t):
    return reuse.log_rows(t("v_query_log"))


@query("saved_resolve", """WITH g AS (SELECT * FROM v_saved WHERE is_default AND status = 'success'), c AS (
   SELECT ref_id, ref, saved_id, 1 AS rk, created_at FROM v_saved_refs JOIN g ON cast(saved_id AS VARCHAR) = ref
   UNION ALL SELECT ref_id, ref, saved_id, 2, created_at FROM v_saved_refs JOIN g ON lower(slug) = lower(ref)
   UNION ALL SELECT ref_id, ref, saved_id, 3, created_at FROM v_saved_refs JOIN g ON lower(title) = lower(ref))
  SELECT r.ref_id, r.ref, x.saved_id FROM v_saved_refs r LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY rk, created_at DESC, saved_id DESC) = 1) x ON x.ref_id = r.ref_id""")
def saved_resolve(t):
    return reuse.saved_resolve(t("v_saved_refs"), t("v_saved"))


@query("published_resolve", """WITH e AS (SELECT doc_id, source || '-' || lang AS slug, text FROM documents WHERE lang <> 'fr'), r AS (SELECT unnest(['4', 'SRC7-en', 'then', 'nothing at all here']) AS ref),
  m AS (SELECT ref, doc_id, CASE WHEN cast(doc_id AS VARCHAR) = ref THEN 1 WHEN lower(slug) = lower(ref) THEN 2 WHEN lower('T ' || slug) = lower(ref) THEN 3
    WHEN contains(lower('T ' || slug), lower(ref)) OR contains(lower(slug), lower(ref)) OR contains(lower(text), lower(ref)) THEN 4 END AS rk FROM r, e)
  SELECT ref, arg_min(doc_id, (rk, doc_id)) AS entity_id FROM m WHERE rk IS NOT NULL GROUP BY 1""")
def published_resolve(t):
    slug = F.concat_ws("-", "source", "lang")
    entities = t("documents").select(F.col("doc_id").alias("entity_id"), slug.alias("slug"), F.concat(F.lit("T "), slug).alias("title"), F.col("text").alias("description"),
                                     F.when(F.col("lang") == "fr", "draft").otherwise("published").alias("status"))
    return reuse.resolve_published(entities, ["4", "SRC7-en", "then", "nothing at all here"])


@query("dataset_refresh", "SELECT o_orderstatus, count(*) AS n, true AS kept, '2024-01-03' AS stamped FROM orders GROUP BY 1")
def dataset_refresh(t):
    """A good refresh, then a failing one: data of the first, stamp of the second."""
    root = shared_dir(t.spark, "refresh")
    at = lambda d: F.lit(f"2024-01-0{d} 00:00:00")
    good = snapshots.refresh(t.spark, root, "by_status", lambda: t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), at(2))
    bad = snapshots.refresh(t.spark, root, "by_status", lambda: t("orders").select("no_such_column"), at(3))
    stamp = snapshots.last_attempt(t.spark, root, "by_status").select(F.date_format("refreshed_at", "yyyy-MM-dd")).scalar()
    return snapshots.current(t.spark, root, "by_status").withColumns({"kept": F.lit(good and not bad), "stamped": stamp})


@query("code_refs", """SELECT step_id, 'step' AS kind, 0 AS position, title AS ref FROM v_steps UNION ALL SELECT step_id, 'entity', 0, 'E' || cast(query_id AS VARCHAR) FROM v_steps""")
def code_refs(t):
    return reuse.code_refs(t("v_steps"))
