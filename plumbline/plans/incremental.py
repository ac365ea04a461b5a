"""Queries for streaming and incremental forms (ST)."""

from pyspark.sql import functions as F

from ..operators import cost
from ..session import shared_dir
from ..sources import snapshots
from ..streaming import eventtime, incremental
from ..streaming.runs import file_stream
from .checks import BREACH_SQL, byte_limits
from .registry import query
from .usage import PRICED, SPEND_SQL, WEIGHT_SQL

USE = """SELECT event_id AS step_id, 'db' || cast(event_id % 3 AS string) || '.' || event_type AS table_fqn, user_id % 4 AS source_id, event_id % 6 <> 0 AS success,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id, CASE event_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'analyst' WHEN 2 THEN 'viewer' WHEN 3 THEN 'trusted' ELSE 'guest' END AS role, ts AS used_at FROM {events}"""


@query("stream_usage_stats", f"""WITH u AS ({USE.format(events='events')}) SELECT source_id, table_fqn, count(*) AS usage, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures,
  cast(coalesce(sum(CAST({WEIGHT_SQL} AS DECIMAL(18,1))) FILTER (success), 0) AS DOUBLE) AS weighted_usage, count(*) FILTER (success AND role IN ('admin', 'trusted')) AS trusted_usage, count(user_id) FILTER (success) AS user_uses,
  strftime(max(used_at) FILTER (success), '%Y-%m-%d %H:%M:%S') AS last_used_at FROM u GROUP BY 1, 2""")
def stream_usage_stats(t):
    """Every event arrives twice; the stream counts it once."""
    events = t.spark.sql(USE, events=file_stream(t.spark, t.path("events")))
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out = incremental.stream_usage_stats(twice)
    return out.withColumn("last_used_at", F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss"))


QUOTA = "SELECT event_id, user_id, event_id % 2 AS connection_id, ts, cast(floor(value) AS bigint) AS bytes FROM {events}"


@query("stream_quota", BREACH_SQL)
def stream_quota(t):
    events = t.spark.sql(QUOTA, events=file_stream(t.spark, t.path("events")))
    _, breaches = incremental.stream_quota(events, byte_limits(t), ["user_id", "connection_id"], "bytes")
    return breaches.drop("month").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("stream_daily_cost", f"""WITH {PRICED.replace(SPEND_SQL, 'TRUE')} SELECT strftime(cast(created_at AS DATE), '%Y-%m-%d') AS day,
  cast(sum(input_cost + output_cost) AS DOUBLE) AS cost_usd, cast(sum(total_tokens) AS BIGINT) AS tokens FROM priced GROUP BY 1""")
def stream_daily_cost(t):
    from .virtual import VIEWS
    rows = t.spark.sql(VIEWS["v_usage_records"], lineitem=file_stream(t.spark, t.path("lineitem")))
    out = incremental.stream_daily_cost(cost.priced(rows, t("v_models")))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("incremental_index", """SELECT doc_id AS item_id, sha256(text) AS hash, length(text)::DOUBLE AS first_value FROM documents""")
def incremental_index(t):
    docs = file_stream(t.spark, t.path("documents")).select(F.col("doc_id").alias("item_id"), "text")
    out = incremental.incremental_index(docs, lambda c: F.array(F.length(c).cast("double")))
    return out.select("item_id", "hash", F.col("embedding")[0].alias("first_value"))


@query("scheduled_refresh", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def scheduled_refresh(t):
    """Two ticks over the same source: the second finds nothing new and keeps the data."""
    root = shared_dir(t.spark, "sched")
    build = lambda: t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    state = incremental.scheduled_refresh(t.spark, file_stream(t.spark, t.path("events")), root, "by_type", build)
    incremental.scheduled_refresh(t.spark, file_stream(t.spark, t.path("events")), root, "by_type", build, state)
    return snapshots.current(t.spark, root, "by_type")


# ---- bounded state: what the watermark, a delay behind the newest event, has passed --------------------

@query("stream_usage_windows", f"""WITH u AS ({USE.format(events='events')}), w AS (SELECT max(used_at) - INTERVAL 3 DAY AS mark FROM u)
  SELECT strftime(date_trunc('day', used_at), '%Y-%m-%d') AS day, source_id, table_fqn, count(*) AS usage, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures,
    cast(coalesce(sum(CAST({WEIGHT_SQL} AS DECIMAL(18,1))) FILTER (success), 0) AS DOUBLE) AS weighted_usage, count(*) FILTER (success AND role IN ('admin', 'trusted')) AS trusted_usage, count(user_id) FILTER (success) AS user_uses
  FROM u, w WHERE date_trunc('day', used_at) + INTERVAL 1 DAY <= mark GROUP BY 1, 2, 3""")
def stream_usage_windows(t):
    """Every event arrives twice; days that the watermark has closed, each step and table counted once."""
    events = t.spark.sql(USE, events=file_stream(t.spark, t.path("events")))
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out = eventtime.run_final(eventtime.usage_windows(twice, "3 days")).rows
    return out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start", "last_used_at")


@query("stream_cost_windows", f"""WITH {PRICED.replace(SPEND_SQL, 'TRUE')}, w AS (SELECT max(created_at) - INTERVAL 30 DAY AS mark FROM priced)
  SELECT strftime(cast(created_at AS DATE), '%Y-%m-%d') AS day, count(*) AS calls, cast(sum(input_cost + output_cost) AS DOUBLE) AS cost_usd, cast(sum(total_tokens) AS BIGINT) AS tokens
  FROM priced, w WHERE date_trunc('day', created_at) + INTERVAL 1 DAY <= mark GROUP BY 1""")
def stream_cost_windows(t):
    from .virtual import VIEWS
    rows = t.spark.sql(VIEWS["v_usage_records"], lineitem=file_stream(t.spark, t.path("lineitem")))
    out = eventtime.run_final(eventtime.cost_windows(cost.priced(rows, t("v_models")), "30 days")).rows
    return out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")


@query("stream_quota_timers", "SELECT * FROM (" + BREACH_SQL + ") AS found WHERE ts < (SELECT strftime(max(ts) - INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') FROM v_quota_events WHERE bytes > 0)")
def stream_quota_timers(t):
    """First breaches up to the watermark, by keyed state that a month's end clears."""
    events = t.spark.sql(QUOTA, events=file_stream(t.spark, t.path("events")))
    out = eventtime.run_final(eventtime.first_breaches(events, byte_limits(t), ["user_id", "connection_id"], "bytes", "2 days")).rows
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
