"""Queries for profiles and previews (PRF)."""

from pyspark.sql import functions as F

from ..operators import profile, sketches
from ..session import shared_dir
from .registry import query


def _num(c, expr=None, dtype="double"):
    e = expr or c
    return f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_, round(avg({e}), 4) AS mean,
  round(stddev_samp({e}), 4) AS std, min({e})::DOUBLE AS min, max({e})::DOUBLE AS max, NULL::BIGINT AS freq, round(quantile_cont({e}, 0.25), 4) AS q25, round(quantile_cont({e}, 0.5), 4) AS q50, round(quantile_cont({e}, 0.75), 4) AS q75 FROM src"""


def _txt(c, dtype="string", expr=None):
    return f"""SELECT '{c}', '{dtype}', count({c}), count(*) - count({c}), count(DISTINCT {expr or c}), NULL, NULL, NULL, NULL, (SELECT count(*) FROM src WHERE {c} IS NOT NULL GROUP BY {expr or c} ORDER BY 1 DESC LIMIT 1), NULL, NULL, NULL FROM src"""


SRC = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus, o_orderdate,
  o_orderkey % 3 = 0 AS flag FROM {orders}"""
_PROFILE = f"""WITH src AS ({SRC.format(orders='orders')}), p AS (""" + " UNION ALL ".join([
    _num("o_orderkey", "o_orderkey::DOUBLE", "bigint"), _num("price"), _txt("o_orderstatus"), _txt("flag", "boolean"),
    _num("o_orderdate", "epoch_us(o_orderdate) / 1e6::DOUBLE", "timestamp_ntz").replace("round(stddev_samp(epoch_us(o_orderdate) / 1e6::DOUBLE), 4)", "NULL")]) + ")"


def _src(t):
    df = t.sql(SRC)
    return df


@query("table_profile", _PROFILE + """ SELECT "column", dtype, non_null, nulls, distinct_ AS "distinct", mean, std, min, max, freq, q25, q50, q75 FROM p""")
def table_profile(t):
    out = profile.table_profile(_src(t)).drop("position")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("profile_modes", f"""WITH src AS ({SRC.format(orders='orders')}) SELECT 'o_orderstatus' AS "column", top, freq FROM (SELECT o_orderstatus AS top, count(*) AS freq FROM src GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
  UNION ALL SELECT 'flag', top, freq FROM (SELECT cast(flag AS VARCHAR) AS top, count(*) AS freq FROM src GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""")
def profile_modes(t):
    return profile.modes(_src(t).select("o_orderstatus", "flag"))


@query("profile_nested", """SELECT 'embedding' AS "column", count(*) AS non_null, count(DISTINCT embedding::VARCHAR) AS "distinct" FROM embeddings
  UNION ALL SELECT 'label', count(label), count(DISTINCT label) FROM embeddings UNION ALL SELECT 'vec_id', count(*), count(DISTINCT vec_id) FROM embeddings""")
def profile_nested(t):
    return profile.table_profile(t("embeddings")).select("column", "non_null", "distinct")


@query("dtype_counts", """SELECT CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE column_type END AS dtype, count(*) AS columns FROM (DESCRIBE lineitem) GROUP BY 1""")
def dtype_counts(t):
    return profile.dtype_counts(t("lineitem"))


@query("viz_profile", _PROFILE + """ SELECT "column", dtype, non_null, distinct_ AS "distinct", nulls, min, max, 'shown' AS variant FROM p
  UNION ALL SELECT "column", dtype, non_null, distinct_, nulls, NULL, NULL, 'hidden' FROM p""")
def viz_profile(t):
    shown = profile.viz_profile(_src(t), True).withColumn("variant", F.lit("shown"))
    return shown.unionByName(profile.viz_profile(_src(t), False).withColumn("variant", F.lit("hidden")))


@query("viz_head", """WITH h AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 20) SELECT 'o_orderkey' AS "column", string_agg(o_orderkey, '|' ORDER BY o_orderkey) AS sample, true AS shown FROM h
  UNION ALL SELECT 'o_orderstatus', string_agg(o_orderstatus, '|' ORDER BY o_orderkey), true FROM h UNION ALL SELECT 'o_orderkey', NULL, false UNION ALL SELECT 'o_orderstatus', NULL, false""")
def viz_head(t):
    df = t("orders").select("o_orderkey", "o_orderstatus")
    parts = [profile.viz_head(df, "o_orderkey", 20, show).withColumn("shown", F.lit(show)) for show in (True, False)]
    return parts[0].unionByName(parts[1]).withColumn("sample", F.array_join("sample", "|"))


@query("preview", """SELECT l_orderkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS q, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS l_shipdate,
  (SELECT count(*) FROM lineitem) AS total_rows, 5 AS total_columns, pos FROM (SELECT *, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS pos FROM lineitem) ORDER BY pos LIMIT 50""")
def preview(t):
    df = t("lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 3, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("q"),
                              "l_shipdate", "l_partkey", "l_linenumber")
    df = df.select("l_orderkey", "q", "l_shipdate", (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), F.lit(1).alias("x"))
    return profile.preview(df, "pos").drop("x").withColumn("total_columns", F.col("total_columns").cast("int"))


@query("render_payload", """WITH x AS (SELECT string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS b FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 10))
  SELECT 'nation' AS name, 'n_nationkey,n_name' || chr(10) || b AS payload, (SELECT count(*) FROM nation) AS n, true AS truncated FROM x
  UNION ALL SELECT cast(doc_id AS VARCHAR), left(text, 100), length(text), length(text) > 100 FROM documents""")
def render_payload(t):
    table = profile.render_table(t("nation").select("n_nationkey", "n_name"), "n_nationkey", 10)
    texts = profile.render_text(t("documents").select("doc_id", "text"), "text", 100)
    return table.select(F.lit("nation").alias("name"), "payload", F.col("row_count").alias("n"), "truncated").unionByName(
        texts.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("payload"), F.col("n_chars").cast("bigint").alias("n"), "truncated"))


@query("breakdown_check", """SELECT count(*) AS rows, count(DISTINCT m) AS distinct_x, 'o_orderpriority' AS unplotted, true AS needs_breakdown FROM
  (SELECT DISTINCT date_trunc('month', o_orderdate) AS m, o_orderpriority FROM orders)""")
def breakdown_check(t):
    tall = t("orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), "o_orderpriority").agg(F.sum("o_totalprice").alias("total"))
    return profile.breakdown_check(tall, "Month", ["total"])


_MERGED = ("o_orderkey", "price", "o_orderdate")


@query("profile_merged", _PROFILE + """ SELECT "column", dtype, non_null, nulls, mean, std, min, max, true AS distinct_within, CASE WHEN mean IS NOT NULL THEN true END AS quantiles_within FROM p""")
def profile_merged(t):
    """The profile of a table from the sketches of its parts; estimates are held against the table within their stated bounds."""
    df, root = _src(t), shared_dir(t.spark, "sketches")
    for status in ("F", "O", "P"):
        sketches.add_part(df.where(F.col("o_orderstatus") == status), root, status)
    out = sketches.merge(sketches.stored(t.spark, root))
    # exact distinct counts, and the ranks that the estimated quantiles have
    exact = profile.value_counts(df).groupBy("column").agg(F.count("*").alias("_distinct"))
    at = out.where("quantiles IS NOT NULL").select("column", F.explode("quantiles").alias("p", "v"))
    number = {"o_orderkey": F.col("o_orderkey").cast("double"), "price": F.col("price"), "o_orderdate": F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), number[c].alias("x")) for c in _MERGED]))).where("x IS NOT NULL")
    ranks = long.join(at, "column").groupBy("column", "p").agg((F.count_if(F.col("x") < F.col("v")) / F.count("*")).alias("below"), (F.count_if(F.col("x") <= F.col("v")) / F.count("*")).alias("upto"))
    fine = ranks.groupBy("column").agg(F.bool_and((F.col("below") <= F.col("p") + sketches.RANK_ERROR) & (F.col("upto") >= F.col("p") - sketches.RANK_ERROR)).alias("quantiles_within"))
    near = F.abs(F.col("distinct") - F.col("_distinct")) <= 4 * sketches.DISTINCT_ERROR * F.col("_distinct")
    out = out.join(exact, "column").join(fine, "column", "left").withColumns({"distinct_within": near, "mean": F.round("mean", 4), "std": F.round("std", 4)})
    return out.drop("distinct", "_distinct", "quantiles")


_WEEKS = {"before": ("2024-01-01", "2024-01-07"), "after": ("2024-01-08", "2024-01-14")}


@query("period_members", """WITH e AS (SELECT event_type, user_id, ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08' AS b, ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AS a FROM events),
  r AS (SELECT event_type, user_id FROM e GROUP BY 1, 2 HAVING bool_or(a) AND bool_or(b))
  SELECT event_type, count(DISTINCT user_id) FILTER (b) AS before_members, count(DISTINCT user_id) FILTER (a) AS after_members, count(*) FILTER (b) AS before_events, count(*) FILTER (a) AS after_events,
    (SELECT count(*) FROM r WHERE r.event_type = e.event_type) AS returning FROM e WHERE a OR b GROUP BY event_type""")
def period_members(t):
    """Users of two weeks, and those of both, from one sketch for each day."""
    days = sketches.member_sketches(t("events"), "user_id", F.date_format("ts", "yyyy-MM-dd"), ["event_type"])
    return sketches.period_members(days, _WEEKS, ["event_type"])
