"""Queries for relevance and vector search (RNK)."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity, vectorcodes
from ..operators import counters, ranking
from ..session import spread_small
from .registry import query
from .texts import jac, kw, tok

NOW = dt.datetime(1998, 6, 1)
LIVE_NOW = dt.datetime(2024, 2, 1)
TABLES = """SELECT DISTINCT 'db' || cast(p_size % 3 AS string) || '.' || p_brand AS table_fqn, cast(substr(p_brand, 7) AS int) % 5 AS source_id,
  cast(substr(p_brand, 7) AS int) / 10.0E0 AS centrality, (p_size % 3) / 2.0E0 AS richness, p_size % 3 = 1 AS entity_like FROM {part}"""
_W = "CASE role WHEN 'admin' THEN 1.5 WHEN 'analyst' THEN 1.2 WHEN 'viewer' THEN 0.8 WHEN 'trusted' THEN 1.5 ELSE 1.0 END"
_AGE = "greatest(epoch_us(TIMESTAMP '{now}') - epoch_us({col}), 0) / 86400e6"


def _rec(col, now="1998-06-01"):
    return f"pow(2.718281828::DOUBLE, -{_AGE.format(now=now, col=col)} / 14)"


@query("table_score", f"""WITH tb AS ({TABLES.format(part='part')}), u AS (SELECT source_id, table_fqn, count(*) AS usage, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS bad,
    coalesce(sum(CAST({_W} AS DECIMAL(18,1))) FILTER (success), 0)::DOUBLE AS w, max(used_at) FILTER (success) AS lu FROM v_table_usage WHERE used_at <= TIMESTAMP '1998-06-01' GROUP BY 1, 2),
  f AS (SELECT source_id, table_fqn, coalesce(sum(CAST({_W} AS DECIMAL(18,1))) FILTER (direction > 0), 0)::DOUBLE AS wp, coalesce(sum(CAST({_W} AS DECIMAL(18,1))) FILTER (direction < 0), 0)::DOUBLE AS wn FROM v_table_feedback GROUP BY 1, 2)
  SELECT table_fqn, source_id, round(CASE WHEN usage > 0 THEN ok / greatest(1, usage) ELSE 0 END, 4) AS success_rate, round(CASE WHEN usage IS NULL THEN 0.1 * (centrality + richness + CASE WHEN entity_like THEN 0.5 ELSE 0 END)
    ELSE 0.35 * (sqrt(w) * coalesce({_rec('lu')}, pow(2.718281828::DOUBLE, -365.0 / 14))) + 0.25 * (ok / greatest(1, usage)) + 0.2 * (coalesce(wp, 0) - coalesce(wn, 0))
      + 0.2 * (centrality + richness + CASE WHEN entity_like THEN 0.5 ELSE 0 END) - 0.2 * sqrt(bad) END, 6) AS score
  FROM tb LEFT JOIN u USING (source_id, table_fqn) LEFT JOIN f USING (source_id, table_fqn)""")
def table_score(t):
    on = ["source_id", "table_fqn"]
    used = counters.usage_stats(t("v_table_usage").where("used_at <= '1998-06-01'")).join(counters.feedback_stats(t("v_table_feedback")), on, "left")
    out = ranking.table_score(t.sql(TABLES), used, NOW, on)
    return out.select("table_fqn", "source_id", F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"), "score")


STEP_COLS = """SELECT step_id, array('c' || cast(step_id % 7 AS string), 'c' || cast(step_id % 5 AS string), 'k') AS columns, 'Bad  column' || cast(step_id AS string) || chr(10) || 'line' AS error_text FROM {v_steps} WHERE status = '@'"""
_U = """u AS (SELECT step_id, max(used_at) AS lu, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS bad, count(*) AS n FROM v_table_usage WHERE used_at >= TIMESTAMP '1997-06-01' AND used_at <= TIMESTAMP '1998-06-01' {extra} GROUP BY 1),
  c AS (SELECT u.*, ['c' || (step_id % 7), 'c' || (step_id % 5), 'k'] AS cols, payload FROM u JOIN v_steps USING (step_id) WHERE status = '{status}'),
  f AS (SELECT event_id % 15000 AS step_id, count(*) FILTER (event_id % 2 = 0) AS pos, count(*) FILTER (event_id % 2 = 1) AS neg FROM events GROUP BY 1),
  x AS (SELECT c.*, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, CASE WHEN payload > 100000 THEN (step_id % 10) / 10 END AS sem FROM c LEFT JOIN f USING (step_id))"""
TARGET = ["c1", "c2", "k"]
_COL = jac("['c1', 'c2', 'k']", "list_distinct(cols)")


def _snippet_inputs(t, status, usage=None):
    used = (usage or t("v_table_usage")).where("used_at >= '1997-06-01' AND used_at <= '1998-06-01'")
    per = counters.snippet_usage(used)
    steps = t.sql(STEP_COLS.replace("@", status))
    fb = t("events").select((F.col("event_id") % 15000).alias("step_id"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("direction"))
    sem = t("v_steps").where("payload > 100000").select("step_id", ((F.col("step_id") % 10) / 10).alias("semantic"))
    return per, steps, fb, sem


@query("snippet_success", f"""WITH {_U.format(extra='', status='success')} SELECT step_id, round(coalesce(0.35 * sem + 0.2 * {_COL}, 0.55 * {_COL}) + 0.2 * ok / n + 0.2 * (pos - neg) + 0.05 * {_rec('lu')}, 6) AS score,
  round({_COL}, 6) AS column_similarity, pos AS positive, neg AS negative, round(ok / n, 4) AS success_rate FROM x""")
def snippet_success(t):
    per, steps, fb, sem = _snippet_inputs(t, "success")
    return ranking.snippet_success(per, steps.drop("error_text"), fb, TARGET, NOW, sem)


@query("snippet_failed", f"""WITH {_U.format(extra='', status='error')} SELECT step_id, round(coalesce(0.35 * sem + 0.25 * {_COL}, 0.6 * {_COL}) + 0.2 * {_rec('lu')} + 0.2 * (0.5 * neg + 0.5 * round(bad / n, 4)) - 0.05 * greatest(0, pos - neg), 6) AS score,
  'Bad column' || step_id || ' line' AS error_summary, round(bad / n, 4) AS failure_rate FROM x""")
def snippet_failed(t):
    per, steps, fb, sem = _snippet_inputs(t, "error")
    return ranking.snippet_failed(per, steps, fb, TARGET, NOW, sem)


@query("snippet_by_table", f"""WITH {_U.format(extra="AND (lower(table_fqn) = 'db1.brand#3' OR lower(table_fqn) LIKE '%.brand#9')", status='success')}
  SELECT step_id, round(0.55 * ok / n + 0.35 * {_rec('lu')} + 0.1 * (pos - neg), 6) AS score, round(ok / n, 4) AS success_rate FROM x""")
def snippet_by_table(t):
    from ..operators.joins import suffix_match
    wanted = t.spark.createDataFrame([("DB1.Brand#3",), ("brand#9",)], "wanted string")
    hit = suffix_match(wanted, t("v_table_usage"), "wanted", "table_fqn")
    per, steps, fb, _ = _snippet_inputs(t, "success", hit)
    return ranking.snippet_by_table(per, steps.select("step_id"), fb, NOW)


@query("cosine_topk", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT label, i, avg(v[i]) AS x FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2),
  q AS (SELECT label, list(x ORDER BY i) AS qv FROM d GROUP BY 1), s AS (SELECT cast(q.label AS VARCHAR) AS query, vec_id, greatest(0, list_cosine_similarity(v, qv)) AS score FROM e, q)
  SELECT query, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) <= 10""")
def cosine_topk(t):
    """The ten vectors nearest to the centroid of each label."""
    dims = t("embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centroids = dims.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))  # as long as a vector
    queries = centroids.select(F.col("label").cast("string").alias("query"), F.transform("c", lambda p: p["x"]).alias("vector"))
    return similarity.cosine_topk(t("embeddings"), "vec_id", "embedding", queries, 10).select("query", "vec_id", F.round("score", 6).alias("score"))


@query("cosine_topk_filtered", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id, greatest(0, list_cosine_similarity(e.v, q.v)) AS score
  FROM e JOIN e q ON q.vec_id % 50 = 0 WHERE e.vec_id IN (SELECT vec_id FROM embeddings WHERE label = 3))
  SELECT query, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) <= 5""")
def cosine_topk_filtered(t):
    """Vectors of one kind nearest to every fiftieth vector."""
    queries = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    out = similarity.cosine_topk(t("embeddings"), "vec_id", "embedding", queries, 5, where={"label": 3})
    return out.select("query", "vec_id", F.round("score", 6).alias("score"))


@query("cosine_topk_codes", like="cosine_topk_filtered")
def cosine_topk_codes(t):
    """The same rows by codes: what the codes leave open is scored."""
    queries = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    out = vectorcodes.cosine_topk(t("embeddings"), "vec_id", "embedding", queries, 5, where={"label": 3})
    return out.select("query", "vec_id", F.round("score", 6).alias("score"))


@query("blend", f"""WITH k AS (SELECT doc_id, {kw('text')} AS ws FROM documents), s AS (SELECT doc_id, {jac('ws', "['then', 'heron']")} AS kws, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 10) / 10 END AS sem FROM k)
  SELECT doc_id, round(coalesce(0.5 * kws + 0.5 * sem, kws), 9) AS score FROM s""")
def blend(t):
    kws = similarity.jaccard(F.array(F.lit("then"), F.lit("heron")), F.col("words"))
    sem = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 10) / 10)
    rows = spread_small(t("documents")).withColumn("words", similarity.keywords("text"))
    return rows.select("doc_id", F.round(similarity.blend(kws, sem), 9).alias("score"))


_GQ = "['reading', 'then', 'heron', 'tion']"


@query("guidance_search", f"""WITH k AS (SELECT *, {kw('text')} AS ws FROM v_guidance WHERE category IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6')), s AS (SELECT item_id, category, lang, load_mode, CASE WHEN load_mode = 'always' THEN 0 ELSE
    round(greatest({jac('ws', _GQ)}, len(list_filter({_GQ}, lambda w: contains(lower(text), w))) / 4 * 0.8), 9) END AS score FROM k),
  a AS (SELECT * FROM s WHERE load_mode = 'always') SELECT * FROM a UNION ALL SELECT * FROM (SELECT * FROM s WHERE load_mode <> 'always' AND score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, item_id) <= 100 - (SELECT count(*) FROM a))""")
def guidance_search(t):
    return ranking.guidance_search(t("v_guidance"), "reading then heron tion", 100, [f"src{i}" for i in range(1, 7)])


@query("changed_only_embed", """SELECT doc_id AS item_id, sha256(coalesce(text, '')) AS hash, CASE WHEN lang = 'en' THEN 'new' WHEN source < 'src15' THEN 'changed' ELSE 'kept' END AS action FROM documents""")
def changed_only_embed(t):
    index = t("documents").where("lang <> 'en'").select(F.col("doc_id").alias("item_id"), F.when(F.col("source") < "src15", F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256)).alias("hash"))
    return ranking.changed_only(t("documents").select(F.col("doc_id").alias("item_id"), "text"), index).select("item_id", "hash", "action")


@query("index_upsert", """SELECT doc_id AS item_id, sha256(coalesce(text, '')) AS hash, CASE WHEN lang = 'en' OR source < 'src15' THEN length(text)::DOUBLE ELSE -1 END AS first_value FROM documents""")
def index_upsert(t):
    """Changed texts get a vector from an injected function, here one that holds the text length."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts):
        return texts.map(lambda s: [float(len(s))])

    embed.func.__annotations__.clear()
    items = t("documents").select(F.col("doc_id").alias("item_id"), "text")
    stored = F.when(F.col("source") < "src15", F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256))
    index = t("documents").where("lang <> 'en'").select(F.col("doc_id").alias("item_id"), stored.alias("hash"), F.array(F.lit(-1.0)).alias("embedding"))
    return ranking.index_texts(items, index, embed).select("item_id", "hash", F.col("embedding")[0].alias("first_value"))


@query("mention_order", """SELECT table_id, coalesce(uses, 0) AS uses FROM v_catalog LEFT JOIN (SELECT l_partkey AS table_id, count(*) AS uses FROM lineitem GROUP BY 1) USING (table_id)""")
def mention_order(t):
    uses = t("lineitem").groupBy(F.col("l_partkey").alias("table_id")).agg(F.count(F.lit(1)).alias("uses"))
    return ranking.mention_order(t("v_catalog").select("table_id"), uses, "table_id")


@query("impact", """WITH r AS (SELECT * FROM documents WHERE text <> ''), h AS (SELECT *, contains(lower(text), 'heron') OR contains(lower(text), 'reading') AS hit FROM r)
  SELECT round(count(*) FILTER (hit) / count(*), 4) AS score, count(*) FILTER (hit) AS matched, count(*) AS total, (SELECT string_agg(doc_id, ',' ORDER BY doc_id DESC) FROM (SELECT * FROM h WHERE hit ORDER BY doc_id DESC LIMIT 3)) AS samples FROM h""")
def impact(t):
    out = ranking.impact(t("documents"), "text", ["heron", "reading"], "doc_id", "doc_id", samples=3)
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query("related", f"""WITH k AS (SELECT doc_id AS item_id, lang, {tok('text')} AS ws FROM documents WHERE (contains(lower(text), 'heron') OR contains(lower(text), 'then')) AND doc_id <> 3)
  SELECT item_id, round(0.5 * {jac('ws', "['heron', 'then']")} + 0.5 * coalesce(CASE WHEN lang = 'en' THEN (item_id % 10) / 10 END, 0), 9) AS score FROM k ORDER BY score DESC, item_id LIMIT 60""")
def related(t):
    items = t("documents").select(F.col("doc_id").alias("item_id"), "text")
    sem = t("documents").where("lang = 'en'").select(F.col("doc_id").alias("item_id"), ((F.col("doc_id") % 10) / 10).alias("semantic"))
    return ranking.related(items, ["heron", "then"], 3, 60, sem)
