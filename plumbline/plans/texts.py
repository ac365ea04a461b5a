"""Queries for scalar, array and JSON functions (FUN)."""

from pyspark.sql import functions as F

from ..functions import ranges, rowwise, similarity, text
from ..session import spread_small
from .registry import query

_STOPS = ", ".join(f"'{w}'" for w in similarity.KEYWORD_STOPS)
_TSTOPS = ", ".join(f"'{w}'" for w in similarity.TOKEN_STOPS)


def kw(e):
    return f"list_distinct(list_filter(string_split_regex(lower({e}), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains([{_STOPS}], w)))"


def tok(e):
    return f"list_distinct(list_filter(string_split_regex(lower({e}), '[^a-z0-9_.]+'), lambda w: length(w) >= 3 AND NOT list_contains([{_TSTOPS}], w)))"


def jac(a, b):
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


@query("keywords", f"SELECT doc_id, array_to_string(list_sort({kw('text')}), ' ') AS words FROM documents")
def keywords(t):
    return spread_small(t("documents")).select("doc_id", F.array_join(F.array_sort(similarity.keywords("text")), " ").alias("words"))


@query("tokens", f"SELECT doc_id, array_to_string(list_sort({tok('text')}), ' ') AS words FROM documents")
def tokens(t):
    return spread_small(t("documents")).select("doc_id", F.array_join(F.array_sort(similarity.tokens("text")), " ").alias("words"))


ASK = "the reading of then heron and stand tion"
_ASKED = "['reading', 'then', 'heron', 'stand', 'tion']"


@query("jaccard", f"WITH k AS (SELECT doc_id, {kw('text')} AS ws FROM documents) SELECT doc_id, round({jac('ws', _ASKED)}, 9) AS score FROM k")
def jaccard(t):
    asked = F.array(*[F.lit(w) for w in similarity.query_words(ASK)])
    rows = spread_small(t("documents")).withColumn("words", similarity.keywords("text"))
    return rows.select("doc_id", F.round(similarity.jaccard(asked, F.col("words")), 9).alias("score"))


@query("keyword_score", f"""WITH k AS (SELECT doc_id, text, {kw('text')} AS ws FROM documents)
  SELECT doc_id, round(greatest({jac('ws', _ASKED)}, len(list_filter({_ASKED}, lambda w: contains(lower(text), w))) / 5 * 0.8), 9) AS score FROM k""")
def keyword_score(t):
    return spread_small(t("documents")).select("doc_id", F.round(similarity.keyword_score("text", similarity.query_words(ASK)), 9).alias("score"))


@query("recency", """SELECT event_id, round(pow(2.718281828::DOUBLE, -coalesce(greatest(epoch_us(TIMESTAMP '2024-01-20') - epoch_us(u), 0) / 86400e6, 365) / 14), 9) AS table_recency,
  round(coalesce(pow(2.718281828::DOUBLE, -greatest(epoch_us(TIMESTAMP '2024-01-20') - epoch_us(u), 0) / 86400e6 / 14), 0), 9) AS snippet_recency FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS u FROM events)""")
def recency(t):
    now = F.lit("2024-01-20 00:00:00")
    rows = t("events").withColumn("u", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    return rows.select("event_id", F.round(similarity.recency(now, "u", 365.0), 9).alias("table_recency"), F.round(similarity.recency(now, "u"), 9).alias("snippet_recency"))


SOURCES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'SUM(db' || cast(user_id AS string) || '.orders.amt)' WHEN 1 THEN 'orders.amt' WHEN 2 THEN 'db.orders.amt'
  WHEN 3 THEN 'plain' WHEN 4 THEN 'avg(t' || cast(user_id AS string) || '.x) + sum(q.y)' ELSE 'main.db.orders.amt / items.qty + coalesce.z' END AS source FROM {events}"""


@query("table_of_source", f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'db' || u || '.orders' WHEN 1 THEN 'orders' WHEN 2 THEN 'db.orders' WHEN 4 THEN 't' || u WHEN 5 THEN 'main.db' END AS table_name,
  CASE event_id % 6 WHEN 3 THEN NULL ELSE split_part(source, '.', 1) END AS db FROM (SELECT s.*, cast(user_id AS VARCHAR) AS u FROM ({SOURCES.format(events='events')}) s JOIN events USING (event_id))""")
def table_of_source(t):
    return t.sql(SOURCES).select("event_id", text.table_of_source("source").alias("table_name"), text.db_of_table("source").alias("db"))


@query("db_of_table", "SELECT DISTINCT table_fqn, split_part(table_fqn, '.', 1) AS db FROM v_table_usage UNION SELECT DISTINCT p_brand, NULL FROM part")
def db_of_table(t):
    names = t("v_table_usage").select("table_fqn").union(t("part").select("p_brand")).distinct()
    return names.select("table_fqn", text.db_of_table("table_fqn").alias("db"))


@query("content_hash", "SELECT doc_id, sha256(coalesce(CASE WHEN doc_id % 10 = 0 THEN NULL ELSE text END, '')) AS hash FROM documents")
def content_hash(t):
    body = F.when(F.col("doc_id") % 10 != 0, F.col("text"))
    return t("documents").select("doc_id", text.content_hash(body).alias("hash"))


@query("json_text", """SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN '' ELSE text END AS said FROM conversations""")
def json_text(t):
    k = F.col("turn") % 4
    body = (F.when(k == 0, F.to_json(F.struct(F.col("text").alias("content"), F.lit("x").alias("text"))))
            .when(k == 1, F.to_json(F.struct(F.lit("").alias("content"), F.col("text").alias("text"))))
            .when(k == 2, F.col("text")).otherwise(F.to_json(F.struct(F.lit(1).alias("other")))))
    return t("conversations").select("conv_id", "turn", text.json_text(body).alias("said"))


@query("clean_answer", """SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[*_`#>]', '', 'g'), '\\s+', ' ', 'g')) AS answer FROM conversations""")
def clean_answer(t):
    framed = F.concat(F.lit("intro **🧠 Planning (act) → create_data ✗** first\n**⚙ Planning (x)**\n ✅ `"), F.col("text"), F.lit("` **🙂** "))
    return t("conversations").select("conv_id", "turn", text.clean_answer(framed).alias("answer"))


@query("error_summary", """SELECT call_id, trim(regexp_replace(error_text, '\\s+', ' ', 'g')) AS summary, split_part(error_text, chr(10), 1) AS first_line FROM v_tool_calls WHERE error_text IS NOT NULL""")
def error_summary(t):
    rows = t("v_tool_calls").where("error_text IS NOT NULL")
    return rows.select("call_id", text.error_summary("error_text").alias("summary"), text.first_line("error_text").alias("first_line"))


@query("label_of_column", """SELECT DISTINCT p_name AS name, upper(p_name[1]) || substr(p_name, 2, strpos(p_name, ' ') - 1) || upper(substr(p_name, strpos(p_name, ' ') + 1, 1)) || substr(p_name, strpos(p_name, ' ') + 2) || ' Total' AS label FROM part""")
def label_of_column(t):
    code = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("Total"))
    return t("part").select(F.col("p_name").alias("name"), text.column_label(code).alias("label")).distinct()


@query("safe_name", """WITH n AS (SELECT p_partkey, lower(regexp_replace(regexp_replace('_ ' || p_name || '#', '[^a-zA-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS base FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM n)
  SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS safe FROM r""")
def safe_name(t):
    rows = t("part").select("p_partkey", text.safe_name(F.concat(F.lit("_ "), "p_name", F.lit("#"))).alias("base"))
    return text.number_duplicates(rows, "base", "p_partkey", "safe").select("p_partkey", "safe")


@query("md_front", """WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\\r', '', 'g'), chr(10)) AS ls, doc_id % 2 = 0 AS has FROM documents),
  l AS (SELECT doc_id, i, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS line FROM d, (SELECT unnest(generate_series(1, 20000)) AS i) WHERE i <= len(ls)),
  s AS (SELECT doc_id, min(i) AS s FROM l WHERE line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '---%' GROUP BY 1),
  e AS (SELECT l.doc_id, min(i) AS e FROM l JOIN s ON l.doc_id = s.doc_id AND i > s WHERE line = '' OR line LIKE '#%' GROUP BY 1),
  c AS (SELECT l.doc_id, l.i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY l.doc_id ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS before
    FROM l JOIN s ON l.doc_id = s.doc_id LEFT JOIN e ON e.doc_id = l.doc_id WHERE l.i >= s AND (e IS NULL OR l.i < e)),
  p AS (SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS lead FROM c GROUP BY 1)
  SELECT doc_id, CASE WHEN has THEN 'alwaysApply: ' || doc_id END AS front, 'Doc ' || doc_id AS title, lead AS description FROM d LEFT JOIN p USING (doc_id)""")
def md_front(t):
    body = F.concat(F.lit("\n# Doc "), F.col("doc_id").cast("string"), F.lit(" \n\n"), F.regexp_replace("text", "\r", ""))
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nalwaysApply: "), F.col("doc_id").cast("string"), F.lit("\n---\n"), body)).otherwise(body)
    return spread_small(t("documents")).select("doc_id", text.front_matter(marked).alias("m")).select("doc_id", "m.front", "m.title", "m.description")


@query("ref_edges", """SELECT p_partkey, cast(position AS INTEGER) AS position, target FROM (SELECT p_partkey, 0 AS position, split_part(p_name, ' ', 1) AS target FROM part
  UNION ALL SELECT p_partkey, 1, 'm_' || p_size FROM part)""")
def ref_edges(t):
    code = F.concat(F.lit("select * from ${ref('"), F.split("p_name", " ")[0], F.lit("')} join ${ref( \"m_"), F.col("p_size").cast("string"),
                    F.lit("\" )} join ${ref('"), F.split("p_name", " ")[0], F.lit("')} where prefix(x)"))
    return text.ref_edges(t("part").withColumn("code", code), "p_partkey", "code")


@query("month_window", """SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_first FROM orders""")
def month_window(t):
    lo, hi = ranges.month_window(F.col("o_orderdate"))
    return t("orders").select("o_orderkey", F.date_format(lo, "yyyy-MM-dd").alias("first_day"), F.date_format(hi, "yyyy-MM-dd").alias("next_first"))


@query("round_half_even", """SELECT event_id, round_even(event_id / 8, 1) AS even, round(event_id / 8, 1) AS up FROM events""")
def round_half_even(t):
    v = F.col("event_id") / 8
    return t("events").select("event_id", F.bround(v, 1).alias("even"), F.round(v, 1).alias("up"))


@query("flatten_output", """SELECT event_id, cast(json_extract(props, '$.k') AS INTEGER) AS "props_k", event_type AS "meta_kind_type", user_id AS "meta_user_id", '["' || event_type || '"]' AS tags FROM events""")
def flatten_output(t):
    meta = F.struct(F.struct(F.col("event_type").alias("type")).alias("kind"), "user_id")
    flat = text.flatten_output(t("events").select("event_id", "props", meta.alias("meta"), F.array("event_type").alias("tags")), {"props": "k int"})
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


@query("lineage_refs", f"""SELECT event_id, unnest(CASE event_id % 6 WHEN 0 THEN ['orders.amt'] WHEN 1 THEN ['orders.amt'] WHEN 2 THEN ['orders.amt'] WHEN 3 THEN [] WHEN 4 THEN ['t' || user_id || '.x', 'q.y']
  ELSE ['db.orders', 'orders.amt', 'items.qty'] END) AS ref FROM events""")
def lineage_refs(t):
    pairs = t.sql(SOURCES).select("event_id", F.explode(text.lineage_refs("source")).alias("r"))
    return pairs.select("event_id", F.concat_ws(".", "r.table", "r.column").alias("ref"))


@query("lineage_resolve", """WITH r AS (SELECT p_partkey, p_size % 3 AS k, p_brand AS tb, p_type AS c FROM part), g AS (SELECT p_partkey, CASE WHEN k = 0 THEN NULL ELSE k END AS src, lower(tb) AS tb, c FROM r),
  f AS (SELECT p_partkey, coalesce(src, 1) AS source_id, tb, c FROM g) SELECT f.p_partkey, f.source_id, f.tb AS table_name, f.c AS columns, k.table_id
  FROM f JOIN (SELECT cast(substr(p_brand, 7) AS INTEGER) AS table_id, lower(p_brand) AS table_name, cast(substr(p_brand, 7) AS INTEGER) % 2 + 1 AS source_id FROM part GROUP BY ALL) k ON k.table_name = f.tb AND k.source_id = f.source_id""")
def lineage_resolve(t):
    brand = F.substring("p_brand", 7, 10).cast("int")
    catalog = t("part").select((brand % 2 + 1).alias("source_id"), F.col("p_brand").alias("table_name"), brand.alias("table_id")).distinct()
    src = F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3)
    refs = t("part").select("p_partkey", src.alias("source_id"), F.upper("p_brand").alias("table"), F.col("p_type").alias("column"))
    out = text.lineage_resolve(refs, catalog, ["p_partkey"], only_source=1)
    return out.select("p_partkey", "source_id", "table_name", F.array_join("columns", ",").alias("columns"), "table_id")


@query("json_in_text", """SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN NULL ELSE cast(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""")
def json_in_text(t):
    k = F.col("event_id") % 6
    p = F.col("props")
    wrapped = (F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here you go: "), p, F.lit(" hope } it helps {")))
               .when(k == 3, F.concat(F.lit("```\n"), p, F.lit("\n```\nBecause {this}"))).when(k == 4, F.lit("no object")).otherwise(F.lit("broken {\"a\": ")))
    return t("events").select("event_id", F.get_json_object(text.json_object_in(wrapped), "$.k").cast("int").alias("k"))


@query("html_extract")
def html_extract(t):
    out = rowwise.html_extract(t("pages"), "page_id", "html")
    return out.select("page_id", "title", "description", F.size("metadata").alias("n_meta"), F.size("json_ld").alias("n_ld"), F.array_join("headings", "|").alias("headings"), "text")
