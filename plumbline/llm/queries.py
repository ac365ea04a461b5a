"""The registered queries ``opN_<name>`` of this subpackage; each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import archives, bpe, chat, crf, decontaminate, langid, merkle, neardup, pivots, rtree, secrets, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.drop("uid")


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=None, digests=True)


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out("doc_id", 3, 1)
    prototypes = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), prototypes)


@query("op2_crf_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out("doc_id", 4, 2)
    field = crf.train(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return crf.score(docs.select("doc_id", held.alias("held_out"), "text"), field)


@query("op10_order_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.assign(table(spark, sf_dir, "documents"))


#: The label table knows two categories: texts of low quality, and toxic ones.
TOXIC_CHAIN = [("low_quality", "quality", 0), ("toxic", "toxic", 1)]


@query("op7_toxicity_chain")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out("doc_id", 4, 2)
    chain = toxicity.train(docs.where(~held), table(spark, sf_dir, "labels").where(~held), TOXIC_CHAIN)
    return toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), chain)


@query("op1_chat_examples")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(fixed)
    return chat.digests(chat.expand(turns))


TOP = 10

OP9_SQL = f"""
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q, e c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= {TOP}
"""


@query("op9_pivot_topk", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut_lineage(pivots.integers(table(spark, sf_dir, "embeddings")).distinct())
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    index = pivots.build(vectors, TOP)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return pivots.search(index, asked, TOP, asked.count())


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_HOST = "translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_replace(regexp_replace(regexp_extract({u}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '')"


def _form(u: str) -> str:
    host, path, rest = (x.format(u=u) for x in (_HOST, _PATH, _QUERY))
    return (f"CASE WHEN contains({u}, '://') THEN regexp_replace(regexp_replace({host}, '^www\\.', ''), ':(80|443)$', '') || regexp_replace({path}, '/$', '')"
            f" || CASE WHEN {rest} <> '' THEN '?' || {rest} ELSE '' END END")


_SEGMENTS = """CASE WHEN regexp_matches({p}, '/\\.\\.?(/|$)') THEN array_to_string(list_reduce(list_transform(string_split({p}, '/'), lambda x: [x]),
  lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] ELSE list_concat(acc, x) END), '/') ELSE {p} END"""

OP8_SQL = f"""
WITH RECURSIVE rules(rhost, rpath, rverdict) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
p AS (SELECT page_id, url, html, coalesce({_HOST.format(u='url')}, '') AS host, coalesce({_PATH.format(u='url')}, '') AS path, {_form('url')} AS form FROM pages),
tags AS (SELECT form, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM p WHERE form IS NOT NULL),
found AS (SELECT form, host, path, regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS t FROM tags WHERE regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')
          UNION ALL
          SELECT form, host, path, regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM tags WHERE regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
plain AS (SELECT form, host, path, regexp_replace(t, '(?i)&(amp|#38|#x26);', '&', 'g') AS t FROM found),
targets AS (SELECT *, regexp_extract(t, '(?s)([?#].*)$', 1) AS rest, CASE WHEN starts_with(t, '/') THEN '' ELSE regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '(?s)[^/]*$', '') END
              || regexp_extract(t, '(?s)^([^?#]*)', 1) AS whole FROM plain),
whole AS (SELECT form, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:|#|$)') THEN NULL WHEN starts_with(t, '//') THEN 'http:' || t
              WHEN starts_with(t, '?') THEN 'http://' || host || path || t ELSE 'http://' || host || {_SEGMENTS.format(p='whole')} || rest END AS t FROM targets),
steps AS (SELECT form AS a, {_form('t')} AS b FROM whole WHERE t IS NOT NULL),
u AS (SELECT url, {_HOST.format(u='url')} AS uhost, {_PATH.format(u='url')} AS upath, {_form('url')} AS uform
      FROM (SELECT url FROM p UNION SELECT t FROM whole) x WHERE contains(url, '://')),
fits AS (SELECT url, uform, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY url ORDER BY length(rhost || rpath) DESC, rverdict, rhost || rpath) AS place
         FROM u JOIN rules ON (uhost = rhost OR ends_with(uhost, '.' || rhost)) AND starts_with(upath, rpath)),
best AS (SELECT url, uform, rule, rverdict FROM fits WHERE place = 1),
both_ways AS (SELECT a, b FROM steps UNION SELECT b, a FROM steps),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
near AS (SELECT a, b FROM reach UNION SELECT uform, uform FROM u),
votes AS (SELECT near.a AS form, bool_or(rverdict = 'allow') AS allowed, bool_or(rverdict = 'block') AS blocked
          FROM near JOIN best ON best.uform = near.b GROUP BY near.a)
SELECT page_id, host, path, rule, CASE WHEN rverdict IS NOT NULL THEN rverdict WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN best USING (url) LEFT JOIN votes USING (form)
"""


@query("op8_url_filter", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


OP6_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, strlen(html) AS n, sha256(html) AS d FROM p),
s AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS head FROM r WINDOW w AS (PARTITION BY d ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND place > 1 THEN head END AS refers_to, url, '2000-01-01T00:00:00Z' AS warc_date
FROM s
"""


@query("op6_arc_to_warc", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.through_archives(table(spark, sf_dir, "pages")).drop("record_id")


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf_sql(**instead: str) -> str:
    parts = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || {instead.get(f, f)} END" for f in LEAF_FIELDS]
    return f"sha256({' || '.join(parts)})"


#: CRC-32 of a decimal number: each character is folded in, then eight shifts with the reversed polynomial.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
    lambda x, zero: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"""

OP12_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, lang, {_leaf_sql()} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql(text=f"translate(text, '{_CAPITALS}', '{_SMALL}')")} END AS changed FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM base),
up(level, tree, idx, digest, n) AS (
  SELECT 0, tree, idx, leaf, n FROM placed
  UNION ALL
  SELECT level + 1, tree, idx >> 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 7) >> 3) FROM up WHERE n > 1 GROUP BY level, tree, idx >> 3),
tops AS (SELECT tree, digest, count(*) OVER () AS n FROM up WHERE n = 1),
heads(level, idx, digest, n) AS (
  SELECT 0, tree, digest, n FROM tops
  UNION ALL
  SELECT level + 1, idx >> 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 7) >> 3) FROM heads WHERE n > 1 GROUP BY level, idx >> 3),
steps AS (
  SELECT p.tree, p.idx, u.level AS step, coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < p.idx >> 3 * u.level), '') || '|'
    || coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > p.idx >> 3 * u.level), '') AS sides
  FROM placed p JOIN up u ON u.tree = p.tree AND u.n > 1 AND u.idx >> 3 = p.idx >> 3 * (u.level + 1) GROUP BY p.tree, p.idx, u.level
  UNION ALL
  SELECT p.tree, p.idx, 100 + u.level, coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < p.tree >> 3 * u.level), '') || '|'
    || coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > p.tree >> 3 * u.level), '')
  FROM placed p JOIN heads u ON u.n > 1 AND u.idx >> 3 = p.tree >> 3 * (u.level + 1) GROUP BY p.tree, p.idx, u.level),
proofs AS (SELECT tree, idx, list(sides ORDER BY step) AS steps FROM steps GROUP BY tree, idx),
folded AS (
  SELECT doc_id, leaf, tops.digest AS subroot, (SELECT digest FROM heads WHERE n = 1) AS root,
    sha256(coalesce(replace(array_to_string(steps, ''), '|', ''), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(changed, leaf), coalesce(steps, [])), lambda acc, s: sha256(split_part(s, '|', 1) || acc || split_part(s, '|', 2))) AS folded_root
  FROM placed JOIN tops USING (tree) LEFT JOIN proofs USING (tree, idx))
SELECT *, folded_root = root AS verified FROM folded
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*LEAF_FIELDS)
    tampered = [F.translate("text", _CAPITALS, _SMALL) if f == "text" else F.col(f) for f in LEAF_FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    manifest = merkle.build(docs, LEAF_FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id"), "changed": F.when(hit, merkle.leaf_digest(tampered))})
    steps, shown = F.col("steps"), F.coalesce("changed", "leaf")
    found = merkle.proofs(manifest).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(steps).alias("proof_sha256"), merkle.fold(shown, steps).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


SHIFTED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"

OP13_SQL = f"""
WITH e AS (SELECT DISTINCT vec_id, CAST({SHIFTED} AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e a, e c WHERE a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS place
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""


@query("op13_rtree_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = rtree.integers(table(spark, sf_dir, "embeddings"), label=F.expr(SHIFTED))
    return rtree.hard_negatives(vectors, F.expr("vec_id % 50 = 0"), positives=5, negatives=3, low=50, high=95)


@query("op11_secret_formats")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"), count("format"))
