"""Queries for sources, sinks and snapshots (SRC)."""

from pyspark.sql import functions as F

from ..functions.text import json_cells
from ..operators import profile
from ..session import shared_dir
from ..sources import budget, documents, files, landing, metastore, remote, reports, snapshots, variants
from .registry import query


@query("file_scan", """SELECT r_name, count(*) AS nations, (SELECT count(*) FROM supplier) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def file_scan(t):
    folder = shared_dir(t.spark, "suppliers")
    t("supplier").select("s_suppkey", "s_name").write.option("header", True).csv(folder)
    got = files.file_scan(t.spark, [t.path("region"), t.path("nation"), f"{folder}/*.csv"], register=False)
    region, nation, supplier = got.values()
    total = supplier.agg(F.count(F.lit(1))).scalar()
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("nations"))
    return joined.withColumn("suppliers", total)


@query("paged_scan", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def paged_scan(t):
    """Pages are the row groups of the orders file, fetched by the tasks."""
    fetch, pages = remote.row_group_pages(t.path("orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return remote.paged_scan(t.spark, fetch, "o_orderkey bigint, o_totalprice double, o_orderstatus string", pages)


def _docs(t):
    meta = F.struct(F.from_json("props", "k int")["k"].alias("k"), F.col("event_type").alias("type"))
    return t("events").select(F.col("event_id").alias("_id"), "user_id", meta.alias("meta"), F.array("event_type", F.lit("x")).alias("tags"))


@query("doc_find", """SELECT _id, user_id, meta FROM (SELECT event_id AS _id, user_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS meta,
   cast(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type IN ('click', 'view')) WHERE k >= 90 OR user_id = 3""")
def doc_find(t):
    spec = {"find": {"meta.type": {"$in": ["click", "view"]}, "$or": [{"meta.k": {"$gte": 90}}, {"user_id": 3}]},
            "projection": {"user_id": 1, "meta": 1}, "sort": {"meta.k": -1, "user_id": 1}, "limit": 0}
    return documents.doc_find(_docs(t), spec)


@query("doc_find_limited", """SELECT event_id AS _id, user_id FROM events WHERE NOT (coalesce(cast(json_extract(props, '$.k') AS INTEGER) < 10, false) OR user_id = 3)
   AND event_type <> 'purchase' ORDER BY cast(json_extract(props, '$.k') AS INTEGER) DESC, event_id LIMIT 250""")
def doc_find_limited(t):
    spec = {"find": {"$nor": [{"meta.k": {"$lt": 10}}, {"user_id": 3}], "tags": {"$all": ["x"], "$size": 2, "$not": {"$elemMatch": {"$eq": "purchase"}}}},
            "projection": {"user_id": 1}, "sort": [("meta.k", -1)], "limit": 250}
    return documents.doc_find(_docs(t), spec)


@query("doc_aggregate", """SELECT type AS tag, count(*) AS n, cast(sum(user_id) AS BIGINT) AS users, min(k) AS lo, max(k) AS hi FROM
   (SELECT user_id, cast(json_extract(props, '$.k') AS INTEGER) AS k, unnest([event_type, 'x']) AS type FROM events) WHERE k >= 5 GROUP BY 1""")
def doc_aggregate(t):
    """Events by tag: filtered, one row per list member, grouped and renamed."""
    return documents.doc_aggregate(_docs(t), [
        {"$match": {"meta.k": {"$gte": 5}}}, {"$unwind": "$tags"},
        {"$group": {"_id": "$tags", "n": {"$sum": 1}, "users": {"$sum": "$user_id"}, "lo": {"$min": "$meta.k"}, "hi": {"$max": "$meta.k"}}},
        {"$sort": {"n": -1}}, {"$project": {"_id": 0, "tag": "$_id", "n": 1, "users": 1, "lo": 1, "hi": 1}}])


_DOCS_SQL = "d AS (SELECT event_id AS _id, user_id, event_type AS type, cast(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"


@query("doc_nested_project", f"""WITH {_DOCS_SQL} SELECT _id, '{{"k":' || k || '}}' AS meta, '{{"owner":{{"id":' || user_id || '}},"twice":' || (2 * k) || '}}' AS more FROM d WHERE k > user_id""")
def doc_nested_project(t):
    """Nested names stay nested, expressions build objects, and two fields of a document are compared."""
    return documents.doc_aggregate(_docs(t), [
        {"$match": {"$expr": {"$gt": ["$meta.k", "$user_id"]}}},
        {"$project": {"meta.k": 1, "more.owner.id": "$user_id", "more.twice": {"$multiply": ["$meta.k", 2]}}}])


@query("doc_unwind_nested", f"""WITH {_DOCS_SQL}, u AS (SELECT k, unnest([type, 'x']) AS tag, unnest([0, 1]) AS i FROM d)
  SELECT tag AS _id, count(*) AS n, max(k) AS hi, cast(max(i) AS BIGINT) AS at, '{{"k":' || max(k) || ',"tags":"' || tag || '"}}' AS top FROM u GROUP BY tag""")
def doc_unwind_nested(t):
    """A list inside an object is unwound where it is."""
    return documents.doc_aggregate(_docs(t), [
        {"$addFields": {"box.k": "$meta.k", "box.tags": "$tags"}}, {"$unwind": {"path": "$box.tags", "includeArrayIndex": "i"}},
        {"$sort": {"meta.k": -1}},
        {"$group": {"_id": "$box.tags", "n": {"$sum": 1}, "hi": {"$max": "$box.k"}, "at": {"$max": "$i"}, "top": {"$first": "$box"}}}])


@query("doc_ordered_groups", f"""WITH {_DOCS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC NULLS LAST, _id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY k NULLS FIRST, _id DESC) AS down FROM d)
  SELECT user_id AS _id, max(_id) FILTER (up = 1) AS best, max(type) FILTER (down = 1) AS worst, '[' || string_agg(_id, ',' ORDER BY up) || ']' AS ids FROM r GROUP BY user_id""")
def doc_ordered_groups(t):
    """First, last and list of a group follow the sort, however the rows are shuffled."""
    return documents.doc_aggregate(_docs(t), [
        {"$sort": {"meta.k": -1}}, {"$group": {"_id": "$user_id", "best": {"$first": "$_id"}, "worst": {"$last": "$meta.type"}, "ids": {"$push": "$_id"}}}])


@query("doc_lookup", """SELECT n_regionkey AS _id, count(s_suppkey) AS suppliers, count(DISTINCT n_nationkey) AS nations, max(s_acctbal) AS richest FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def doc_lookup(t):
    """Suppliers as lists in the documents of their nations, unwound and summed by region."""
    nations = t("nation").select(F.col("n_nationkey").alias("_id"), F.col("n_regionkey").alias("region"))
    suppliers = t("supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    return documents.doc_aggregate(nations, [
        {"$lookup": {"from": "suppliers", "localField": "_id", "foreignField": "nation", "as": "found"}},
        {"$unwind": {"path": "$found", "preserveNullAndEmptyArrays": True}},
        {"$group": {"_id": "$region", "suppliers": {"$sum": {"$cond": [{"$gt": ["$found._id", -1]}, 1, 0]}}, "ids": {"$addToSet": "$_id"}, "richest": {"$max": "$found.s_acctbal"}}},
        {"$project": {"suppliers": 1, "nations": {"$toLong": {"$size": "$ids"}}, "richest": 1}}], collections={"suppliers": suppliers})


@query("doc_facet", f"""WITH {_DOCS_SQL}, c AS (SELECT type, count(*) AS n FROM d GROUP BY 1), o AS (SELECT * FROM d WHERE k < 50 ORDER BY k DESC, _id LIMIT 3)
  SELECT (SELECT '[' || string_agg('{{"_id":"' || type || '","count":' || n || '}}', ',' ORDER BY n DESC, type) || ']' FROM c) AS types,
    (SELECT '[' || string_agg('{{"_id":' || _id || ',"k":' || k || '}}', ',' ORDER BY k DESC, _id) || ']' FROM o) AS top""")
def doc_facet(t):
    return documents.doc_aggregate(_docs(t), [{"$facet": {
        "types": [{"$sortByCount": "$meta.type"}],
        "top": [{"$match": {"meta.k": {"$lt": 50}}}, {"$sort": {"meta.k": -1}}, {"$limit": 3}, {"$project": {"k": "$meta.k"}}]}}])


#: Documents in which ``k`` is a number, a text, null, missing, or a list, and ``items`` a list of objects of two kinds, or one object.
_MIXED = """CASE event_id % 5 WHEN 0 THEN '{"_id":' || event_id || ',"k":' || k || ',"items":[{"q":' || k || '},{"q":"x"}]}' WHEN 1 THEN '{"_id":' || event_id || ',"k":"' || k || '"}'
  WHEN 2 THEN '{"_id":' || event_id || ',"k":null,"items":{"q":' || k || '}}' WHEN 3 THEN '{"_id":' || event_id || '}' ELSE '{"_id":' || event_id || ',"k":[' || k || ',"' || k || '"],"items":[]}' END AS doc"""


def _mixed(t):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k IS NOT NULL").selectExpr(_MIXED)


_MIXED_SQL = "m AS (SELECT event_id, k FROM (SELECT event_id, cast(json_extract(props, '$.k') AS INTEGER) AS k FROM events) WHERE k IS NOT NULL)"


@query("doc_find_mixed", f"""WITH {_MIXED_SQL} SELECT cast(event_id AS VARCHAR) AS _id, CASE event_id % 5 WHEN 0 THEN cast(k AS VARCHAR) WHEN 4 THEN '[' || k || ',"' || k || '"]' END AS k
  FROM m WHERE (event_id % 5 IN (0, 4) AND k > 50) OR (event_id % 5 = 3 AND event_id >= 500)""")
def doc_find_mixed(t):
    """Numbers are compared with numbers only, a list by its members; missing is not null."""
    spec = {"find": {"$or": [{"k": {"$gt": 50}}, {"k": {"$exists": False}, "_id": {"$gte": 500}}]}, "projection": ["_id", "k"]}
    return variants.doc_find(_mixed(t), "doc", spec)


@query("doc_group_mixed", f"""WITH {_MIXED_SQL}, u AS (SELECT cast(k AS VARCHAR) AS _id, k AS own FROM m WHERE event_id % 5 = 0 UNION ALL SELECT '"x"', k FROM m WHERE event_id % 5 = 0 UNION ALL SELECT cast(k AS VARCHAR), NULL FROM m WHERE event_id % 5 = 2)
  SELECT _id, count(*) AS n, cast(coalesce(sum(own), 0) AS DOUBLE) AS total, cast(min(own) AS VARCHAR) AS least FROM u GROUP BY 1""")
def doc_group_mixed(t):
    """Members of a list, or the one object that stands in its place, grouped by a value of two kinds."""
    return variants.group(_mixed(t), "doc", {"_id": "$items.q", "n": {"$sum": 1}, "total": {"$sum": "$k"}, "least": {"$min": "$k"}}, unwind="items")


@query("doc_schema", """WITH f(name, dtype, seen) AS (
  SELECT '_id', 'integer', count(event_id) FROM events UNION ALL SELECT 'user_id', 'integer', count(user_id) FROM events
  UNION ALL SELECT 'meta', 'object', count(*) FROM events UNION ALL SELECT 'meta.k', 'integer', count(try_cast(json_extract_string(props, '$.k') AS BIGINT)) FROM events
  UNION ALL SELECT 'meta.type', 'string', count(event_type) FROM events UNION ALL SELECT 'tags', 'array', count(*) FROM events
  UNION ALL SELECT 'price', CASE WHEN count(*) FILTER (l_extendedprice + 0.25 <> floor(l_extendedprice + 0.25)) > 0 THEN 'number' ELSE 'integer' END, count(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'items', 'array', count(*) FROM lineitem
  UNION ALL SELECT 'items[].q', CASE WHEN count(*) FILTER (l_quantity + 0.5 <> floor(l_quantity + 0.5)) > 0 THEN 'number' ELSE 'integer' END, count(l_quantity) FROM lineitem
  UNION ALL SELECT 'items[].flag', 'boolean', count(l_linenumber > 2) FROM lineitem) SELECT name, dtype FROM f WHERE seen > 0""")
def doc_schema(t):
    """Two kinds of documents in one collection; the schema is their union."""
    events = _docs(t).select(F.to_json(F.struct("*")).alias("doc"))
    item = F.struct((F.col("l_quantity") + 0.5).alias("q"), (F.col("l_linenumber") > 2).alias("flag"))
    lines = t("lineitem").select(F.to_json(F.struct(F.col("l_orderkey").alias("_id"), (F.col("l_extendedprice") + 0.25).alias("price"), F.array(item).alias("items"))).alias("doc"))
    return documents.doc_schema(events.unionByName(lines), "doc")


MONTHLY = """SELECT date_format(o_orderdate, 'yyyy-MM') AS m, o_orderstatus AS k, sum(cast(o_totalprice AS decimal(18,2))) AS cost, count(*) AS n FROM {orders} GROUP BY 1, 2"""


@query("report_flatten", """WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderstatus AS k, sum(cast(o_totalprice AS DECIMAL(18,2))) AS cost, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT m AS timeperiod_start, m || '-28' AS timeperiod_end, k AS status, cast(cost AS VARCHAR) AS cost_amount, 'USD' AS cost_unit, cast(n AS VARCHAR) AS usage_amount, 'N/A' AS usage_unit FROM g
  UNION ALL SELECT m, m || '-28', NULL, cast(sum(cost) AS VARCHAR), 'USD', NULL, NULL FROM g GROUP BY 1""")
def report_flatten(t):
    metric = lambda c, u: F.struct(F.col(c).cast("string").alias("Amount"), F.lit(u).alias("Unit"))
    by_key = t.sql(MONTHLY).withColumn("g", F.struct(F.array("k").alias("keys"), F.create_map(F.lit("Cost"), metric("cost", "USD"), F.lit("Usage"), metric("n", "N/A")).alias("metrics")))
    response = by_key.groupBy("m").agg(F.collect_list("g").alias("groups"), F.sum("cost").alias("cost"))  # one entry per order status
    response = response.select(F.col("m").alias("period_start"), F.concat("m", F.lit("-28")).alias("period_end"), "groups",
                               F.create_map(F.lit("Cost"), metric("cost", "USD")).alias("total"))
    flat = reports.report_flatten(response, ["STATUS"], ["Cost", "Usage"])
    return flat.toDF(*[c.replace(".", "_").lower() for c in flat.columns])


@query("header_rows_zip", """SELECT cast(floor(c_custkey / 100) AS BIGINT) AS page, cast(c_custkey AS VARCHAR) AS id, c_name AS name, NULL::VARCHAR AS missing FROM customer""")
def header_rows_zip(t):
    page = F.floor(F.col("c_custkey") / 100).alias("page")
    even = F.col("page") % 2 == 0
    response = t("customer").groupBy(page).agg(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))).alias("r"))
    response = response.select(
        "page", F.when(even, F.array(F.lit("id"), F.lit("name"))).otherwise(F.array(F.lit("name"), F.lit("id"))).alias("columns"),
        F.transform("r", lambda x: F.when(even, F.array(x["id"], x["name"])).otherwise(F.array(x["name"], x["id"]))).alias("rows"))
    return reports.header_rows_zip(response, ["id", "name", "missing"]).drop("row_pos")


@query("serial_temporal", """WITH s AS (SELECT o_orderkey, o_totalprice / 10 AS v FROM orders) SELECT o_orderkey, strftime(DATE '1970-01-01' + cast(round(v - 25569) AS INTEGER), '%Y-%m-%d') AS d,
  cast(round((v - 25569) * 86400.0::DOUBLE * 1000000.0::DOUBLE) AS BIGINT) AS micros,
  greatest(0, least(cast(round((v - floor(v)) * 86400.0::DOUBLE * 1000000.0::DOUBLE) AS BIGINT), 86399999999)) AS time_micros FROM s""")
def serial_temporal(t):
    v = F.col("o_totalprice") / 10
    return t("orders").select("o_orderkey", F.date_format(landing.serial_to_date(v), "yyyy-MM-dd").alias("d"),
                              landing.serial_to_micros(v).alias("micros"), landing.serial_to_time_micros(v).alias("time_micros"))


def _landed(t):
    rows = t("lineitem").select(
        F.col("l_orderkey").cast("string").alias("key"), F.col("l_quantity").cast("string").alias("qty"), F.col("l_returnflag").alias("flag"),
        F.col("l_partkey").cast("string").alias("ship_serial"), F.when(F.col("l_linenumber") < 0, "x").alias("empty"),
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_tax").cast("string")).alias("tax"))
    return rows


@query("column_type_infer", """SELECT 'key' AS "column", CASE WHEN count(try_cast(l_orderkey::VARCHAR AS BIGINT)) = count(*) THEN 'int' ELSE 'text' END AS type FROM lineitem
  UNION ALL SELECT 'qty', CASE WHEN count(try_cast(CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::VARCHAR || '' ELSE l_quantity::VARCHAR END AS BIGINT)) FILTER (NOT contains(l_quantity::VARCHAR, '.')) = count(*) THEN 'int' WHEN count(try_cast(l_quantity::VARCHAR AS DOUBLE)) = count(*) THEN 'double' ELSE 'text' END FROM lineitem
  UNION ALL SELECT 'flag', CASE WHEN count(try_cast(l_returnflag AS DOUBLE)) = count(*) THEN 'date' ELSE 'text' END FROM lineitem
  UNION ALL SELECT 'ship_serial', CASE WHEN count(try_cast(l_partkey::VARCHAR AS DOUBLE)) = count(*) THEN 'date' ELSE 'text' END FROM lineitem
  UNION ALL SELECT 'empty', CASE WHEN count(*) FILTER (l_linenumber < 0) = 0 THEN 'text' ELSE 'other' END FROM lineitem
  UNION ALL SELECT 'tax', CASE WHEN count(*) FILTER (l_linenumber = 3) > 0 THEN 'text' ELSE 'double' END FROM lineitem""")
def column_type_infer(t):
    return landing.infer_column_types(_landed(t), {"ship_serial": "$date", "flag": "$date"})


@query("landed_cast", """SELECT l_orderkey AS key, l_quantity AS qty, l_returnflag AS flag, strftime(DATE '1970-01-01' + cast(l_partkey - 25569 AS INTEGER), '%Y-%m-%d') AS ship_serial FROM lineitem""")
def landed_cast(t):
    out = landing.cast_landed(_landed(t), {"key": "int", "qty": "double", "ship_serial": "date"})
    return out.select("key", "qty", "flag", F.date_format("ship_serial", "yyyy-MM-dd").alias("ship_serial"))


@query("snapshot_write", """SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderstatus = 'F'""")
def snapshot_write(t):
    snap = snapshots.snapshot_write(t("orders").where("o_orderstatus = 'F'"), shared_dir(t.spark, "snap"))
    return snap.select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))


@query("result_budget", """SELECT * FROM (SELECT 'fits' AS attempt, count(*) AS rows, true AS accepted FROM orders UNION ALL SELECT 'rows', count(*), false FROM orders UNION ALL SELECT 'bytes', count(*), false FROM orders)""")
def result_budget(t):
    out = []
    for name, limits in (("fits", {}), ("rows", {"max_rows": 100}), ("bytes", {"max_bytes": 10})):
        try:
            kept = snapshots.budgeted_snapshot(t("orders"), shared_dir(t.spark, "budget"), **limits)
            out.append((name, kept.count(), True))
        except snapshots.ResultTooLarge as e:
            out.append((name, e.rows, False))
    return t.spark.createDataFrame(out, "attempt string, rows bigint, accepted boolean")


@query("result_budget_early", """SELECT 'fits' AS attempt, count(*) AS rows, true AS accepted, NULL AS about_the_budget FROM orders
  UNION ALL SELECT 'rows', NULL, false, true UNION ALL SELECT 'bytes', NULL, false, true""")
def result_budget_early(t):
    """A result of a hundred times its budget is refused after about the budget's rows; nothing stays behind."""
    total, out = t("orders").count(), []
    rows = t("orders").repartition(4)
    for name, limits in (("fits", {"max_rows": total}), ("rows", {"max_rows": total // 100}), ("bytes", {"max_bytes": 1})):
        try:
            kept = budget.budgeted_write(rows, shared_dir(t.spark, "budget"), **limits)
            out.append((name, kept.count(), True, None))
        except snapshots.ResultTooLarge as e:
            # each of four tasks may be a step beyond, which is a tenth of the budget; bytes are counted with the rows
            out.append((name, None, False, e.rows <= (total // 100) * 1.5 if name == "rows" else e.rows <= total))
    return t.spark.createDataFrame(out, "attempt string, rows bigint, accepted boolean, about_the_budget boolean")


@query("paged_stream", "SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 8 < 5 THEN 0 ELSE 1 END AS run FROM orders WHERE o_totalprice >= 1000")
def paged_stream(t):
    """Pages are the files of a folder; the second run fetches only those that have come since the first."""
    folder, state, out = (shared_dir(t.spark, n) for n in ("pages", "state", "paged"))
    orders = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")

    def put(first, last):
        for page in range(first, last):
            orders.where(F.col("o_orderkey") % 8 == page).coalesce(1).write.parquet(f"{folder}/page={page}")

    schema = "o_orderkey bigint, o_totalprice double, o_orderstatus string"
    for run, (first, last) in enumerate(((0, 5), (5, 8))):
        put(first, last)
        pages = remote.paged_stream(t.spark, remote.folder_page(folder, ["o_orderkey", "o_totalprice", "o_orderstatus"]), schema, remote.folder_pages(folder), where=[("o_totalprice", ">=", 1000.0)])
        query_ = pages.withColumn("run", F.lit(run)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query_.awaitTermination()
    return t.spark.read.parquet(out)


@query("csv_export", """SELECT 'event_id,quoted,nested,value' AS value UNION ALL SELECT event_id || ',"say ""hi"", ' || event_type || '","{""k"":' || json_extract_string(props, '$.k') || '}",'
  || CASE WHEN event_id % 2 = 1 THEN '' WHEN value = floor(value) THEN cast(cast(value AS BIGINT) AS VARCHAR) ELSE cast(value AS VARCHAR) END FROM events""")
def csv_export(t):
    df = t("events").select("event_id", F.concat(F.lit('say "hi", '), "event_type").alias("quoted"), F.from_json("props", "k int").alias("nested"),
                            F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"))
    return t.spark.read.option("lineSep", "\r\n").text(snapshots.csv_export(df, shared_dir(t.spark, "csv")))


@query("grid_roundtrip", """SELECT 'capped' AS grid, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS d FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)
  UNION ALL SELECT 'whole', o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') FROM orders""")
def grid_roundtrip(t):
    df = t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    parts = []
    for name, cap in (("capped", snapshots.GRID_ROWS), ("whole", None)):
        rows, columns = snapshots.to_grid(df, "o_orderkey", cap)
        back = snapshots.from_grid(rows, columns, df.schema)
        parts.append(back.select(F.lit(name).alias("grid"), "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")))
    return parts[0].unionByName(parts[1])


@query("grid_info", """SELECT 'o_orderkey' AS "column", count(*) AS non_null, count(DISTINCT o_orderkey) AS "distinct" FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus) FROM orders""")
def grid_info(t):
    """The profile stored with a grid is that of the uncapped frame."""
    return profile.table_profile(t("orders").select("o_orderkey", "o_orderstatus")).select("column", "non_null", "distinct")


@query("repo_scan")
def repo_scan(t):
    root = shared_dir(t.spark, "tree")
    t("documents").select("doc_id", "lang", "text").write.option("maxRecordsPerFile", 20).partitionBy("lang").json(f"{root}/models")
    t("pages").select(F.concat(F.lit("models: "), "url").alias("value")).write.text(f"{root}/node_modules/x.txt")
    return files.repo_scan(t.spark, root, "tree").select("path", "content_hash", "size_bytes", "extension", "resource_type")


@query("trim_to_data", """SELECT cast(c_custkey + 10 AS BIGINT) AS pos, cast(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer""")
def trim_to_data(t):
    blank = F.lit(None).cast("string")
    body = t("customer").select((F.col("c_custkey") + 10).alias("pos"), F.col("c_custkey").cast("string").alias("a"), blank.alias("b"), F.col("c_name").alias("c"))
    lead = t("region").select(F.col("r_regionkey").cast("bigint").alias("pos"), F.when(F.col("r_regionkey") == 4, "id").alias("a"), blank.alias("b"), F.when(F.col("r_regionkey") == 4, "name").alias("c"))
    return files.trim_to_data(lead.unionByName(body), "pos")


@query("partition_profile", """WITH v AS (SELECT DISTINCT 'year' AS "column", strftime(l_shipdate, '%Y') AS value FROM lineitem UNION SELECT DISTINCT 'month', strftime(l_shipdate, '%m') FROM lineitem),
  s AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS r FROM v)
  SELECT "column", cast(count(*) AS VARCHAR) AS count, string_agg(value, ',' ORDER BY value) FILTER (r <= 5) AS sample, min(value) AS min, max(value) AS max FROM s GROUP BY 1
  UNION ALL SELECT 'cut_' || "column", '>=10', string_agg(value, ',' ORDER BY value) FILTER (r <= 5), NULL, NULL FROM s GROUP BY 1""")
def partition_profile(t):
    specs = t("lineitem").select(F.date_format("l_shipdate", "'year='yyyy/'month='MM").alias("partition")).distinct()
    whole = metastore.partition_profile(specs)
    cut = metastore.partition_profile(specs, limit=10).withColumn("column", F.concat(F.lit("cut_"), "column"))
    return whole.unionByName(cut)


@query("json_cells", """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS nested, event_type AS raw, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at_time FROM events""")
def cells(t):
    df = t("events").select("event_id", F.from_json("props", "k int").alias("nested"), F.encode("event_type", "UTF-8").alias("raw"), F.to_date("ts").alias("day"), F.col("ts").alias("at_time"))
    return json_cells(df)
