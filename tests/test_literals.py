"""Literal cases with expected numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import money, rowwise, similarity, text, user_code
from plumbline.functions.ranges import previous_period, whole_days
from plumbline.operators import activity, catalog, charts, cost, counters, filters, joins, profile, quota, ranking, reuse, rules
from plumbline.session import shared_dir
from plumbline.sources import documents, files, landing, metastore, remote, snapshots
from plumbline.streaming import incremental, runs

from .conftest import rows


def one(df):
    return rows(df)[0]


# ---- snapshots and handles -----------------------------------------------------
@pytest.fixture(scope="module")
def sales(spark):
    regions = F.element_at(F.array(F.lit("EU"), F.lit("US"), F.lit("APAC")), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(300).select(F.col("id").cast("int").alias("id"), regions.alias("region"), F.col("id").cast("int").alias("amt"))


def test_snapshot_and_handle(spark, sales):
    snap = snapshots.snapshot_write(sales, shared_dir(spark, "t"))
    b = reuse.handle_basics(snap)
    assert (b["rows"], b["columns"]) == (300, ["id", "region", "amt"]) and b["bytes"] > 0
    assert one(reuse.handle_sql(snap, "SELECT sum(amt) FROM data")) == (44850,)
    assert one(reuse.handle_sql(snap, "SELECT count(*), sum(amt) FROM s WHERE id < 100", "s")) == (100, 4950)


def test_empty_snapshot_keeps_schema(spark, sales):
    empty = snapshots.snapshot_write(sales.where("id < 0"), shared_dir(spark, "t"))
    assert [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in sales.schema] and empty.count() == 0


def test_budget_removes_partial_output(spark, sales):
    path = shared_dir(spark, "t")
    with pytest.raises(snapshots.ResultTooLarge) as e:
        snapshots.budgeted_snapshot(sales, path, max_rows=299)
    assert e.value.rows == 300 and e.value.size > 0
    import os
    assert not os.path.exists(path)
    assert snapshots.budgeted_snapshot(sales, path, max_rows=300).count() == 300


def test_handle_sql_restores_the_callers_view(spark, sales):
    spark.range(5).createOrReplaceTempView("data")
    reuse.handle_sql(sales, "SELECT * FROM data")
    assert spark.table("data").count() == 5
    spark.catalog.dropTempView("data")


def test_csv_rules(spark):
    df = spark.createDataFrame([('a,"b"', None, 1), ("x\ny", "", 2)], "t string, e string, n int").withColumn("s", F.struct("n"))
    path = snapshots.csv_export(df.coalesce(1), shared_dir(spark, "t"))
    import glob
    raw = "".join(open(f, newline="", encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*.txt")))
    assert raw == '\ufefft,e,n,s\r\n"a,""b""",,1,"{""n"":1}"\r\n"x\ny",,2,"{""n"":2}"\r\n'


# ---- reuse -----------------------------------------------------------------------
def test_subsumption_runs_unchanged_sql(spark):
    snap = spark.createDataFrame([("EU", 10), ("US", 20), ("EU", 30)], "region string, amt int")
    run = lambda q, complete=True: reuse.answer_from_snapshot(spark, q, "orders", snap, complete)
    assert sorted(rows(run("SELECT region, SUM(amt) FROM orders GROUP BY region"))) == [("EU", 40), ("US", 20)]
    assert sorted(r[0] for r in rows(run("SELECT region FROM orders WHERE amt > 15"))) == ["EU", "US"]
    assert run("SELECT * FROM customers_unknown") is None
    assert run("SELECT region, day FROM orders") is None
    assert run("SELECT * FROM orders", complete=False) is None and run("SELECT * FROM orders").count() == 3


def test_plan_sizes(spark):
    plans = [("sizeInBytes=1 B",), ("sizeInBytes=2 KiB",), ("x sizeInBytes=1.5 GiB y",), ("sizeInBytes=3.0 TiB, sizeInBytes=8.0 EiB",), ("sizeInBytes=8.0 EiB",), ("none",)]
    got = [r[0] for r in rows(spark.createDataFrame(plans, "p string").select(reuse.plan_scan_bytes(F.col("p"))))]
    assert got == [1, 2048, 1610612736, 3 * 1024**4, None, None]


def test_readonly_flags(spark):
    texts = ["SELECT 1", "create table t(a int)", "please create a chart", "select updated_at from t", "REPLACE INTO t VALUES (1)", "CALL f(1)"]
    df = spark.createDataFrame([(t,) for t in texts], "sql_text string")
    got = [(r.read_only, r.read_only_text) for r in reuse.readonly_flag(df).collect()]
    assert got == [(True, True), (False, False), (False, True), (True, True), (False, False), (False, False)]


def test_code_refs(spark):
    code = "a = load_step('Customer Sales'); load_step('Customer Sales'); load_entity(\"Monthly Revenue Model\"); load_step(some_var)"
    got = rows(reuse.code_refs(spark.createDataFrame([(1, code)], "step_id int, code string")).select("kind", "ref"))
    assert sorted(got) == [("entity", "Monthly Revenue Model"), ("step", "Customer Sales")]


# ---- files, documents, landing ---------------------------------------------------
def test_view_names():
    got = files.view_names(["s3://b/dir/Sales Data.parquet", "/x/y/*.csv", "/z/y/*.csv", "plain.csv"])
    assert got == ["Sales_Data", "y", "y_2", "plain"]


def test_trim_without_data(spark):
    df = spark.createDataFrame([(0, None, None)], "i int, a string, b string")
    assert files.trim_to_data(df, "i").count() == 0
    df = spark.createDataFrame([(0, None, None, None), (1, "h", None, None), (2, "v", None, "w")], "i int, a string, b string, c string")
    out = files.trim_to_data(df, "i")
    assert out.columns == ["i", "h", "col_1"] and rows(out) == [(2, "v", "w")]


def test_doc_schema_merges(spark):
    docs = ['{"a": 1, "o": {"x": true}}', '{"a": 2, "l": [{"q": 1.5}], "s": "t"}']
    got = rows(documents.doc_schema(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc"))
    assert sorted(got) == sorted([("a", "integer"), ("o", "object"), ("o.x", "boolean"), ("l", "array"), ("l[].q", "number"), ("s", "string")])


def test_serial_numbers(spark):
    df = spark.createDataFrame([(25569.0,), (25570.0,), (25568.0,), (43466.0,), (25569.5,), (0.5,), (43831.75,), (0.999999999,), (float("nan"),)], "v double")
    v = F.col("v")
    got = rows(df.select(F.datediff(landing.serial_to_date(v), F.lit("1970-01-01").cast("date")), landing.serial_to_micros(v), landing.serial_to_time_micros(v)))
    assert [g[0] for g in got[:4]] == [0, 1, -1, 17897]
    assert got[4][1] == 43_200_000_000 and got[5][2] == 43_200_000_000 and got[6][2] == 64_800_000_000
    assert got[7][2] < 86_400_000_000 and got[8] == (None, None, None)


def test_type_inference(spark):
    df = spark.createDataFrame([("1", "1.5", "x", None, "43831.75", "+2"), ("2", "2", "1", None, "1", "-3")], "i string, d string, t string, e string, ts string, s string")
    got = dict(rows(landing.infer_column_types(df, {"ts": "$timestamp", "t": "$date"})))
    assert got == {"i": "int", "d": "double", "t": "text", "e": "text", "ts": "timestamp", "s": "int"}


def test_partition_profile(spark):
    specs = spark.createDataFrame([("year=2026/month=06/day=01",), ("year=2026/month=06/day=02",), ("year=2026/month=06/day=03",)], "partition string")
    whole = {r.column: (r["count"], r["min"], r["max"]) for r in metastore.partition_profile(specs).collect()}
    assert whole == {"year": ("1", "2026", "2026"), "month": ("1", "06", "06"), "day": ("3", "01", "03")}
    cut = {r.column: (r["count"], r["min"]) for r in metastore.partition_profile(specs, limit=2).collect()}
    assert cut["day"] == (">=2", None)


def test_jdbc_options():
    o = remote.jdbc_options("jdbc:x", query="select 1", column="id", lower=0, upper=100, partitions=8)
    assert o["dbtable"] == "(select 1) q" and o["numPartitions"] == "8" and o["fetchsize"] == "50000" and "query" not in o
    assert remote.jdbc_options("jdbc:x", query="select 1")["query"] == "select 1"
    with pytest.raises(ValueError):
        remote.jdbc_options("jdbc:x")
    with pytest.raises(ValueError):
        remote.jdbc_options("jdbc:x", table="t", column="id")


def test_paged_rows(spark):
    df = remote.paged_scan(spark, lambda page: [{"p": page, "v": f"{page}-{i}"} for i in range(3)], "p int, v string, missing string", 5, pages_per_task=2)
    assert df.count() == 15 and rows(df.agg(F.max("p"), F.count("missing"))) == [(4, 0)]


# ---- spend -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def spend(spark):
    day = dt.datetime(2026, 1, 5)
    raw = [("claude", "anthropic", "Alice", "R1", "planner", 0.003, 0.0075, 0.0105), ("gpt", "openai", "Bob", "R2", "answer", 0.005, 0.015, 0.02),
           ("claude", "anthropic", None, None, "data_source.summary", 0.001, 0.0, 0.001)]
    cols = "model_id string, provider string, user_id string, report_id string, scope string, i double, o double, t double"
    df = spark.createDataFrame(raw, cols).withColumns({
        "model_name": F.col("model_id"), "created_at": F.lit(str(day)).cast("timestamp"), "prompt_tokens": F.lit(1000), "completion_tokens": F.lit(500),
        "cache_read_tokens": F.lit(0), "cache_write_tokens": F.lit(0), "total_tokens": F.lit(1500), "input_cost": F.col("i").cast(money.COST_TYPE),
        "output_cost": F.col("o").cast(money.COST_TYPE), "total_cost": F.col("t").cast(money.COST_TYPE)})
    dims = dict(
        users=spark.createDataFrame([("Alice", "Alice"), ("Bob", "Bob")], "user_id string, user_name string"),
        group_membership=spark.createDataFrame([("G1", "Alice")], "group_id string, user_id string"),
        groups=spark.createDataFrame([("G1", "Group 1")], "group_id string, group_name string"),
        report_source=spark.createDataFrame([("R1", "DS1"), ("R2", "DS1"), ("R2", "DS2")], "report_id string, source_id string"),
        sources=spark.createDataFrame([("DS1", "One"), ("DS2", "Two")], "source_id string, source_name string"))
    return df, dims


@pytest.mark.parametrize("key,want", [
    ("model", {"claude": 0.0115, "gpt": 0.02}), ("provider", {"anthropic": 0.0115, "openai": 0.02}),
    ("user", {"Alice": 0.0105, "Bob": 0.02, "__unattributed__": 0.001}), ("group", {"G1": 0.0105, "__unattributed__": 0.021}),
    ("data_source", {"DS1": 0.0305, "DS2": 0.02, "__unattributed__": 0.001}),
    ("scope", {"planner": 0.0105, "answer": 0.02, "data_source.summary": 0.001})])
def test_attribution(spend, key, want):
    df, dims = spend
    got = {r.key: r.total_cost for r in cost.cost_by(df, key, **dims).collect()}
    assert got == pytest.approx(want)
    kpi = cost.cost_kpi(df).first()
    assert (kpi.total_calls, kpi.total_cost_usd) == (3, 0.0315)


def test_daily_series_adds_up_over_any_range(spend):
    df, _ = spend
    daily = cost.cost_daily(df, dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 10))
    assert daily.count() == 10 and one(daily.agg(F.round(F.sum("cost_usd"), 6))) == (0.0315,)
    assert cost.cost_daily(df, dt.datetime(2020, 1, 1), dt.datetime(2026, 1, 10)).count() == 2202
    assert cost.cost_daily(df, dt.datetime(2020, 1, 1), dt.datetime(2026, 1, 10), most=401).count() == 401


def test_prices(spark):
    df = spark.createDataFrame([("anthropic",), ("openai",), ("google",), ("custom",)], "p string")
    price = money.input_cost(F.col("p"), F.lit(10.0), F.lit(1000), F.lit(400), F.lit(800))
    assert [float(r[0]) for r in rows(df.select(price))] == [0.0204, 0.008, 0.015, 0.01]
    floor = money.input_cost(F.lit("openai"), F.lit(10.0), F.lit(0), F.lit(400), F.lit(0))
    assert float(one(df.limit(1).select(floor))[0]) == 0.0
    assert float(one(df.limit(1).select(money.input_cost(F.lit("x"), F.lit(None).cast("double"), F.lit(5), F.lit(0), F.lit(0))))[0]) == 0.0


def test_ranges():
    lo, hi = whole_days(None, dt.datetime(2024, 3, 31, 5))
    assert lo == dt.datetime(2024, 3, 1) and hi == dt.datetime(2024, 3, 31, 23, 59, 59, 999999)
    assert previous_period(dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 10)) == (dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 8))


def test_carry_forward(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 0.0, 5.0, 0.0, 3.0, 0.0])], "k string, d int, v double")
    got = [r[0] for r in rows(activity.carry_forward(df, ["k"], "d", ["v"]).orderBy("d").select("v"))]
    assert got == [0, 0, 5, 5, 3, 3]


def test_table_pairs_count_a_query_once(spark):
    at = dt.datetime(2024, 1, 1)
    data = [(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (4, "a"), (4, "b"), (4, "c")]
    use = spark.createDataFrame([(s, n, at) for s, n in data], "step_id int, table_fqn string, used_at timestamp")
    got = {(r.table_a, r.table_b): (r.together, r.queries_analysed) for r in activity.table_pairs(use, at, at).collect()}
    assert got == {("a", "b"): (3, 3), ("a", "c"): (1, 3), ("b", "c"): (1, 3)}


# ---- filters and charts --------------------------------------------------------------
CASES = {  # value: equals x, not_equals x, gte 0, less_than 1, before 2000, is_empty
    None: (False, True, True, True, True, True), "": (False, True, True, True, False, True),
    "abc": (False, True, False, False, False, False), "X": (True, False, False, False, False, False)}


def test_coercion_table(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "c string")
    conds = [("equals", "x"), ("not_equals", "x"), ("gte", 0), ("less_than", 1), ("before", "2000-01-01"), ("is_empty", None)]
    got = rows(df.select("c", *[filters.condition(df, {"column": "C", "operator": o, "value": v}).alias(o) for o, v in conds]))
    assert {g[0]: g[1:] for g in got} == CASES
    num = spark.createDataFrame([(5,)], "c int")
    got = one(num.select(*[filters.condition(num, {"column": "c", "operator": o, "value": v}) for o, v in conds]))
    assert got == (False, True, True, False, True, False)


def test_sql_mode_and_unknowns(spark):
    df = spark.createDataFrame([(None,), ("a",)], "c string")
    keep = lambda cond, **kw: df.where(filters.condition(df, cond, **kw)).count()
    assert keep({"column": "c", "operator": "not_equals", "value": "z"}) == 2
    assert keep({"column": "c", "operator": "not_equals", "value": "z"}, mode="sql") == 1
    assert keep({"column": "c", "operator": "surprise", "value": 1}) == 2
    assert keep({"column": "gone", "operator": "equals", "value": "undefined"}) == 2
    assert keep({"column": "gone", "operator": "gte", "value": 0}) == 0


def test_groups_for_other_charts(spark):
    df = spark.range(4).withColumnRenamed("id", "n")
    other = [[{"column": "b:n", "operator": "equals", "value": 1}]]
    assert filters.apply_filters(df, other, chart="a").count() == 4
    mixed = [[{"column": "a:n", "operator": "equals", "value": 1}], [{"column": "b:n", "operator": "equals", "value": 9}]]
    assert filters.apply_filters(df, mixed, chart="a").count() == 4
    assert filters.apply_filters(df, [], chart="a").count() == 4


def test_metric_rules(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "abc"), (3, "5"), (4, "X")], "p int, v string")
    assert one(charts.metric_card(df, "v", "p", "sum")) == (5.0,)
    assert one(charts.metric_card(df, "v", "p", "count")) == (3.0,)
    assert one(charts.metric_card(df, "v", "p")) == (None,)
    assert one(charts.metric_card(df.where("p > 2"), "V", "p", "avg", comparison="p")) == (5.0, 3)


def test_group_by_forms():
    got = [charts.normalize_group_by(v) for v in ("genre", ["genre"], ["genre", "country"], [], "", None, 123)]
    assert got == ["genre", "genre", "genre", None, None, None, None]


def test_formats(spark):
    df = spark.createDataFrame([(1234567.891,), (0.5,), (-1234.5,), (999960.0,), (None,)], "v double")
    got = lambda kind: [r[0] for r in rows(df.select(charts.format_value(F.col("v"), kind)))]
    assert got("number") == ["1,234,567.89", "0.5", "-1,234.5", "999,960", "—"]
    assert got("currency") == ["$1,234,567.89", "$0.5", "-$1,234.5", "$999,960", "—"]
    assert got("percent") == ["1,234,567.9%", "0.5%", "-1,234.5%", "999,960%", "—"]
    assert got("compact") == ["1.2M", "0.5", "-1.2K", "1M", "—"]
    short = [r[0] for r in rows(df.select(charts.format_short(F.col("v"))))]
    assert short == ["1.2M", "0.5", "-1.2K", "1000.0K", "—"]


def test_treemap_cycle_is_refused(spark):
    df = spark.createDataFrame([("a", "b", "A", 1.0), ("b", "a", "B", 2.0)], "id string, parentid string, name string, value double")
    with pytest.raises(ValueError):
        charts.treemap_totals(charts.treemap(df, "id", "parentid", "name", "value"))


# ---- catalog, profile ------------------------------------------------------------------
def cols(spark, data):
    return spark.createDataFrame(data, "table_name string, col_name string, dtype string")


def test_drift(spark):
    old = cols(spark, [("users", "id", "int"), ("orders", "id", "int"), ("orders", "x", "int")])
    new = cols(spark, [("users", "id", "int"), ("users", "email", "string"), ("products", "id", "int"), ("orders", "x", "int"), ("orders", "id", "int")])
    assert rows(catalog.schema_drift(old, new)) == [("products", "added"), ("users", "changed")]
    assert catalog.schema_drift(old.limit(0), new).count() == 0


def test_sync_keeps_selection(spark):
    existing = spark.createDataFrame([(1, 10, "users", True, "o"), (2, 11, "orders", True, "o"), (3, None, "items", True, "o"), (4, None, "users", True, "o")],
                                     "row_id int, link_id int, name string, is_active boolean, signature string")
    incoming = spark.createDataFrame([(10, "users", "n"), (12, "items", "n"), (13, "new", "n")], "table_id int, name string, signature string")
    got = {r.name: (r.row_id, r.link_id, r.is_active, r.action) for r in catalog.catalog_sync(existing, incoming, False).collect()}
    assert got == {"users": (1, 10, True, "refreshed"), "orders": (2, 11, False, "missing"), "items": (3, 12, True, "adopted"), "new": (None, 13, False, "inserted")}


def test_profile_numbers(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "a", float("nan")), (4, None, 4.0)], "i int, s string, d double")
    p = {r.column: r for r in profile.table_profile(df).collect()}
    assert (p["i"].q25, p["i"].q50, p["i"].q75, p["i"].distinct) == (1.75, 2.5, 3.25, 4)
    assert (p["s"].non_null, p["s"].nulls, p["s"].distinct, p["s"].freq) == (3, 1, 2, 2)
    assert (p["d"].non_null, p["d"].nulls, p["d"].mean, p["d"].q50) == (2, 2, 2.5, 2.5)
    assert rows(profile.modes(df.select("s"))) == [("s", "a", 2)]
    approx = {r.column: r.distinct for r in profile.table_profile(df, distinct="approx").collect()}
    assert approx["i"] == 4


def test_payload_and_breakdown(spark):
    df = spark.createDataFrame([(i, c) for i, c in ((1, "x"), (2, "y"), (3, "z"))], "a int, b string")
    got = profile.render_table(df, "a", 10).first()
    assert (got.payload, got.row_count, got.col_count, got.truncated) == ("a,b\n1,x\n2,y\n3,z", 3, 2, False)
    assert profile.render_table(spark.range(100), "id", 5).first().truncated
    t = profile.render_text(spark.createDataFrame([("x" * 1000,)], "t string"), "t", 100).first()
    assert (len(t.t), t.n_chars, t.truncated) == (100, 1000, True)
    tall = spark.createDataFrame([("jan", "rock", 1.0), ("jan", "pop", 2.0)], "month string, genre string, total double")
    b = profile.breakdown_check(tall, "month", ["total"]).first()
    assert (b.unplotted, b.rows, b.distinct_x, b.needs_breakdown) == ("genre", 2, 1, True)


# ---- joins ------------------------------------------------------------------------------
def test_suffix_and_latest(spark):
    short = spark.createDataFrame([("Orders",), ("db.ITEMS",), ("rders",)], "n string")
    full = spark.createDataFrame([("db.orders",), ("x.db.items",), ("orders",), ("db.xorders",)], "f string")
    assert sorted(rows(joins.suffix_match(short, full, "n", "f"))) == [("Orders", "db.orders"), ("Orders", "orders"), ("db.ITEMS", "x.db.items")]
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c")], "k int, t int, v string")
    assert sorted(r.v for r in joins.latest_rows_by_max(df, "k", "t").collect()) == ["b", "c"]


# ---- text and ranking ----------------------------------------------------------------------
def test_names_and_labels(spark):
    df = spark.createDataFrame([("order_totalUSD",), ("aB_c",)], "n string")
    assert [r[0] for r in rows(df.select(text.column_label("n")))] == ["Order Total Usd", "A B C"]
    names = spark.createDataFrame([(0, "My File!"), (1, "my-file"), (2, "MY_FILE"), (3, "__")], "i int, n string").select("i", text.safe_name("n").alias("s"))
    got = rows(text.number_duplicates(names, "s", "i", "u").orderBy("i").select("u"))
    assert got == [("my_file",), ("my_file_2",), ("my_file_3",), ("table",)]


def test_sources_and_lineage(spark):
    df = spark.createDataFrame([("SUM(dvd.payment.amount)",), ("customer.name",), ("plain",), ("",)], "s string")
    assert [r[0] for r in rows(df.select(text.table_of_source("s")))] == ["dvd.payment", "customer", None, None]
    refs = spark.createDataFrame([("sum(main.orders.amt) / items.qty + lower.x",)], "s string").select(text.lineage_refs("s"))
    assert [tuple(x) for x in refs.first()[0]] == [("orders", "amt"), ("items", "qty")]


def test_json_recovery(spark):
    body = '{"a": {"b": "}"}}'
    texts = [body, f"```json\n{body}\n```", f"Sure! {body} and {{more}}", "garbage", "[1, 2]", '{"a": ', None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r[0] for r in rows(df.select(text.json_object_in("t")))]
    assert got == ['{"a":{"b":"}"}}'] * 3 + [None] * 4


def test_markdown(spark):
    md = "---\nalwaysApply: false\n---\n\n# Title here\n## Sub\nFirst line\nsecond line\n\nother"
    m = spark.createDataFrame([(md,), ("no heading",)], "t string").select(text.front_matter("t").alias("m")).select("m.*").collect()
    assert (m[0].front, m[0].title, m[0].description) == ("alwaysApply: false", "Title here", "First line second line")
    assert (m[1].front, m[1].title, m[1].description) == (None, None, "no heading")


def test_blend_and_related_order(spark):
    df = spark.createDataFrame([(0.4, None), (0.4, 0.8)], "k double, s double")
    assert [round(r[0], 9) for r in rows(df.select(similarity.blend(F.col("k"), F.col("s"))))] == [0.4, 0.6]
    items = spark.createDataFrame([("a", "quarterly sales revenue by region"), ("b", "unrelated revenue note")], "item_id string, text string")
    sem = spark.createDataFrame([("a", 0.9), ("b", 0.0)], "item_id string, semantic double")
    assert [r.item_id for r in ranking.related(items, ["revenue"], None, 5, sem).collect()] == ["a", "b"]


def test_guidance_slots(spark):
    data = [(1, "always on", "c", "always"), (2, "sales revenue", "c", "intelligent"), (3, "sales", "c", "intelligent"), (4, "cats", "c", "intelligent")]
    items = spark.createDataFrame(data, "item_id int, text string, category string, load_mode string")
    assert sorted(r.item_id for r in ranking.guidance_search(items, "sales revenue", 2).collect()) == [1, 2]
    assert sorted(r.item_id for r in ranking.guidance_search(items, "", 10).collect()) == [1, 2, 3, 4]
    assert sorted(r.item_id for r in ranking.guidance_search(items, "the of", 10).collect()) == [1]


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0])], "id int, v array<double>")
    got = {(r.query, r.id): round(r.score, 6) for r in similarity.cosine_topk(v, "id", "v", spark.createDataFrame([("q", [3.0, 0.0])], "query string, vector array<double>"), 3).collect()}
    assert got == {("q", 1): 1.0, ("q", 5): 0.707107, ("q", 2): 0.0}


# ---- rules, quotas, user code -----------------------------------------------------------------
def test_rule_matchers(spark):
    df = spark.createDataFrame([("Hello\nworld",)], "v string")
    text_cases = [("text.contains", "hello", False), ("text.contains", "Hello", True), ("text.regex", "/HELLO/i", True), ("text.regex", "", True),
                  ("text.regex", "*", True), ("text.regex", "(", False), ("text.regex", "/^world/m", True), ("text.equals", "Hello", False), ("other", "x", True)]
    got = one(df.select(*[rules.match_text(F.lit(k), F.col("v"), F.lit(w)).alias(f"c{i}") for i, (k, w, _) in enumerate(text_cases)]))
    assert got == tuple(w for *_, w in text_cases)
    none = F.lit(None).cast("string")
    empty, ab = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    got = one(df.select(rules.match_text(F.lit("text.not_contains"), none, F.lit("x")), rules.match_number(F.lit("gt"), F.lit("x"), F.lit(1)),
                        rules.match_number(F.lit("weird"), F.lit(1), F.lit(1)), rules.match_list(F.lit("list.contains_any"), none.cast("array<string>") if False else ab, empty),
                        rules.match_list(F.lit("list.contains_all"), ab, F.array(F.lit("a"), F.lit("z"))), rules.match_length(F.lit("gt"), F.col("v"), F.lit(50))))
    assert got == (False, False, True, True, False, False)


def test_limits_literal(spark):
    pol = spark.createDataFrame([("group", 1, 7, 100, 1000, None)], "level string, policy_id int, principal_id int, max_queries int, max_bytes bigint, max_tokens bigint")
    who = spark.createDataFrame([(5, "group", 7), (6, "group", 8)], "user_id int, level string, principal_id int")
    over = spark.createDataFrame([(1, 100, 12, 120)], "policy_id int, connection_id bigint, max_queries int, max_bytes bigint")
    lim = quota.limits_resolve(pol, who, over)
    pairs = spark.createDataFrame([(5, 100), (5, 200), (6, 100)], "user_id int, connection_id bigint")
    got = {(r.user_id, r.connection_id): (r.max_queries, r.max_bytes, r.max_tokens) for r in quota.connection_limits(lim, pairs).collect()}
    assert got == {(5, 100): (12, 120, None), (5, 200): (100, 1000, None), (6, 100): (None, None, None)}
    assert {r.user_id: r.source for r in lim.where("connection_id IS NULL").collect()} == {5: "inherited", 6: "default"}


def test_user_functions(spark):
    step = spark.range(3)
    assert user_code.generate_df(lambda load_step: load_step("top rows"), spark, {}, steps={"Top Rows": step}).count() == 3
    with pytest.raises(user_code.MissingResult, match="Top Rows"):
        user_code.generate_df(lambda load_step: load_step("other"), spark, {}, steps={"Top Rows": step})
    with pytest.raises(TypeError):
        user_code.generate_df(lambda views: 42, spark, {})
    with pytest.raises(TypeError):
        user_code.generate_df(lambda mystery: step, spark, {})


def test_event_weights(spark):
    at = dt.datetime(2024, 1, 1)
    data = [(1, "s", "t", True, "u", "Admin", at), (1, "s", "t", False, "u", "viewer", at), (2, "s", "t", True, None, "zzz", at)]
    use = spark.createDataFrame(data, "step_id int, source_id string, table_fqn string, success boolean, user_id string, role string, used_at timestamp")
    r = counters.usage_stats(use).first()
    assert (r.usage, r.successes, r.failures, r.weighted_usage, r.trusted_usage, r.user_uses, r.distinct_users) == (3, 2, 1, 2.5, 1, 1, 1)
    assert counters.one_event_per_step(use).count() == 2


# ---- pages ----------------------------------------------------------------------------------------
def test_page_parts():
    html = ("<html><head><title> A &amp; B </title><meta name='description' content='d'><meta property='og:title' content='o'>"
            "<script type='application/ld+json'>[{\"x\": 1}, 2]</script><script>var a='<p>no</p>'</script></head>"
            "<body><nav>menu</nav><h1>Head <b>one</b></h1><p>Text   here</p><style>x{}</style><h2></h2><footer>f</footer>tail</body></html>")
    p = rowwise.page_parts(html)
    assert (p["title"], p["description"], p["headings"], p["json_ld"]) == ("A & B", "d", ["Head one"], ['{"x": 1}'])
    assert p["metadata"] == {"description": "d", "og:title": "o"} and p["text"].split("\n") == ["Head", "one", "Text here", "tail"]


# ---- streams --------------------------------------------------------------------------------------
def test_stream_quota_over_several_batches(spark):
    start = dt.datetime(2024, 1, 30)
    data = [(i, i % 2, start + dt.timedelta(hours=i), 10) for i in range(96)]
    events = spark.createDataFrame(data, "event_id int, user_id int, ts timestamp, bytes bigint")
    path = shared_dir(spark, "events")
    for lo in range(0, 96, 24):  # four files in time order
        events.where((F.col("event_id") >= lo) & (F.col("event_id") < lo + 24)).coalesce(1).write.mode("append").parquet(path)
    limits = spark.createDataFrame([(0, 125), (1, None)], "user_id int, limit bigint")
    batch = sorted(rows(quota.quota_breach(events, limits, ["user_id"], "bytes").select("user_id", "event_id", "used")))
    totals, breaches = incremental.stream_quota(runs.file_stream(spark, path, files_per_batch=1), limits, ["user_id"], "bytes")
    assert sorted(rows(breaches.select("user_id", "event_id", "used"))) == batch
    assert one(totals.agg(F.sum("used"))) == (960,)


def test_incremental_index_embeds_changes_only(spark):
    path, index, state = shared_dir(spark, "docs"), shared_dir(spark, "idx"), shared_dir(spark, "state")
    embed = lambda c: F.array(F.length(c).cast("double"))
    for batch in ([(1, "one"), (2, "two")], [(2, "two"), (3, "three"), (1, "changed")]):
        spark.createDataFrame(batch, "item_id int, text string").coalesce(1).write.mode("append").parquet(path)
        got = incremental.incremental_index(runs.file_stream(spark, path), embed, path=index, checkpoint=state)
    assert {r.item_id: r.embedding[0] for r in got.collect()} == {1: 7.0, 2: 3.0, 3: 5.0}
    assert spark.read.parquet(index).count() == 4


def test_replayed_batches_change_nothing(spark):
    """The commit of the last batch is lost: it runs again and must not erase or repeat anything."""
    import pathlib

    root = shared_dir(spark, "replay")
    src, state = f"{root}/src", f"{root}/state"
    use = "step_id int, table_fqn string, source_id int, success boolean, user_id int, role string, used_at timestamp"
    at = dt.datetime(2024, 1, 1)
    batches = ([(1, "t", 1, True, 5, "admin", at), (2, "t", 1, False, 5, "viewer", at)], [(1, "t", 1, True, 5, "admin", at + dt.timedelta(days=9)), (3, "u", 1, True, None, "x", at)])

    def lose_last_commit():
        commits = sorted((p for p in pathlib.Path(state, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
            p.unlink(missing_ok=True)

    for b in batches:
        spark.createDataFrame(b, use).coalesce(1).write.mode("append").parquet(src)
        got = incremental.stream_usage_stats(runs.file_stream(spark, src), path=f"{root}/first", checkpoint=state)
    batch = counters.one_event_per_step(spark.read.parquet(src)).groupBy("source_id", "table_fqn").agg(*counters.usage_aggs())
    assert sorted(rows(got)) == sorted(rows(batch)) and batch.agg(F.sum("usage")).first()[0] == 3
    lose_last_commit()
    again = incremental.stream_usage_stats(runs.file_stream(spark, src), path=f"{root}/first", checkpoint=state)
    assert sorted(rows(again)) == sorted(rows(batch))


def test_replayed_index_keeps_its_batch(spark):
    import pathlib

    root = shared_dir(spark, "replay-index")
    embed = lambda c: F.array(F.length(c).cast("double"))
    spark.createDataFrame([(1, "one", 1), (1, "longer", 2), (2, "two", 1)], "item_id int, text string, at int").coalesce(1).write.parquet(f"{root}/src")
    index = lambda: incremental.incremental_index(runs.file_stream(spark, f"{root}/src"), embed, order="at", path=f"{root}/idx", checkpoint=f"{root}/state")
    want = {1: 6.0, 2: 3.0}
    assert {r.item_id: r.embedding[0] for r in index().collect()} == want
    for p in pathlib.Path(f"{root}/state/commits").iterdir():
        p.unlink()
    assert {r.item_id: r.embedding[0] for r in index().collect()} == want


def test_stream_reads_fail_loudly(spark):
    path = shared_dir(spark, "ledger")
    ledger = runs.Ledger(spark, path, "k int, n bigint")
    assert ledger.before(None).count() == 0
    for i in range(4):
        ledger.replace(spark.createDataFrame([(1, i)], "k int, n bigint"), i)
    assert one(ledger.before(None)) == (1, 3) and one(ledger.before(3)) == (1, 2) and ledger.before(1).count() == 0
    spark.createDataFrame([("x",)], "k string").write.mode("overwrite").json(f"{path}/v=4")
    with pytest.raises(Exception):
        ledger.before(None).collect()


def test_find_operators(spark):
    data = [(1, ["a", "b"], [(1, "x"), (5, "y")]), (2, ["b"], [(9, "x")]), (3, None, None), (4, [], [])]
    docs = spark.createDataFrame(data, "_id int, tags array<string>, items array<struct<q:int,k:string>>")
    find = lambda spec, **more: [r._id for r in documents.doc_find(docs, {"find": spec, "sort": {"_id": 1}, **more}).collect()]
    assert find({"tags": "b"}) == [1, 2] and find({"tags": ["b"]}) == [2] and find({"tags": {"$all": ["a", "b"]}}) == [1]
    assert find({"tags": {"$size": 1}}) == [2] and find({"tags": {"$not": {"$size": 1}}}) == [1, 3, 4] and find({"tags": {"$nin": ["a"]}}) == [2, 3, 4]
    assert find({"items": {"$elemMatch": {"q": {"$gt": 4}, "k": "x"}}}) == [2] and find({"$nor": [{"tags": "a"}]}) == [2, 3, 4]
    assert find({}, limit=0) == find({}, limit=None) == [1, 2, 3, 4] and find({}, limit=2) == [1, 2]
    out = documents.doc_aggregate(docs, [{"$unwind": "$tags"}, {"$group": {"_id": {"t": "$tags"}, "ids": {"$addToSet": "$_id"}}}, {"$sort": {"_id": 1}}]).collect()
    assert [tuple(r) for r in out] == [('{"t":"a"}', "[1]"), ('{"t":"b"}', "[1,2]")]


def test_vector_filters(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.1]), (3, "a", [0.0, 1.0])], "id int, org string, v array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("w", [1.0, 0.0, 0.0])], "query string, vector array<double>")
    top = lambda **more: sorted(r.id for r in similarity.cosine_topk(v, "id", "v", q, 2, **more).collect())
    assert top() == [1, 2] and top(where={"org": "a"}) == [1, 3] and top(ids=[3]) == [3] and top(ids=[]) == []


def test_daily_series_of_any_length(spark):
    start = dt.datetime(2020, 1, 1)
    data = [(start + dt.timedelta(days=i), 1.0, 1) for i in range(500)]
    usage = spark.createDataFrame(data, "created_at timestamp, total_cost double, total_tokens int")
    daily = cost.cost_daily(usage, start, start + dt.timedelta(days=499))
    assert one(daily.agg(F.count("*"), F.sum("tokens"))) == (500, 500)


def test_tree_rules(spark, tmp_path):
    (tmp_path / "models").mkdir()
    for name, body in (("models/a.SQL", "select 1"), ("models/b.sql", "select 2"), ("dbt_project.yml", "name: p"), ("models/skip.sql", "x"), ("big.md", "y" * 300_000)):
        (tmp_path / name).write_text(body)
    got = {r.path: (r.resource_type, r.skipped) for r in files.repo_scan(spark, str(tmp_path), "t", ignore=["# note", "skip.sql"]).collect()}
    assert got == {"t/models/a.SQL": ("dbt_model", None), "t/models/b.sql": ("dbt_model", None), "t/dbt_project.yml": ("yaml_file", None), "t/big.md": ("markdown_document", None)}
    got = {r.path: (r.skipped, r.text is None) for r in files.repo_scan(spark, str(tmp_path), "t", max_bytes=1000).collect()}
    assert got["t/big.md"] == ("too_large", True) and got["t/models/skip.sql"] == (None, False)
