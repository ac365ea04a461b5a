"""Pages by rank against pages by offset, and merged sketches against exact profiles."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import paging, profile, rankmap, sketches
from plumbline.session import drop_path, shared_dir


def order():
    return [F.desc_nulls_last("score"), F.asc("id")]


@pytest.fixture(scope="module")
def listing(spark):
    # a third of the rows tie on one score, and some have none
    return spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 1000 == 1, None).otherwise(F.xxhash64("id") % 997).alias("score"), F.concat(F.lit("row "), "id").alias("name"))


@pytest.fixture(scope="module")
def ranked(spark, listing):
    return rankmap.build(listing, order(), shared_dir(spark, "rank-test"), "1", 1000)


@pytest.mark.parametrize("number, size", [(1, 10), (2, 10), (1500, 7), (3000, 10), (3001, 10), (10_000, 3), (10, 2500), (1, 40_000), (50_000, 10)])
def test_pages_like_offset(listing, ranked, number, size):
    want = paging.page(listing, order(), number, size).collect()
    got = ranked.page(number, size).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_page_reads_the_parts_that_hold_it(spark, listing, ranked):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        page = ranked.page(2000, 10)
        assert len(page.collect()) == 10
        leaves = page._jdf.queryExecution().executedPlan().collectLeaves()
        read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
        assert read <= 2 * 1000 + 1000  # one part, or two at a boundary, of about 1,000 rows
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*__part", plan) and "GreaterThanOrEqual(__place" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rank_of_rows(listing, ranked):
    rows = {r.id: r.rank for r in ranked.ranks(F.col("id").isin(7, 9, 1, 29_999)).collect()}
    placed = [r.id for r in listing.orderBy(*order()).collect()]
    assert rows == {i: placed.index(i) for i in (7, 9, 1, 29_999)}


def test_map_of_a_version(spark, listing):
    root = shared_dir(spark, "rank-versions")
    first = rankmap.build(listing, order(), root, "a", 5000)
    again = rankmap.build(listing.limit(0), order(), root, "a", 5000)  # this version is there: nothing is built
    assert again.starts == first.starts and again.total == 30_000
    none = rankmap.build(listing.limit(0), order(), root, "b")
    assert none.total == 0 and none.page(1, 10).count() == 0 and none.slice(0, 5).count() == 0
    assert first.slice(-3, 5).count() == 0 and first.slice(29_998, 5).count() == 2


def test_parts_are_bounded(spark, listing, monkeypatch):
    monkeypatch.setattr(rankmap, "MOST", 6)
    ranked = rankmap.build(listing, order(), shared_dir(spark, "rank-bounded"), "1", 10)
    assert len(ranked.starts) - 1 <= 6 and ranked.total == 30_000
    for number, size in ((1, 10), (1700, 9), (3000, 10)):
        assert [tuple(r) for r in ranked.page(number, size).collect()] == [tuple(r) for r in paging.page(listing, order(), number, size).collect()]


# ---- sketches ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(2)
    rows = [(i, None if i % 11 == 0 else rnd.gauss(5, 3) if i % 3 else 7.0, "abc"[i % 3] if i % 5 else None, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 90_000)), [i % 4], float("nan") if i % 2 else 1.0, None)
            for i in range(20_000)]
    return spark.createDataFrame(rows, "id long, x double, s string, at timestamp, nested array<int>, odd double, nothing int")


def within(merged, exact, df):
    exact = {r["column"]: r for r in exact.collect()}
    for r in merged.collect():
        e = exact[r["column"]]
        assert (r.dtype, r.non_null, r.nulls, r.min, r.max) == (e.dtype, e.non_null, e.nulls, e.min, e.max), r
        for c in ("mean", "std"):
            assert r[c] == (None if e[c] is None else pytest.approx(e[c], rel=1e-9)), r
        assert abs(r.distinct - e.distinct) <= 4 * sketches.DISTINCT_ERROR * e.distinct, r
        if r.quantiles and r["column"] in ("id", "x"):
            values = sorted(v[0] for v in df.select(r["column"]).where(F.col(r["column"]).isNotNull()).collect())
            for p, v in r.quantiles.items():
                below, upto = sum(y < v for y in values) / len(values), sum(y <= v for y in values) / len(values)
                assert below - sketches.RANK_ERROR <= p <= upto + sketches.RANK_ERROR, (r["column"], p)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_merged_profile_within_its_bounds(spark, table, parts):
    root = shared_dir(spark, "sketch-parts")
    for p in range(parts):
        sketches.add_part(table.where(F.col("id") % parts == p), root, str(p))
    within(sketches.merge(sketches.stored(spark, root)), profile.table_profile(table), table)


def test_an_appended_part_is_all_that_is_read(spark, table):
    root, source = shared_dir(spark, "sketch-append"), shared_dir(spark, "sketch-source")
    table.where("id < 15000").write.parquet(f"{source}/old")
    table.where("id >= 15000").write.parquet(f"{source}/new")
    sketches.add_part(spark.read.parquet(f"{source}/old"), root, "old")
    drop_path(spark, f"{source}/old")  # what is sketched is not needed again
    sketches.add_part(spark.read.parquet(f"{source}/new"), root, "new")
    sketches.add_part(spark.read.parquet(f"{source}/new"), root, "new")  # a part that comes again replaces itself
    merged = sketches.merge(sketches.stored(spark, root))
    within(merged, profile.table_profile(table), table)
    some = sketches.merge(sketches.stored(spark, root).where("part = 'new'"))
    within(some, profile.table_profile(table.where("id >= 15000")), table.where("id >= 15000"))


def test_empty_and_small_parts_are_exact(spark, table):
    few = table.where("id < 1000")
    merged = {r["column"]: r for r in sketches.merge(sketches.sketch(few).union(sketches.sketch(few.limit(0)))).collect()}
    exact = {r["column"]: r for r in profile.table_profile(few).collect()}
    assert {c: r.distinct for c, r in merged.items()} == {c: r.distinct for c, r in exact.items()}
    assert merged["nothing"].quantiles is None and merged["nothing"].nulls == 1000 and merged["nothing"].distinct == 0
    assert merged["id"].quantiles[0.5] in (499, 500)
    none = sketches.merge(sketches.sketch(few.limit(0))).collect()
    assert all(r.non_null == 0 and r.distinct == 0 and r.quantiles is None for r in none)


def test_members_of_periods(spark):
    rnd = random.Random(8)
    data = [(rnd.randint(0, 200), rnd.choice("ab"), rnd.randint(0, 27)) for _ in range(3000)] + [(None, "a", 3), (999, "c", 2)]
    events = spark.createDataFrame(data, "user int, kind string, day int")
    units = sketches.member_sketches(events, "user", F.col("day"), ["kind"])
    got = {r.kind: r for r in sketches.period_members(units, {"old": (0, 6), "mid": (7, 13), "new": (14, 20)}, ["kind"]).collect()}
    for kind in "abc":
        of = {n: {u for u, k, d in data if k == kind and a <= d <= b and u is not None} for n, (a, b) in {"old": (0, 6), "mid": (7, 13), "new": (14, 20)}.items()}
        r = got[kind]
        assert (r.old_members, r.mid_members, r.new_members, r.returning) == (len(of["old"]), len(of["mid"]), len(of["new"]), len(of["old"] & of["new"]))
        assert r.old_events == sum(k == kind and 0 <= d <= 6 for _, k, d in data)
