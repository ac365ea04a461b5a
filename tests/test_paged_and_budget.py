"""Paged sources that go on from a checkpoint and take filters; results refused while they are written."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.session import shared_dir
from plumbline.sources import budget, remote
from plumbline.sources.snapshots import ResultTooLarge


def source(folder):
    """A source of pages as files that a test adds, and a log of what was fetched."""
    os.makedirs(folder, exist_ok=True)

    def pages():
        return len([n for n in os.listdir(folder) if n.startswith("p")])

    def fetch(page, where=None):
        with open(f"{folder}/log", "a") as f:
            f.write(f"{page} {where}\n")
        rows = [{"page": page, "x": page * 10 + i} for i in range(10)]
        return [r for r in rows if not where or all(op != ">=" or r[c] >= v for c, op, v in where)]

    return pages, fetch, lambda n: open(f"{folder}/p{n}", "w").close(), lambda: [line.strip() for line in open(f"{folder}/log")] if os.path.exists(f"{folder}/log") else []


def run(stream, out, state):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_second_run_fetches_new_pages_only(spark, tmp_path):
    pages, fetch, add, log = source(str(tmp_path / "src"))
    out, state = (shared_dir(spark, n) for n in ("paged-out", "paged-state"))
    stream = lambda where=None: remote.paged_stream(spark, fetch, "page int, x int", pages, pages_per_task=2, where=where)
    for n in range(5):
        add(n)
    run(stream(), out, state)
    assert sorted(log()) == [f"{n} None" for n in range(5)]
    run(stream(), out, state)  # nothing new
    assert len(log()) == 5
    for n in range(5, 8):
        add(n)
    run(stream(), out, state)
    assert sorted(log()[5:]) == [f"{n} None" for n in range(5, 8)]
    rows = spark.read.parquet(out)
    assert rows.count() == 80 and rows.select("x").distinct().count() == 80
    # the commit of the last batch is lost: the same pages come again and are not doubled by the sink
    for name in os.listdir(f"{state}/commits"):
        if name.strip(".crc").isdigit() and int(name.strip(".crc")) == max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit()):
            os.remove(f"{state}/commits/{name}")
    run(stream(), out, state)
    assert spark.read.parquet(out).count() == 80


def test_comparisons_reach_the_fetch(spark, tmp_path):
    pages, fetch, add, log = source(str(tmp_path / "src"))
    for n in range(3):
        add(n)
    out = shared_dir(spark, "paged-where")
    run(remote.paged_stream(spark, fetch, "page int, x int", pages, where=[("x", ">=", 15)]), out, shared_dir(spark, "paged-where-state"))
    assert spark.read.parquet(out).agg(F.min("x"), F.count("*")).first()[:] == (15, 15)
    assert set(log()) == {f"{n} [('x', '>=', 15)]" for n in range(3)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = remote.paged_scan(spark, fetch, "page int, x int", 3, filtered=True).where("x >= 25 AND x < 28")
        assert sorted(r.x for r in got.collect()) == [25, 26, 27]
        assert all("('x', '>=', 25)" in line and "('x', '<', 28)" in line for line in log()[-3:])
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    plain = remote.paged_scan(spark, fetch, "page int, x int", 3, filtered=True).where("x >= 25")
    assert plain.count() == 5 and sorted(log()[-3:]) == ["0 []", "1 []", "2 []"]


def left(path):
    return os.path.exists(path)


def test_a_result_far_over_budget_stops_early(spark):
    rows = spark.range(2_000_000, numPartitions=8).select("id", F.concat(F.lit("row "), "id").alias("name"))
    path = shared_dir(spark, "budget-far")
    with pytest.raises(ResultTooLarge) as e:
        budget.budgeted_write(rows, path, max_rows=20_000)
    # eight tasks write at once, each a step of 2,000 beyond its last count at most
    assert 20_000 < e.value.rows <= 20_000 + 8 * 2 * 2000 and not left(path)
    with pytest.raises(ResultTooLarge):
        budget.budgeted_write(rows, path, max_bytes=100_000)
    assert not left(path)


def test_a_result_within_budget_is_whole(spark):
    import datetime as dt
    import decimal

    data = [(i, None if i % 3 else f"é{i}", dt.datetime(2024, 1, 1, i % 24), dt.date(2024, 1, 1 + i % 28), decimal.Decimal(i) / 4, [i, None], {"a": i}, (i, "x")) for i in range(1000)]
    df = spark.createDataFrame(data, "i long, s string, t timestamp, d date, m decimal(10,2), l array<int>, k map<string,int>, n struct<a:int,b:string>").repartition(5)
    path = shared_dir(spark, "budget-fits")
    back = budget.budgeted_write(df, path, max_rows=1000, max_bytes=10_000_000)
    assert back.schema == df.schema and back.select("i", "s", "t", "d", "m", "l", "n").exceptAll(df.select("i", "s", "t", "d", "m", "l", "n")).isEmpty() and back.count() == 1000
    assert not left(f"{path}/_writing")
    with pytest.raises(FileExistsError):
        budget.budgeted_write(df, path)
    none = budget.budgeted_write(df.limit(0), shared_dir(spark, "budget-none"), max_rows=0)
    assert none.count() == 0 and none.schema == df.schema
    with pytest.raises(ResultTooLarge):
        budget.budgeted_write(df, shared_dir(spark, "budget-one"), max_rows=999)


def test_a_failed_write_leaves_nothing(spark):
    path = shared_dir(spark, "budget-fails")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        budget.budgeted_write(spark.range(1000, numPartitions=4).select((F.lit(1) / (F.col("id") - 900)).alias("x")), path, max_rows=10_000)
    assert not left(path)
