"""Streams that go on after a lost checkpoint, a replay or another stream, and state that event time bounds."""

import datetime as dt
import pathlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import counters, quota
from plumbline.session import shared_dir
from plumbline.streaming import eventtime, incremental, runs

START = dt.datetime(2024, 1, 29)


def write(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lose_last_commit(state):
    commits = sorted((p for p in pathlib.Path(state, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)


USE = "step_id int, table_fqn string, source_id int, success boolean, user_id int, role string, used_at timestamp"
BYTES = "event_id int, user_id int, ts timestamp, bytes bigint"
SPENT = "created_at timestamp, total_cost decimal(20,4), total_tokens bigint"
TEXTS = "item_id int, text string"


def usage_data(day):
    return [(day * 10 + i - day, f"t{i % 3}", i % 2, i % 4 > 0, i, "admin", START + dt.timedelta(days=day, hours=i)) for i in range(10)]  # one step a day comes again


def byte_data(day):
    return [(day * 20 + i, i % 3, START + dt.timedelta(days=day, hours=i), 10) for i in range(20)]


def spent_data(day):
    return [(START + dt.timedelta(days=(day + i) % 6), Decimal(day + i), 1) for i in range(5)]  # late rows, too


def text_data(day):
    return [(i, f"text {i} {(day + i) // 4}") for i in range(8)]


def embed(c):
    return F.array(F.length(c).cast("double"))


LIMITS = [(0, 200), (1, 10_000), (2, 155)]


class Form:
    def __init__(self, spark, kind):
        self.spark, self.kind = spark, kind
        self.root = shared_dir(spark, f"form-{kind}")
        self.data, self.schema = {"usage": (usage_data, USE), "quota": (byte_data, BYTES), "daily": (spent_data, SPENT), "index": (text_data, TEXTS)}[kind]

    def put(self, source, day):
        write(self.spark, f"{self.root}/{source}", self.data(day), self.schema)

    def run(self, source, checkpoint):
        stream = runs.file_stream(self.spark, f"{self.root}/{source}")
        args = {"path": f"{self.root}/out", "checkpoint": f"{self.root}/{checkpoint}"}
        if self.kind == "usage":
            return sorted_rows(incremental.stream_usage_stats(stream, **args))
        if self.kind == "daily":
            return sorted_rows(incremental.stream_daily_cost(stream, **args))
        if self.kind == "index":
            return sorted_rows(incremental.incremental_index(stream, embed, **args))
        limits = self.spark.createDataFrame(LIMITS, "user_id int, limit bigint")
        totals, found = incremental.stream_quota(stream, limits, ["user_id"], "bytes", **args)
        return sorted_rows(totals), sorted_rows(found.select("user_id", "event_id", "used"))

    def batch(self, days):
        df = self.spark.createDataFrame([r for d in days for r in self.data(d)], self.schema)
        if self.kind == "usage":
            return sorted_rows(counters.one_event_per_step(df).groupBy("source_id", "table_fqn").agg(*counters.usage_aggs()))
        if self.kind == "daily":
            return sorted_rows(df.groupBy(F.to_date("created_at").alias("day")).agg(F.sum("total_cost").cast("double"), F.sum("total_tokens")))
        if self.kind == "index":
            last = {i: t for d in days for i, t in self.data(d)}
            return sorted_rows(self.spark.createDataFrame(list(last.items()), TEXTS).select("item_id", F.sha2("text", 256), embed(F.col("text"))))
        limits = self.spark.createDataFrame(LIMITS, "user_id int, limit bigint")
        totals = df.groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(F.sum("bytes"))
        return sorted_rows(totals), sorted_rows(quota.quota_breach(df, limits, ["user_id"], "bytes").select("user_id", "event_id", "used"))


KINDS = ["usage", "quota", "daily", "index"]


@pytest.mark.parametrize("kind", KINDS)
def test_lost_checkpoint_replay_and_two_streams(spark, kind):
    form = Form(spark, kind)
    for day in range(2):
        form.put("a", day)
        got = form.run("a", "state-a")
    assert got == form.batch(range(2))
    # the commit of the last batch is lost, then the whole checkpoint: new rows come by a new one, numbered from 0 again
    lose_last_commit(f"{form.root}/state-a")
    assert form.run("a", "state-a") == form.batch(range(2))
    form.put("b", 2)
    assert form.run("b", "state-b") == form.batch(range(3))
    # the first stream goes on where it was, with the other's rows in place
    form.put("a", 3)
    assert form.run("a", "state-a") == form.batch(range(4))
    lose_last_commit(f"{form.root}/state-b")
    assert form.run("b", "state-b") == form.batch(range(4))


def accounts(spark, buckets=8):
    return runs.Accounts(spark, shared_dir(spark, "accounts"), "k int, n bigint", ["k"], buckets)


def counted(spark, ledger, stream, i, keys):
    batch = spark.createDataFrame([(k, 1) for k in keys], "k int, n bigint")
    ledger.add(stream, i, batch, lambda known: known.unionByName(batch).groupBy("k").agg(F.sum("n").alias("n")))


def test_only_touched_buckets_are_written(spark):
    ledger = accounts(spark)
    counted(spark, ledger, "a", 0, range(100))
    _, before = ledger.states.newest()
    counted(spark, ledger, "a", 1, [7, 7])
    _, after = ledger.states.newest()
    assert [b for b in after["buckets"] if after["buckets"][b] != before["buckets"][b]] == [str(ledger.touched(spark.createDataFrame([(7,)], "k int"))[0])]
    counted(spark, ledger, "a", 2, range(200, 300))  # a batch that touches all buckets lets the first folder go
    counted(spark, ledger, "a", 3, [7])
    counted(spark, ledger, "a", 4, [7])
    assert {r.k: r.n for r in ledger.rows().collect()} == {**dict.fromkeys([*range(100), *range(200, 300)], 1), 7: 5}
    kept = {p.name for p in pathlib.Path(ledger.path).iterdir() if p.name.startswith("v")}
    assert "v0" not in kept and len(kept) <= 4


def test_half_written_batches_do_not_count(spark):
    ledger = accounts(spark, buckets=2)
    counted(spark, ledger, "a", 0, [1, 2, 3])
    spark.createDataFrame([(9, 9)], "k int, n bigint").write.parquet(f"{ledger.path}/v1/bucket=0")  # data without a record
    assert ledger.rows().count() == 3
    counted(spark, ledger, "b", 0, [1])
    counted(spark, ledger, "b", 0, [1])
    counted(spark, ledger, "a", 0, [1])
    assert {r.k: r.n for r in ledger.rows().collect()} == {1: 2, 2: 1, 3: 1}
    empty = accounts(spark)
    counted(spark, empty, "a", 0, [])
    assert empty.rows().count() == 0 and empty.holds("a", 0)


# ---- event time -------------------------------------------------------------------------------------


def at(day, hour=0):
    return START + dt.timedelta(days=day, hours=hour)


def test_usage_windows_drop_late_rows_and_state(spark):
    path, state, out = (shared_dir(spark, n) for n in ("win-src", "win-state", "win-out"))
    inside = [(1, "t", 1, True, 5, "admin", at(0, 1)), (2, "t", 1, False, 5, "viewer", at(0, 2)), (3, "u", 1, True, None, "x", at(2))]
    parts = [inside, [(1, "t", 1, True, 5, "admin", at(0, 1)), (4, "t", 1, True, 6, "x", at(1, 20)), (5, "t", 2, True, 6, "x", at(6))],  # a repeat, and rows out of order
             [(7, "t", 1, True, 6, "x", at(5))], [(6, "t", 1, True, 6, "x", at(0, 5)), (8, "z", 1, True, 6, "x", at(30))]]  # 6 comes too late
    for p in parts:
        write(spark, path, p, USE)
    run = eventtime.run_final(eventtime.usage_windows(runs.file_stream(spark, path, files_per_batch=1), "2 days"), out, state)
    kept = spark.createDataFrame([r for p in parts for r in p if r[0] not in (6, 8)], USE)
    batch = counters.one_event_per_step(kept).groupBy(F.date_trunc("day", "used_at"), "source_id", "table_fqn").agg(*counters.usage_aggs())
    assert sorted_rows(run.rows) == sorted_rows(batch)
    assert run.arrived == 9 and run.late["dedupeWithinWatermark"] == 1 and run.newest == str(at(30))
    assert run.state == {"dedupeWithinWatermark": 1, "stateStoreSave": 1}  # the last event and its open day
    # the next run goes on: it closes that day
    write(spark, path, [(9, "z", 1, True, 6, "x", at(40))], USE)
    again = eventtime.run_final(eventtime.usage_windows(runs.file_stream(spark, path, files_per_batch=1), "2 days"), out, state)
    assert again.rows.count() == run.rows.count() + 1 or again.rows.where(F.col("window_start") == at(30)).count() == 1


def test_cost_windows(spark):
    path = shared_dir(spark, "cost-src")
    for p in ([(at(0), 1, 1), (at(1), 2, 1)], [(at(0, 3), 4, 1), (at(9), 8, 1)], [(at(9, 1), 64, 1)], [(at(1), 16, 1), (at(1), 16, 1), (at(20), 32, 1)]):
        write(spark, path, [(when, Decimal(much), n) for when, much, n in p], SPENT)
    run = eventtime.run_final(eventtime.cost_windows(runs.file_stream(spark, path, files_per_batch=1), "3 days"))
    assert sorted_rows(run.rows) == sorted([(at(0), 2, 5.0, 2), (at(1), 1, 2.0, 1), (at(9), 2, 72.0, 2)], key=str)
    assert run.arrived == 8 and run.late["stateStoreSave"] == 1  # two rows of one group
    empty = shared_dir(spark, "cost-none")
    write(spark, empty, [], SPENT)
    assert eventtime.run_final(eventtime.cost_windows(runs.file_stream(spark, empty), "3 days")).rows.count() == 0


def test_timers_find_first_breaches_out_of_order(spark):
    path = shared_dir(spark, "timer-src")
    limits = spark.createDataFrame([*LIMITS, (3, None), (4, 0)], "user_id int, limit bigint")
    whole = [r for d in range(0, 8) for r in byte_data(d)] + [(900, 3, at(1), 10), (901, 4, at(1), 10), (902, 4, at(0), 0), (903, 2, at(2, 5), 7)]
    # each file holds every third event, so a file's events reach back over all days but the delay covers
    for i in range(3):
        write(spark, path, [r for r in whole if r[0] % 3 == i], BYTES)
    write(spark, path, [(1000, 3, at(60), 1)], BYTES)  # a user without a limit moves the time on and holds no state
    run = eventtime.run_final(eventtime.first_breaches(runs.file_stream(spark, path, files_per_batch=1), limits, ["user_id"], "bytes", "10 days"))
    batch = quota.quota_breach(spark.createDataFrame(whole, BYTES), limits, ["user_id"], "bytes")
    assert sorted_rows(run.rows.select("user_id", "event_id", "ts", "used", "limit")) == sorted_rows(batch.select("user_id", "event_id", "ts", "used", "limit"))
    assert run.rows.count() >= 4 and run.late["applyInPandasWithState"] == 0
    assert run.state["applyInPandasWithState"] == 0  # the months are over


def test_timers_wait_for_the_watermark(spark):
    path, state, out = (shared_dir(spark, n) for n in ("wait-src", "wait-state", "wait-out"))
    limits = spark.createDataFrame([(0, 15)], "user_id int, limit bigint")
    step = lambda rows: (write(spark, path, rows, BYTES), eventtime.run_final(eventtime.first_breaches(runs.file_stream(spark, path), limits, ["user_id"], "bytes", "1 day"), out, state))[1]
    run = step([(1, 0, at(0, 2), 10), (2, 0, at(0, 4), 10)])
    assert run.rows.count() == 0 and run.state["applyInPandasWithState"] == 1  # an earlier event may still come
    run = step([(3, 0, at(0, 1), 10)])
    assert run.rows.count() == 0
    run = step([(4, 0, at(2), 1)])
    assert sorted_rows(run.rows.select("event_id", "used")) == [(1, 20)]
    run = step([(5, 0, at(0, 3), 99), (6, 0, at(2, 1), 99)])  # too late, and after the first breach
    assert run.rows.count() == 1 and run.late["applyInPandasWithState"] == 1
