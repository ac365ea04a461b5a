"""Aggregates whose state is bounded by event time.

The ledger forms in ``incremental`` take rows however late they come and keep a
row for every key for ever.  The forms here keep what a watermark still allows:
rows that come a batch or more after the watermark, ``delay`` behind the newest
event time, has passed them are dropped and counted, results are final once the watermark has passed them, and state goes when no
row can touch it any more.  Results are appended, each once, to a folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.counters import usage_aggs
from ..session import shared_dir


@dataclass
class Run:
    """What a run to the end of the input has left behind."""

    #: Final results: those of this run and of the runs before it from the same checkpoint.
    rows: DataFrame
    checkpoint: str
    #: Input rows of this run, and the latest event time among them.
    arrived: int = 0
    newest: str | None = None
    #: Rows that came too late, by stateful operator, and rows of state still held.  An aggregate counts
    #: its late rows after partial sums, so one for each group of a task.
    late: dict[str, int] = field(default_factory=dict)
    state: dict[str, int] = field(default_factory=dict)
    watermark: str | None = None


def _event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """``df`` with a watermark; what arrives is observed beside the data."""
    stamped = df.withColumn(column, F.col(column).cast("timestamp"))
    return stamped.observe("arrived", F.count(F.lit(1)).alias("rows"), F.max(column).alias("newest")).withWatermark(column, delay)


def run_final(results: DataFrame, path: str | None = None, checkpoint: str | None = None) -> Run:
    """Append the final results of everything available to ``path``; the next run from ``checkpoint`` goes on from there."""
    spark = results.sparkSession
    path, checkpoint = path or shared_dir(spark, "final"), checkpoint or shared_dir(spark, "stream")
    query = results.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    told = {}
    ended = False
    while not ended:  # only the newest reports are kept for asking
        ended = query.awaitTermination(1)
        told |= {p.batchId: p for p in query.recentProgress}
    out = Run(spark.read.schema(results.schema).parquet(path), checkpoint)
    for batch in sorted(told):
        progress = told[batch]
        seen = progress.observedMetrics.get("arrived")
        if seen is not None and seen["rows"]:
            out.arrived += seen["rows"]
            out.newest = max(x for x in (out.newest, seen["newest"]) if x is not None)
        for op in progress.stateOperators:
            out.late[op.operatorName] = out.late.get(op.operatorName, 0) + op.numRowsDroppedByWatermark
            out.state[op.operatorName] = op.numRowsTotal
        out.watermark = progress.eventTime.get("watermark", out.watermark)
    return out


def usage_windows(events: DataFrame, delay: str, width: str = "1 day") -> DataFrame:
    """Counters per (window, source, table), each (step, table) counted once as long as its repeats come within ``delay``.

    Any of the repeats may be the one that counts: they are the same use.
    """
    kept = _event_time(events, "used_at", delay).dropDuplicatesWithinWatermark(["step_id", "table_fqn"])
    sums = kept.groupBy(F.window("used_at", width).alias("w"), "source_id", "table_fqn").agg(*usage_aggs())
    return sums.select(F.col("w.start").alias("window_start"), *[c for c in sums.columns if c != "w"])


def cost_windows(rows: DataFrame, delay: str, width: str = "1 day", cost: str = "total_cost", tokens: str = "total_tokens") -> DataFrame:
    """Spend per window."""
    sums = _event_time(rows, "created_at", delay).groupBy(F.window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(cost).cast("double").alias("cost_usd"), F.sum(tokens).cast("bigint").alias("tokens"))
    return sums.select(F.col("w.start").alias("window_start"), "calls", "cost_usd", "tokens")


_STATE = "used long, done boolean, limit long, ends long, at array<long>, ids array<long>, amounts array<long>"


def first_breaches(events: DataFrame, limits: DataFrame, keys: list[str], amount: str, delay: str) -> DataFrame:
    """First event per key and month at which the running total passes the limit, told once the watermark has passed it.

    Keyed state with timers: a key and month holds its total and the events
    that earlier ones may still precede, ``delay`` of them at most.  A timer at
    the oldest of those, or at the month's end, wakes it when nothing comes; the
    month's end clears it.  Events of one time are taken in the order of their
    ids.  A key without a limit holds no state.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    timed = _event_time(events.where(F.col(amount) > 0), "ts", delay)
    month = F.date_trunc("month", "ts")
    ends = F.unix_micros(F.date_trunc("month", F.col("month") + F.expr("INTERVAL 32 DAYS")))
    rows = timed.join(limits.where("limit IS NOT NULL").select(*keys, F.col("limit").cast("long").alias("limit")), keys).withColumn("month", month).select(
        *keys, "month", "ts", "limit", F.col("event_id").cast("long").alias("event_id"), F.col(amount).cast("long").alias("amount"), F.unix_micros("ts").alias("at"), ends.alias("ends"))

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, done, limit, month_ends, at, ids, amounts = state.get if state.exists else (0, False, 0, 0, [], [], [])
        waiting = list(zip(at, ids, amounts, strict=True))
        for part in parts:
            if len(part):
                limit, month_ends = int(part["limit"].iloc[0]), int(part["ends"].iloc[0])
                if not done:
                    waiting += zip(part["at"].tolist(), part["event_id"].tolist(), part["amount"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        taken = 0
        for when, event, much in waiting:
            if done or when >= passed:
                break
            taken += 1
            used += much
            if used > limit:
                done = True
                yield pd.DataFrame([[*key[:-1], event, when, used, limit]], columns=[*keys, "event_id", "at", "used", "limit"])
        waiting = [] if done else waiting[taken:]
        if passed >= month_ends:
            state.remove()
            return
        state.update((used, done, limit, month_ends, *[[int(w[i]) for w in waiting] for i in range(3)]))
        # wakes when the watermark is past it: nothing earlier can come then
        state.setTimeoutTimestamp(max(min([month_ends, *[w[0] for w in waiting]]) // 1000, state.getCurrentWatermarkMs()))

    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", event_id long, at long, used long, limit long"
    found = rows.groupBy(*keys, "month").applyInPandasWithState(advance, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*keys, "event_id", F.timestamp_micros("at").alias("ts"), "used", "limit")
