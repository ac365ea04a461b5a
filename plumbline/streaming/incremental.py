"""Incremental forms of the batch aggregates, as Structured Streaming queries.

Each form ends in the same rows as its batch operator over the same events.
What a form keeps under ``path`` outlives its checkpoint: a replayed batch
changes nothing, and a stream with a new checkpoint adds its rows to what is
there.  After the loss of a checkpoint, give the new stream new rows only;
rows it reads again are new rows to it (counters of steps and the index, whose
keys tell, take no harm).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash
from ..operators.counters import one_event_per_step, usage_aggs
from ..operators.quota import quota_breach
from ..session import shared_dir
from ..sources import snapshots
from .runs import BUCKETS, Accounts, States, bucket_of, newest, run_available, stream_name


def stream_usage_stats(events: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Counters per (source, table), each (step, table) counted once, however late a repeat comes.

    As in the batch form the earliest use of a (step, table) counts.  A batch
    merges its uses into the touched buckets of the table of first uses, of one
    row per (step, table); counters are aggregated from it.
    """
    spark = events.sparkSession
    checkpoint = checkpoint or shared_dir(spark, "stream")
    name = stream_name(spark, checkpoint)
    first = Accounts(spark, path or shared_dir(spark, "usage-first"), _ddl(events), ["step_id", "table_fqn"])

    def each(batch: DataFrame, i: int) -> None:
        first.add(name, i, batch, lambda known: one_event_per_step(known.unionByName(batch)).select(*events.columns))

    run_available(events, each, "append", checkpoint)
    return first.rows().groupBy("source_id", "table_fqn").agg(*usage_aggs())


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def stream_quota(events: DataFrame, limits: DataFrame, keys: list[str], amount: str, path: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Monthly totals and first breaches, batch by batch: (totals, breaches).

    A batch starts from the totals that the batches before it left and runs
    the batch operator on its own events, so a hot key is spread inside a
    batch.  Months are part of the key; a batch's breaches are written before
    its totals, and again by a replay only if its totals are not in yet.
    """
    spark = events.sparkSession
    path, checkpoint = path or shared_dir(spark, "quota"), checkpoint or shared_dir(spark, "stream")
    name = stream_name(spark, checkpoint)
    by = [*keys, "month"]
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    month = kinds["ts"] if kinds["ts"].startswith("timestamp") else "timestamp"
    totals = Accounts(spark, f"{path}/totals", ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"month {month}", "used bigint"]), by)

    def each(batch: DataFrame, i: int) -> None:
        if totals.holds(name, i):
            return
        used = batch.where(F.col(amount) > 0).select(*keys, F.date_trunc("month", "ts").cast(month).alias("month"), F.col(amount).cast("bigint").alias("used"))
        opening = totals.rows(totals.touched(used))
        found = quota_breach(batch, limits, keys, amount, opening=opening)
        found.write.mode("overwrite").parquet(f"{path}/breaches/batch={name}-{i}")
        totals.add(name, i, used, lambda known: known.unionByName(used).groupBy(*by).agg(F.sum("used").alias("used")))

    run_available(events, each, "append", checkpoint)
    return totals.rows(), spark.read.parquet(f"{path}/breaches").drop("batch")


def stream_daily_cost(rows: DataFrame, cost: str = "total_cost", tokens: str = "total_tokens", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Spend per day over everything that has arrived: open days and late rows included.

    A batch adds its sums per day to the touched buckets of the table of days.
    """
    spark = rows.sparkSession
    checkpoint = checkpoint or shared_dir(spark, "stream")
    name = stream_name(spark, checkpoint)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    money = f"decimal(38,{kinds[cost].scale})" if isinstance(kinds[cost], T.DecimalType) else "double"
    days = Accounts(spark, path or shared_dir(spark, "daily-cost"), f"day date, cost {money}, tokens bigint", ["day"])

    def each(batch: DataFrame, i: int) -> None:
        new = batch.select(F.to_date(F.col("created_at").cast("timestamp")).alias("day"), F.col(cost).cast(money).alias("cost"), F.col(tokens).cast("bigint").alias("tokens"))
        days.add(name, i, new, lambda known: known.unionByName(new).groupBy("day").agg(F.sum("cost").cast(money).alias("cost"), F.sum("tokens").alias("tokens")))

    run_available(rows, each, "append", checkpoint)
    return days.rows().select("day", F.col("cost").cast("double").alias("cost_usd"), "tokens")


def incremental_index(items: DataFrame, embed: Callable[[Column], Column], key: str = "item_id", order: str | None = None, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Vector index of a text stream: only new or changed texts are embedded.

    Of several texts of a key in one batch the last by ``order`` counts (the
    greatest text, if no order is given).  A batch writes its changes below a
    number of its own, in buckets, and compares them with the touched buckets
    of the batches before it; the index is the newest row per key.
    """
    spark = items.sparkSession
    path, checkpoint = path or shared_dir(spark, "index"), checkpoint or shared_dir(spark, "stream")
    name, states = stream_name(spark, checkpoint), States(spark, path)
    kind = items.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, hash string, embedding array<double>"

    def each(batch: DataFrame, i: int) -> None:
        n, record = states.newest()
        if States.holds(record, name, i):
            return
        bucket = bucket_of([key], BUCKETS)
        last = F.max_by("text", F.struct(*([order] if order else []), "text"))
        hashed = batch.groupBy(key).agg(last.alias("text")).withColumns({"hash": content_hash("text"), "bucket": bucket})
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        known = newest(spark, path, [key], schema, before=n + 1, buckets=touched).select(key, "hash")
        changed = hashed.join(known, [key, "hash"], "left_anti")
        rows = changed.select(key, "hash", embed(F.col("text")).alias("embedding"), "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch_id={n + 1}")
        states.put(n + 1, {"streams": record["streams"] | {name: i}})

    run_available(items, each, "append", checkpoint)
    return newest(spark, path, [key], schema, before=states.newest()[0] + 1)


def scheduled_refresh(spark: SparkSession, source: DataFrame, root: str, name: str, build: Callable[[], DataFrame], checkpoint: str | None = None) -> str:
    """One tick of a scheduled refresh: rebuild the dataset when the source has new rows.

    Call it once per interval with the same checkpoint folder.
    """
    def each(batch: DataFrame, i: int) -> None:
        if not batch.isEmpty():
            snapshots.refresh(spark, root, name, build, F.current_timestamp())

    return run_available(source, each, "append", checkpoint)
