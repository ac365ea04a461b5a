"""Running streams to the end of what is there, over files and into versioned folders."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, shared_dir


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a parquet table, be it a folder or a single file."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if any(f.rsplit("/", 1)[-1] == name for f in table.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(path.rstrip("/").rsplit("/", 1)[0])
    return reader.parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> str:
    """Process everything available through ``each(batch, id)``; returns the checkpoint folder.

    Running again with the same folder goes on where the last run ended.
    """
    checkpoint = checkpoint or shared_dir(stream.sparkSession, "stream")
    query = (stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return checkpoint


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier batches wrote below ``path``; nothing if there is no such folder yet.

    Only a missing folder counts as nothing: any other failure to read is raised.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def newest(spark: SparkSession, path: str, keys: list[str], schema: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Latest version of each key over all batches, or over those before one; of some buckets only, if asked for."""
    rows = stored(spark, path, f"{schema}, batch_id bigint, bucket int")
    rows = rows if before is None else rows.where(F.col("batch_id") < before)
    rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
    cols = [c for c in rows.columns if c not in (*keys, "batch_id", "bucket")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_v")).select(*keys, "_v.*")


class Ledger:
    """A table that batches replace as a whole, each under its own id.

    A batch reads the newest version before its own, so a replayed batch meets
    what it met the first time and replaces its own version.  Versions older
    than the one before are dropped: the cost of a batch follows the size of
    the table, not the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> list[int]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return []
        folders = [x.getPath() for x in fs.listStatus(target)]
        done = [p for p in folders if p.getName().startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[2:]) for p in done)

    def before(self, batch_id: int | None) -> DataFrame:
        """The table as the batches before ``batch_id`` left it (None: as it is now)."""
        found = [v for v in self._versions() if batch_id is None or v < batch_id]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1]}")

    def replace(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        for old in [v for v in self._versions() if v < batch_id][:-1]:
            drop_path(self.spark, f"{self.path}/v={old}")


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is either there as a whole or not at all."""
    target, fs = _fs(spark, path)
    hidden, _ = _fs(spark, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    out.write(text.encode())
    out.close()
    if not fs.rename(hidden, target):
        raise RuntimeError(f"{path} was written by another stream")


def _get_text(spark: SparkSession, path: str) -> str | None:
    target, fs = _fs(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(target) else None


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that a checkpoint folder belongs to; a new or lost folder makes a new stream."""
    path = f"{checkpoint}/plumbline-stream"
    known = _get_text(spark, path)
    if known is None:
        known = uuid.uuid4().hex
        _put_text(spark, path, known)
    return known


class States:
    """Numbered small records of what streams have added below a path; the newest one counts.

    A record names, for each stream, the last batch that went in.  It is written
    last, after the data it speaks of, so a batch is in exactly if the newest
    record says so: a replayed batch is told from one that was lost half-way,
    and batch numbers of another or a later stream are never mixed up.  One
    stream at a time may write; the next one goes on from the newest record.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/_state"

    def newest(self) -> tuple[int, dict]:
        """(number, record); number -1 if there is none."""
        target, fs = _fs(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []
        n = max((int(x) for x in names if x.isdigit()), default=-1)
        return n, json.loads(_get_text(self.spark, f"{self.path}/{n}")) if n >= 0 else {"streams": {}}

    def put(self, n: int, record: dict) -> None:
        _put_text(self.spark, f"{self.path}/{n}", json.dumps(record))

    @staticmethod
    def holds(record: dict, stream: str, batch_id: int) -> bool:
        return record["streams"].get(stream, -1) >= batch_id


#: Buckets of a ledger: a batch rewrites those that its keys fall into.
BUCKETS = 32


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Accounts(Ledger):
    """A table in buckets of its keys; a batch reads and rewrites the buckets it touches, once and for all.

    The newest record says where each bucket lies and which batches are in.
    Buckets that neither it nor the record before refers to are dropped.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        super().__init__(spark, path, schema)
        self.keys, self.buckets, self.states = keys, buckets, States(spark, path)

    def rows(self, touched: list[int] | None = None) -> DataFrame:
        """The table as the newest record has it, or some of its buckets."""
        _, record = self.states.newest()
        return self._read(record, touched)

    def _read(self, record: dict, touched: list[int] | None) -> DataFrame:
        at = record.get("buckets", {})
        paths = [f"{self.path}/{at[b]}/bucket={b}" for b in sorted(at) if touched is None or int(b) in touched]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def holds(self, stream: str, batch_id: int) -> bool:
        return States.holds(self.states.newest()[1], stream, batch_id)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets that the rows' keys fall into."""
        return sorted(r[0] for r in batch.select(bucket_of(self.keys, self.buckets)).distinct().collect())

    def add(self, stream: str, batch_id: int, batch: DataFrame, grow: Callable[[DataFrame], DataFrame]) -> None:
        """Put a batch in: ``grow(rows)`` gives the new rows of the touched buckets from the old ones.

        ``batch`` holds the key columns; a batch that is in already changes nothing.
        """
        n, record = self.states.newest()
        if States.holds(record, stream, batch_id):
            return
        touched = self.touched(batch)
        folder = f"v{n + 1}"
        if touched:
            grown = grow(self._read(record, touched)).withColumn("bucket", bucket_of(self.keys, self.buckets))
            grown.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        target, fs = _fs(self.spark, f"{self.path}/{folder}")
        there = [x.getPath().getName() for x in fs.listStatus(target)] if touched else []
        at = {b: f for b, f in record.get("buckets", {}).items() if int(b) not in touched} | {x[7:]: folder for x in there if x.startswith("bucket=")}
        self.states.put(n + 1, {"streams": record["streams"] | {stream: batch_id}, "buckets": at, "before": sorted(set(record.get("buckets", {}).values()))})
        for old in set(record.get("before", [])) - set(record.get("buckets", {}).values()) - set(at.values()):
            drop_path(self.spark, f"{self.path}/{old}")
