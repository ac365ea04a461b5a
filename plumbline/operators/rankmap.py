"""Pages by rank: a stored order in which any page is read from the parts that hold it.

An offset has to count through everything before it, in one task.  A rank map
keeps a listing sorted into range partitions of ``rows_per_part`` rows or more,
with each row's place in its part, and the parts' counts.  The page at rank r
lies in the parts whose counts add up to r: one or two folders are read, and of
those the rows of the page, however deep it is.  The same counts turn a row
that is found by its own columns back into its rank and page.

The map is of one version of a listing; a changed one gets a map of its own.
A part is a task, a folder and a count that the driver hears of, so there are ``MOST``
of them at most: beyond that the parts grow.  The counts, a row for each part, are
what reaches the driver.  Equal order
values would make the places a matter of chance, so the order must be unique,
as that of any paged listing.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_path

ROWS_PER_PART = 1_000_000
#: Parts of a map at most.
MOST = 512


@dataclass
class RankMap:
    spark: SparkSession
    path: str
    schema: T.StructType
    #: Rows before each part, and in all.
    starts: list[int]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def _stored(self) -> DataFrame:
        kind = [*self.schema.fields, T.StructField("__place", T.LongType()), T.StructField("__part", T.IntegerType())]
        return self.spark.read.schema(T.StructType(kind)).parquet(f"{self.path}/rows")

    def slice(self, offset: int, n: int) -> DataFrame:
        """Rows ``offset`` to ``offset + n`` of the order, in order."""
        end = min(offset + n, self.total)
        if offset < 0 or offset >= end:
            return self._stored().where("false").drop("__place", "__part")
        first, last = (bisect_right(self.starts, at) - 1 for at in (offset, end - 1))
        part, place = F.col("__part"), F.col("__place")
        rows = self._stored().where(part.isin(list(range(first, last + 1))))
        rows = rows.where((part > first) | (place >= offset - self.starts[first])).where((part < last) | (place < end - self.starts[last]))
        return rows.orderBy("__part", "__place").drop("__place", "__part")

    def page(self, number: int, size: int) -> DataFrame:
        """One page with total, total_pages and has_more, as ``paging.page`` gives it."""
        return self.slice((number - 1) * size, size).withColumns({
            "total": F.lit(self.total).cast("long"), "total_pages": F.lit(-(-self.total // size)).cast("long"), "has_more": F.lit(self.total > number * size)})

    def ranks(self, condition: Column) -> DataFrame:
        """Rows that meet a condition, with their ``rank`` from 0: rank // size is the page before theirs."""
        found = self._stored().where(condition)
        starts = self.spark.createDataFrame(list(enumerate(self.starts[:-1])), "__part int, __start long")
        return found.join(starts, "__part").withColumn("rank", F.col("__start") + F.col("__place")).drop("__part", "__start", "__place")


def build(df: DataFrame, order: list[Column], root: str, version: str, rows_per_part: int = ROWS_PER_PART) -> RankMap:
    """The rank map of ``df`` in a unique ``order``, below ``root``; built only if this version is not there yet."""
    spark = df.sparkSession
    path = f"{root}/{version}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        drop_path(spark, path)
        parts = min(MOST, max(1, -(-df.count() // rows_per_part)))
        placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        # the place within a partition is the low part of the running id
        placed = placed.withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).withColumn("__part", F.spark_partition_id())
        placed.write.partitionBy("__part").parquet(f"{path}/rows")
        spark.read.schema("__place long, __part int").parquet(f"{path}/rows").groupBy("__part").agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")
    counts = {r["__part"]: r["n"] for r in spark.read.schema("__part int, n long").parquet(f"{path}/counts").collect()}
    sizes = [counts.get(p, 0) for p in range(max(counts, default=0) + 1)]
    return RankMap(spark, path, df.schema, [0, *accumulate(sizes)])


def pager(root: str, version: str, rows_per_part: int = ROWS_PER_PART):
    """A stand-in for ``paging.page`` that reads pages by rank."""
    def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
        return build(df, order, root, version, rows_per_part).page(number, size)

    return page
