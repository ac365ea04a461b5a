"""Order-dependent work without one task per key.

``running_total`` lets a key that holds a third of the rows be worked on by
many tasks, and gives exact results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_total(df: DataFrame, keys: list[str], order: list[Column], amount: str, out: str = "running") -> DataFrame:
    """Exact running sum of ``amount`` per key; ``order`` must be unique within a key.

    Rows are range-partitioned on (keys, order), so a hot key spans several
    partitions.  Each partition sums on its own; what earlier partitions hold
    for the same key is added from a table of one row per partition at most.
    The range partitioning is written out first: its partition numbers must
    not change if an executor is lost.
    """
    placed = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_rt_pid", F.spark_partition_id())
    placed = cut_lineage(placed)
    # a boundary cuts one key at most: only a partition's first key can have earlier rows elsewhere
    parts = placed.groupBy("_rt_pid", *keys).agg(F.sum(amount).alias("_rt_part"))
    parts = parts.withColumn("_rt_first", F.row_number().over(W.partitionBy("_rt_pid").orderBy(*[F.col(k) for k in keys])) == 1) if keys else parts.withColumn("_rt_first", F.lit(True))
    before = W.partitionBy(*keys).orderBy("_rt_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("_rt_before", F.sum("_rt_part").over(before)).where("_rt_first and _rt_before is not null").select(F.col("_rt_pid").alias("_rt_p"), *[F.col(k).alias(f"_rt_k{i}") for i, k in enumerate(keys)], "_rt_before")
    within = W.partitionBy("_rt_pid", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumn("_rt_run", F.sum(amount).over(within))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_rt_k{i}")) for i, k in enumerate(keys)], F.col("_rt_pid") == F.col("_rt_p"))  # a null key is a key
    return summed.join(offsets, same, "left").withColumn(out, F.col("_rt_run") + F.coalesce("_rt_before", F.lit(0))).select(*df.columns, out)
