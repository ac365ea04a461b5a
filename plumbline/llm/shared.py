"""Helpers of the operators: bounded Bloom bitmaps and distributed connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Bits of a Bloom bitmap: 2 MB whatever it is filled with, so it may travel to every task.
BLOOM_BITS = 1 << 24


def bloom_words(df: DataFrame, key: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bitmap of the values of the long column ``key``, put together by the executors.

    At most ``bits / 64`` rows reach the driver, whatever the size of ``df``.
    A full bitmap lets everything pass; it never loses a value.
    """
    at = F.pmod(F.col(key), F.lit(bits))
    rows = (
        df.select(at.alias("at")).where(F.col("at").isNotNull())
        .groupBy((F.shiftright("at", 6)).cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("b"))
        .collect()
    )
    out = np.zeros(bits // 64, np.uint64)
    for r in rows:
        out[r.w] = r.b & 0xFFFFFFFFFFFFFFFF
    return out


def bloom_hits(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``values`` may be in the bitmap."""
    at = values.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """Connected components: one row (node, root) for each node of an edge.

    Each round hooks every node to its least neighbour, halves the paths
    twice, and goes on with the graph of the hooked nodes, so that stars
    vanish in one round and paths shrink by a constant factor.  The root is
    the least node of a component.  All joins are equi-joins between written
    tables, so a hub with very many edges can be split by skew handling, and
    least neighbours are aggregated before they are shuffled.  Null ends and
    self-edges join nothing.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    left = cut_lineage(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if left.isEmpty():
            break
        ends = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut_lineage(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
        for _ in range(2):
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            hook = cut_lineage(hook.join(up, "p").select("u", F.col("q").alias("p")))
        maps.append(hook)
        left = cut_lineage(
            left.join(hook, "u").select(F.col("p").alias("x"), "v")
            .join(hook.select(F.col("u").alias("v"), F.col("p").alias("y")), "v")
            .where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
        )
    else:
        raise RuntimeError("the components did not settle")
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        deeper = out.select(F.col("u").alias("p"), F.col("p").alias("q"))
        out = cut_lineage(m.join(deeper, "p", "left").select("u", F.coalesce("q", "p").alias("p")))
    return out.select(F.col("u").alias("node"), F.col("p").alias("root"))


#: Rows of an Arrow batch at most: bounds what a task holds twice, on the JVM's side and on Python's.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for long texts."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(df: DataFrame, without: list[str]) -> list[T.StructField]:
    """The columns of ``df`` but those named, whatever their case."""
    names = {n.lower() for n in without}
    return [f for f in df.schema.fields if f.name.lower() not in names]
