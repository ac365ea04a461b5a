"""Exact top-k inner products with a pivot-distance index.

Vectors are turned into integers, floor(``scale`` * x).  One more coordinate
makes all of them equally long, so that the largest inner product becomes the
smallest Euclidean distance.  Each vector is keyed by its nearest pivot and
its distance to it; the rows of a pivot are cut along that distance into rings
(annuli), and rings into blocks of bounded size.

A search expands from the ring with the smallest bound.  First each query
scans the block that comes first for it, which gives it a k-th score to beat.
Then the triangle inequality bounds every ring: a row at distance r from its
pivot p is at least |d(query, p) - r| away.  Rings that cannot beat the k-th
score are dropped; in the others only the stretch of sorted distances that
could is scored.  Bounds are rounded in the safe direction, and scores are
integers, so the result is exact; ties go to the smaller id.

Pivots come from a bounded sample of the vectors, ring edges from quantiles;
both only steer the work.  Every vector is indexed.  Equal vectors are brought
together first: of each, the k + 1 smallest ids can appear in a result.

Vectors that are null, or hold null or non-finite components, take no part,
nor do rows of a null id or of another dimension than most.  Repeated rows (same
id and vector) count once; a query never finds its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import quoted

SCALE = 1024
PIVOTS = 48
RINGS = 12
#: Vectors that the pivots are chosen from.
SAMPLE = 4000
#: Rows of a block, in expectation, and queries scored against a block at once.
BLOCK = 4096
QUERIES = 4096


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dimension)


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the integer vectors that take part."""
    x = F.transform(quoted(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.where(quoted(key).isNotNull() & quoted(vector).isNotNull()).select(quoted(key).cast("long").alias("vec_id"), x.alias("x")).where(fine & (F.size("x") > 0)).select(
        "vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def far_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Some of the vectors, each as far as possible from those before."""
    chosen = [0]
    near = np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < min(count, len(vectors)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
    return vectors[chosen]


def _lift(v: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate, so that all vectors have the length ``longest``."""
    rest = np.sqrt(np.maximum(longest ** 2 - (v * v).sum(axis=1), 0))
    return np.column_stack([v, rest])


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Index:
    """The rows by (cell, block), and the bounded table of cells: pivot, least and greatest distance, blocks."""

    def __init__(self, rows: DataFrame, cells: pd.DataFrame, pivots: np.ndarray, longest: float, dimension: int):
        self.rows, self.cells, self.pivots, self.longest, self.dimension = rows, cells, pivots, longest, dimension


def build(vectors: DataFrame, k: int, n_pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE, block: int = BLOCK) -> Index | None:
    """Index of (vec_id, v); None if there is no row."""
    kept = Window.partitionBy("v").orderBy("vec_id")
    # of equal vectors, only the k + 1 smallest ids can be among any query's first k
    once = cut_lineage(vectors.distinct().withColumn("rank", F.row_number().over(kept)).where(F.col("rank") <= k + 1).drop("rank"))
    size = once.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)).alias("m")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not size:
        return None
    dimension, total, longest = size[0]["d"], size[0]["n"], float(np.sqrt(float(size[0]["m"]))) + 1.0
    once = once.where(F.size("v") == dimension)
    drawn = once.orderBy(F.xxhash64("vec_id")).limit(sample).collect()
    pivots = far_pivots(_lift(np.array([r["v"] for r in drawn], np.float64), longest), n_pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_lift(_matrix(b.column("v"), dimension).astype(np.float64), longest), pivots)
                best = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(best)), best])], names=["vec_id", "v", "pivot", "distance"])

    placed = cut_lineage(once.mapInArrow(place, "vec_id long, v array<long>, pivot int, distance double"))
    edges = placed.groupBy("pivot").agg(F.percentile_approx("distance", [i / rings for i in range(1, rings)], 1000).alias("e"))
    edge = {r["pivot"]: np.unique(r["e"]) for r in edges.collect()}  # n_pivots x rings numbers at most

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, distance = b.column("pivot").to_numpy(), b.column("distance").to_numpy()
            cell = pivot.astype(np.int32) * rings
            for p in np.unique(pivot).tolist():
                own = pivot == p
                cell[own] += np.searchsorted(edge[p], distance[own], side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    ringed = placed.mapInArrow(ring, "vec_id long, v array<long>, pivot int, distance double, cell int")
    cells = ringed.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n")).toPandas().sort_values("cell").reset_index(drop=True)
    cells["blocks"] = np.maximum(1, -(-cells["n"] // block))
    spark = vectors.sparkSession
    counts = spark.createDataFrame([(int(c), int(n)) for c, n in zip(cells["cell"], cells["blocks"], strict=True)], "cell int, blocks int")
    # one row for each cell: n_pivots x rings at most, whatever the table's size
    rows = cut_lineage(ringed.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks"))
    return Index(rows, cells, pivots, longest, dimension)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best: largest score, then smallest id."""
    if len(ids) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _scan(index: Index, k: int):
    """Scores the queries of a (cell, block) against its rows, within the distances that can still matter."""
    dimension = index.dimension

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values("distance", kind="stable")
            matrix = np.stack(rows["v"].to_numpy()).reshape(-1, dimension)
            ids, distance = rows["vec_id"].to_numpy(), rows["distance"].to_numpy()
            lows = np.searchsorted(distance, queries["near"].to_numpy(), side="left")
            highs = np.searchsorted(distance, queries["far"].to_numpy(), side="right")
            for q, v, a, b in zip(queries["query_id"].tolist(), queries["v"], lows.tolist(), highs.tolist(), strict=True):
                scores = matrix[a:b] @ np.asarray(v, np.int64)
                other = ids[a:b] != q
                best = _top(ids[a:b][other], scores[other], k)
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[a:b][other][best], "score": scores[other][best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


_HIT = "query_id long, vec_id long, score long"


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visit(index: Index, queries: DataFrame, k: int, first: bool) -> DataFrame:
    """(query_id, v, cell, block, near, far): which blocks each query has to scan.

    ``first``: only the cell whose bound comes first and that holds more than k
    rows; else all cells that the query's ``least`` score leaves open.
    """
    cells, pivots, longest, dimension = index.cells, index.pivots, index.longest, index.dimension
    lo, hi, of = cells["lo"].to_numpy(), cells["hi"].to_numpy(), cells["pivot"].to_numpy()
    names, blocks, sizes = cells["cell"].to_numpy(), cells["blocks"].to_numpy(), cells["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                v = _matrix(b.column("v"), dimension).astype(np.float64)
                square = (v * v).sum(axis=1)
                d = _distances(np.column_stack([v, np.zeros(len(v))]), pivots)[:, of]
                slack = 1e-6 * (longest + np.sqrt(square)) + 1e-6
                bound = np.maximum(0, np.maximum(d - hi[None, :], lo[None, :] - d)) - slack[:, None]
                if first:
                    open_, near, far = np.zeros(bound.shape, bool), np.full(len(v), -np.inf), np.full(len(v), np.inf)
                    enough = np.where(sizes > k, 0, np.inf)[None, :]
                    open_[np.arange(len(v)), (bound + enough).argmin(axis=1)] = True
                    reach = np.full(len(v), np.inf)
                else:
                    least = b.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = np.sqrt(np.maximum(square + longest ** 2 - 2 * least, 0)) + slack
                    reach[np.isnan(reach)] = np.inf
                    open_ = bound <= reach[:, None]
                q, c = np.nonzero(open_)
                q_, times = np.repeat(q, blocks[c]), blocks[c]
                block = np.arange(len(q_)) - np.repeat(np.cumsum(times) - times, times)
                c_ = np.repeat(c, times)
                near, far = d[q_, c_] - reach[q_], d[q_, c_] + reach[q_]
                yield pa.RecordBatch.from_arrays(
                    [b.column("query_id").take(pa.array(q_)), b.column("v").take(pa.array(q_)), pa.array(names[c_].astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(near), pa.array(far)],
                    names=["query_id", "v", "cell", "block", "near", "far"])

    return queries.mapInArrow(run, "query_id long, v array<long>, cell int, block int, near double, far double")


def search(index: Index, queries: DataFrame, k: int, n_queries: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query (query_id, v) by inner product."""
    sets = max(1, -(-n_queries // QUERIES))  # queries meet a block in sets of bounded size
    keys = ["cell", "block", "part"]
    rows = index.rows.select("cell", "block", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("part"), "vec_id", "v", "distance")

    def scan(visits: DataFrame) -> DataFrame:
        asked = visits.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int"))
        return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_scan(index, k), _HIT)

    fit = queries.where(F.size("v") == index.dimension)
    start = cut_lineage(_best(scan(_visit(index, fit, k, True)), k))
    least = start.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    ready = cut_lineage(fit.join(least, "query_id", "left"))
    return _best(scan(_visit(index, ready, k, False)), k).select("query_id", "rank", "vec_id", "score")
