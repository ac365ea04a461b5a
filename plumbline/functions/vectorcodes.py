"""Nearest vectors through product-quantised codes, exact by their error.

Unit vectors are cut into ``SUBSPACES`` parts, and each part is replaced by the
number of the nearest of ``CENTROIDS`` centroids: a vector becomes as many bytes,
and the length of what the code leaves out (its residual).  A query's inner
product with the code is a sum of table entries; with the vector itself it
differs by the residual at most, the query being of length 1.  So the codes alone
bound every score from both sides: rows whose upper bound is below a query's k-th
best lower bound are out, and only the others are scored.  The answer is that of
the full scan, whatever the codes are; good codes leave few survivors.  Centroids
are fitted to a bounded sample.

Codes lie in packed blocks beside their vectors, and queries, a frame of any size,
are packed into sets of bounded size: a task meets one block and one set, scores
what the codes leave open there and hands on ``k`` rows a query at most, however
many are open.  Nothing of either goes through the driver.  Every set meets every
block, so the work grows with queries times rows, in tasks of bounded size.  Vectors meet queries of their own length; null vectors and
queries take no part, a vector of length 0 scores 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

SUBSPACES = 16
CENTROIDS = 256
#: Numbers in the sample that the centroids are fitted to.
SAMPLE = 1 << 20
#: Codes of a block and queries of a set, in expectation.
BLOCK = 16_384
QUERIES = 1024
#: Queries of a set that are held against a block at once.
STEP = 128


def _matrix(column, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _nearest(part: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (part @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1)[None, :]).argmax(axis=1)


def fit(v: np.ndarray, subspaces: int = SUBSPACES, centroids: int = CENTROIDS, rounds: int = 12, seed: int = 7) -> list[np.ndarray]:
    """Centroids of each part, by Lloyd's rounds from rows of the sample."""
    rnd, out = np.random.default_rng(seed), []
    for part in np.array_split(v, min(subspaces, v.shape[1]), axis=1):
        known = np.unique(part, axis=0)
        c = known[rnd.permutation(len(known))[:centroids]]
        for _ in range(rounds if len(known) > centroids else 0):
            of = _nearest(part, c)
            n = np.bincount(of, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, of, part)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out.append(c)
    return out


def encode(v: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual lengths rounded up) of unit vectors."""
    parts = np.array_split(v, len(centroids), axis=1)
    codes = np.stack([_nearest(p, c) for p, c in zip(parts, centroids, strict=True)], axis=1).astype(np.uint8)
    left = sum(((p - c[codes[:, i]]) ** 2).sum(axis=1) for i, (p, c) in enumerate(zip(parts, centroids, strict=True)))
    return codes, np.nextafter((np.sqrt(left) * (1 + 1e-9) + 1e-9).astype(np.float32), np.float32(np.inf))


def approximate(q: np.ndarray, codes: np.ndarray, centroids: list[np.ndarray]) -> np.ndarray:
    """Inner products of queries with codes, from a table of each query's products with the centroids."""
    out = np.zeros((len(q), len(codes)))
    for i, (p, c) in enumerate(zip(np.array_split(q, len(centroids), axis=1), centroids, strict=True)):
        out += (p @ c.T)[:, codes[:, i]]
    return out


@dataclass
class Codes:
    """Packed blocks of codes (block, keys, codes, residuals, vectors) of vectors of one length, and their centroids."""

    blocks: DataFrame
    centroids: list[np.ndarray]
    dimension: int
    n_blocks: int


def build(vectors: DataFrame, key: str, vector: str, dimension: int, subspaces: int = SUBSPACES, centroids: int = CENTROIDS, sample: int = SAMPLE, block: int = BLOCK) -> Codes:
    """Codes of the vectors of one length."""
    same = vectors.where((F.size(vector) == dimension) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    n_blocks = max(1, -(-same.count() // block))
    drawn = same.orderBy(F.xxhash64("key"), "key").limit(max(centroids, sample // max(1, dimension))).select("v").toArrow()
    fitted = fit(_unit(_matrix(drawn["v"], dimension)), subspaces, centroids)
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("codes", T.BinaryType()), T.StructField("residuals", T.BinaryType()), T.StructField("vectors", T.BinaryType())])

    def pack(rows: pa.Table) -> pa.Table:
        unit = _unit(_matrix(rows["v"], dimension))
        codes, left = encode(unit, fitted)
        keys = rows["key"].combine_chunks()
        return pa.table({"block": rows["block"].slice(0, 1), "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "codes": [codes.tobytes()], "residuals": [left.tobytes()], "vectors": [unit.tobytes()]})

    dealt = same.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"))
    return Codes(cut_lineage(dealt.groupBy("block").applyInArrow(pack, schema)), fitted, dimension, n_blocks)


def search(index: Codes, queries: DataFrame, k: int, n_queries: int) -> DataFrame:
    """(query, key, score, rank): of each query (q, v) the k best by max(0, cosine), ties to the smaller key."""
    centroids, dimension = index.centroids, index.dimension
    sets = max(1, -(-n_queries // QUERIES))
    # each set meets each block once: a set goes to every block, codes stay where they are
    asked = queries.where((F.size("v") == dimension) & F.col("q").isNotNull()).select("q", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("q"), F.lit(sets)).cast("int").alias("part"))
    kind, q_kind = index.blocks.schema["keys"].dataType.elementType, queries.schema["q"].dataType

    def scan(asks: DataFrame, each, schema, *columns: str) -> DataFrame:
        spread = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(index.n_blocks - 1))))
        copies = index.blocks.select("block", "codes", "residuals", *columns).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
        empty = pa.schema([(f.name, _arrow(f.dataType)) for f in schema]).empty_table()

        def run(blocks: pa.Table, some: pa.Table) -> pa.Table:
            if not blocks.num_rows or not some.num_rows:
                return empty
            codes = np.frombuffer(blocks["codes"][0].as_py(), np.uint8).reshape(-1, len(centroids))
            left, out = np.frombuffer(blocks["residuals"][0].as_py(), np.float32).astype(np.float64), []
            unit = _unit(_matrix(some["v"], dimension))
            held = each(blocks)
            for at in range(0, len(unit), STEP):
                near = approximate(unit[at:at + STEP], codes, centroids)
                # room for the rounding of sums of doubles
                out.append(held(some.slice(at, STEP), unit[at:at + STEP], near, left + 1e-9))
            return pa.concat_tables(out)

        return copies.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInArrow(run, schema)

    def lowest(blocks):
        def best(some, unit, near, room):
            lower = np.maximum(near - room, 0)
            take = min(k, lower.shape[1])
            best = -np.partition(-lower, take - 1, axis=1)[:, :take]
            return pa.table({"q": some["q"].take(pa.array(np.repeat(np.arange(len(lower)), take))), "low": best.ravel()})

        return best

    lows = scan(asked, lowest, T.StructType([T.StructField("q", q_kind), T.StructField("low", T.DoubleType())]))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("low")))
    floor = lows.withColumn("place", place).where(F.col("place") == k).select("q", F.col("low").alias("floor"))
    ready = cut_lineage(asked.join(floor, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))))

    def survivors(blocks):
        keys = blocks["keys"].combine_chunks().flatten()
        rows = np.frombuffer(blocks["vectors"][0].as_py(), np.float64).reshape(-1, dimension)
        order = np.empty(len(keys), np.int64)
        order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))

        def best(some, unit, near, room):
            open_ = np.maximum(near + room, 0) >= some["floor"].to_numpy()[:, None]
            at = np.flatnonzero(open_.any(axis=0))
            scores = np.maximum(unit @ rows[at].T, 0)
            of, found, values = [], [], []
            for i, (mine, score) in enumerate(zip(open_[:, at], scores, strict=True)):
                pick = np.flatnonzero(mine)
                pick = pick[np.lexsort((order[at[pick]], -np.round(score[pick], 9)))[:k]]
                of.append(np.full(len(pick), i))
                found.append(at[pick])
                values.append(score[pick])
            return pa.table({"q": some["q"].take(pa.array(np.concatenate(of))), "key": keys.take(pa.array(np.concatenate(found))), "score": np.concatenate(values)})

        return best

    scored = scan(ready, survivors, T.StructType([T.StructField("q", q_kind), T.StructField("key", kind), T.StructField("score", T.DoubleType())]), "keys", "vectors")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "key"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def cosine_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, label: str = "query", query_vector: str = "vector", where: dict | None = None, **sizes) -> DataFrame:
    """As ``similarity.cosine_topk``, through codes: (label, key, score, rank)."""
    usable = vectors.where(F.col(vector).isNotNull())
    for name, value in (where or {}).items():
        usable = usable.where(F.col(name) == F.lit(value))
    usable = cut_lineage(usable.select(key, vector))
    asked = cut_lineage(queries.where(F.size(query_vector) > 0).select(F.col(label).alias("q"), F.col(query_vector).alias("v")))
    parts = []
    for row in asked.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect():  # one row for each length of vectors
        index = build(usable, key, vector, row["d"], **sizes)
        parts.append(search(index, asked, k, row["n"]))
    if not parts:
        return vectors.sparkSession.createDataFrame([], T.StructType([T.StructField(label, queries.schema[label].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("q").alias(label), F.col("key").alias(key), "score", "rank")
