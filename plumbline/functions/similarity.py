"""Keywords, set similarity, recency and vector scores as column expressions."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that carry no meaning in a search, for keywords and for tokens.
KEYWORD_STOPS = (
    "the", "a", "an", "of", "and", "for", "to", "in", "by", "with", "on", "is", "are", "be", "this", "that", "it", "as", "at", "from", "or",
    "what", "how", "when", "where", "why", "which", "who", "can", "will", "should", "would", "could", "have", "has", "had", "do", "does", "did",
    "i", "you", "we", "they", "he", "she", "my", "your", "our", "their", "me", "us", "them", "all", "some", "any", "no", "not", "but", "if",
    "show", "get", "find", "give", "tell", "list", "display", "want", "need",
)
TOKEN_STOPS = ("the", "a", "an", "of", "and", "for", "to", "in", "by", "with", "on", "is", "are", "be", "this", "that")
E = 2.718281828
HALF_LIFE_DAYS = 14.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(text: Column, pattern: str, least: int, stops: tuple[str, ...]) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), pattern)
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= least) & ~w.isin(*stops)))


def keywords(text) -> Column:
    return _words(_c(text), "[^a-z0-9]+", 2, KEYWORD_STOPS)


def tokens(text) -> Column:
    return _words(_c(text), "[^a-z0-9_.]+", 3, TOKEN_STOPS)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets (arrays without repeats); 0 when both are empty."""
    return F.when((F.size(a) > 0) | (F.size(b) > 0), _overlap(F.size(a), F.size(b), F.size(F.array_intersect(a, b)))).otherwise(F.lit(0.0))


def _overlap(na: Column, nb: Column, both: Column) -> Column:
    return both / (na + nb - both)


def keyword_score(text, words: list[str]) -> Column:
    """max(jaccard, 0.8 x share of query words of 3+ letters found anywhere in the text).

    The text is split once: its size and the hits come from one array.
    """
    if not words:
        return F.lit(0.0)
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    query = F.array(*[F.lit(w) for w in words])
    counts = F.transform(F.array(keywords(text)), lambda kw: F.struct(F.size(kw).alias("n"), F.size(F.array_intersect(query, kw)).alias("both")))[0]
    exact = F.transform(F.array(counts), lambda c: _overlap(F.lit(len(words)), c["n"], c["both"]))[0]
    found = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words if len(w) >= 3), F.lit(0))
    return F.when(low != "", F.greatest(exact, found / len(words) * 0.8)).otherwise(F.lit(0.0))


def query_words(query: str | None) -> list[str]:
    """Distinct keywords of a question, in order."""
    found = re.split("[^a-z0-9]+", (query or "").lower())
    return list(dict.fromkeys(w for w in found if len(w) >= 2 and w not in KEYWORD_STOPS))


def age_days(now: Column, then) -> Column:
    gap = F.unix_micros(now.cast("timestamp")) - F.unix_micros(_c(then).cast("timestamp"))
    return F.greatest(gap / 86_400e6, F.lit(0.0))


def recency(now: Column, last_used, missing_days: float | None = None) -> Column:
    """exp(-age / 14 days); a missing time counts as ``missing_days``, or as 0.0 when that is None."""
    age = age_days(now, last_used)
    if missing_days is not None:
        return F.pow(F.lit(E), -F.coalesce(age, F.lit(missing_days)) / HALF_LIFE_DAYS)
    return F.coalesce(F.pow(F.lit(E), -age / HALF_LIFE_DAYS), F.lit(0.0))


def blend(keyword: Column, semantic: Column) -> Column:
    return F.coalesce(0.5 * keyword + 0.5 * semantic, keyword)


#: Query vectors scored in one scan; more of them take more scans.
QUERIES_PER_SCAN = 4096


def cosine_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, label: str = "query", query_vector: str = "vector",
                where: dict | None = None, ids: list | None = None) -> DataFrame:
    """Best ``k`` rows per query (``label``, ``query_vector``) by ``max(0, cosine)``.

    ``where`` gives column values that rows must have (organisation, kind,
    model), ``ids`` the only keys that may be found: an empty list finds none.
    Each Arrow batch is scored against a bounded set of queries at once and
    hands on at most ``k`` rows per query and tie, so the shuffle carries
    candidates only; the driver holds one set of queries at a time.
    """
    usable = vectors
    for name, value in (where or {}).items():
        usable = usable.where(F.col(name) == F.lit(value))
    if ids is not None:
        usable = usable.where(F.col(key).isin(*ids) if ids else F.lit(False))
    kind, name_kind = vectors.schema[key].dataType.simpleString(), queries.schema[label].dataType.simpleString()
    rows = queries.where(F.col(query_vector).isNotNull()).select(F.col(label).alias("q"), F.col(query_vector).alias("v")).toLocalIterator()
    near = None
    while part := list(islice(rows, QUERIES_PER_SCAN)):
        for dim in sorted({len(r["v"]) for r in part}):
            same = [r for r in part if len(r["v"]) == dim]
            scored = usable.where(F.size(vector) == dim).select(key, vector).mapInArrow(
                _scorer([r["q"] for r in same], np.asarray([r["v"] for r in same], dtype=np.float64), k, key), f"query {name_kind}, {key} {kind}, score double")
            near = scored if near is None else near.unionByName(scored)
    if near is None:
        return vectors.sparkSession.createDataFrame([], f"query {name_kind}, {key} {kind}, score double, rank int")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), key))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _scorer(labels: list, matrix: np.ndarray, k: int, key: str):
    dim = matrix.shape[1]
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            size = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
            scores = np.maximum(rows @ unit.T, 0.0)
            keep = min(k, len(rows))
            for j, name in enumerate(labels):
                s = scores[:, j]
                floor = np.partition(s, len(s) - keep)[len(s) - keep]
                # every row tied with the k-th score stays: the tie-break needs the keys
                pick = np.flatnonzero(s >= floor)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pick)), ids.take(pa.array(pick)), pa.array(s[pick])], ["query", key, "score"])

    return run
