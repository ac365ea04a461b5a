"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; every later model also sees the
earlier categories' probabilities.  It is trained with out-of-fold ones: each
training row gets them from a model that has not seen the row's fold, so that
the chain learns from probabilities as unsure as those it will meet.

A model is a logistic regression over hashed counts (log of one plus the
count) of words, word beginnings and runs of other marks, plus the earlier
logits; only buckets whose share of documents differs clearly between the two
answers take part.  Words are
lower-cased runs of letters, digits and non-ASCII characters.

Training reads a bounded sample: at most ``per_label`` labelled documents for
each combination of labels, chosen by a hash of the id; rows with a null id,
text or label teach nothing.  Scoring reads whole texts; null counts as empty
and gets what the intercepts say.  Rows are independent, so repeated rows need
no rule; further columns pass through, and columns with a result's name are
replaced.  Without training rows every probability is 0.5 and nothing is
flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import carried, fresh, quoted, small_batches
from .textbytes import IS_WORD, Words, pieces, runs, span_hashes, text_bytes

PER_LABEL = 1200
FOLDS = 3
BUCKETS = 1 << 18
#: Word beginnings, in bytes, that are features beside the whole word.
BEGINNINGS = (6, 8, 10)
#: Buckets whose share differs between the two answers by fewer standard errors stay out of a model.
Z_LEAST = 4.0
_MARKS = ~IS_WORD & (np.arange(256) > 32)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value, first): hashed features of each document, and where each document's begin."""
    words = Words(data, offsets)
    docs = words.documents()
    hashes, owners = [words.hashes], [docs]
    for size in BEGINNINGS:
        long = np.flatnonzero(words.ends - words.starts > size)
        hashes.append(span_hashes(words.data, words.starts[long], words.starts[long] + size) ^ np.uint64(0xA5A5A5A5 * size))
        owners.append(docs[long])
    starts, ends = runs(_MARKS[data], offsets)
    hashes.append(span_hashes(data, starts, ends) ^ np.uint64(0x5C5C5C5C))
    owners.append(np.searchsorted(offsets, starts, side="right") - 1)
    bucket = (np.concatenate(hashes) >> np.uint64(40)).astype(np.int64) % BUCKETS
    keys, counts = np.unique(np.concatenate(owners) * BUCKETS + bucket, return_counts=True)
    first = np.searchsorted(keys, np.arange(len(offsets)) * BUCKETS)
    return keys % BUCKETS, np.log1p(counts), first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the stretches that begin at ``first``; an empty stretch sums to 0."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


@dataclass
class Model:
    """One link of the chain."""

    name: str
    weights: np.ndarray  # by bucket
    earlier: np.ndarray  # of the earlier categories' logits
    intercept: float

    def logits(self, bucket, value, first, earlier: np.ndarray) -> np.ndarray:
        return _sums(self.weights[bucket] * value, first) + earlier @ self.earlier + self.intercept


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(name: str, bucket, value, first, earlier: np.ndarray, y: np.ndarray, weigh: np.ndarray, steps: int = 300, rate: float = 0.1, penalty: float = 1e-4) -> Model:
    """Logistic regression by gradient steps over the buckets that tell the answers apart."""
    rows = np.repeat(np.arange(len(y)), np.diff(first))
    yes, no = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    in_yes = np.bincount(bucket, y[rows], BUCKETS)
    in_all = np.bincount(bucket, minlength=BUCKETS)
    share = in_all / len(y)
    z = (in_yes / yes - (in_all - in_yes) / no) / np.sqrt(np.maximum(share * (1 - share), 1 / len(y)) * (1 / yes + 1 / no))
    used = (np.abs(z) >= Z_LEAST) & (in_all >= 5)
    inside = used[bucket]
    place = np.cumsum(used) - 1
    col, val, rows = place[bucket[inside]], value[inside], rows[inside]
    n = int(used.sum())
    theta = np.zeros(n + earlier.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weigh = weigh / weigh.sum()
    for step in range(1, steps + 1):
        logit = np.bincount(rows, theta[col] * val, len(y)) + earlier @ theta[n:-1] + theta[-1]
        err = (_sigmoid(logit) - y) * weigh
        grad = np.concatenate([np.bincount(col, err[rows] * val, n), earlier.T @ err, [err.sum()]])
        grad[:-1] += penalty * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[used] = theta[:n]
    return Model(name, weights, theta[n:-1], float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str, int]], text: str = "text", key: str = "doc_id",
          per_label: int = PER_LABEL, folds: int = FOLDS) -> list[Model]:
    """The chain for ``categories``: (name, label column, value that means yes), in the order of prediction."""
    columns = list(dict.fromkeys(c for _, c, _ in categories))
    known = labels.select(quoted(key).alias("__key"), *[quoted(c).alias(f"y_{c}") for c in columns]).dropna().distinct()
    sizes = known.groupBy(*[f"y_{c}" for c in columns]).agg(F.count("*").alias("n")).collect()
    if not sizes:
        return [Model(n, np.zeros(BUCKETS), np.zeros(i), 0.0) for i, (n, _, _) in enumerate(categories)]
    chosen, draw = None, F.xxhash64("__key", F.lit("toxicity"))
    for r in sorted(sizes, key=str):
        same = known
        for c in columns:
            same = same.where(F.col(f"y_{c}") == r[f"y_{c}"])
        same = same.orderBy(draw, "__key").limit(per_label).withColumn("__stands", F.lit(r["n"] / min(r["n"], per_label)))
        chosen = same if chosen is None else chosen.union(same)
    sample = docs.where(quoted(text).isNotNull()).select(quoted(key).alias("__key"), quoted(text).alias("__text")).join(chosen, "__key")
    # one text for each drawn id, whatever its rows: the ids bound what reaches the driver
    sample = sample.groupBy(*chosen.columns).agg(F.min_by("__text", F.md5("__text")).alias("__text"))
    sample = sample.select(F.xxhash64("__key", F.lit("fold")).alias("h"), "__stands", "__text", *[f"y_{c}" for c in columns])
    out = T.StructType([T.StructField("h", T.LongType()), T.StructField("__stands", T.DoubleType()), T.StructField("bucket", T.BinaryType()), T.StructField("value", T.BinaryType()),
                        *[T.StructField(f"y_{c}", sample.schema[f"y_{c}"].dataType) for c in columns]])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                bucket, value, first = features(*text_bytes(part.column("__text")))
                cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("h"), part.column("__stands"), pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary()),
                     pa.array([value[a:b].astype(np.float32).tobytes() for a, b in cut], pa.binary()), *[part.column(f"y_{c}") for c in columns]], names=out.names)

    rows = sorted(sample.mapInArrow(extract, out).collect(), key=lambda r: (r["h"], bytes(r["bucket"])))
    if not rows:
        return [Model(n, np.zeros(BUCKETS), np.zeros(i), 0.0) for i, (n, _, _) in enumerate(categories)]
    bucket = np.concatenate([np.frombuffer(r["bucket"], np.int32) for r in rows]).astype(np.int64)
    value = np.concatenate([np.frombuffer(r["value"], np.float32) for r in rows]).astype(np.float64)
    first = np.concatenate(([0], np.cumsum([len(r["bucket"]) // 4 for r in rows])))
    weigh = np.array([r["__stands"] for r in rows])
    fold = np.array([r["h"] % folds for r in rows])
    chain: list[Model] = []
    earlier = np.zeros((len(rows), 0))

    def part(keep: np.ndarray):
        counts = np.diff(first)[keep]
        inside = np.repeat(keep, np.diff(first))
        return bucket[inside], value[inside], np.concatenate(([0], np.cumsum(counts)))

    for i, (name, column, yes) in enumerate(categories):
        y = np.array([r[f"y_{column}"] == yes for r in rows], np.float64)
        # both answers weigh the same in training; the intercept is set right afterwards
        share = (weigh * y).sum() / weigh.sum()
        even = weigh * np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        shift = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        model = fit(name, bucket, value, first, earlier, y, even)
        model.intercept += 0.5 * shift
        chain.append(model)
        if i + 1 < len(categories):
            unseen = np.zeros(len(rows))
            for f in range(folds):
                train_rows, rest = fold != f, fold == f
                if not train_rows.any() or not rest.any():
                    continue
                half = fit(name, *part(train_rows), earlier[train_rows], y[train_rows], even[train_rows])
                half.intercept += 0.5 * shift
                unseen[rest] = half.logits(*part(rest), earlier[rest])
            earlier = np.column_stack([earlier, np.clip(unseen, -10, 10)])
    return chain


def score(df: DataFrame, chain: list[Model], text: str = "text", keep_text: bool = False, threshold: float = 0.35) -> DataFrame:
    """``df`` with the probability ``p_<category>`` of every category and ``is_<category>`` (above the threshold)."""
    new = [f"p_{m.name}" for m in chain] + [f"is_{m.name}" for m in chain]
    kept = carried(df, [*new] + ([] if keep_text else [text]))
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType() if n.startswith("p_") else T.BooleanType()) for n in new]])
    body = len(kept)  # the text travels behind the columns that stay
    sent = df.sparkSession.sparkContext.broadcast([(m.name, m.weights, m.earlier, m.intercept) for m in chain])  # one weight for each bucket and category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(*m) for m in sent.value]
        for batch in batches:
            for part in pieces(batch, body):
                bucket, value, first = features(*text_bytes(part.column(body)))
                earlier = np.zeros((part.num_rows, 0))
                for m in models:
                    z = m.logits(bucket, value, first, earlier)
                    earlier = np.column_stack([earlier, np.clip(z, -10, 10)])
                p = _sigmoid(earlier)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:body], *[pa.array(p[:, i]) for i in range(len(models))],
                     *[pa.array(p[:, i] > threshold) for i in range(len(models))]], names=schema.names)

    return small_batches(df).select(*[quoted(f.name) for f in kept], quoted(text).alias(fresh(df, "__text"))).mapInArrow(run, schema)
