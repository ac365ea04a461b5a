"""Document quality by a linear-chain conditional random field over lines.

Each line is labelled good or bad.  A line's features are its character mix,
word shapes and repetitions, its length and place, and the main ones of the
line before and the line after.  Forward-backward gives each line's marginal
probability of being good; a document's score is their mean, weighted by the
lines' lengths.

Training knows documents' labels only: every line of a training document
carries the document's label, and the field is fitted to these chains by
gradient ascent with a penalty on the squared weights.  The sample is bounded:
``per_label`` documents of each label, chosen by a hash of the id, and at most
``lines`` consecutive lines of each.  Of an id that repeats, the text of the
smallest digest teaches.

Scoring reads whole texts: null counts as empty, an empty text (or one of
blank lines only) has one empty line and gets the share of good documents.
Rows are independent, so repeated rows and ties need no rule; further columns
pass through, and columns with a result's name are replaced.  Without
training rows every document scores 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import carried, fresh, quoted, small_batches
from .textbytes import Words, pieces, text_bytes

PER_LABEL = 1500
LINES = 64
#: Documents of at least this score are predicted good.
THRESHOLD = 0.7

# character classes: lower, upper, digit, white space, sentence marks, other marks, continuation and lead bytes
_KIND = np.full(256, 5, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 4
_KIND[128:192], _KIND[192:] = 6, 7
_N_KINDS = 8
_OWN = 15
_SHARED = (1, 3, 4, 6, 8, 9)  # own features that neighbouring lines see
N_FEATURES = _OWN + 2 * (len(_SHARED) + 1)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, first, blank): of every non-empty line, and where each document's lines begin.

    A document without such a line gets one empty line and is marked blank.
    """
    n = len(data)
    broken = data == 10
    begins = np.zeros(n, bool)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    begins[1:] |= broken[:-1]
    begins &= ~broken
    starts = np.flatnonzero(begins)
    # a line ends at the next break or the document's end
    stops = np.sort(np.concatenate([np.flatnonzero(broken), offsets[1:]]))
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    docs = np.searchsorted(offsets, starts, side="right") - 1
    # documents of no line stand as one empty line
    has = np.bincount(docs, minlength=len(offsets) - 1) > 0 if len(starts) else np.zeros(len(offsets) - 1, bool)
    empty = np.flatnonzero(~has)
    order = np.argsort(np.concatenate([docs, empty]), kind="stable")
    docs = np.concatenate([docs, empty])[order]
    starts = np.concatenate([starts, offsets[empty]])[order]
    ends = np.concatenate([ends, offsets[empty]])[order]
    lines = len(starts)
    first = np.searchsorted(docs, np.arange(len(offsets)))
    size = (ends - starts).astype(np.float64)
    own = np.zeros((lines, _OWN))
    if n:
        line_of = np.searchsorted(starts, np.arange(n), side="right") - 1
        line_of = np.maximum(line_of, 0)
        counts = np.bincount(line_of * _N_KINDS + _KIND[data], minlength=lines * _N_KINDS)[:lines * _N_KINDS].reshape(lines, _N_KINDS).astype(np.float64)
        total = np.maximum(counts.sum(axis=1), 1)
        letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 7], 1)
        own[:, 1] = counts[:, 1] / letters
        own[:, 2] = counts[:, 2] / total
        own[:, 3] = counts[:, 5] / total
        own[:, 4] = np.minimum(counts[:, 5] / np.maximum(counts[:, 3] + 1, 1), 4)
        own[:, 5] = counts[:, 4] / total
        own[:, 10] = counts[:, 3] / total
        words = Words(data, offsets)
        of = np.searchsorted(starts, words.starts, side="right") - 1 if lines else np.empty(0, np.int64)
        n_words = np.bincount(of, minlength=lines).astype(np.float64)
        some = np.maximum(n_words, 1)
        h = words.hashes
        again, second = np.zeros(len(h)), np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        second[2:] = (h[2:] == h[:-2]) & (of[2:] == of[:-2])
        own[:, 6] = np.bincount(of, again, lines) / some
        own[:, 7] = np.log1p(n_words) / 4
        own[:, 8] = np.bincount(of, second, lines) / some
        width = (words.ends - words.starts).astype(np.float64)
        own[:, 11] = np.bincount(of, width, lines) / some / 10
        # the share of words that came before in the document
        doc_of = docs[of]
        key = h ^ (doc_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        seen = np.zeros(len(h))
        seen[order[1:]] = key[order[1:]] == key[order[:-1]]
        own[:, 9] = np.bincount(of, seen, lines) / some
        last = data[np.maximum(ends - 1, 0)]
        own[:, 12] = (last == 46) & (size > 0)
        own[:, 13] = (data[np.minimum(starts, n - 1)] - 65 < 26) & (size > 0)
    own[:, 0] = 1
    own[:, 14] = np.log1p(size) / 6
    out = np.zeros((lines, N_FEATURES))
    out[:, :_OWN] = own
    near = own[:, _SHARED]
    same = docs[1:] == docs[:-1]
    width = len(_SHARED) + 1
    out[1:, _OWN:_OWN + width - 1] = near[:-1] * same[:, None]
    out[1:, _OWN + width - 1] = same
    out[:-1, _OWN + width:_OWN + 2 * width - 1] = near[1:] * same[:, None]
    out[:-1, -1] = same
    return out, size, first, ~has


@dataclass
class Field:
    """Weights of the line score (for good against bad), transition scores, and the share of good documents."""

    weights: np.ndarray
    moves: np.ndarray  # (bad, good) x (bad, good)
    prior: float


def _chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents by falling number of lines, and those numbers."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    return order, counts[order]


def forward_backward(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of good per line, expected moves, log partition per document), over all documents at once.

    ``emit`` is the good score of each line; a bad line scores 0.  Step t
    works on the t-th line of every document that has one.
    """
    order, counts = _chains(first)
    begin = first[:-1][order]
    lines = len(emit)
    alpha, beta = np.zeros((lines, 2)), np.zeros((lines, 2))
    score = np.stack([np.zeros(lines), emit], axis=1)
    longest = int(counts[0]) if len(counts) else 0
    active = [int(np.searchsorted(-counts, -t, side="left")) for t in range(longest + 1)]  # documents of over t lines
    if longest:
        alpha[begin] = score[begin]
    for t in range(1, longest):
        at = begin[:active[t]] + t
        prev = alpha[at - 1]
        for s in (0, 1):
            alpha[at, s] = np.logaddexp(prev[:, 0] + moves[0, s], prev[:, 1] + moves[1, s]) + score[at, s]
    for t in range(longest - 2, -1, -1):
        at = begin[:active[t + 1]] + t
        after = beta[at + 1] + score[at + 1]
        for s in (0, 1):
            beta[at, s] = np.logaddexp(after[:, 0] + moves[s, 0], after[:, 1] + moves[s, 1])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(lines, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    expected = np.zeros((2, 2))
    for s in (0, 1):
        for u in (0, 1):
            expected[s, u] = np.exp(alpha[at - 1, s] + moves[s, u] + score[at, u] + beta[at, u] - total[at]).sum() if len(at) else 0
    ends = first[1:] - 1
    return good, expected, np.logaddexp(alpha[ends, 0], alpha[ends, 1]) if len(first) > 1 else np.empty(0)


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, prior: float, steps: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximum conditional likelihood of chains whose lines all carry the document's label (both labels weigh the same)."""
    weights, moves = np.zeros(features.shape[1]), np.zeros((2, 2))
    counts = np.diff(first)
    y = np.repeat(labels.astype(np.float64), counts)
    # every document weighs the same, and so do both labels together
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    weigh = np.repeat(share / np.maximum(counts, 1), counts)
    stays = np.array([(share * (counts - 1) / np.maximum(counts, 1))[labels == s].sum() for s in (0, 1)])
    state = [np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)]
    inner_share = float((share * (counts - 1) / np.maximum(counts, 1)).sum())
    for step in range(1, steps + 1):
        good, expected, _ = forward_backward(features @ weights, first, moves)
        to_weights = features.T @ ((y - good) * weigh) - penalty * weights
        scale = inner_share / max(expected.sum(), 1e-9)
        to_moves = np.diag(stays) - expected * scale - penalty * moves
        grad = np.concatenate([to_weights, to_moves.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad * grad
        move = rate * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.999 ** step)) + 1e-8)
        weights = weights + move[:-4]
        moves = np.clip(moves + move[-4:].reshape(2, 2), -2.0, 2.0)
    return Field(weights, moves, prior)


_SAMPLE = "label int, n int, features binary"


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          per_label: int = PER_LABEL, lines: int = LINES) -> Field:
    """A field fitted to a bounded sample of the labelled documents; rows with nulls teach nothing."""
    known = labels.where(quoted(key).isNotNull() & quoted(label).isin(0, 1)).select(quoted(key).alias("__key"), quoted(label).cast("int").alias("label")).distinct()
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    draw = F.xxhash64("__key", F.lit("crf"))
    chosen = None
    for value in sorted(shares):
        some = known.where(F.col("label") == value).orderBy(draw, "__key").limit(per_label)
        chosen = some if chosen is None else chosen.union(some)
    if chosen is None:
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.5)
    sample = docs.where(quoted(text).isNotNull()).select(quoted(key).alias("__key"), quoted(text).alias("__text")).join(chosen, "__key")
    # one text for each drawn id, whatever its rows: the ids bound what reaches the driver
    sample = sample.groupBy("__key", "label").agg(F.min_by("__text", F.md5("__text")).alias("__text")).select("__key", "__text", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                features, _, first, _ = line_features(*text_bytes(part.column("__text")))
                keys, out, sizes = part.column("__key").to_pylist(), [], []
                for d, k in enumerate(keys):
                    a, b = int(first[d]), int(first[d + 1])
                    if b - a > lines:  # a stretch whose place follows from the id
                        a += zlib.crc32(str(k).encode()) % (b - a - lines + 1)
                        b = a + lines
                    out.append(features[a:b].astype(np.float32).tobytes())
                    sizes.append(b - a)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["label", "n", "features"])

    rows = sample.mapInArrow(extract, _SAMPLE).collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["features"])))
    if not rows:
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)), prior)
    features = np.concatenate([np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in rows]).astype(np.float64)
    first = np.concatenate(([0], np.cumsum([r["n"] for r in rows])))
    return fit(features, first, np.array([r["label"] for r in rows]), prior)


def score(df: DataFrame, field: Field, text: str = "text", keep_text: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher is better) and ``predicted``; without ``text`` unless asked for."""
    new = ("score", "predicted")
    kept = carried(df, [*new] + ([] if keep_text else [text]))
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    body = len(kept)  # the text travels behind the columns that stay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, body):
                features, size, first, blank = line_features(*text_bytes(part.column(body)))
                good, _, _ = forward_backward(features @ field.weights, first, field.moves)
                weight = np.maximum(size, 1e-9)
                value = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
                value = np.clip(np.where(blank, field.prior, value), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:body], pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=schema.names)

    return small_batches(df).select(*[quoted(f.name) for f in kept], quoted(text).alias(fresh(df, "__text"))).mapInArrow(run, schema)
