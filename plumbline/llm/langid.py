"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1: those below U+0100 one each, the
others one of about 140 that they share by hash.  A letter three-gram is bound
by multiplying its letters' vectors, each rotated by its place; a text's
vector is the sum (bundle) of its three-grams' vectors, and a language's
prototype the sum of the unit vectors of its training texts.  A text gets the
language whose prototype has the largest cosine with its vector.

Letters are Unicode letters, lower-cased; everything else counts as one gap.
Null texts and texts without a letter get ``und`` and score 0.  Ties go to the
language that sorts first.  Texts are read whole, whatever their length; rows
are independent, so repeated rows need no rule; further columns pass through,
and columns of ``df`` with a result's name are replaced.

Training reads a bounded sample: about ``per_language`` texts of each language,
chosen by a hash of id and text.  Rows whose text, language or id is null teach
nothing.  Without any training row every text gets ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import class_table
from .shared import carried, fresh, quoted, small_batches
from .textbytes import pieces, text_bytes, worker_cache

UNKNOWN = "und"
DIMENSIONS = 1024
#: Training texts of a language, in expectation.
PER_LANGUAGE = 1500
_DIRECT = 0x100  # letters below have a symbol of their own, the others share the rest by hash
_SYMBOLS = 0x100


class Profiles:
    """Turns texts into hypervectors; three-gram vectors are made once per worker."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 20240607):
        letter = class_table() == 1
        points = np.arange(len(letter))
        own = np.cumsum(letter[:_DIRECT])
        shared = own[-1] + 1 + (points * 2654435761 >> 7) % (_SYMBOLS - own[-1] - 1)
        shared[:_DIRECT] = own
        self.symbol = np.where(letter, shared, 0).astype(np.int32)
        self.dimensions = dimensions
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (_SYMBOLS, dimensions))
        # of each three-gram: its row in ``bound``, counted from 1; pages that no three-gram falls into stay untouched
        self.place = np.zeros(_SYMBOLS ** 3, np.int32)
        self.bound = np.empty((4096, dimensions), np.int8)
        self.n_bound = 0

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The rows of three-gram vectors, bound when first met."""
        got = self.place[codes]
        if (got == 0).any():
            new = np.unique(codes[got == 0])
            need = self.n_bound + len(new)
            if need > len(self.bound):
                grown = np.empty((max(need, 2 * len(self.bound)), self.dimensions), np.int8)
                grown[:self.n_bound] = self.bound[:self.n_bound]
                self.bound = grown
            a, b, c = new // (_SYMBOLS * _SYMBOLS), new // _SYMBOLS % _SYMBOLS, new % _SYMBOLS
            self.bound[self.n_bound:need] = np.roll(self.letters[a], 2, axis=1) * np.roll(self.letters[b], 1, axis=1) * self.letters[c]
            self.place[new] = np.arange(self.n_bound + 1, need + 1)
            self.n_bound = need
            got = self.place[codes]
        return got - 1

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hypervectors of the texts, which of them hold a letter, and how many three-grams each has."""
        data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
        symbols = self.symbol[np.frombuffer(data.tobytes().decode(errors="replace").encode("utf-32-le"), np.int32)]
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        edges = lead[offsets]
        stay = np.ones(len(symbols), bool)
        stay[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        begin = edges[:-1]
        stay[begin[begin < len(symbols)]] = True
        kept = np.flatnonzero(stay)
        first = np.searchsorted(kept, edges)
        s = symbols[kept]
        codes = (s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:] if len(s) > 2 else np.empty(0, np.int32)
        rows = self.rows(codes)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        letters = np.concatenate(([0], np.cumsum(s != 0)))
        for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b - a > 2:
                counts = np.bincount(rows[a:b - 2])
                own = np.flatnonzero(counts)
                out[d] = counts[own].astype(np.float32) @ self.bound[own].astype(np.float32)
            elif b > a:  # one or two letters: padded with gaps
                pad = np.zeros(3, np.int64)
                pad[:b - a] = s[a:b]
                out[d] = self.bound[self.rows(np.array([(pad[0] * _SYMBOLS + pad[1]) * _SYMBOLS + pad[2]]))[0]]
        has = letters[first[1:]] > letters[first[:-1]]
        out[~has] = 0
        return out, has, np.maximum(np.diff(first) - 2, 0)


def _of(dimensions: int) -> Profiles:
    known = worker_cache("profiles", large=True)
    if dimensions not in known:
        known[dimensions] = Profiles(dimensions)
    p = known[dimensions]
    if p.n_bound > 60_000:  # bounds the memory: start again
        p.place = np.zeros(_SYMBOLS ** 3, np.int32)
        p.n_bound, p.bound = 0, np.empty((4096, dimensions), np.int8)
    return p


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The prototype of each language, learned from a sample of about ``per_language`` texts."""
    rows = rows.where(quoted(text).isNotNull() & quoted(lang).isNotNull() & quoted(key).isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy(quoted(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    million = 1_000_000
    # by row, not by id alone: an id that repeats brings each of its texts on its own
    draw = F.pmod(F.xxhash64(quoted(key).cast("string"), quoted(text), F.lit("langid")), F.lit(million))
    limit = F.lit(million)
    for name, n in counts.items():
        if n > per_language:
            limit = F.when(quoted(lang) == name, max(1, round(million * per_language / n))).otherwise(limit)
    sample = rows.where(draw < limit).select(quoted(text).alias("__text"), quoted(lang).alias("lang"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "__text"):
                units = _unit(_of(dimensions).vectors(part.column("__text"))[0]).astype(np.float64)
                for name, u in zip(part.column("lang").to_pylist(), units, strict=True):
                    sums[name] = sums.get(name, 0) + u
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "sum"])

    out: dict[str, np.ndarray] = {}
    for r in sorted(sample.mapInArrow(bundle, "lang string, sum binary").collect(), key=lambda r: (r["lang"], bytes(r["sum"]))):
        out[r["lang"]] = out.get(r["lang"], 0) + np.frombuffer(r["sum"])
    return {name: _unit(v).astype(np.float32) for name, v in sorted(out.items())}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep_text: bool = False, counted: str | None = None) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (the cosine, at least 0); without ``text`` unless asked for.

    ``counted`` names a further column for the number of the text's three-grams.
    """
    names = list(prototypes)
    dimensions = len(next(iter(prototypes.values()))) if names else DIMENSIONS
    matrix = np.stack([prototypes[n] for n in names], axis=1) if names else np.zeros((dimensions, 0), np.float32)
    new = ["lang_pred", "score"] + ([counted] if counted else [])
    kept = carried(df, [*new] + ([] if keep_text else [text]))
    more = [T.StructField(counted, T.LongType())] if counted else []
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *more])
    body = len(kept)  # the text travels behind the columns that stay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, body):
                vectors, has, grams = _of(dimensions).vectors(part.column(body))
                if names:
                    cosines = _unit(vectors) @ matrix
                    best = np.argmax(cosines, axis=1)
                    score = np.where(has, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                    lang = [names[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                else:
                    lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:body], pa.array(lang, pa.string()), pa.array(score), *([pa.array(grams.astype(np.int64))] if counted else [])], names=schema.names)

    return small_batches(df).select(*[quoted(f.name) for f in kept], quoted(text).alias(fresh(df, "__text"))).mapInArrow(run, schema)


def held_out(key: str, modulus: int, remainder: int):
    """Whether a row is kept from training: crc32 of its id as text, modulo; a null id is not held out."""
    return F.coalesce(F.crc32(quoted(key).cast("string")) % modulus == remainder, F.lit(False))
