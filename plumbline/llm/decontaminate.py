"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of an item (an item of fewer words,
but not none, is one window).  Of both sides the minimum hash of every run of
``window - gram + 1`` consecutive word ``gram``-s is kept, so two texts that
share ``window`` words share a kept gram inside them: none is missed.  Kept
grams of the documents first pass a bitmap of the items' grams (fixed size),
then join them; every hit brings the words around it, which are extended to
the left and right word by word.  Words are compared as text, so the result
is exact.  Items shorter than a window are found by hashing runs of just
their length.

Null and empty texts have no words and are hit by nothing; null or empty
items have no windows.  Documents are told apart by their row, so repeated
rows, equal ids and null ids each give a row of their own; equal items count
each.  Further columns are carried where the caller names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .shared import bloom_hits, bloom_words, fresh, quoted, small_batches
from .textbytes import Words, grams, pieces, text_bytes

WINDOW = 13
GRAM = 8

_ANCHOR = T.ArrayType(T.StructType([
    T.StructField("fp", T.LongType()), T.StructField("need", T.IntegerType()), T.StructField("at", T.IntegerType()),
    T.StructField("off", T.IntegerType()), T.StructField("ctx", T.StringType()),
]))


def kept_grams(hashes: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some window of ``window`` words."""
    got = grams(hashes, gram)
    n = len(got)
    if not n:
        return np.empty(0, np.int64), got
    whole = np.ones(n, bool)
    for j in range(1, gram):  # a gram must not run over a document's end
        edge = first[1:-1] - j
        whole[edge[(edge >= 0) & (edge < n)]] = False
    got[~whole] = np.iinfo(np.uint64).max
    span = window - gram + 1
    least = np.full(n + span - 1, np.iinfo(np.uint64).max, np.uint64)  # least[i + span - 1]: of grams i to i + span - 1
    padded = np.concatenate([np.full(span - 1, np.iinfo(np.uint64).max, np.uint64), got, np.full(span - 1, np.iinfo(np.uint64).max, np.uint64)])
    for j in range(span):
        np.minimum(least, padded[j:j + len(least)], out=least)
    most = least[:n].copy()
    for j in range(1, span):
        np.maximum(most, least[j:j + n], out=most)
    at = np.flatnonzero((most == got) & whole)
    return at, got[at]


def _anchors(words: Words, d: int, at: np.ndarray, fps: np.ndarray, need: int, gram: int) -> list[dict]:
    """Kept grams of document ``d`` with as many words around them as a window through them can reach."""
    a, b = int(words.first[d]), int(words.first[d + 1])
    out = []
    for p, fp in zip(at.tolist(), fps.view(np.int64).tolist(), strict=True):
        lo, hi = max(a, p - (need - gram)), min(b, p + need)
        out.append({"fp": fp, "need": need, "at": p - a, "off": p - lo, "ctx": words.text(lo, hi)})
    return out


def _pass(df: DataFrame, text: str, keep: list[str], bloom: np.ndarray | None, short: list[int], window: int, gram: int) -> DataFrame:
    """One row per row of ``df``: a row number, the kept columns, the words' count and the kept grams.

    Without ``bloom`` (the items' side) every text gives all its kept grams,
    and a short one itself; with it, only grams that may be an item's.
    """
    carried = [quoted(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    schema = T.StructType(
        [T.StructField("uid", T.LongType())] + [T.StructField(f"k_{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
        + [T.StructField("n_words", T.LongType()), T.StructField("anchors", _ANCHOR)])
    types = pa.list_(pa.struct([("fp", pa.int64()), ("need", pa.int32()), ("at", pa.int32()), ("off", pa.int32()), ("ctx", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, "__text"):
                words = Words(*text_bytes(part.column("__text")))
                n = part.num_rows
                found: list[list[dict]] = [[] for _ in range(n)]
                sizes = [(window, gram)] + [(k, k) for k in short]
                for need, size in sizes:
                    at, fps = kept_grams(words.hashes, words.first, size, need)
                    if bloom is not None:
                        ok = bloom_hits(bloom, fps)
                        at, fps = at[ok], fps[ok]
                    if not len(at):
                        continue
                    owner = np.searchsorted(words.first, at, side="right") - 1
                    cuts = np.flatnonzero(np.diff(owner)) + 1
                    for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(at)].tolist(), strict=True):
                        d = int(owner[lo])
                        # of an item only its own window length counts
                        if bloom is None and need != min(int(words.counts[d]), window):
                            continue
                        found[d] += _anchors(words, d, at[lo:hi], fps[lo:hi], need, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), *[part.column(f"k_{i}") for i in range(len(keep))],
                     pa.array(words.counts.astype(np.int64)), pa.array(found, types)], names=schema.names)
                row += n

    return small_batches(df).select(*carried, quoted(text).alias("__text")).mapInArrow(run, schema)


def extend(words: list[str], at: int, item: list[str], item_at: int) -> tuple[int, int]:
    """How far two texts agree around positions known to correspond: words before, words from there on."""
    back = 0
    while back < at and back < item_at and words[at - back - 1] == item[item_at - back - 1]:
        back += 1
    ahead = 0
    while at + ahead < len(words) and item_at + ahead < len(item) and words[at + ahead] == item[item_at + ahead]:
        ahead += 1
    return back, ahead


_SPAN = "uid long, ctx_id long, start long, stop long"


def _extend_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for r in batch.to_pylist():
            back, ahead = extend(r["ctx"].split(" "), r["off"], r["item_ctx"].split(" "), r["item_off"])
            if back + ahead >= r["need"]:
                out.append((r["uid"], r["ctx_id"], r["at"] - back, r["at"] + ahead))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["uid", "ctx_id", "start", "stop"])


def spans(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id",
          window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, windows): every occurrence of an item's window in a document.

    ``documents`` has uid, the columns ``keep`` as k_0, k_1, ... and n_words;
    ``hits`` has uid, ctx_id, start and stop (word positions, stop excluded);
    ``windows`` maps ctx_id to the ids of the items that hold that stretch.
    """
    sides = cut_lineage(_pass(items, text, [item_id], None, list(range(1, window)), window, gram))
    short = sorted(r.n for r in sides.where(f"n_words between 1 and {window - 1}").select(F.col("n_words").cast("int").alias("n")).distinct().collect())
    grams_of = sides.select(F.col("k_0").alias("item_id"), F.explode("anchors").alias("x")).select("item_id", "x.*")
    # the same stretch of several items is held once
    ctx_id = F.xxhash64("fp", "need", "off", "ctx")
    grams_of = cut_lineage(grams_of.withColumn("ctx_id", ctx_id))
    stretches = cut_lineage(grams_of.groupBy("ctx_id", "fp", "need", "off", "ctx").agg(F.count("*").alias("times"))
                            .select("ctx_id", "fp", "need", F.col("off").alias("item_off"), F.col("ctx").alias("item_ctx")))
    held = grams_of.select("ctx_id", "item_id").distinct()
    passed = cut_lineage(_pass(docs, text, keep, bloom_words(stretches, "fp"), short, window, gram))
    near = passed.select("uid", F.explode("anchors").alias("x")).select("uid", "x.*")
    hits = near.join(stretches, ["fp", "need"]).select("uid", "at", "off", "ctx", "need", "ctx_id", "item_off", "item_ctx")
    return passed.drop("anchors"), cut_lineage(hits.mapInArrow(_extend_rows, _SPAN)), held


def report(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id",
           share: int = 20, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: uid, the columns ``keep``, and how much of it items cover.

    ``contaminated``: some word is hit, and ``share`` times the hit words are
    at least all words.
    """
    passed, hits, held = spans(docs, items, keep, text, item_id, window, gram)
    # overlapping spans count each word once
    covered = (hits.select("uid", "start", "stop").distinct()
               .select("uid", F.explode(F.sequence("start", F.col("stop") - 1)).alias("p"))
               .groupBy("uid", "p").agg(F.count("*").alias("times")).groupBy("uid").agg(F.count("*").alias("n_hit")))
    by_item = (hits.select("uid", "ctx_id").distinct().join(held, "ctx_id").select("uid", F.col("item_id").cast("string").alias("item")).distinct()
               .groupBy("uid").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items")))
    found = cut_lineage(covered.join(by_item, "uid", "left"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return passed.join(found, "uid", "left").select(
        "uid", *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", **rule) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, with all their columns.

    The decision is a function of the text, so it is carried back by the
    text's digest: equal texts share it.
    """
    key = fresh(docs, "__text_key")
    keyed = docs.withColumn(key, F.unhex(F.md5(quoted(text))))
    bad = cut_lineage(report(keyed, items, [key], text, item_id, **rule).where("contaminated").select(key).distinct())
    return keyed.join(bad, key, "left_anti").drop(key)
