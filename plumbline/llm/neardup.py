"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is the sequence of its word five-grams (one gram of all words, if there
are fewer).  Each gram is labelled with its occurrence number, so repeats
count.  For each of ``SKETCHES`` hash functions the ``ORDER`` least labelled
grams are kept *in text order*; the hash of that sequence is a sketch.  Texts
that share a sketch are candidates.  Because order is kept, sketches agree for
texts of small edit distance, not merely for equal sets of grams.

Of few grams one edit changes too many sketches, so short texts have exact
keys beside them: in one fixed order of labelled grams, two texts that the
threshold lets link share one among the first ``len - need + 1`` of each,
where ``need`` is the number of grams that the threshold asks them to share.
Every text whose ``need`` is below ``SHORT`` has these as further buckets.  So
a link of a text of fewer than ``SHORT`` grams is always a candidate.

A candidate pair is a link if the edit similarity of the two gram sequences,
one minus their Levenshtein distance over the longer length, is at least
``threshold``; the alignment is computed in the diagonal band that the
threshold leaves open, after a bound from the common grams.  Classes are the
connected components of the links.

Equal texts are brought together first by digest.  Then three rounds find the
links that matter to the classes.  A bucket's middle is its member whose own
buckets are the fullest, so in a group of copies the text they were made from.
Each text is compared with the weightiest middle of its buckets; then with
the middles of buckets where the two are not yet in one class; and finally
members of one bucket that are still in different classes.  For these a bound
keeps the pairs few: a text that has too little in common with the middle can
be linked only to one that shares a gram with it which the middle lacks, so
such pairs are found by an equi-join on grams.  Pairs that the rounds skip are
joined by other links or cannot be linked, so no class is lost, and a large
group of copies costs a few comparisons for each member.

Null texts and texts without a word are classes of their own rows: they link
to nothing, not even to each other.  Repeated rows are exact copies.  Ids may
be null or repeat: a class is named by its smallest id (null if all are).
Texts are read whole.  Columns of the input that clash with a result's name
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import bloom_hits, bloom_words, components, fresh, quoted, small_batches
from .textbytes import Words, grams, mix, pieces, text_bytes

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 48
ORDER = 5
#: Links of texts of fewer grams do not depend on sketches.
SHORT = 30
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_MAX = np.iinfo(np.uint64).max
_PREFIX = np.uint64(0xC2B2AE3D27D4EB4F)  # keeps exact keys apart from sketches


def shingles(words: Words) -> list[np.ndarray]:
    """The gram hashes of each document, in text order."""
    whole = grams(words.hashes, WORDS)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(whole[a:b - WORDS + 1])
        else:
            out.append(grams(words.hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def labelled(seq: np.ndarray) -> np.ndarray:
    """The grams with their occurrence numbers mixed in."""
    order = np.argsort(seq, kind="stable")
    ordered = seq[order]
    new = np.ones(len(seq), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if new.all():
        return mix(seq)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(seq)), 0))
    out = np.empty(len(seq), np.uint64)
    out[order] = mix(ordered + (np.arange(len(seq)) - begin).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def sketch(seq: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each hash function the hash of the ``order`` least grams, taken in text order."""
    marks = labelled(seq)
    n = len(marks)
    keep = min(order, n)
    out = np.empty(len(_SEEDS), np.uint64)
    step = max(1, (1 << 18) // n)  # functions at once: bounds the table
    for lo in range(0, len(_SEEDS), step):
        seeds = _SEEDS[lo:lo + step]
        values = marks[None, :] * seeds[:, None]
        values ^= values >> np.uint64(32)
        rows = np.arange(len(seeds))
        at = np.empty((len(seeds), keep), np.int64)
        for j in range(keep):
            at[:, j] = values.argmin(axis=1)
            values[rows, at[:, j]] = _MAX
        at.sort(axis=1)
        got = np.arange(lo, lo + len(seeds), dtype=np.uint64)
        for j in range(keep):
            got = mix(got * np.uint64(0x9FB21C651E98DF25) + marks[at[:, j]])
        out[lo:lo + len(seeds)] = got
    return out


def needed(n: int, threshold: float) -> int:
    """How many labelled grams a text of ``n`` grams shares at least with whatever it is linked to."""
    return n - int((1 - threshold) * n + 1e-9)


def short_keys(seq: np.ndarray, threshold: float = SIMILARITY) -> np.ndarray:
    """The exact keys of a short text, one of which every link of it has too; none for other texts."""
    need = needed(len(seq), threshold)
    return mix(np.sort(labelled(seq))[:len(seq) - max(need, 1) + 1] ^ _PREFIX) if need < SHORT else np.empty(0, np.uint64)


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The Levenshtein distance of two sequences if it is at most ``most``, else ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    short = min(len(a), len(b))  # equal ends cost nothing
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    if short:
        differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
        tail = int(differ[0]) if len(differ) else short
        a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    # cell j of row i stands for b[: i + j - most]; a column outside b costs too much
    width = 2 * most + 1
    steps = np.arange(width)
    far = most + 1
    padded = np.full(m + 2 * width, 0, np.uint64)
    padded[width:width + m] = b
    inside_lo, inside_hi = most, m + most  # column = i + j - most lies in 0..m
    row = np.where(steps >= most, steps - most, far)
    for i in range(1, n + 1):
        # substitution keeps j, deletion takes j + 1 of the row above, insertion j - 1 of this row
        cells = padded[width + i - most - 1:width + i - most - 1 + width]
        now = row + (cells != a[i - 1])
        now[:-1] = np.minimum(now[:-1], row[1:] + 1)
        lo, hi = max(0, inside_lo - i), min(width - 1, inside_hi - i)
        if lo > 0 or i <= most:
            now[:max(lo, 0)] = far
        if i <= most:
            now[lo] = min(int(now[lo]), i)
        now[hi + 1:] = far
        row = np.minimum(np.minimum.accumulate(now - steps) + steps, far)
        row[hi + 1:] = far
        row[:lo] = far
        if row.min() >= far:
            return far
    return int(row[m - n + most])


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> bool:
    """Whether the edit similarity of two gram sequences reaches the threshold."""
    longest = max(len(a), len(b))
    most = int((1 - threshold) * longest + 1e-9)
    if longest - min(len(a), len(b)) > most:
        return False
    if len(a) == len(b) and np.array_equal(a, b):
        return True
    # every gram of the longer text that finds no partner costs at least one step
    x, p = np.unique(a, return_counts=True)
    y, q = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if longest - int(np.minimum(p[i], q[j]).sum()) > most:
        return False
    return banded_distance(a, b, most) <= most


def _sketcher(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                seqs = shingles(Words(*text_bytes(part.column("text"))))
                some = np.flatnonzero([len(s) > 0 for s in seqs])
                keys = [np.concatenate([sketch(seqs[d]), short_keys(seqs[d], threshold)]) for d in some]
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *keys])
                yield pa.RecordBatch.from_arrays(
                    [part.column("tkey").take(pa.array(some)), pa.array([len(seqs[d]) for d in some], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["tkey", "n", "keys"])

    return run


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                left, right = (shingles(Words(*text_bytes(part.column(c)))) for c in ("a_text", "b_text"))
                keep += [similar(x, y, threshold) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _outside(threshold: float):
    """For each (middle, text): the grams, apart from the middle's, that a link of the text must partly share.

    A link of texts x and y needs as many common grams as the threshold asks
    of the longer one.  If x has fewer than that in common with the middle,
    the others lie outside of it: at least ``need`` of them.  In any fixed
    order of grams, two sets that share so many share one among the first
    ``len - need + 1`` of each.  A text with no such need is free; all its
    outer grams are given.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                middles, own = (shingles(Words(*text_bytes(part.column(c)))) for c in ("middle_text", "tkey_text"))
                free, out = [], []
                for c, x, name in zip(middles, own, part.column("middle").to_pylist(), strict=True):
                    marks = labelled(x)
                    inside = np.isin(marks, labelled(c))
                    need = needed(len(x), threshold) - int(inside.sum())
                    rest = np.sort(marks[~inside])
                    free.append(need < 1)
                    rest = rest[:max(0, len(rest) - max(need, 1) + 1)]
                    out.append(mix(rest ^ np.uint64(int.from_bytes(name[:8], "big"))).view(np.int64))
                sizes = np.cumsum([0, *map(len, out)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("middle"), part.column("tkey"), pa.array(free, pa.bool_()),
                     pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(np.concatenate(out)))], names=["middle", "tkey", "free", "grams"])

    return run


def classes(docs: DataFrame, text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(tkey, root): the class of every text that has a link, by the text's digest; other texts are their own class."""
    rows = small_batches(docs).where(quoted(text).isNotNull()).select(F.unhex(F.md5(quoted(text))).alias("tkey"), quoted(text).alias("text"))
    sketched = cut_lineage(rows.mapInArrow(_sketcher(threshold), "tkey binary, n int, keys array<long>"))
    # copies of a text give equal keys: one row for each text
    sketched = cut_lineage(sketched.groupBy("tkey").agg(F.first("n").alias("n"), F.first("keys").alias("keys")))
    members = sketched.select("tkey", "n", F.explode("keys").alias("key"))
    sizes = cut_lineage(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    # only rows of shared buckets matter from here on
    shared = cut_lineage(members.join(sizes, "key"))
    # the text whose buckets are the fullest lies in the middle of its copies: it stands for its buckets
    weight = cut_lineage(shared.groupBy("tkey").agg(F.sum("size").alias("weight")))
    weighed = shared.join(weight, "tkey").groupBy("key").agg(F.max(F.struct("weight", "tkey")).alias("middle"))
    shared = cut_lineage(shared.drop("size").join(cut_lineage(weighed), "key"))
    wanted = shared.select(F.xxhash64("tkey").alias("h")).distinct()
    bloom = bloom_words(wanted, "h")

    def may_be_member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = bloom_hits(bloom, batch.column("h").to_numpy())
            yield batch.select(["tkey", "text"]).filter(pa.array(ok))

    some = rows.withColumn("h", F.xxhash64("tkey")).mapInArrow(may_be_member, "tkey binary, text string")
    ids = shared.select("tkey").distinct()
    texts = cut_lineage(some.groupBy("tkey").agg(F.first("text").alias("text")).join(ids, "tkey", "left_semi"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of digests that the alignment confirms."""
        pairs = cut_lineage(pairs.distinct())
        sides = [texts.select(F.col("tkey").alias(c), F.col("text").alias(f"{c}_text")) for c in ("a", "b")]
        return cut_lineage(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_text", "b_text")
                           .mapInArrow(_verifier(threshold), "a binary, b binary"))

    def rooted(frame: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
        named = roots.select(F.col("node").alias(column), F.col("root").alias("__root"))
        return frame.join(named, column, "left").withColumn(out, F.coalesce("__root", column)).drop("__root")

    others = shared.where("tkey <> middle.tkey")
    links = linked(others.groupBy("tkey").agg(F.max("middle").alias("middle")).select(F.col("tkey").alias("a"), F.col("middle.tkey").alias("b")))
    roots = cut_lineage(components(links))
    pairs = cut_lineage(others.select(F.col("tkey").alias("a"), F.col("middle.tkey").alias("b")).distinct())
    apart = rooted(rooted(pairs, roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select("a", "b")
    links = cut_lineage(links.union(linked(apart)))
    roots = cut_lineage(components(links))
    # what is left: pairs of one bucket, of different classes
    placed = cut_lineage(rooted(shared.select("key", "tkey", "n", "middle.tkey").toDF("key", "tkey", "n", "middle"), roots, "tkey", "root"))
    mixed = cut_lineage(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key"))
    open_rows = cut_lineage(placed.join(mixed, "key"))
    sides = [texts.select(F.col("tkey").alias(c), F.col("text").alias(f"{c}_text")) for c in ("middle", "tkey")]
    seen = cut_lineage(open_rows.select("middle", "tkey").distinct())
    apart = cut_lineage(seen.join(sides[0], "middle").join(sides[1], "tkey").select("middle", "tkey", "middle_text", "tkey_text")
                        .mapInArrow(_outside(threshold), "middle binary, tkey binary, free boolean, grams array<long>"))
    named = cut_lineage(rooted(apart.select("middle", "tkey", F.explode("grams").alias("gram")), roots, "tkey", "root"))
    both = cut_lineage(named.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("gram"))
    named = cut_lineage(named.join(both, "gram").join(apart.select("middle", "tkey", "grams"), ["middle", "tkey"]))
    one, two = (named.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("tkey", "root", "grams")]) for x in ("a", "b"))
    # a pair that shares several grams is taken at the first of them only
    once = F.array_min(F.array_intersect("grams_a", "grams_b")) == F.col("gram")
    rest = one.join(two, "gram").where((F.col("root_a") < F.col("root_b")) & once).select(F.col("tkey_a").alias("a"), F.col("tkey_b").alias("b"))
    # texts that lie almost wholly inside a middle without being linked to it, or are linked to it
    free = open_rows.join(apart.where("free").select("middle", "tkey"), ["middle", "tkey"])
    free = cut_lineage(free.join(sketched.select("tkey", "keys"), "tkey"))
    one, two = (free.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("tkey", "n", "root", "keys")]) for x in ("a", "b"))
    room = F.greatest("n_a", "n_b") - F.least("n_a", "n_b") <= F.greatest("n_a", "n_b") * (1 - threshold) + 1e-9
    # a pair that shares several buckets is taken in the first of them only
    first = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    inner = one.join(two, "key").where((F.col("root_a") < F.col("root_b")) & room & first).select(F.col("tkey_a").alias("a"), F.col("tkey_b").alias("b"))
    rest = rest.union(inner)
    return components(links.union(linked(rest))).select(F.col("node").alias("tkey"), "root")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: its id, ``class_id`` (the smallest id of its class) and ``class_size``."""
    named = docs.select(quoted(key).alias("id"), F.unhex(F.md5(quoted(text))).alias("tkey"), _wordless(text).alias("alone"))
    placed = cut_lineage(named.join(cut_lineage(classes(docs, text, threshold)), "tkey", "left")
                         .select("id", F.when(F.col("alone"), None).otherwise(F.coalesce("root", "tkey")).alias("root")))
    sizes = cut_lineage(placed.where("root is not null").groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")))
    out = placed.where("root is not null").join(sizes, "root").select("id", "class_id", "class_size")
    alone = placed.where("root is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.union(alone).withColumnRenamed("id", key)


def _wordless(text: str):
    """Null, or without any word character."""
    return F.coalesce(~quoted(text).rlike("[0-9A-Za-z]|[^\\x00-\\x7F]"), F.lit(True))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The document of the smallest id of each class, with all its columns; texts without a word all stay.

    Among rows of that id the smallest text stays, once.
    """
    found = classes(docs, text, threshold)
    tkey = F.unhex(F.md5(quoted(text)))
    named = docs.select(quoted(key).alias("id"), tkey.alias("tkey"), _wordless(text).alias("alone")).where(~F.col("alone")).drop("alone")
    # one row for each text, of its smallest id, before anything is joined
    rows = named.groupBy("tkey", "id").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "times"))
    texts = cut_lineage(rows.groupBy("tkey").agg(first.alias("m")).select("tkey", "m.id", "m.times"))
    placed = texts.join(cut_lineage(found), "tkey", "left").withColumn("root", F.coalesce("root", "tkey"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "tkey", "times")
    t, i = fresh(docs, "__tkey"), fresh(docs, "__id")
    best = cut_lineage(placed.groupBy("root").agg(F.min(rank).alias("best")).select(F.col("best.tkey").alias(t), F.col("best.id").alias(i), "best.times"))
    keyed = docs.withColumn(t, tkey)

    def chosen(of: DataFrame) -> DataFrame:
        return keyed.join(of.select(t, i), t).where(quoted(key).eqNullSafe(F.col(i))).drop(i)

    # rows that repeat both id and text stay once; the others need no grouping
    once = cut_lineage(chosen(best.where("times > 1"))).groupBy(t).agg(F.first(F.struct(*[quoted(c) for c in docs.columns])).alias("row")).select("row.*")
    return chosen(best.where("times = 1")).drop(t).unionByName(once).unionByName(docs.where(_wordless(text)))
