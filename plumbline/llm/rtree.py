"""Hard negatives over an STR-packed R-tree of vectors.

Vectors are turned into integers, floor(``scale`` * x), and packed by
sort-tile-recursive: cut into slabs along the label, each slab into slabs along
a coordinate, and so on, until tiles of about ``BLOCK`` rows are left.  The cuts
come from a bounded sample and only steer the work: every row is in a tile, and
a tile's minimum bounding box, and its range of labels, is taken over all its
rows.  Tiles larger than ``BLOCK`` are dealt into blocks of that size, and each
block is packed once more, by the same rule, into leaves of ``LEAF`` rows.

A box bounds the inner product with a query by an interval, coordinate by
coordinate: q * lo or q * hi, whichever is smaller, and whichever is larger.  A
search asks for the k largest scores within a window of scores, among rows of
the query's label or of any other label.  Boxes are visited best first, by the
upper end of their interval; a box is dropped when its interval misses the
window, when its labels cannot fit, or when its upper end is strictly below the
k-th score found so far (an equal one may still hold a smaller id).  Tiles are
pruned before any row moves: a first round scans one block of each query's best
tile for a k-th score, the second visits every tile that it leaves open.  Scores
are exact integers as long as they fit 64 bits, and so is the result.

Hard negatives of an anchor and one of its positives are the best rows of
another label whose score lies between two shares of the positive's score.

Rows with a null id, label or vector, with null or non-finite components, or
with an empty vector take no part; vectors meet those of their own length only.
Repeated rows (id, label and vector alike) count once; a row is never its own
partner, nor is any row of the same id.  Ties go to the smaller id.  Other
columns are not looked at.  A tile that holds a hot label or many equal vectors
is only more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import quoted

SCALE = 256
#: Rows of a tile to aim at, and of a block at most, in expectation.
BLOCK = 4096
#: Boxes that every task holds: tiles of one vector length, whatever the table's size.
TILES = 1024
LEAF = 64
#: Queries that meet a block at once.
QUERIES = 4096
#: Numbers in the sample that the cuts come from.
SAMPLE = 1 << 20
LEAST, MOST = -(1 << 62), 1 << 62

_ROWS = "vec_id long, label long, v array<long>"
_HITS = "q long, slot int, vec_id long, score long"


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows that take part, each once."""
    x = F.transform(quoted(vector), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    label = quoted("label") if label is None else label
    rows = df.select(quoted(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(fine)
    return rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v")).distinct()


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


@dataclass
class Cut:
    """Slabs along one axis (0: the label, i + 1: coordinate i); each is a tile's number or cut again."""

    axis: int
    edges: np.ndarray
    slabs: list


def _axis(labels: np.ndarray, v: np.ndarray, axis: int) -> np.ndarray:
    return v[:, axis - 1] if axis else labels


def str_cuts(labels: np.ndarray, v: np.ndarray, tiles: int) -> tuple[Cut | int, int]:
    """How to cut rows like these into about ``tiles`` tiles, and the number of tiles it makes."""
    axes = [0, *(np.argsort(-v.astype(np.float64).var(axis=0), kind="stable") + 1).tolist()]
    made = 0

    def cut(at: np.ndarray, want: int, depth: int) -> Cut | int:
        nonlocal made
        if want <= 1 or depth >= len(axes) or not len(at):
            made += 1
            return made - 1
        values = _axis(labels[at], v[at], axes[depth])
        # the label is cut into its values if the tiles suffice, a coordinate in two: there are many of them
        slabs = min(len(np.unique(values)), int(np.ceil(np.sqrt(want)))) if depth == 0 else 2
        edges = np.unique(np.sort(values)[[len(values) * i // slabs for i in range(1, slabs)]])
        edges = edges[edges > values.min()]
        of = np.searchsorted(edges, values, side="right")
        share = -(-want // (len(edges) + 1))
        return Cut(axes[depth], edges, [cut(at[of == s], share, depth + 1) for s in range(len(edges) + 1)])

    return cut(np.arange(len(v)), tiles, 0), made


def tile_of(root: Cut | int, labels: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), np.int32)

    def go(node: Cut | int, at: np.ndarray) -> None:
        if not isinstance(node, Cut):
            out[at] = node
            return
        of = np.searchsorted(node.edges, _axis(labels[at], v[at], node.axis), side="right")
        for s in np.unique(of).tolist():
            go(node.slabs[s], at[of == s])

    go(root, np.arange(len(v)))
    return out


@dataclass
class Boxes:
    """Minimum bounding boxes: coordinates and labels from lo to hi."""

    lo: np.ndarray
    hi: np.ndarray
    label_lo: np.ndarray
    label_hi: np.ndarray

    def scores(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product of each query with each box, rounded outwards."""
        up, down = np.maximum(v, 0).astype(np.float64), np.minimum(v, 0).astype(np.float64)
        lo, hi = self.lo.T.astype(np.float64), self.hi.T.astype(np.float64)
        least, most = up @ lo + down @ hi, up @ hi + down @ lo
        # sums of integers below 2**53 are exact; beyond, leave room for rounding
        slack = 1e-12 * (np.abs(v).astype(np.float64) @ np.maximum(np.abs(lo), np.abs(hi))) * (v.shape[1] + 2)
        slack[slack < 1e-3] = 0
        return least - slack, most + slack

    def fit(self, labels: np.ndarray, same: bool) -> np.ndarray:
        """Which boxes can hold a row of each query's label, or of another."""
        at = labels[:, None]
        return (self.label_lo <= at) & (at <= self.label_hi) if same else (self.label_lo != at) | (self.label_hi != at)


@dataclass
class Index:
    """Rows by (tile, block), and the bounded table of tiles."""

    rows: DataFrame
    boxes: Boxes
    sizes: np.ndarray
    blocks: np.ndarray
    dimension: int


def _boxes_of(tile: np.ndarray, labels: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(tile, rows, least, most) of each tile; the label stands before the coordinates."""
    order = np.argsort(tile, kind="stable")
    names, starts = np.unique(tile[order], return_index=True)
    if len(names):
        whole = np.column_stack([labels, v])[order]
        yield from zip(names.tolist(), np.diff(np.append(starts, len(order))).tolist(), np.minimum.reduceat(whole, starts), np.maximum.reduceat(whole, starts), strict=True)


def build(vectors: DataFrame, dimension: int, block: int = BLOCK, tiles: int = TILES, sample: int = SAMPLE) -> Index:
    """Index of (vec_id, label, v), all of one length."""
    total = vectors.count()
    drawn = vectors.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(max(256, sample // (dimension + 2))).select("label", "v").toArrow()
    root, _ = str_cuts(drawn["label"].to_numpy(), _matrix(drawn["v"], dimension), min(tiles, -(-total // block)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = tile_of(root, b.column("label").to_numpy(zero_copy_only=False), _matrix(b.column("v"), dimension))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["vec_id", "label", "v", "tile"])

    placed = cut_lineage(vectors.mapInArrow(place, f"{_ROWS}, tile int"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                p = b.slice(at, block)
                found = list(_boxes_of(p.column("tile").to_numpy(), p.column("label").to_numpy(zero_copy_only=False), _matrix(p.column("v"), dimension)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()),
                     *[pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (2, 3)]], names=["tile", "n", "lo", "hi"])

    # one number for each tile and axis, whatever the rows
    partial = placed.mapInArrow(bound, "tile int, n long, lo array<long>, hi array<long>")
    sides = partial.select("tile", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "side"))
    merged = sides.groupBy("tile", "axis").agg(F.sum("n").alias("n"), F.min("side.lo").alias("lo"), F.max("side.hi").alias("hi")).toArrow()
    names = np.unique(merged["tile"].to_numpy())
    row, axis = np.searchsorted(names, merged["tile"].to_numpy()), merged["axis"].to_numpy()
    sizes = np.zeros(len(names), np.int64)
    lo, hi = (np.zeros((len(names), dimension + 1), np.int64) for _ in range(2))
    sizes[row], lo[row, axis], hi[row, axis] = merged["n"].to_numpy(), merged["lo"].to_numpy(), merged["hi"].to_numpy()
    blocks = np.maximum(1, -(-sizes // block))
    table = vectors.sparkSession.createDataFrame([(int(t), i, int(b)) for i, (t, b) in enumerate(zip(names, blocks, strict=True))], "name int, tile int, blocks int")
    # a row for each tile: TILES at most
    dealt = placed.withColumnRenamed("tile", "name").join(F.broadcast(table), "name")
    rows = cut_lineage(dealt.select("tile", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "label", "v"))
    return Index(rows, Boxes(lo[:, 1:], hi[:, 1:], lo[:, 0], hi[:, 0]), sizes, blocks, dimension)


def _visits(index: Index, k: int, same: bool, first: bool):
    """Which (tile, block) each query has to scan, and for which of its windows."""
    boxes, sizes, blocks, dimension = index.boxes, index.sizes, index.blocks, index.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                v, own, q = _matrix(b.column("v"), dimension), b.column("label").to_numpy(), b.column("q").to_numpy()
                slots, los, his = _windows(b)
                least, most = boxes.scores(v)
                open_ = boxes.fit(own, same)[:, :, None] & (most[:, :, None] >= los[:, None, :]) & (least[:, :, None] <= his[:, None, :])
                if first:
                    # of each window the best tile that may hold k rows, and one block of it
                    reach = np.where(open_ & (sizes > k)[None, :, None], np.minimum(most[:, :, None], his[:, None, :]), -np.inf)
                    best = np.zeros_like(open_)
                    np.put_along_axis(best, reach.argmax(axis=1)[:, None, :], True, axis=1)
                    open_ &= best & np.isfinite(reach)
                qi, ti = np.nonzero(open_.any(axis=2))
                times = np.ones(len(ti), np.int64) if first else blocks[ti]
                r = np.repeat(np.arange(len(qi)), times)
                block = q[qi] % blocks[ti] if first else np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                qi, ti = qi[r], ti[r]
                wanted = open_[qi, ti]
                edge = pa.array(np.concatenate(([0], np.cumsum(wanted.sum(axis=1)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edge, pa.array(x[qi][wanted])) for x in (slots, los, his)]
                take = pa.array(qi)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ti.astype(np.int32)), pa.array(block.astype(np.int32)), *[b.column(c).take(take) for c in ("q", "vec_id", "label", "v")], *lists],
                    names=["tile", "block", "q", "vec_id", "label", "v", "slots", "los", "his"])

    return run


_ASK = "q long, vec_id long, label long, v array<long>, slots array<int>, los array<long>, his array<long>"


def leaves(labels: np.ndarray, v: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A block's rows in leaves: (row of each place, whether the place is taken)."""
    want = -(-len(v) // leaf)
    root, made = str_cuts(labels, v, want)
    tile = tile_of(root, labels, v)
    order = np.lexsort((ids, tile))
    counts = np.bincount(tile, minlength=made)
    rows, taken, done = [], [], 0
    for c in counts.tolist():
        for at in range(0, c, leaf):
            own = order[done + at:done + min(at + leaf, c)]
            rows.append(np.resize(own, leaf))  # repeats fill the leaf and do not count
            taken.append(np.arange(leaf) < len(own))
        done += c
    return np.array(rows), np.array(taken)


def best_first(v: np.ndarray, ids: np.ndarray, labels: np.ndarray, asks: dict[str, np.ndarray], k: int, same: bool, leaf: int = LEAF, scored: list | None = None) -> tuple[np.ndarray, ...]:
    """(query, window, id, score) of the k best rows for each window of each query.

    ``asks``: v, label and vec_id of the queries, lo and hi of their windows
    (queries x windows; one whose lo is above its hi is none).  A query scores a
    leaf once for all its windows.  ``scored`` counts the rows that were looked at.
    """
    at, taken = leaves(labels, v, ids, leaf)
    reach = float(np.abs(v).max(initial=0)) * float(np.abs(asks["v"]).max(initial=0)) * v.shape[1]
    kind = np.float64 if reach < 2.0 ** 53 else np.int64  # either way exact
    lv, li, ll = v[at], ids[at], labels[at]
    boxes = Boxes(lv.min(axis=1), lv.max(axis=1), ll.min(axis=1), ll.max(axis=1))
    lv = lv.astype(kind)
    out = []
    for a in range(0, len(asks["lo"]), QUERIES):
        q, own, mine, lo, hi = (asks[c][a:a + QUERIES] for c in ("v", "label", "vec_id", "lo", "hi"))
        least, most = boxes.scores(q)
        q = q.astype(kind)
        open_ = boxes.fit(own, same)[:, :, None] & (most[:, :, None] >= lo[:, None, :]) & (least[:, :, None] <= hi[:, None, :])
        bound = np.where(open_, np.minimum(most[:, :, None], hi[:, None, :]), -np.inf)
        queue = np.argsort(-bound.max(axis=2), axis=1, kind="stable")
        score, found = np.full((*lo.shape, k), LEAST), np.full((*lo.shape, k), MOST)
        for step in range(queue.shape[1]):
            next_ = bound[np.arange(len(q)), queue[:, step]]
            if not np.isfinite(next_).any():
                break
            alive = np.flatnonzero(((next_ > -np.inf) & (next_ >= score[:, :, -1])).any(axis=1))
            if not len(alive):
                continue
            # queries whose next box is the same one are scored together
            box = queue[alive, step]
            alive = alive[np.argsort(box, kind="stable")]
            names, starts = np.unique(np.sort(box), return_index=True)
            for b, who in zip(names.tolist(), np.split(alive, starts[1:]), strict=True):
                s = (q[who] @ lv[b].T).astype(np.int64)
                fits = ll[b] == own[who][:, None]
                fine = taken[b] & (fits if same else ~fits) & (li[b] != mine[who][:, None])
                if scored is not None:
                    scored.append(int(taken[b].sum()) * len(who))
                for w in range(lo.shape[1]):
                    good = fine & (s >= np.maximum(lo[who, w], score[who, w, -1])[:, None]) & (s <= hi[who, w][:, None])
                    some = np.flatnonzero(good.any(axis=1))
                    if len(some):  # few boxes better a k-th score
                        up = who[some]
                        s_ = np.concatenate([score[up, w], np.where(good[some], s[some], LEAST)], axis=1)
                        i_ = np.concatenate([found[up, w], np.where(good[some], li[b][None, :], MOST)], axis=1)
                        top = np.lexsort((i_, -s_), axis=1)[:, :k]
                        score[up, w], found[up, w] = np.take_along_axis(s_, top, 1), np.take_along_axis(i_, top, 1)
        r, w, c = np.nonzero(found != MOST)
        out.append((r + a, w, found[r, w, c], score[r, w, c]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(4))


def _windows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slots, los and his as tables of one row a query; a missing window is never open."""
    lists = {c: batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c) for c in ("slots", "los", "his")}
    counts = np.diff(lists["slots"].offsets.to_numpy())
    some = np.arange(max(1, int(counts.max(initial=0))))[None, :] < counts[:, None]
    out = np.zeros(some.shape, np.int32), np.full(some.shape, MOST), np.full(some.shape, LEAST)
    for c, to in zip(lists.values(), out, strict=True):
        to[some] = c.flatten().to_numpy(zero_copy_only=False)
    return out


def _scan(dimension: int, k: int, same: bool):
    schema = pa.schema([("q", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, visits: pa.Table) -> pa.Table:
        if not rows.num_rows or not visits.num_rows:
            return schema.empty_table()
        slots, los, his = _windows(visits)
        asks = {"v": _matrix(visits["v"], dimension), "label": visits["label"].to_numpy(), "vec_id": visits["vec_id"].to_numpy(), "lo": los, "hi": his}
        at, window, ids, score = best_first(_matrix(rows["v"], dimension), rows["vec_id"].to_numpy(), rows["label"].to_numpy(), asks, k, same)
        return pa.Table.from_arrays([pa.array(visits["q"].to_numpy()[at]), pa.array(slots[at, window]), pa.array(ids), pa.array(score)], schema=schema)

    return run


def search(index: Index, queries: DataFrame, k: int, same: bool, n_queries: int) -> DataFrame:
    """(q, slot, rank, vec_id, score): for each window (slots, los, his) of each query its k best rows."""
    sets = max(1, -(-n_queries // QUERIES))  # queries meet a block in sets of bounded size
    keys = ["tile", "block", "part"]

    def scan(asked: DataFrame, first: bool) -> DataFrame:
        visits = asked.mapInArrow(_visits(index, k, same, first), f"tile int, block int, {_ASK}")
        visits = cut_lineage(visits.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(sets)).cast("int")))
        # a block goes only where a query waits for it
        rows = index.rows.join(visits.select("tile", "block", F.col("part").alias("part")).distinct(), ["tile", "block"])
        hits = rows.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_scan(index.dimension, k, same), _HITS)
        order = Window.partitionBy("q", "slot").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    some = scan(queries, True).groupBy("q", "slot").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    # a window rises to the k-th score found
    risen = some.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("known"))
    known = F.transform("slots", lambda s: F.coalesce(F.col("known")[s], F.lit(LEAST)))
    ready = queries.join(risen, "q", "left").withColumn("los", F.zip_with("los", known, lambda a, b: F.greatest(a, b))).drop("known")
    return scan(ready, False).select("q", "slot", "rank", "vec_id", "score")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int, negatives: int, low: int, high: int, block: int = BLOCK, tiles: int = TILES) -> DataFrame:
    """Hard negatives of the ``anchors`` among (vec_id, label, v): (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A negative's score is at least ``low`` and at most ``high`` hundredths of the positive's.
    """
    whole = cut_lineage(vectors)
    parts = []
    for dimension in sorted(r["d"] for r in whole.select(F.size("v").alias("d")).distinct().collect()):
        rows = whole.where(F.size("v") == dimension)
        index = build(rows, dimension, block, tiles)
        asked = cut_lineage(rows.where(anchors).withColumn("q", F.monotonically_increasing_id()))
        n = asked.count()
        all_ = F.array(F.lit(LEAST)), F.array(F.lit(MOST))
        ask = asked.select("q", "vec_id", "label", "v", F.array(F.lit(0)).alias("slots"), all_[0].alias("los"), all_[1].alias("his"))
        near = cut_lineage(search(index, ask, positives, True, n).select("q", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        # least and greatest integer score within the shares; a positive of negative score has no window
        lo, hi = F.expr(f"-((-positive_score * {low}) div 100)"), F.expr(f"positive_score * {high} div 100")
        lo = lo + (lo * 100 < F.col("positive_score") * low).cast("long")
        hi = hi - (hi * 100 > F.col("positive_score") * high).cast("long")
        windows = near.select("q", "slot", lo.alias("lo"), hi.alias("hi")).where("lo <= hi").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("slot", "lo", "hi"))).alias("w"))
        ask = cut_lineage(asked.join(windows, "q").select("q", "vec_id", "label", "v", F.col("w.slot").alias("slots"), F.col("w.lo").alias("los"), F.col("w.hi").alias("his")))
        found = search(index, ask, negatives, False, n).select("q", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        parts.append(found.join(near, ["q", "slot"]).join(asked.select("q", F.col("vec_id").alias("anchor_id")), "q").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
