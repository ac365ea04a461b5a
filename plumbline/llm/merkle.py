"""Merkle manifest of a dataset: checkpoint and recompute.

Every row is a leaf, the hash of its fields.  Rows of one group (say, of one
language) ascend by a key and form a tree in which every ``FAN`` consecutive
nodes (the last run may be shorter, even one) become the hash of their joined
digests, until one node is left: the subroot, or the lone leaf itself.  The
subroots, in the order of their groups, form one more tree, whose top is the
root of the manifest.

Only every ``stride``-th level is stored, the leaves among them.  To extract
proofs, the stored nodes of an aligned subtree (``FAN ** stride`` of them at
most) are brought together, the levels between are computed again, each stored
node's siblings are emitted, and the levels are dropped.  Subtrees are worked
on from the top down, so a subtree meets the proof of its own top once, not
once for each of its rows.

Leaves are numbered without a task per group: rows are range-partitioned and
sorted by (group, key, digest), and a partition adds what earlier partitions
hold of the same group, from a table of one row for each partition and group
boundary.  A group that holds most rows is therefore spread like any other,
and no task ever sees more of it than a partition or one subtree.

A null group is a group of its own and comes first, a null key comes first in
its group, rows of equal key are ordered by their digest, and a repeated row is
a leaf of its own each time.  Null fields are hashed as ``-``, which no value
equals.  Texts are hashed whole.  Without rows there is no root and no proof.
Other columns of the table are neither hashed nor in the way, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir
from .shared import quoted

FAN = 8
#: Levels from one stored level to the next: aligned subtrees of FAN ** STRIDE nodes at most.
STRIDE = 3


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the joined strings."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """The hash of a row: of each field ``-`` if null, else its UTF-8 length, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return reduce(lambda a, b: a + b, [(n > FAN ** i).cast("int") for i in range(21)])


def _number(rows: DataFrame, group: str | None, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with (tree, idx, n), their place in their group; and the groups with (tree, n).

    ``tree`` numbers the groups in their order, ``n`` counts a group's rows.
    """
    keys = ([group] if group else []) + order
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(placed.withColumn("__seq", F.monotonically_increasing_id()).withColumn("__pid", F.spark_partition_id()))
    by = [group] if group else []
    # a row for each partition, and one more for each group that begins within it
    parts = placed.groupBy("__pid", *by).agg(F.min("__seq").alias("__first"), F.count("*").alias("__rows"))
    whole = W.partitionBy(*by)
    parts = parts.withColumn("__before", F.sum("__rows").over(whole.orderBy("__pid")) - F.col("__rows")).withColumn("n", F.sum("__rows").over(whole))
    if not group:
        tops = parts.select(F.lit(0).cast("long").alias("tree"), "n").distinct()
        at = parts.select("__pid", "__first", "__before", "n", F.lit(0).cast("long").alias("tree"))
        joined = placed.join(at, "__pid")
    else:
        # groups begin in ascending partitions: their numbers follow from the group's first place
        groups, _ = _number(cut_lineage(parts.groupBy(group).agg(F.first("n").alias("__n"))), None, [group])
        tops = cut_lineage(groups.select(F.col("idx").alias("tree"), F.col(group).alias("__name"), F.col("__n").alias("n")))
        at = parts.join(tops.drop("n"), F.col(group).eqNullSafe(F.col("__name"))).select(
            F.col("__pid").alias("__p"), F.col(group).alias("__g"), "__first", "__before", "n", "tree")
        joined = placed.join(at, (F.col("__pid") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g"))).drop("__p", "__g")
    return joined.withColumn("idx", F.col("__seq") - F.col("__first") + F.col("__before")).drop("__seq", "__pid", "__first", "__before"), tops


def _runs(nodes: Column) -> Column:
    """The next level's digests of a row of consecutive digests that starts at a run's edge."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")),
        lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), "").cast("binary"), 256))


def _subtrees(nodes: DataFrame, level: int, stride: int, *extra: str) -> DataFrame:
    """Aligned subtrees over the nodes of one stored level: (tree, idx, n, up, d0, d1, ...).

    ``up`` is the number of levels that the subtree really has, d0 its stored
    nodes' digests in order, d1 and so on the levels computed again.
    """
    of = F.struct("idx", "digest", *extra)
    span = FAN ** stride
    groups = nodes.where(F.col("n") > FAN ** level).groupBy("tree", F.expr(f"idx div {span}").alias("top"), "n").agg(F.sort_array(F.collect_list(of)).alias("of"))
    out = groups.withColumn("up", F.least(F.lit(stride), height(F.col("n")) - level)).withColumn("d0", F.col("of.digest"))
    for i in range(1, stride + 1):
        out = out.withColumn(f"d{i}", F.when(F.col("up") >= i, _runs(F.col(f"d{i - 1}"))))
    return out


@dataclass
class Tree:
    """The stored levels of a forest, from the leaves up: (tree, idx, n, digest), the leaves with their own columns."""

    levels: list[DataFrame]
    stride: int
    #: Columns that leaves carry along.
    kept: list[str] = field(default_factory=list)

    def subroots(self) -> DataFrame:
        """(tree, digest) of the top of every tree."""
        tops = [nodes.where((height(F.col("n")) <= i * self.stride) & (F.col("idx") == 0)) for i, nodes in enumerate(self.levels)]
        # a tree's top is stored once: in the first level that its height reaches
        tops = [t if i == 0 else t.where(height(F.col("n")) > (i - 1) * self.stride) for i, t in enumerate(tops)]
        return reduce(DataFrame.union, [t.select("tree", "digest") for t in tops])


@dataclass
class Manifest:
    groups: Tree
    top: Tree
    #: Folder of the stored levels.
    path: str

    def root(self) -> str | None:
        row = self.top.subroots().first()
        return row["digest"] if row else None


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grow(leaves: DataFrame, kept: list[str], stride: int, path: str) -> Tree:
    levels = [_store(leaves.select("tree", "idx", "n", "digest", *kept), f"{path}/level-0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    level = 0
    while FAN ** level < most:
        tops = F.element_at(F.array(*[F.col(f"d{i}") for i in range(1, stride + 1)]), F.col("up"))[0]
        grown = _subtrees(levels[-1].select("tree", "idx", "n", "digest"), level, stride)
        level += stride
        levels.append(_store(grown.select("tree", F.col("top").alias("idx"), "n", tops.alias("digest")), f"{path}/level-{level}"))
    return Tree(levels, stride, kept)


def build(df: DataFrame, fields: list[str], group: str, order: str, kept: dict[str, Column] | None = None, stride: int = STRIDE, path: str | None = None) -> Manifest:
    """The manifest of ``df``, its stored levels below ``path`` (the shared folder, if none is given).

    ``kept``: further columns that the leaves carry, to be found beside the proofs.
    """
    kept = kept or {}
    path = path or shared_dir(df.sparkSession, "manifest")
    rows = cut_lineage(df.select(quoted(group).alias("__group"), quoted(order).alias("__key"), leaf_digest([quoted(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in kept.items()]))
    leaves, _ = _number(rows, "__group", ["__key", "digest"])
    groups = _grow(leaves, list(kept), stride, f"{path}/groups")
    subroots, _ = _number(cut_lineage(groups.subroots().withColumnRenamed("tree", "of")), None, ["of"])
    return Manifest(groups, _grow(subroots, ["of"], stride, f"{path}/top"), path)


def load(spark: SparkSession, path: str, kept: list[str] | None = None, stride: int = STRIDE) -> Manifest:
    """A stored manifest; the number of levels follows from the leaves' counts."""
    def tree(name: str, kept: list[str]) -> Tree:
        first = spark.read.parquet(f"{path}/{name}/level-0")
        most = first.agg(F.max("n")).first()[0] or 0
        levels = [spark.read.parquet(f"{path}/{name}/level-{i}") for i in range(stride, stride + 63, stride) if FAN ** (i - stride) < most]
        return Tree([first, *levels], stride, kept)

    return Manifest(tree("groups", kept or []), tree("top", ["of"]), path)


_STEP = "struct<before:string,after:string>"


def _own_steps(stride: int, up: Column, i: Column) -> Column:
    """The siblings of stored node ``i`` within its subtree: one step (joined before, joined after) a level."""
    steps = []
    for lv in range(stride):
        at = F.floor(i / FAN ** lv).cast("int")
        begin = at - at % FAN
        d = F.col(f"d{lv}")
        steps.append(F.when(up > lv, F.struct(
            F.array_join(F.slice(d, begin + 1, at % FAN), "").alias("before"),
            F.array_join(F.slice(d, at + 2, FAN - 1 - at % FAN), "").alias("after"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _descend(tree: Tree, over: DataFrame) -> DataFrame:
    """Proofs of all leaves of a forest; ``over``: (tree, subroot, root, steps) of the trees' tops."""
    above = None
    last = len(tree.levels) - 1
    for i in range(last, -1, -1):
        level, nodes = i * tree.stride, tree.levels[i]
        own = tree.kept if i == 0 else []
        # the tops of trees that end at this level, by what stands over them
        lone = height(F.col("n")) <= level
        at_top = nodes.where(lone if i == 0 else lone & (height(F.col("n")) > level - tree.stride))
        out = at_top.join(over, "tree").select("tree", "idx", "digest", *own, "subroot", "root", "steps")
        if above is not None:
            grown = _subtrees(nodes, level, tree.stride, *own)
            up = above.select("tree", F.col("idx").alias("top"), "subroot", "root", F.col("steps").alias("more"))
            each = F.transform("of", lambda x, j: F.struct(x.alias("x"), _own_steps(tree.stride, F.col("up"), j).alias("own")))
            met = grown.join(up, ["tree", "top"]).select("tree", F.explode(each).alias("e"), "subroot", "root", "more")
            out = out.union(met.select("tree", "e.x.idx", "e.x.digest", *[F.col("e.x")[c].alias(c) for c in own], "subroot", "root", F.concat("e.own", "more").alias("steps")))
        above = cut_lineage(out) if i else out
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """(leaf, kept columns, subroot, root, steps) of every row; a step holds the joined siblings before and after, from the leaf up."""
    top = manifest.top
    over = top.subroots().select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.expr(f"cast(array() as array<{_STEP}>)").alias("steps"))
    tops = cut_lineage(_descend(top, over))
    trees = tops.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", "steps")
    return _descend(manifest.groups, trees).select(F.col("digest").alias("leaf"), *manifest.groups.kept, "subroot", "root", "steps")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """The hash of all siblings of a proof, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)
