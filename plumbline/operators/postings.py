"""Search without a full scan: a stored table of trigrams and the texts that hold them.

``build`` writes, once for each version of the texts, the rows themselves, dealt
into folders by a hash of their key, and for every run of three ASCII bytes in the
lower-cased texts its postings, dealt by gram and sorted: the keys of a few
thousand texts as one row (gram, keys, n).  A search
takes the parts of its pattern that any match must spell out, looks up how many
texts hold each of their trigrams, reads the postings of the rarest ones, and
intersects them.  Only the folders of the rows that are left are read, and the
caller's exact test runs on those rows alone, so the result is that of the scan.

What a lookup reads follows the rarest grams, not the table.  At most 2**21
grams exist; a pattern's counts and the folder numbers, ``parts`` at most, are
all that reaches the driver.  Nothing is shuffled for the index: each task deals
its own split of the texts, so what a task holds follows the split and not the
table, and a gram of very many texts spans as many files as there are splits.

A pattern that spells out no three ASCII characters in a row cannot be looked
up: the whole table is returned, and ``Narrowed.reason`` says so.  Null texts
hold no gram; rows of a null key are refused, since nothing could refer to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, drop_path, spread_small

#: Folders of rows and of postings.
PARTS = 64
#: Rarest grams of an alternative that are intersected.
RAREST = 4
#: Bytes of text handled at once.
CHUNK = 1 << 20


# --- what a pattern spells out -----------------------------------------------------------------------------------


def alternatives(pattern: str) -> list[list[str]] | None:
    """Literal runs that a match of a regular expression must hold, for each top-level alternative.

    Reads less than there is rather than more: groups, classes and anything
    optional count as unknown text.  None if the pattern is out of reach.
    """
    if re.search(r"\\[QE]|\(\?(?!i\)|:)", pattern):
        return None
    pattern = pattern.removeprefix("(?i)")
    out, runs, run, i, depth = [], [], "", 0, 0

    def close() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "[":  # a class ends at the first bracket that is neither escaped nor its first member
            i += 1
            i += pattern[i:i + 1] == "^"
            i += pattern[i:i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                if pattern[i] == "[":
                    return None  # nested classes
                i += 2 if pattern[i] == "\\" else 1
            close()
        elif c == "\\":
            i += 1
            follows = pattern[i:i + 1]
            if depth == 0 and follows and not follows.isalnum():
                run += follows
            elif follows.isdigit() or follows in tuple("xucpPkN0"):
                return None  # codes, properties and references run on for a length of their own
            else:
                close()
        elif c in "()":
            close()
            depth += 1 if c == "(" else -1
        elif c == "|":
            close()
            if depth == 0:
                out.append(runs)
                runs = []
        elif c in "?*{":
            run = run[:-1]  # what it repeats may be missing
            close()
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return None
        elif c == "+":
            close()
        elif c in ".^$" or depth:
            close()
        else:
            run += c
        i += 1
    close()
    return [*out, runs] if depth == 0 else None


def codes(literal: str) -> set[int]:
    """The grams of a literal: three ASCII bytes in a row, as one number."""
    raw = literal.lower().encode()
    return {a << 14 | b << 7 | c for a, b, c in zip(raw, raw[1:], raw[2:], strict=False) if max(a, b, c) < 128}


def needed(literals: Iterable[list[str]] | None) -> list[set[int]] | None:
    """Grams that each alternative needs; None if one of them needs none."""
    sets = [set().union(*[codes(s) for s in runs]) for runs in literals] if literals is not None else [set()]
    return sets if sets and all(sets) else None


# --- the index ---------------------------------------------------------------------------------------------------


def _grams(body: int, names: list[str]):
    def packed(part: pa.Array) -> np.ndarray:
        """row << 21 | gram of the distinct grams of each text."""
        part = pa.concat_arrays([part])  # offsets from zero
        _, offsets, data = part.buffers()
        edge = np.frombuffer(offsets, np.int64, len(part) + 1)
        raw = np.frombuffer(data, np.uint8)[edge[0]:edge[-1]] if data is not None and data.size else np.empty(0, np.uint8)
        if len(raw) < 3:
            return np.empty(0, np.int64)
        a, b, c = (raw[j:len(raw) - 2 + j] for j in range(3))
        edge = edge - edge[0]
        of = np.repeat(np.arange(len(part)), np.diff(edge))
        whole = ((a | b | c) < 128) & (of[:-2] == of[2:])
        a, b, c, of = (v[whole].astype(np.int64) for v in (a, b, c, of[:-2]))
        return np.unique(of << 21 | a << 14 | b << 7 | c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pc.fill_null(batch.column(i), "").cast(pa.large_string()) for i in range(body, batch.num_columns)]
            ends, at = np.cumsum(sum(pc.binary_length(c).to_numpy() for c in columns)), 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
                seen = [packed(c.slice(at, to - at)) for c in columns]
                seen = np.unique(np.concatenate(seen)) if len(seen) > 1 else seen[0]  # a gram in two columns of a row
                gram, row = seen & (1 << 21) - 1, seen >> 21
                order = np.argsort(gram, kind="stable")
                grams, first, n = np.unique(gram[order], return_index=True, return_counts=True)
                keys = pa.ListArray.from_arrays(pa.array([*first, len(seen)], pa.int32()), batch.column(0).take(pa.array(row[order] + at)))
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), keys, pa.array(n.astype(np.int32))], names=names)
                at = to

    return run


@dataclass
class Narrowed:
    """Rows that may match, and why so many."""

    rows: DataFrame
    indexed: bool
    reason: str


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    key: str
    parts: int
    #: Of the rows as they were given.
    schema: T.StructType

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("__part", T.IntegerType())])).parquet(f"{self.path}/rows")

    def postings(self) -> DataFrame:
        """Rows of (gram, keys, n): a gram has as many as there were chunks of texts with it."""
        keys = T.ArrayType(self.schema[self.key].dataType)
        kind = [T.StructField("gram", T.IntegerType()), T.StructField("keys", keys), T.StructField("n", T.IntegerType()), T.StructField("__part", T.IntegerType())]
        return self.spark.read.schema(T.StructType(kind)).parquet(f"{self.path}/postings")

    def table(self) -> DataFrame:
        """All rows, as they were given."""
        return self.rows().drop("__part")

    def counts(self, grams: set[int]) -> dict[int, int]:
        found = self.spark.read.schema("gram int, n long").parquet(f"{self.path}/counts").where(F.col("gram").isin(sorted(grams)))
        return {r["gram"]: r["n"] for r in found.collect()}

    def candidates(self, sets: list[set[int]], rarest: int = RAREST) -> DataFrame:
        """Keys of the texts that hold the rarest grams of any of the sets."""
        counts = self.counts(set().union(*sets))
        # a gram that no text holds rules its alternative out
        chosen = [sorted(s, key=lambda g: (counts[g], g))[:rarest] for s in sets if all(g in counts for g in s)]
        postings, keys = self.postings(), F.explode("keys").alias(self.key)
        if not chosen:
            return postings.where("false").select(keys)
        asked = sorted(set().union(*chosen))
        hits = postings.where(F.col("__part").isin(sorted({g % self.parts for g in asked})) & F.col("gram").isin(asked)).select("gram", keys)
        holds = [F.count_if(F.col("gram").isin(c)) >= len(c) for c in chosen]
        return hits.groupBy(self.key).agg(reduce(lambda a, b: a | b, holds).alias("holds")).where("holds").select(self.key)

    def narrow(self, sets: list[set[int]] | None, also: DataFrame | None = None) -> Narrowed:
        """Rows that hold all grams of a set; ``also``: keys that are wanted whatever they hold."""
        if sets is None:
            return Narrowed(self.table(), False, "the pattern spells out no three ASCII characters: every row is read")
        keys = self.candidates(sets)
        keys = cut_lineage(keys if also is None else keys.union(also.select(self.key)).distinct())
        at = sorted(r[0] for r in keys.select(part_of(F.col(self.key), self.parts).alias("p")).distinct().collect())
        rows = self.rows().where(F.col("__part").isin(at)) if at else self.rows().where("false")
        return Narrowed(rows.join(keys, self.key, "left_semi").drop("__part"), True, f"{len(at)} of {self.parts} folders are read")

    def matching(self, patterns: list[str], also: DataFrame | None = None) -> Narrowed:
        """Rows that may match any of the regular expressions."""
        found = [alternatives(p) for p in patterns]
        return self.narrow(None if None in found else needed([a for f in found for a in f]), also)

    def containing(self, literals: list[str], also: DataFrame | None = None) -> Narrowed:
        """Rows that may contain any of the literals, whatever their case."""
        return self.narrow(needed([[s] for s in literals]), also)


def part_of(key, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def version_of(items: DataFrame, key: str, columns: list[str]) -> str:
    """A number for the texts as they are, whatever the order of their rows."""
    each = F.xxhash64(key, *columns)
    row = items.agg(F.count("*").alias("n"), F.sum(each.cast("decimal(38,0)")).alias("s"), F.bit_xor(each).alias("x")).first()
    return f"{row['n']:x}-{int(row['s'] or 0) & (1 << 64) - 1:x}-{(row['x'] or 0) & (1 << 64) - 1:x}"


def build(items: DataFrame, key: str, columns: list[str], root: str, version: str | None = None, parts: int = PARTS) -> TextIndex:
    """The index of the texts in ``columns``, below ``root``; built only if this version of them is not there yet."""
    spark = items.sparkSession
    version = version or version_of(items, key, columns)
    path = f"{root}/{key}-{parts}-{version}"
    index = TextIndex(spark, path, key, parts, items.schema)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts/_SUCCESS")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return index
    drop_path(spark, path)  # what a build that did not end has left
    if not items.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is null in some rows")
    dealt = spread_small(items).withColumn("__part", part_of(F.col(key), parts))
    dealt.write.partitionBy("__part").parquet(f"{path}/rows")
    schema = T.StructType([T.StructField("gram", T.IntegerType()), T.StructField("keys", T.ArrayType(items.schema[key].dataType)), T.StructField("n", T.IntegerType())])
    texts = spread_small(items.select(key, *[F.lower(F.col(c).cast("string")).alias(f"__text{i}") for i, c in enumerate(columns)]))
    postings = texts.mapInArrow(_grams(1, schema.names), schema).withColumn("__part", F.col("gram") % parts)
    postings.sortWithinPartitions("__part", "gram").write.partitionBy("__part").parquet(f"{path}/postings")
    index.postings().groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").write.parquet(f"{path}/counts")
    return index
