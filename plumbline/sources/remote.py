"""Remote sources: JDBC tables and paged APIs."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FETCH_SIZE = 50_000


def jdbc_options(url: str, query: str | None = None, table: str | None = None, *, column: str | None = None,
                 lower=None, upper=None, partitions: int = 1, fetch_size: int = FETCH_SIZE, **extra) -> dict[str, str]:
    """Options of a cursor-sized, optionally range-partitioned scan."""
    if (query is None) == (table is None):
        raise ValueError("give a query or a table")
    opts = {"url": url, "fetchsize": str(fetch_size), **{k: str(v) for k, v in extra.items()}}
    if column is None:
        opts["query" if query else "dbtable"] = query or table
        return opts
    if lower is None or upper is None:
        raise ValueError("a partition column needs both bounds")
    # a partitioned read takes a relation, so a query becomes a derived table
    opts["dbtable"] = f"({query}) q" if query else table
    return opts | {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}


def jdbc_scan(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, table, **kw)).load()


class _Page(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _rows(got, names: list[str]):
    """What a fetch gave, as Spark takes it: row dicts, an Arrow table or a record batch."""
    if isinstance(got, pa.Table):
        yield from got.select(names).to_batches()
    elif isinstance(got, pa.RecordBatch):
        yield got.select(names)
    else:
        for row in got:
            yield tuple(row.get(n) for n in names)


_PUSHED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


class _PagedReader(DataSourceReader):
    def __init__(self, fetch, schema: T.StructType, options: dict, filtered: bool = False):
        self.fetch, self.schema, self.options, self.filtered = fetch, schema, options, filtered
        self.pushed: list[tuple[str, str, object]] = []

    def partitions(self):
        pages, per = int(self.options["pages"]), int(self.options["pagesPerTask"])
        return [_Page(i, min(i + per, pages)) for i in range(0, pages, per)]

    def read(self, partition):
        names = self.schema.fieldNames()
        for number in range(partition.first, partition.last):
            yield from _rows(self.fetch(number, self.pushed) if self.filtered else self.fetch(number), names)


class _FilteredReader(_PagedReader):
    def pushFilters(self, filters: list[Filter]):
        """Comparisons of a column go to a fetch that takes them; Spark tests them once more, so a fetch may also ignore them."""
        self.pushed = [(".".join(f.attribute), _PUSHED[type(f)], f.value) for f in filters if type(f) in _PUSHED]
        yield from filters


class _PagedStream(DataSourceStreamReader):
    """Offsets are page numbers: what lies between two of them is the same pages whenever it is read."""

    def __init__(self, fetch, schema: T.StructType, pages: Callable[[], int], per: int, filters: list[tuple[str, str, object]] | None):
        self.fetch, self.schema, self.pages, self.per, self.filters = fetch, schema, pages, per, filters

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.pages()}

    def partitions(self, start: dict, end: dict):
        return [_Page(i, min(i + self.per, end["page"])) for i in range(start["page"], end["page"], self.per)]

    def read(self, partition):
        names = self.schema.fieldNames()
        for number in range(partition.first, partition.last):
            yield from _rows(self.fetch(number) if self.filters is None else self.fetch(number, self.filters), names)

    def commit(self, end: dict) -> None:
        pass  # the source keeps its pages

    def stop(self) -> None:
        pass


def _as_schema(schema: str | T.StructType) -> T.StructType:
    return T.DataType.fromDDL(schema) if isinstance(schema, str) else schema


def paged_scan(spark: SparkSession, fetch: Callable[..., object], schema: str | T.StructType, pages: int, pages_per_task: int = 1, filtered: bool = False) -> DataFrame:
    """Read a paged source in parallel: page ranges become tasks.

    ``fetch(page)`` gives row dicts, an Arrow table or a record batch; it runs
    on the executors and travels by value.  With ``filtered`` it is called as
    ``fetch(page, filters)`` with the comparisons (column, operator, value) that
    the query makes, as far as the session pushes filters to Python sources
    (``spark.sql.python.filterPushdown.enabled``); else with none.
    """
    label = f"paged_{uuid.uuid4().hex}"
    # a session that does not push refuses readers that take filters
    pushes = filtered and spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return label

        def reader(self, schema):
            return (_FilteredReader if pushes else _PagedReader)(fetch, schema, {"pages": pages, "pagesPerTask": pages_per_task}, filtered)

    spark.dataSource.register(Paged)
    return spark.read.format(label).schema(schema).load()


def paged_stream(spark: SparkSession, fetch: Callable[..., object], schema: str | T.StructType, pages: Callable[[], int], pages_per_task: int = 1,
                 where: list[tuple[str, str, object]] | None = None) -> DataFrame:
    """A paged source that goes on: each run from a checkpoint fetches the pages that have come since.

    ``pages()`` tells how many there are by now, on the driver; a page that is
    counted must not change any more, so a replayed batch reads what it read.
    ``where`` gives comparisons (column, operator, value) that hold for every row:
    ``fetch(page, where)`` may leave out what they rule out, and Spark does.
    """
    label = f"paged_{uuid.uuid4().hex}"

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return label

        def streamReader(self, schema):
            return _PagedStream(fetch, schema, pages, pages_per_task, where)

    spark.dataSource.register(Paged)
    out = spark.readStream.format(label).schema(_as_schema(schema)).load()
    for name, op, value in where or []:
        c = F.col(name)
        out = out.where(c.isin(*value) if op == "in" else {"=": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op])
    return out


def row_group_pages(path: str, columns: list[str]) -> tuple[Callable[[int], pa.Table], int]:
    """A fetcher whose pages are the row groups of parquet files, and their number."""
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    # listed once, on the driver: a page is a file and a row group of it
    pages = [(f.path, g.row_groups[0].id) for f in ds.dataset(path).get_fragments() for g in f.split_by_row_group()]

    def fetch(page: int) -> pa.Table:
        file, group = pages[page]
        return pq.ParquetFile(file).read_row_group(group, columns=columns)

    return fetch, len(pages)


def _files(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def folder_pages(folder: str) -> Callable[[], int]:
    """How many pages ``page=0``, ``page=1``, ... of a folder are there, from the first on."""
    def pages() -> int:
        import pyarrow.fs

        files, root = _files(folder)
        there = {f.base_name for f in files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.base_name == "_SUCCESS" for f in [files.get_file_info(f.path.rpartition("/")[0])]}
        n = 0
        while f"page={n}" in there:
            n += 1
        return n

    return pages


def folder_page(folder: str, columns: list[str]) -> Callable[[int, list], pa.Table]:
    """A fetcher of such pages; comparisons are left to the files' reader."""
    def fetch(page: int, where: list | None = None) -> pa.Table:
        import pyarrow.dataset as ds

        files, root = _files(folder)
        table = ds.dataset(f"{root}/page={page}", filesystem=files, format="parquet", exclude_invalid_files=True)
        compare = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a.isin(b)}
        keep = None
        for name, op, value in where or []:
            test = compare[op](ds.field(name), value)
            keep = test if keep is None else keep & test
        return table.to_table(columns=columns, filter=keep)

    return fetch
