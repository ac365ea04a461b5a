"""A result that is refused while it is written.

``budgeted_snapshot`` counts a finished write.  Here each task counts what it
writes and, every so many rows, leaves its count in a folder that all tasks
share; a task that finds the counts to be past the budget stops, and so do all
others at their next count.  What has been written by then is about the budget,
and a count's step for each task that runs.  The files become a result only when
the writer commits; a refused or failed write leaves nothing.

Bytes are those of the rows in memory (Arrow), before compression.
"""

from __future__ import annotations

import posixpath
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .snapshots import ResultTooLarge

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows between two counts of a task, at most; a tenth of the budget, if that is less.
STEP = 100_000
_PAST = "the budget is spent"


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int
    size: int


def _folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, max_rows: int | None, max_bytes: int | None):
        self.path, self.max_rows, self.max_bytes = path, max_rows, max_bytes
        self.step = max(1, min(STEP, STEP if max_rows is None else max_rows // 10))

    def _past(self, rows: int, size: int) -> bool:
        return (self.max_rows is not None and rows > self.max_rows) or (self.max_bytes is not None and size > self.max_bytes)

    def _check(self, files, folder: str, task: int) -> None:
        """Stop if all tasks together are past the budget; of attempts of a task the largest count holds."""
        counts: dict[int, tuple[int, int]] = {}
        for f in files.get_file_info(pyarrow.fs.FileSelector(folder)):
            told = re.fullmatch(r"count-(\d+)-\w+-(\d+)-(\d+)", f.base_name)
            if told:
                counts[int(told[1])] = max(counts.get(int(told[1]), (0, 0)), (int(told[2]), int(told[3])))
        rows, size = (sum(c[i] for c in counts.values()) for i in (0, 1))
        if self._past(rows, size):
            raise RuntimeError(f"{_PAST}: {rows} rows, {size} bytes")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _folder(self.path)
        folder, task, mark = posixpath.join(root, "_writing"), TaskContext.get().partitionId(), uuid.uuid4().hex
        files.create_dir(folder, recursive=True)
        self._check(files, folder, task)
        name, told, rows, size, out = f"part-{task:05d}-{mark}.parquet", None, 0, 0, None
        since = 0

        def tell() -> None:
            nonlocal told, since
            new = posixpath.join(folder, f"count-{task}-{mark}-{rows}-{size}")
            files.open_output_stream(new, compression=None).close()
            if told:
                files.delete_file(told)
            told, since = new, 0
            self._check(files, folder, task)

        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, self.step):
                    part = batch.slice(at, self.step)
                    out = out or pyarrow.parquet.ParquetWriter(posixpath.join(folder, name), part.schema, filesystem=files)
                    out.write_batch(part)
                    rows, size, since = rows + part.num_rows, size + part.nbytes, since + part.num_rows
                    if since >= self.step or self._past(rows, size):
                        tell()
            if since:
                tell()
        finally:
            if out:
                out.close()
        return _Written(name if out else "", rows, size)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _folder(self.path)
        done = [m for m in messages if m is not None]
        rows, size = sum(m.rows for m in done), sum(m.size for m in done)
        if self._past(rows, size):
            raise RuntimeError(f"{_PAST}: {rows} rows, {size} bytes")
        files.create_dir(root, recursive=True)
        for m in done:
            if m.name:
                files.move(posixpath.join(root, "_writing", m.name), posixpath.join(root, m.name))
        self._clear(files, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_folder(self.path))

    @staticmethod
    def _clear(files, root: str) -> None:
        folder = posixpath.join(root, "_writing")
        if files.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(folder)


def budgeted_write(df: DataFrame, path: str, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Write ``df`` below ``path``, a new folder that all tasks can reach, and read it back; past the budget stop and raise.

    ``ResultTooLarge.rows`` says how many rows had been counted by then.
    """
    spark, label = df.sparkSession, f"budget_{uuid.uuid4().hex}"
    files, root = _folder(path)
    if files.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
        raise FileExistsError(path)

    class Budgeted(DataSource):
        @classmethod
        def name(cls):
            return label

        def writer(self, schema, overwrite):
            return _Writer(path, max_rows, max_bytes)

    spark.dataSource.register(Budgeted)
    try:
        df.write.format(label).mode("append").save()
    except Exception as e:
        _Writer._clear(files, root)  # a task that was still writing may have come after the abort
        if files.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(root)
        told = re.search(rf"{_PAST}: (\d+) rows, (\d+) bytes", str(e))
        if told:
            raise ResultTooLarge(int(told[1]), int(told[2]), max_rows, max_bytes) from None
        raise
    return spark.read.schema(df.schema).parquet(path)
