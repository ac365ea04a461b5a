"""Result snapshots: write, budget, refresh, export, and the stored grid form."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import js_string
from ..session import drop_path

# Result limits that a caller may ask for; no function applies them by itself.
MAX_ROWS = 50_000_000
MAX_BYTES = 8 * 1024**3
GRID_ROWS = 1000


class ResultTooLarge(RuntimeError):
    def __init__(self, rows: int, size: int, max_rows: int | None, max_bytes: int | None):
        super().__init__(f"result of {rows} rows and about {size} bytes exceeds {max_rows} rows or {max_bytes} bytes")
        self.rows, self.size = rows, size


def byte_size(df: DataFrame) -> int:
    """Bytes of the files a DataFrame reads, from file metadata."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct()
    return files.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]


def snapshot_write(df: DataFrame, path: str) -> DataFrame:
    """Persist a result once and return a handle over it; an empty one keeps its schema."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def budgeted_snapshot(df: DataFrame, path: str, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Write to ``path``, counting on the way; over budget, remove it and raise.

    All tasks write in parallel: a row cap would pull the result through one
    task, so the check happens on the counters of the finished write.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    rows = seen.get["rows"]
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    size = byte_size(out) if rows else 0
    if (max_rows is not None and rows > max_rows) or (max_bytes is not None and size > max_bytes):
        drop_path(df.sparkSession, path)
        raise ResultTooLarge(rows, size, max_rows, max_bytes)
    return out


def csv_export(df: DataFrame, path: str, columns: list[str] | None = None) -> str:
    """RFC 4180 CSV: UTF-8 with byte-order mark, CRLF, quotes doubled, nested cells as JSON, null as nothing.

    Cells are quoted by expressions because the CSV writer would also rewrite
    line breaks inside a cell.  The header is a part of its own that sorts
    first, so the parts joined in name order are the file.
    """
    nested = (T.StructType, T.ArrayType, T.MapType)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = columns or df.columns

    def cell(c: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(c.rlike(r'[",\r\n]'), quoted).otherwise(c), F.lit(""))

    texts = [F.to_json(n) if isinstance(kinds[n], nested) else js_string(F.col(f"`{n}`"), kinds[n], "sql") for n in names]
    lines = df.select(F.concat_ws(",", *[cell(c) for c in texts]).alias("value"))
    head = df.sparkSession.range(1).select(F.concat(F.lit("\ufeff"), F.concat_ws(",", *[cell(F.lit(n)) for n in names])).alias("value"))
    head.coalesce(1).union(lines).write.mode("errorifexists").option("lineSep", "\r\n").text(path)
    return path


def to_grid(df: DataFrame, order: str, max_rows: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Rows as JSON in order, capped unless ``max_rows`` is None, and the column list."""
    kept = df.orderBy(order).limit(max_rows) if max_rows else df
    rows = kept.select(F.col(order).alias("pos"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
    return rows, [{"headerName": c, "field": c} for c in df.columns]


def from_grid(rows: DataFrame, columns: list[dict], schema: T.StructType) -> DataFrame:
    """Back to columns, ordered by the column list; columns it does not name come last."""
    parsed = rows.select(F.from_json("row", schema).alias("r")).select("r.*")
    named = [c["field"] for c in columns if c.get("field") in parsed.columns]
    return parsed.select(*named, *[c for c in parsed.columns if c not in named])


def refresh(spark: SparkSession, root: str, name: str, build, now: Column) -> bool:
    """Rebuild a dataset into a new folder, then point to it.

    A failing build keeps the old pointer but still stamps the attempt.
    """
    version = f"{root}/{name}/v-{uuid.uuid4().hex}"
    try:
        build().write.mode("errorifexists").parquet(version)
        ok = True
    except Exception:  # any failure of user code keeps the previous data
        ok = False
    row = spark.range(1).select(
        F.lit(name).alias("name"), F.lit(version).alias("path"), now.cast("timestamp").alias("refreshed_at"), F.lit(ok).alias("ok"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/_pointers")
    return ok


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The data of the newest successful refresh."""
    pointers = spark.read.parquet(f"{root}/_pointers").where((F.col("name") == name) & F.col("ok"))
    hit = pointers.agg(F.max_by("path", "refreshed_at").alias("p")).first()
    if hit["p"] is None:
        raise LookupError(f"{name}: never refreshed successfully")
    return spark.read.parquet(hit["p"])


def last_attempt(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/_pointers").where(F.col("name") == name).agg(
        F.max("refreshed_at").alias("refreshed_at"), F.max_by("ok", "refreshed_at").alias("ok"))
