"""Catalog listings and partition profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "sys", "system")
COLUMNS = "schema_name string, table_name string, col_name string, dtype string, comment string, is_partition boolean, position int"


def catalog_columns(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """Columns of every table of the session catalog; system schemas are left out."""
    rows = []
    for db in databases or [d.name for d in spark.catalog.listDatabases()]:
        if db.lower() in SYSTEM_SCHEMAS:
            continue
        for table in spark.catalog.listTables(db):
            if table.isTemporary:
                continue
            for i, c in enumerate(spark.catalog.listColumns(f"`{db}`.`{table.name}`")):
                rows.append((db, table.name, c.name, c.dataType, c.description, bool(c.isPartition), i))
    return spark.createDataFrame(rows, COLUMNS)


def frame_columns(spark: SparkSession, frames: dict[str, DataFrame], schema_name: str = "files") -> DataFrame:
    """The same listing for DataFrames that are not in a metastore."""
    rows = [(schema_name, n, f.name, f.dataType.simpleString(), f.metadata.get("comment"), False, i)
            for n, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, COLUMNS)


def partition_values(specs: DataFrame, spec: str = "partition", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, column, value) of specs such as ``year=2026/month=06``."""
    parts = F.explode(F.filter(F.split(spec, "/"), lambda p: F.contains(p, F.lit("="))))
    return specs.select(*keys, parts.alias("_p")).select(
        *keys, F.split("_p", "=", 2)[0].alias("column"), F.split("_p", "=", 2)[1].alias("value"))


def partition_profile(specs: DataFrame, spec: str = "partition", keys: tuple[str, ...] = (), limit: int | None = None, sample: int = 5) -> DataFrame:
    """Per partition column: distinct count, first values, range.

    With more specs than ``limit`` the profile is marked truncated: the count
    reads ``>=limit`` and no range is given.
    """
    total = specs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    values = partition_values(specs, spec, keys).distinct()
    by = [*keys, "column"]
    stats = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy("value"))
    first = values.withColumn("_r", rank).where(F.col("_r") <= sample).groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_list("value")), ",").alias("sample"))
    out = stats.join(first, by)
    cut = F.lit(False)
    if limit is not None:
        if keys:
            out, cut = out.join(total, list(keys)), F.col("_n") > limit
        else:
            cut = total.select("_n").scalar() > F.lit(limit)
    return out.select(
        *by, F.when(cut, F.lit(f">={limit}")).otherwise(F.col("n").cast("string")).alias("count"), "sample",
        F.when(~cut, F.col("lo")).alias("min"), F.when(~cut, F.col("hi")).alias("max"))
