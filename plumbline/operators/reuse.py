"""Query entry, reuse of earlier results, and the query log."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clip, ref_names
from ..sources.snapshots import byte_size


@contextmanager
def _view(spark: SparkSession, name: str, df: DataFrame):
    """Register ``df`` under ``name`` for the block and restore what was there."""
    before = spark.table(name) if spark.catalog.tableExists(name) else None
    df.createOrReplaceTempView(name)
    try:
        yield
    finally:
        spark.catalog.dropTempView(name)
        if before is not None and not spark.catalog.tableExists(name):
            before.createOrReplaceTempView(name)


def handle_sql(df: DataFrame, sql: str, name: str = "data") -> DataFrame:
    """Run any SELECT against ``df``; the result is lazy again."""
    spark = df.sparkSession
    with _view(spark, name, df):
        return spark.sql(sql)


def handle_basics(df: DataFrame) -> dict:
    return {"rows": df.count(), "columns": df.columns, "bytes": byte_size(df)}


# Verbs that make a query text a write, and the forms that do so inside longer strings.
WRITE_VERBS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "MERGE",
    "CALL", "REPLACE", "LOAD", r"INTO\s+OUTFILE", r"INTO\s+DUMPFILE",
)
WRITE_FORMS = (
    r"CREATE\s+(OR\s+REPLACE\s+)?(TEMP(ORARY)?\s+)?(TABLE|VIEW|INDEX|DATABASE|SCHEMA|FUNCTION|PROCEDURE|TRIGGER|SEQUENCE|ROLE|USER|MATERIALIZED)\b",
    r"DROP\s+(TABLE|VIEW|INDEX|DATABASE|SCHEMA|FUNCTION|PROCEDURE|TRIGGER|SEQUENCE|COLUMN|CONSTRAINT|ROLE|USER)\b",
    r"ALTER\s+(TABLE|VIEW|INDEX|DATABASE|SCHEMA|COLUMN|SEQUENCE|ROLE|USER)\b",
    r"TRUNCATE\s+(TABLE\s+)?\w+", r"INSERT\s+INTO\b", r"UPDATE\s+[\w.`\"\[\]]+(\s+AS\s+\w+|\s+\w+)?\s+SET\b",
    r"DELETE\s+FROM\b", r"MERGE\s+INTO\b", r"REPLACE\s+INTO\b", r"GRANT\s+[\w,\s*]+\s+ON\b",
    r"REVOKE\s+[\w,\s*]+\s+(ON|FROM)\b", r"EXEC(UTE)?\s+(\w+\.)*\w+", r"CALL\s+\w+\s*\(", r"LOAD\s+DATA\b",
    r"INTO\s+OUTFILE\b", r"INTO\s+DUMPFILE\b",
)
VERB_PATTERN = r"(?i)\b(" + "|".join(WRITE_VERBS) + r")\b"
FORM_PATTERN = r"(?i)\b(" + "|".join(WRITE_FORMS) + ")"


def readonly_flag(log: DataFrame, sql: str = "sql_text") -> DataFrame:
    """Read-only flags of query texts: strict (any write verb) and structural, with the first verb."""
    c = F.col(sql)
    verb = F.nullif(F.upper(F.regexp_extract(c, VERB_PATTERN, 1)), F.lit(""))
    return log.withColumns({"read_only": ~c.rlike(VERB_PATTERN), "read_only_text": ~c.rlike(FORM_PATTERN), "first_verb": verb})


# Binary size units, and the size from which an estimate counts as unknown (1 EiB).
SIZE_UNITS = {"B": 0, "KiB": 1, "MiB": 2, "GiB": 3, "TiB": 4, "PiB": 5, "EiB": 6}
UNKNOWN_SIZE = float(1024**6)


def plan_scan_bytes(plan: Column) -> Column:
    """Largest known size of an ``EXPLAIN COST`` text, null when none is usable."""
    pattern = r"sizeInBytes=([0-9.]+(?:E[+-]?[0-9]+)?) (B|KiB|MiB|GiB|TiB|PiB|EiB)"
    numbers = F.regexp_extract_all(plan, F.lit(pattern), F.lit(1))
    units = F.regexp_extract_all(plan, F.lit(pattern), F.lit(2))
    power = F.create_map(*[F.lit(x) for k, v in SIZE_UNITS.items() for x in (k, float(1024**v))])
    sizes = F.zip_with(numbers, units, lambda n, u: F.floor(n.try_cast("double") * power[u]))
    return F.array_max(F.filter(sizes, lambda s: s < UNKNOWN_SIZE))


def scan_guard(log: DataFrame, tables: DataFrame, max_bytes: int) -> DataFrame:
    """Verdict per logged query; a missing plan or unknown size never blocks.

    Deviation: an empty filter list is held against partitioned tables only,
    because plans print it for unpartitioned scans too.
    """
    rows = log.join(tables.select("base_table", "is_partitioned"), "base_table", "left")
    unfiltered = F.coalesce(F.col("plan").rlike(r"PartitionFilters:\s*\[\s*\]") & F.col("is_partitioned"), F.lit(False))
    size = plan_scan_bytes(F.col("plan"))
    verdict = F.when(unfiltered, "no_partition_filter").when(size > max_bytes, "too_large").otherwise("ok")
    return rows.withColumns({"scan_bytes": size, "verdict": verdict})


def answer_from_snapshot(spark: SparkSession, sql: str, table: str, snapshot: DataFrame, complete: bool) -> DataFrame | None:
    """Run the unchanged SQL over a saved full scan of ``table``, or None when it cannot.

    Spark's own analysis decides: with the snapshot standing in for the table,
    a column the snapshot lacks does not resolve.  ``SELECT *`` needs a
    ``complete`` snapshot.  Any other relation named by the query is a miss.
    """
    leaf = table.split(".")[-1]
    try:
        with _view(spark, leaf, snapshot):
            narrow = spark.sql(sql)
            probe = snapshot.withColumn("_plumbline_probe", F.lit(None))
        if not complete:
            with _view(spark, leaf, probe):
                if len(spark.sql(sql).columns) != len(narrow.columns):
                    return None
        return narrow
    except AnalysisException:
        return None


def log_summary(log: DataFrame) -> DataFrame:
    """Calls, time, rows and bytes per cache state and error kind; hits are metered too."""
    kind = F.when(F.col("error_text").isNull(), "none").otherwise(F.split("error_text", " ")[0])
    return log.groupBy(F.when(F.col("cache_hit"), "hit").otherwise("miss").alias("cache"), kind.alias("error_type")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cost_ms").alias("ms"), F.max("cost_ms").alias("max_ms"),
        F.sum("n_rows").alias("rows"), F.sum("bytes").alias("bytes"))


def log_rows(log: DataFrame, sql_length: int | None = None, error_length: int | None = None) -> DataFrame:
    return log.select("query_id", F.col("cost_ms").alias("ms"), F.col("n_rows").alias("rows"), "bytes",
                      clip(F.col("sql_text"), sql_length).alias("sql"), F.when(F.col("cache_hit"), "hit").otherwise("miss").alias("cache"),
                      clip(F.col("error_text"), error_length).alias("error"))


def saved_resolve(refs: DataFrame, saved: DataFrame) -> DataFrame:
    """Resolve references by id, then slug, then title (newest wins), ignoring case for the last two.

    Candidates become one (key, rank) table, reduced to the newest per key, so
    a title shared by many results meets the references as one row.
    """
    good = saved.where(F.col("is_default") & (F.col("status") == "success"))
    keyed = good.select("saved_id", "created_at", F.inline(F.array(
        F.struct(F.lit(1).alias("rank"), F.col("saved_id").cast("string").alias("k")),
        F.struct(F.lit(2).alias("rank"), F.lower("slug").alias("k")),
        F.struct(F.lit(3).alias("rank"), F.lower("title").alias("k"))))).where("k <> ''")
    best = keyed.groupBy("rank", "k").agg(F.max_by("saved_id", F.struct("created_at", "saved_id")).alias("saved_id"))
    tries = refs.select("ref_id", "ref", F.inline(F.array(
        F.struct(F.lit(1).alias("rank"), F.col("ref").alias("k")),
        F.struct(F.lit(2).alias("rank"), F.lower("ref").alias("k")),
        F.struct(F.lit(3).alias("rank"), F.lower("ref").alias("k")))))
    hits = tries.join(best, ["rank", "k"], "left")
    return hits.groupBy("ref_id", "ref").agg(F.min_by("saved_id", F.when(F.col("saved_id").isNotNull(), F.col("rank"))).alias("saved_id"))


def resolve_published(entities: DataFrame, refs: list[str]) -> DataFrame:
    """Published entities by id, slug, title, then substring; one scan for all references."""
    def rank(ref):
        lo = F.lit(ref.lower())
        part = F.contains(F.lower("title"), lo) | F.contains(F.lower("slug"), lo) | F.contains(F.lower(F.coalesce("description", F.lit(""))), lo)
        r = F.when(F.col("entity_id").cast("string") == ref, 1).when(F.lower("slug") == lo, 2).when(F.lower("title") == lo, 3).when(part, 4)
        return F.struct(F.lit(ref).alias("ref"), r.alias("rank"))
    hits = entities.where("status = 'published'").select("entity_id", F.inline(F.array(*[rank(r) for r in refs]))).where("rank IS NOT NULL")
    return hits.groupBy("ref").agg(F.min_by("entity_id", F.struct("rank", "entity_id")).alias("entity_id"))


def code_refs(steps: DataFrame, key: str = "step_id", code: str = "code") -> DataFrame:
    """Literal ``load_step`` / ``load_entity`` references as ordered edges; variables are ignored."""
    kinds = [F.struct(F.lit(k).alias("kind"), ref_names(code, f"load_{k}").alias("refs")) for k in ("step", "entity")]
    return steps.select(key, F.inline(F.array(*kinds))).select(key, "kind", F.posexplode("refs").alias("position", "ref"))

