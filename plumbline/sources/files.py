"""File sources: patterns to views, headerless sheets, and file trees."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def view_names(patterns: list[str]) -> list[str]:
    """Last path segment without extension, its folder for a wildcard; repeats get ``_2``, ``_3``."""
    names: list[str] = []
    for p in patterns:
        parts = [x for x in re.sub(r"^file://", "", p).split("/") if x] or ["files"]
        last = parts[-1]
        base = (parts[-2] if len(parts) > 1 else "files") if "*" in last else last.rsplit(".", 1)[0]
        base = re.sub(r"[^A-Za-z0-9_]+", "_", base).strip("_") or "t"
        name, i = base, 1
        while name in names:
            i += 1
            name = f"{base}_{i}"
        names.append(name)
    return names


def file_scan(spark: SparkSession, patterns: list[str], schemas: dict[str, str] | None = None, register: bool = True) -> dict[str, DataFrame]:
    """One DataFrame (and temp view) per pattern: Parquet by suffix, otherwise CSV.

    Give a CSV schema where it is known: inference costs one more pass.
    """
    out = {}
    for name, pattern in zip(view_names(patterns), patterns):
        if ".parquet" in pattern.lower():
            df = spark.read.parquet(pattern)
        elif schemas and name in schemas:
            df = spark.read.schema(schemas[name]).option("header", True).csv(pattern)
        else:
            df = spark.read.option("header", True).option("inferSchema", True).csv(pattern)
        if register:
            df.createOrReplaceTempView(name)
        out[name] = df
    return out


def trim_to_data(df: DataFrame, index: str) -> DataFrame:
    """Drop blank rows and columns, promote the first remaining row to header.

    Only one count per column and one header row reach the driver.
    """
    cells = [c for c in df.columns if c != index]
    blank = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in cells]
    rows = df.select(F.col(index), *blank).dropna("all", subset=cells)
    filled = rows.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cells], F.min(index).alias("_first"),
                      F.min_by(F.struct(*[F.col(f"`{c}`") for c in cells]), index).alias("_head")).first()
    kept = [c for c in cells if filled[c]]
    if not kept:
        return rows.select(index).where(F.lit(False))
    heads = [filled["_head"][c] if filled["_head"][c] is not None else f"col_{i}" for i, c in enumerate(kept)]
    return rows.where(F.col(index) > filled["_first"]).select(index, *[F.col(f"`{c}`").alias(h) for c, h in zip(kept, heads)])


# Text files worth indexing, and folders never entered.
ALLOWED_EXTENSIONS = ("md", "txt", "sql", "py", "yml", "yaml", "json", "toml", "cfg", "lkml", "sqlx", "tds", "tdsx", "csv")
SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".eggs")
YAML_KEYS = ("models:", "sources:", "seeds:", "metrics:", "exposures:", "macros:")


def glob_pattern(glob: str) -> str:
    """A line of an ignore file as a regular expression over paths: ``*`` and ``?`` stay inside a folder, ``**`` does not."""
    body = re.sub(r"\*\*/?|\*|\?|[^*?]+", lambda m: {"**": ".*", "**/": "(.*/)?", "*": "[^/]*", "?": "[^/]"}.get(m[0]) or re.escape(m[0]), glob.strip("/"))
    return ("^" if "/" in glob.rstrip("/") else "(^|/)") + body + ("/" if glob.endswith("/") else "(/|$)")


def repo_scan(spark: SparkSession, root: str, prefix: str, is_dbt: bool | None = None, ignore: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Index a file tree: path, text, sha256, size, extension, class, and why a file's text was left out.

    ``is_dbt`` is found out from a project file at the root unless given, and
    ``ignore`` holds the lines of an ignore file.  Extensions count whatever
    their case.  Files over ``max_bytes`` keep their row without text.
    """
    either = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    ext = "{" + ",".join(either(e) for e in ALLOWED_EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.sub(r"([^A-Za-z0-9/_])", r"\\\1", root.rstrip("/")) + "/", "")
    skip = "(^|/)(" + "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", d) for d in SKIP_DIRS) + r"|[^/]*\.egg-info)/"
    listed = files.withColumn("rel", rel)
    project = F.lit(is_dbt) if is_dbt is not None else listed.select("rel").where("rel = 'dbt_project.yml'").agg(F.count(F.lit(1)) > 0).scalar()
    rows = listed.where(F.col("length") > 0).where(~F.col("rel").rlike(skip))
    for line in ignore or []:
        if line.strip() and not line.startswith("#"):
            rows = rows.where(~F.col("rel").rlike(glob_pattern(line.strip())))
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    rows = rows.withColumn("skipped", F.when(large, "too_large")).withColumn("content", F.when(~large, F.col("content")))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    rows = rows.withColumn("text", text).withColumn("extension", F.lower(F.regexp_extract("rel", r"(\.[^./]+)$", 1)))
    has = lambda words: F.col("text").rlike("|".join(words))
    e = F.col("extension")
    kind = (
        F.when(e == ".lkml", "lookml_view").when(e == ".sqlx", "dataform_table").when(e.isin(".tds", ".tdsx"), "tableau_workbook")
        .when(e == ".md", "markdown_document").when(e.isin(".yml", ".yaml") & has(YAML_KEYS), "dbt_source")
        .when(e.isin(".yml", ".yaml") & has(["base_table:", "semantic_view:"]), "snowflake_semantic_view")
        .when(e.isin(".yml", ".yaml"), "yaml_file").when((e == ".sql") & project, "dbt_model").when(e == ".sql", "sql_file").otherwise("generic_file"))
    return rows.select(F.concat(F.lit(f"{prefix}/"), "rel").alias("path"), "text", F.sha2("text", 256).alias("content_hash"),
                       F.col("length").alias("size_bytes"), "extension", kind.alias("resource_type"), "skipped")

