"""Text, JSON and name functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import running_total
from .rowwise import first_json_object


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_text(value, limit: int | None = None) -> Column:
    """``content``, else ``text``, else the raw string; optionally cut."""
    v = _c(value)
    part = lambda k: F.nullif(F.get_json_object(v, f"$.{k}"), F.lit(""))
    is_obj = F.ltrim(v).startswith("{") & F.get_json_object(v, "$").isNotNull()
    out = F.when(is_obj, F.coalesce(part("content"), part("text"), F.lit(""))).otherwise(F.coalesce(v, F.lit("")))
    return F.substring(out, 1, limit) if limit else out


# Heading of a planning block, and the symbol ranges dropped from answers.
PLANNING_HEADER = r"\*\*[^\n*]*Planning[^\n*]*\*\*"
SYMBOLS = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}]"


def clean_answer(value) -> Column:
    """Prose after the last planning header, without symbols and markdown marks."""
    parts = F.split(json_text(value), PLANNING_HEADER)
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    tail = F.when((F.trim(F.regexp_replace(last, r"\s+", " ")) == "") & (F.size(parts) > 1), before).otherwise(last)
    for pattern, by in ((SYMBOLS, ""), (r"[*_`#>]", ""), (r"\s+", " ")):
        tail = F.regexp_replace(tail, pattern, by)
    return F.trim(tail)


def clip(value: Column, length: int | None) -> Column:
    """The first ``length`` characters, or all of them."""
    return value if length is None else F.substring(value, 1, length)


def error_summary(value, limit: int | None = None) -> Column:
    return clip(F.trim(F.regexp_replace(F.coalesce(_c(value), F.lit("")), r"\s+", " ")), limit)


def first_line(value) -> Column:
    return F.split(F.coalesce(_c(value), F.lit("")), "\n")[0]


def column_label(name) -> Column:
    """Readable label: underscores and camel case become words, each capitalised."""
    spaced = F.regexp_replace(F.regexp_replace(_c(name), "_", " "), "([a-z])([A-Z])", "$1 $2")
    return F.array_join(F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def safe_name(name, fallback: str = "table") -> Column:
    cleaned = F.lower(F.regexp_replace(F.regexp_replace(_c(name), "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", ""))
    return F.when(cleaned == "", fallback).otherwise(cleaned)


def number_duplicates(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """Suffix repeats of ``name`` with ``_2``, ``_3`` ... in the given order, however often it repeats."""
    ranked = running_total(df.withColumn("_one", F.lit(1)), [name], [F.col(order)], "_one", "_nth")
    label = F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat_ws("_", name, F.col("_nth").cast("string")))
    return ranked.withColumn(out, label).drop("_one", "_nth")


def db_of_table(name) -> Column:
    parts = F.split(_c(name), "\\.")
    return F.when(F.size(parts) > 1, parts[0])


def table_of_source(source) -> Column:
    """Table of ``db.table.col``, ``table.col`` or ``f(db.table.col)``."""
    s = _c(source)
    inner = F.when(s.rlike(r"\(.*?\)"), F.regexp_extract(s, r"\((.*?)\)", 1)).otherwise(s)
    parts = F.split(inner, "\\.")
    return F.when(F.size(parts) >= 3, F.concat_ws(".", parts[0], parts[1])).when(F.size(parts) == 2, parts[0])


def content_hash(value) -> Column:
    return F.sha2(F.coalesce(_c(value), F.lit("")), 256)


FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n?"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lead_paragraph(lines: Column) -> Column:
    """First run of plain lines joined by spaces."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(acc, line):
        text, done = acc["text"], acc["done"]
        started, gap = text != "", (line == "") | line.startswith("#")
        joined = F.when(started, F.concat(text, F.lit(" "), line)).otherwise(line)
        skip = done | gap | (~started & line.startswith("---"))
        return F.struct(F.when(skip, text).otherwise(joined).alias("text"),
                        (done | (gap & started)).alias("done"))

    return F.aggregate(lines, start, step, lambda acc: acc["text"])


def front_matter(value, most: int | None = None) -> Column:
    """struct(front, body, title, description) of a markdown text; a description over ``most`` characters ends in dots."""
    v = F.coalesce(_c(value), F.lit(""))
    has = v.rlike(FRONT_MATTER)
    body = F.when(has, F.regexp_replace(v, FRONT_MATTER, "")).otherwise(v)
    lines = F.transform(F.split(body, "\n"), _strip)
    head = F.try_element_at(F.filter(lines, lambda x: x.startswith("# ")), F.lit(1))
    lead = _lead_paragraph(lines)
    shown = lead if most is None else F.when(F.length(lead) > most, F.concat(F.substring(lead, 1, most - 3), F.lit("..."))).otherwise(lead)
    return F.struct(
        F.when(has, F.regexp_extract(v, FRONT_MATTER, 1)).alias("front"), body.alias("body"),
        _strip(F.substring(head, 3, 1 << 30)).alias("title"),
        F.nullif(shown, F.lit("")).alias("description"))


def ref_names(value, call: str = "ref") -> Column:
    """Distinct literal arguments of ``call("x")`` in first-seen order."""
    v = F.coalesce(_c(value), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(v, F.lit(rf"{call}\(\s*['\"]([^'\"]+)['\"]\s*\)"), F.lit(1)))


def ref_edges(df: DataFrame, key: str, code: str, call: str = "ref") -> DataFrame:
    return df.select(key, F.posexplode(ref_names(code, call)).alias("position", "target"))


def json_cells(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text, bytes as UTF-8, dates and timestamps as ISO text."""
    def cell(f):
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("struct", "array", "map"):
            return F.to_json(c).alias(f.name)
        if kind == "binary":
            return F.decode(c, "UTF-8").alias(f.name)
        if kind == "date":
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        if kind.startswith("timestamp"):
            micros = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            return F.regexp_replace(micros, r"\.000000$", "").alias(f.name)
        return c
    return df.select(*[cell(f) for f in df.schema.fields])


def flatten_output(df: DataFrame, parse: dict[str, str] | None = None) -> DataFrame:
    """Primitive columns only: structs expand to ``a.b``, the rest becomes JSON text.

    ``parse`` gives the schema of JSON text columns that should be expanded.
    """
    for name, schema in (parse or {}).items():
        df = df.withColumn(name, F.from_json(name, schema))

    def walk(prefix, path, fields):
        for f in fields:
            label, c = f"{prefix}{f.name}", path[f.name] if path is not None else F.col(f"`{f.name}`")
            if f.dataType.typeName() == "struct":
                yield from walk(f"{label}.", c, f.dataType.fields)
            elif f.dataType.typeName() in ("array", "map"):
                yield F.to_json(c).alias(label)
            else:
                yield c.alias(label)

    return df.select(*walk("", None, df.schema.fields))


def json_object_in(value) -> Column:
    """The JSON object inside plain, fenced or prose-wrapped text, else null.

    Whole text and fenced block are tried on the JVM; only what is left goes to
    the Python decoder, which takes the first object after the first brace.
    """
    v = F.coalesce(_c(value), F.lit(""))
    # fenced text: what lies between the first line that opens a fence and the next one that closes it
    lines = F.split(_strip(v), "\\r?\\n")
    plain = F.array_join(F.filter(lines, lambda x: ~F.trim(x).startswith("```")), "\n")
    bare = F.when(F.trim(F.element_at(lines, 1)).startswith("```"), plain).otherwise(_strip(v))
    valid = lambda c: F.when(F.ltrim(c).startswith("{"), F.to_json(F.try_parse_json(c)))
    quick = F.coalesce(valid(v), valid(bare))
    return F.coalesce(quick, F.to_json(F.try_parse_json(first_json_object(F.when(quick.isNull() & F.contains(bare, F.lit("{")), bare)))))


# Words in front of a dot that are SQL, not tables.
SQL_WORDS = ("sum", "avg", "min", "max", "count", "concat", "lower", "upper", "coalesce", "substring", "trim",
             "case", "when", "then", "else", "end")
IDENT = "[A-Za-z_][A-Za-z0-9_]*"


def lineage_refs(expression) -> Column:
    """array<struct<table,column>> of an expression.

    ``a.b.c`` names column ``c`` of table ``b``; ``b.c`` names table ``b`` unless
    ``c`` is the table of a longer reference; SQL words are no tables.
    """
    s = F.coalesce(_c(expression), F.lit(""))
    part = lambda t, i: F.split(t, "\\.")[i]
    pair = lambda t, i: F.struct(part(t, i).alias("table"), part(t, i + 1).alias("column"))
    triples = F.regexp_extract_all(s, F.lit(rf"{IDENT}\.{IDENT}\.{IDENT}"), F.lit(0))
    doubles = F.regexp_extract_all(s, F.lit(rf"{IDENT}\.{IDENT}"), F.lit(0))
    tables = F.transform(triples, lambda t: part(t, 1))
    plain = F.filter(doubles, lambda d: ~F.array_contains(tables, part(d, 1)) & ~F.lower(part(d, 0)).isin(*SQL_WORDS))
    return F.array_distinct(F.concat(F.transform(triples, lambda t: pair(t, 1)), F.transform(plain, lambda d: pair(d, 0))))


def lineage_resolve(refs: DataFrame, catalog: DataFrame, keys: list[str], only_source=None) -> DataFrame:
    """Column sets per referenced table; the single source fills gaps, unknown tables of a known source drop out.

    ``refs(*keys, source_id, table, column)``; ``catalog(source_id, table_name, table_id)``.
    """
    source = F.coalesce("source_id", F.lit(only_source)) if only_source is not None else F.col("source_id")
    grouped = refs.groupBy(*keys, source.alias("source_id"), F.lower("table").alias("table_name")).agg(
        F.array_sort(F.collect_set("column")).alias("columns"))
    known = catalog.select("source_id", F.lower("table_name").alias("table_name"), "table_id")
    out = grouped.join(known, ["source_id", "table_name"], "left")
    return out.where(F.col("source_id").isNull() | F.col("table_id").isNotNull())
