"""Dashboard and catalog filters, compiled to plain column predicates.

A condition is ``{"column": "name" or "chart:name", "operator": ..., "value": ...,
"value2": ...}``; a group is a list of conditions joined by AND, groups are
joined by OR.  Null rules follow the dashboard (``mode="reference"``) or SQL.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import NUMBER_TEXT, js_date, js_number, js_string
from ..functions.ranges import within
from ..session import spread_small


def _target_text(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def _target_number(v) -> float | None:
    if v is None or (isinstance(v, str) and not v.strip()):
        return 0.0
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _field(df: DataFrame, name: str) -> T.StructField | None:
    return next((f for f in df.schema.fields if f.name.lower() == name.lower()), None)


def split_key(key: str) -> tuple[str, str]:
    """``chart:column`` parts; a key without a colon names a chart only in the dashboard, here a column."""
    chart, _, column = (key or "").partition(":")
    return (chart, column) if column else ("", chart)


def condition(df: DataFrame, cond: dict, chart: str | None = None, mode: str = "reference") -> Column:
    cond_chart, name = split_key(cond["column"])
    if chart and cond_chart != chart:
        return F.lit(True)
    op, value, field = cond["operator"], cond.get("value"), _field(df, name)
    if field is None:  # a missing column reads as undefined
        return _undefined(op, value)
    c, kind = F.col(f"`{field.name}`"), field.dataType
    text, target = F.lower(js_string(c, kind, mode)), _target_text(value).lower()
    if op == "equals":
        out = text == target
    elif op == "not_equals":
        out = text != target
    elif op == "contains":
        out = F.contains(text, F.lit(target))
    elif op == "not_contains":
        out = ~F.contains(text, F.lit(target))
    elif op == "starts_with":
        out = F.startswith(text, F.lit(target))
    elif op == "ends_with":
        out = F.endswith(text, F.lit(target))
    elif op in ("greater_than", "less_than", "gte", "lte", "between"):
        out = _numeric(op, js_number(c, kind, mode), value, cond.get("value2"))
    elif op in ("before", "after"):
        bound = F.lit(str(value)).cast("timestamp_ntz") if not isinstance(value, (int, float)) else F.timestamp_millis(F.lit(int(value))).cast("timestamp_ntz")
        d = js_date(c, kind, mode)
        out = d < bound if op == "before" else d > bound
    elif op in ("is_empty", "is_not_empty"):
        empty = c.isNull() | (c == "") if isinstance(kind, T.StringType) else c.isNull()
        out = empty if op == "is_empty" else ~empty
    elif op in ("is_true", "is_false"):
        want = op == "is_true"
        if isinstance(kind, T.BooleanType):
            out = c == F.lit(want)
        elif isinstance(kind, T.StringType):
            out = c == str(want).lower()
        else:
            out = c == int(want)
    elif op in ("in", "not_in"):
        if not isinstance(value, (list, tuple)):
            return F.lit(op == "not_in")
        hit = text.isin(*[_target_text(v).lower() for v in value]) if value else F.lit(False)
        out = hit if op == "in" else ~hit
    else:
        return F.lit(True)
    return F.coalesce(out, F.lit(False))


def _numeric(op: str, n: Column, value, value2) -> Column:
    lo, hi = _target_number(value), _target_number(value2)
    if lo is None or (op == "between" and (hi is None or value2 is None)):
        return F.lit(False)
    return {"greater_than": n > lo, "less_than": n < lo, "gte": n >= lo, "lte": n <= lo}.get(op) if op != "between" else n.between(lo, hi)


def _undefined(op: str, value) -> Column:
    target = _target_text(value).lower()
    out = {
        "equals": target == "undefined", "not_equals": target != "undefined", "contains": target in "undefined",
        "not_contains": target not in "undefined", "starts_with": "undefined".startswith(target),
        "ends_with": "undefined".endswith(target), "is_empty": True,
        "in": isinstance(value, (list, tuple)) and "undefined" in [_target_text(v).lower() for v in value],
        "not_in": not isinstance(value, (list, tuple)) or "undefined" not in [_target_text(v).lower() for v in value],
    }
    known = {"greater_than", "less_than", "gte", "lte", "between", "before", "after", "is_not_empty", "is_true", "is_false"}
    return F.lit(out.get(op, op not in known))


def filter_expr(df: DataFrame, groups: list[list[dict]], chart: str | None = None, mode: str = "reference") -> Column:
    """OR over groups of AND over conditions; nothing relevant keeps every row."""
    if not groups:
        return F.lit(True)
    if chart and not any(split_key(c["column"])[0] == chart for g in groups for c in g):
        return F.lit(True)
    ands = [reduce(lambda a, b: a & b, [condition(df, c, chart, mode) for c in g], F.lit(True)) for g in groups]
    return reduce(lambda a, b: a | b, ands)


def apply_filters(df: DataFrame, groups: list[list[dict]], chart: str | None = None, mode: str = "reference") -> DataFrame:
    return df.where(filter_expr(df, groups, chart, mode))


def default_filters(df: DataFrame, view: dict) -> DataFrame:
    """Apply the conditions attached to a view before any chart operator."""
    conds = [c for f in view.get("defaultFilters", []) for c in (f.get("conditions") or [f])]
    return apply_filters(df, [conds]) if conds else df


# Operators offered per inferred column type.
OPERATORS = {
    "string": ("equals", "not_equals", "contains", "not_contains", "starts_with", "ends_with", "is_empty", "is_not_empty"),
    "number": ("equals", "not_equals", "greater_than", "less_than", "gte", "lte", "is_empty", "is_not_empty"),
    "date": ("equals", "before", "after", "is_empty", "is_not_empty"),
    "boolean": ("is_true", "is_false"),
}
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}|^\d{2}/\d{2}/\d{4}|^\d{4}/\d{2}/\d{2}"


def infer_types(df: DataFrame, order: str, columns: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """(column, type, operators) from the non-null values; from the first ``sample`` in row order only if asked for.

    The declared schema answers for typed columns; each text column costs one
    scan of that column.
    """
    rows = []
    for f in df.schema.fields:
        if columns and f.name not in columns:
            continue
        kind = f.dataType
        c = F.col(f"`{f.name}`")
        if isinstance(kind, T.StringType):
            first = df.where(c.isNotNull()).select(c.alias("v"), F.col(order).alias("_o"))
            first = first if sample is None else first.orderBy("_o").limit(sample)
            v = F.col("v")
            as_date = v.rlike(DATE_TEXT) | v.try_cast("timestamp").isNotNull()
            found = first.agg(
                F.count("v").alias("n"), F.bool_and(v.isin("true", "false")).alias("b"),
                F.bool_and(F.trim(v).rlike(NUMBER_TEXT)).alias("d"), F.bool_and(as_date).alias("t"))
            t = F.when(F.col("n") == 0, "string").when(F.col("b"), "boolean").when(F.col("d"), "number").when(F.col("t"), "date").otherwise("string")
            rows.append(found.select(F.lit(f.name).alias("column"), t.alias("type")))
        else:
            name = "boolean" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) \
                else "date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"
            found = df.where(c.isNotNull()).select(F.lit(1)).limit(1).agg(F.count(F.lit(1)).alias("n"))
            rows.append(found.select(F.lit(f.name).alias("column"), F.when(F.col("n") > 0, name).otherwise("string").alias("type")))
    ops = F.create_map(*[x for k, v in OPERATORS.items() for x in (F.lit(k), F.lit(",".join(v)))])
    return reduce(DataFrame.unionByName, rows).withColumn("operators", ops[F.col("type")])


def store_filter(df: DataFrame, filters: dict, field_map: dict[str, str] | None = None) -> DataFrame:
    """Artifact filters: text range, membership or substring; unknown columns are skipped."""
    for key, val in filters.items():
        name = (field_map or {}).get(key) or key
        field = next((f for f in df.schema.fields if f.name == name), None)
        if field is None:
            continue
        text = js_string(F.col(f"`{name}`"), field.dataType)
        if isinstance(val, dict) and (val.get("from") or val.get("to")):
            if val.get("from"):
                df = df.where(text >= val["from"])
            if val.get("to"):
                df = df.where(text <= val["to"])
        elif isinstance(val, (list, tuple)):
            df = df.where(text.isin(*val)) if val else df
        elif val:
            df = df.where(F.contains(F.lower(text), F.lit(str(val).lower())))
    return df


_SPECIAL = re.compile(r"[.^$*+?{}\[\]\\|()]")


def _java_literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text)


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def name_patterns(queries: list[str]) -> list[str]:
    """Search patterns: the escaped name at a path end, plus the raw regex when it is one."""
    out = []
    for q in queries:
        out.append(rf"(?i)(?:^|[./]){_java_literal(q)}$")
        if _SPECIAL.search(q) and _valid(q):
            out.append(f"(?i){q}")
    return out


def match_names(df: DataFrame, column: str, queries: list[str]) -> DataFrame:
    exact = F.col(column).isin(*queries)
    return df.where(reduce(lambda a, p: a | F.col(column).rlike(p), name_patterns(queries), exact))


def multi_search(df: DataFrame, queries: list[str], columns: list[str], order: str, limit: int) -> DataFrame:
    """Rows matching any query in any column, with the total before the limit."""
    usable = [q for q in queries if not _SPECIAL.search(q) or _valid(q)]
    pattern = "(?i)" + "|".join(f"(?:{q})" if _SPECIAL.search(q) else _java_literal(q) for q in usable)
    hay = reduce(lambda a, b: a | b, [F.col(c).cast("string").rlike(pattern) for c in columns]) if usable else F.lit(False)
    hits = spread_small(df).where(F.coalesce(hay, F.lit(False)))
    total = hits.agg(F.count(F.lit(1))).scalar()
    return hits.orderBy(order).limit(limit).withColumn("total", total)


def is_pattern(q: str) -> bool:
    """Whether a search text is taken as a regular expression."""
    return bool(_SPECIAL.search(q))


def invalid_regexes(queries: list[str]) -> list[str]:
    return [q for q in queries if _SPECIAL.search(q) and not _valid(q)]


def ilike_recent(df: DataFrame, q: str, columns: list[str], newest: str, key: str, limit: int) -> DataFrame:
    like = "%" + re.sub(r"([%_\\])", r"\\\1", q) + "%"
    return df.where(reduce(lambda a, b: a | b, [F.ilike(F.col(c), F.lit(like)) for c in columns])).orderBy(F.desc(newest), F.desc(key)).limit(limit)


def date_range(df: DataFrame, column: str, start: dt.datetime | None, end: dt.datetime | None, now=None) -> DataFrame:
    return df.where(within(column, start, end, now))


def soft_scope(catalog: DataFrame, key: str, scope: str, overlay: DataFrame | None = None, active: bool | None = None) -> DataFrame:
    """Visible tables: all, none, or those of an overlay; optionally by selection state."""
    if scope == "none":
        return catalog.where(F.lit(False))
    out = catalog if scope == "all" else catalog.join(overlay.select(key), key, "left_semi")
    return out if active is None else out.where(F.col("is_active") == active)


def parent_or_child(parents: DataFrame, children: DataFrame, key: str, title: str, texts: list[str], q: str) -> DataFrame:
    """Parents whose title matches or that own a child row matching in any text.

    Matching child keys are made distinct first; the OR costs one join.
    """
    like = "%" + re.sub(r"([%_\\])", r"\\\1", q) + "%"
    hit = reduce(lambda a, b: a | b, [F.ilike(F.col(c), F.lit(like)) for c in texts])
    keys = children.where(hit).select(key).distinct().withColumn("_hit", F.lit(True))
    return parents.join(keys, key, "left").where(F.ilike(F.col(title), F.lit(like)) | F.col("_hit")).drop("_hit")
