"""Data steps of charts: aggregation per category, matrices, cards and formats.

Names match ignoring case; values read as JavaScript numbers (null is 0, an
unparsable text is skipped).  Without a function the first row in ``order``
wins, so an explicit order column is always asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import js_number, js_string
from ..session import cut_lineage

AGGREGATIONS = ("sum", "avg", "count", "min", "max")


def field(df: DataFrame, name: str) -> T.StructField:
    hit = next((f for f in df.schema.fields if f.name.lower() == name.lower()), None)
    if hit is None:
        raise KeyError(f"no column {name!r} among {df.columns}")
    return hit


def number(df: DataFrame, name: str) -> Column:
    f = field(df, name)
    return js_number(F.col(f"`{f.name}`"), f.dataType)


def label(df: DataFrame, name: str) -> Column:
    """Category text; null becomes the empty label."""
    f = field(df, name)
    c = F.col(f"`{f.name}`")
    return F.when(c.isNull(), "").otherwise(js_string(c, f.dataType))


def reduce_values(v: Column, fn: str | None, order: Column) -> Column:
    """Aggregate of the non-null values of ``v``; the first one without a function."""
    known = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    if fn == "count":
        return F.when(F.count(v) > 0, F.count(v).cast("double"))
    if fn in known:
        return known[fn](v)
    return F.min_by(v, F.when(v.isNotNull(), order))


def series_function(view: dict, model: dict, key: str, index: int) -> str | None:
    """Function of a series: its style, else the view, else the data model."""
    style = next((s for s in view.get("seriesStyles") or [] if s.get("key") == key), {})
    series = model.get("series") or []
    own = series[index].get("aggregation") if index < len(series) else None
    return style.get("aggregation") or view.get("aggregation") or own


def pie(df: DataFrame, key: str, value: str, order: str, fn: str | None = None) -> DataFrame:
    f = field(df, key)
    c = F.col(f"`{f.name}`")
    rows = df.select(F.when(c.isNotNull(), js_string(c, f.dataType)).alias("name"), number(df, value).alias("value"), F.col(order).alias("_pos"))
    rows = rows.where("name IS NOT NULL AND value IS NOT NULL")
    if not fn:
        return rows.select("name", "value", F.col("_pos").alias("first_pos"))
    return rows.groupBy("name").agg(reduce_values(F.col("value"), fn, F.col("_pos")).alias("value"), F.min("_pos").alias("first_pos"))


def group_labels(df: DataFrame, group: str, order: str) -> list[str]:
    """Non-empty group labels by first appearance: the chart's legend, a column each, so metadata of the result."""
    seen = df.select(label(df, group).alias("g"), F.col(order).alias("o")).where("g <> ''").groupBy("g").agg(F.min("o").alias("o"))
    return [r["g"] for r in seen.orderBy("o", "g").collect()]


def matrix(df: DataFrame, x: str, group: str, value: str, order: str, fn_of=None, groups: list[str] | None = None) -> DataFrame:
    """Category x group matrix, one column per group, null where no row exists.

    All cells come from one aggregation per category: no shuffle per series.
    """
    groups = groups if groups is not None else group_labels(df, group, order)
    fn_of = fn_of or (lambda g, i: None)
    rows = df.select(label(df, x).alias("category"), label(df, group).alias("_g"), number(df, value).alias("_v"), F.col(order).alias("_pos"))
    cells = [reduce_values(F.when(F.col("_g") == g, F.col("_v")), fn_of(g, i), F.col("_pos")).alias(g) for i, g in enumerate(groups)]
    return rows.groupBy("category").agg(F.min("_pos").alias("first_pos"), *cells)


def multi(df: DataFrame, x: str, series: list[tuple[str, str | None]], order: str) -> DataFrame:
    """Several measures over x, each with its own function."""
    rows = df.select(label(df, x).alias("category"), F.col(order).alias("_pos"), *[number(df, v).alias(f"_v{i}") for i, (v, _) in enumerate(series)])
    cells = [reduce_values(F.col(f"_v{i}"), fn, F.col("_pos")).alias(v if [s for s, _ in series].count(v) == 1 else f"{v}_{fn}") for i, (v, fn) in enumerate(series)]
    return rows.groupBy("category").agg(F.min("_pos").alias("first_pos"), *cells)


def scatter(df: DataFrame, x: str, y: str, order: str, fn: str | None = None) -> DataFrame:
    rows = df.select(number(df, x).alias("x"), number(df, y).alias("y"), F.col(order).alias("_pos")).where("x IS NOT NULL AND y IS NOT NULL")
    if not fn:
        return rows.select("x", "y")
    return rows.groupBy("x").agg(reduce_values(F.col("y"), fn, F.col("_pos")).alias("y"))


def heatmap(df: DataFrame, x: str, y: str, value: str, order: str, fn: str | None = None) -> DataFrame:
    """Grid of labelled cells with the colour scale's maximum (never below 0)."""
    rows = df.select(label(df, x).alias("x"), label(df, y).alias("y"), number(df, value).alias("v"), F.col(order).alias("_pos"))
    rows = rows.where("x <> '' AND y <> '' AND v IS NOT NULL")
    cells = rows.groupBy("x", "y").agg(reduce_values(F.col("v"), fn, F.col("_pos")).alias("value")) if fn else rows.select("x", "y", F.col("v").alias("value"))
    top = cells.agg(F.greatest(F.lit(0.0), F.coalesce(F.max("value"), F.lit(0.0)))).scalar()
    return cells.withColumn("max_value", top)


# Names read as the time axis of a price chart.
TIME_NAMES = ("time", "date", "datetime", "timestamp", "period")


def candlestick(df: DataFrame, key: str | None = None, **columns: str) -> DataFrame:
    """Open, close, low, high by time; unset columns are found by name."""
    lower = {c.lower(): c for c in df.columns}
    key = key or next((lower[c] for c in lower if c in TIME_NAMES), None)
    if key is None:
        raise KeyError("no time column")
    picked = {k: columns.get(k) or lower.get(k) or k for k in ("open", "close", "low", "high")}
    return df.select(F.col(key).alias("time"), *[number(df, c).alias(k) for k, c in picked.items()]).orderBy("time")


def ohlc_bucket(df: DataFrame, ts: str, value: str, tie: str, unit: str = "day") -> DataFrame:
    """Raw ticks to one row per bucket; a plain aggregate, no window."""
    at = F.struct(ts, tie)
    return df.groupBy(F.date_trunc(unit, F.col(ts)).alias("time")).agg(
        F.min_by(value, at).alias("open"), F.max_by(value, at).alias("close"), F.min(value).alias("low"), F.max(value).alias("high"))


def treemap(df: DataFrame, key: str, parent: str, name: str, value: str) -> DataFrame:
    """Nodes with a resolved parent (missing ones become roots) and their child count."""
    nodes = df.select(F.col(key).alias("id"), F.col(parent).alias("_p"), F.col(name).alias("name"), number(df, value).alias("value"))
    known = nodes.select(F.col("id").alias("_p"), F.lit(True).alias("_known")).distinct()
    linked = nodes.join(known, "_p", "left").withColumn("parent_id", F.when(F.col("_known"), F.col("_p")))
    kids = linked.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return linked.select("id", "parent_id", "name", "value").join(kids, "id", "left").fillna(0, ["children"])


def treemap_totals(nodes: DataFrame) -> DataFrame:
    """Own value plus all descendants, whatever the depth.

    Pointer doubling: after round r a node's sum covers its descendants less
    than 2**r levels down, and its pointer leads 2**r levels up, so the rounds
    are the logarithm of the depth.  Sums are aggregated per ancestor before
    they join.  A cycle never runs out of pointers, which is an error.
    """
    state = cut_lineage(nodes.select("id", F.col("parent_id").alias("up"), F.col("value").alias("total")))
    rounds, most = 0, state.count()
    while not state.where("up IS NOT NULL").isEmpty():
        if 1 << rounds > most:
            raise ValueError("the hierarchy has a cycle")
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("given"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        state = cut_lineage(state.join(above, "up", "left").join(given, "id", "left").select(
            "id", F.col("next").alias("up"), F.when(F.col("given").isNull(), F.col("total")).otherwise(F.coalesce("total", F.lit(0.0)) + F.col("given")).alias("total")))
        rounds += 1
    return nodes.join(state.select("id", "total"), "id")



def radar(df: DataFrame, series: list[dict], dimensions: list[str], order: str) -> DataFrame:
    """Per named series the first matching row, else the first row; one aggregation."""
    pos = F.col(order)
    cells = []
    for s in series:
        key = label(df, s.get("key") or "name")
        for d in dimensions:
            v = F.coalesce(number(df, d), F.lit(0.0))
            hit, first = F.min_by(v, F.when(key == s["name"], pos)), F.min_by(v, pos)
            cells.append(F.struct(F.lit(s["name"]).alias("name"), F.lit(d.upper()).alias("dimension"),
                                  F.coalesce(F.when(F.count_if(key == s["name"]) > 0, hit), first, F.lit(0.0)).alias("value")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def metric_card(df: DataFrame, column: str, order: str, fn: str | None = None, comparison: str | None = None) -> DataFrame:
    """One value over all rows; ``count`` counts non-null, non-empty cells; comparison from the first row."""
    f = field(df, column)
    c = F.col(f"`{f.name}`")
    if fn == "count":
        value = F.count_if(c.isNotNull() & (c != "" if isinstance(f.dataType, T.StringType) else F.lit(True))).cast("double")
    elif fn:
        value = reduce_values(number(df, column), fn, F.col(order))
    else:
        value = F.min_by(c, order)
    extra = [F.min_by(F.col(f"`{field(df, comparison).name}`"), order).alias("comparison")] if comparison else []
    return df.agg(value.alias("value"), *extra)


def sparkline(df: DataFrame, x: str, value: str, tie: str) -> DataFrame:
    return df.select(F.col(x).alias("x"), number(df, value).alias("value"), F.col(tie).alias("tie")).orderBy("x", "tie")


# Column names taken as category and value when no encoding is given.
KEY_NAMES = ("label", "name", "category", "genre", "type")
VALUE_NAMES = ("value", "count", "total", "amount", "revenue")


def infer_series(df: DataFrame, kind: str) -> list[dict] | None:
    """Key and value column by common names, then first text, then first number, from the schema."""
    if kind not in ("pie_chart", "bar_chart", "line_chart", "area_chart") or not df.columns:
        return None
    fields = df.schema.fields
    is_text = lambda f: isinstance(f.dataType, T.StringType)
    is_num = lambda f: isinstance(f.dataType, (T.NumericType, T.BooleanType))
    first = lambda test: next((f.name for f in fields if test(f)), None)
    key = first(lambda f: f.name.lower() in KEY_NAMES) or first(is_text) or first(lambda f: not is_num(f)) or fields[0].name
    value = first(lambda f: f.name.lower() in VALUE_NAMES) or first(is_num) or (fields[1].name if len(fields) > 1 else None)
    return [{"name": "Series", "key": key, "value": value}] if key and value else None


def normalize_group_by(value) -> str | None:
    """One column name from a string or list; anything else is no grouping."""
    if isinstance(value, (list, tuple)):
        value = next((v for v in value if isinstance(v, str) and v.strip()), None)
    return value.strip() if isinstance(value, str) and value.strip() else None


def build_view(model: dict, title: str | None = None, columns: list[str] | None = None) -> dict:
    """Chart view from a declared data model: x, measures, grouping, filters, aggregation."""
    have = {c.lower(): c for c in columns or []}
    known = lambda c: have.get(c.lower()) if have and c else c
    series = model.get("series") or []
    kind = model.get("type") or "table"
    first = series[0] if series else {}
    view = {"type": kind, "title": title, "aggregation": model.get("aggregation") or first.get("aggregation"),
            "defaultFilters": model.get("filters") or []}
    if kind == "metric_card":
        view["value"] = known(first.get("value"))
    elif kind == "table":
        view["columns"] = [known(c.get("generated_column_name") or c.get("name")) for c in model.get("columns") or []] or columns or []
    elif kind == "heatmap":
        view |= {"x": known(first.get("x") or first.get("key")), "y": known(first.get("y")), "value": known(first.get("value"))}
    elif kind == "scatter_plot":
        view |= {"x": known(first.get("x") or first.get("key")), "y": known(first.get("y") or first.get("value"))}
    elif kind == "treemap":
        view |= {"id": known(first.get("id") or "id"), "parent": known(first.get("parentId") or "parentId"), "name": known(first.get("key") or first.get("name") or "name"), "value": known(first.get("value"))}
    else:
        view |= {"x": known(first.get("key")), "y": [known(s["value"]) for s in series if s.get("value")],
                 "groupBy": known(normalize_group_by(model.get("group_by")))}
    return {k: v for k, v in view.items() if v not in (None, [])}


def run_view(df: DataFrame, view: dict, order: str, model: dict | None = None) -> DataFrame:
    """Filter by the view's default conditions, then run its chart operator."""
    from .filters import default_filters

    rows, model, fn = default_filters(df, view), model or {}, view.get("aggregation")
    kind = view["type"]
    if kind == "metric_card":
        return metric_card(rows, view["value"], order, fn, view.get("comparison"))
    if kind == "table":
        from .paging import view_table

        return view_table(rows, view | {"columns": view["columns"]}, order) if view.get("sortBy") or view.get("pageSize") else rows.select(*view["columns"])
    if kind == "count":
        return rows.agg(F.count(F.lit(1)).alias("value"))
    if kind == "sparkline":
        return sparkline(rows, view.get("x") or order, view["y"][0], order).drop("tie")
    if kind == "candlestick":
        return candlestick(rows, view.get("x"))
    if kind == "radar_chart":
        return radar(rows, [{"name": s["name"], "key": view.get("x")} for s in model.get("series") or [] if s.get("name")], view["y"], order)
    if kind == "heatmap":
        return heatmap(rows, view["x"], view["y"], view["value"], order, fn)
    if kind == "scatter_plot":
        return scatter(rows, view["x"], view["y"], order, fn)
    if kind == "treemap":
        return treemap_totals(treemap(rows, view["id"], view["parent"], view["name"], view["value"]))
    if kind in ("pie_chart", "map"):
        return pie(rows, view["x"], view["y"][0], order, fn)
    if view.get("groupBy"):
        return matrix(rows, view["x"], view["groupBy"], view["y"][0], order, lambda g, i: series_function(view, model, g, i))
    return multi(rows, view["x"], [(y, series_function(view, model, y, i)) for i, y in enumerate(view["y"])], order)


def region_map(df: DataFrame, region: str, value: str, order: str, fn: str = "sum") -> DataFrame:
    return pie(df, region, value, order, fn)


def _trimmed(c: Column, digits: int) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_number(F.round(c, digits), digits), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _compact(c: Column) -> Column:
    size, sign = F.abs(c), F.when(c < 0, "-").otherwise("")
    out = _trimmed(size, 1)
    for power, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(F.round(size / (power / 1e3), 1) >= 1000, F.concat(_trimmed(size / power, 1), F.lit(unit))).otherwise(out)
    return F.concat(sign, out)


def format_value(c: Column, kind: str = "number") -> Column:
    """Card text: number, currency, percent (of 100) or compact; null as an em dash."""
    if kind == "currency":
        text = F.concat(F.when(c < 0, "-$").otherwise("$"), _trimmed(F.abs(c), 2))
    elif kind == "percent":
        text = F.concat(_trimmed(c, 1), F.lit("%"))
    elif kind == "compact":
        text = _compact(c)
    else:
        text = _trimmed(c, 2)
    return F.coalesce(text, F.lit("—"))


def format_short(c: Column, currency: bool = False, pct: bool = False, decimals: int = 0) -> Column:
    """Artifact text: currency, percent, or K/M/B with one fixed decimal."""
    fixed = lambda v: F.format_string("%.1f", F.round(v, 1))
    if currency:
        text = F.concat(F.when(c < 0, "-$").otherwise("$"), _trimmed(F.abs(c), decimals) if decimals else F.format_number(F.round(F.abs(c), 0), 0))
    elif pct:
        text = F.concat(fixed(c), F.lit("%"))
    else:
        size = F.abs(c)
        text = (F.when(size >= 1e9, F.concat(fixed(c / 1e9), F.lit("B"))).when(size >= 1e6, F.concat(fixed(c / 1e6), F.lit("M")))
                .when(size >= 1e3, F.concat(fixed(c / 1e3), F.lit("K"))).otherwise(_trimmed(c, 2)))
    return F.coalesce(text, F.lit("—"))

