"""Table profiles and previews.

Counts and moments come from one aggregation; distinct counts and modes from a
(column, value) frequency table, whose shuffle is pre-aggregated; quartiles are
exact and found by narrowing to the rows around each rank, never by collecting a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .spread import running_total


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _number(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if _is_time(f.dataType):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    return c.cast("double")


def _sorted_json(c: Column, kind: T.DataType) -> Column:
    """Nested values made comparable: maps by sorted entries, then JSON."""
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(kind, (T.StructType, T.ArrayType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def _missing(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def base_stats(df: DataFrame) -> DataFrame:
    """One row per column: dtype, non-null, null, mean, std, min, max; one aggregation."""
    aggs, items = _base_parts(df)
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def _base_parts(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """The aggregates of ``base_stats``, and the rows made of them."""
    aggs, items = [], []
    for i, f in enumerate(df.schema.fields):
        bad, n = _missing(f), _number(f) if _is_number(f.dataType) or _is_time(f.dataType) else None
        aggs += [F.count_if(~bad).alias(f"c{i}_n"), F.count_if(bad).alias(f"c{i}_z")]
        if n is not None:
            ok = F.when(~bad, n)
            aggs += [F.avg(ok).alias(f"c{i}_a"), F.stddev_samp(ok).alias(f"c{i}_s"), F.min(ok).alias(f"c{i}_l"), F.max(ok).alias(f"c{i}_h")]
        stat = lambda k: F.col(f"c{i}_{k}") if n is not None else F.lit(None).cast("double")  # noqa: E731, B023
        std = F.lit(None).cast("double") if _is_time(f.dataType) else stat("s")
        items.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"c{i}_n").alias("non_null"), F.col(f"c{i}_z").alias("nulls"), stat("a").alias("mean"), std.alias("std"),
            stat("l").alias("min"), stat("h").alias("max")))
    return aggs, items


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, n) over all columns; partial counts are made before the shuffle."""
    pairs = [F.struct(F.lit(f.name).alias("column"), F.when(~_missing(f), _sorted_json(F.col(f"`{f.name}`"), f.dataType)).alias("value"))
             for f in df.schema.fields]
    long = df.select(F.inline(F.array(*pairs))).where("value IS NOT NULL")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


SKETCH_ACCURACY, SKETCH_MARGIN = 10_000, 5e-4  # the sketch errs by at most 1/accuracy of the rows


def _ranked(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if _is_number(f.dataType) or _is_time(f.dataType)]


def _sketch(df: DataFrame, probs: list[float]) -> list[Column]:
    """Aggregates that bracket the wanted ranks of every number and time column."""
    ends = [min(1.0, max(0.0, p + d)) for p in probs for d in (-SKETCH_MARGIN, SKETCH_MARGIN)]
    values = [F.when(~_missing(f), _number(f)) for f in _ranked(df)]
    return [F.percentile_approx(v, ends, SKETCH_ACCURACY).alias(f"q{i}") for i, v in enumerate(values)] + [F.count(v).alias(f"n{i}") for i, v in enumerate(values)]


def exact_quantiles(df: DataFrame, probs: list[float], sketch: DataFrame | None = None) -> DataFrame:
    """(column, prob, value) with linear interpolation for number and time columns.

    A sketch (one row; made here unless given) brackets every wanted rank.  A
    second pass counts what lies below each bracket and collapses the rows
    inside it, a thousandth of the table, to (value, n); those are ranked by a
    spread running total.
    """
    fields, spark = _ranked(df), df.sparkSession
    none = spark.createDataFrame([], "column string, prob double, value double")
    if not fields or not probs:
        return none
    cuts = (sketch if sketch is not None else df.agg(*_sketch(df, probs))).first()  # two numbers per column and rank
    spans = [(i, p, cuts[f"q{i}"][2 * j], cuts[f"q{i}"][2 * j + 1], cuts[f"n{i}"])
             for i in range(len(fields)) for j, p in enumerate(probs) if cuts[f"n{i}"]]
    if not spans:
        return none
    nums = df.select(*[F.when(~_missing(f), _number(f)).alias(f"v{i}") for i, f in enumerate(fields)])
    cells = F.array(*[F.when(F.col(f"v{i}") <= hi, F.struct(F.lit(k).alias("span"), F.when(F.col(f"v{i}") >= lo, F.col(f"v{i}")).alias("v")))
                      for k, (i, _, lo, hi, _) in enumerate(spans)])
    # v is null for all that lies below the bracket: one row per span
    near = cut_lineage(nums.select(F.inline(F.array_compact(cells))).groupBy("span", "v").agg(F.count(F.lit(1)).alias("n")))
    placed = running_total(near.where("v IS NOT NULL"), ["span"], [F.col("v")], "n", "upto")
    facts = spark.createDataFrame([(k, fields[i].name, float(p), p * (n - 1)) for k, (i, p, _, _, n) in enumerate(spans)], "span int, column string, prob double, pos double")
    facts = facts.join(near.where("v IS NULL").select("span", F.col("n").alias("below")), "span", "left").fillna(0, ["below"])
    upto, start = F.col("upto") + F.col("below"), F.col("upto") + F.col("below") - F.col("n")
    holds = lambda rank: (rank >= start) & (rank < upto)
    at = placed.join(facts, "span").where(holds(F.floor("pos")) | holds(F.ceil("pos")))
    lo, hi, part = F.min("v"), F.max("v"), F.max(F.col("pos") - F.floor("pos"))
    return at.groupBy("column", "prob").agg((lo + (hi - lo) * part).alias("value"))


QUARTILES = [0.25, 0.5, 0.75]


def table_profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """One row per column with counts, moments, quartiles, mode and its frequency.

    Two passes: moments, counts and rank brackets in one aggregation, then the
    rows around each rank; exact distinct counts and modes add the frequency
    table.  Times are reported in epoch seconds.  ``distinct="approx"`` trades
    the frequency table for a sketch and leaves the mode out.
    """
    aggs, items = _base_parts(df)
    rough = [F.approx_count_distinct(_sorted_json(F.col(f"`{f.name}`"), f.dataType)).alias(f"a{i}") for i, f in enumerate(df.schema.fields)] if distinct == "approx" else []
    wide = cut_lineage(df.agg(*aggs, *rough, *_sketch(df, QUARTILES)))
    base = wide.select(F.inline(F.array(*items)))
    if distinct == "approx":
        freq = wide.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"a{i}").alias("distinct")) for i, f in enumerate(df.schema.fields)])))
    else:
        freq = value_counts(df).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("freq"))
        texts = [f.name for f in df.schema.fields if not _is_number(f.dataType) and not _is_time(f.dataType)]
        is_text = F.col("column").isin(*texts) if texts else F.lit(False)
        freq = freq.select("column", "distinct", F.when(is_text, F.col("freq")).alias("freq"))
    q = exact_quantiles(df, QUARTILES, wide).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in zip(QUARTILES, ("q25", "q50", "q75"), strict=True)])
    return base.join(freq, "column", "left").join(q, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def modes(df: DataFrame) -> DataFrame:
    """Most frequent value per column, the smallest text on a tie."""
    counts = value_counts(df)
    best = counts.groupBy("column").agg(F.max("n").alias("n"))
    return counts.join(best, ["column", "n"]).groupBy("column").agg(F.min("value").alias("top"), F.max("n").alias("freq"))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Columns per type, from the schema: no row is read."""
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    return df.sparkSession.createDataFrame([(k, kinds.count(k)) for k in sorted(set(kinds))], "dtype string, columns bigint")


def viz_profile(df: DataFrame, may_show: bool) -> DataFrame:
    """Profile subset; extremes only when data may be shown."""
    p = table_profile(df)
    hide = lambda c: F.col(c) if may_show else F.lit(None).cast("double")
    return p.select("column", "dtype", "non_null", "distinct", "nulls", hide("min").alias("min"), hide("max").alias("max"))


def viz_head(df: DataFrame, order: str, rows: int, may_show: bool) -> DataFrame:
    """(column, sample): the first values of every column as text; none when data may not be shown."""
    top = df.orderBy(order).limit(rows)
    cells = [F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(f"`{f.name}`").cast("string").alias("v")))), lambda x: x["v"]) for f in df.schema.fields]
    none = F.lit(None).cast("array<string>")
    return top.agg(F.array(*[F.struct(F.lit(f.name).alias("column"), (c if may_show else none).alias("sample")) for f, c in zip(df.schema.fields, cells)]).alias("x")).select(F.inline("x"))


def preview(df: DataFrame, order: str, rows: int = 50, columns: int = 50) -> DataFrame:
    """First rows and columns with the total shape; infinities and NaN become null, times ISO text."""
    def cell(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        if _is_time(f.dataType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c).alias(f.name)
        return c
    total = df.agg(F.count(F.lit(1))).scalar()
    shown = [cell(f) for f in df.schema.fields[:columns]]
    return df.orderBy(order).limit(rows).select(*shown, total.alias("total_rows"), F.lit(len(df.columns)).cast("bigint").alias("total_columns"))


def render_table(df: DataFrame, order: str, max_rows: int) -> DataFrame:
    """CSV text of the first rows with the full shape and a truncation flag."""
    total = df.agg(F.count(F.lit(1))).scalar()
    top = df.orderBy(order).limit(max_rows).select(F.col(order).alias("_o"), F.to_csv(F.struct(*df.columns)).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_o", "line"))), lambda x: x["line"])  # at most max_rows lines
    head = F.lit(",".join(df.columns) + "\n")
    return top.agg(F.concat(head, F.array_join(lines, "\n")).alias("payload")).select(
        "payload", total.alias("row_count"), F.lit(len(df.columns)).alias("col_count"), (total > F.lit(max_rows)).alias("truncated"))


def render_text(df: DataFrame, text: str, max_chars: int) -> DataFrame:
    c = F.col(text)
    return df.withColumns({text: F.substring(c, 1, max_chars), "n_chars": F.length(c), "truncated": F.length(c) > max_chars})


def breakdown_check(df: DataFrame, x: str, measures: list[str]) -> DataFrame:
    """Is a dimension left un-plotted?  Text columns beside x and measures, or more rows than x values."""
    taken = {x.lower(), *[m.lower() for m in measures]}
    dims = [f.name for f in df.schema.fields if f.name.lower() not in taken and not _is_number(f.dataType)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(x).alias("distinct_x")).select(
        "rows", "distinct_x", F.lit(",".join(dims)).alias("unplotted"), (F.lit(bool(dims)) | (F.col("rows") > F.col("distinct_x"))).alias("needs_breakdown"))

