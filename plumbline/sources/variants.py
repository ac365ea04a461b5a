"""Documents that share no schema: find and aggregation over JSON texts as Variant values.

``documents`` works on columns, one type for each name.  Here a name may hold a
number in one document, a text in the next, a list or nothing in others.
Comparisons are bracketed by type: a number is compared with numbers only, a
text with texts, and a value of another kind neither matches nor fails the
query.  Missing and null differ: ``$exists`` sees null, equality with null sees
both.  A dotted name goes through lists, and a list matches if a member does.

Values sort by kind first (missing or null, numbers, texts, objects, lists,
booleans), then within it.  Texts that are no JSON are documents without a field.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which they sort.
KINDS = ("missing", "number", "string", "object", "array", "boolean")
_OF_TYPE = {"number": "number", "string": "string", "object": "object", "array": "array", "bool": "boolean", "null": "missing"}


def _step(name: str) -> str:
    mark = "'" if "'" not in name else '"'
    if mark in name:
        raise ValueError(f"a name of both kinds of quotes: {name}")
    return f"$[{mark}{name}{mark}]"


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, _step(name), "variant")


def _members(v: Column) -> Column:
    """The members of a list; none for any other value."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def kind_of(v: Column) -> Column:
    """number, string, boolean, object or array; null for a null value."""
    t = F.schema_of_variant(v)
    return (F.when(t.rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL|SMALLINT|TINYINT)"), "number").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
            .when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array"))


def values_at(doc: Column, name: str) -> Column:
    """All values at a dotted name, through lists on the way; none if it is missing.

    A list at the end comes as itself, followed by its members.
    """
    parts = name.split(".")
    at = F.array(_get(doc, parts[0]))
    for p in parts[1:]:
        direct = F.transform(at, lambda x: _get(x, p))  # noqa: B023
        through = F.flatten(F.transform(at, lambda x: F.transform(_members(x), lambda e: _get(e, p))))  # noqa: B023
        at = F.concat(F.filter(direct, lambda x: x.isNotNull()), through)
    at = F.filter(at, lambda x: x.isNotNull())
    return F.concat(at, F.flatten(F.transform(at, _members)))


def _typed(value) -> tuple[str, Column]:
    if isinstance(value, bool):
        return "boolean", F.lit(value)
    if isinstance(value, (int, float)):
        return "number", F.lit(float(value))
    if isinstance(value, str):
        return "string", F.lit(value)
    raise ValueError(f"cannot compare with {value!r}")


_CAST = {"number": "double", "string": "string", "boolean": "boolean"}
_ORDER = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$eq": lambda a, b: a == b}


def _matches(values: Column, op: str, value) -> Column:
    """Whether any of the values is of the wanted kind and compares so."""
    if value is None:
        if op != "$eq":
            raise ValueError(f"cannot compare null by {op}")
        return (F.size(values) == 0) | F.exists(values, F.is_variant_null)
    kind, wanted = _typed(value)
    return F.exists(values, lambda x: F.coalesce((kind_of(x) == kind) & _ORDER[op](F.try_variant_get(x, "$", _CAST[kind]), wanted), F.lit(False)))


def _test(values: Column, op: str, value) -> Column:
    if op in _ORDER:
        return _matches(values, op, value)
    if op == "$ne":
        return ~_matches(values, "$eq", value)
    if op in ("$in", "$nin"):
        hit = reduce(lambda a, b: a | b, [_matches(values, "$eq", v) for v in value], F.lit(False))
        return ~hit if op == "$nin" else hit
    if op == "$exists":
        return (F.size(values) > 0) if value else (F.size(values) == 0)
    if op == "$regex":
        return F.exists(values, lambda x: F.coalesce((kind_of(x) == "string") & F.try_variant_get(x, "$", "string").rlike(value), F.lit(False)))
    if op == "$type":
        wanted = _OF_TYPE[value]
        return F.exists(values, lambda x: F.coalesce(kind_of(x), F.lit("missing")) == wanted)
    if op == "$not":
        return ~reduce(lambda a, b: a & b, [_test(values, o, v) for o, v in value.items()])
    raise ValueError(f"unknown operator {op}")


def find_filter(doc: Column, spec: dict, at=values_at) -> Column:
    """A find document as a predicate over a Variant column."""
    terms = []
    for k, v in spec.items():
        if k in ("$and", "$or", "$nor"):
            parts = [find_filter(doc, s, at) for s in v]
            joined = reduce((lambda a, b: a & b) if k == "$and" else (lambda a, b: a | b), parts)
            terms.append(~joined if k == "$nor" else joined)
        else:
            tests = v.items() if isinstance(v, dict) and any(x.startswith("$") for x in v) else [("$eq", v)]
            terms += [_test(at(doc, k), op, value) for op, value in tests]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def sort_key(v: Column) -> Column:
    """A struct that orders values of any kind."""
    kind = F.when(v.isNotNull(), F.coalesce(kind_of(v), F.lit("missing"))).otherwise("missing")
    place = reduce(lambda c, ik: c.when(kind == ik[1], ik[0]), enumerate(KINDS), F).otherwise(len(KINDS))
    return F.struct(place.alias("kind"), F.when(kind == "number", F.try_variant_get(v, "$", "double")).alias("n"),
                    F.when(kind == "string", F.try_variant_get(v, "$", "string")).when(place > 2, F.to_json(v)).alias("s"))


def _first(doc: Column, name: str) -> Column:
    return F.try_element_at(values_at(doc, name), F.lit(1))


def parsed(df: DataFrame, text: str) -> DataFrame:
    """The texts as a Variant column ``doc``."""
    return df.select(F.try_parse_json(text).alias("doc"))


def doc_find(df: DataFrame, text: str, spec: dict) -> DataFrame:
    """``{"find", "projection", "sort", "limit"}`` over JSON texts: a column of JSON text for each name of the projection.

    Without a projection the whole document comes back as ``doc``.  A missing value is null, a null one the text ``null``.
    """
    rows = parsed(df, text).where(find_filter(F.col("doc"), spec.get("find") or {}))
    order = spec.get("sort") or {}
    by = [(F.desc if d < 0 else F.asc)(sort_key(_first(F.col("doc"), n))) for n, d in (order.items() if isinstance(order, dict) else order)]
    if spec.get("limit") and not by:
        raise ValueError("a limit needs a sort")
    rows = rows.orderBy(*by) if by else rows
    rows = rows.limit(spec["limit"]) if spec.get("limit") else rows
    names = spec.get("projection")
    return rows.select(*[F.to_json(_get(F.col("doc"), n) if "." not in n else _first(F.col("doc"), n)).alias(n) for n in names]) if names else rows.select(F.to_json("doc").alias("doc"))


def _numbers(v: Column) -> Column:
    return F.when(kind_of(v) == "number", F.try_variant_get(v, "$", "double"))


def group(df: DataFrame, text: str, spec: dict, match: dict | None = None, unwind: str | None = None) -> DataFrame:
    """``$match``, ``$unwind`` of one name, then ``$group``: (_id as JSON text, accumulators).

    ``spec``: ``{"_id": "$path" or None, name: {"$sum" | "$avg" | "$min" | "$max": "$path" or number}}``.  Sums and
    means take numbers and leave anything else out; least and greatest go by the order of kinds, null aside.  Groups
    are by value: 1 and 1.0 are one group, "1" is another, missing and null are the group ``null``.
    """
    rows = parsed(df, text).where(find_filter(F.col("doc"), match or {}))
    if unwind:
        list_ = _first(F.col("doc"), unwind)
        members = F.when(kind_of(list_) == "array", _members(list_)).when(list_.isNotNull() & ~F.is_variant_null(list_), F.array(list_))
        rows = rows.withColumn("member", F.explode(members))

    def value(path: str) -> Column:
        name = path[1:]
        if unwind and (name == unwind or name.startswith(unwind + ".")):
            rest = name[len(unwind) + 1:]
            return _first(F.col("member"), rest) if rest else F.col("member")
        return _first(F.col("doc"), name)

    key = F.lit(None).cast("string")
    if spec["_id"] is not None:
        v = value(spec["_id"])
        number = _numbers(v)
        # a number by its value, written without a fraction where there is none
        text_of = F.when(number.isNotNull(), F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))).otherwise(F.to_json(v))
        key = F.when(v.isNotNull() & ~F.is_variant_null(v), text_of)
    columns, aggs = {"_key": key}, []
    for i, (name, acc) in enumerate((k, a) for k, a in spec.items() if k != "_id"):
        (op, arg), = acc.items()
        if op == "$sum" and isinstance(arg, (int, float)):
            aggs.append((F.count(F.lit(1)) * F.lit(arg)).alias(name))
            continue
        v = value(arg)
        if op in ("$sum", "$avg"):
            columns[f"_v{i}"] = _numbers(v)
            aggs.append((F.coalesce(F.sum(f"_v{i}"), F.lit(0.0)) if op == "$sum" else F.avg(f"_v{i}")).alias(name))
        elif op in ("$min", "$max"):
            columns[f"_v{i}"] = F.when(v.isNotNull() & ~F.is_variant_null(v), F.struct(sort_key(v).alias("k"), F.to_json(v).alias("t")))
            aggs.append((F.min if op == "$min" else F.max)(f"_v{i}")["t"].alias(name))
        else:
            raise ValueError(f"unknown accumulator {op}")
    return rows.select(*[c.alias(n) for n, c in columns.items()]).groupBy("_key").agg(*aggs).withColumnRenamed("_key", "_id")
