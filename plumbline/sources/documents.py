"""Document collections: find, and nested schema inference."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread_small

def _path(name: str) -> Column:
    parts = name.split(".")
    return reduce(lambda c, p: c[p], parts[1:], F.col(f"`{parts[0]}`"))


def _type(df: DataFrame, name: str) -> T.DataType:
    return df.select(_path(name).alias("x")).schema["x"].dataType


_ORDER = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}


def _equal(c: Column, kind: T.DataType, v) -> Column:
    """Equality; a list field also equals each of its members, and a list value only the whole list."""
    if v is None:
        return c.isNull()
    if isinstance(kind, T.ArrayType):
        return c.eqNullSafe(F.array(*[F.lit(x) for x in v]).cast(kind)) if isinstance(v, list) else F.array_contains(c, F.lit(v))
    return c == F.lit(v)


def _test(c: Column, kind: T.DataType, op: str, v) -> Column:
    """One operator on a value; false, never null, where the value is missing."""
    held = isinstance(kind, T.ArrayType)
    if op in ("$eq", "$ne"):
        hit = _equal(c, kind, v)
    elif op in ("$in", "$nin"):
        hit = reduce(lambda a, b: a | b, [F.coalesce(_equal(c, kind, x), F.lit(False)) for x in v], F.lit(False))
    elif op == "$exists":
        hit = c.isNotNull() if v else c.isNull()
    elif op == "$regex":
        hit = F.exists(c, lambda x: x.rlike(v)) if held else c.rlike(v)
    elif op == "$not":
        return ~reduce(lambda a, b: a & b, [_test(c, kind, o, x) for o, x in v.items()])
    elif op == "$all":
        hit = reduce(lambda a, b: a & b, [_equal(c, kind, x) for x in v], F.lit(bool(v)))
    elif op == "$size":
        hit = F.size(c) == v
    elif op == "$elemMatch":
        inner = kind.elementType
        if all(k.startswith("$") for k in v):
            hit = F.exists(c, lambda x: reduce(lambda a, b: a & b, [_test(x, inner, o, y) for o, y in v.items()]))
        else:
            hit = F.exists(c, lambda x: reduce(lambda a, b: a & b, [
                _test(x[k], inner[k].dataType, o, z) for k, y in v.items() for o, z in (y.items() if _is_test(y) else [("$eq", y)])]))
    elif op in _ORDER:
        hit = F.exists(c, lambda x: _ORDER[op](x, F.lit(v))) if held else _ORDER[op](c, F.lit(v))
    else:
        raise ValueError(f"unknown operator {op}")
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if op in ("$ne", "$nin") else hit


def _is_test(v) -> bool:
    return isinstance(v, dict) and any(k.startswith("$") for k in v)


def find_filter(df: DataFrame, spec: dict) -> Column:
    """A find document as a predicate over ``df``: tests of fields, joined by and, or, nor."""
    terms = []
    for k, v in spec.items():
        if k == "$expr":
            terms.append(_truth(v))
        elif k in ("$and", "$or", "$nor"):
            parts = [find_filter(df, s) for s in v]
            joined = reduce((lambda a, b: a & b) if k == "$and" else (lambda a, b: a | b), parts)
            terms.append(~joined if k == "$nor" else joined)
        else:
            kind = _type(df, k)
            terms += [_test(_path(k), kind, op, arg) for op, arg in (v.items() if _is_test(v) else [("$eq", v)])]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def _sorted(df: DataFrame, order, tie: str | None) -> DataFrame:
    """``order`` as pairs or as the object of the JSON form; missing values sort lowest."""
    pairs = list(order.items()) if isinstance(order, dict) else list(order or [])
    by = [F.desc_nulls_last(_path(n)) if d < 0 else F.asc_nulls_first(_path(n)) for n, d in pairs]
    by += [F.asc_nulls_first(tie)] if tie in df.columns else []
    return df.orderBy(*by) if by else df


def _as_cells(df: DataFrame) -> DataFrame:
    """Nested values as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def doc_find(df: DataFrame, spec: dict, tie: str = "_id") -> DataFrame:
    """``{"find", "projection", "sort", "limit"}`` over a collection; nested cells as JSON text.

    All matches come back unless a limit above zero is asked for.
    """
    out = df.where(find_filter(df, spec.get("find") or {}))
    if spec.get("sort") or spec.get("limit"):
        out = _sorted(out, spec.get("sort"), tie)
    if spec.get("limit"):
        out = out.limit(spec["limit"])
    wanted = spec.get("projection")
    names = [n for n in df.columns if not wanted or wanted.get(n) or (n == tie and wanted.get(tie, 1))]
    if wanted and not any(wanted.values()):
        names = [n for n in df.columns if n not in wanted]
    return _as_cells(out.select(*names))


_JOINS = {"$add": lambda a, b: a + b, "$subtract": lambda a, b: a - b, "$multiply": lambda a, b: a * b, "$divide": lambda a, b: a / b,
          "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b,
          "$eq": lambda a, b: a.eqNullSafe(b), "$ne": lambda a, b: ~a.eqNullSafe(b)}
_ALONE = {"$toLower": F.lower, "$toUpper": F.upper, "$size": F.size, "$year": F.year, "$month": F.month, "$abs": F.abs, "$toString": lambda c: c.cast("string"), "$toLong": lambda c: c.cast("long")}


def _value(v) -> Column:
    """An expression of a pipeline: ``"$path"``, a literal, or one operator on expressions."""
    if isinstance(v, str) and v.startswith("$"):
        return _path(v[1:])
    if isinstance(v, dict) and len(v) == 1 and next(iter(v)).startswith("$"):
        (op, arg), = v.items()
        if op == "$literal":
            return F.lit(arg)
        if op == "$cond":
            test, yes, no = (arg["if"], arg["then"], arg["else"]) if isinstance(arg, dict) else arg
            return F.when(_truth(test), _value(yes)).otherwise(_value(no))
        if op in ("$and", "$or"):
            return reduce((lambda a, b: a & b) if op == "$and" else (lambda a, b: a | b), [_truth(x) for x in arg])
        if op == "$not":
            return ~_truth(arg[0] if isinstance(arg, list) else arg)
        if op == "$in":
            return F.coalesce(F.array_contains(_value(arg[1]), _value(arg[0])), F.lit(False))
        parts = [_value(x) for x in (arg if isinstance(arg, list) else [arg])]
        if op in _JOINS:
            return reduce(_JOINS[op], parts)
        if op in _ALONE:
            return _ALONE[op](parts[0])
        if op == "$concat":
            return F.concat(*parts)
        if op == "$ifNull":
            return F.coalesce(*parts)
        raise ValueError(f"unknown expression {op}")
    if isinstance(v, dict):
        return F.struct(*[_value(x).alias(k) for k, x in v.items()])
    if isinstance(v, list):
        return F.array(*[_value(x) for x in v])
    return F.lit(v)


def _truth(v) -> Column:
    """An expression as a test: a missing value is false."""
    return F.coalesce(_value(v), F.lit(False))


#: A row's place in the order that the last ``$sort`` made; members of an unwound list come after one another.
_PLACE = "__place"


def _gathered(spec: dict, place: Column | None) -> Column:
    """One accumulator of a group; ``place`` orders the rows for those that depend on it."""
    (op, arg), = spec.items()
    if op == "$count" or (op == "$sum" and isinstance(arg, (int, float))):
        return F.count(F.lit(1)) * F.lit(arg if op == "$sum" else 1)
    c = _value(arg)
    if place is not None and op in ("$first", "$last", "$push"):
        if op == "$push":
            pairs = F.collect_list(F.when(c.isNotNull(), F.struct(place.alias("at"), c.alias("v"))))
            return F.transform(F.sort_array(pairs), lambda p: p["v"])
        return (F.min_by if op == "$first" else F.max_by)(c, place)
    made = {"$sum": lambda: F.coalesce(F.sum(c), F.lit(0)), "$avg": lambda: F.avg(c), "$min": lambda: F.min(c), "$max": lambda: F.max(c),
            "$addToSet": lambda: F.array_sort(F.collect_set(c)), "$push": lambda: F.collect_list(c), "$first": lambda: F.first(c), "$last": lambda: F.last(c)}
    if op not in made:
        raise ValueError(f"unknown accumulator {op}")
    return made[op]()


def _tree(paths: dict) -> dict:
    """Dotted names as nested ones: ``{"a.b": 1}`` is ``{"a": {"b": 1}}``; what a name maps to is wrapped to tell it from a level."""
    out: dict = {}
    for name, v in paths.items():
        at, parts = out, name.split(".")
        for p in parts[:-1]:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name} lies below another name of the projection")
        at[parts[-1]] = (v,)
    return out


def _shown(c: Column | None, kind: T.DataType | None, tree: dict) -> Column:
    """What a projection leaves of a nested value; each member of a list is projected, expressions build what is not there."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _shown(x, kind.elementType, tree))
    fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    parts, made = [], False
    for name, sub in tree.items():
        if isinstance(sub, dict):
            below = fields.get(name)
            if below is not None or _builds(sub):
                parts.append(_shown(c[name] if below is not None else None, below, sub).alias(name))
                made |= _builds(sub)
        elif sub[0] not in (1, True):
            parts.append(_value(sub[0]).alias(name))
            made = True
        elif name in fields:
            parts.append(c[name].alias(name))
    built = F.struct(*parts)
    return built if made or c is None else F.when(c.isNotNull(), built)


def _builds(tree: dict) -> bool:
    return any(_builds(v) if isinstance(v, dict) else v[0] not in (1, True) for v in tree.values())


def _hidden(c: Column, kind: T.DataType, tree: dict) -> Column:
    """A nested value without the names of ``tree``."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _hidden(x, kind.elementType, tree))
    if not isinstance(kind, T.StructType):
        return c
    parts = []
    for f in kind.fields:
        sub = tree.get(f.name)
        if sub is None:
            parts.append(c[f.name].alias(f.name))
        elif isinstance(sub, dict):
            parts.append(_hidden(c[f.name], f.dataType, sub).alias(f.name))
    return F.when(c.isNotNull(), F.struct(*parts)) if parts else F.lit(None).cast(T.StructType([]))


def _project(out: DataFrame, arg: dict) -> DataFrame:
    shown = {k: v for k, v in arg.items() if k != "_id"}
    fields = {f.name: f.dataType for f in out.schema.fields}
    hidden = [_PLACE] if _PLACE in fields else []
    if (shown and all(v in (0, False) for v in shown.values())) or (not shown and arg.get("_id") in (0, False)):
        tree = _tree({k: v for k, v in arg.items() if not v})
        whole = [n for n, v in tree.items() if not isinstance(v, dict)]
        return out.select(*[(_hidden(F.col(f"`{n}`"), k, tree[n]).alias(n) if n in tree else F.col(f"`{n}`")) for n, k in fields.items() if n not in whole])
    columns = []
    own = arg.get("_id", 1)
    if own not in (0, False) and ("_id" in fields or "_id" in arg):
        columns.append((_path("_id") if own in (1, True) else _value(own)).alias("_id"))
    for name, sub in _tree(shown).items():
        if isinstance(sub, dict):
            if name in fields or _builds(sub):
                columns.append(_shown(F.col(f"`{name}`") if name in fields else None, fields.get(name), sub).alias(name))
        elif sub[0] not in (1, True):
            columns.append(_value(sub[0]).alias(name))
        elif name in fields:
            columns.append(F.col(f"`{name}`"))
    return out.select(*columns, *hidden)


def _set_path(out: DataFrame, name: str, value: Column) -> DataFrame:
    """``out`` with the value at a dotted name; objects on the way are kept, or made where there is none."""
    head, _, rest = name.partition(".")
    if not rest:
        return out.withColumn(name, value)
    if head in out.columns and isinstance(out.schema[head].dataType, T.StructType):
        return out.withColumn(head, F.coalesce(F.col(f"`{head}`").withField(rest, value), _nest(rest, value, out.schema[head].dataType)))
    return out.withColumn(head, _nest(rest, value, None))


def _nest(name: str, value: Column, like: T.DataType | None) -> Column:
    head, _, rest = name.partition(".")
    made = {head: _nest(rest, value, None) if rest else value}
    fields = like.fields if isinstance(like, T.StructType) else []
    return F.struct(*[made.pop(f.name).alias(f.name) if f.name in made else F.lit(None).cast(f.dataType).alias(f.name) for f in fields], *[c.alias(n) for n, c in made.items()])


def _unwind(out: DataFrame, arg: dict | str) -> DataFrame:
    """A row for each member, put where the list was; a value that is no list is its own only member."""
    spec = arg if isinstance(arg, dict) else {"path": arg}
    name, keep, index = spec["path"][1:], spec.get("preserveNullAndEmptyArrays"), spec.get("includeArrayIndex")
    c = _path(name)
    if not isinstance(_type(out, name), T.ArrayType):
        c = F.when(c.isNotNull(), F.array(c))
    rows = out.select("*", (F.posexplode_outer if keep else F.posexplode)(c).alias("__at", "__member"))
    if _PLACE in out.columns:
        rows = rows.withColumn(_PLACE, F.struct(F.col(_PLACE), "__at"))
    head, _, rest = name.partition(".")
    member = F.col("__member")
    # an object that is missing stays missing
    rows = rows.withColumn(head, F.col(f"`{head}`").withField(rest, member) if rest else member)
    if index:
        rows = _set_path(rows, index, F.col("__at").cast("long"))
    return rows.drop("__at", "__member")


def _lookup(out: DataFrame, arg: dict, collections: dict[str, DataFrame], tie: str) -> DataFrame:
    """``$lookup`` by equal fields: the other collection's documents as a list, ordered by their id.

    They are gathered before the join, so a document that many refer to is
    moved as one row.  A missing field equals a missing one; a list looks up each of its members.
    """
    other = collections[arg["from"]]
    kind = _type(out, arg["localField"])
    docs = F.sort_array(F.collect_list(F.struct(*([tie] if tie in other.columns else []), *[c for c in other.columns if c != tie])))
    found = other.groupBy(_path(arg["foreignField"]).alias("__key")).agg(docs.alias("__docs"))
    if isinstance(kind, T.ArrayType):
        if tie not in out.columns:
            raise ValueError(f"a lookup by a list needs the column {tie}")
        keys = out.select(F.col(tie).alias("__tie"), F.explode(F.array_distinct(_path(arg["localField"]))).alias("__key"))
        lists = keys.join(found, "__key").groupBy("__tie").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("__docs")))).alias("__docs"))
        rows = out.join(lists, F.col(tie) == F.col("__tie"), "left").drop("__tie")
    else:
        rows = out.join(found, _path(arg["localField"]).eqNullSafe(F.col("__key")), "left").drop("__key")
    empty = F.array().cast(rows.schema["__docs"].dataType)
    return rows.withColumn(arg["as"], F.coalesce("__docs", empty)).drop("__docs")


def doc_aggregate(df: DataFrame, pipeline: list[dict], tie: str = "_id", collections: dict[str, DataFrame] | None = None) -> DataFrame:
    """An aggregation pipeline, stage by stage as DataFrame calls; nested cells as JSON text.

    After a ``$sort``, ``$first``, ``$last`` and ``$push`` follow its order,
    whatever is shuffled in between; without one they follow ``tie``.
    ``collections`` are those that ``$lookup`` may name.  ``$facet`` gives one
    document of lists, so its parts should be as small as a document.
    """
    return _as_cells(_stages(df, pipeline, tie, collections or {}).drop(_PLACE))


def _stages(df: DataFrame, pipeline: list[dict], tie: str, collections: dict[str, DataFrame]) -> DataFrame:
    out = df
    for stage in pipeline:
        (op, arg), = stage.items()
        placed = _PLACE in out.columns
        if op == "$match":
            out = out.where(find_filter(out, arg))
        elif op in ("$group", "$sortByCount"):
            spec = arg if op == "$group" else {"_id": arg, "count": {"$sum": 1}}
            place = F.col(_PLACE) if placed else F.col(f"`{tie}`") if tie in out.columns else None
            sums = [_gathered(v, place).alias(k) for k, v in spec.items() if k != "_id"]
            out = out.groupBy(_value(spec["_id"]).alias("_id")).agg(*sums or [F.count(F.lit(1)).alias("_n")]).select("_id", *[k for k in spec if k != "_id"])
            if op == "$sortByCount":
                out = _placed(out, {"count": -1}, tie)
        elif op == "$project":
            out = _project(out, arg)
        elif op == "$unset":
            out = _project(out, dict.fromkeys(arg if isinstance(arg, list) else [arg], 0))
        elif op in ("$addFields", "$set"):
            values = {f"__set{i}": _value(v) for i, v in enumerate(arg.values())}  # all of them see the row as it was
            out = out.withColumns(values)
            for made, name in zip(values, arg, strict=True):
                out = _set_path(out, name, F.col(made))
            out = out.drop(*values)
        elif op == "$replaceRoot":
            out = out.select(F.inline(F.array(_value(arg["newRoot"]))), *([_PLACE] if placed else []))
        elif op == "$unwind":
            out = _unwind(out, arg)
        elif op == "$lookup":
            out = _lookup(out, arg, collections, tie)
        elif op == "$facet":
            cells = {}
            for name, sub in arg.items():
                rows = _stages(out, sub, tie, collections)
                one = F.struct(*[c for c in rows.columns if c != _PLACE])
                listed = F.collect_list(F.struct(F.col(_PLACE).alias("at"), one.alias("v")) if _PLACE in rows.columns else one)
                cells[name] = rows.agg((F.transform(F.sort_array(listed), lambda p: p["v"]) if _PLACE in rows.columns else F.sort_array(listed)).alias(name)).scalar()
            out = df.sparkSession.range(1).select(*[c.alias(n) for n, c in cells.items()])
        elif op == "$sort":
            out = _placed(out, arg, tie)
        elif op == "$limit":
            out = (out.orderBy(_PLACE) if placed else out).limit(arg)
        elif op == "$skip":
            out = (out.orderBy(_PLACE) if placed else out).offset(arg)
        elif op == "$count":
            out = out.agg(F.count(F.lit(1)).alias(arg))
        else:
            raise ValueError(f"unknown stage {op}")
    return out


def _placed(out: DataFrame, order: dict, tie: str) -> DataFrame:
    """Sorted rows with their place: running ids ascend through range-sorted partitions."""
    return _sorted(out.drop(_PLACE), order, tie).withColumn(_PLACE, F.monotonically_increasing_id())


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, T.NumericType):
        return "number"
    return {"struct": "object", "array": "array"}.get(t.typeName(), "string")


def _walk(prefix: str, fields) -> list[tuple[str, str]]:
    rows = []
    for f in fields:
        name, t = f"{prefix}{f.name}", f.dataType
        rows.append((name, _kind(t)))
        if isinstance(t, T.StructType):
            rows += _walk(f"{name}.", t.fields)
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            rows += _walk(f"{name}[].", t.elementType.fields)
    return rows


def doc_schema(df: DataFrame, text: str, sample: int | None = None) -> DataFrame:
    """(name, dtype) of JSON texts: dotted names for objects, ``name[].child`` for lists of objects.

    The merged schema is one aggregate over all texts; only its one-line
    description reaches the driver.  ``sample`` looks at that many rows instead.
    """
    rows = df.limit(sample) if sample else spread_small(df)
    found = rows.agg(F.schema_of_variant_agg(F.try_parse_json(text)).alias("s")).first()["s"] or "OBJECT<>"
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", found).replace("VARIANT", "STRING").replace("VOID", "STRING")
    kind = T.DataType.fromDDL(ddl) if ddl != "STRUCT<>" else T.StructType([])
    rows = _walk("", kind.fields) if isinstance(kind, T.StructType) else []
    return df.sparkSession.createDataFrame(rows, "name string, dtype string")
