"""Aggregation pipelines over nested documents, stage by stage."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources.documents import doc_aggregate

DATA = [
    (1, {"v": 1, "w": "x"}, {"v": 5, "tags": ["p", "q"]}, [(1, "a"), (2, "b")]),
    (2, {"v": None, "w": "y"}, {"v": 6, "tags": []}, []),
    (3, None, None, None),
    (4, {"v": 4, "w": None}, {"v": None, "tags": None}, [(9, None)]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, a, b, c) for i, a, b, c in DATA], "_id int, a struct<v:int,w:string>, b struct<v:int,tags:array<string>>, items array<struct<q:int,k:string>>")


def run(df, *stages, **more):
    """Rows as dicts without missing values, nested cells read back."""
    out = []
    for r in doc_aggregate(df, list(stages), **more).collect():
        cells = {k: json.loads(v) if isinstance(v, str) and v[:1] in "[{" else v for k, v in r.asDict().items()}
        out.append({k: v for k, v in cells.items() if v is not None})
    return sorted(out, key=lambda d: str(d.get("_id")))


def test_project_keeps_names_nested(docs):
    assert run(docs, {"$project": {"a.v": 1, "b.v": 1}}) == [
        {"_id": 1, "a": {"v": 1}, "b": {"v": 5}}, {"_id": 2, "a": {}, "b": {"v": 6}}, {"_id": 3}, {"_id": 4, "a": {"v": 4}, "b": {}}]
    assert run(docs, {"$project": {"_id": 1, "items.q": 1}})[0] == {"_id": 1, "items": [{"q": 1}, {"q": 2}]}
    assert run(docs, {"$match": {"_id": 1}}, {"$project": {"_id": 0, "a.v": 1, "a.u": {"$add": ["$b.v", 1]}, "c.d.e": "$a.w", "none.of": 1}}) == [{"a": {"v": 1, "u": 6}, "c": {"d": {"e": "x"}}}]
    assert run(docs, {"$match": {"_id": 1}}, {"$project": {"a.w": 0, "items.k": 0, "b": 0}}) == [{"_id": 1, "a": {"v": 1}, "items": [{"q": 1}, {"q": 2}]}]
    assert run(docs, {"$match": {"_id": 3}}, {"$project": {"a.w": 0, "items.k": 0}}) == [{"_id": 3}]
    assert run(docs, {"$match": {"_id": 4}}, {"$unset": ["a", "b.v", "items"]}) == [{"_id": 4, "b": {}}]
    with pytest.raises(ValueError):
        run(docs, {"$project": {"a": 1, "a.v": 1}})


def test_unwind_puts_the_member_where_the_list_was(docs):
    got = run(docs, {"$unwind": "$b.tags"}, {"$project": {"b": 1}})
    assert got == [{"_id": 1, "b": {"v": 5, "tags": "p"}}, {"_id": 1, "b": {"v": 5, "tags": "q"}}]
    kept = run(docs, {"$unwind": {"path": "$b.tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "at.i"}}, {"$project": {"b.tags": 1, "at": 1}})
    assert kept == [{"_id": 1, "b": {"tags": "p"}, "at": {"i": 0}}, {"_id": 1, "b": {"tags": "q"}, "at": {"i": 1}}, {"_id": 2, "b": {}, "at": {}}, {"_id": 3, "at": {}}, {"_id": 4, "b": {}, "at": {}}]
    assert run(docs, {"$unwind": "$items"}, {"$match": {"items.q": {"$gt": 1}}}, {"$project": {"items": 1}}) == [{"_id": 1, "items": {"q": 2, "k": "b"}}, {"_id": 4, "items": {"q": 9}}]
    assert [d["_id"] for d in run(docs, {"$unwind": "$a.v"})] == [1, 4]  # no list: its own only member


def test_set_of_nested_names(docs):
    got = run(docs, {"$addFields": {"a.v": {"$literal": 7}, "new.deep.x": "$b.v"}}, {"$project": {"a": 1, "new": 1}})
    assert got[0] == {"_id": 1, "a": {"v": 7, "w": "x"}, "new": {"deep": {"x": 5}}} and got[2] == {"_id": 3, "a": {"v": 7}, "new": {"deep": {}}}
    # all values see the row as it was
    assert run(docs, {"$match": {"_id": 1}}, {"$set": {"p": "$a.v", "a.v": {"$literal": 9}, "q": "$a.v"}}, {"$project": {"p": 1, "q": 1, "a.v": 1}}) == [{"_id": 1, "p": 1, "q": 1, "a": {"v": 9}}]


def test_ordered_accumulators_follow_the_sort(spark):
    df = spark.range(5000).select(F.col("id").alias("_id"), (F.col("id") % 7).alias("g"), (F.xxhash64("id") % 100).alias("x")).repartition(13)
    rows = sorted(((r.g, -r.x, r._id, r.x) for r in df.collect()))
    got = run(df, {"$sort": {"x": -1}}, {"$match": {"x": {"$lt": 50}}}, {"$group": {"_id": "$g", "first": {"$first": "$_id"}, "last": {"$last": "$x"}, "all": {"$push": "$_id"}}})
    for d in got:
        own = [(i, x) for g, _, i, x in rows if g == d["_id"] and x < 50]
        assert d["all"] == [i for i, _ in own] and d["first"] == own[0][0] and d["last"] == own[-1][1]
    # members of a list stand in its order, and a limit takes the first of the sort
    lists = spark.createDataFrame([(1, [3, 1, 2], 5), (2, [9, 8], 7), (3, [4], 6)], "_id int, l array<int>, s int").repartition(3)
    assert run(lists, {"$sort": {"s": -1}}, {"$unwind": "$l"}, {"$group": {"_id": None, "l": {"$push": "$l"}, "f": {"$first": "$l"}}}) == [{"l": [9, 8, 4, 3, 1, 2], "f": 9}]
    assert run(lists, {"$sort": {"s": -1}}, {"$unwind": "$l"}, {"$limit": 3}, {"$group": {"_id": None, "l": {"$push": "$l"}}}) == [{"l": [9, 8, 4]}]
    assert run(lists, {"$sort": {"s": -1}}, {"$skip": 1}, {"$limit": 1}, {"$project": {"s": 1}}) == [{"_id": 3, "s": 6}]
    assert run(lists, {"$group": {"_id": None, "ids": {"$push": "$_id"}}}) == [{"ids": [1, 2, 3]}]  # without a sort: by id


def test_lookup(spark, docs):
    other = spark.createDataFrame([(10, 1, "one"), (11, 1, "uno"), (12, 4, "four"), (13, None, "none")], "_id int, v int, name string")
    got = run(docs, {"$lookup": {"from": "o", "localField": "a.v", "foreignField": "v", "as": "found"}}, {"$project": {"found.name": 1}}, collections={"o": other})
    assert [[f["name"] for f in d["found"]] for d in got] == [["one", "uno"], ["none"], ["none"], ["four"]]  # missing equals missing
    tags = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q")], "_id int, t string")
    got = run(docs, {"$lookup": {"from": "t", "localField": "b.tags", "foreignField": "t", "as": "hit"}}, {"$project": {"hit._id": 1}}, collections={"t": tags})
    assert [[h["_id"] for h in d["hit"]] for d in got] == [[1, 2, 3], [], [], []]


def test_expressions_facets_and_roots(docs):
    assert [d["_id"] for d in run(docs, {"$match": {"$expr": {"$lt": ["$a.v", "$b.v"]}}})] == [1]
    assert [d["_id"] for d in run(docs, {"$match": {"$expr": {"$or": [{"$eq": ["$a.w", "y"]}, {"$in": ["p", "$b.tags"]}]}}})] == [1, 2]
    assert run(docs, {"$match": {"a.v": {"$gt": 0}}}, {"$replaceRoot": {"newRoot": "$a"}}) == [{"v": 1, "w": "x"}, {"v": 4}]
    (facet,) = run(docs, {"$facet": {"n": [{"$count": "c"}], "top": [{"$sort": {"b.v": -1}}, {"$limit": 2}, {"$project": {"_id": 1}}], "none": [{"$match": {"_id": 99}}, {"$project": {"_id": 1}}]}})
    assert facet == {"n": [{"c": 4}], "top": [{"_id": 2}, {"_id": 1}], "none": []}
    assert run(docs, {"$sortByCount": {"$cond": [{"$gt": ["$a.v", 0]}, "some", "none"]}}, {"$limit": 1}) == [{"_id": "none", "count": 2}]
    for bad in ({"$nope": 1}, {"$project": {"x": {"$nope": 1}}}, {"$group": {"_id": None, "x": {"$nope": 1}}}):
        with pytest.raises(ValueError):
            run(docs, bad)
