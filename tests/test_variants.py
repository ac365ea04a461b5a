"""Find and group over documents whose fields differ in kind."""

import json

import pytest

from plumbline.sources import variants

DOCS = [
    {"_id": 1, "x": 5, "a": {"b": "s"}}, {"_id": 2, "x": "5", "a": {"b": 7}}, {"_id": 3, "x": None}, {"_id": 4}, {"_id": 5, "x": [1, "z", 9.5]}, {"_id": 6, "x": True, "a": [{"b": 1}, {"b": "t"}, 3]},
    {"_id": 7, "x": {"y": 1}, "a": {"b": [8, 9]}}, {"_id": 8, "x": 5.0, "it's": 1, "a.b": 3}, {"_id": 9, "x": -2.5, "a": []}, {"_id": 10, "x": "abc"},
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(json.dumps(d), 1) for d in DOCS] + [("not json", 1), (None, 1), ("[1, 2]", 1), ("7", 1)], "body string, doc int")


def ids(docs, find, **more):
    return [int(r._id) for r in variants.doc_find(docs, "body", {"find": find, "projection": ["_id"], "sort": {"_id": 1}, **more}).collect() if r._id is not None]


@pytest.mark.parametrize("find, expected", [
    ({"x": 5}, [1, 8]), ({"x": "5"}, [2]), ({"x": {"$gt": 1}}, [1, 5, 8]), ({"x": {"$lte": "5"}}, [2]), ({"x": {"$gte": "a"}}, [5, 10]), ({"x": True}, [6]), ({"x": None}, [3, 4]),
    ({"x": {"$exists": True}}, [1, 2, 3, 5, 6, 7, 8, 9, 10]), ({"x": {"$exists": False}}, [4]), ({"x": {"$ne": 5}}, [2, 3, 4, 5, 6, 7, 9, 10]), ({"x": {"$in": [1, "abc", None]}}, [3, 4, 5, 10]),
    ({"x": {"$nin": [5, None]}}, [2, 5, 6, 7, 9, 10]), ({"x": {"$type": "array"}}, [5]), ({"x": {"$type": "number"}}, [1, 5, 8, 9]), ({"x": {"$type": "null"}}, [3]), ({"x": {"$regex": "^[az]"}}, [5, 10]),
    ({"a.b": 1}, [6]), ({"a.b": {"$gt": 6}}, [2, 7]), ({"a.b": {"$type": "string"}}, [1, 6]), ({"a.b": {"$exists": True}}, [1, 2, 6, 7]), ({"a.b": 9}, [7]), ({"x.y": 1}, [7]), ({"it's": 1}, [8]),
    ({"x": {"$not": {"$gt": 0}}}, [2, 3, 4, 6, 7, 9, 10]), ({"$or": [{"x": 5}, {"x": "abc"}], "_id": {"$gt": 1}}, [8, 10]), ({"$nor": [{"x": {"$exists": True}}]}, [4]), ({"x": {"$gt": 0, "$lt": 9}}, [1, 5, 8]),
])
def test_find(docs, find, expected):
    assert ids(docs, find) == expected


def test_order_of_kinds_and_cells(docs):
    got = variants.doc_find(docs, "body", {"find": {"_id": {"$gt": 0}}, "projection": ["_id", "x", "a.b"], "sort": [("x", 1), ("_id", 1)]}).collect()
    # missing and null, numbers, texts, objects, lists, booleans
    assert [int(r._id) for r in got] == [3, 4, 9, 1, 8, 2, 10, 7, 5, 6]
    cells = {int(r._id): (r.x, r["a.b"]) for r in got}
    assert cells[3][0] == "null" and cells[4][0] is None and cells[5][0] == '[1,"z",9.5]' and cells[1] == ("5", '"s"') and cells[7][1] == "[8,9]"
    assert ids(docs, {"_id": {"$gt": 0}}, limit=3) == [1, 2, 3]
    assert variants.doc_find(docs, "body", {}).count() == len(DOCS) + 4
    for bad in ({"x": {"$nope": 1}}, {"x": {"$gt": None}}, {"x": {"$eq": {"y": 1}}}):
        with pytest.raises(ValueError):
            ids(docs, bad)


def test_group(docs):
    rows = variants.group(docs, "body", {"_id": "$x", "n": {"$sum": 1}, "ids": {"$sum": "$_id"}}, match={"_id": {"$gt": 0}}).collect()
    assert {r._id: (r.n, r.ids) for r in rows} == {"5": (2, 9.0), '"5"': (1, 2.0), None: (2, 7.0), '[1,"z",9.5]': (1, 5.0), "true": (1, 6.0), '{"y":1}': (1, 7.0), "-2.5": (1, 9.0), '"abc"': (1, 10.0)}
    (all_,) = variants.group(docs, "body", {"_id": None, "lo": {"$min": "$x"}, "hi": {"$max": "$x"}, "mean": {"$avg": "$x"}, "n": {"$sum": 2}}, match={"_id": {"$gt": 0}}).collect()
    assert (all_._id, all_.lo, all_.hi, all_.mean, all_.n) == (None, "-2.5", "true", 2.5, 20)
    members = variants.group(docs, "body", {"_id": "$x", "n": {"$sum": 1}}, match={"x": {"$exists": True}}, unwind="x").collect()
    assert {r._id: r.n for r in members} == {"5": 2, '"5"': 1, "1": 1, '"z"': 1, "9.5": 1, "true": 1, '{"y":1}': 1, "-2.5": 1, '"abc"': 1}
    whole = variants.group(docs, "body", {"_id": None, "n": {"$sum": 1}}, unwind="x").collect()  # missing, null and no document give no member
    assert [r.n for r in whole] == [10]
    nested = variants.group(docs, "body", {"_id": "$a.b", "n": {"$sum": 1}}, match={"_id": 6}, unwind="a").collect()
    assert {r._id: r.n for r in nested} == {"1": 1, '"t"': 1, None: 1}
