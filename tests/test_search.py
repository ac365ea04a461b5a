"""Indexed search: literals of patterns, the rows of the scan, and what is read for them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import filters, postings, ranking, search
from plumbline.session import shared_dir


@pytest.mark.parametrize("pattern, expected", [
    ("then\\s+and|retition", [["then", "and"], ["retition"]]), ("abc+d", [["abc", "d"]]), ("abcd?e", [["abc", "e"]]), ("abc*", [["ab"]]), ("ab{0,3}cd", [["a", "cd"]]),
    ("(abc|def)ghi", [["ghi"]]), ("a\\.b\\d", [["a.b"]]), ("[abc]def[]x]y", [["def", "y"]]), ("(?i)Abc", [["Abc"]]), ("^abc$", [["abc"]]), ("x[^]]yz", [["x", "yz"]]),
    ("a|", [["a"], []]), ("(?x)a b c", None), ("\\Qa.b\\E", None), ("\\x41bc", None), ("(?<n>abc)def", None), ("\\p{L}abc", None), ("(?:ab)?cde", [["cde"]]), ("[a[b]]c", None), ("", [[]]),
])
def test_literals_of_a_pattern(pattern, expected):
    assert postings.alternatives(pattern) == expected


def test_literals_are_in_every_match():
    rnd = random.Random(4)
    atoms = ["abc", "de", "x", "\\.", ".", "[ab]", "(?:abc|de)", "(xy)", "a", "\\s", "\\w", "cd", "|"]
    texts = ["".join(rnd.choice(["abc", "de", "x", ".", " ", "xy", "cd", "b", "A"]) for _ in range(12)) for _ in range(60)]
    tried = 0
    for _ in range(1500):
        pattern = "".join(rnd.choice(atoms) + rnd.choice(["", "", "", "?", "*", "+", "{0,2}"]) for _ in range(4))
        try:
            compiled = re.compile(pattern, re.IGNORECASE)
        except re.error:
            continue
        sets = postings.needed(postings.alternatives(pattern))
        if sets is None:
            continue
        tried += 1
        for t in texts:
            if compiled.search(t):
                assert any(s <= postings.codes(t) for s in sets), (pattern, t)
    assert tried > 100


ODD = ["Then  and now", "THEN and", "reTITION", None, "", "th", "é then€and", "no\nthen\tand", "KELVIN then", "x" * 200_000 + "retition" + "y" * 200_000, "the hen and", "ab%c_d"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, f"c{i % 3}", "always" if i % 7 == 3 else "search") for i, t in enumerate(ODD)]
    data += [(100 + i, f"filler {i} {chr(97 + i % 26) * 3}", "c0", "search") for i in range(2000)]
    return spark.createDataFrame(data, "item_id long, text string, category string, load_mode string")


@pytest.fixture(scope="module")
def index(spark, rows):
    return postings.build(rows, "item_id", ["text", "category", "item_id"], shared_dir(spark, "index-test"), parts=32)


def same(a, b):
    return [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]


@pytest.mark.parametrize("queries", [["then\\s+and"], ["retition", "broken("], ["1999"], ["the.*and", "zzz"], ["nowhere to be found"], ["broken("], ["th"], ["c2|aaa"], ["€AND"], ["ab%c_"]])
def test_multi_search_like_the_scan(rows, index, queries):
    args = (queries, ["text", "category", "item_id"], "item_id", 50)
    found = search.multi_search(index, *args)
    assert same(found.select(*rows.columns, "total"), filters.multi_search(rows, *args))


@pytest.mark.parametrize("q", ["THEN", "kelvin", "é then", "ab%c_d", "t", "", "\n"])
def test_ilike_like_the_scan(rows, index, q):
    args = (q, ["text"], "item_id", "item_id", 30)
    assert same(search.ilike_recent(index, *args).select(*rows.columns), filters.ilike_recent(rows, *args))


@pytest.mark.parametrize("question", ["then retition", "filler kelvin", "zz", "", "unheard words"])
def test_guidance_and_related_like_the_scan(spark, rows, index, question):
    semantic = spark.createDataFrame([(5, 0.5), (200, 0.25), (201, 0.0), (3, 0.9)], "item_id long, semantic double")
    for s in (None, semantic):
        expected = ranking.guidance_search(rows, question, 20, None, s)
        assert sorted(map(str, search.guidance_search(index, question, 20, None, s).select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
        words = question.split()
        if words:
            assert same(search.related(index, words, 1, 30, s), ranking.related(rows, words, 1, 30, s))


def scanned(df):
    """(files, rows) that the leaves of a plan have read; for a plan that is not adaptive."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    out = [0, 0]
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics()
        for j, name in enumerate(("numFiles", "numOutputRows")):
            out[j] += m.apply(name).value() if m.contains(name) else 0
    return tuple(out)


def test_unmatched_texts_are_not_read(spark, index):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = index.containing(["retition"])
        assert found.indexed and found.reason == "2 of 32 folders are read"  # of two texts
        files, read = scanned(found.rows.select("item_id", "text"))
        whole = scanned(index.table())
        # two folders of the rows, and the keys that were found
        assert files <= whole[0] / 8 and read < whole[1] / 8
        none = index.containing(["nowhere to be found"])
        assert none.indexed and scanned(none.rows)[1] == 0
        plan = index.candidates([postings.codes("retition")])._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [__part" in plan and "PushedFilters: [In(gram" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_literal_falls_back_and_says_so(rows, index):
    found = index.matching(["a.b|[xyz]+"])
    assert not found.indexed and "every row" in found.reason and found.rows.count() == rows.count()
    assert index.matching(["(?x) abc"]).indexed is False


def test_built_once_for_a_version(spark, rows, tmp_path):
    root = shared_dir(spark, "index-versions")
    first = postings.build(rows, "item_id", ["text"], root, parts=4)
    assert postings.build(rows.orderBy(F.desc("item_id")).repartition(3), "item_id", ["text"], root, parts=4).path == first.path
    changed = postings.build(rows.withColumn("text", F.when(F.col("item_id") == 0, "other").otherwise(F.col("text"))), "item_id", ["text"], root, parts=4)
    assert changed.path != first.path and changed.containing(["other"]).rows.count() == 1
    with pytest.raises(ValueError):
        postings.build(rows.union(rows.selectExpr("NULL", "text", "category", "load_mode").limit(1)), "item_id", ["text"], root)
    empty = postings.build(rows.limit(0), "item_id", ["text"], root, parts=4)
    assert empty.containing(["other"]).rows.count() == 0 and empty.matching(["."]).rows.count() == 0


def test_repeated_keys_keep_all_rows(spark):
    df = spark.createDataFrame([(1, "abcdef"), (1, "ghijkl"), (2, "abc"), (2, "defghi"), (3, "abcdefghijkl")] * 2, "item_id long, text string")
    index = postings.build(df, "item_id", ["text"], shared_dir(spark, "index-repeats"), parts=4)
    got = index.matching(["abcd"]).rows.where("text rlike 'abcd'").collect()
    assert sorted(tuple(r) for r in got) == [(1, "abcdef")] * 2 + [(3, "abcdefghijkl")] * 2


def test_postings_are_packed_and_whole(spark, rows, index):
    stored = index.postings()
    assert stored.columns == ["gram", "keys", "n", "__part"] and stored.where("n <> size(keys) OR __part <> gram % 32").isEmpty()
    got = {(r.gram, r.key) for r in stored.selectExpr("gram", "explode(keys) AS key").collect()}
    assert got == {(g, r.item_id) for r in rows.collect() for c in (r.text, r.category, str(r.item_id)) for g in postings.codes(c or "")}
    assert stored.count() < len(got) / 4
