"""Url filters, archives, vector search, components and the registered queries."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import archives, crf, pivots, queries, urls
from plumbline.llm.shared import components
from plumbline.plans.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_like_sql(name, spark):
    ok, why, _ = compare(queries.QUERIES[name](spark, SF), queries.ORACLES[name], oracle_connection(SF))
    assert ok, why


def test_registered():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_duplicates", "benchmark_decontamination", "byte_bpe"]
    sizes, now = [docs.count()], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.cut_lineage(stage(spark, now, SF))
        assert out.columns == docs.columns or i == 4
        assert out.select("doc_id").exceptAll(now.select("doc_id")).isEmpty()
        now = out
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0] and sizes[-1] == sizes[-2]
    assert corpus_pipeline.run(spark, SF).exceptAll(now).isEmpty()


def test_language_stage_keeps_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = [(-i, t, "fr", "s", len(t)) for i, t in enumerate(["Avec.", "A.", "Erö.", "This.", "Thlyntsh.", "Edrere."], 1)] + [(-9, "12 !!", "fr", "s", 5), (-10, None, "fr", "s", 0)]
    more = docs.unionByName(spark.createDataFrame(short, docs.schema))
    kept = corpus_pipeline.in_a_language(spark, more, SF).where("doc_id < 0").collect()
    assert sorted(-r.doc_id for r in kept) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("score", [0.6, 0.8])
def test_quality_stage_decides_like_op2(spark, monkeypatch, score):
    weights = np.zeros(crf.N_FEATURES)
    weights[0] = np.log(score / (1 - score))  # every line has this marginal
    field = crf.Field(weights, np.zeros((2, 2)), score)
    monkeypatch.setattr(crf, "train", lambda *_: field)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    kept = corpus_pipeline.of_quality(spark, docs, SF).count()
    assert kept == crf.score(docs, field).where("predicted = 1").count() == (20 if score >= crf.THRESHOLD else 0)


def test_targets(spark):
    cases = [("b", "http://h/a/b"), ("/b/../c/./d", "http://h/c/d"), ("../../..", "http://h"), ("//o/p", "http://o/p"), ("?q=1", "http://h/a/x?q=1"), ("c?u=../d#e", "http://h/a/c?u=../d#e"), ("HTTPS://o", "HTTPS://o"),
             ("javascript:x", None), ("#", None), ("", None), ("./", "http://h/a/"), ("a:b", None), ("..", "http://h"), ("x/../y", "http://h/a/y"), ("...", "http://h/a/...")]
    df = spark.createDataFrame([(t, "h", "/a/x") for t, _ in cases], "t string, host string, path string")
    got = [r.u for r in df.select(urls.resolved(df.t, df.host, df.path).alias("u")).collect()]
    assert got == [u for _, u in cases]


@pytest.mark.parametrize("shape", ["random", "path", "star", "cycle"])
def test_components(spark, shape):
    rnd = random.Random(3)
    edges = {"random": [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(90)], "path": [(i, i + 1) for i in range(60)],
             "star": [(500, i) for i in range(300)], "cycle": [(i, (i + 1) % 40) for i in range(40)]}[shape] + [(1, 1), (None, 3), (2, None), (7, 8), (8, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def link(target):
    return f'<html><link rel="canonical" href="{target}"></html>'


def test_url_filter(spark):
    refresh = '<meta http-equiv="refresh" content="0; url=http://a.net/1">'
    pages = [
        (1, "http://Sub.Example.ORG/es/x?y#z", None), (2, "http://example.org/en/15", ""), (3, "http://example.org/en/2", None), (4, "http://x.com/de", None),
        (5, "https://www.x.com/de/", None), (6, "no scheme", None), (7, None, None), (8, "http://a.net/1", link("http://b.net/2")), (9, "http://b.net/2/", link("//www.x.com/de/")),
        (10, "http://c.net/", refresh), (11, "http://d.net/q?utm_source=f", link("http://e.com/fr/1")), (12, "http://d.net/q", link("http://y.com/de/")),
        (12, "http://d.net/q", link("http://y.com/de/")), (None, "ftp://notorg/de/", None), (13, "http://evilexample.org/es/1", None), (14, "://", None), (15, "http://g.net/" + "p" * 100_000, link("/local")),
        (20, "http://k.net/d/1", link("2")), (21, "http://k.net/d/2", link("../x/./y?a=1&amp;b=2")), (22, "http://k.net/x/y?a=1&b=2", link("http://x.com/de/")),
        (23, "http://m.net", link("#top")), (24, "http://m.net/q", link("?p=1")), (25, "http://m.net/q?p=1", link("mailto:a@x.com/de/")), (26, "http://n.net/a/b/", link("../../../de/..")),
        (27, "http://n.net/", link("next?u=http://x.com/de/")), (28, "http://n.net/next?u=http://x.com/de/", None), (29, "http://" + "a." * 20_000 + "com/de/", None), (30, "http://w.net/e/\n", None), (31, "http://w.net/e", link("http://x.com/de/")),
    ]
    df = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id long, url string, html string, rule int, host int")
    # 4 is spelled like 5; 8, 9 and 10 lead to the blocked 5 and are blocked with 4; 11 and 12 also reach an allowed url
    expected = [(1, "example.org/es/", "block"), (2, "example.org/en/1", "block"), (3, "org/", "allow"), (4, None, "block"), (5, "com/de/", "block"), (6, None, "allow"), (7, None, "allow"),
                (8, None, "block"), (9, None, "block"), (10, None, "block"), (11, None, "allow"), (12, None, "allow"), (12, None, "allow"), (None, None, "allow"),
                (13, "org/", "allow"), (14, None, "allow"), (15, None, "allow"),
                # 20 leads to 21, that to 22, and that to a blocked url; the others lead nowhere blocked, or nowhere; a line break is no end of a path
                (20, None, "block"), (21, None, "block"), (22, None, "block"), (23, None, "allow"), (24, None, "allow"), (25, None, "allow"), (26, None, "allow"),
                (27, None, "allow"), (28, None, "allow"), (29, "com/de/", "block"), (30, None, "allow"), (31, None, "block")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = urls.judge(df, rules).collect()
    assert sorted(((r.page_id, r.rule, r.verdict) for r in rows), key=str) == sorted(expected, key=str)
    row = {r.page_id: r for r in rows}
    assert (row[1].host, row[1].path) == ("sub.example.org", "/es/x") and (row[6].host, row[7].path, row[14].host) == ("", "", "")
    assert urls.judge(df.limit(0), rules).count() == 0
    # all of it once more through the SQL oracle
    con = duckdb.connect()
    con.register("pages_frame", df.select("page_id", "url", "html").toPandas())
    con.execute("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM pages_frame")
    ok, why, _ = compare(urls.judge(df, rules), queries.ORACLES["op8_url_filter"], con)
    assert ok, why


def test_arc_versions_and_places(spark, tmp_path):
    pages = [(1, "http://a/ b", "x" * 150), (2, None, "x" * 150), (3, "http://a/%41é", "short"), (4, "-", "short"), (5, "", None), (None, "http://n", "x" * 150), (2, "http://dup", "y" * 200), (2, "http://dup", "y" * 200), (6, "u", "é\r\n\r\n" * 300_000)]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, path string")
    out = archives.through_archives(df).collect()
    size = lambda h: len((h or "").encode())
    assert sorted(((r.page_id, r.url, r.payload_bytes) for r in out), key=str) == sorted(((i, u, size(h)) for i, u, h in pages), key=str)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in out), key=str)
    assert kinds == sorted([(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (None, "revisit", 1), (2, "response", None), (2, "revisit", 2), (6, "response", None)], key=str)
    assert len({r.record_id for r in out}) == len(out)
    assert archives.through_archives(df.limit(0)).count() == 0
    for version in (1, 2):
        data = archives.arc_header("n.arc", version) + archives.arc_record("http://a", 9, b"body", version, 0, "n.arc")
        (r,) = archives.parse_arc(data)
        assert (r.url, r.page_id, r.payload) == ("http://a", 9, b"body")
        (again,) = archives.parse_arc(b"".join(zlib.compress(x, wbits=31) for x in (archives.arc_header("n.arc", version), archives.arc_record("http://a", 9, b"body", version, 0, "n.arc"))))
        assert again.payload == b"body"
        with pytest.raises(ValueError):
            list(archives.parse_arc(data[:-3]))


def brute_top(vectors, k, every):
    best = {}
    rows = {(i, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    sizes = defaultdict(int)
    for _, v in {(i, v) for i, v in rows}:
        sizes[len(v)] += 1
    if not sizes:
        return []
    wide = max(sizes, key=lambda d: (sizes[d], -d))
    rows = [(i, v) for i, v in rows if len(v) == wide]
    for q, qv in rows:
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in rows if i != q))[:k]
            best[q] = [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(x for v in best.values() for x in v)


def test_pivot_search_like_brute_force(spark):
    rnd = np.random.default_rng(7)
    centers = rnd.normal(size=(6, 8))
    vectors = [(i, (centers[i % 6] * (1 + i % 3) + 0.1 * rnd.normal(size=8)).tolist()) for i in range(700)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(200)] + [vectors[10], (None, vectors[0][1]), (2000, None), (2001, [float("nan")] * 8), (2002, [1.0, None] * 4), (2003, [1.0, float("inf")] * 4), (2100, []), (2200, [0.5] * 3)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, cell string")
    whole = pivots.integers(df)
    index = pivots.build(whole, 10, n_pivots=7, rings=4, sample=100, block=50)
    asked = whole.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id").distinct()
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivots.search(index, asked, 10, asked.count()).collect())
    assert got == brute_top(vectors, 10, 100)
    assert pivots.build(whole.limit(0), 10) is None
    few = pivots.integers(df.where("vec_id < 4"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivots.search(pivots.build(few, 10), few.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), 10, 1).collect())
    assert got == brute_top([v for v in vectors if v[0] is not None and v[0] < 4], 10, 100)
