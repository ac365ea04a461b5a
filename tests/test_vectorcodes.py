"""Vector search through codes against the full scan, and how few vectors the codes leave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import similarity, vectorcodes


def data(n=3000, d=24, seed=5):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(40, d))
    return [(i, f"k{i % 2}", (centers[i % 40] + 0.25 * rnd.normal(size=d)).tolist()) for i in range(n)]


def same(a, b):
    get = lambda df: sorted((str(r.query), r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    assert get(a) == get(b)


@pytest.mark.parametrize("block, k", [(400, 10), (100_000, 3), (700, 1)])
def test_like_the_full_scan(spark, block, k):
    rows = data()
    rows += [(5000 + i, "k1", rows[4][2]) for i in range(50)]  # ties by key
    rows += [(6000, "k0", None), (6001, "k0", [0.0] * 24), (6002, "k0", [1.0, 2.0]), (6003, "k1", [2.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, kind string, v array<double>")
    asked = [(f"q{i}", rows[i * 7][2]) for i in range(40)] + [("zero", [0.0] * 24), ("short", [1.0, 1.0]), ("none", None), ("long", [1.0] * 30), ("far", (-np.array(rows[0][2])).tolist())]
    q = spark.createDataFrame(asked, "query string, vector array<double>")
    same(vectorcodes.cosine_topk(v, "id", "v", q, k, block=block), similarity.cosine_topk(v, "id", "v", q, k))
    same(vectorcodes.cosine_topk(v, "id", "v", q, k, where={"kind": "k1"}, block=block), similarity.cosine_topk(v, "id", "v", q, k, where={"kind": "k1"}))


def test_many_queries_in_sets(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "QUERIES", 16)
    v = spark.createDataFrame(data(500), "id long, kind string, v array<double>")
    q = v.where("id % 5 = 0").select(F.col("id").alias("query"), F.col("v").alias("vector"))
    same(vectorcodes.cosine_topk(v, "id", "v", q, 4, block=120), similarity.cosine_topk(v, "id", "v", q, 4))


def test_nothing_to_search(spark):
    v = spark.createDataFrame(data(50), "id long, kind string, v array<double>")
    q = v.select(F.col("id").alias("query"), F.col("v").alias("vector"))
    assert vectorcodes.cosine_topk(v.limit(0), "id", "v", q, 4).count() == 0
    assert vectorcodes.cosine_topk(v, "id", "v", q.limit(0), 4).count() == 0


def test_codes_bound_scores_and_leave_few():
    rows = np.array([r[2] for r in data(4000)])
    unit = vectorcodes._unit(rows)
    centroids = vectorcodes.fit(unit[:2000], 8, 64)
    codes, left = vectorcodes.encode(unit, centroids)
    q = unit[::100]
    near, true = vectorcodes.approximate(q, codes, centroids), q @ unit.T
    assert (np.abs(near - true) <= left[None, :].astype(float) + 1e-9).all()
    floor = np.sort(near - left, axis=1)[:, -10]
    open_ = (near + left >= floor[:, None]).mean()
    assert open_ < 0.1  # one cluster of forty is 0.025 of the rows


def test_repeated_rows_and_queries_like_the_full_scan(spark):
    rows = data(300) * 2 + [(None, "k0", [1.0] * 24)] * 3
    v = spark.createDataFrame(rows, "id long, kind string, v array<double>")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("v").alias("vector"))
    same(vectorcodes.cosine_topk(v, "id", "v", q, 5, block=90), similarity.cosine_topk(v.where("id IS NOT NULL"), "id", "v", q, 5))


def test_pairs_are_scored_where_the_codes_are(spark):
    """Random directions leave nearly every pair open; no pair may leave its task for a join."""
    v = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=16).tolist()) for i in range(200)], "id long, v array<double>")
    out = vectorcodes.cosine_topk(v, "id", "v", v.where("id % 10 = 0").selectExpr("id AS query", "v AS vector"), 3, block=50)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 60
