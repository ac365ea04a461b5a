"""Hard negatives against brute force, and what the boxes spare."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import rtree


def brute(vectors, every, positives, negatives, low, high):
    rows = {(i, lb, tuple(int(np.floor(256 * float(x))) for x in v)) for i, lb, v in vectors
            if i is not None and lb is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    by = defaultdict(list)
    for r in rows:
        by[len(r[2])].append(r)
    out = []
    for some in by.values():
        m = np.array([r[2] for r in some], np.int64)
        for i, label, v in some:
            if i % every:
                continue
            scores = (m @ np.array(v)).tolist()
            order = sorted((-s, r[0], r[1]) for s, r in zip(scores, some, strict=True) if r[0] != i)
            for s, p, _ in [x for x in order if x[2] == label][:positives]:
                fits = [(n, t) for t, n, lb in order if lb != label and low * -s <= 100 * -t <= high * -s][:negatives]
                out += [(i, p, rank, n, -s, -t) for rank, (n, t) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **sizes):
    rows = rtree.hard_negatives(rtree.integers(df), F.expr("vec_id % 50 = 0"), 5, 3, 50, 95, **sizes)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows.collect())


def clustered(n, seed=3):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(5, 6))
    # a third of the rows and more have label 0
    return [(i, 0 if i % 3 == 0 else int(rnd.integers(0, 6)), (centers[i % 5] + 0.3 * rnd.normal(size=6)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def odd():
    base = clustered(900)
    hot = base[50][2]
    base += [(2000 + i, i % 4, hot) for i in range(400)]  # many equal vectors: ties by id
    base += [base[3], base[3], (50, 5, hot), (50, 5, [-x for x in hot])]  # repeated rows, and one id with several vectors
    base += [(None, 1, hot), (3000, None, hot), (3050, 1, None), (3100, 1, []), (3150, 1, [None] * 6), (3200, 1, [float("nan")] * 6), (3250, 1, [float("inf")] * 6)]
    base += [(3300, 1, [1.0, 2.0]), (3301, 1, [1.0, 1.5]), (3302, 2, [1.0, 1.0]), (3350, 1, [0.0] * 6), (3351, 1, [-9.0] * 6)]
    return base


@pytest.mark.parametrize("block, tiles", [(60, 8), (4096, 1024), (100, 1)])
def test_like_brute_force(spark, odd, block, tiles):
    df = spark.createDataFrame([(*r, "q", 1) for r in odd], "vec_id long, label int, embedding array<double>, q string, TILE int")
    assert mined(df, block=block, tiles=tiles) == brute(odd, 50, 5, 3, 50, 95)


@pytest.mark.parametrize("rows", [[], [(50, 1, [1.0])], [(50, 1, [1.0, -1.0]), (51, 1, [1.0, 1.0]), (52, 2, [0.5, 3.0])], [(0, 1, [4e9, 2e9]), (1, 1, [4e9, 1e9]), (2, 2, [3e9, 1e9])]])
def test_few_rows_and_large_numbers(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(df) == brute(rows, 50, 5, 3, 50, 95)


def test_boxes_spare_rows():
    vectors = clustered(4000)
    v = np.array([[int(np.floor(256 * x)) for x in r[2]] for r in vectors])
    ids, labels = np.array([r[0] for r in vectors]), np.array([r[1] for r in vectors])
    asks = {"v": v[:200], "label": labels[:200], "vec_id": ids[:200], "lo": np.full((200, 1), rtree.LEAST), "hi": np.full((200, 1), rtree.MOST)}
    scored = []
    q, _, found, score = rtree.best_first(v, ids, labels, asks, 5, True, scored=scored)
    for i in range(200):
        mine = sorted((-int(s), int(n)) for n, s, lb in zip(ids, v @ v[i], labels, strict=True) if lb == labels[i] and n != ids[i])[:5]
        assert [(-s, n) for n, s in zip(found[q == i].tolist(), score[q == i].tolist(), strict=True)] == mine
    assert sum(scored) < 0.3 * 200 * len(v)  # the labels alone leave more than that


def test_cuts_bound_tiles():
    rnd = np.random.default_rng(1)
    v, labels = rnd.integers(-100, 100, (5000, 16)), np.where(rnd.random(5000) < 0.4, 7, rnd.integers(0, 9, 5000))
    root, made = rtree.str_cuts(labels, v, 64)
    counts = np.bincount(rtree.tile_of(root, labels, v), minlength=made)
    assert 32 <= made <= 160 and counts.sum() == 5000 and counts.max() < 600
    assert rtree.str_cuts(np.zeros(50, int), np.ones((50, 3), int), 16)[1] >= 1  # nothing to cut by
    at, taken = rtree.leaves(labels, v, np.arange(5000))
    assert sorted(at[taken].tolist()) == list(range(5000))
