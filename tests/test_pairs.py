"""Top pairs by support bounds against all pairs."""

import datetime as dt
import random
from collections import Counter
from itertools import combinations

import pytest

from plumbline.operators import activity

DAY = dt.datetime(2024, 1, 2)
RANGE = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))


def brute(steps, n):
    counts = Counter(p for tables in steps.values() for p in combinations(sorted(set(tables)), 2))
    top = sorted((-c, a, b) for (a, b), c in counts.items())[:n]
    return [(a, b, -c, sum(len(set(t)) > 1 for t in steps.values())) for c, a, b in top]


def usage(spark, steps):
    rows = [(s, t, DAY) for s, tables in steps.items() for t in tables]
    return spark.createDataFrame(rows, "step_id long, table_fqn string, used_at timestamp")


CASES = {
    "skewed": {i: random.Random(i).sample([f"t{j:03}" for j in range(40)], 5) + ["hot"] for i in range(300)},
    "singles": {i: [f"s{i}_{j}" for j in range(6)] for i in range(30)},
    "few": {1: ["a", "b"], 2: ["b", "a", "a"], 3: ["c"]},
    "none": {1: ["a"], 2: ["b"]},
    "rare beside common": {**{i: ["a", "b", "c"] for i in range(4)}, **{100 + i: [f"r{i}", "a"] for i in range(50)}, 200: ["d", "e"]},
}


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("n, probe", [(10, 4), (50, 32)])
def test_like_all_pairs(spark, case, n, probe):
    got = activity.top_pairs(usage(spark, CASES[case]), *RANGE, n=n, probe=probe).collect()
    assert [tuple(r) for r in got] == brute(CASES[case], n)


def test_a_query_of_very_many_tables(spark):
    steps = {i: [f"t{j}" for j in range(8)] for i in range(20)}
    steps[999] = [f"wide{j:05}" for j in range(5000)] + ["t1", "t2"]  # twelve million pairs, none of which can win
    df = activity.top_pairs(usage(spark, steps), *RANGE, n=20)
    assert [tuple(r) for r in df.collect()] == brute({k: [t for t in v if not t.startswith("wide")] for k, v in steps.items()}, 20)
    # and where single pairs can win, the first by name do
    wide = {1: [f"w{j:05}" for j in range(5000)], 2: ["w00000", "x"]}
    got = [tuple(r)[:3] for r in activity.top_pairs(usage(spark, wide), *RANGE, n=30).collect()]
    assert got == [("w00000", f"w{j:05}", 1) for j in range(1, 31)]
