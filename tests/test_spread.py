"""Hot keys and brute force: exact results when one key holds most rows."""

import datetime as dt
import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import profile, quota, rules
from plumbline.operators.conversation import pair_turns
from plumbline.operators.spread import running_total




def test_running_total_of_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), "id", (F.col("id") % 7).alias("a"))
    got = {r.id: r.running for r in running_total(df, ["k"], [F.col("id")], "a").collect()}
    total, want = {}, {}
    for i in range(20_000):
        k = i % 50 if i % 3 == 0 else -1
        total[k] = total.get(k, 0) + i % 7
        want[i] = total[k]
    assert got == want


def test_running_total_spreads_the_hot_key(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), "id")
    plan = running_total(df, ["k"], [F.col("id")], "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "_rt_pid" in plan[plan.index("Window"):]


def test_quantiles_match_numpy(spark):
    rng = random.Random(3)
    vals = [rng.choice([0.0, 1.5, rng.gauss(0, 10)]) for _ in range(4001)]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.999, 1.0]
    got = {r.prob: r.value for r in profile.exact_quantiles(df, probs).collect()}
    assert np.allclose([got[p] for p in probs], np.quantile(vals, probs))


def test_quota_breach_matches_a_loop(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 31, 12)
    data = [(i, 0 if i % 3 else i % 40, base + dt.timedelta(minutes=rng.randrange(4000)), rng.randrange(0, 30)) for i in range(6000)]
    events = spark.createDataFrame(data, "event_id int, user_id int, ts timestamp, bytes int")
    caps = {u: 400 + 10 * u for u in range(40)}
    limits = spark.createDataFrame(list(caps.items()), "user_id int, limit int")
    used, want = {}, {}
    for i, u, ts, b in sorted(data, key=lambda x: (x[2], x[0])):
        k = (u, ts.month)
        used[k] = used.get(k, 0) + b
        if b and used[k] > caps[u] and k not in want:
            want[k] = (i, used[k])
    got = {(r.user_id, r.month.month): (r.event_id, r.used) for r in quota.quota_breach(events, limits, ["user_id"], "bytes").collect()}
    assert got == want and len(want) > 15


def test_ordering_rules_match_a_loop(spark):
    rng = random.Random(9)
    base = dt.datetime(2024, 1, 1)
    calls = [(i, 0 if i % 2 else rng.randrange(1, 60), rng.choice("abc"), base + dt.timedelta(seconds=rng.randrange(500))) for i in range(600)]
    lists = {}
    for i, c, tool, _ in sorted(calls, key=lambda x: (x[3], x[0])):
        lists.setdefault(c, []).append(tool)
    made, want = [], {}
    for n, case in enumerate(sorted(lists)):
        for mode in ("flexible", "strict", "exact"):
            seq = lists[case][:3] if n % 2 else [rng.choice("abc") for _ in range(3)]
            if mode == "exact" and n % 3 == 0:
                seq = lists[case]
            rid, have = len(made), lists[case]
            made.append((rid, case, mode, list(seq)))
            it = iter(have)
            want[rid] = {"flexible": all(s in it for s in seq), "exact": have == seq,
                         "strict": any(have[i:i + len(seq)] == seq for i in range(len(have)))}[mode]
    got = rules.ordering_rules(spark.createDataFrame(made, "rule_id int, case_id int, mode string, sequence array<string>"),
                               spark.createDataFrame(calls, "call_id int, case_id int, tool_name string, started_at timestamp"))
    assert {r.rule_id: r.passed for r in got.collect()} == want


def test_turns_across_blocks_match_a_loop(spark):
    rng = random.Random(13)
    turns = [(c, i, rng.choice(["user", "assistant", "system"]), f"text {i}") for c, n in ((1, 3000), (2, 5)) for i in range(n) if rng.random() < 0.9]
    want = {}
    for c in (1, 2):
        mine = [t for t in turns if t[0] == c and t[2] != "system"]
        for a, b in zip(mine, [*mine[1:], None]):
            if a[2] == "user":
                want[(c, a[1])] = b[3] if b and b[2] == "assistant" else ""
    got = {(r.conv_id, r.turn): r.answer or "" for r in pair_turns(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).collect()}
    assert got == want


def test_pairs_match_combinations(spark):
    from plumbline.operators.activity import table_pairs

    rng = random.Random(23)
    at = dt.datetime(2024, 1, 1)
    use = [(0 if i % 3 == 0 else rng.randrange(80), f"t{rng.randrange(12):02d}", at) for i in range(900)]
    sets, want = {}, {}
    for s, n, _ in use:
        sets.setdefault(s, set()).add(n)
    for names in sets.values():
        for p in combinations(sorted(names), 2):
            want[p] = want.get(p, 0) + 1
    got = table_pairs(spark.createDataFrame(use, "step_id int, table_fqn string, used_at timestamp"), at, at, n=10_000)
    assert {(r.table_a, r.table_b): r.together for r in got.collect()} == want


