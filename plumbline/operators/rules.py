"""Declarative checks: matchers on values, rules on runs, totals per case.

Rules and facts are both tables; facts are reduced per (case, tool, ...) before
they meet the rules, so a case with a third of all calls joins as a few rows.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .spread import running_total

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# The flags that a rule may write behind its pattern.
FLAGS = {"i": re.I, "m": re.M, "s": re.S}
_WRITTEN = re.compile(r"/(?P<body>.*)/(?P<flags>[^/]*)", re.S)


def compile_pattern(raw: str | None):
    """Regex of a rule, written plainly or as ``/pattern/flags``: nothing or ``*`` matches all, an invalid one is None."""
    written = _WRITTEN.fullmatch(raw or "")
    body, letters = written.group("body", "flags") if written else (raw or "", "")
    everything = body.strip() in ("", "*")
    try:
        return re.compile(".*" if everything else body, sum({FLAGS[c] for c in letters if c in FLAGS}))
    except re.error:
        return None


@F.pandas_udf(T.BooleanType())
def regex_found(values: pd.Series, patterns: pd.Series) -> pd.Series:
    known = {p: compile_pattern(p) for p in patterns.unique()}
    return pd.Series([isinstance(v, str) and known[p] is not None and known[p].search(v) is not None for v, p in zip(values, patterns)])


def match_text(kind: Column, value: Column, wanted: Column) -> Column:
    """contains, not_contains, equals, regex on texts; a missing value fails."""
    is_regex = kind == "text.regex"
    # only regex rows travel to Python: the others are null there
    found = regex_found(F.when(is_regex, value), F.when(is_regex, F.coalesce(wanted, F.lit(""))))
    hit = (
        F.when(kind == "text.contains", F.contains(value, wanted)).when(kind == "text.not_contains", ~F.contains(value, wanted))
        .when(kind == "text.equals", value == wanted).when(is_regex, found).otherwise(F.lit(True)))
    return F.coalesce(hit & F.when(kind.startswith("text."), value.isNotNull()).otherwise(F.lit(True)), F.lit(False))


def match_number(op: Column, value: Column, wanted: Column) -> Column:
    """Numeric comparison of texts or numbers; not numeric fails, an unknown operator passes."""
    v, w = value.try_cast("double"), wanted.try_cast("double")
    hit = F.when(op == "gt", v > w).when(op == "gte", v >= w).when(op == "lt", v < w).when(op == "lte", v <= w) \
        .when(op == "eq", v == w).when(op == "ne", v != w).otherwise(F.lit(True))
    return F.coalesce(hit & v.isNotNull() & w.isNotNull(), F.lit(False))


def match_list(kind: Column, values: Column, wanted: Column) -> Column:
    """contains_any (an empty wish passes) and contains_all."""
    have = F.coalesce(values, F.array().cast("array<string>"))
    any_hit = (F.size(wanted) == 0) | F.arrays_overlap(have, wanted)
    all_hit = F.size(F.array_except(wanted, have)) == 0
    return F.coalesce(F.when(kind == "list.contains_any", any_hit).when(kind == "list.contains_all", all_hit).otherwise(F.lit(True)), F.lit(False))


def match_length(op: Column, value: Column, wanted: Column, is_list: bool = False) -> Column:
    """Length comparison as declared (the studied platform skips it and always passes)."""
    n = F.coalesce(F.size(value) if is_list else F.length(value), F.lit(0))
    return match_number(op, n, wanted)


def _scope(rules: str = "r") -> Column:
    """A rule without phase or turn applies to all of them."""
    return (F.col("rule_phase").isNull() | (F.col("rule_phase") == F.col("phase"))) & (F.col("rule_turn").isNull() | (F.col("rule_turn") == F.col("turn")))


def tool_call_rules(rules: DataFrame, calls: DataFrame) -> DataFrame:
    """``rules(rule_id, case_id, tool, min_calls, max_calls, rule_phase, rule_turn)`` against call counts."""
    counted = calls.groupBy("case_id", F.col("tool_name").alias("tool"), "phase", "turn").agg(F.count(F.lit(1)).alias("n"))
    hits = rules.join(counted, ["case_id", "tool"], "left")
    total = F.coalesce(F.sum(F.when(_scope(), F.col("n"))), F.lit(0))
    per = hits.groupBy("rule_id", "case_id").agg(total.alias("calls"), F.first("min_calls").alias("lo"), F.first("max_calls").alias("hi"))
    ok = (F.col("calls") >= F.coalesce("lo", F.lit(0))) & (F.col("hi").isNull() | (F.col("calls") <= F.col("hi")))
    return per.select("rule_id", "case_id", "calls", ok.alias("passed"))


def phase_rules(rules: DataFrame, calls: DataFrame) -> DataFrame:
    """A phase occurred or did not: ``rules(rule_id, case_id, wanted_phase, occurred, rule_turn)``."""
    seen = calls.select("case_id", F.col("phase").alias("wanted_phase"), "turn").distinct()
    hits = rules.join(seen, ["case_id", "wanted_phase"], "left")
    here = F.col("turn").isNotNull() & (F.col("rule_turn").isNull() | (F.col("rule_turn") == F.col("turn")))
    per = hits.groupBy("rule_id", "case_id").agg(F.coalesce(F.bool_or(here), F.lit(False)).alias("fired"), F.first("occurred").alias("occurred"))
    return per.select("rule_id", "case_id", (F.col("fired") == F.col("occurred")).alias("passed"))


def ordering_rules(rules: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool order per case: ``rules(rule_id, case_id, mode, sequence)``, ``calls(case_id, tool_name, started_at, call_id)``.

    ``flexible``: in this order, other calls allowed between; ``strict``: as one
    unbroken run; ``exact``: the whole list of calls.  Calls get their position
    from a spread running count, then everything is keyed aggregation: no
    case's call list is ever gathered.
    """
    numbered = running_total(calls.select("case_id", "tool_name", "started_at", "call_id").withColumn("_one", F.lit(1)),
                             ["case_id"], [F.col("started_at"), F.col("call_id")], "_one", "pos")
    placed = cut_lineage(numbered.select("case_id", "tool_name", "pos"))  # read once per step below
    sizes = placed.groupBy("case_id").agg(F.max("pos").alias("n_calls"))
    wanted = rules.withColumn("n_wanted", F.size("sequence"))
    steps = wanted.select("rule_id", "case_id", "mode", "n_wanted", F.posexplode("sequence").alias("i", "tool_name"))

    # strict and exact: calls that would start a run at the same place, counted per place
    runs = steps.where("mode <> 'flexible'").join(placed, ["case_id", "tool_name"]).withColumn("start", F.col("pos") - F.col("i"))
    full = runs.groupBy("rule_id", "case_id", "start").agg(F.count_distinct("i").alias("k"), F.max("n_wanted").alias("n"), F.max("mode").alias("mode"))
    full = full.where("k = n").join(sizes, "case_id").where("mode = 'strict' OR (start = 1 AND n_calls = n)").select("rule_id").distinct()

    # flexible: the earliest place of each step after the place of the step before
    at = wanted.where("mode = 'flexible'").select("rule_id", "case_id", "n_wanted", F.lit(0).cast("bigint").alias("at"))
    longest = wanted.where("mode = 'flexible'").agg(F.max("n_wanted")).first()[0] or 0
    done = [at.where("n_wanted = 0").select("rule_id")]
    for i in range(longest):
        step = steps.where((F.col("i") == i) & (F.col("mode") == "flexible")).select("rule_id", "tool_name")
        nxt = at.join(step, "rule_id").join(placed, ["case_id", "tool_name"]).where(F.col("pos") > F.col("at"))
        at = nxt.groupBy("rule_id", "case_id", "n_wanted").agg(F.min("pos").alias("at"))
        done.append(at.where(F.col("n_wanted") == i + 1).select("rule_id"))
    for d in done:
        full = full.unionByName(d)
    passed = full.distinct().withColumn("_ok", F.lit(True))
    return rules.select("rule_id", "case_id", "mode").join(passed, "rule_id", "left").select(
        "rule_id", "case_id", "mode", F.coalesce("_ok", F.lit(False)).alias("passed"))


def rule_totals(verdicts: DataFrame) -> DataFrame:
    """Passed, failed and skipped per case; a case passes when nothing failed (``passed`` null is skipped)."""
    failed = F.count_if(~F.col("passed"))
    return verdicts.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), failed.alias("failed"),
        F.count_if(F.col("passed").isNull()).alias("skipped"), F.when(failed == 0, "pass").otherwise("fail").alias("status"))
