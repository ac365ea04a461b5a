"""Relevance: scores of tables, code snippets, guidance and prompts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.ranges import ts
from ..functions.text import content_hash, error_summary
from ..session import spread_small

SEMANTIC_WEIGHT = 0.35


def table_score(tables: DataFrame, stats: DataFrame, now: dt.datetime, on: list[str]) -> DataFrame:
    """Usage, success, verdicts and structure in one score, best first.

    ``stats`` carries the usage and verdict counters; tables without any get a
    tenth of their structural signal.
    """
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    rows = tables.join(stats.withColumn("_has", F.lit(True)), on, "left")
    structure = c("centrality") + c("richness") + F.when(F.col("entity_like"), 0.5).otherwise(0.0)
    rate = F.when(c("usage") > 0, c("successes") / F.greatest(F.lit(1.0), c("usage"))).otherwise(0.0)
    fresh = sim.recency(ts(now), "last_used_at", missing_days=365.0)
    full = (0.35 * (F.sqrt(c("weighted_usage")) * fresh) + 0.25 * rate + 0.2 * (c("weighted_positive") - c("weighted_negative"))
            + 0.2 * structure - 0.2 * F.sqrt(c("failures")))
    return rows.withColumns({"success_rate": F.round(rate, 4), "score": F.round(F.when(F.col("_has"), full).otherwise(0.1 * structure), 6)}).drop("_has")


def _candidates(usage: DataFrame, steps: DataFrame, n: int | None) -> DataFrame:
    """The used steps with a given state; only the ``n`` most recent ones if a number is asked for."""
    rows = usage.join(steps, "step_id")
    return rows if n is None else rows.orderBy(F.desc("last_used_at"), "step_id").limit(n)


def _verdicts(rows: DataFrame, feedback: DataFrame) -> DataFrame:
    per = feedback.groupBy("step_id").agg(F.count_if(F.col("direction") > 0).alias("positive"), F.count_if(F.col("direction") < 0).alias("negative"))
    return rows.join(per, "step_id", "left").fillna(0, ["positive", "negative"])


def _similarity(column: Column, semantic: Column, weight: float) -> Column:
    return F.coalesce(SEMANTIC_WEIGHT * semantic + (weight - SEMANTIC_WEIGHT) * column, weight * column)


def snippet_success(usage, steps, feedback, target: list[str], now: dt.datetime, semantic: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Successful snippets for a set of wanted columns.

    ``usage`` are per-step counters, ``steps(step_id, columns)`` the successful ones.
    """
    rows = _with_semantic(_verdicts(_candidates(usage, steps, n), feedback), semantic)
    col = sim.jaccard(F.array(*[F.lit(t) for t in target]), F.array_distinct("columns"))
    rate = F.when(F.col("attempts") > 0, F.col("successes") / F.col("attempts")).otherwise(0.0)
    score = (_similarity(col, F.col("semantic"), 0.55) + 0.20 * rate + 0.20 * (F.col("positive") - F.col("negative"))
             + 0.05 * sim.recency(ts(now), "last_used_at"))
    return rows.select("step_id", F.round(score, 6).alias("score"), F.round(col, 6).alias("column_similarity"), "positive", "negative", F.round(rate, 4).alias("success_rate"))


def snippet_failed(usage, steps, feedback, target: list[str], now: dt.datetime, semantic: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Failed snippets worth showing as warnings; ``steps(step_id, columns, error_text)``."""
    rows = _with_semantic(_verdicts(_candidates(usage, steps, n), feedback), semantic)
    col = sim.jaccard(F.array(*[F.lit(t) for t in target]), F.array_distinct("columns"))
    rate = F.round(F.when(F.col("attempts") > 0, F.col("failures") / F.col("attempts")).otherwise(0.0), 4)
    penalty = F.greatest(F.lit(0), F.col("positive") - F.col("negative"))
    score = (_similarity(col, F.col("semantic"), 0.60) + 0.20 * sim.recency(ts(now), "last_used_at")
             + 0.20 * (0.5 * F.col("negative") + 0.5 * rate) - 0.05 * penalty)
    return rows.select("step_id", F.round(score, 6).alias("score"), error_summary("error_text").alias("error_summary"), rate.alias("failure_rate"))


def snippet_by_table(usage, steps, feedback, now: dt.datetime, n: int | None = None) -> DataFrame:
    """Successful snippets of the wanted tables; ``usage`` is already cut to their events."""
    rows = _verdicts(_candidates(usage, steps, n), feedback)
    rate = F.when(F.col("attempts") > 0, F.col("successes") / F.col("attempts")).otherwise(0.0)
    score = 0.55 * rate + 0.35 * sim.recency(ts(now), "last_used_at") + 0.10 * (F.col("positive") - F.col("negative"))
    return rows.select("step_id", F.round(score, 6).alias("score"), F.round(rate, 4).alias("success_rate"))


def _with_semantic(rows: DataFrame, semantic: DataFrame | None) -> DataFrame:
    if semantic is None:
        return rows.withColumn("semantic", F.lit(None).cast("double"))
    return rows.join(semantic.select("step_id", "semantic"), "step_id", "left")


def guidance_search(items: DataFrame, query: str, limit: int, categories: list[str] | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """Guidance for a question: always-on items first, scored ones in the remaining slots.

    A query keeps positive scores only; without one every item fills at 0.
    """
    rows = items.where(F.col("category").isin(*categories)) if categories else items
    always = F.col("load_mode") == "always"
    rows = spread_small(rows)
    score = sim.keyword_score("text", sim.query_words(query))
    if semantic is not None:
        rows = rows.join(semantic.select("item_id", "semantic"), "item_id", "left")
        score = sim.blend(score, F.col("semantic"))
    rows = rows.withColumn("score", F.when(always, F.lit(0.0)).otherwise(F.round(score, 9) if (query or "").strip() else F.lit(0.0)))
    if (query or "").strip():
        rows = rows.where(always | (F.col("score") > 0))
    first = rows.where(always)
    taken = first.agg(F.count(F.lit(1))).scalar()
    # at most `limit` scored rows can be wanted, so the top is cut before slots are counted
    top = rows.where(~always).orderBy(F.desc("score"), "item_id").limit(limit)
    place = F.row_number().over(_by_score())
    rest = top.withColumn("_p", place).where(F.col("_p") <= F.lit(limit) - taken).drop("_p")
    keep = [c for c in rows.columns if c != "text"]
    return first.select(*keep).unionByName(rest.select(*keep))


def _by_score():
    from pyspark.sql import Window as W

    return W.orderBy(F.desc("score"), "item_id")


def changed_only(items: DataFrame, index: DataFrame, key: str = "item_id") -> DataFrame:
    """Which texts need a new vector: new or changed hash; the rest keep theirs."""
    hashed = items.withColumn("hash", content_hash("text"))
    known = index.select(key, F.col("hash").alias("_stored"))
    return hashed.join(known, key, "left").withColumn(
        "action", F.when(F.col("_stored").isNull(), "new").when(F.col("_stored") != F.col("hash"), "changed").otherwise("kept")).drop("_stored")


def index_texts(items: DataFrame, index: DataFrame, embed, key: str = "item_id") -> DataFrame:
    """New index: vectors of changed texts from ``embed`` (a Pandas UDF), kept ones untouched."""
    todo = changed_only(items, index, key).where("action <> 'kept'")
    fresh = todo.select(key, "hash", embed("text").alias("embedding"))
    return index.select(key, "hash", "embedding").join(fresh.select(key), key, "left_anti").unionByName(fresh)


def mention_order(tables: DataFrame, stats: DataFrame, on: str) -> DataFrame:
    return tables.join(stats, on, "left").fillna(0, ["uses"]).orderBy(F.desc("uses"), on)


def impact(prompts: DataFrame, text: str, words: list[str], newest: str, key: str, scan: int | None = None, samples: int = 5) -> DataFrame:
    """Share of prompts holding any word, with the newest matching samples; of the ``scan`` newest only, if asked for.

    Counts are partial sums and the samples a top-k, so nothing is gathered.
    """
    recent = prompts if scan is None else prompts.orderBy(F.desc(newest), F.desc(key)).limit(scan)
    low = F.lower(text)
    hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    flagged = recent.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(newest).alias("_t"), F.col(key).alias("_k"), hit.alias("_hit"))
    total = F.count(F.lit(1))
    score = F.when(total > 0, F.least(F.lit(1.0), F.count_if("_hit") / total)).otherwise(0.0)
    counts = flagged.agg(F.round(score, 4).alias("score"), F.count_if("_hit").alias("matched"), total.alias("total"))
    top = flagged.where("_hit").orderBy(F.desc("_t"), F.desc("_k")).limit(samples)
    picks = top.agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_t", "_k")))), lambda s: s["_k"]).alias("samples"))
    return counts.withColumn("samples", picks.scalar())


def related(items: DataFrame, words: list[str], exclude, limit: int, semantic: DataFrame | None = None) -> DataFrame:
    """Items holding any query token, ranked by token overlap, blended with a semantic score if given."""
    low = F.lower(F.coalesce("text", F.lit("")))
    mine = F.array(*[F.lit(w) for w in words])
    rows = spread_small(items).where(F.exists(mine, lambda w: F.contains(low, w)))
    rows = rows if exclude is None else rows.where(F.col("item_id") != exclude)
    rows = rows.withColumn("_words", sim.tokens("text"))  # split once, used twice
    score = sim.jaccard(mine, F.col("_words"))
    if semantic is not None:
        rows = rows.join(semantic, "item_id", "left")
        score = 0.5 * score + 0.5 * F.coalesce("semantic", F.lit(0.0))
    return rows.select("item_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "item_id").limit(limit)
