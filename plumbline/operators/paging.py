"""Sort, limit and pages.  Every order ends in a unique tie-break; totals are scalar subqueries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ranges import within
from .activity import head_prompts, latest_per_key


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page with total, total_pages and has_more."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)
    return rows.withColumns({
        "total_pages": F.ceil(F.col("total") / size), "has_more": F.col("total") > F.lit(number * size)})


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, size: int) -> DataFrame:
    """The rows that follow the one with the order values ``after`` (None: the first page).

    ``order`` names columns without nulls, and whether each falls; together
    they are unique.  However deep the page, only ``size`` rows leave each
    task, which an offset cannot do.
    """
    rows = df
    if after is not None:
        later, same = F.lit(False), F.lit(True)
        for (name, falls), value in zip(order, after, strict=True):
            c = F.col(name)
            later = later | (same & ((c < F.lit(value)) if falls else (c > F.lit(value))))
            same = same & (c == F.lit(value))
        rows = rows.where(later)
    return rows.orderBy(*[F.desc(n) if falls else F.asc(n) for n, falls in order]).limit(size)


def sort_order(column: str, direction: str, tie: str) -> list[Column]:
    first = F.desc_nulls_last(column) if direction == "desc" else F.asc_nulls_first(column)
    return [first, F.asc(tie)]


def facets(catalog: DataFrame) -> DataFrame:
    """Distinct schema filters, prefixed by the connection when there are several."""
    pairs = catalog.select("connection", F.split("table_name", "\\.")[0].alias("schema")).distinct()
    several = pairs.agg(F.count_distinct("connection") > 1).scalar()
    label = F.when(several, F.concat_ws(":", "connection", "schema")).otherwise(F.col("schema"))
    return pairs.select("connection", "schema", label.alias("facet"))


def issues(messages, failed_calls, feedback, users, start, end, kind: str = "all", number: int = 1, size: int = 50, cut: int | None = None, pager=page) -> DataFrame:
    """Messages with an issue: a failed tool first, else a negative verdict; paged, newest first.

    ``kind="all_queries"`` lists the others too, summed up by their own first line.
    ``pager`` makes the page: ``page`` by offset, ``rankmap.pager(...)`` by rank.
    """
    first_fail = latest_per_key(failed_calls, "execution_id", [F.desc("attempt"), F.desc("started_at"), F.desc("call_id")]) \
        .select("execution_id", "tool_name", "error_text", F.lit(True).alias("_failed"))
    negative = latest_per_key(feedback.where("direction = -1"), "message_id", [F.desc("created_at"), F.desc("feedback_id")]) \
        .select("message_id", "note", F.lit(True).alias("_neg"))
    base = messages.where(within("created_at", start, end)).withColumn("execution_id", F.floor(F.col("message_id") / 5))
    rows = base.join(first_fail, "execution_id", "left").join(negative, "message_id", "left") \
        .join(users, "user_id", "left").join(head_prompts(messages, cut), "report_id", "left")
    flagged = F.coalesce(F.col("_failed"), F.col("_neg"), F.lit(False))
    rows = rows if kind == "all_queries" else rows.where(flagged)
    full = F.when(F.col("_failed"), F.coalesce("error_text", F.lit(""))).otherwise(F.coalesce("note", F.lit("")))
    summary = F.when(full == "", F.when(F.col("_failed"), "Error").otherwise("Negative feedback")).otherwise(text.first_line(full))
    own = text.clip(text.first_line(F.trim(text.json_text("prompt"))), cut)
    own = F.when(own == "", F.concat(F.initcap("role"), F.lit(" Completion"))).otherwise(own)
    issue = F.when(F.col("_failed"), "tool_error").when(F.col("_neg"), "negative_feedback").otherwise("no_issue")
    out = rows.select(
        "message_id", "created_at", issue.alias("issue_type"), F.when(flagged, summary).otherwise(own).alias("summary"),
        F.coalesce("head_prompt", F.lit("")).alias("head_prompt"), F.when(F.col("_failed"), F.col("tool_name")).alias("tool_name"),
        F.coalesce("user_name", F.lit("Unknown User")).alias("user_name"))
    out = out if kind in ("all", "all_queries") else out.where(F.col("issue_type") == kind)
    return pager(out, [F.desc("created_at"), F.desc("message_id")], number, size)


def sort_tables(catalog: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Catalog order by score, usage, centrality (in + out + score) or name."""
    order = {
        "score": [F.desc("score"), "table_name"], "usage": [F.desc_nulls_last("uses"), "table_name"],
        "centrality": [F.desc(F.col("in_degree") + F.col("out_degree") + F.col("centrality")), "table_name"], "name": ["table_name"],
    }[by]
    out = catalog.orderBy(*order)
    return out.limit(n) if n else out


def view_table(df: DataFrame, view: dict, tie: str) -> DataFrame:
    """Table view: chosen columns, sort and page size (50 unless given)."""
    by, direction = view.get("sortBy"), view.get("sortOrder", "asc")
    order = sort_order(by, direction, tie) if by else [F.asc(tie)]
    return df.orderBy(*order).limit(view.get("pageSize") or 50).select(*view["columns"])


def audit_page(log: DataFrame, *, actions=None, resource=None, user=None, start=None, end=None, search=None, number=1, size=50, pager=page) -> DataFrame:
    conds = []
    if actions:
        conds.append(F.col("action").isin(*actions))
    if resource:
        conds.append(F.col("resource") == resource)
    if user is not None:
        conds.append(F.col("user_id") == user)
    if start or end:
        conds.append(within("created_at", start, end))
    if search:
        like = f"%{search}%"
        conds.append(F.ilike("action", F.lit(like)) | F.ilike("resource", F.lit(like)))
    hits = log.where(reduce(lambda a, b: a & b, conds)) if conds else log
    return pager(hits, [F.desc("created_at"), F.desc("log_id")], number, size)


def starred_first(df: DataFrame, flag: str, newest: str, key: str, offset: int, n: int) -> DataFrame:
    return df.orderBy(F.desc(flag), F.desc(newest), key).offset(offset).limit(n)
