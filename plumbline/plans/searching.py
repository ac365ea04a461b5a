"""Queries for indexed search (FLT, RNK): the rows of the scans, through stored trigrams."""

from pyspark.sql import functions as F

from ..operators import postings, search
from ..session import shared_dir
from .registry import query


def _index(t, items, key, columns):
    return postings.build(items, key, columns, shared_dir(t.spark, "text-index"), parts=16)


@query("f_multi_search_indexed", like="f_multi_search")
def f_multi_search_indexed(t):
    index = _index(t, t("v_guidance"), "item_id", ["text", "category", "item_id"])
    out = search.multi_search(index, ["then\\s+and", "retition", "broken("], ["text", "category", "item_id"], "item_id", 40)
    return out.select("item_id", "category", "total")


@query("f_ilike_recent_indexed", like="f_ilike_recent")
def f_ilike_recent_indexed(t):
    index = _index(t, t("v_reports"), "report_id", ["title"])
    return search.ilike_recent(index, "urgent REPORT 1", ["title"], "created_at", "report_id", 25).select("report_id", "title")


@query("guidance_search_indexed", like="guidance_search")
def guidance_search_indexed(t):
    index = _index(t, t("v_guidance"), "item_id", ["text"])
    return search.guidance_search(index, "reading then heron tion", 100, [f"src{i}" for i in range(1, 7)])


@query("related_indexed", like="related")
def related_indexed(t):
    index = _index(t, t("documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id", ["text"])
    sem = t("documents").where("lang = 'en'").select(F.col("doc_id").alias("item_id"), ((F.col("doc_id") % 10) / 10).alias("semantic"))
    return search.related(index, ["heron", "then"], 3, 60, sem)
