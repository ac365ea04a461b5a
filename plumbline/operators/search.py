"""The searches over texts, by way of a trigram index instead of a scan.

Each takes a :class:`~plumbline.operators.postings.TextIndex` where its namesake
takes a frame, narrows it to the rows that can match, and runs the namesake on
those: same rows, same order, same totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from . import filters, ranking
from .postings import TextIndex, alternatives, needed


def multi_search(index: TextIndex, queries: list[str], columns: list[str], order: str, limit: int) -> DataFrame:
    """As ``filters.multi_search``; ``columns`` must be among those indexed."""
    wanted: list[list[str]] | None = []
    for q in queries:
        if not filters.is_pattern(q):
            wanted.append([q])
        elif q not in filters.invalid_regexes([q]):
            found = alternatives(q)
            if found is None:
                wanted = None
                break
            wanted += found
    rows = index.narrow(needed(wanted)).rows if wanted or wanted is None else index.table().where("false")
    return filters.multi_search(rows, queries, columns, order, limit)


def ilike_recent(index: TextIndex, q: str, columns: list[str], newest: str, key: str, limit: int) -> DataFrame:
    return filters.ilike_recent(index.containing([q]).rows, q, columns, newest, key, limit)


def guidance_search(index: TextIndex, query: str, limit: int, categories: list[str] | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """As ``ranking.guidance_search``: always-on items are read by their mode, the rest by the question's words.

    An item that only its semantic score lifts above zero is read by its key.
    """
    words = sim.query_words(query)
    lifted = None if semantic is None else semantic.where("semantic > 0").select(index.key)
    found = index.containing(words, lifted)
    rows = found.rows
    if found.indexed:
        always = F.col("load_mode") == "always"
        rows = rows.where(~F.coalesce(always, F.lit(False))).unionByName(index.table().where(always))
    return ranking.guidance_search(rows, query, limit, categories, semantic)


def related(index: TextIndex, words: list[str], exclude, limit: int, semantic: DataFrame | None = None) -> DataFrame:
    """As ``ranking.related``: an item must hold a word, so the words' grams find it."""
    return ranking.related(index.containing(words).rows, words, exclude, limit, semantic)
