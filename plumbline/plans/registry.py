"""Registry of queries and the table loader they share.

A query is a function of :class:`Tables`.  Its oracle is DuckDB SQL over the
same parquet tables; names starting with ``v_`` are the virtual tables of
``virtual.VIEWS``, which both engines derive from the same text.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .virtual import BASE_TABLES, VIEWS

_BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
FAMILIES = (
    "sources", "reuse", "predicates", "linking", "usage", "ordering", "catalog", "profiling",
    "charting", "texts", "relevance", "checks", "incremental", "user_code", "searching",
)


class Tables:
    """Lazily read tables: ``t("orders")`` or a virtual one, ``t("v_reports")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in VIEWS:
                self._frames[name] = self.sql(VIEWS[name])
            else:
                self._frames[name] = self.spark.read.parquet(self.path(name))
        return self._frames[name]

    def sql(self, template: str) -> DataFrame:
        needed = set(re.findall(r"\{(\w+)\}", template))
        return self.spark.sql(template, **{n: self(n) for n in needed})


def query(name: str, oracle: str | None = None, like: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under the survey key ``name``.

    ``like``: a query, registered before, that must give the same rows.
    """

    def keep(fn):
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = fn
        if oracle or like:
            _ORACLES[name] = with_views(oracle) if oracle else _ORACLES[like]
        return fn

    return keep


def _view_closure(names: set[str], done: list[str]) -> list[str]:
    for n in sorted(names):
        if n in VIEWS and n not in done:
            _view_closure(set(re.findall(r"\{(\w+)\}", VIEWS[n])), done)
            done.append(n)
    return done


def with_views(sql: str) -> str:
    """Prefix ``sql`` with a CTE for each virtual table it mentions."""
    views = _view_closure(set(re.findall(r"\bv_\w+", sql)), [])
    body = sql.strip()
    if not views:
        return body
    ctes = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n]).strip()})" for n in views)
    m = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"


class _Loaded:
    @cached_property
    def ready(self) -> bool:
        for family in FAMILIES:
            importlib.import_module(f"{__package__}.{family}")
        return True


_LOADED = _Loaded()


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    assert _LOADED.ready
    return {n: (lambda spark, sf_dir, fn=fn: fn(Tables(spark, sf_dir))) for n, fn in _BUILDERS.items()}


def oracles() -> dict[str, str]:
    assert _LOADED.ready
    return dict(_ORACLES)


__all__ = ["BASE_TABLES", "Tables", "builders", "oracles", "query", "with_views"]
