"""User functions that build a DataFrame from named views and saved results."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class MissingResult(LookupError):
    pass


def loaders(steps: dict[str, DataFrame], entities: dict[str, DataFrame]) -> dict[str, Callable[[str], DataFrame]]:
    """``load_step`` and ``load_entity``; a miss names what there is."""
    def loader(kind: str, have: dict[str, DataFrame]):
        names = {k.lower(): v for k, v in have.items()}

        def load(ref: str) -> DataFrame:
            if ref.lower() not in names:
                raise MissingResult(f"{kind}({ref!r}): not found; available: {sorted(have)}")
            return names[ref.lower()]

        return load

    return {"load_step": loader("load_step", steps), "load_entity": loader("load_entity", entities)}


def generate_df(fn: Callable, spark: SparkSession, views: dict[str, DataFrame], *, steps: dict[str, DataFrame] | None = None,
                entities: dict[str, DataFrame] | None = None) -> DataFrame:
    """Call a user function with what its parameter names ask for and check its result.

    Known parameters: ``spark``, ``views``, ``load_step``, ``load_entity``.  The
    result must be a DataFrame with at least one column; it stays lazy.
    """
    offered = {"spark": spark, "views": views, **loaders(steps or {}, entities or {})}
    wanted = inspect.signature(fn).parameters
    unknown = [n for n, p in wanted.items() if n not in offered and p.default is inspect.Parameter.empty]
    if unknown:
        raise TypeError(f"unknown parameters {unknown}; offered: {sorted(offered)}")
    out = fn(**{n: offered[n] for n in wanted if n in offered})
    if not isinstance(out, DataFrame):
        raise TypeError(f"the function must return a DataFrame, not {type(out).__name__}")
    if not out.columns:
        raise ValueError("the result has no columns")
    return out
