"""Token totals and prices.  Every rule here is per row: apply before any sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COST_TYPE = "decimal(18,6)"


def total_tokens(provider: Column, prompt: Column, completion: Column, read: Column, write: Column) -> Column:
    """Cache tokens are added only for the provider that reports them separately."""
    zero = [F.coalesce(c, F.lit(0)) for c in (prompt, completion, read, write)]
    return F.when(provider == "anthropic", zero[0] + zero[1] + zero[2] + zero[3]).otherwise(zero[0] + zero[1])


def input_cost(provider: Column, rate: Column, prompt: Column, read: Column, write: Column) -> Column:
    # Cache multipliers of the input rate, per provider.
    extra = (
        F.when(provider == "anthropic", read * 0.1 + write * 1.25)
        .when(provider.isin("openai", "azure"), read * -0.5)
        .when(provider == "google", read * -0.75 + write * 1.0)
        .otherwise(F.lit(0.0))
    )
    price = (F.coalesce(prompt, F.lit(0)) + F.coalesce(extra, F.lit(0.0))) / 1e6 * rate
    return F.coalesce(F.greatest(price, F.lit(0.0)), F.lit(0.0)).cast(COST_TYPE)


def output_cost(rate: Column, tokens: Column) -> Column:
    return F.coalesce(tokens / 1e6 * rate, F.lit(0.0)).cast(COST_TYPE)


def is_estimated(provider: Column) -> Column:
    p = F.lower(F.coalesce(provider, F.lit("")))
    return p.isin("custom", "azure", "bedrock") | p.startswith("bedrock")
