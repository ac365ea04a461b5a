"""Catalog snapshots: signatures, drift, sync, upserts, selection and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranges import ts
from .joins import full_diff


def schema_signature(columns: DataFrame, key: str = "table_name") -> DataFrame:
    """Order-independent signature: hash of the sorted (name, dtype) pairs of a table."""
    pairs = F.array_sort(F.collect_list(F.struct("col_name", "dtype")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["col_name"], p["dtype"])), ",")
    return columns.groupBy(key).agg(F.sha2(text, 256).alias("signature"), F.count(F.lit(1)).alias("n_columns"))


def schema_drift(old: DataFrame, new: DataFrame, key: str = "table_name") -> DataFrame:
    """Names whose signature differs between two column snapshots; none for an empty old one."""
    # one row of the old side tells whether there is any
    populated = old.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    return full_diff(schema_signature(old, key), schema_signature(new, key), key, "signature").where(populated).orderBy(key)


def catalog_sync(existing: DataFrame, incoming: DataFrame, activate_new: bool) -> DataFrame:
    """New snapshot of a catalog after a connection refresh.

    ``existing(row_id, link_id, name, is_active, signature)`` and
    ``incoming(table_id, name, signature)``.  Linked rows are refreshed and keep
    ``is_active``; an unlinked row of the same name is adopted, further ones are
    folded into the kept row; missing tables are switched off; the rest is new.
    """
    linked = existing.where("link_id IS NOT NULL")
    loose = existing.where("link_id IS NULL")
    first = F.min_by(F.struct("row_id", "is_active"), "row_id")
    pool = loose.groupBy("name").agg(first.alias("first"), F.bool_or("is_active").alias("any_active"))
    inc = incoming.select(F.col("table_id").alias("link_id"), F.col("name").alias("in_name"), F.col("signature").alias("in_signature"))
    both = linked.join(inc, "link_id", "full_outer").withColumn("name", F.coalesce("in_name", "name"))
    rows = both.join(pool, "name", "left")
    old, fresh, loose_hit = F.col("row_id").isNotNull(), F.col("in_name").isNotNull(), F.col("first").isNotNull()
    action = F.when(old & fresh, "refreshed").when(old, "missing").when(loose_hit, "adopted").otherwise("inserted")
    active = (
        F.when(old & fresh, F.col("is_active") | F.coalesce("any_active", F.lit(False))).when(old, F.lit(False))
        .when(loose_hit, F.col("any_active")).otherwise(F.lit(activate_new))
    )
    synced = rows.select(
        F.coalesce("row_id", "first.row_id").alias("row_id"), "link_id", "name", active.alias("is_active"),
        F.coalesce("in_signature", "signature").alias("signature"), action.alias("action"))
    kept = loose.join(rows.select("name").distinct(), "name", "left_anti").select(
        "row_id", "link_id", "name", "is_active", "signature", F.lit("kept").alias("action"))
    return synced.unionByName(kept)


def resource_upsert(old: DataFrame, new: DataFrame, now: Column, activate_new: bool = True) -> DataFrame:
    """Upsert by (name, type, org): new content wins, the user's ``is_active`` stays."""
    keys = ["name", "type", "org_id"]
    o = old.select(*keys, F.col("content").alias("_oc"), F.col("is_active").alias("_oa"), F.col("synced_at").alias("_os"))
    n = new.where("name <> ''").select(*keys, F.col("content").alias("_nc"), F.lit(True).alias("_new"))
    hit = F.col("_new").isNotNull()
    return o.join(n, keys, "full_outer").select(
        *keys, F.when(hit, F.col("_nc")).otherwise(F.col("_oc")).alias("content"),
        F.coalesce("_oa", F.lit(activate_new)).alias("is_active"),
        F.when(hit, now).otherwise(F.col("_os")).alias("synced_at"))


def ds_overlap(items: DataFrame, column: str, wanted: list) -> DataFrame:
    return items.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted])))


def stratified_pick(catalog: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` tables spread over schemas in proportion, widest tables first.

    Ranks are cut at ``k`` before the per-schema allocation applies, so a schema
    with a third of the tables is pruned inside each task.
    """
    schema = F.when(F.instr("table_name", ".") > 0, F.split("table_name", "\\.")[0]).otherwise("__default__")
    tables = catalog.withColumn("schema_name", schema)
    total = tables.agg(F.count(F.lit(1))).scalar()
    share = tables.groupBy("schema_name").agg(F.count(F.lit(1)).alias("n"))
    alloc = share.select("schema_name", F.greatest(F.lit(1), F.round(F.col("n") / total * k).cast("int")).alias("allocation"))
    rank = F.row_number().over(W.partitionBy("schema_name").orderBy(F.desc("n_columns"), "table_name"))
    ranked = tables.withColumn("rank_in_schema", rank).where(F.col("rank_in_schema") <= k)
    picked = ranked.join(alloc, "schema_name").where("rank_in_schema <= allocation")
    return picked.orderBy(F.desc("n_columns"), "table_name").limit(k)


def retention_purge(steps: DataFrame, cutoffs: DataFrame, default_days: int, now: dt.datetime, payloads: list[str]) -> DataFrame:
    """Null the payloads of superseded or stale steps; other rows pass unchanged.

    The newest successful step per query comes from a map-side aggregate and is
    matched back on the step id, so a query with a third of the steps needs no
    per-query sort.
    """
    ok = steps.where("status = 'success'")
    newest = ok.where("query_id IS NOT NULL").groupBy("query_id").agg(
        F.max_by("step_id", F.struct("updated_at", "step_id")).alias("step_id")).select("step_id", F.lit(True).alias("_newest"))
    days = F.coalesce("retention_days", F.lit(default_days))
    cutoff = ts(now).cast("timestamp") - F.make_interval(days=days)
    rows = steps.join(newest, "step_id", "left").join(cutoffs, "org_id", "left")
    stale = (F.col("created_at").cast("timestamp") < cutoff) & (F.col("updated_at").cast("timestamp") < cutoff)
    superseded = F.col("query_id").isNotNull() & F.col("_newest").isNull()
    free = ~F.coalesce("shared", F.lit(False)) & ~F.col("parent_status").eqNullSafe("published")
    some = F.greatest(*[F.col(p).isNotNull() for p in payloads]) if len(payloads) > 1 else F.col(payloads[0]).isNotNull()
    purge = F.coalesce((F.col("status") == "success") & (superseded | stale) & free & some, F.lit(False))
    out = rows.withColumn("purged", purge)
    return out.withColumns({p: F.when(~F.col("purged"), F.col(p)) for p in payloads}).drop("_newest", "retention_days")
