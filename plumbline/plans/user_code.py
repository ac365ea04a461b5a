"""Queries for the user-function surface (UDF)."""

from pyspark.sql import functions as F

from ..functions import user_code
from ..session import shared_dir
from ..sources import snapshots
from .registry import query


@query("generate_df", """SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1""")
def generate_df(t):
    def build(views):
        rows = views["customer"].where("c_acctbal > 0").join(views["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("balance"))

    return user_code.generate_df(build, t.spark, {n: t(n) for n in ("customer", "nation")})


@query("load_step", """SELECT o_custkey, n, rank() OVER (ORDER BY n DESC, o_custkey) AS place FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) QUALIFY place <= 25""")
def load_step(t):
    """A function reading a saved step; an unknown name lists what is available."""
    saved = snapshots.snapshot_write(t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), shared_dir(t.spark, "step"))

    def build(load_step, load_entity):
        try:
            load_entity("Nothing")
        except user_code.MissingResult as miss:
            assert "Top Model" in str(miss)
        return load_step("orders per CUSTOMER").orderBy(F.desc("n"), "o_custkey").limit(25)

    top = user_code.generate_df(build, t.spark, {}, steps={"Orders per customer": saved}, entities={"Top Model": saved})
    from pyspark.sql import Window as W
    return top.withColumn("place", F.rank().over(W.orderBy(F.desc("n"), "o_custkey")).cast("bigint"))


@query("load_entity", "SELECT p_brand, count(*) AS parts FROM part GROUP BY 1")
def load_entity(t):
    saved = snapshots.snapshot_write(t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts")), shared_dir(t.spark, "entity"))
    return user_code.generate_df(lambda load_entity: load_entity("brand model"), t.spark, {}, entities={"Brand Model": saved})
