"""Connected components of a table of links, by alternating star contractions; every step is a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours get the least of the node and its neighbours."""
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable. Only nodes with a link to another node get a row."""
    e = common.cut(links.where(f"{a} <> {b}").select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).distinct(), "links")
    sign = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    before = None
    for _ in range(most):
        e = common.cut(_small_star(_large_star(e)), "stars", [e])  # the round before is read no more
        if (now := sign(e)) == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
