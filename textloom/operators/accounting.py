"""Key joins, compaction of read conversations, and usage roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def key_edges(nodes: DataFrame, name: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(key nodes, has edges): each match of pattern in a node id that two nodes or more hold. Recomputed whole at each run."""
    owner = f"~key:{name}"
    ids = nodes.where(~F.startswith("connector", F.lit("~"))).select("id")
    held = ids.select("id", F.explode(F.array_distinct(F.regexp_extract_all("id", F.lit(pattern), F.lit(0)))).alias("match")).where("match <> ''")
    shared = held.groupBy("match").agg(F.count("*").alias("holders")).where("holders >= 2")
    key_id = F.concat(F.lit(f"{name}:"), F.col("match"))
    foreign = nodes.where(F.col("connector") != owner).select(F.col("id").alias("key_id"))
    made = shared.select(key_id.alias("key_id"), "match", "holders").join(foreign, "key_id", "left_anti")
    edges = held.join(made, "match").select(F.col("key_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("has").alias("kind"), F.lit(1.0).alias("weight"), F.lit(owner).alias("connector"))
    return made.select(F.col("key_id").alias("id"), F.lit(name).alias("kind"), "holders", F.lit(owner).alias("connector")), edges


def compactable(nodes: DataFrame, edges: DataFrame, kinds: list[str], cutoff: Column, read: DataFrame) -> DataFrame:
    """(container): containers whose every member of kinds, in by an edge of kind in, is dated, at cutoff or before, and read (id)."""
    member = edges.where("kind = 'in'").select(F.col("from_id").alias("id"), F.col("to_id").alias("container")).join(nodes.where(F.col("kind").isin(kinds)).select("id", "at"), "id")
    member = member.join(nodes.select(F.col("id").alias("container")), "container", "left_semi").select("id", "container", "at")
    seen = member.join(read.select("id", F.lit(True).alias("was_read")), "id", "left")
    ok = F.col("at").isNotNull() & F.coalesce(F.col("at") <= cutoff, F.lit(False)) & F.coalesce("was_read", F.lit(False))
    return seen.groupBy("container").agg(F.bool_and(ok).alias("all_ok")).where("all_ok").select("container")


def compacted_members(nodes: DataFrame, edges: DataFrame, kinds: list[str], containers: DataFrame) -> DataFrame:
    """(id, container): a member of several containers goes to the least."""
    member = edges.where("kind = 'in'").select(F.col("from_id").alias("id"), F.col("to_id").alias("container")).join(containers, "container", "left_semi")
    return member.join(nodes.where(F.col("kind").isin(kinds)).select("id"), "id", "left_semi").groupBy("id").agg(F.min("container").alias("container"))


def repointed(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """Edges with compacted ends at their containers: equal ones add up, those within a container go; the first in key order keeps its owner."""
    a = homes.select(F.col("id").alias("from_id"), F.col("container").alias("a"))
    b = homes.select(F.col("id").alias("to_id"), F.col("container").alias("b"))
    moved = edges.join(a, "from_id", "left").join(b, "to_id", "left").withColumns({"f": F.coalesce("a", "from_id"), "t": F.coalesce("b", "to_id")})
    kept = moved.where("not (f = t and (a is not null or b is not null))")
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    first = F.min_by("connector", F.struct("from_id", "to_id", "kind"))
    touched = F.bool_or(F.col("a").isNotNull() | F.col("b").isNotNull())
    return kept.groupBy(F.col("f").alias("from_id"), F.col("t").alias("to_id"), "kind").agg(F.when(touched, F.sum(weight)).otherwise(F.max("weight")).alias("weight"), first.alias("connector"))


def compact(nodes: DataFrame, edges: DataFrame, kinds: list[str], cutoff: Column, read: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, tombstones (id, connector)) after compaction."""
    homes = compacted_members(nodes, edges, kinds, compactable(nodes, edges, kinds, cutoff, read))
    dead = nodes.join(homes.select("id"), "id", "left_semi").select("id", "connector")
    return nodes.join(homes.select("id"), "id", "left_anti").select(*nodes.columns), repointed(edges, homes), dead


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (bank, model, purpose, at, tokens_in, tokens_out, requests) with cost; unpriced is 1 where the model has no price."""
    met = usage.join(F.broadcast(prices), "model", "left")
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return met.withColumns({"cost": F.coalesce(cost, F.lit(0.0)), "unpriced": F.col("price_in").isNull().cast("int")})


def overlaid(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Prices by model, an override before a default."""
    return defaults.join(overrides.select("model"), "model", "left_anti").unionByName(overrides)


def usage_sums() -> list[Column]:
    return [F.count("*").alias("calls"), F.sum("requests").alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"), F.sum("unpriced").alias("unpriced")]


def usage_rollup(usage: DataFrame, by: str) -> DataFrame:
    """(key, calls, requests, tokens_in, tokens_out, cost, unpriced) by bank, model, purpose or day, and a row with key null: the total."""
    key = F.date_format("at", "yyyy-MM-dd") if by == "day" else F.col(by)
    return usage.withColumn("key", key).rollup("key").agg(*usage_sums())


def usage_dashboard(usage: DataFrame, day: str) -> DataFrame:
    """(grouping, key, ...): all, by bank, purpose and model in one pass, and the given day."""
    spark = usage.sparkSession
    marked = usage.withColumn("today", F.when(F.date_format("at", "yyyy-MM-dd") == day, F.lit(day)))
    sums = "count(*) calls, sum(requests) requests, sum(tokens_in) tokens_in, sum(tokens_out) tokens_out, sum(cost) cost, sum(unpriced) unpriced"
    q = f"select grouping_id(bank, purpose, model, today) g, bank, purpose, model, today, {sums} from {{u}} group by grouping sets ((), (bank), (purpose), (model), (today))"
    out = spark.sql(q, u=marked)
    name = F.when(F.col("g") == 15, "all").when(F.col("g") == 7, "bank").when(F.col("g") == 11, "purpose").when(F.col("g") == 13, "model").otherwise("today")
    key = F.coalesce("bank", "purpose", "model", "today", F.lit(""))
    return out.select(name.alias("grouping"), key.alias("key"), "calls", "requests", "tokens_in", "tokens_out", "cost", "unpriced").where("grouping <> 'today' or key <> ''")
