"""Incremental maintenance: upserts, change detection, deletes, sweeps, cursors and compacted ids, as joins of stored and arriving rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.tables import checkpointed

ENGINE = "~"
SEMANTIC = "~semantic"


def latest(records: DataFrame, *keys: str) -> DataFrame:
    """The last record by seq of each key."""
    cols = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*cols), "seq").alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in cols))


def changed(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """(id, changed): whether a node is new, or its hash or recipe differs from what is stored."""
    old = stored.select("id", F.col("hash").alias("old_hash"), F.col("recipe").alias("old_recipe"), F.lit(True).alias("known"))
    same = F.coalesce(F.col("known"), F.lit(False)) & F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("recipe").eqNullSafe(F.col("old_recipe"))
    return arriving.join(old, "id", "left").select("id", (~same).alias("changed"))


def upsert(stored: DataFrame, arriving: DataFrame, *keys: str) -> DataFrame:
    """Arriving rows replace stored ones of the same key wholly."""
    return stored.join(arriving.select(*keys), list(keys), "left_anti").unionByName(arriving.select(*stored.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, connector: str) -> tuple[DataFrame, DataFrame]:
    """Delete the connector's own nodes of ids, and edges at them that it or the semantic layer stated; others are left to dangle."""
    gone = nodes.where(F.col("connector") == connector).join(ids.select("id"), "id", "left_semi").select("id")
    mine = F.col("connector").isin(connector, SEMANTIC)
    hit = edges.where(mine)
    hit = hit.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").select(*edges.columns)
    hit = hit.join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(*edges.columns)
    return nodes.join(gone, "id", "left_anti").select(*nodes.columns), edges.where(~mine).unionByName(hit)


def sweep(stored: DataFrame, seen: DataFrame, connector: str, *keys: str) -> DataFrame:
    """The connector's rows that this run hasn't seen go; others stay."""
    mine = stored.where(F.col("connector") == connector).join(seen.select(*keys), list(keys), "left_semi").select(*stored.columns)
    return stored.where(F.col("connector") != connector).unionByName(mine)


def without_compacted(records: DataFrame, compacted: DataFrame, *ends: str) -> DataFrame:
    """Records that name no compacted id."""
    for end in ends:
        records = records.join(compacted.select(F.col("id").alias(end)), end, "left_anti").select(*records.columns)
    return records


def guard(records: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Fails when a connector states what the semantic layer owns."""
    owned = stored.where(F.col("connector") == SEMANTIC).select(*keys, F.lit(True).alias("owned"))
    checked = records.join(owned, list(keys), "left")
    keep = F.when(F.col("owned"), F.raise_error(F.lit("a connector may not state what the semantic layer owns")).cast("boolean")).otherwise(F.lit(True))
    return checked.where(keep).select(*records.columns)


def run_stats(arriving: DataFrame, change: DataFrame, deleted: DataFrame) -> DataFrame:
    """(nodes, changed, deleted) of a run."""
    return arriving.agg(F.count("*").alias("nodes")).crossJoin(change.agg(F.count_if("changed").alias("changed"))).crossJoin(deleted.agg(F.count("*").alias("deleted")))


def owner_of_enrichment(connector: Column) -> Column:
    """The enrichment that owns a row, or the empty string."""
    return F.when(F.startswith(connector, F.lit("~enrich:")), F.substring(connector, 9, 1 << 20)).otherwise("")


def engine_chunk(nodes: DataFrame) -> DataFrame:
    """The one chunk of a text node that the engine made."""
    return nodes.select(F.col("id").alias("node_id"), F.lit(0).alias("idx"), T.content_hash(F.col("text")).alias("hash"), F.lit("").alias("prefix"), "text", F.lit(1).alias("line"), F.lit(1).alias("end_line"))


@dataclass(frozen=True)
class Tables:
    """What stages pass on: nodes (id, kind, text, attrs, at, connector, hash, recipe), edges, cursors (connector, value), compacted (id, connector)."""

    nodes: DataFrame
    edges: DataFrame
    cursors: DataFrame
    compacted: DataFrame


def apply_run(tables: Tables, records: DataFrame, connector: str, recipe: str) -> tuple[Tables, DataFrame]:
    """One connector's records (seq and the wire fields) applied to the tables; and the run's statistics.

    Within a run the last record of a key counts; a delete counts against nodes stated before it. A sweep counts if a sweep record came.
    """
    own = F.lit(connector)
    records = checkpointed(records)  # read once; each of the steps below reads it
    n = records.where("node is not null").select("seq", "node.*")
    n = without_compacted(latest(n, "id"), tables.compacted, "id")
    e = records.where("edge is not null").select("seq", F.col("edge.from").alias("from_id"), F.col("edge.to").alias("to_id"), F.col("edge.kind").alias("kind"), F.coalesce("edge.weight", F.lit(0.0)).alias("weight"))
    e = without_compacted(latest(e, "from_id", "to_id", "kind"), tables.compacted, "from_id", "to_id")
    d = records.where("delete is not null").select("seq", F.col("delete.id").alias("id"))
    d = latest(d, "id").join(n.select("id", F.col("seq").alias("stated")), "id", "left").where("stated is null or stated < seq").select("id")
    arriving = n.join(d, "id", "left_anti").select("id", F.coalesce("kind", F.lit("document")).alias("kind"), "text", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"), "at", own.alias("connector"), F.coalesce("hash", T.content_hash(F.col("text"))).alias("hash"), F.coalesce("chunker", F.lit(recipe)).alias("recipe"))
    arriving = checkpointed(guard(arriving, tables.nodes, "id"))
    stated = checkpointed(guard(e.select("from_id", "to_id", "kind", "weight", own.alias("connector")), tables.edges, "from_id", "to_id", "kind"))
    change = changed(tables.nodes, arriving)
    nodes, edges = delete_nodes(upsert(tables.nodes, arriving, "id"), upsert(tables.edges, stated, "from_id", "to_id", "kind"), d, connector)
    if not records.where("sweep is not null").isEmpty():
        nodes = sweep(nodes, arriving, connector, "id")
        edges = sweep(edges, stated, connector, "from_id", "to_id", "kind")
    value = records.where("cursor is not null").agg(F.max_by("cursor.value", "seq").alias("value")).where("value is not null").select(own.alias("connector"), "value")
    nodes, edges = checkpointed(nodes), checkpointed(edges)  # the next run's plan starts here
    gone = tables.nodes.join(nodes.select("id"), "id", "left_anti")
    return replace(tables, nodes=nodes, edges=edges, cursors=checkpointed(upsert(tables.cursors, value, "connector"))), run_stats(arriving, change, gone)


def remove_connector(tables: Tables, connector: str) -> Tables:
    """Everything of a connector goes: its nodes by the delete rule, its edges, compacted marks and cursor."""
    nodes, edges = delete_nodes(tables.nodes, tables.edges, tables.nodes.where(F.col("connector") == connector).select("id"), connector)
    keep = F.col("connector") != connector
    return Tables(nodes, edges.where(keep), tables.cursors.where(keep), tables.compacted.where(keep))


def island(condition: Column, *partition: str, order: str) -> Column:
    """Number of the run that a row is in: rows for which condition holds open one."""
    return F.sum(condition.cast("int")).over(Window.partitionBy(*partition).orderBy(order))
