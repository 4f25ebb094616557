"""The driver tables as a graph of text: nodes (id, kind, text, attrs, at, connector) and edges (from_id, to_id, kind, weight, connector)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is read from its files once in a session, as a graph names the same tables many times."""
    key = (spark.sparkContext.applicationId, path := f"{sf_dir}/{name}.parquet")
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def key(kind: str, *parts: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws(":", *parts))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _node(df: DataFrame, node_id: Column, kind: str, connector: str, text: Column | None = None, attrs: Column | None = None, at: Column | None = None) -> DataFrame:
    none = F.lit(None)
    attrs = F.create_map().cast("map<string,string>") if attrs is None else attrs
    return df.select(node_id.alias("id"), F.lit(kind).alias("kind"), (none if text is None else text).cast("string").alias("text"), attrs.alias("attrs"), (none if at is None else at).cast("timestamp").alias("at"), F.lit(connector).alias("connector"))


def _edge(df: DataFrame, a: Column, b: Column, kind: str, connector: str, weight: Column | None = None) -> DataFrame:
    return df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("kind"), (F.lit(0.0) if weight is None else weight).cast("double").alias("weight"), F.lit(connector).alias("connector"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and replies with their node id, kind and time."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    kind = F.when(F.col("role") == "user", "message").otherwise("reply")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select("conv_id", "turn", "role", "text", kind.alias("kind"), F.concat_ws(":", kind, "conv_id", "turn").alias("id"), at.alias("at"))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    attrs = F.map_filter(F.create_map(*(x for c in ("lang", "source", "quality", "toxic") for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull())
    return _node(d, key("doc", "doc_id"), "document", "docs", F.col("text"), attrs)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    named = lambda c: F.create_map(F.lit("name"), F.col(c).cast("string"))
    d, p, tt = t("documents"), t("pages"), turns(spark, sf_dir)
    return union([
        document_nodes(spark, sf_dir),
        _node(d.select("source").distinct(), key("source", "source"), "source", "docs", attrs=named("source")),
        _node(d.select("lang").distinct(), key("lang", "lang"), "lang", "docs", attrs=named("lang")),
        _node(p, key("page", "page_id"), "page", "web", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.create_map(F.lit("url"), F.col("url"))),
        _node(p.select(host(F.col("url")).alias("h")).distinct(), key("host", "h"), "host", "web", attrs=named("h")),
        _node(t("conversations").select("conv_id").distinct(), key("session", "conv_id"), "session", "talk"),
        tt.select("id", "kind", "text", F.create_map().cast("map<string,string>").alias("attrs"), "at", F.lit("talk").alias("connector")),
        _node(t("region"), key("region", "r_regionkey"), "region", "shop", attrs=named("r_name")),
        _node(t("nation"), key("nation", "n_nationkey"), "nation", "shop", attrs=named("n_name")),
        _node(t("customer"), key("customer", "c_custkey"), "customer", "shop", F.col("c_name"), F.create_map(F.lit("segment"), F.col("c_mktsegment"))),
        _node(t("supplier"), key("supplier", "s_suppkey"), "supplier", "shop", attrs=named("s_name")),
        _node(t("part"), key("part", "p_partkey"), "part", "shop", F.col("p_name"), F.create_map(F.lit("brand"), F.col("p_brand"))),
        _node(t("orders"), key("orders", "o_orderkey"), "orders", "shop", at=F.col("o_orderdate")),
    ])


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/]+)", 1)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    d, p = t("documents"), t("pages")
    links = p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("target"))
    lines = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("w"))
    return union([
        _edge(d, key("doc", "doc_id"), key("source", "source"), "in", "docs"),
        _edge(d, key("doc", "doc_id"), key("lang", "lang"), "has", "docs"),
        _edge(p, key("page", "page_id"), F.concat(F.lit("host:"), host(F.col("url"))), "of", "web"),
        _edge(links, key("page", "page_id"), F.concat(F.lit("url:"), F.col("target")), "links", "web"),
        conversation_edges(turns(spark, sf_dir)),
        _edge(t("nation"), key("nation", "n_nationkey"), key("region", "n_regionkey"), "of", "shop"),
        _edge(t("customer"), key("customer", "c_custkey"), key("nation", "c_nationkey"), "of", "shop"),
        _edge(t("supplier"), key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "of", "shop"),
        _edge(t("orders"), key("orders", "o_orderkey"), key("customer", "o_custkey"), "of", "shop"),
        _edge(lines, key("part", "l_partkey"), key("supplier", "l_suppkey"), "supplied_by", "shop", F.col("w")),
    ])


def conversation_edges(t: DataFrame) -> DataFrame:
    """in: turn to session; next: turn to the turn after it; answers: reply to the latest message before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    seen = t.select("*", F.lead("id").over(w).alias("after"), F.last(F.when(F.col("kind") == "message", F.col("id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("asked"))
    return union([
        _edge(t, F.col("id"), key("session", "conv_id"), "in", "talk"),
        _edge(seen.where("after is not null"), F.col("id"), F.col("after"), "next", "talk"),
        _edge(seen.where("kind = 'reply' and asked is not null"), F.col("id"), F.col("asked"), "answers", "talk"),
    ])
