"""Inverted index and BM25. A chunk is a document; statistics cover the whole index, filters come after the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.tables import checkpointed

#: Fixed values of the scoring rule.
K1, B, TF_CAP = 1.2, 0.75, 65_535


def postings(chunks: DataFrame) -> DataFrame:
    """(term, node_id, idx, tf) of chunks (node_id, idx, prefix, text): tokens of the id's last path element and of the embedded text."""
    source = F.concat(T.base_name(F.col("node_id")), F.lit(" "), T.embed_text(F.col("prefix"), F.col("text")))
    return text_postings(chunks.select("node_id", "idx", source.alias("text")))


def text_postings(chunks: DataFrame) -> DataFrame:
    """(term, node_id, idx, tf) of (node_id, idx, text)."""
    terms = chunks.select("node_id", "idx", F.explode(T.tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term", "node_id", "idx").agg(F.least(F.count("*"), F.lit(TF_CAP)).alias("tf"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """(node_id, idx, len) of (node_id, idx, text)."""
    return chunks.select("node_id", "idx", F.size(T.tokens(F.col("text"))).cast("long").alias("len"))


def vocabulary(posts: DataFrame) -> DataFrame:
    """(term, cf, df)."""
    return posts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def text_vocabulary(chunks: DataFrame) -> DataFrame:
    """(term, cf, df) of (node_id, idx, text) in which no chunk has two rows: an aggregate over tokens, without a row for each term of a chunk.

    Unlike in postings, a term's frequency in a chunk isn't capped.
    """
    sorted_ = chunks.select(F.array_sort(T.tokens(F.col("text"))).alias("t"))
    first = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get("t", i - 1) == x), 0).otherwise(1).cast("long").alias("first")))
    return sorted_.select(F.inline(first)).groupBy("term").agg(F.count("*").alias("cf"), F.sum("first").alias("df"))


def has_terms(posts: DataFrame, terms: DataFrame) -> DataFrame:
    return terms.join(posts.select("term"), "term", "left_semi")


def bm25(posts: DataFrame, lengths: DataFrame, query: DataFrame) -> DataFrame:
    """(node_id, idx, score) of every chunk that shares a term with query (one column, term).

    The query's terms are few, so the index is cut to them before it is joined with lengths.
    """
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    hit = posts.join(F.broadcast(query.select("term").distinct()), "term")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    return _scored(hit.join(lengths, ["node_id", "idx"]), df, stats)


def bm25_texts(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """bm25 of (node_id, idx, text) that have no index: one pass over the texts, in which a chunk becomes its length and its few hits.

    Only these narrow rows are kept and aggregated; no token of a text is shuffled. terms: those of one query.
    """
    held = chunks.select("node_id", "idx", T.tokens(F.col("text")).alias("t"))
    tf = lambda term: F.size("t") - F.size(F.array_remove("t", term))
    counted = F.array(*(F.struct(F.lit(x).alias("term"), F.least(tf(x), F.lit(TF_CAP)).alias("tf")) for x in dict.fromkeys(terms)))
    if not terms:
        return held.select("node_id", "idx", F.lit(0.0).alias("score")).limit(0)
    rows = checkpointed(held.select("node_id", "idx", F.size("t").alias("len"), F.filter(counted, lambda h: h["tf"] > 0).alias("hits")))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    hit = rows.where(F.size("hits") > 0).select("node_id", "idx", "len", F.inline("hits"))
    return _scored(hit, hit.groupBy("term").agg(F.count("*").alias("df")), stats)


def _scored(hit: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """hit: (node_id, idx, len, term, tf); df has a row for each term of the query."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "mean")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hit.join(F.broadcast(weights), "term").groupBy("node_id", "idx").agg(F.sum(part).alias("score"))


def query_terms(spark, text: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array_distinct(T.tokens(F.lit(text)))).alias("term"))
