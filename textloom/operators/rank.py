"""Fusion, reduction to nodes, filters, decay, classes and caps."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Fixed values of the ranking rules.
RRF, DEPTH, ALSO, SEEDS, REACH = 60, 200, 2, 10, 0.05


def ranked(scores: DataFrame, *ties: str, depth: int = DEPTH) -> DataFrame:
    """The first depth rows by score, ties in order of the named columns, with rank from 1."""
    top = scores.orderBy(F.desc("score"), *ties).limit(depth)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties)))


def reciprocal_rank_fusion(channels: list[DataFrame], *keys: str) -> DataFrame:
    """(keys, score): the sum over channels of 1 / (60 + rank)."""
    both = reduce(DataFrame.unionAll, [c.select(*keys, "rank") for c in channels])
    return both.groupBy(*keys).agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"))


def best_chunk(chunks: DataFrame) -> DataFrame:
    """(node_id, idx, score, also): each node by its best chunk; also lists up to two further ones."""
    w = Window.partitionBy("node_id").orderBy(F.desc("score"), "idx")
    first = chunks.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= ALSO + 1)
    more = F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", "idx")))), lambda s: s["idx"])
    return first.groupBy("node_id").agg(F.min_by("idx", "rn").alias("idx"), F.max("score").alias("score"), more.alias("also"))


@dataclass(frozen=True)
class Filter:
    kinds: tuple[str, ...] = ()
    attrs: dict[str, str] = field(default_factory=dict)
    owner_prefix: str = ""
    since: Column | None = None
    muted: tuple[str, ...] = ()

    def column(self) -> Column:
        """All conditions on node columns kind, attrs, connector, at, id; an undated node fails since."""
        c = F.lit(True)
        if self.kinds:
            c &= F.col("kind").isin(*self.kinds)
        for k, v in self.attrs.items():
            c &= T.attr(F.col("attrs"), k) == v
        if self.owner_prefix:
            c &= F.startswith("connector", F.lit(self.owner_prefix))
        if self.since is not None:
            c &= F.col("at").isNotNull() & (F.col("at") >= self.since)
        if self.muted:
            c &= ~F.col("id").isin(*self.muted)
        return c


def _halved(times: Column) -> Column:
    @F.arrow_udf("double")
    def power(y: pa.Array) -> pa.Array:
        return pa.array([None if v is None else math.pow(0.5, v) for v in y.to_pylist()], pa.float64())

    return power(times)


def half_life(hits: DataFrame, now: Column, seconds: float, *scores: str, past_only: bool = True, exact: bool = False) -> DataFrame:
    """Scores of dated nodes of the past lose half in every half-life; past_only off: those of the future gain as much, too.

    exact: powers by the C library, whose last bit differs from the JVM's for some; large scores show it.
    """
    age = F.unix_micros(now) / 1e6 - F.unix_micros("at") / 1e6
    factor = F.when(F.col("at").isNotNull() & ((age > 0) if past_only else F.lit(True)), _halved(age / seconds) if exact else F.pow(F.lit(0.5), age / seconds)).otherwise(1.0)
    return hits.withColumns({c: F.col(c) * factor for c in scores})


def node_class(classes: list[tuple[str, tuple[str, ...], tuple[str, ...]]]) -> Column:
    """The first class (name, kinds, globs) that takes the node by kind or by id; else its kind."""
    out = F.when(F.lit(False), "")
    for name, kinds, globs in classes:
        takes = (F.col("kind").isin(*kinds) if kinds else F.lit(False)) | T.any_glob(F.col("id"), list(globs))
        out = out.when(takes, name)
    return out.otherwise(F.col("kind"))


def structural(layer_owner: str = "~semantic") -> Column:
    """A node without chunks, or of the semantic layer."""
    return (F.coalesce("n_chunks", F.lit(0)) == 0) | (F.col("connector") == layer_owner)


def class_cut(hits: DataFrame, k: int, classes: list[str] = ()) -> DataFrame:
    """Hits (id, class, score, mass, is_structural) cut by class, with pos.

    A class is answered if one of its hits has a third of the best score; a hit stays with a third of the best score, or more
    than a third of its class's top mass; at most k a class. Structural hits come last, at most max(1, k / 4).
    """
    text, frame = hits.where("not is_structural"), hits.where("is_structural")
    order = [F.desc("mass"), F.desc("score"), "id"]
    best = text.agg(F.max("score").alias("best"))
    by_class = Window.partitionBy("class")
    marked = text.crossJoin(F.broadcast(best)).withColumns({"class_score": F.max("score").over(by_class), "top_mass": F.max("mass").over(by_class)})
    kept = marked.where("class_score >= best / 3 and (score >= best / 3 or mass > top_mass / 3)")
    kept = kept.withColumn("in_class", F.row_number().over(by_class.orderBy(*order))).where(F.col("in_class") <= k)
    place = reduce(lambda c, x: c.when(F.col("class") == x[1], x[0]), enumerate(classes), F.when(F.lit(False), 0)).otherwise(len(classes))
    lead = kept.withColumns({"place": place, "first": F.max(F.struct("mass", "score")).over(by_class)})
    rank = F.row_number().over(Window.orderBy("place", F.desc("first"), "class", "in_class"))
    head = lead.select("id", "class", "score", "mass", "is_structural", rank.alias("pos"))
    tail = frame.orderBy(*order).limit(max(1, k // 4)) if k > 0 else frame.limit(0)
    tail = tail.select("id", "class", "score", "mass", "is_structural", F.row_number().over(Window.orderBy(*order)).alias("n"))
    size = head.agg(F.count("*").alias("size"))
    return head.unionAll(tail.crossJoin(F.broadcast(size)).select("id", "class", "score", "mass", "is_structural", (F.col("n") + F.col("size")).cast("int").alias("pos")))


def source_counts(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, sources): edges to each item that its own connector stated."""
    own = edges.select(F.col("to_id").alias("id"), "connector")
    return items.select("id", "connector").join(own, ["id", "connector"], "left_semi").join(own, ["id", "connector"]).groupBy("id").agg(F.count("*").alias("sources"))


def seeds(hits: DataFrame, n: int = SEEDS) -> DataFrame:
    """(id, s): the first n hits with shares of their scores' sum."""
    top = hits.orderBy(F.desc("score"), "id").limit(n)
    return top.select("id", (F.col("score") / F.sum("score").over(Window.partitionBy())).alias("s"))
