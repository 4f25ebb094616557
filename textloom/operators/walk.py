"""Walk graph and personalised PageRank."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import both_ways, hashed, with_ends
from textloom.operators.tables import checkpointed

#: Fixed values of the walk.
ALPHA, EPSILON, DAMPING = 0.15, 1e-4, 0.25
#: Rows of a side that Spark may broadcast; a larger one is held in hash tables by tasks.
SMALL = 100_000


def walk_edges(nodes: DataFrame, edges: DataFrame, kind_weights: dict[str, float] | None = None, muted: Iterable[str] = (), caps: dict[str, int] | None = None) -> DataFrame:
    """(u, v, w) in both directions: loops, absent and muted ends dropped; an unstated weight counts 1; parallel edges add up.

    caps: an edge of a kind goes if either end has more stored edges of that kind, muted ones included.
    """
    e = edges
    for kind, cap in (caps or {}).items():
        ends = edges.where(F.col("kind") == kind).select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("end"))
        hubs = ends.groupBy("end").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("end")
        near = e.where(F.col("kind") == kind)
        for side in ("from_id", "to_id"):
            near = near.join(hubs.withColumnRenamed("end", side), side, "left_anti").select(*e.columns)
        e = e.where(F.col("kind") != kind).unionAll(near)
    alive = nodes.where(~F.col("id").isin(*muted)).select("id") if (muted := list(muted)) else nodes.select("id")
    by_kind: Column = F.lit(1.0)
    for kind, w in (kind_weights or {}).items():
        by_kind = F.when(F.col("kind") == kind, float(w)).otherwise(by_kind)
    w = by_kind * F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    e = e.where("from_id <> to_id").select(F.least("from_id", "to_id").alias("u"), F.greatest("from_id", "to_id").alias("v"), w.alias("w")).where("w > 0")
    e = with_ends(e, alive, "u", "v").groupBy("u", "v").agg(F.sum("w").alias("w"))  # rows lie by v already
    return both_ways(e, "w")


def damped(walk: DataFrame) -> DataFrame:
    """Weights over the fourth root of the product of the ends' weighted degrees, which are those before damping."""
    half = checkpointed(walk.where("u < v"))  # read twice; the other half is the same the other way round
    deg = both_ways(half, "w").groupBy("u").agg(F.sum("w").alias("d"))
    both = half.join(hashed(deg.withColumnRenamed("d", "du")), "u").join(hashed(deg.select(F.col("u").alias("v"), F.col("d").alias("dv"))), "v")
    return both_ways(both.select("u", "v", (F.col("w") / F.pow(F.col("du") * F.col("dv"), DAMPING)).alias("w")), "w")


def within_reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that a walk from seeds (id) can come to, all of them and those by absent nodes too: what other parts of a graph hold moves no mass.

    Frontiers are joined until none is new, or until they hold so many nodes that little would be left out; then all edges come back.
    """
    edges = checkpointed(edges)  # each frontier reads them
    most, held = edges.count() // 8, 0
    near = frontier = checkpointed(seeds.select("id").distinct())
    while n := frontier.count():
        if (held := held + n) > max(most, SMALL):
            return edges
        side = hashed(frontier) if n > SMALL else frontier
        out = edges.join(side.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id"))
        into = edges.join(side.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id"))
        frontier = checkpointed(out.unionAll(into).distinct().join(near, "id", "left_anti"))
        near = checkpointed(near.unionAll(frontier))
    return edges.join((hashed(near) if held > SMALL else near).withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(*edges.columns)


def ppr_power(walk: DataFrame, seeds: DataFrame, steps: int = 20, alpha: float = ALPHA) -> DataFrame:
    """(id, mass) by the residual form of the lazy walk, a join and an aggregate each step; a seed without edges keeps its mass."""
    walk = checkpointed(walk)
    deg = walk.groupBy("u").agg(F.sum("w").alias("d"))
    # Every step reads the shares, so they are written once. Their ends are all linked nodes, as arcs go both ways.
    share = checkpointed(walk.join(deg, "u").select("u", "v", (F.col("w") / F.col("d")).alias("p")))
    seeds = checkpointed(seeds)
    linked = share.select(F.col("u").alias("id")).distinct()
    alone = seeds.join(linked, "id", "left_anti").select("id", F.col("s").alias("mass"))
    # A row holds a node's residual and the mass it has had so far.
    r = seeds.join(linked, "id", "left_semi").select("id", F.col("s").alias("r"), (alpha * F.col("s")).alias("mass"))
    none, held = F.lit(0.0).alias("mass"), []
    for step in range(1, steps):
        moved = r.join(share, r["id"] == share["u"]).select(F.col("v").alias("id"), (0.5 * (1 - alpha) * F.col("r") * F.col("p")).alias("r"), none)
        stays = r.select("id", (0.5 * (1 - alpha) * F.col("r")).alias("r"), "mass")
        r = moved.unionAll(stays).groupBy("id").agg(F.sum("r").alias("r"), F.sum("mass").alias("mass")).select("id", "r", (F.col("mass") + alpha * F.col("r")).alias("mass"))
        r = checkpointed(r, held)
        held = [r]
    return r.select("id", "mass").unionAll(alone)


def reached_within(walk: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(u): nodes within hops of a seed."""
    near = checkpointed(seeds.select(F.col("id").alias("u")).distinct())
    for _ in range(hops):
        near = checkpointed(near.unionAll(walk.join(near, "u", "left_semi").select(F.col("v").alias("u"))).distinct())  # the next hop reads it twice
    return near


def ppr_push(walk: DataFrame, seeds: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, hops: int = 0) -> DataFrame:
    """(id, mass) by pushing residuals in first-in first-out order until none exceeds epsilon times its degree.

    The push is sequential by definition. It pushes nodes of at most 1 / (epsilon * alpha) degrees in all, so the edges of these go to
    one group, sorted, and the whole push runs there: first those within hops of the seeds. Where nodes whose edges aren't there are
    left with more, these are added and the push starts anew; the last one is that over all edges. A large node that gets too little to
    be pushed never brings its edges.
    """
    import pandas as pd

    walk, seeds = checkpointed(walk), checkpointed(seeds)  # each hop reads them
    deg = checkpointed(walk.groupBy("u").agg(F.sum("w").alias("d")))
    start = seeds.select(F.col("id").alias("u"), F.lit(None).cast("string").alias("v"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("dv"), "s")

    def push(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf.s.notna()].sort_values("u")
        adjacency: dict[str, list[tuple[str, float]]] = {}
        degree: dict[str, float] = {}
        for u, v, w, dv in pdf[pdf.s.isna()].sort_values(["u", "v"])[["u", "v", "w", "dv"]].itertuples(index=False):
            adjacency.setdefault(u, []).append((v, w))
            degree[v] = dv
        for u, arcs in adjacency.items():
            degree[u] = sum(w for _, w in arcs)
        mass: dict[str, float] = {}
        left: dict[str, float] = {}
        queue, waiting = deque(), set()
        for u, s in zip(first.u, first.s, strict=True):
            if u not in adjacency:
                mass[u] = mass.get(u, 0.0) + s
                continue
            left[u] = left.get(u, 0.0) + s
            if left[u] > epsilon * degree[u] and u not in waiting:
                queue.append(u)
                waiting.add(u)
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            r = left.get(u, 0.0)
            if u not in adjacency or r <= epsilon * degree[u]:
                continue
            mass[u] = mass.get(u, 0.0) + alpha * r
            left[u] = (1 - alpha) * r / 2
            for v, w in adjacency[u]:
                left[v] = left.get(v, 0.0) + (1 - alpha) * r / 2 * w / degree[u]
                if left[v] > epsilon * degree[v] and v not in waiting:
                    queue.append(v)
                    waiting.add(v)
            if left[u] > epsilon * degree[u] and u not in waiting:
                queue.append(u)
                waiting.add(u)
        beyond = [v for v, r in left.items() if v not in adjacency and r > epsilon * degree[v]]
        return pd.DataFrame({"id": [*mass, *beyond], "mass": [*mass.values(), *(None for _ in beyond)]}).astype({"id": object, "mass": float})

    known = reached_within(walk, seeds, hops)
    while True:  # ends, as each round adds nodes
        rows = walk.join(known, "u", "left_semi").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v").select("u", "v", "w", "dv", F.lit(None).cast("double").alias("s"))
        pushed = checkpointed(rows.unionAll(start).groupBy(F.lit("all").alias("g")).applyInPandas(push, "id string, mass double"))
        beyond = pushed.where("mass is null or isnan(mass)")
        if beyond.isEmpty():
            return pushed
        known = checkpointed(known.unionAll(beyond.select(F.col("id").alias("u"))))


def from_node(walk: DataFrame, nodes: DataFrame, start: str, reach: float = 0.05) -> DataFrame:
    """(id, mass) of what a walk from one node reaches: not itself, and of text nodes those with reach of the best one's mass."""
    spark = nodes.sparkSession
    mass = ppr_push(walk, spark.createDataFrame([(start, 1.0)], "id string, s double")).where(F.col("id") != start)
    met = mass.join(nodes.select("id", F.col("text").isNotNull().alias("has_text")), "id")
    best = met.where("has_text").agg(F.max("mass").alias("best"))
    return met.crossJoin(F.broadcast(best)).where(f"not has_text or mass >= {reach} * best").select("id", "mass", "has_text")


def merge_walk(hits: DataFrame, mass: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with their mass, and other reached nodes of nodes with score 0 and their first chunk."""
    reached = mass.join(nodes.select("id"), "id", "left_semi")
    return hits.join(reached, "id", "full_outer").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("mass", F.lit(0.0)).alias("mass"))
