"""Graph catalogue: neighbours, payloads, listings, reach and components."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.tables import checkpointed

#: Fixed limits of the listings.
GRAPH_LIMIT, LIST_LIMIT, REACH_LIMIT = 1500, 1000, 200


def hashed(df: DataFrame) -> DataFrame:
    """df as the side of a join that tasks hold in hash tables. Ids begin alike, so a sort by them compares whole strings: a merge of
    sorted sides costs more, and sorts the larger side in memory too."""
    return df.hint("shuffle_hash")


def live_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends present; others dangle and are nobody's neighbour."""
    return with_ends(edges, nodes.select("id"), "from_id", "to_id")


def with_ends(edges: DataFrame, ids: DataFrame, *sides: str) -> DataFrame:
    """Edges whose ends, the named columns, all are among ids (id). What comes out is dealt by the last one.

    A semi-join would be pushed below the union that edges are made of, and each part of it would sort or hash all ids anew.
    """
    ids = ids.distinct()
    for side in sides:
        edges = edges.join(hashed(ids.withColumnRenamed("id", side)), side).select(*edges.columns)
    return edges


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """(u, v, more) and (v, u, more) of each row, in one pass over what makes edges."""
    return edges.select(F.inline(F.array(F.struct("u", "v", *more), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), *more))))


def overlapping(chunks: DataFrame, first: int, last: int) -> DataFrame:
    return chunks.where((F.col("line") <= last) & (F.col("end_line") >= first))


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """(dir, kind, other, other_kind) of a node; a loop once, as out; the kind of an absent node is empty."""
    out = edges.where(F.col("from_id") == node_id).select(F.lit("out").alias("dir"), "kind", F.col("to_id").alias("other"))
    into = edges.where((F.col("to_id") == node_id) & (F.col("from_id") != node_id)).select(F.lit("in").alias("dir"), "kind", F.col("from_id").alias("other"))
    kinds = nodes.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"))
    return out.unionAll(into).join(kinds, "other", "left").select("dir", "kind", "other", F.coalesce("other_kind", F.lit("")).alias("other_kind"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, degree): live edges at each node; a loop counts once."""
    ends = live_edges(nodes, edges).select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id"))
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id", "kind").join(hashed(counts), "id", "left").select("id", "kind", F.coalesce("degree", F.lit(0)).alias("degree"))


def payload_nodes(nodes: DataFrame, edges: DataFrame, limit: int = GRAPH_LIMIT, kinds: list[str] | None = None, hidden: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """(id, kind, degree): the nodes of greatest degree, and extra ids with their neighbours."""
    d = degrees(nodes, edges)
    shown = d.where(F.col("kind").isin(kinds)) if kinds else d
    shown = shown.where(~F.col("kind").isin(hidden)) if hidden else shown
    top = shown.orderBy(F.desc("degree"), "id").limit(limit)
    if not extra:
        return top
    e = live_edges(nodes, edges)
    near = e.where(F.col("from_id").isin(extra)).select(F.col("to_id").alias("id")).unionAll(e.where(F.col("to_id").isin(extra)).select(F.col("from_id").alias("id")))
    wanted = near.unionAll(d.where(F.col("id").isin(extra)).select("id")).distinct()
    return top.unionAll(d.join(wanted, "id", "left_semi")).distinct()


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges among ids, a table of nodes that is made once."""
    return live_edges(checkpointed(ids.select("id")), edges)


def kind_listing(nodes: DataFrame, edges: DataFrame, kind: str, substring: str = "", limit: int = LIST_LIMIT) -> DataFrame:
    """(id, at, degree, about, total) of a kind's nodes, latest first: by the latest of its own time and those of what points to it."""
    d = degrees(nodes, edges)
    mine = nodes.where(F.col("kind") == kind)
    if substring:
        hay = F.lower(F.concat_ws("\n", "id", T.label(F.col("id"), F.col("kind"), F.col("attrs"), F.col("text")), F.array_join(F.map_values("attrs"), "\n")))
        mine = mine.where(F.contains(hay, F.lit(substring.lower())))
    source = nodes.select(F.col("id").alias("from_id"), F.col("at").alias("from_at"), F.when(F.col("text").isNotNull(), T.label(F.col("id"), F.col("kind"), F.col("attrs"), F.col("text"))).alias("from_label"))
    into = edges.select("from_id", F.col("to_id").alias("id")).join(source, "from_id")
    seen = into.groupBy("id").agg(F.max("from_at").alias("in_at"), F.min_by("from_label", F.struct("from_at", "from_id")).alias("about"))
    rows = mine.select("id", "at").join(seen, "id", "left").join(d.select("id", "degree"), "id")
    rows = rows.select("id", F.greatest("at", "in_at").alias("at"), "degree", F.coalesce("about", F.lit("")).alias("about"))
    top = rows.orderBy(F.col("at").desc_nulls_last(), F.desc("degree"), "id").limit(limit)
    return top.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def parts(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, id): what a node stands for, by incoming edges through nodes without text; a node with text is its only part.

    start has the column root. Frontiers are joined until none is new.
    """
    # Each round reads both.
    has_text = checkpointed(nodes.select("id", F.col("text").isNotNull().alias("has_text")))
    into = checkpointed(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("next")))
    seen = start.select("root", F.col("root").alias("id")).distinct()
    frontier = seen
    while not frontier.isEmpty():  # ends, as each round adds pairs that weren't seen
        through = frontier.join(has_text.where("not has_text"), "id", "left_semi")
        new = through.join(into, "id").select("root", F.col("next").alias("id")).distinct().join(has_text.select("id"), "id", "left_semi").select("root", "id")
        frontier = checkpointed(new.join(seen, ["root", "id"], "left_anti"))
        seen = checkpointed(seen.unionAll(frontier))
    return seen


def reach_groups(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """(dir, kind, node_kind, total): the neighbours of a node's parts, by direction, edge kind and kind of node."""
    return reach(nodes, edges, root).groupBy("dir", "kind", "node_kind").agg(F.count("*").alias("total"))


def reach(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """(dir, kind, node_kind, other, ties): edges that leave the parts, a row for each neighbour."""
    own = parts(nodes, edges, nodes.sparkSession.createDataFrame([(root,)], "root string")).select("id")
    e = live_edges(nodes, edges)
    out = e.join(own.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.lit("out").alias("dir"), "kind", F.col("to_id").alias("other"))
    into = e.join(own.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.lit("in").alias("dir"), "kind", F.col("from_id").alias("other"))
    away = out.unionAll(into).join(own.withColumnRenamed("id", "other"), "other", "left_anti")
    kinds = nodes.select(F.col("id").alias("other"), F.col("kind").alias("node_kind"))
    return away.groupBy("dir", "kind", "other").agg(F.count("*").alias("ties")).join(kinds, "other").select("dir", "kind", "node_kind", "other", "ties")


def reach_top(found: DataFrame, limit: int = REACH_LIMIT) -> DataFrame:
    """The first limit neighbours of each group, by ties."""
    w = Window.partitionBy("dir", "kind", "node_kind").orderBy(F.desc("ties"), "other")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")


def node_detail(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """(dir, kind, others): a node's edges in groups."""
    return neighbours(nodes, edges, node_id).groupBy("dir", "kind").agg(F.array_sort(F.collect_list(F.struct("other", "other_kind"))).alias("others"))


def kind_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("kind").agg(F.count("*").alias("n"))


def bank_summary(nodes: DataFrame) -> DataFrame:
    """(connector, kind, n, n_text)."""
    return nodes.groupBy("connector", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNotNull()).alias("n_text"))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v): distinct neighbours in both directions, without loops."""
    return both_ways(neighbour_pairs(nodes.select("id"), edges))


def neighbour_pairs(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v), u < v: distinct neighbours among ids (id). Rows that are dealt by v already are made distinct where they lie."""
    pairs = edges.where("from_id <> to_id").select(F.least("from_id", "to_id").alias("u"), F.greatest("from_id", "to_id").alias("v"))
    return with_ends(pairs, ids, "u", "v").distinct()


def coded(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(codes (n, id), pairs (u, v)): a number for each distinct id and the neighbours' numbers, u <> v, a pair once in one direction.

    Both are written: what goes over a graph again and again then moves numbers, not ids.
    """
    codes = checkpointed(nodes.select("id").distinct().select(F.monotonically_increasing_id().alias("n"), "id"))
    pairs = edges.where("from_id <> to_id").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"))
    for side, name in (("a", "u"), ("b", "v")):
        pairs = pairs.join(hashed(codes.select(F.col("id").alias(side), F.col("n").alias(name))), side).drop(side)
    return codes, checkpointed(pairs.select("u", "v").distinct())


def component_numbers(pairs: DataFrame, seed: int = 11) -> DataFrame:
    """(n, c): the number that stands for n's component, of every number in pairs (u, v), a written table.

    Each number goes to the least of itself and its neighbours, in an order that changes from round to round; what went to the same one
    becomes that one, and its pairs with others stay. So the graph shrinks until no pair is left: a chain by a share of its length in
    each round, a star at once.
    """
    rng, rounds = random.Random(seed), []
    while not pairs.isEmpty():  # ends, as each round joins both ends of some pair at least
        mask = F.lit(rng.getrandbits(62))
        least = both_ways(pairs).groupBy("u").agg(F.min(F.col("v").bitwiseXOR(mask)).alias("m"))
        went = checkpointed(least.select(F.col("u").alias("n"), F.least("m", F.col("u").bitwiseXOR(mask)).bitwiseXOR(mask).alias("c")))
        rounds.append(went)
        moved = pairs
        for side in ("u", "v"):
            moved = moved.join(hashed(went.select(F.col("n").alias(side), F.col("c").alias(f"c{side}"))), side)
        moved = moved.where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()
        pairs = checkpointed(moved, [pairs])
    found = None
    for went in reversed(rounds):
        if found is not None:
            went = went.join(hashed(found.select(F.col("n").alias("c"), F.col("c").alias("last"))), "c", "left").select("n", F.coalesce("last", "c").alias("c"))
        found = went
    return pairs.select(F.col("u").alias("n"), F.col("v").alias("c")) if found is None else found


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable."""
    codes, pairs = coded(nodes, edges)
    own = codes.join(hashed(component_numbers(pairs)), "n", "left").select("id", F.coalesce("c", "n").alias("c"))
    least = own.groupBy("c").agg(F.min("id").alias("component"))
    return own.join(hashed(least), "c").select("id", "component")


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(c, size): the number of nodes of each component, which a number stands for."""
    codes, pairs = coded(nodes, edges)
    own = codes.join(hashed(component_numbers(pairs)), "n", "left").select(F.coalesce("c", "n").alias("c"))
    return own.groupBy("c").agg(F.count("*").alias("size"))


def numbered(ids: DataFrame) -> DataFrame:
    """(id, n): places from 0 in order of id, by sorted ranges and the number of rows before each."""
    ranges = checkpointed(ids.select("id").orderBy("id").select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))
    before = ranges.groupBy("p").agg(F.count("*").alias("c")).select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))  # a row for each range
    return ranges.join(before, "p").select("id", (F.col("before") + F.col("k")).alias("n"))


def graphml(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, edge_kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node rows, edge rows, count of dangling edges) of an export: nodes numbered in order of id, edges in order of (from, to, kind).

    An edge dangles if an end is absent from nodes; one whose end is of another kind than kinds is left out.
    """
    kept = nodes.where(F.col("kind").isin(kinds)) if kinds else nodes
    picked = edges.where(F.col("kind").isin(edge_kinds)) if edge_kinds else edges
    there, live = live_edges(nodes, picked), live_edges(kept, picked)  # the numbers' joins below leave live edges too
    ends = live.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    number = checkpointed(numbered(kept))
    chunks = F.col("n_chunks") if "n_chunks" in nodes.columns else F.when(F.col("text").isNotNull(), 1)
    rows = kept.join(number, "id").join(ends, "id", "left").select("n", "id", "kind", "attrs", "text", "at", "connector", F.coalesce(chunks, F.lit(0)).alias("n_chunks"), F.coalesce("degree", F.lit(0)).alias("degree"))
    by = lambda side, name: hashed(number.select(F.col("id").alias(side), F.col("n").alias(name)))
    arcs = picked.join(by("from_id", "a"), "from_id").join(by("to_id", "b"), "to_id").select("a", "b", "from_id", "to_id", "kind", "weight", "connector")
    ranges = checkpointed(arcs.orderBy("a", "b", "kind").select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))
    before = ranges.groupBy("p").agg(F.count("*").alias("c")).select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))
    arcs = ranges.join(before, "p").select((F.col("before") + F.col("k")).alias("e"), "a", "b", "from_id", "to_id", "kind", "weight", "connector")
    lost = picked.agg(F.count("*").alias("all")).crossJoin(there.agg(F.count("*").alias("live"))).select((F.col("all") - F.col("live")).alias("dangling"))
    return rows, arcs, lost


def xml_escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


#: Columns of an export: id, what has it, name, type.
GRAPHML = [("n_id", "node", "id", "string"), ("n_label", "node", "label", "string"), ("n_kind", "node", "kind", "string"), ("n_connector", "node", "connector", "string"), ("n_chunks", "node", "chunks", "int"), ("n_degree", "node", "degree", "int"), ("n_at", "node", "at", "string"), ("e_kind", "edge", "kind", "string"), ("e_weight", "edge", "weight", "double"), ("e_connector", "edge", "connector", "string")]


def graphml_lines(nodes: DataFrame, edges: DataFrame, **picked) -> DataFrame:
    """(part, n, line): the lines of a GraphML file, ordered by part and n; empty values are left out."""
    rows, arcs, _ = graphml(nodes, edges, **picked)
    data = lambda k, v: F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f'<data key="{k}">'), xml_escaped(v.cast("string")), F.lit("</data>"))).otherwise("")
    values = {"n_id": F.col("id"), "n_label": T.label(F.col("id"), F.col("kind"), F.col("attrs"), F.col("text")), "n_kind": F.col("kind"), "n_connector": F.col("connector"), "n_chunks": F.col("n_chunks"), "n_degree": F.col("degree"), "n_at": F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    node = rows.select(F.lit(1).alias("part"), "n", F.concat(F.lit('<node id="n'), F.col("n"), F.lit('">'), *(data(k, v) for k, v in values.items()), F.lit("</node>")).alias("line"))
    said = [data("e_kind", F.col("kind")), data("e_weight", F.col("weight")), data("e_connector", F.col("connector"))]
    edge = arcs.select(F.lit(2).alias("part"), F.col("e").alias("n"), F.concat(F.lit('<edge id="e'), F.col("e"), F.lit('" source="n'), F.col("a"), F.lit('" target="n'), F.col("b"), F.lit('">'), *said, F.lit("</edge>")).alias("line"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(f'<key id="{k}" for="{f}" attr.name="{n}" attr.type="{t}"/>\n' for k, f, n, t in GRAPHML) + '<graph id="G" edgedefault="directed">'
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(0, 0, head), (3, 0, "</graph>\n</graphml>")], "part int, n long, line string")
    return fixed.unionAll(node).unionAll(edge)


def write_graphml(lines: DataFrame, path: str) -> None:
    """A folder of parts that are one file when they are joined in order of name: sorted ranges, each written by its own task."""
    lines.orderBy("part", "n").select("line").write.mode("overwrite").text(path)
