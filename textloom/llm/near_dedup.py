"""MinHash near-dedup by an inverted join on signature coordinates.

1. Each document's set of word shingles gives a fingerprint and a signature of COORDINATES minima. Documents with equal sets are
   linked at once; one representative of each class goes on.
2. Representatives are posted under their coordinate-value pairs. Two signatures that agree in enough places (matches) share a posting
   among the COORDINATES - matches + 1 rarest pairs of each (prefix filter), so only those are kept; pairs that one document alone
   has, and posting lists with the same members as another, are skipped.
3. The first document of each posting list is compared with all others of the list, a row for each pair, on the full sets; what is
   linked is contracted. A large group of near copies becomes one component here, in as many comparisons as it has members.
4. What lists still hold in several components is compared in blocks: collisions of coordinates are counted, and what reaches
   matches is confirmed on the full sets. Blocks are bounded by their shingles, and no two blocks of one component meet, so such a
   component costs its size times that of the rest; only links that join two components leave a pair of blocks.
5. Links are contracted to components.

The places in which two signatures have to agree follow from the link threshold: the most for which a pair at the threshold is missed
with a chance below 5e-7 (38 of 64 at 85 %, where a pair agrees in 54 on average). The query links at PERCENT, the stage of the
pipeline at STAGE_PERCENT. Links are confirmed on sets of 64-bit shingle hashes.

Texts whose least doc_id is the same (rows that repeat a doc_id with other texts) count as one document: it is linked where one of them is.

Defined cases: a document without words (null or empty text) has no shingles and stands alone; one with fewer words than the
width has its whole sequence as one shingle; rows that repeat a doc_id give a row each;
rows without doc_id are left out.
Ties: the least doc_id of a component is kept. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.components import components

WIDTH, COORDINATES, PERCENT, STAGE_PERCENT, BLOCK = 5, 64, 85, 80, 300_000
SEED = 20240229  # BLOCK: shingles of a block


def matches_at(percent: int) -> int:
    """The most matches m, 1 at least, for which a pair of this similarity agrees in fewer than m coordinates with a chance below 5e-7."""
    p, below, m = percent / 100, 0.0, 0
    while m < COORDINATES and (below := below + math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) < 5e-7:
        m += 1
    return max(m, 1)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words, A-Z taken as a-z."""
    return common.distinct(common.shingle_hashes(common.word_hashes(text.translate(common.LOWER_SPACE))[0], width))


_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(1, 1 << 31, (COORDINATES, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _RNG.integers(0, 1 << 32, (COORDINATES, 1), np.uint32)


def signature(s: np.ndarray) -> np.ndarray:
    """For each coordinate the least value of a hash function over the set: half of them over each half of the 64-bit hashes."""
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    half = COORDINATES // 2
    for i in range(0, len(s), 1024):
        x = s[i : i + 1024]
        for k, part in enumerate((x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32))):
            rows = slice(k * half, k * half + half)
            best[rows] = np.minimum(best[rows], ((part[None] ^ _MASKS[rows]) * _FACTORS[rows]).min(1))
    return best


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig) of every document; f1 and f2 fingerprint the set, sig is null without shingles."""

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        import xxhash

        for doc_id, text in docs:
            s = shingle_set(text)
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            yield doc_id, len(s), (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), signature(s).tobytes() if len(s) else None

    return common.map_docs(docs, rows, "doc_id long, n_shingles long, f1 long, f2 long, sig binary", "doc_id")


def rare_postings(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, doc_id): each representative's prefix, where another one has the same key.

    The key is a hash of coordinate and value; a clash of two keys only adds a comparison.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
            keys = common.mixed(sig + salt[None])
            for i in range(0, len(keys), 500):
                part = keys[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("doc_id").to_numpy()[i : i + 500], COORDINATES)), pa.array(part.reshape(-1).view(np.int64))], ["doc_id", "key"])

    posted = reps.select("doc_id", "sig").mapInArrow(rows, "doc_id long, key long")
    spread = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    # All pairs of a document stand in its row of the ranking, so that a key that no other document has uses up a place of the prefix.
    shared = posted.join(spread, F.col("key") == F.col("k"))
    per_doc = shared.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    alone = F.lit(COORDINATES) - F.size("shared")
    places = F.greatest(F.lit(COORDINATES - matches_at(percent) + 1) - alone, F.lit(0))
    return per_doc.select("doc_id", F.explode(F.slice("shared", 1, places)).alias("p")).select("doc_id", F.col("p.key").alias("key"))


def full_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(doc_id, full): the shingle sets of documents of needed, a written table, and of few others."""

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, text in docs:
            yield doc_id, shingle_set(text).tobytes()

    return common.map_docs(common.likely(docs, needed), rows, "doc_id long, full binary", "doc_id", batch=200)


def star_links(postings: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links of the first document of each posting list with others of the list."""
    first = postings.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    pairs = postings.join(first, F.col("key") == F.col("k")).where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    pairs = common.cut(pairs, "pairs")
    sets = full_sets(docs, common.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "paired"))
    met = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_near(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(linked, "a long, b long")


def _near(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def block_pairs(postings: DataFrame, comps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cell, doc_id, component): what posting lists hold besides their first document in several components, as pairs of blocks.

    comps: (node, component) as far as it is known; sizes: (doc_id, n_shingles). A group of a list is some of its components; a large one makes several blocks.
    """
    first = postings.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 2").select(F.col("key").alias("k"), "a")
    rest = postings.join(first, F.col("key") == F.col("k")).where("doc_id > a").select("key", "doc_id")
    own = F.coalesce("component", "doc_id").alias("component")
    rest = rest.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", own).distinct()
    # Lists with the same members are compared once.
    h = F.xxhash64("doc_id")
    lists = rest.groupBy("key").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("s2"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2")
    once = lists.groupBy("n", "s1", "s2").agg(F.min("key").alias("k")).select("k")
    rest = common.cut(rest.join(once, F.col("key") == F.col("k")).join(sizes.groupBy("doc_id").agg(F.sum("n_shingles").alias("weight")), "doc_id").select("key", "doc_id", "component", "weight"), "unlike")
    room = lambda x: F.ceil(F.sum(x) / BLOCK).cast("int")
    parts = rest.groupBy("key").agg(room("weight").alias("parts")).withColumnRenamed("key", "k")
    dealt = rest.join(parts, F.col("key") == F.col("k")).withColumn("part", F.pmod(F.xxhash64("component"), F.col("parts")).cast("int")).drop("k")
    groups = dealt.groupBy("key", "part").agg(room("weight").alias("blocks"), (F.min("component") == F.max("component")).alias("single"))
    w = Window.partitionBy("key")
    groups = groups.select(F.col("key").alias("k"), F.col("part").alias("p"), "blocks", "single", (F.sum("blocks").over(w.orderBy("part")) - F.col("blocks")).alias("before"), F.sum("blocks").over(w).alias("all"))
    placed = dealt.join(groups, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p"))).withColumn("own", F.col("before") + F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("blocks")))
    others = placed.select("key", "doc_id", "component", "own", "single", "before", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("other"))
    others = others.where("not (single and other >= before and other < before + blocks)")
    return others.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "doc_id", "component")


def _links(ids: np.ndarray, comps: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Confirmed links among the documents of a cell between components, without those that close a circle."""
    n = len(ids)
    _, root = np.unique(comps, return_inverse=True)
    root = root.tolist()
    nodes = list(range(n))

    def find(i: int) -> int:
        while nodes[i] != i:
            nodes[i] = nodes[nodes[i]]
            i = nodes[i]
        return i

    size = np.array([len(s) for s in sets])
    hits = np.zeros((n, n), np.uint8)
    for k in range(COORDINATES):
        hits += sigs[:, k][:, None] == sigs[:, k][None]
    fit = (hits >= matches_at(percent)) & (comps[:, None] != comps[None]) & (100 * np.minimum(size[:, None], size[None]) >= percent * np.maximum(size[:, None], size[None]))
    a, b = np.nonzero(np.triu(fit, 1))
    order = np.argsort(-hits[a, b].astype(np.int16), kind="stable")
    out = []
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if (x := find(root[i])) != (y := find(root[j])) and _near(sets[i], sets[j], percent):
            nodes[max(x, y)] = min(x, y)
            out.append((int(ids[i]), int(ids[j])))
    return out


def confirmed(cells: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) links: the members' full sets meet in their cell."""
    met = cells.join(full_sets(docs, common.cut(cells.select("doc_id").distinct(), "in-cells")), "doc_id").select("cell", "doc_id", "component", "full")
    dealt = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "doc_id")

    def cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch | None:
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            got = _links(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.stack([signature(s) for s in sets]), sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"]) if got else None

        cell, held = None, []
        for b in batches:
            for c, *row in zip(b.column("cell").to_pylist(), b.column("doc_id").to_pylist(), b.column("component").to_pylist(), b.column("full").to_pylist(), strict=True):
                if c != cell:
                    if len(held) > 1 and (out := flush(held)):
                        yield out
                    cell, held = c, []
                held.append(tuple(row))
        if len(held) > 1 and (out := flush(held)):
            yield out

    return dealt.mapInArrow(cell_links, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    docs = common.as_docs(docs).where("doc_id is not null")
    feats = common.cut(features(docs), "features")
    classes = feats.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    reps = common.only(feats.where("n_shingles > 0"), classes.select(F.col("rep").alias("doc_id")))
    postings = common.cut(rare_postings(reps, percent), "postings")
    stars = common.cut(star_links(postings, docs, percent), "star-links")
    # What is linked with the same first document is one component; that is told by an aggregate, and nearly all of a large group's own.
    nearest = stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    cells = common.cut(block_pairs(postings, nearest, reps.select("doc_id", "n_shingles")), "cells")
    found = components(stars.unionAll(confirmed(cells, docs, percent)))
    keys = ["n_shingles", "f1", "f2"]
    merged = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*keys, F.coalesce("component", "rep").alias("c"))
    out = feats.select("doc_id", *keys).join(merged, keys, "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the least doc_id. Rows without doc_id stay."""
    gone = near_duplicates(docs, STAGE_PERCENT).where("not kept").select("doc_id")
    return common.only(docs, gone, "left_anti")
