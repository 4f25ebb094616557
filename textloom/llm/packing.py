"""Best-fit packing by repeated length patterns.

Lengths of pieces form a histogram of at most CAPACITY entries, whatever the number of documents. Patterns of one to four lengths
that fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded
down, and what is left over is packed by repeated best-fit patterns. Pieces are then numbered within their length and take the
places of that length in order, so that only the histogram and the plan, both bounded by CAPACITY and PER_LENGTH, pass the driver.
Full pieces, the commonest at scale, are a sequence each and take no number. To number the others, each length is dealt out to as many
parts as its count asks for, of some PART pieces, so that no task holds a common length alone.

Defined cases: a null or empty text is the one closing id; repeated rows and rows without doc_id are packed like others.
Columns other than doc_id and text are ignored. Ties between pieces of one length go by (doc_id, piece, ids_crc32).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import common, tokens

CAPACITY, PER_LENGTH, PART, CLOSING = 2048, 6, 100_000, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = tokens.BYTE_BPE) -> DataFrame:
    """Documents' ids, closed by CLOSING and cut into pieces of capacity; only the first piece may be shorter. No shuffle."""

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        encode = tokens.encoder(tokenizer).encode
        for doc_id, text in docs:
            ids = encode(text.decode("utf-8", "replace")) + CLOSING.to_bytes(4, "little")
            n = len(ids) // 4
            first = n % capacity or min(n, capacity)
            for k, start in enumerate([0, *range(first, n, capacity)]):
                end = first if not k else start + capacity
                yield doc_id, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])

    return common.map_docs(common.as_docs(docs), rows, PIECES, "doc_id")


def patterns(hist: np.ndarray, capacity: int, per_length: int = PER_LENGTH) -> np.ndarray:
    """Rows of up to four lengths, 0 for none, that add up to the capacity: for each length its commonest partners of each size."""
    have = np.flatnonzero(hist)
    common_first = have[np.argsort(-hist[have], kind="stable")]
    out = {(int(a), 0, 0, 0) for a in have if a == capacity}
    spread = common_first[:: max(1, len(common_first) // 64)][:64]
    for a in have[::-1].tolist():
        gap = capacity - a
        if gap and hist[gap]:
            out.add(tuple(sorted((a, gap, 0, 0), reverse=True)))
        found = 0
        for b in common_first.tolist():
            if b < gap and hist[gap - b]:
                out.add(tuple(sorted((a, b, gap - b, 0), reverse=True)))
                found += 1
                if found == per_length:
                    break
        found = 0
        for b in spread.tolist():
            for c in spread.tolist():
                if b + c < gap and hist[gap - b - c]:
                    out.add(tuple(sorted((a, b, c, gap - b - c), reverse=True)))
                    found += 1
                    break
            if found == per_length:
                break
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def nnls(pats: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths close to the histogram in squares; accelerated projected gradient."""
    h = hist.astype(np.float64)
    h[0] = 0
    used = pats > 0
    # A length's row of the matrix has one entry a pattern that holds it, so the largest row sum times four bounds the curvature.
    bound = 4.0 * np.bincount(pats[used], minlength=len(h)).max()
    x = np.zeros(len(pats))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        r = h - np.bincount(pats.ravel(), np.repeat(y, 4), minlength=len(h))
        r[0] = 0
        new = np.maximum(0, y + r[pats].sum(1) / bound)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); holds every piece of the histogram."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    pats = patterns(left, capacity)
    if len(pats):
        x = nnls(pats, left)
        for i in np.argsort(-x, kind="stable").tolist():
            if x[i] < 1:
                break
            p = pats[i][pats[i] > 0]
            kinds, times = np.unique(p, return_counts=True)
            if (n := int(min(int(x[i]), (left[kinds] // times).min()))) > 0:
                left[kinds] -= n * times
                out.append((tuple(p.tolist()), n))
    while len(have := np.flatnonzero(left)):
        row, gap, spare = [], capacity, left.copy()
        while len(have) and gap:
            k = int(np.searchsorted(have, gap, side="right")) - 1
            if k < 0:
                break
            a = int(have[k])
            if spare[gap - a] and gap - a != a and a != gap and left[gap - a] >= 1:
                row += [a, gap - a]
                gap = 0
                break
            row.append(a)
            gap -= a
            spare[a] -= 1
            if not spare[a]:
                have = np.delete(have, k)
        kinds, times = np.unique(row, return_counts=True)
        n = int((left[kinds] // times).min())
        left[kinds] -= n * times
        out.append((tuple(row), n))
    return out


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The places of each length in order: from the how-manieth piece of a length on, in which sequence and at what offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in planned:
        offset = 0
        for a in lengths:
            rows.append((a, taken.get(a, 0), sequence, offset))
            taken[a] = taken.get(a, 0) + n
            offset += a
        sequence += n
    rows.sort()
    return {k: np.array(v, np.int64) for k, v in zip(("length", "rank", "sequence", "offset"), zip(*rows, strict=True) if rows else [()] * 4, strict=True)}


def packed(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. cut_pieces has to give the same rows each time it is read (a written table)."""
    counts = cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts:
        hist[r.length] = r.n
    full, hist[capacity] = int(hist[capacity]), 0
    at = places(plan(hist, capacity))
    sequences = int(at["sequence"].max(initial=-1) + hist.sum() + 1)  # more than the plan has
    # A full piece is a sequence alone; any distinct numbers from there on do.
    alone = cut_pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id() + sequences, "offset": F.lit(0).cast("long")}) if full else None
    cut_pieces = cut_pieces.where(F.col("length") < capacity)
    parts = F.get(F.lit((1 + hist // PART).tolist()), F.col("length").cast("int"))
    dealt = cut_pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), parts))
    before = dealt.groupBy("length", "shard").agg(F.count("*").alias("n")).select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "shard"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    shift = 1 << 45

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = at["length"] * shift + at["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, length * shift + rank, side="right") - 1
            where = [pa.array(at["sequence"][i] + rank - at["rank"][i]), pa.array(at["offset"][i])]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), *where], [*b.schema.names[:5], "sequence_id", "offset"])

    rest = ranked.mapInArrow(placed, f"{PIECES}, sequence_id long, offset long")
    return rest.unionAll(alone.select(*rest.columns)) if alone is not None else rest


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = tokens.BYTE_BPE) -> DataFrame:
    return packed(common.cut(pieces(docs, capacity, tokenizer), "pieces"), capacity)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
