"""Suffix dedup: removes every byte covered by a MATCH-byte string that also starts in a document with a smaller doc_id.

The named method, external induced sorting of a whole suffix array, is not what runs here (README, with figures). Only order by the
first MATCH bytes of suffixes matters, and only where they repeat, so suffixes meet as follows:

1. Texts that are equal to that of a smaller document go whole; texts shorter than MATCH lose nothing.
2. Anchors: in every run of MATCH bytes the GRAM-byte string with the least hash, of equal ones the last, is an anchor. Equal runs
   have their anchor at the same place, wherever they stand, so two documents that share a run share an anchor. A run holds its
   anchor and SIDE bytes more, so it holds HALF bytes on one side of it at least.
3. Anchors meet by hash. Where the bytes around an anchor (all runs that hold it) have been seen in a smaller document, all of
   them go; this settles the inside of repeats by digests alone. Of the others, those that share HALF bytes on a side with another
   document are compared: a table of their surroundings is sorted by each of the MATCH - GRAM + 1 runs that hold the anchor,
   which gives the least document of each run.
4. The spans of a document are merged and cut out. A span goes with a digest of its bytes and is laid on a row only if the row has
   these bytes there, so that rows that repeat a doc_id with other texts keep theirs.

Each phase is written before the next one begins, so that the disk holds one phase's shuffle files at a time.

Defined cases: a null or empty text loses nothing; rows with equal doc_id take nothing from each other, whether their texts are equal
or not; rows without doc_id are left out. Overlaps count. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common

MATCH, GRAM = 50, 12
WINDOW = MATCH - GRAM + 1
SIDE = MATCH - GRAM  # bytes on each side of an anchor that a run with it can hold
HALF = SIDE // 2
AROUND = 2 * SIDE + GRAM
#: The lower bits of a hash, in place of which windows that are searched at once hold their places.
NEAR = np.uint64((1 << 16) - 1)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def _words(text: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as a number."""
    out = np.empty(len(text) - 7, np.uint64)
    for k in range(min(8, len(out))):
        part = out[k::8]
        part[:] = np.frombuffer(text, "<u8", len(part), k)
    return out


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text of MATCH bytes or more."""
    x = _words(text)
    h = (x[: len(text) - GRAM + 1] * common.MIX1) ^ (x[GRAM - 8 :] * common.MIX2)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(30)
    at = [_least(h[a : a + STEP + WINDOW - 1]) + a for a in range(0, max(1, len(h) - WINDOW + 1), STEP)]
    at = np.concatenate(at)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


#: Windows that are searched at once.
STEP = int(NEAR) - WINDOW + 2


def _least(h: np.ndarray) -> np.ndarray:
    """Place of the least hash (without its lower bits) of each window, of equal ones the last; for up to STEP windows."""
    v = (h & ~NEAR) | (NEAR - np.arange(len(h), dtype=np.uint64))
    size = 1
    while 2 * size <= WINDOW:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < WINDOW:
        v = np.minimum(v[: len(v) - (WINDOW - size)], v[WINDOW - size :])
    return (NEAR - (v & NEAR)).astype(np.int64)


def _sums(b: np.ndarray) -> np.ndarray:
    power, _ = common._powers_to(b.shape[-1])
    sums = np.zeros((*b.shape[:-1], b.shape[-1] + 1), np.uint64)
    np.cumsum(common._BYTE[b] * power[: b.shape[-1]], axis=-1, out=sums[..., 1:])
    return sums


def _digests(sums: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Digests of the bytes from a to e of a text, the same wherever they stand."""
    _, inverse = common._powers_to(len(sums))
    return common.mixed((sums[e] - sums[a]) * inverse[a] + (e - a).astype(np.uint64))


def surroundings(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A digest of the bytes within SIDE of each anchor, and of how much of them the text has."""
    a, e = np.maximum(at - SIDE, 0), np.minimum(at + GRAM + SIDE, len(sums) - 1)
    return common.mixed(_digests(sums, a, e) + (at - a).astype(np.uint64) * np.uint64(1009))


def halves(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits of a digest of the HALF bytes before each anchor and 32 of those after it; 0 where the text has fewer."""
    n = len(sums) - 1
    low = np.uint64(0xFFFFFFFF)
    left = np.where(at < HALF, np.uint64(0), _digests(sums, np.maximum(at - HALF, 0), at) & low | np.uint64(1))
    right = np.where(at + GRAM + HALF > n, np.uint64(0), _digests(sums, np.minimum(at + GRAM, n), np.minimum(at + GRAM + HALF, n)) & low | np.uint64(1))
    return left << np.uint64(32) | right


ANCHORS = "anchor long, doc_id long, place int, around long, sides long"


def anchor_rows(docs: DataFrame) -> DataFrame:
    """A row for each anchor: the hash of its GRAM bytes, its place, and digests of its surroundings and of what is on each side."""
    names = [x.split()[0] for x in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for doc_id, text in [*common.text_rows(b, "text", "doc_id"), (None, b"")]:
                if len(text) >= MATCH:
                    at, h = anchors(text)
                    sums = _sums(np.frombuffer(text, np.uint8))
                    held.append((h.view(np.int64), np.full(len(h), doc_id, np.int64), at.astype(np.int32), surroundings(sums, at).view(np.int64), halves(sums, at).view(np.int64)))
                    size += len(h)
                if held and (size > 100_000 or doc_id is None):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                    held, size = [], 0

    return docs.where(F.octet_length("text") >= MATCH).mapInArrow(run, ANCHORS)


def _extremes(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest document among the rows with each row's key."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    starts, group = np.flatnonzero(head), np.cumsum(head) - 1
    least, most = np.empty_like(doc), np.empty_like(doc)
    least[order] = np.minimum.reduceat(d, starts)[group]
    most[order] = np.maximum.reduceat(d, starts)[group]
    return least, most


def _by_anchor(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches sorted by their first column as tables of some size rows in which every value of it is whole."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        h = b.column(0).to_numpy()
        if n >= size and h[0] != h[-1]:  # all before the last value of this batch is complete
            stop = int(np.searchsorted(h, h[-1]))
            yield pa.Table.from_batches([*held[:-1], b.slice(0, stop)])
            held = [b.slice(stop)]
            n = held[0].num_rows
    if n:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor")


def met(rows: DataFrame) -> DataFrame:
    """(doc_id, place, around, anchor) of anchors that two documents have: anchor is null where all around it goes, else its runs are to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_anchor(batches, 500_000):
            h, doc, place, around, sides = (t.column(k).to_numpy() for k in range(5))
            least, most = _extremes(h, doc)
            i = np.flatnonzero(least < most)
            if not len(i):
                continue
            h, doc, place, around, sides = (x[i] for x in (h, doc, place, around, sides))
            base = common.mixed(h.view(np.uint64))
            least, _ = _extremes(common.mixed(base ^ around.view(np.uint64)), doc)
            whole, edge = doc > least, np.zeros(len(doc), bool)
            for k, side in enumerate((sides.view(np.uint64) >> np.uint64(32), sides.view(np.uint64) & np.uint64(0xFFFFFFFF))):
                least, most = _extremes(common.mixed(base + side * np.uint64(2) + np.uint64(k)), doc)
                edge |= (side > 0) & (least < most)
            keep = whole | edge
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(place[keep]), pa.array(around[keep]), pa.array(h[keep], mask=whole[keep])], ["doc_id", "place", "around", "anchor"])

    return _dealt(rows).mapInArrow(run, "doc_id long, place int, around long, anchor long")


def edge_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(anchor, doc_id, place, around): the bytes around the anchors whose runs are to be compared; around starts with the number of bytes missing on its left."""
    lists = found.where("anchor is not null").groupBy("doc_id").agg(F.collect_list(F.struct("place", "anchor", "around")).alias("at")).withColumnRenamed("doc_id", "key")
    near = docs.join(lists, F.col("doc_id") == F.col("key")).select("doc_id", "text", *(F.col(f"at.{c}").alias(f"{c}s") for c in ("place", "anchor", "around")))

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, places, hashes, arounds, text in docs:
            p = np.array(places, np.int64)
            own = p + GRAM <= len(text)  # a place may be of another text with this doc_id
            own[own] = surroundings(_sums(np.frombuffer(text, np.uint8)), p[own]) == np.array(arounds, np.int64)[own].view(np.uint64)
            for p, h, ok in zip(places, hashes, own.tolist(), strict=True):
                if ok:
                    a = max(0, p - SIDE)
                    yield h, doc_id, p, bytes([SIDE - (p - a)]) + text[a : p + GRAM + SIDE]

    return common.map_docs(near, rows, "anchor long, doc_id long, place int, around binary", "doc_id", "places", "anchors", "arounds", batch=10_000)


def edge_spans(edges: DataFrame) -> DataFrame:
    """(doc_id, start, stop, digest): for each anchor the bytes in those of its runs that a smaller document has too; these runs all overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_anchor(batches, 50_000):
            h, doc, place = (t.column(k).to_numpy() for k in range(3))
            around = t.column(3).to_pylist()
            m = len(h)
            b = np.zeros((m, AROUND), np.uint8)
            first = np.array([x[0] for x in around])
            last = first + np.array([len(x) - 1 for x in around])
            for i, x in enumerate(around):
                b[i, first[i] : last[i]] = np.frombuffer(x, np.uint8, len(x) - 1, 1)
            sums = _sums(b)
            _, inverse = common._powers_to(AROUND)
            base = common.mixed(h.view(np.uint64))
            start, stop = np.full(m, AROUND), np.zeros(m, np.int64)
            for o in range(WINDOW):  # the run that starts at byte o of the surroundings
                ok = np.flatnonzero((first <= o) & (last >= o + MATCH))
                if len(ok) < 2:
                    continue
                key = common.mixed((sums[ok, o + MATCH] - sums[ok, o]) * inverse[o] ^ base[ok])
                hit = ok[doc[ok] > _extremes(key, doc[ok])[0]]
                start[hit] = np.minimum(start[hit], o)
                stop[hit] = o + MATCH
            i = np.flatnonzero(stop)
            digest = common.mixed((sums[i, stop[i]] - sums[i, start[i]]) * inverse[start[i]] + (stop[i] - start[i]).astype(np.uint64))
            at = place[i] - SIDE
            yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(at + start[i]), pa.array(at + stop[i]), pa.array(digest.view(np.int64))], ["doc_id", "start", "stop", "digest"])

    return _dealt(edges).mapInArrow(run, "doc_id long, start long, stop long, digest long")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: bytes, removed bytes and spans, and the SHA-256 of what is left."""
    docs = common.as_docs(docs).where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    f1, f2 = F.xxhash64("text"), F.xxhash64(F.md5(F.encode("text", "utf-8")))
    prints = docs.select("doc_id", f1.alias("f1"), f2.alias("f2"))
    twice = prints.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(F.col("f1").alias("k1"), F.col("f2").alias("k2"), "least")
    copies = prints.join(twice, (F.col("f1") == F.col("k1")) & (F.col("f2") == F.col("k2")) & (F.col("doc_id") > F.col("least"))).select("doc_id", "f1").distinct()
    copies = common.cut(copies, "copies")
    # Few documents are copies: the others are told by a bitmap, without a shuffle of their texts.
    maybe, no = common.sifted(docs, copies.select("doc_id"))
    is_copy = (F.col("doc_id") == F.col("key")) & (f1 == F.col("kf"))
    ids = copies.select(F.col("doc_id").alias("key"), F.col("f1").alias("kf"))
    firsts = no.unionAll(maybe.join(ids, is_copy, "left_anti"))
    found = common.cut(met(anchor_rows(firsts)), "anchors")
    spans = common.cut(edge_spans(edge_rows(firsts, found)), "spans")
    whole = found.where("anchor is null").select("doc_id", F.col("place").cast("long").alias("start"), F.lit(-1).cast("long").alias("stop"), F.col("around").alias("digest"))
    lists = whole.unionAll(spans).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "digest")).alias("at")).withColumnRenamed("doc_id", "key")
    left = firsts.join(lists, F.col("doc_id") == F.col("key"), "left").select("doc_id", "text", *(F.col(f"at.{c}").alias(f"{c}s") for c in ("start", "stop", "digest")))

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, starts, stops, digests, text in docs:
            a, e = _laid(text, np.array(starts or [], np.int64), np.array(stops or [], np.int64), np.array(digests or [], np.int64).view(np.uint64))
            s, e = _union(a, e)
            kept = hashlib.sha256()
            at = 0
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                kept.update(text[at:x])
                at = y
            kept.update(text[at:])
            yield doc_id, len(text), int((e - s).sum()), len(s), kept.hexdigest(), s, e

    n = F.octet_length("text").cast("long")
    long = n >= MATCH
    zero = lambda x: F.when(long, F.array(x)).otherwise(F.array().cast("array<long>"))
    sha = F.when(long, F.lit(hashlib.sha256().hexdigest())).otherwise(F.sha2(F.encode("text", "utf-8"), 256))
    gone = maybe.join(ids, is_copy, "left_semi").select("doc_id", n.alias("n_bytes"), F.when(long, n).otherwise(0).alias("n_removed"), long.cast("long").alias("n_spans"), sha.alias("kept_sha256"), zero(F.lit(0).cast("long")).alias("starts"), zero(n).alias("ends"))
    return common.map_docs(left, rows, SCHEMA, "doc_id", "starts", "stops", "digests").unionAll(gone)


def _laid(text: bytes, start: np.ndarray, stop: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the spans whose digests are those of the text's bytes there; stop is -1 for all that is around an anchor."""
    if not len(start):
        return start, stop
    sums = _sums(np.frombuffer(text, np.uint8))
    fits = np.where(stop < 0, start + GRAM, stop) <= len(text)
    start, stop, digest = start[fits], stop[fits], digest[fits]
    whole = stop < 0
    own = np.zeros(len(start), bool)
    own[whole] = surroundings(sums, start[whole]) == digest[whole]
    own[~whole] = _digests(sums, start[~whole], stop[~whole]) == digest[~whole]
    a = np.where(whole, np.maximum(start - SIDE, 0), start)
    e = np.where(whole, np.minimum(start + GRAM + SIDE, len(text)), stop)
    return a[own], e[own]


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of a union; spans that touch are one."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.concatenate([[True], a[1:] > b[:-1]])
    return a[head], b[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(a) - 1]])]


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(common.table(spark, sf_dir, "documents"))
    return out.drop("starts", "ends")
