"""Substring dedup: hashes of lines and of phrases within lines, grouped globally; the earliest occurrence stays.

A unit is a run of words: a whole line, and within lines phrases cut after word pairs that a hash picks, so that the same passage
is cut alike wherever it stands in a line. A unit is taken lower-cased, its words joined by single spaces. Occurrences are ranked
by (doc_id, position); all but the first are repeats. Removed are

* lines of MIN_LINE words or more that repeat,
* unbroken runs of repeated phrases of MIN_RUN words or more, over line ends too, and
* every passage of PASSAGE words or more that also stands in a document with a smaller doc_id, or that starts PASSAGE words or more
  earlier in its own, however lines are broken in either.

Passages meet by anchors: in every PASSAGE words the GRAM words with the least hash are an anchor, so that documents that share a
passage share its anchors. Where the words around an anchor (all passages of PASSAGE words that hold it) stand in an earlier document
as they are, all of them go; of anchors that stand among different words, each passage of PASSAGE words is looked up by its own digest.

What is left keeps its bytes; the removed spans are byte offsets in the input.

Only (digest, doc_id) travels, a row for each distinct unit, anchor and passage of a document, and aggregation takes a hot digest in
parts; the text crosses the network once, to meet the digests that its document has to give up, and once more for documents with
anchors among different words.

Defined cases: a null or empty text has no units and gives back an empty text; repeated rows of a doc_id are one document, so
none of its rows loses a unit to another; a row without doc_id neither gives nor loses units. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common

MIN_LINE, MIN_RUN, PHRASE = 8, 20, 6
PASSAGE, GRAM = 50, 8
SIDE = PASSAGE - GRAM  # words on each side of an anchor that a passage with it can hold
PLACE = np.uint64((1 << 28) - 1)
#: The lower two bits of a digest tell what it is of.
UNIT, ANCHOR, WINDOW, AROUND = (np.uint64(k) for k in range(4))
SCHEMA = "doc_id long, n_units long, n_removed_units long, n_removed long, starts array<long>, ends array<long>, kept_text binary"


def units(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first byte, end byte, words, is a line) of each phrase, then of each line of MIN_LINE words or more; in order of position."""
    return _units(text, *common.word_hashes(text.translate(common.LOWER_SPACE)))


def _units(text: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    n = len(h)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z.astype(bool)
    new_line = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    line = np.searchsorted(new_line, starts)
    cut = np.ones(n, bool)  # a unit ends after this word
    same = line[1:] == line[:-1]
    pair = common.mixed(h[:-1] * common.MIX1 + h[1:])
    cut[:-1] = ~same
    cut[1:-1] |= pair[:-1] % np.uint64(PHRASE) == 0
    out = [_cut_units(h, starts, ends, cut, 0)]
    whole = np.ones(n, bool)
    whole[:-1] = ~same
    d, a, b, w, f = _cut_units(h, starts, ends, whole, 1)
    long = w >= MIN_LINE
    out.append((d[long], a[long], b[long], w[long], f[long]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cut_units(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, cut: np.ndarray, kind: int):
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(h)) - np.repeat(first, last - first + 1)
    power, _ = common._powers_to(len(h))
    sums = np.add.reduceat(h * power[place], first)
    return _kind(common.mixed(sums + np.uint64(kind + 1)), UNIT), starts[first], ends[last], last - first + 1, np.full(len(last), bool(kind))


def _kind(digest: np.ndarray, kind: np.uint64) -> np.ndarray:
    return (digest & ~np.uint64(3)) | kind


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of anchors, their digests, digests of the words around them, digest of each passage of PASSAGE words) of word hashes."""
    n = len(h)
    if n < PASSAGE:
        z = np.zeros(0, np.uint64)
        return z.astype(np.int64), z, z, z
    power, inverse = common._powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=sums[1:])
    runs = lambda size: common.mixed((sums[size:] - sums[: n - size + 1]) * inverse[: n - size + 1])
    grams = runs(GRAM)
    v = (grams & ~PLACE) | (PLACE - np.arange(len(grams), dtype=np.uint64))
    size, wanted = 1, SIDE + 1
    while 2 * size <= wanted:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < wanted:
        v = np.minimum(v[: len(v) - (wanted - size)], v[wanted - size :])
    at = (PLACE - (v & PLACE)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    a, e = around(at, n)
    near = common.mixed((sums[e] - sums[a]) * inverse[a] + (at - a).astype(np.uint64) * np.uint64(1009) + (e - at).astype(np.uint64))
    return at, _kind(grams[at], ANCHOR), _kind(near, AROUND), _kind(runs(PASSAGE), WINDOW)


def around(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of what is around each anchor in a text of n words."""
    return np.maximum(at - SIDE, 0), np.minimum(at + GRAM + SIDE, n)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places the intervals cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): each document's distinct units, and its distinct pairs of an anchor and the words around it as two rows."""

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, text in docs:
            words = common.word_hashes(text.translate(common.LOWER_SPACE))
            _, anchor, near, _ = anchors(words[0])
            near, i = np.unique(near, return_index=True)
            yield doc_id, np.concatenate([common.distinct(_units(text, *words)[0]), anchor[i], near]).view(np.int64)

    per_doc = common.map_docs(docs, rows, "doc_id long, d array<long>", "doc_id")
    return per_doc.select("doc_id", F.explode("d").alias("digest"))


def windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, digest): each document's distinct passages of PASSAGE words that hold an anchor which stands among different words somewhere.

    Where all around an anchor goes, none of its passages is the first.
    """
    found = found.where("open > 0").select(F.col("doc_id").alias("key"), "gone", F.col("seeds.digest").alias("seeds"), F.col("seeds.n").alias("counts"))
    met = docs.join(found, F.col("doc_id") == F.col("key")).select("doc_id", "text", "gone", "seeds", "counts")

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, gone, seeds, counts, text in docs:
            at, anchor, near, window = anchors(common.word_hashes(text.translate(common.LOWER_SPACE))[0])
            count = dict(zip(seeds, counts, strict=True))
            lost = set(gone)
            pairs = zip(anchor.view(np.int64).tolist(), near.view(np.int64).tolist(), strict=True)
            at = at[np.array([count.get(x, 1) > count.get(y, 1) and y not in lost for x, y in pairs], bool)]
            held = _covered(len(window), np.maximum(at - SIDE, 0), np.minimum(at + 1, len(window)))
            yield doc_id, common.distinct(window[held]).view(np.int64)

    per_doc = common.map_docs(met, rows, "doc_id long, d array<long>", "doc_id", "gone", "seeds", "counts", batch=500)
    return per_doc.select("doc_id", F.explode("d").alias("digest"))


def _passages(h: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each unbroken run of words in passages that stand earlier, in another document (gone) or in this one."""
    n = len(h)
    at, anchor, near, window = anchors(h)
    a, e = around(at, n)
    whole = _among(near, gone)
    a, e = a[whole], e[whole]
    repeat = _among(window, gone)
    if len(np.unique(anchor)) < len(anchor):  # a passage that stands twice has its anchor twice
        _, first, number = np.unique(window, return_index=True, return_inverse=True)
        repeat |= np.arange(len(window)) - first[number] >= PASSAGE
    s = np.flatnonzero(repeat)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], _covered(n, np.concatenate([a, s]), np.concatenate([e, s + PASSAGE])).astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def without(text: bytes, gone: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(units, removed units, starts, ends of the removed spans); gone: the sorted digests whose first occurrence is in an earlier document."""
    h, first_byte, end_byte = common.word_hashes(text.translate(common.LOWER_SPACE))
    d, a, b, words, is_line = _units(text, h, first_byte, end_byte)
    if not len(d):
        return 0, 0, a, b
    repeat = _among(d, gone)
    _, first = np.unique(d, return_index=True)  # phrases stand in order, and so do lines
    later = np.ones(len(d), bool)
    later[first] = False
    repeat |= later
    phrase = ~is_line
    r, w = repeat[phrase], words[phrase]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], r.astype(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(w)])
    pa, pb = a[phrase], b[phrase]
    spans = [(pa[i], pb[j - 1]) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if total[j] - total[i] >= MIN_RUN]
    lines = is_line & repeat
    first_word, last_word = _passages(h, gone)
    spans = sorted([*spans, *zip(a[lines], b[lines], strict=True), *zip(first_byte[first_word], end_byte[last_word], strict=True)])
    merged: list[list[int]] = []
    for x, y in spans:
        if merged and x <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], int(y))
        else:
            merged.append([int(x), int(y)])
    s = np.array(merged, np.int64).reshape(-1, 2)
    inside = np.searchsorted(s[:, 0], a[phrase], side="right") - 1
    hit = (inside >= 0) & (b[phrase] <= s[np.maximum(inside, 0), 1]) if len(s) else np.zeros(int(phrase.sum()), bool)
    return int(phrase.sum()), int(hit.sum()), s[:, 0], s[:, 1]


def deduped(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts of phrases and bytes, the removed spans and the bytes that are left."""
    docs = common.as_docs(docs)
    d = digests(docs.where("doc_id is not null"))
    shared = d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").withColumnRenamed("digest", "k")
    kind = F.col("digest").bitwiseAND(F.lit(3))
    earlier = (F.col("doc_id") > F.col("first")) & (kind != int(ANCHOR))
    # An anchor counts once for each of the words around it, so its count and theirs are equal only where it always stands among the same.
    more = F.when(kind == int(ANCHOR), F.col("n")).when(kind == int(AROUND), -F.col("n")).otherwise(0)
    found = d.join(shared, F.col("digest") == F.col("k")).where(earlier | (kind != int(UNIT))).groupBy("doc_id").agg(
        F.collect_set(F.when(earlier, F.col("digest"))).alias("gone"), F.collect_list(F.when(kind != int(UNIT), F.struct("digest", "n"))).alias("seeds"), F.sum(more).alias("open")
    )
    found = common.cut(found.withColumn("seeds", F.when(F.col("open") > 0, F.col("seeds"))), "found")
    w = common.cut(windows(docs, found), "windows")
    twice = w.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").withColumnRenamed("digest", "k")
    passages = w.join(twice, F.col("digest") == F.col("k")).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("more"))
    passages = passages.withColumnRenamed("doc_id", "other")
    lost = found.join(passages, F.col("doc_id") == F.col("other"), "left").select(F.col("doc_id").alias("key"), F.concat("gone", F.coalesce("more", F.array().cast("array<long>"))).alias("gone"))
    met = docs.join(lost, F.col("doc_id") == F.col("key"), "left").select("doc_id", "text", "gone")

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, gone, text in docs:
            n, m, a, b = without(text, np.sort(np.array(gone if gone is not None else [], np.int64).view(np.uint64)))
            yield doc_id, n, m, int((b - a).sum()), a, b, left_over(text, a, b)

    return common.map_docs(met, rows, SCHEMA, "doc_id", "gone", batch=500)


def left_over(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The text without its spans."""
    keep, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        keep.append(text[at:a])
        at = b
    return b"".join([*keep, text[at:]])


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduped(common.table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("starts", lambda x, i: F.concat_ws("-", x, F.get("ends", i))), ",")
    return out.select("doc_id", "n_units", "n_removed_units", F.col("n_removed").alias("n_removed_bytes"), F.size("starts").cast("long").alias("n_spans"), spans.alias("spans"), F.decode("kept_text", "utf-8").alias("text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with what is left of each text; a document that lost all of its words goes. n_chars, where it is a column, follows the text."""
    left = deduped(docs).where("n_removed > 0").select(F.col("doc_id").alias("__key"), F.col("kept_text").cast("string").alias("__text"), F.col("n_units").alias("__n"), F.col("n_removed_units").alias("__m"))
    left = left.dropDuplicates(["__key"])
    met = docs.join(left, docs["doc_id"].cast("long") == F.col("__key"), "left").where("__m is null or __m < __n")
    text = F.coalesce(F.col("__text"), docs["text"])
    put = {"text": text} | ({"n_chars": F.when(F.col("__text").isNotNull(), F.char_length("__text")).otherwise(docs["n_chars"]).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return met.select(*(put[c].alias(c) if c in put else docs[c] for c in docs.columns))
