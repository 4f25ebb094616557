"""SentencePiece encoding and decoding by a relational lattice.

1. A text gets a leading mark, spaces become marks, and it is cut into words where no piece of the model can cross: before a mark
   that follows another character, and between letters and others. The cut is checked against the model when it is loaded.
2. Distinct words are exploded into substrings of at most HEAD characters; an equi-join with the first HEAD characters of the pieces (the
   vocabulary bounds their table, so it is broadcast) and, for longer pieces, a look at the rest of the piece leave the edges. A character
   that is no piece is an edge of its UTF-8 byte pieces.
   A piece that scores less than some way of spelling it by others is on no best path, so the table leaves it out (``useful``).
3. Edges are grouped by word and folded with ``aggregate``. The fold is Viterbi: the path with the greatest sum of the model's scores,
   of equal ones that with longer pieces at its end. One fold over the edges leaves the best score of each place, a second one
   back over them the path, whose edges are those that add up to these scores.
4. Documents take their words' ids. Words above a count that at most FREQUENT words reach are broadcast, and whole runs of them are
   encoded where the document lies. The other words, each of which stands less than (all occurrences / FREQUENT) times, are joined to
   their ids. Texts never cross the network.

The result has a row for each run of frequent words and one for each other word of a document: in order of ``word`` they give the
document's ids and, decoded from the ids, its text. ``encode`` and ``decode`` give a row for each document.

The public model is of BPE type. Its scores are merge ranks, and the library joins neighbours by rank instead of adding ranks, so its
ids differ from the best path's (README has figures).

A word is held in a row with its edges, up to the longest piece's length times its own, and the fold copies a number for each place
before each other one; that is nothing for words, and some seconds for a run of 100,000 letters.

Defined cases: a null or empty text has no words and gives one row with no ids and an empty text. Repeated rows give their rows again.
A null doc_id stays null. Columns other than doc_id and text are ignored. The mark itself in a text is decoded as a space.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

MARK = "▁"
WORD = f"{MARK}*(?:\\p{{L}}+|[^\\p{{L}}{MARK}]+)|{MARK}+"
FREQUENT = 500_000
#: So many first characters of a piece find it; few pieces that can be on a best path are longer.
HEAD = 4
MODEL = "piece_bpe_32k.model"
#: An edge is one long: the place where it stops, its length, and the id of its piece.
ID_BITS, LENGTH_BITS = 20, 8
ID = (1 << ID_BITS) - 1
#: Bytes of text that are cut into words at once; numbers of a batch have 32 bits, and what is used up goes before more is made.
BATCH_BYTES = 4 << 20
RUNS = "doc_id long, word int, n_words int, ids array<int>, text string"


@dataclass(frozen=True)
class Pieces:
    rows: list[tuple[str, int, float]]  # piece, id, score
    byte_ids: list[int]
    unknown: float  # score of a character that is no piece
    longest: int
    texts: list[str]  # by id, for decoding

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r[:2] for r in self.rows], "piece string, id int")

    @property
    def no_piece(self) -> int:
        """Stands for the id of a character that is no piece."""
        return len(self.texts)

    def scores(self) -> Column:
        by_id = dict((i, s) for _, i, s in self.rows)
        return F.from_json(F.lit(str([by_id.get(i, self.unknown) for i in range(self.no_piece + 1)])), "array<double>")

    def hexes(self) -> Column:
        """The bytes of each id, as hexadecimal digits."""
        of_byte = {i: f"{b:02X}" for b, i in enumerate(self.byte_ids)}
        return F.split(F.lit(",".join(of_byte.get(i) or t.encode().hex().upper() for i, t in enumerate(self.texts))), ",")


def load(path: str = MODEL) -> Pieces:
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path if "/" in path else public_tokenizers.path(path))
    n = m.get_piece_size()
    plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    rows = [(m.id_to_piece(i), i, float(m.get_score(i))) for i in plain]
    for piece, *_ in rows:
        body = piece.lstrip(MARK)
        if MARK in body or len({c.isalpha() for c in body}) > 1:
            raise ValueError(f"piece {piece!r} crosses a cut between words")
    longest = max(len(p) for p, *_ in rows)
    if longest >> LENGTH_BITS or n >= ID:
        raise ValueError("pieces don't fit an edge")
    usual = [s for *_, s in rows if s > -1e8]
    rows = useful(rows, min(usual) - 10)
    byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Pieces(rows, byte_ids, min(usual) - 10, longest, [m.id_to_piece(i) for i in range(n)])


def useful(rows: list[tuple[str, int, float]], unknown: float) -> list[tuple[str, int, float]]:
    """The pieces that can be on a best path: those that no spelling by two pieces or more beats. Single characters stay."""
    score = {p: s for p, _, s in rows}
    longest = max(map(len, score), default=0)

    def beaten(piece: str) -> bool:
        best = [0.0]
        for stop in range(1, len(piece) + 1):
            ways = (best[stop - n] + (score.get(piece[stop - n : stop], unknown if n == 1 else None) or 0.0) for n in range(1, min(stop, longest) + 1) if n < len(piece) and (n == 1 or piece[stop - n : stop] in score))
            best.append(max(ways))
        return best[-1] > score[piece]

    return [r for r in rows if len(r[0]) == 1 or not beaten(r[0])]


def edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """The columns of words, among them word, and edge: the lattice of each row's word, an edge as one long."""
    own = words.columns
    starts = words.select(*own, F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("start"))
    room = F.least(F.char_length("word") - F.col("start") + 1, F.lit(HEAD))
    cut = starts.select(*own, "start", F.explode(F.sequence(F.lit(1), room)).alias("length"))
    cut = cut.withColumn("part", F.substring("word", F.col("start"), F.col("length")))
    # The vocabulary bounds this side; the literal size check keeps a larger table from being broadcast. Equal 64-bit digests meet, which
    # a table of numbers finds faster, and a piece counts where it is equal itself.
    table = pieces.table(words.sparkSession).withColumn("key", F.xxhash64(F.substring("piece", 1, HEAD))).withColumn("size", F.char_length("piece"))
    met = cut.join(F.broadcast(table) if len(pieces.rows) <= 1 << 20 else table, F.xxhash64("part") == F.col("key"), "left")
    whole = F.when(F.col("size") <= HEAD, F.col("part")).otherwise(F.substring("word", F.col("start"), F.col("size")))
    met = met.withColumn("id", F.when(whole == F.col("piece"), F.col("id"))).where("id is not null or length = 1")
    size = F.when(F.col("id").isNull(), F.lit(1)).otherwise(F.col("size")).cast("long")
    packed = F.shiftleft(F.shiftleft(F.col("start") - 1 + size, LENGTH_BITS).bitwiseOR(size), ID_BITS).bitwiseOR(F.coalesce("id", F.lit(pieces.no_piece)).cast("long"))
    return met.select(*own, packed.alias("edge"))


def _stop(e: Column) -> Column:
    return F.shiftright(e, ID_BITS + LENGTH_BITS)


def _length(e: Column) -> Column:
    return F.shiftright(e, ID_BITS).bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))


def _id(e: Column) -> Column:
    return e.bitwiseAND(F.lit(ID))


def best_paths(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """The lattice's columns but edge, and path: the edges of the best way through each word's lattice, in order."""
    own = [c for c in lattice.columns if c != "edge"]
    grouped = lattice.groupBy(*own).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    scores = pieces.scores()
    kind = "struct<best:array<double>,now:double>"

    def step(acc: Column, e: Column) -> Column:
        # Edges come in order of their stop, and at each stop there is one of length 1, which comes first and closes the place before.
        score = F.get(scores, _id(e))
        ahead = F.struct(F.array_append(acc["best"], acc["now"]).alias("best"), (acc["now"] + score).alias("now"))
        also = F.struct(acc["best"].alias("best"), F.greatest(acc["now"], F.get(acc["best"], _stop(e) - _length(e)) + score).alias("now"))
        one = e.bitwiseAND(F.lit(((1 << LENGTH_BITS) - 1) << ID_BITS)) == 1 << ID_BITS
        return F.when(one, ahead).otherwise(also)

    first = F.struct(F.array().cast("array<double>").alias("best"), F.lit(0.0).alias("now")).cast(kind)
    summed = grouped.select(*own, "edges", F.aggregate("edges", first, step, lambda acc: F.array_append(acc["best"], acc["now"])).alias("best"))
    back_kind = "struct<at:long,path:array<long>>"

    def back(acc: Column, e: Column) -> Column:
        # Long edges of a stop come first here; the first one that adds up to the stop's score is on the path.
        start = acc["at"] - _length(e)
        adds_up = (_stop(e) == acc["at"]) & (F.get(F.col("best"), start) + F.get(scores, _id(e)) == F.get(F.col("best"), acc["at"]))
        return F.when(adds_up, F.struct(start.alias("at"), F.array_append(acc["path"], e).alias("path"))).otherwise(acc)

    end = F.struct((F.size("best") - 1).alias("at"), F.array().cast("array<long>").alias("path")).cast(back_kind)
    return summed.select(*own, F.aggregate(F.reverse("edges"), end, back, lambda acc: F.reverse(acc["path"])).alias("path"))


def encoded_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """The columns of words, ids and text of distinct words; text is decoded from ids."""
    byte_ids = F.from_json(F.lit(str(pieces.byte_ids)), "array<int>")

    def ids(e: Column) -> Column:
        raw = F.hex(F.encode(F.substring(F.col("word"), _stop(e).cast("int"), F.lit(1)), "utf-8"))
        pairs = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int")), lambda i: F.get(byte_ids, F.conv(F.substring(raw, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))
        return F.when(_id(e) == pieces.no_piece, pairs).otherwise(F.array(_id(e).cast("int")))

    spelled = F.exists("path", lambda e: _id(e) == pieces.no_piece)
    all_ids = F.when(spelled, F.flatten(F.transform("path", ids))).otherwise(F.transform("path", lambda e: _id(e).cast("int")))
    found = best_paths(edges(words, pieces), pieces).select(*words.columns, all_ids.alias("ids"))
    return found.withColumn("text", decoded(F.col("ids"), pieces))


def decoded(ids: Column, pieces: Pieces) -> Column:
    """The text of ids: byte pieces join to characters, marks become spaces."""
    hexes, plain = pieces.hexes(), F.from_json(F.lit(json.dumps(pieces.texts)), "array<string>")
    by_bytes = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), "")), "utf-8")
    low, high = min(pieces.byte_ids), max(pieces.byte_ids)  # all byte pieces lie between, and where others do they take the same way
    text = F.when(F.exists(ids, lambda i: (i >= low) & (i <= high)), by_bytes).otherwise(F.array_join(F.transform(ids, lambda i: F.get(plain, i)), ""))
    return F.translate(text, MARK, " ")


_pattern = []


def cut_words(text: str) -> list[str]:
    """The words of a text that has its marks."""
    if not _pattern:
        import regex

        _pattern.append(regex.compile(WORD))
    return _pattern[0].findall(text)


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words of each text, code of each word in order, distinct words by code) of texts without nulls.

    Where single spaces stand between the tokens of a text, tokens are cut apart from each other, a distinct one once. A text with an
    empty token (spaces stand otherwise, or it is empty) or with a mark of its own is cut as a whole.
    """
    lists = pc.split_pattern(texts, " ")
    tokens = lists.flatten().dictionary_encode()
    each, token = tokens.dictionary, tokens.indices.to_numpy()
    count = np.diff(lists.offsets.to_numpy())
    del lists, tokens
    odd = pc.or_(pc.equal(each, ""), pc.match_substring(each, MARK))
    is_odd = odd.to_numpy(zero_copy_only=False)
    # A token of letters is one word. Marks stand at the beginnings of tokens alone, so the words of all others are found in one string.
    alpha = pc.utf8_is_alpha(each)
    is_alpha = alpha.to_numpy(zero_copy_only=False)
    one, rest = each.filter(alpha), each.filter(pc.invert(pc.or_(alpha, odd)))
    found = pa.array(cut_words(MARK + MARK.join(rest.to_pylist())) if len(rest) else [], pa.string())
    del rest
    encoded = pa.concat_arrays([pc.binary_join_element_wise(MARK, one, ""), found]).dictionary_encode()
    opens, sizes = np.zeros(len(each), np.int32), np.ones(len(each), np.int32)
    opens[is_alpha] = np.arange(len(one))
    heads = np.flatnonzero(pc.starts_with(found, MARK).to_numpy(zero_copy_only=False))
    others = ~(is_alpha | is_odd)
    opens[others], sizes[others], sizes[is_odd] = len(one) + heads, np.diff(np.append(heads, len(found))), 0
    whole = np.zeros(len(texts), bool)
    if is_odd.any():
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), count)
        whole[doc[is_odd[token]]] = True
        token = token[~whole[doc]]
        count = np.where(whole, 0, count)
        del doc
    n = sizes[token]
    codes = encoded.indices.to_numpy()[_ranges(opens[token], n)] if len(token) else np.zeros(0, np.int32)
    sums = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=sums[1:])
    words = np.diff(sums[np.concatenate([[0], np.cumsum(count)])])
    del n, sums, token
    if not whole.any():
        return words, codes, encoded.dictionary
    known = {w: i for i, w in enumerate(encoded.dictionary.to_pylist())}
    more: dict[str, int] = {}
    parts, at = [], 0
    for i, ok in enumerate((~whole).tolist()):
        if ok:
            parts.append(codes[at : at + words[i]])
            at += words[i]
        elif text := texts[i].as_py():
            own = cut_words(MARK + text.replace(" ", MARK))
            words[i] = len(own)
            parts.append(np.array([known[w] if w in known else more.setdefault(w, len(known) + len(more)) for w in own], np.int32))
    return words, np.concatenate([np.zeros(0, np.int32), *parts]), pa.concat_arrays([encoded.dictionary, pa.array(list(more), pa.string())])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of starts[1], ..."""
    ends = np.cumsum(sizes, dtype=np.int32)  # of one batch
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
    out += np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    return out


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(batch, texts without nulls) of some BATCH_BYTES bytes each."""
    for b in batches:
        texts = pc.fill_null(b.column("text"), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(BATCH_BYTES, ends[-1] if len(ends) else 0, BATCH_BYTES)) + 1, [len(ends)]]))
        for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield b.slice(a, e - a), texts.slice(a, e - a)
            pa.default_memory_pool().release_unused()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all distinct words; they are counted where they lie first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _pieces_of(batches):
            _, codes, distinct = _cut(texts)
            yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, minlength=len(distinct)))], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass(frozen=True)
class Known:
    """Frequent words with their ids, one after another, and texts."""

    words: pa.Array
    ids: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    texts: pa.Array

    @staticmethod
    def of(table: pa.Table) -> Known:
        lists = table.column("ids").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
        return Known(table.column("word").combine_chunks(), lists.flatten().to_numpy(), np.cumsum(sizes) - sizes, sizes, table.column("text").combine_chunks())

    def places(self, distinct: pa.Array) -> np.ndarray:
        """The place of each word here, or -1."""
        return pc.fill_null(pc.index_in(distinct, self.words), -1).to_numpy()


def document_runs(docs: DataFrame, pieces: Pieces, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, word, n_words, ids, text): runs of words with their ids; word is the place of a run's first one."""
    docs = common.as_docs(docs)
    spark = docs.sparkSession
    counts = common.cut(word_counts(docs), "words")
    levels = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("words")).collect()  # at most 100,000 rows
    least, held = 1 << 62, 0
    for r in sorted(levels, key=lambda r: -r.n):
        held += r.words
        if held > frequent:
            break
        least = r.n
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Edges follow the order of their words, so that the sort before they are grouped has nothing left to do.
    dealt = counts.repartition(n, "word").sortWithinPartitions("word")
    table = common.cut(encoded_words(dealt, pieces), "pieces-of-words", [counts])
    known = spark.sparkContext.broadcast(Known.of(table.where(f"n >= {least}").select("word", "ids", "text").toArrow()))

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(ids of documents, words of each, codes, distinct words, place of each word among the known ones or -1)."""
        for b, texts in _pieces_of(batches):
            sizes, codes, distinct = _cut(texts)
            yield b.column("doc_id"), sizes, codes, distinct, known.value.places(distinct)[codes] if len(codes) else codes

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = known.value
        for doc, sizes, _, _, at in cut_batches(batches):
            row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            place = _ranges(np.zeros(len(sizes), np.int32), sizes)
            is_known = at >= 0
            at, row, place = at[is_known], row[is_known], place[is_known]
            opens = np.ones(len(at), bool)
            opens[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(opens)
            row, place = row[first], place[first]
            ends = np.append(first, len(at))
            n_ids = np.zeros(len(at) + 1, np.int32)
            np.cumsum(k.sizes[at], out=n_ids[1:])
            ids = pa.ListArray.from_arrays(pa.array(n_ids[ends]), pa.array(k.ids[_ranges(k.first[at], k.sizes[at])]))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), k.texts.take(pa.array(at))), "")
            names = ["doc_id", "word", "n_words", "ids", "text"]
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), pa.array(place), pa.array(np.diff(ends).astype(np.int32)), ids, texts], names)
            none = np.flatnonzero(sizes == 0)
            zero = pa.array(np.zeros(len(none), np.int32))
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(none)), zero, zero, pa.array([[]] * len(none), pa.list_(pa.int32())), pa.array([""] * len(none), pa.string())], names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, sizes, codes, distinct, at in cut_batches(batches):
            i = np.flatnonzero(at < 0)
            ends = np.cumsum(sizes)
            row = np.searchsorted(ends, i, side="right")
            place = i - (ends - sizes)[row]
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), pa.array(place.astype(np.int32)), distinct.take(pa.array(codes[i]))], ["doc_id", "word", "w"])

    rare = docs.mapInArrow(others, "doc_id long, word int, w string")
    spelled = table.where(f"n < {least}").select(F.col("word").alias("w"), "ids", "text")
    rest = rare.join(spelled, "w").select("doc_id", "word", F.lit(1).alias("n_words"), "ids", "text")
    return docs.mapInArrow(runs, RUNS).unionAll(rest)


def encode(docs: DataFrame, pieces: Pieces, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, ids): the ids of each document's text, in order. Rows need distinct doc_ids."""
    runs = document_runs(docs, pieces, frequent)
    return runs.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("word", "ids"))), lambda x: x["ids"])).alias("ids"))


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); the leading mark goes."""
    return encoded.select("doc_id", F.substring(decoded(F.col("ids"), pieces), 2, (1 << 31) - 1).alias("text"))


def op6_piece_lattice(spark, sf_dir: str) -> DataFrame:
    runs = document_runs(common.table(spark, sf_dir, "documents"), load())
    return runs.select("doc_id", "word", "n_words", F.size("ids").alias("n_pieces"), "ids", "text")
