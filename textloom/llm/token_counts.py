"""Token counts from flat token files: a scan for end-of-document ids.

A flat file is a run of big-endian 16-bit ids, each document closed by END, with no index and no header. END lies outside the
vocabulary, and its two bytes are the UTF-8 form of one character, so Spark's text writer can lay such files down on any store with
that character as line separator.

A file holds up to PACKS packs, and a pack documents of PACK_BYTES bytes together or one longer document; so a file's size is
bounded by its packs, however long documents are, and files are what machines take in parallel. A file over Spark's limit for one
value (2 GiB; only a text of 128 MiB of ids or more gets there) is an error.

Reading cuts every file into blocks, searches each block's ids for END at once, and stitches documents that span blocks by a prefix
scan: what the blocks before have as last separator and as number of separators gives each block its carry. Only positions of
separators are shuffled, keyed by file. The same scan over the files of a partition gives a document's place in it, by which it is
told which one it is; a document without a partner on either side is an error, so none is lost.

Defined cases: a null or empty text is a document of no tokens. A file that does not end in END gives its tail as a last document,
not closed. Blocks may cut a document anywhere. Empty files give nothing. Repeated rows are documents of their own.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common, tokens

END = 0xC580
SEPARATOR = END.to_bytes(2, "big").decode()
BLOCK_BYTES, PACK_BYTES, PACKS = 1 << 20, 1 << 20, 8


def write_token_files(docs: DataFrame, path: str, tokenizer: str = tokens.BYTE_BPE, pack_bytes: int = PACK_BYTES, packs: int = PACKS) -> DataFrame:
    """Write docs as flat files of up to so many packs; returns (part, ordinal, doc_id), the order in which they were written.

    docs has to be a table that is read, not computed, so that both passes see the same order.
    """

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        encode = tokens.encoder(tokenizer, ">u2").encode
        held, size, end = [], 0, END.to_bytes(2, "big")
        for (text,) in docs:
            ids = encode(text.decode("utf-8", "replace"))
            if held and size + len(ids) > pack_bytes:
                yield (end.join(held),)
                held, size = [], 0
            held.append(ids)
            size += len(ids) + 2
        if held:
            yield (end.join(held),)

    ids = common.map_docs(docs, rows, "ids binary", batch=4)
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", packs).text(path)
    return docs.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"), "doc_id")


def blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, n_ids, ends): for each block the positions in its file of the END ids."""
    if block_bytes % 2:
        raise ValueError("a block holds whole ids")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 1")
    files = files.withColumn("length", F.when(F.col("length") < (1 << 31) - 1, F.col("length")).otherwise(F.raise_error(F.lit("a token file of 2 GiB or more"))))
    n = F.ceil(F.col("length") / block_bytes).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("content"), i * block_bytes + 1, F.lit(block_bytes)))
    cut = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(pieces).alias("block", "bytes"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = np.frombuffer(b.column(2)[k].as_buffer(), ">u2", b.column(2)[k].as_buffer().size // 2)
                ends = np.flatnonzero(ids == END) + b.column(1)[k].as_py() * (block_bytes // 2)
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1], b.column(1)[k : k + 1], pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "n_ids", "ends"])

    return cut.mapInArrow(search, "file string, block int, n_ids long, ends array<long>")


def documents(found: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document; start is the place of its first id in the file."""
    latest = F.get("ends", F.size("ends") - 1)  # null for a block without END
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    scanned = found.select(
        "file",
        "ends",
        F.coalesce(F.max(latest).over(before), F.lit(-1)).alias("last"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long").alias("seen"),
        (F.coalesce(F.sum("n_ids").over(before), F.lit(0)) + F.col("n_ids")).alias("stop"),
        F.coalesce(F.sum(F.lit(1)).over(after), F.lit(0)).alias("more"),
    )
    closed = scanned.select("file", "seen", F.array_insert("ends", 1, F.col("last")).alias("at"), F.posexplode("ends").alias("i", "end"))
    start = F.get("at", F.col("i")) + 1
    closed = closed.select("file", (F.col("seen") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = F.coalesce(latest, F.col("last")) + 1
    opened = scanned.where((F.col("more") == 0) & (tail < F.col("stop"))).select("file", (F.col("seen") + F.size("ends")).alias("ordinal"), tail.alias("start"), (F.col("stop") - tail).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionAll(opened)


def token_counts(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return documents(blocks(spark, path, block_bytes))


def counted_documents(docs: DataFrame, path: str, **sizes: int) -> DataFrame:
    """(doc_id, part, ordinal, start, n_tokens, closed) of each row of docs, written to path as token files and counted there.

    ordinal is the row's place in its partition, start that of its first id in its file.
    """
    order = write_token_files(docs, path, **sizes)
    found = common.cut(blocks(docs.sparkSession, path), "separators")
    part, number = (F.regexp_extract("file", r"^part-(\d+)-.*-c(\d+)", k).cast("int") for k in (1, 2))
    files = found.groupBy("file").agg(F.sum(F.size("ends")).alias("n")).withColumns({"part": part, "number": number})
    before = files.select("file", "part", (F.sum("n").over(Window.partitionBy("part").orderBy("number")) - F.col("n")).alias("before"))
    counted = documents(found).join(before, "file").select("part", (F.col("ordinal") + F.col("before")).alias("ordinal"), "start", "n_tokens", "closed")
    met = counted.join(order.withColumn("known", F.lit(True)), ["part", "ordinal"], "full_outer")
    sure = F.when(F.col("known") & F.col("n_tokens").isNotNull(), F.col("part")).otherwise(F.raise_error(F.lit("a document has no partner: the table was read in another order")).cast("int"))
    return met.select("doc_id", sure.alias("part"), "ordinal", "start", "n_tokens", "closed")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return counted_documents(common.table(spark, sf_dir, "documents"), common.new_path(spark, "token-files"))
