"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, and the ASCII white space \t \n \v \f \r to a space.
LOWER_SPACE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset a new local one (tests)."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not _own_dir:
        _own_dir.append(f"file://{tempfile.mkdtemp(prefix='textloom-')}")
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark removes a query's shuffle files when the query ends, where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, after: Iterable[DataFrame] = ()) -> DataFrame:
    """Write df to the shared folder and read it again, so that a lost executor costs no recomputation of what came before.

    What is written needs no shuffle file any more, so these go at once. after: results of cut that nothing else reads; they go too.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path := new_path(spark, name))
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    for done in after:
        drop_path(spark, done.written_at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a batch whose texts are Python objects at the same time.
ROWS = 200


def text_rows(batch: pa.RecordBatch, text: str = "text", *keys: str) -> Iterator[tuple]:
    """(key values..., text as bytes) of each row; a null text is empty."""
    for i in range(0, batch.num_rows, ROWS):
        part = batch.slice(i, ROWS)
        texts = part.column(text).cast(pa.binary())
        yield from zip(*(part.column(k).to_pylist() for k in keys), (x or b"" for x in texts.to_pylist()), strict=True)


def trim() -> None:
    """What this process has freed goes back to the system, where the C library can do that: workers live on between tasks."""
    if back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        back(0)


def map_docs(df: DataFrame, rows: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str, *keys: str, batch: int = 2000) -> DataFrame:
    """rows(generator of (keys..., text bytes)) on each partition; yields tuples of schema. Only the named columns leave the JVM."""
    df = df.select(*keys, "text")
    names = [x.strip().split(" ")[0] for x in _fields(schema)]
    arrow = _arrow_schema(schema, df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in rows(r for b in batches for r in text_rows(b, "text", *keys)):
            out.append(row)
            if len(out) >= batch:
                yield _as_batch(out, names, arrow)
                out = []
        if out:
            yield _as_batch(out, names, arrow)
        del out
        trim()

    return df.mapInArrow(run, schema)


def _as_batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=schema.field(n).type) for n, c in zip(names, columns, strict=True)], schema=schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    depth, field, out = 0, "", []
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(field)
            field = ""
        else:
            field += c
    return [*out, field]


def _arrow_schema(schema: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def as_docs(docs: DataFrame) -> DataFrame:
    """doc_id and text only: other columns, whatever their names, can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose doc_id is (left_semi) or isn't (left_anti) in ids; ids has the one column doc_id."""
    key = ids.select(F.col("doc_id").cast("long").alias("__key"))
    return docs.join(key, docs["doc_id"].cast("long") == F.col("__key"), how)


#: Bits of a bitmap for an id, and the largest bitmap that is broadcast, 64 MB; beyond it rows aren't sifted, only joined.
BITS_EACH, MOST_BITS = 32, 1 << 29


def sifted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose doc_id may be in ids, rows whose doc_id surely isn't), told without a shuffle of docs. ids: a written table.

    ids are hashed into a bitmap that is broadcast; its size follows their number. With more ids than MOST_BITS has room for, all rows
    come back as the first part, which a join has to tell apart in any case.
    """
    bits = 1 << max(15, (BITS_EACH * ids.count()).bit_length())
    if bits > MOST_BITS:
        return docs, docs.where("false")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    held = ids.groupBy(F.bitmap_bucket_number(place("doc_id")).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("doc_id"))).alias("__bits"))
    at = F.bitmap_bit_position(place("doc_id")).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    met = docs.join(F.broadcast(held), F.bitmap_bucket_number(place("doc_id")) == F.col("__bucket"), "left").withColumn("__hit", hit)
    return met.where("__hit").select(*docs.columns), met.where("not __hit").select(*docs.columns)


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids, a written table, and few others."""
    return sifted(docs, ids)[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, where: str = "true") -> DataFrame:
    """(doc_id, text, y) of at most bound labelled rows, chosen by a hash of doc_id: the same rows however the table is split.

    The bounded list of ids is broadcast; docs isn't shuffled.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null").where(where)
    y = y.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return as_docs(docs).join(F.broadcast(chosen), "doc_id")


def crc_mod4() -> str:
    """SQL: the remainder that holds rows out of training."""
    return "crc32(cast(cast(doc_id as string) as binary)) % 4"


#: The ASCII white space to a space.
SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every bit of x over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.random.default_rng(20240301).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MIX1 to the powers 0 to n, and the inverses, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        for k, base in enumerate((int(MIX1), pow(int(MIX1), -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def word_hashes(text: bytes, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hashes, starts, ends) of the words of a text in which every white space is a space: 64-bit sums over random numbers for bytes.

    After them, for each k of beginnings, the hashes of the first k bytes of the words that are longer.
    """
    b = np.frombuffer(text, np.uint8)
    word = np.zeros(len(b) + 2, bool)
    np.not_equal(b, 32, out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers_to(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=sums[1:])
    more = ((i := starts[ends - starts > k], sums[i + k] - sums[i], np.uint64(k)) for k in beginnings)
    return mixed((sums[ends] - sums[starts]) * inverse[starts]), starts, ends, *(mixed(x * inverse[i] + k) for i, x, k in more)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width word hashes; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = out * MIX1 + h[k : k + n]
    return mixed(out)


def filtered(docs: DataFrame, keep: Callable[[bytes], bool]) -> DataFrame:
    """Rows of docs, all columns unchanged, whose text keep() accepts; a null text is empty."""
    @F.arrow_udf("boolean")
    def verdict(text: pa.Array) -> pa.Array:
        parts = (text.slice(i, ROWS).to_pylist() for i in range(0, len(text), ROWS))
        return pa.array([bool(keep((x or "").encode())) for part in parts for x in part], pa.bool_())

    return docs.where(verdict(docs["text"].cast("string")))
