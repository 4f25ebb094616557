"""The wire format: JSON lines, one of node, edge, delete, cursor or sweep each; and sinks of the same form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<id:string,kind:string,text:string,hash:string,attrs:map<string,string>,chunker:string,at:timestamp>"
EDGE = "struct<from:string,to:string,kind:string,weight:double>"
RECORD = f"node {NODE}, edge {EDGE}, delete struct<id:string>, cursor struct<value:string>, sweep struct<present:boolean>"
KINDS = ("node", "edge", "delete", "cursor", "sweep")


def parsed(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Records of (seq, value); a line that is no JSON object fails the read with its number."""
    r = F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r")
    has_sweep = F.get_json_object("value", "$.sweep").isNotNull()
    out = lines.where(F.trim("value") != "").select("seq", "value", r, has_sweep.alias("has_sweep"))
    if strict:
        bad = F.try_parse_json("value").isNull()
        out = out.where(F.when(bad, F.raise_error(F.concat(F.lit("record "), F.col("seq").cast("string"), F.lit(" is no JSON object"))).cast("boolean")).otherwise(True))
    sweep = F.when(F.col("has_sweep"), F.struct(F.lit(True).alias("present")))
    return out.select("seq", *(F.col(f"r.{k}").alias(k) for k in KINDS[:-1]), sweep.alias("sweep"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) of a file or folder. seq orders as files by name and lines within them do, however Spark packs the files."""
    text = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return text.select(place.alias("seq"), "value")


def read_stream_file(spark: SparkSession, path: str) -> DataFrame:
    """Valid records of a file or folder, in order of seq."""
    return valid(parsed(ordered_lines(spark, path)))


def marked(spark: SparkSession, path: str) -> DataFrame:
    """Records with ok, which is false for one that would be refused."""
    records = parsed(ordered_lines(spark, path), strict=False)
    return records.withColumn("ok", ~_wrong())


def literal(seq) -> Column:
    """A value of seq that was brought to the driver, as a column."""
    return F.struct(F.lit(seq["file"]).alias("file"), F.lit(seq["block"]).cast("long").alias("block"), F.lit(seq["n"]).cast("long").alias("n"))


def _wrong() -> Column:
    parts = sum((F.col(k).isNotNull().cast("int") for k in KINDS[1:]), F.col("node").isNotNull().cast("int"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (parts != 1) | (F.col("node").isNotNull() & empty("node.id")) | (F.col("delete").isNotNull() & empty("delete.id")) | (F.col("edge").isNotNull() & (empty("edge.from") | empty("edge.to") | empty("edge.kind")))


def valid(records: DataFrame) -> DataFrame:
    """Exactly one part each; ids, ends and kinds not empty. Others fail."""
    return records.where(F.when(_wrong(), F.raise_error(F.concat(F.lit("record "), F.col("seq").cast("string"), F.lit(" is not valid"))).cast("boolean")).otherwise(True))


def of_tables(nodes: DataFrame, edges: DataFrame, cursor: str | None = None, sweep: bool = False) -> DataFrame:
    """Records (seq and the wire fields) of nodes (id, kind, text, attrs, at) and edges; with a cursor or a sweep at their end."""
    at = lambda n: F.struct(F.lit("").alias("file"), F.lit(n).cast("long").alias("block"), F.monotonically_increasing_id().alias("n")).alias("seq")
    kind = dict(zip(KINDS, (NODE, EDGE, "struct<id:string>", "struct<value:string>", "struct<present:boolean>"), strict=True))
    one = lambda d, n, **k: d.select(at(n), *((k[x] if x in k else F.lit(None)).cast(kind[x]).alias(x) for x in KINDS))
    chunker = F.col("chunker") if "chunker" in nodes.columns else F.lit(None).cast("string")
    node = F.struct("id", "kind", "text", F.lit(None).cast("string").alias("hash"), "attrs", chunker.alias("chunker"), "at")
    edge = F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "kind", "weight")
    out = one(nodes, 0, node=node).unionByName(one(edges, 1, edge=edge))
    last = nodes.sparkSession.range(1)
    out = out.unionByName(one(last, 2, cursor=F.struct(F.lit(cursor).alias("value")))) if cursor else out
    return out.unionByName(one(last, 3, sweep=F.struct(F.lit(True).alias("present")))) if sweep else out


def lines(records: DataFrame) -> Column:
    """The JSON line of each record."""
    return F.to_json(F.struct(*(F.col(k) for k in KINDS)))


def write_stream_file(records: DataFrame, path: str) -> None:
    """Append records to a folder, in order of seq and each part a file: what is there when this returns can be read up to its last cursor."""
    records.orderBy("seq").select(lines(records).alias("value")).write.mode("append").text(path)
