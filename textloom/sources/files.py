"""File trees as nodes and edges: documents, their folders, and links of Markdown texts."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import text as T
from textloom.operators.chunk import front_matter

MAX_FILE, TITLE_LINES = 4 << 20, 60
PRUNED = r"(^|/)(\.[^/]+|node_modules)(/|$)"


def walk(spark: SparkSession, root: str, globs: list[str] = ("**/*.md",), exclude: list[str] = (), follow: bool = False) -> DataFrame:
    """(rel, content, modified) of the files under root: hidden folders, node_modules and excluded subtrees pruned, at most MAX_FILE bytes, UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(base)}/", "")
    out = files.select(rel.alias("rel"), "content", F.col("modificationTime").alias("modified"), "length")
    if follow and (pairs := linked_files(base)):
        more = spark.read.format("binaryFile").load(sorted({p for _, p in pairs}))
        names = spark.createDataFrame(pairs, "rel string, real string")
        real = F.regexp_replace("path", "^file:/*", "/")
        out = out.unionByName(more.join(names, real == F.col("real")).select("rel", "content", F.col("modificationTime").alias("modified"), "length"))
    out = out.where(~F.rlike("rel", F.lit(PRUNED)) & T.any_glob(F.col("rel"), list(globs)) & (F.col("length") <= MAX_FILE))
    if exclude:
        heads = F.transform(F.sequence(F.lit(1), F.size(F.split("rel", "/"))), lambda i: F.array_join(F.slice(F.split("rel", "/"), 1, i), "/"))
        out = out.where(~F.exists(heads, lambda h: T.any_glob(h, list(exclude))))
    return out.where(F.is_valid_utf8(F.col("content").cast("string"))).select("rel", F.col("content").cast("string").alias("text"), "modified")


def git_log(root: str) -> list[tuple[str, int, int]]:
    """(path, added at, place in the log) of the commits that added files under root, newest first; nothing where there is no repository."""
    import subprocess

    run = subprocess.run(["git", "-C", root, "log", "--diff-filter=A", "--name-only", "--relative", "--format=%x00%at"], capture_output=True, text=True, check=False)
    out: list[tuple[str, int, int]] = []
    for entry in run.stdout.split("\0")[1:] if run.returncode == 0 else ():
        when, *names = entry.split("\n")
        out += [(n, int(when), len(out) + k) for k, n in enumerate(x for x in names if x)]
    return out


def linked_files(root: str) -> list[tuple[str, str]]:
    """(path under root, real path) of files that symbolic links lead to. A link whose target is, holds or lies in a folder that was walked
    already isn't followed, so no circle is."""
    import os

    walked = [os.path.realpath(root)]
    out: list[tuple[str, str]] = []
    inside = lambda a, b: a == b or a.startswith(b.rstrip("/") + "/")

    def visit(shown: str, real: str) -> None:
        for name in sorted(os.listdir(real)):
            path, here = os.path.join(real, name), f"{shown}/{name}" if shown else name
            if re.search(PRUNED, here):
                continue
            if os.path.islink(path):
                target = os.path.realpath(path)
                if os.path.isdir(target):
                    if not any(inside(target, w) or inside(w, target) for w in walked):
                        walked.append(target)
                        follow(here, target)
                elif os.path.isfile(target):
                    out.append((here, target))
            elif os.path.isdir(path):
                visit(here, path)

    def follow(shown: str, real: str) -> None:
        for folder, names, files in os.walk(real):
            names[:] = sorted(n for n in names if not re.search(PRUNED, n))
            rel = os.path.relpath(folder, real)
            at = shown if rel == "." else f"{shown}/{rel}"
            out.extend((f"{at}/{n}", os.path.join(folder, n)) for n in sorted(files))

    visit("", os.path.realpath(root))
    return out


def folder_chain(paths: DataFrame, path: str = "path") -> DataFrame:
    """(parent, child): every folder of each path to the root "", and the path itself; each pair once."""
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    pairs = F.arrays_zip(F.slice(heads, 1, F.size(heads) - 1).alias("parent"), F.slice(heads, 2, F.size(heads) - 1).alias("child"))
    return paths.select(F.explode(pairs).alias("p")).select("p.parent", "p.child").distinct()


def resolved(folder: str, target: str) -> str | None:
    """A link's target as a path under the root, or null."""
    path = posixpath.normpath(posixpath.join(folder, target))
    return None if path.startswith(("..", "/")) else path


def links(files: DataFrame) -> DataFrame:
    """(from_path, to_path): links of Markdown texts to files that are there."""
    target = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1)))).alias("raw")
    found = files.where(F.endswith("rel", F.lit(".md"))).select(F.col("rel").alias("from_path"), target).withColumn("raw", F.regexp_replace("raw", "#.*$", ""))
    found = found.where("raw <> ''").where(~F.rlike("raw", F.lit("^([a-z][a-z0-9+.-]*:|//)")))
    decoded = F.try_url_decode(F.replace("raw", F.lit("+"), F.lit("%2B")))

    def resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            to = [resolved(posixpath.dirname(a), b) if b else None for a, b in zip(pdf.from_path, pdf.raw, strict=True)]
            yield pd.DataFrame({"from_path": pdf.from_path, "to_path": to}).dropna()

    out = found.select("from_path", decoded.alias("raw")).mapInPandas(resolve, "from_path string, to_path string")
    return out.join(files.select(F.col("rel").alias("to_path")), "to_path", "left_semi").select("from_path", "to_path").distinct()


@F.pandas_udf(StringType())
def title(text: pd.Series) -> pd.Series:
    """Of the front matter, else the first heading, within the first lines."""

    def one(t: str | None) -> str:
        head = "\n".join((t or "").split("\n")[:TITLE_LINES])
        m = re.search(r"^# +(.+)$", head, re.M)
        return front_matter(head)[0] or (m[1].strip() if m else "")

    return text.map(one)


def added_dates(files: DataFrame, log: DataFrame) -> DataFrame:
    """(rel, at): the newest commit that added a path, of log (path, at, ord) in log order; else the file's own time."""
    first = log.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("ord"))).where("n = 1").select(F.col("path").alias("rel"), F.col("at").alias("added"))
    return files.select("rel", "modified").join(first, "rel", "left").select("rel", F.coalesce("added", "modified").alias("at"))


def graph(files: DataFrame, connector: str = "fs") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a walk."""
    chain = folder_chain(files.select(F.col("rel").alias("path")))
    own: Column = F.lit(connector)
    no_attrs = F.create_map().cast("map<string,string>")
    docs = files.select(F.col("rel").alias("id"), F.lit("document").alias("kind"), "text", F.map_filter(F.create_map(F.lit("title"), title("text")), lambda _, v: v != "").alias("attrs"), F.col("modified").alias("at"), own.alias("connector"))
    folders = chain.select(F.col("parent").alias("id")).distinct().select("id", F.lit("directory").alias("kind"), F.lit(None).cast("string").alias("text"), no_attrs.alias("attrs"), F.lit(None).cast("timestamp").alias("at"), own.alias("connector"))
    arc = lambda d, a, b, k: d.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(k).alias("kind"), F.lit(0.0).alias("weight"), own.alias("connector"))
    return docs.unionByName(folders), arc(chain, "parent", "child", "contains").unionByName(arc(links(files), "from_path", "to_path", "links"))
