"""Session logs as turns, replies and a conversation graph."""

from __future__ import annotations

import json
import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed by the log formats and the folding rule.
SHORT_REPLY = 200
ROLLOUT = r"^rollout-.*-(.{8}-.{4}-.{4}-.{4}-.{12})$"
SHOWN = r"\brule:[0-9a-f]{12}\b"
ITEMS = "session string, seq int, role string, text string, at string, cwd string, branch string, reads array<string>, edits array<string>, shown array<string>"


def changed_files(spark: SparkSession, root: str, cursor: str | None) -> DataFrame:
    """(path, modified, name) of logs changed strictly after the cursor; the next cursor is the greatest time among all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root).select("path", F.col("modificationTime").alias("modified"), F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("name"))
    return files.where(F.col("modified") > F.lit(cursor).cast("timestamp")) if cursor else files


def rollout_id(name: Column) -> Column:
    return F.regexp_extract(name, ROLLOUT, 1)


def cleaned(x: Column) -> Column:
    """Typed text without injected tags; a slash command as /name args."""
    name, args = F.regexp_extract(x, r"(?s)<command-name>/?(.*?)</command-name>", 1), F.regexp_extract(x, r"(?s)<command-args>(.*?)</command-args>", 1)
    bare = F.trim(F.regexp_replace(x, r"(?s)<([a-z][a-z-]*)>.*?</\1>", ""))
    return F.when(name != "", F.trim(F.concat(F.lit("/"), name, F.lit(" "), args))).otherwise(bare)


def _blocks(content: object) -> list[dict]:
    return [{"type": "text", "text": content}] if isinstance(content, str) else [b for b in content or [] if isinstance(b, dict)]


def assistant_items(session: str, records: list[dict]) -> list[tuple]:
    """(session, seq, role, text, at, cwd, branch, reads, edits, shown) of a log of message records.

    The first working folder and branch count for all. Side chains, meta records, summaries, tool results and synthetic answers are dropped.
    """
    first = lambda key: next((r[key] for r in records if r.get(key)), "")
    cwd, branch, out = first("cwd"), first("gitBranch"), []
    for r in records:
        m = r.get("message") or {}
        if r.get("isMeta") or r.get("isSidechain") or r.get("isCompactSummary") or m.get("model") == "<synthetic>" or r.get("type") not in ("user", "assistant"):
            continue
        parts = _blocks(m.get("content"))
        text = "\n".join(b.get("text", "") for b in parts if b.get("type") == "text").strip()
        calls = [b for b in parts if b.get("type") == "tool_use"]
        paths = lambda names: [p for b in calls if b.get("name") in names and (p := (b.get("input") or {}).get("file_path") or (b.get("input") or {}).get("path"))]
        shown = sorted({x for b in parts if b.get("type") == "tool_result" for x in re.findall(SHOWN, json.dumps(b.get("content")))})
        if r["type"] == "user" and any(b.get("type") == "tool_result" for b in parts):
            text = ""
        if text or calls or shown:
            out.append((session, len(out), r["type"], text, r.get("timestamp"), cwd, branch, paths({"Read"}), paths({"Edit", "Write", "MultiEdit", "NotebookEdit"}), shown))
    return out


def rollout_items(session: str, records: list[dict]) -> list[tuple]:
    """The same of a log of events: messages from event records, edits from patches that did not fail. A spawned session gives nothing."""
    meta = next((r.get("payload") or {} for r in records if r.get("type") == "session_meta"), {})
    if isinstance(meta.get("source"), dict):
        return []
    cwd, branch, out = meta.get("cwd", ""), (meta.get("git") or {}).get("branch", ""), []
    roles = {"user_message": "user", "agent_message": "assistant"}
    for r in records:
        p = r.get("payload") or {}
        if r.get("type") != "event_msg":
            continue
        role = roles.get(p.get("type"))
        edits = sorted({q for f, c in (p.get("changes") or {}).items() for q in (f, (c or {}).get("move_path")) if q}) if p.get("type") == "patch_apply_end" and p.get("success", True) else []
        if role or edits:
            out.append((session, len(out), role or "assistant", (p.get("message") or "").strip() if role else "", r.get("timestamp"), cwd, branch, [], edits, []))
    return out


def items(logs: DataFrame, kind: str) -> DataFrame:
    """Items of logs (session, line_no, value): a session's records are read together, in order of lines. A log is a file, so its size bounds a group."""
    read = {"messages": assistant_items, "events": rollout_items}[kind]
    names = [x.split()[0] for x in ITEMS.split(", ")]

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for v in pdf.sort_values("line_no").value:
            try:
                r = json.loads(v)
            except ValueError:
                continue
            if isinstance(r, dict):
                rows.append(r)
        return pd.DataFrame(read(pdf.session.iloc[0], rows), columns=names)

    return logs.groupBy("session").applyInPandas(assemble, ITEMS)


def scan(spark: SparkSession, root: str, form: str = "messages", cursor: str | None = None, connector: str = "sessions", project: str = "") -> tuple[DataFrame, DataFrame, str | None]:
    """(nodes, edges, next cursor) of the logs under root that changed after the cursor. Nothing is swept: a log that went stays told."""
    plain = lambda path: F.regexp_replace(path, "^file:/+", "file:/")
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root).select("modificationTime")
    latest = seen.agg(F.date_format(F.max("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("at")).first().at
    files = changed_files(spark, root, cursor)
    session = F.when(rollout_id(F.col("name")) != "", rollout_id(F.col("name"))).otherwise(F.col("name"))
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    lines = text.select(plain(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    lines = lines.join(files.select(plain(F.col("path")).alias("path"), session.alias("session")), "path")
    logs = lines.select("session", F.row_number().over(Window.partitionBy("session").orderBy("path", "block", "n")).alias("line_no"), "value")
    talk = items(logs, form)
    talk = talk.withColumn("text", F.when(F.col("role") == "user", cleaned(F.col("text"))).otherwise(F.col("text")))
    talk = talk.where(in_project(F.col("cwd"), project)) if project else talk
    return *graph(talk, connector), latest


def turns(talk: DataFrame) -> DataFrame:
    """(session, seq, role, text, turn_no): a user's item opens a turn; one that repeats the last without a reply between is dropped."""
    w = Window.partitionBy("session").orderBy("seq")
    spoken = talk.where("text <> ''").withColumns({"last_role": F.lag("role").over(w), "last_text": F.lag("text").over(w)})
    kept = spoken.where("not (role = 'user' and last_role <=> 'user' and last_text <=> text)")
    return kept.withColumn("turn_no", F.sum((F.col("role") == "user").cast("int")).over(w)).drop("last_role", "last_text")


def folded_replies(replies: DataFrame, least: int = SHORT_REPLY) -> DataFrame:
    """(session, turn_no, reply_no, text, n_folded): a reply under least characters joins the next one; trailing ones join the last."""
    w = Window.partitionBy("session", "turn_no").orderBy("seq")
    long = (F.char_length("text") >= least).cast("int")
    numbered = replies.withColumns({"group": F.coalesce(F.sum(long).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "longs": F.sum(long).over(Window.partitionBy("session", "turn_no"))})
    group = F.least("group", F.greatest(F.col("longs") - 1, F.lit(0)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n\n")
    return numbered.groupBy("session", "turn_no", group.cast("int").alias("reply_no")).agg(texts.alias("text"), F.count("*").alias("n_folded"))


def folded(t: DataFrame) -> DataFrame:
    """Turns with short replies joined: a reply stands at the place of its first part, and what its parts read and edited is its own."""
    said, replies = t.where("role = 'user'"), t.where("role <> 'user'")
    w = Window.partitionBy("session", "turn_no").orderBy("seq")
    long = (F.char_length("text") >= SHORT_REPLY).cast("int")
    numbered = replies.withColumns({"before": F.coalesce(F.sum(long).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "longs": F.sum(long).over(Window.partitionBy("session", "turn_no"))})
    group = F.least("before", F.greatest(F.col("longs") - 1, F.lit(0)))
    part = F.array_sort(F.collect_list(F.struct("seq", "text", "reads", "edits", "shown")))
    made = numbered.groupBy("session", "turn_no", group.alias("g")).agg(part.alias("p"), F.min("role").alias("role"), F.min_by("at", "seq").alias("at"), F.min_by("cwd", "seq").alias("cwd"), F.min_by("branch", "seq").alias("branch"))
    joined = lambda c: F.array_distinct(F.flatten(F.transform("p", lambda x: F.coalesce(x[c], F.array().cast("array<string>")))))
    out = made.select("session", F.get("p", F.lit(0))["seq"].alias("seq"), "role", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), "at", "cwd", "branch", *(joined(c).alias(c) for c in ("reads", "edits", "shown")), "turn_no")
    return said.unionByName(out.select(*said.columns))


@F.pandas_udf(ArrayType(StringType()))
def resolved_paths(cwd: pd.Series, paths: pd.Series) -> pd.Series:
    """Absolute normal paths, each once in order; a relative one without a working folder is dropped."""
    one = lambda c, p: posixpath.normpath(posixpath.join(c, p)) if p.startswith("/") or c else None
    return pd.Series([list(dict.fromkeys(x for p in (ps if ps is not None else []) if (x := one(c or "", p)))) for c, ps in zip(cwd, paths, strict=True)])


def in_project(folder: Column, project: str) -> Column:
    """A path takes folders equal to it or under it; a name any element of the path."""
    if project.startswith("/"):
        p = project.rstrip("/")
        return (folder == p) | F.startswith(folder, F.lit(p + "/"))
    return F.array_contains(F.split(folder, "/"), project)


def project_root(folder: Column) -> Column:
    """The folder above .worktrees, else the folder itself."""
    return F.coalesce(F.nullif(F.regexp_extract(folder, r"^(.*?)/\.worktrees/", 1), F.lit("")), folder)


def graph(talk: DataFrame, connector: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a session's items: sessions, repositories and branches; messages and replies; in, next, answers, on, of, reads, edits, injected."""
    t = folded(turns(talk))
    t = t.withColumn("node", F.concat_ws(":", F.when(F.col("role") == "user", "message").otherwise("reply"), "session", "seq"))
    w = Window.partitionBy("session").orderBy("seq")
    t = t.withColumns({"prev": F.lag("node").over(w), "asked": F.last(F.when(F.col("role") == "user", F.col("node")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    own, none = F.lit(connector), F.lit(None)
    session, repo = F.concat(F.lit("session:"), F.col("session")), F.concat(F.lit("repo:"), project_root(F.col("cwd")))
    branch = F.concat_ws(":", F.lit("branch"), project_root(F.col("cwd")), "branch")
    no_attrs = F.create_map().cast("map<string,string>")
    node = lambda d, i, k, x=none, at=none: d.select(i.alias("id"), k.alias("kind"), x.cast("string").alias("text"), no_attrs.alias("attrs"), at.cast("timestamp").alias("at"), own.alias("connector")).dropDuplicates(["id"])
    arc = lambda d, a, b, k: d.select(a.alias("from_id"), b.alias("to_id"), F.lit(k).alias("kind"), F.lit(0.0).alias("weight"), own.alias("connector")).distinct()
    placed, branched = talk.where("cwd <> ''"), talk.where("cwd <> '' and branch <> ''")
    nodes = [node(t, F.col("node"), F.when(F.col("role") == "user", "message").otherwise("reply"), F.col("text"), F.col("at")), node(talk, session, F.lit("session")), node(placed, repo, F.lit("repo")), node(branched, branch, F.lit("branch"))]
    edges = [arc(t, F.col("node"), session, "in"), arc(t.where("prev is not null"), F.col("prev"), F.col("node"), "next"), arc(t.where("role <> 'user' and asked is not null"), F.col("node"), F.col("asked"), "answers"), arc(branched, session, branch, "on"), arc(placed, session, repo, "of")]
    for kind, c in (("reads", "reads"), ("edits", "edits")):
        edges.append(arc(t.select("node", F.explode(resolved_paths("cwd", c)).alias("p")), F.col("node"), F.col("p"), kind))
    edges.append(arc(talk.select("session", F.explode("shown").alias("item")), F.concat(F.lit("session:"), F.col("session")), F.col("item"), "injected"))
    out_n, out_e = nodes[0], edges[0]
    for x in nodes[1:]:
        out_n = out_n.unionByName(x)
    for x in edges[1:]:
        out_e = out_e.unionByName(x)
    return out_n, out_e
