"""Answers as text and JSON: snippets, the folder that ids share, and lines of hits.

Snippets are made where the hits are, in vectorised functions; what is formatted on the driver is one answer.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import text as T

WORD = re.compile(r"[^\W_]+")


def stem(token: str) -> str:
    """Places a snippet over inflected words; nothing is ranked by it."""
    return token[: T.STEM_RUNES]


def snippet(text: str, terms: Iterable[str], width: int = T.SNIPPET_RUNES) -> str:
    """The part of a text, on one line, that has most distinct stems of terms within three quarters of the width, from a quarter before
    the first of them; the text's beginning where it has none. Words at both ends stay whole, and what is left out shows as an ellipsis."""
    line = " ".join(text.split())
    if len(line) <= width:
        return line
    wanted = {stem(t) for t in terms}
    words = [(m.start(), m.end(), s) for m in WORD.finditer(line) if (s := stem(m[0].lower())) in wanted]
    start = 0
    if words:
        places = np.array([a for a, *_ in words])
        until = np.searchsorted(places, places + 3 * width // 4, side="right")
        kinds = [len({s for *_, s in words[i:j]}) for i, j in enumerate(until.tolist())]
        start = max(0, words[int(np.argmax(kinds))][0] - width // 4)
    start = min(start, len(line) - width)
    inside = lambda i: 0 < i < len(line) and line[i - 1].isalnum() and line[i].isalnum()
    if start and line[start - 1].isalnum():
        while start < len(line) and line[start - 1].isalnum():
            start += 1
    end = min(start + width, len(line))
    while end > start and inside(end):
        end -= 1
    return ("…" if start else "") + line[start:end].strip() + ("…" if end < len(line) else "")


def snippets(text: Column, terms: list[str], width: int = T.SNIPPET_RUNES) -> Column:
    @F.pandas_udf(StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t or "", terms, width))

    return cut(text)


def common_base(ids: Iterable[str]) -> str:
    """The folder that all ids share, with its slash; nothing for ids that don't begin with one, or that share only the root."""
    shared = os.path.commonprefix(list(ids))
    base = shared[: shared.rfind("/") + 1]
    return base if len(base) > 1 and base[0] == "/" else ""


def reading_text(first_chunk: Column, summary: Column, runes: int) -> Column:
    """What is shown of a neighbour: its first chunk, else its summary, up to so many characters."""
    return F.left(F.coalesce(first_chunk, summary, F.lit("")), F.lit(runes))


def hit_rows(hits: DataFrame, nodes: DataFrame, chunks: DataFrame, terms: list[str], full: bool = False, chars: int = T.SNIPPET_RUNES) -> DataFrame:
    """Hits (id, idx, class, score, mass, seed, also, sources, pos) with what an answer shows: kind, attrs, date, heading, lines and text."""
    own = chunks.select(F.col("node_id").alias("id"), "idx", "prefix", "text", "line", "end_line")
    where = F.struct("line", "end_line")
    also = hits.select("id", F.explode("also").alias("idx")).join(own, ["id", "idx"]).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", where.alias("at")))), lambda s: s["at"]).alias("also_at"))
    met = hits.drop("also").join(own, ["id", "idx"], "left").join(also, "id", "left").join(nodes.select("id", "kind", "attrs", "at", "connector"), "id")
    shown = F.coalesce(F.col("text"), F.lit(""))
    return met.withColumn("shown", shown if full else snippets(shown, terms, chars)).drop("text")


def as_text(rows: list, attrs: Iterable[str] = (), full: bool = False, warning: str = "") -> str:
    """The answer as text; rows are those of hit_rows in order of pos."""
    out = [f"! {warning}", "! Tell the user this before answering from these hits, and ask them to fix it."] if warning else []
    if not rows:
        return "\n".join([*out, "no hits"])
    base = common_base(r["id"] for r in rows)
    if base:
        out.append(f"{len(rows)} hits under {base}")
    headed, last = len({r["class"] for r in rows}) > 1, object()
    for n, r in enumerate(rows, 1):
        name = r["id"].removeprefix(base)
        if headed and r["class"] != last:
            last = r["class"]
            out.append(f"# {last or 'graph'}")
        if r["is_structural"]:
            pairs = "".join(f" {k}={v}" for k, v in sorted((r["attrs"] or {}).items()))
            out.append(f"~{n} {name} [{r['kind']}]{pairs}")
            continue
        parts = [f"{'~' if not r['seed'] and r['mass'] > 0 else ''}{n} {name}{locator(r['line'], r['end_line'])}"]
        if r["prefix"]:
            parts.append(f" — {r['prefix']}")
        if r["at"] is not None:
            parts.append(f" · {r['at']:%Y-%m-%d}")
        if r["sources"]:
            parts.append(f" · {r['sources']} source{'s' if r['sources'] > 1 else ''}")
        out.append("".join(parts))
        out += [f"  {k}: {(r['attrs'] or {})[k]}" for k in attrs if (r["attrs"] or {}).get(k)]
        out += [f"  {x}" for x in (r["shown"].split("\n") if full else [r["shown"]] if r["shown"] else [])]
        if r["also_at"]:
            out.append("  also " + " ".join(locator(*a) for a in r["also_at"]))
    return "\n".join(out)


def as_json(query: str, rows: list, warning: str = "") -> str:
    """The answer as one JSON object; empty fields are left out."""

    def hit(r) -> dict:
        lines = [r["line"], r["end_line"]] if (r["line"] or 0) > 0 else None
        fields = {"id": r["id"], "kind": r["kind"], "class": r["class"], "sources": r["sources"], "lines": lines, "heading": r["prefix"], "also": [list(a) for a in r["also_at"] or ()], "attrs": r["attrs"]}
        return {k: v for k, v in fields.items() if v} | {"text": r["shown"], "score": r["score"], "mass": r["mass"], "seed": r["seed"]}

    return json.dumps({"query": query, "hits": [hit(r) for r in rows]} | ({"warning": warning} if warning else {}), ensure_ascii=False)


def locator(line: int | None, end_line: int | None) -> str:
    if not line or line < 1:
        return ""
    return f":{line}" if not end_line or end_line <= line else f":{line}-{end_line}"
