"""Chunkers: text to spans with a prefix, as a table function. Budgets count characters.

A chunker packs units of a text greedily up to a budget; that is a scan with state, so it runs in Arrow batches.
The chunker for Go reads declarations from lines and brackets, not from a parse tree; a text that it can't read goes to ``text``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

BUDGET, LEAST_BUDGET, SEPARATOR = 1600, 100, " › "


@dataclass(frozen=True)
class Chunk:
    prefix: str
    start: int
    stop: int


Span = tuple[int, int]


def _lines(text: str, start: int = 0, stop: int | None = None) -> list[Span]:
    out, stop = [], len(text) if stop is None else stop
    while start < stop:
        end = text.find("\n", start, stop)
        end = stop if end < 0 else end + 1
        out.append((start, end))
        start = end
    return out


def _trimmed(text: str, span: Span) -> Span:
    a, b = span
    return a, a + len(text[a:b].rstrip())


def split_long(text: str, span: Span, budget: int) -> list[Span]:
    """Pieces of a span at line ends; a longer line between characters."""
    out: list[Span] = []
    at, end = span[0], span[0]
    for a, b in _lines(text, *span):
        if b - at > budget and end > at:
            out.append((at, end))
            at = a
        while b - at > budget:
            out.append((at, at + budget))
            at += budget
        end = b
    return [*out, (at, end)] if end > at else out


def pack(text: str, units: list[Span], budget: int) -> list[Span]:
    """Neighbouring units together, as many as fit."""
    out: list[Span] = []
    for a, b in units:
        if out and b - out[-1][0] <= budget:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def front_matter(text: str) -> tuple[str, int]:
    """(title, end) of a closed front matter at the start; end 0 without one."""
    m = re.match(r"---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return "", 0
    title = re.search(r"^title:[ \t]*(.+?)[ \t]*$", m[1] or "", re.M)
    return (title[1].strip("\"'") if title else ""), m.end()


def blocks(text: str, start: int) -> list[tuple[Span, int, str]]:
    """(span, heading level or 0, heading) of a text's blocks: blank lines part them, fences stay whole, a heading is one."""
    out: list[tuple[Span, int, str]] = []
    open_at, fence = None, ""
    end = start

    def close() -> None:
        nonlocal open_at
        if open_at is not None:
            out.append(((open_at, end), 0, ""))
        open_at = None

    for a, b in _lines(text, start):
        line = text[a:b].rstrip("\n")
        bare = line.strip()
        if fence:
            if bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
            end = b
            continue
        if m := re.match(r"[ ]{0,3}(`{3,}|~{3,})", line):
            fence = m[1]
            open_at = a if open_at is None else open_at
            end = b
        elif m := re.match(r"(#{1,6})[ \t](.*)$", line):
            close()
            out.append(((a, b), len(m[1]), m[2].strip().rstrip("#").strip()))
        elif not bare:
            close()
        else:
            open_at = a if open_at is None else open_at
            end = b
    close()
    return out


def chunk_none(text: str, budget: int) -> list[Chunk]:
    return [Chunk("", 0, len(text))] if text else []


def chunk_text(text: str, budget: int) -> list[Chunk]:
    """Blocks packed to the budget; a heading opens a chunk once the current one holds a quarter of it. The prefix is the path of headings."""
    title, start = front_matter(text)
    path: list[tuple[int, str]] = []
    out: list[Chunk] = []
    at: int | None = None
    end, prefix = 0, title

    def flush() -> None:
        nonlocal at
        if at is not None:
            for piece in split_long(text, (at, end), budget) if end - at > budget else [(at, end)]:
                a, b = _trimmed(text, piece)
                if b > a:
                    out.append(Chunk(prefix, a, b))
        at = None

    for (a, b), level, heading in blocks(text, start):
        if at is not None and ((level and end - at >= budget / 4) or b - at > budget):
            flush()
        if level:
            path = [x for x in path if x[0] < level] + [(level, heading)]
        if at is None:
            at = a
            prefix = SEPARATOR.join(x for x in [title, *(h for _, h in path)] if x)
        end = b
    flush()
    return out


def _declarations(text: str) -> list[tuple[int, int, str]] | None:
    """(start, end, signature) of top-level Go declarations with their leading comments; null if brackets don't close."""
    out, depth, start, lead = [], 0, None, None
    code = re.sub(r'`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?\*/', lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    for a, b in _lines(text):
        line, bare = text[a:b], code[a:b]
        if depth == 0 and start is None:
            if re.match(r"(func|type|var|const|import)\b", bare):
                start, signature = a if lead is None else lead, line.strip().rstrip("{").strip()
            elif re.match(r"\s*(//|/\*|\*)", line):
                lead = a if lead is None else lead
            elif line.strip():
                lead = None
            else:
                lead = None
        depth += sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}")
        if depth < 0:
            return None
        if start is not None and depth == 0:
            out.append((start, b, signature))
            start = lead = None
    return out if depth == 0 and start is None else None


def chunk_go(text: str, budget: int) -> list[Chunk]:
    """A unit for each top-level declaration, packed; one too long is cut between statements of its body. Prefix: package, signature."""
    package = re.search(r"^package\s+(\w+)", text, re.M)
    found = _declarations(text) if package else None
    if not found:
        return chunk_text(text, budget)
    units: list[tuple[Span, str]] = []
    at = 0
    for _, end, signature in found:
        units.append(((at, end), signature))
        at = end
    units[-1] = ((units[-1][0][0], len(text)), units[-1][1])
    out: list[Chunk] = []
    held: Span | None = None
    first = ""

    def flush() -> None:
        nonlocal held
        if held and (s := _trimmed(text, held))[1] > s[0]:
            out.append(Chunk(f"{package[1]}{SEPARATOR}{first}", *s))
        held = None

    for (a, b), signature in units:
        if b - a > budget:
            flush()
            cuts = [x for x in _lines(text, a, b) if re.match(r"\t\S", text[x[0] : x[1]]) or x[0] == a]
            stops = [x for x, _ in cuts[1:]] + [b]
            for piece in pack(text, list(zip([a, *stops[:-1]], stops, strict=True)), budget):
                for s in split_long(text, piece, budget) if piece[1] - piece[0] > budget else [piece]:
                    s = _trimmed(text, s)
                    if s[1] > s[0]:
                        out.append(Chunk(f"{package[1]}{SEPARATOR}{signature}", *s))
        elif held and b - held[0] <= budget:
            held = (held[0], b)
        else:
            flush()
            held, first = (a, b), signature
    flush()
    return out


def yaml_documents(text: str) -> list[Span]:
    out, at = [], 0
    for a, b in _lines(text):
        if re.match(r"(---|\.\.\.)([ \t].*)?$", text[a:b].rstrip("\n")):
            out.append((at, a))
            at = b
    return [s for s in [*out, (at, len(text))] if text[s[0] : s[1]].strip()]


def _yaml_units(text: str, span: Span) -> list[tuple[Span, str]]:
    """(span, name) of the shallowest keys or items, comments above them included."""
    rows = [(a, b, text[a:b]) for a, b in _lines(text, *span)]
    keyed = [(a, len(x) - len(x.lstrip(" ")), x) for a, _, x in rows if re.match(r" *(- |-$|[^\s#][^#]*?:(\s|$))", x)]
    if not keyed:
        return []
    indent = min(i for _, i, _ in keyed)
    has_key = any(i == indent and not x.lstrip().startswith("-") for _, i, x in keyed)
    heads = [(a, x) for a, i, x in keyed if i == indent and not (has_key and x.lstrip().startswith("-"))]
    starts = []
    for a, x in heads:
        k = next(j for j, r in enumerate(rows) if r[0] == a)
        while k and rows[k - 1][2].lstrip().startswith("#") and rows[k - 1][0] >= span[0]:
            k -= 1
        name = x.strip()[:60] if x.lstrip().startswith("-") else x.strip().split(":", 1)[0].strip("\"'")
        starts.append((rows[k][0], name))
    starts[0] = (span[0], starts[0][1])
    return [((a, b), n) for (a, n), b in zip(starts, [x for x, _ in starts[1:]] + [span[1]], strict=True)]


def chunk_yaml(text: str, budget: int) -> list[Chunk]:
    """Each document by its shallowest keys; one too long goes a level deeper. Prefix: kind and name, then the path of keys."""
    out: list[Chunk] = []

    def cut(span: Span, prefix: list[str]) -> None:
        units = _yaml_units(text, span) if span[1] - span[0] > budget else []
        if len(units) == 1 and units[0][0] == span:
            body = text.find("\n", span[0], span[1]) + 1
            units = _yaml_units(text, (body, span[1])) if body else []
            prefix = [*prefix]
        if len(units) < 2:
            for s in split_long(text, span, budget) if span[1] - span[0] > budget else [span]:
                s = _trimmed(text, s)
                if s[1] > s[0]:
                    out.append(Chunk(SEPARATOR.join(prefix), *s))
            return
        held: list[tuple[Span, str]] = []

        def flush() -> None:
            if held:
                s = _trimmed(text, (held[0][0][0], held[-1][0][1]))
                if s[1] > s[0]:
                    out.append(Chunk(SEPARATOR.join([*prefix, held[0][1]]), *s))
                held.clear()

        for (a, b), name in units:
            if b - a > budget:
                flush()
                cut((a, b), [*prefix, name])
                continue
            if held and b - held[0][0][0] > budget:
                flush()
            held.append(((a, b), name))
        flush()

    for span in yaml_documents(text):
        body = text[span[0] : span[1]]
        kind, name = re.search(r"^kind:[ \t]*(\S+)", body, re.M), re.search(r"^metadata:[ \t]*\n(?:[ \t]+.*\n)*?[ \t]+name:[ \t]*(\S+)", body, re.M)
        cut(span, [" ".join(m[1] for m in (kind, name) if m)] if kind else [])
    return out


CHUNKERS: dict[str, tuple[int, Callable[[str, int], list[Chunk]]]] = {"none": (1, chunk_none), "text": (1, chunk_text), "go": (1, chunk_go), "yaml": (1, chunk_yaml)}


def recipe(name: str, budget: int = BUDGET) -> str:
    """name@version/budget: what a stored chunk was made by."""
    return f"{name}@{CHUNKERS[name][0]}/{budget}"


def chunks(nodes: DataFrame, chunker: str = "text", budget: int = BUDGET) -> DataFrame:
    """(node_id, idx, hash, prefix, text, line, end_line, start) of nodes (id, text)."""
    if budget < LEAST_BUDGET:
        raise ValueError(f"a budget is {LEAST_BUDGET} at least")
    split = CHUNKERS[chunker][1]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(i, k, c.prefix, t[c.start : c.stop], t.count("\n", 0, c.start) + 1, c.start) for i, t in zip(pdf.id, pdf.text, strict=True) if t for k, c in enumerate(split(t, budget))]
            yield pd.DataFrame(out, columns=["node_id", "idx", "prefix", "text", "line", "start"])

    cut = nodes.where("text is not null").select("id", "text").mapInPandas(rows, "node_id string, idx int, prefix string, text string, line int, start int")
    end = F.col("line") + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return cut.select("node_id", "idx", T.content_hash(T.embed_text(F.col("prefix"), F.col("text"))).alias("hash"), "prefix", "text", "line", end.alias("end_line"), "start")


def chunker_for(path: Column, rules: list[tuple[str, str]], otherwise: str = "text") -> Column:
    """The chunker of the first rule (glob, chunker) that takes the path."""
    out = F.when(F.lit(False), otherwise)
    for glob, name in rules:
        if name not in CHUNKERS:
            raise ValueError(f"no chunker {name}")
        out = out.when(F.rlike(path, F.lit(T.glob_regex(glob))), name)
    return out.otherwise(otherwise)
