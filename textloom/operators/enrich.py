"""Enrichments: items drawn from neighbourhoods of texts by a model client, and settled against the items kept."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Fixed limits of the stage.
NEIGHBOURS, RATIO, FLOOR, SLACK, SHORTLIST, SHOWN, FOREIGN, LONG_ITEM, PASSAGE, BEFORE = 4, 0.05, 10, 1.25, 12, 60, 3, 900, 12_000, 2_000
Client = Callable[[str], str]


@dataclass(frozen=True)
class Enrichment:
    name: str
    prompt: str = ""
    kinds: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    kind: str = "rule"
    neighbours: int = NEIGHBOURS
    ratio: float = RATIO
    votes: int = 1
    fields: tuple[str, ...] = ()

    @property
    def owner(self) -> str:
        return f"~enrich:{self.name}"

    def selects(self) -> Column:
        """Kind in kinds, if any, and id matching a path, if any."""
        kinds = F.col("kind").isin(*self.kinds) if self.kinds else F.lit(True)
        return kinds & (T.any_glob(F.col("id"), list(self.paths)) if self.paths else F.lit(True))

    def cap(self, selected: int) -> int:
        """A pressure, not a limit."""
        return max(FLOOR, int(self.ratio * selected))


def neighbourhoods(texts: DataFrame, near: DataFrame, read: DataFrame) -> DataFrame:
    """(seed, members): the oldest unread text and its nearest (a, b, rank), again and again; what was shown is read.

    Greedy in time order and so sequential; it runs in one group over ids alone.
    """
    lists = near.groupBy(F.col("a").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda s: s["b"]).alias("near"))
    done = read.select("id", F.lit(True).alias("done"))
    rows = texts.select("id", "at").join(lists, "id", "left").join(done, "id", "left")

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(undated=pdf["at"].notna()).sort_values(["undated", "at", "id"])
        seen = set(pdf.id[pdf.done.fillna(False).astype(bool)])
        out = []
        for i, near in zip(pdf.id, pdf.near, strict=True):
            if i not in seen:
                members = [i, *(near if near is not None else [])]
                out.append((i, members))
                seen.update(members)
        return pd.DataFrame(out, columns=["seed", "members"])

    kind = dict(texts.dtypes)["id"]
    return rows.groupBy(F.lit("all").alias("g")).applyInPandas(cover, f"seed {kind}, members array<{kind}>")


def shown_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, shown): a text clipped to its head and tail, after the end of the text that precedes it."""
    before = edges.where("kind = 'next'").select(F.col("to_id").alias("id"), F.col("from_id").alias("before_id"))
    last = nodes.select(F.col("id").alias("before_id"), F.right("text", F.lit(BEFORE)).alias("before"))
    met = nodes.where("text is not null").select("id", "text").join(before.groupBy("id").agg(F.min("before_id").alias("before_id")), "id", "left").join(last, "before_id", "left")
    return met.select("id", F.concat_ws("\n\n", "before", T.head_and_tail(F.col("text"), PASSAGE)).alias("shown"))


def signature(shown: Column, enrichment: Enrichment, model: str, version: int = 1) -> Column:
    return F.sha2(F.concat_ws("|", shown, F.lit(version), F.lit(model), F.lit(enrichment.prompt), F.lit(",".join(enrichment.fields))), 256)


def prompt_texts(groups: DataFrame, shown: DataFrame, nodes: DataFrame, enrichment: Enrichment) -> DataFrame:
    """(seed, ids, prompt): numbered dated passages in time order below the prompt's frame."""
    flat = groups.select("seed", F.explode("members").alias("id")).join(shown, "id").join(nodes.select("id", "at"), "id")
    w = Window.partitionBy("seed").orderBy("at", "id")
    n = flat.withColumn("n", F.row_number().over(w))
    line = F.format_string("[%d] %s\n%s", F.col("n"), F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("undated")), F.col("shown"))
    body = n.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line"), "id"))).alias("rows"))
    frame = f"{enrichment.prompt}\nAnswer with JSON: {{\"items\": [{{\"text\", \"from\"" + "".join(f', "{f}"' for f in enrichment.fields) + "}]}\n\n"
    return body.select("seed", F.transform("rows", lambda r: r["id"]).alias("ids"), F.concat(F.lit(frame), F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n")).alias("prompt"))


def answered(prompts: DataFrame, client: Client) -> DataFrame:
    """(seed, ids, answer): the client's answers; one that isn't JSON is asked for once more, then left empty."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(answer=[complete(client, p) for p in pdf.prompt]).drop(columns="prompt")

    kind = dict(prompts.dtypes)["seed"]
    return prompts.mapInPandas(ask, f"seed {kind}, ids array<{kind}>, answer string")


def unfenced(answer: str) -> str:
    a = answer.strip()
    if a.startswith("```"):
        a = a.split("\n", 1)[-1].rsplit("```", 1)[0]
    return a.strip()


def complete(client: Client, prompt: str) -> str:
    for again in ("", "\n\nAnswer with valid JSON only."):
        answer = unfenced(client(prompt + again))
        try:
            json.loads(answer)
            return answer
        except ValueError:
            continue
    return "{}"


def extracted(answers: DataFrame, votes: int) -> DataFrame:
    """(seed, text, supporters): items with a text and enough distinct passages that were shown."""
    items = F.from_json("answer", "items array<struct<text:string,from:array<int>>>")["items"]
    flat = answers.select("seed", "ids", F.explode(items).alias("item"))
    valid = F.array_distinct(F.filter(F.coalesce("item.from", F.array().cast("array<int>")), lambda i: (i >= 1) & (i <= F.size("ids"))))
    ids = F.transform(valid, lambda i: F.get("ids", i - 1))
    out = flat.select("seed", F.trim("item.text").alias("text"), ids.alias("supporters"))
    return out.where(F.coalesce("text", F.lit("")) != "").where(F.size("supporters") >= votes)


def item_id(kind: str, text: str) -> str:
    return f"{kind}:{hashlib.sha256(text.encode()).hexdigest()[:12]}"


@dataclass
class Items:
    """The kept items of an enrichment on the driver; their number is held near a share of the texts."""

    kind: str = "rule"
    texts: dict[str, str] = field(default_factory=dict)
    states: dict[str, set[str]] = field(default_factory=dict)  # item: supporters
    vectors: dict[str, np.ndarray] = field(default_factory=dict)

    def shortlist(self, v: np.ndarray, shown: list[str] = (), most: int = SHORTLIST) -> list[str]:
        """Items that the session was shown, then the nearest."""
        near = sorted(self.vectors, key=lambda i: (-float(self.vectors[i] @ v), i))[:most]
        return list(dict.fromkeys([*(i for i in shown if i in self.texts), *near]))[:SHOWN]

    def put(self, text: str, supporters: set[str], v: np.ndarray) -> str:
        i = item_id(self.kind, text)
        self.texts[i], self.vectors[i] = text, v
        self.states.setdefault(i, set()).update(supporters)
        return i

    def retire(self, i: str) -> None:
        for d in (self.texts, self.states, self.vectors):
            d.pop(i, None)

    def absorb(self, into: str, gone: list[str]) -> None:
        """The supporters of merged items support the kept one."""
        for g in gone:
            if g != into and g in self.texts:
                self.states[into] |= self.states[g]
                self.retire(g)

    def settle(self, decisions: list[dict], embed: Callable[[str], np.ndarray]) -> list[str]:
        """Decisions in order: merges and retirements first, then updates and repeats, then new items. Gives the log."""
        rank = {"merge": 0, "retire": 1, "update": 2, "same": 3, "new": 4}
        log = []
        for d in sorted(decisions, key=lambda d: rank.get(d["action"], 9)):
            action, target, who = d["action"], d.get("id"), set(d.get("from", ()))
            if action == "new":
                log.append(f"new {self.put(d['text'], who, embed(d['text']))}")
            elif target not in self.texts:
                log.append(f"skip {action} {target}")
            elif action == "same":
                self.states[target] |= who
                log.append(f"same {target}")
            elif action == "retire":
                self.retire(target)
                log.append(f"retire {target}")
            elif action in ("update", "merge"):
                self.absorb(target, d.get("merged", []))
                if d.get("text"):
                    self.texts[target], self.vectors[target] = d["text"], embed(d["text"])
                self.states[target] |= who
                log.append(f"{action} {target}")
        return log


def item_dates(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, at): the latest time of the nodes that state an item, of edges (from_id, to_id) of kind states."""
    return states.where("kind = 'states'").select("from_id", F.col("to_id").alias("id")).join(nodes.select(F.col("id").alias("from_id"), "at"), "from_id").groupBy("id").agg(F.max("at").alias("at"))


def status(nodes: DataFrame, read: DataFrame, enrichment: Enrichment) -> DataFrame:
    """(items, read, pending) of an enrichment; read (id, enrichment)."""
    seen = read.where(F.col("enrichment") == enrichment.name).select("id", F.lit(True).alias("seen"))
    chosen = nodes.where(F.col("text").isNotNull() & enrichment.selects() & ~F.startswith("connector", F.lit("~"))).select("id").join(seen, "id", "left")
    items = nodes.where(F.col("connector") == enrichment.owner).agg(F.count("*").alias("items"))
    return items.crossJoin(chosen.agg(F.count_if("seen").alias("read"), F.count_if(F.col("seen").isNull()).alias("pending")))
