"""The enrichment stage: neighbourhoods of unread texts are shown to a client, and what it draws from them is settled with the items kept."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import enrich, vectors
from textloom.operators.tables import checkpointed

Embed = Callable[[str], np.ndarray]
HEX = re.compile(r"[0-9a-f]{12}")
INHERITED = ("repo", "project", "branch")
BATCH = 16  # neighbourhoods whose items are settled together


@dataclass
class Stats:
    shown: int = 0
    new: int = 0
    merged: int = 0
    retired: int = 0
    updated: int = 0
    log: list[str] = field(default_factory=list)


@dataclass
class Run:
    """One enrichment over the tables of a bank; its items, and those of others, are on the driver and bounded by the ratio."""

    config: enrich.Enrichment
    client: Callable[[str], str]
    embed: Embed
    items: enrich.Items
    others: dict[str, tuple[str, np.ndarray]] = field(default_factory=dict)  # items of other enrichments: text and vector
    revised: dict[str, str] = field(default_factory=dict)  # of other enrichments: new text, or "" for gone
    stats: Stats = field(default_factory=Stats)

    def known(self, name: str) -> str | None:
        """The item that a client means, by the twelve hexadecimal digits of its id."""
        m = HEX.search(name or "")
        return next((i for i in (*self.items.texts, *self.others) if m and i.endswith(f":{m[0]}")), None)

    def foreign(self, v: np.ndarray, most: int = enrich.FOREIGN) -> list[str]:
        """The nearest items of other enrichments; one without a vector, or with another size, comes last."""
        near = lambda w: float(w @ v) if w is not None and w.shape == v.shape else -1.0
        return sorted(self.others, key=lambda i: (-near(self.others[i][1]), i))[:most]

    def revise(self, item: str, text: str, by: str | None = None) -> None:
        """A later statement speaks against an item, of this enrichment or another: it is rewritten, or goes if nothing is left."""
        i, text = self.known(item), text.strip()
        if i is None or text == (self.items.texts.get(i) or self.others.get(i, ("",))[0]):
            return
        if i in self.items.texts:
            if text:
                self.items.texts[i], self.items.vectors[i] = text, self.embed(text)
                self.items.states[i] |= {by} if by else set()
            else:
                self.items.retire(i)
        else:
            self.revised[i] = text
            if text:
                self.others[i] = (text, self.embed(text))
            else:
                del self.others[i]
        self.stats.updated += bool(text)
        self.stats.retired += not text
        self.stats.log.append(f"against {i}: {text or 'retired'}")

    def settle(self, drawn: list[dict], shown: list[str] = ()) -> None:
        """Items drawn from a batch, (text, supporters): the client says what they are to the nearest kept ones and to each other."""
        if not drawn:
            return
        vecs = [self.embed(d["text"]) for d in drawn]
        near = list(dict.fromkeys(i for v in vecs for i in self.items.shortlist(v, shown)))[: enrich.SHOWN]
        far = list(dict.fromkeys(i for v in vecs for i in self.foreign(v)))[: enrich.SHOWN // 2]
        lines = [f"item{n}: {d['text']}" for n, d in enumerate(drawn)]
        lines += ["", "Kept:", *(f"{i}: {self.items.texts[i]}" for i in near)]
        lines += ["", "Of other readings:", *(f"{i}: {self.others[i][0]}" for i in far)] if far else []
        form = 'Answer with JSON: {"decisions": [{"item": number, "action": "new|same|update|merge|retire", "id", "text", "merged": [ids]}], "against": [{"id", "text", "item": number}]}\n'
        answer = _object(enrich.complete(self.client, form + "\n".join(lines)))
        decided = {d.get("item"): d for d in answer.get("decisions", ()) if isinstance(d, dict)}
        decisions = []
        for n, d in enumerate(drawn):
            got = decided.get(n, {"action": "new"})
            target = self.known(str(got.get("id") or ""))
            action = got.get("action") if target in self.items.texts or got.get("action") == "new" else "new"
            merged = [i for m in got.get("merged", ()) if (i := self.known(str(m))) in self.items.texts]
            decisions.append({"action": action, "id": target, "text": d["text"] if action == "new" else got.get("text"), "from": d["supporters"], "merged": merged})
        before = len(self.items.texts)
        self.stats.log += self.items.settle(decisions, self.embed)
        self.stats.new += sum(d["action"] == "new" for d in decisions)
        self.stats.merged += max(0, before + sum(d["action"] == "new" for d in decisions) - len(self.items.texts))
        for r in answer.get("against", ()):
            n = r.get("item")
            by = next(iter(drawn[n]["supporters"]), None) if isinstance(n, int) and 0 <= n < len(drawn) else None
            self.revise(str(r.get("id")), str(r.get("text") or ""), by)

    def consolidate(self, selected: int, looked: set[str], dates: dict[str, str]) -> set[str]:
        """Each item not looked at yet with its nearest, oldest first; over the cap with slack also those that were, without long ones,
        until the ratio holds. Gives the items that have been looked at."""
        cap = self.config.cap(selected)
        for pressed in (False, True):
            if pressed and len(self.items.texts) <= enrich.SLACK * cap:
                break
            taken: set[str] = set()
            long = lambda i: pressed and len(self.items.texts[i]) > enrich.LONG_ITEM  # noqa: B023, E731
            for seed in sorted(self.items.texts, key=lambda i: (dates.get(i, ""), i)):
                if seed not in self.items.texts or (not pressed and seed in looked):
                    continue
                if pressed and (seed in taken or long(seed) or len(self.items.texts) <= cap):
                    continue
                v = self.items.vectors[seed]
                rest = [i for i in self.items.texts if i != seed and i not in taken and not long(i)]
                near = sorted(rest, key=lambda i: (-float(self.items.vectors[i] @ v), i))[: self.config.neighbours]
                far = [] if pressed else self.foreign(v)
                looked = looked | {seed}
                if not near and not far:
                    continue
                taken |= {seed, *near}
                lines = [f"- {i}: {self.items.texts.get(i) or self.others[i][0]}" for i in (seed, *near, *far)]
                form = 'Which of these say one thing, and which speaks against another? Answer with JSON: {"merges": [{"id", "with": [ids], "text"}], "revisions": [{"id", "text"}]}\n'
                answer = _object(enrich.complete(self.client, form + "\n".join(lines)))
                for m in answer.get("merges", ()):
                    into, text = self.known(str(m.get("id"))), str(m.get("text") or "").strip()
                    gone = [i for x in m.get("with", ()) if (i := self.known(str(x))) in (seed, *near) and i != into]
                    if into in self.items.texts and text and gone:
                        self.items.absorb(into, gone)
                        self.items.texts[into], self.items.vectors[into] = text, self.embed(text)
                        self.stats.merged += len(gone)
                for r in answer.get("revisions", ()):
                    self.revise(str(r.get("id")), str(r.get("text") or ""))
        return looked & self.items.texts.keys()


def _object(answer: str) -> dict:
    try:
        got = json.loads(answer)
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def kept(nodes: DataFrame, edges: DataFrame, config: enrich.Enrichment, embed: Embed) -> enrich.Items:
    """The items of an enrichment as tables hold them."""
    out = enrich.Items(config.kind)
    for r in nodes.where(F.col("connector") == config.owner).select("id", "text").toLocalIterator():
        out.texts[r.id], out.states[r.id], out.vectors[r.id] = r.text, set(), embed(r.text)
    for r in edges.where((F.col("connector") == config.owner) & (F.col("kind") == "states")).select("from_id", "to_id").toLocalIterator():
        if r.to_id in out.states:
            out.states[r.to_id].add(r.from_id)
    return out


def item_tables(nodes: DataFrame, items: enrich.Items, config: enrich.Enrichment) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of items: an item is as late as its latest supporter and takes over where that one belongs."""
    spark = nodes.sparkSession
    own = spark.createDataFrame([(i, t) for i, t in sorted(items.texts.items())], "id string, text string")
    edges = spark.createDataFrame([(s, i, "states", 1.0, config.owner) for i, who in sorted(items.states.items()) for s in sorted(who)], "from_id string, to_id string, kind string, weight double, connector string")
    behind = edges.select("from_id", F.col("to_id").alias("id")).join(nodes.select(F.col("id").alias("from_id"), "at", "attrs"), "from_id")
    latest = behind.groupBy("id").agg(F.max("at").alias("at"), F.max_by("attrs", F.struct("at", "from_id")).alias("inherited"))
    attrs = F.map_concat(F.map_filter(F.coalesce("inherited", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*INHERITED)), F.create_map(F.lit("type"), F.lit(config.name)))
    return own.join(latest, "id", "left").select("id", F.lit(config.kind).alias("kind"), "text", attrs.alias("attrs"), "at", F.lit(config.owner).alias("connector")), edges


def drawn_items(answers: DataFrame, config: enrich.Enrichment) -> DataFrame:
    """(seed, text, supporters, fields): valid items of the answers, with the enrichment's further fields."""
    more = F.from_json("answer", "items array<map<string,string>>")["items"]
    base = enrich.extracted(answers, config.votes)
    if not config.fields:
        return base.withColumn("fields", F.create_map().cast("map<string,string>"))
    flat = answers.select("seed", F.explode(more).alias("m")).select("seed", F.trim(F.col("m")["text"]).alias("text"), F.map_filter("m", lambda k, _: k.isin(*config.fields)).alias("fields"))
    return base.join(flat.dropDuplicates(["seed", "text"]), ["seed", "text"], "left")


def run(nodes: DataFrame, edges: DataFrame, chunk_vectors: DataFrame, read: DataFrame, config: enrich.Enrichment, client: Callable[[str], str], embed: Embed, looked: set[str] = frozenset(), others: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame, Run]:
    """(item nodes, item edges, (id, enrichment) newly read, the run). chunk_vectors: (node_id, v); read: (id, enrichment)."""
    selected = checkpointed(nodes.where(F.col("text").isNotNull() & config.selects() & ~F.startswith("connector", F.lit("~"))))
    mine = read.where(F.col("enrichment") == config.name).select("id")
    own = vectors.node_vectors(chunk_vectors.join(selected.select(F.col("id").alias("node_id")), "node_id", "left_semi")).withColumnRenamed("node_id", "id")
    near = vectors.knn(own, own, config.neighbours).select("a", "b", "rank")
    groups = checkpointed(enrich.neighbourhoods(selected, near, mine))
    prompts = enrich.prompt_texts(groups, enrich.shown_texts(nodes, edges), nodes, config)
    answers = checkpointed(enrich.answered(prompts, client))
    items = checkpointed(drawn_items(answers, config))
    state = Run(config, client, embed, kept(nodes, edges, config, embed), dict(others or {}))
    order = groups.join(selected.select(F.col("id").alias("seed"), "at"), "seed").join(items.select("seed", "text", "supporters"), "seed").orderBy(F.col("at").asc_nulls_first(), "seed")
    batch, seeds = [], set()
    for r in order.select("seed", "text", "supporters").toLocalIterator():
        if len(seeds) == BATCH and r.seed not in seeds:
            state.settle(batch)
            batch, seeds = [], set()
        seeds.add(r.seed)
        batch.append({"text": r.text, "supporters": set(r.supporters)})
    state.settle(batch)
    dates = {r.id: str(r.at or "") for r in enrich.item_dates(edges, nodes).toLocalIterator()}
    state.looked = state.consolidate(selected.count(), set(looked), dates)
    shown = groups.select(F.explode("members").alias("id")).distinct().withColumn("enrichment", F.lit(config.name))
    state.stats.shown = shown.count()
    return *item_tables(nodes, state.items, config), shown, state


def reset(nodes: DataFrame, edges: DataFrame, read: DataFrame, name: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the items and readings of an enrichment, or of all."""
    gone = F.col("connector") == f"~enrich:{name}" if name else F.startswith("connector", F.lit("~enrich:"))
    return nodes.where(~gone), edges.where(~gone), read.where(F.col("enrichment") != name) if name else read.limit(0)


def live_readings(read: DataFrame, nodes: DataFrame, configs: list[enrich.Enrichment]) -> DataFrame:
    """Readings of nodes that are there and of enrichments that are still set."""
    names = [c.name for c in configs]
    return read.join(nodes.select("id"), "id", "left_semi").where(F.col("enrichment").isin(*names) if names else F.lit(False)).select("id", "enrichment")


def unread(nodes: DataFrame, read: DataFrame, configs: list[enrich.Enrichment]) -> DataFrame:
    """(id): nodes that some enrichment selects and has not read."""
    out = nodes.select("id").limit(0)
    for c in configs:
        wanted = nodes.where(F.col("text").isNotNull() & c.selects() & ~F.startswith("connector", F.lit("~"))).select("id")
        out = out.unionAll(wanted.join(read.where(F.col("enrichment") == c.name).select("id"), "id", "left_anti"))
    return out.distinct()


def node_text(chunks: DataFrame) -> DataFrame:
    """(node_id, text, hash): chunks joined by blank lines."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), "\n\n")
    return chunks.groupBy("node_id").agg(joined.alias("text")).withColumn("hash", T.content_hash(F.col("text")))
