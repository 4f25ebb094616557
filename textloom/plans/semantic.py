"""The semantic stage: passages are named by a model client, names are voted on, answers become patches, and patches pass the gate.

Asking is distributed and its answers are tables keyed by signature, so that a run resumes where another one stopped; the gate and
what follows from its order run on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import enrich, gate, layer
from textloom.operators.tables import checkpointed

Client = Callable[[str], str]
PROMPT_VERSION = 1
EXCERPT, DESCRIBED, AROUND, SHOWN, PAIRS_AT_ONCE, SAVED = 6000, 8, 700, 30, 10, 512


def extractor_id(model: str, version: int = PROMPT_VERSION) -> str:
    return f"{version}|{model}"


def reads(nodes: DataFrame, kinds: list[str] | None = None) -> Column:
    """Text nodes that aren't the layer's own, of the kinds if any are named."""
    own = F.col("text").isNotNull() & (F.col("connector") != layer.OWNER)
    return own & F.col("kind").isin(*kinds) if kinds else own


def excerpt(text: Column, runes: int = EXCERPT) -> Column:
    """A text, or its headings up to a quarter of the room and then its beginning."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"^\s{0,3}#{1,6}\s")))
    outline = F.left(F.array_join(lines, "\n"), F.lit(runes // 4))
    cut = F.when(outline == "", F.left(text, F.lit(runes))).otherwise(F.concat(outline, F.lit("\n\n"), F.left(text, F.lit(runes) - F.char_length(outline) - 2)))
    return F.when(F.char_length(text) <= runes, text).otherwise(cut)


def asked(prompts: DataFrame, client: Client, stored: DataFrame | None = None) -> DataFrame:
    """(signature, answer) of prompts (signature, prompt): stored answers stay, the client is asked for the rest; JSON or {}."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"signature": pdf.signature, "answer": [enrich.complete(client, p) for p in pdf.prompt]})

    known = stored.join(prompts.select("signature"), "signature", "left_semi").select("signature", "answer") if stored is not None else None
    new = prompts if known is None else prompts.join(known.select("signature"), "signature", "left_anti")
    got = new.mapInPandas(ask, "signature string, answer string")
    return checkpointed(got if known is None else known.unionByName(got))


def names_of(passages: DataFrame, answers: DataFrame) -> DataFrame:
    """(node_id, name): valid names of the first pass, lower-cased with single spaces."""
    found = answers.select("signature", F.explode(F.from_json("answer", "names array<string>")["names"]).alias("name")).withColumn("name", T.collapsed(F.lower("name")))
    return passages.join(found.where(T.is_entity_name(F.col("name"))), "signature").select(F.col("id").alias("node_id"), "name").distinct()


def canonical(names: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """(node_id, name) with plurals folded where the vocabulary (term) has the singular."""
    if vocabulary is None:
        return names
    return names.join(layer.folded_plurals(names, vocabulary), "name").select("node_id", F.col("canonical").alias("name")).distinct()


def evidence_passages(edges: DataFrame, nodes: DataFrame, entities: DataFrame, most: int = DESCRIBED, around: int = AROUND) -> DataFrame:
    """(id, passage, n): for each entity (id, forms) texts that mention it, itself or by its topics, about the first of its forms."""
    part = edges.where("kind = 'part_of'").select(F.col("from_id").alias("topic"), F.col("to_id").alias("id"))
    mention = edges.where("kind = 'mentions'").select("from_id", F.col("to_id").alias("target"))
    via = mention.join(part, mention["target"] == part["topic"]).select("from_id", "id")
    texts = mention.select("from_id", F.col("target").alias("id")).unionAll(via).distinct().join(entities.select("id"), "id", "left_semi").join(nodes.select(F.col("id").alias("from_id"), "at").distinct(), "from_id")
    # The first texts of an entity are told before any text is moved.
    w = Window.partitionBy("id").orderBy(F.col("at").desc_nulls_last(), "from_id")
    first = texts.select("id", "from_id", F.row_number().over(w).alias("n")).where(F.col("n") <= most)
    texts = first.join(entities, "id").join(nodes.select(F.col("id").alias("from_id"), "text"), "from_id")
    low = F.lower("text")
    places = F.filter(F.transform("forms", lambda f: F.call_function("instr", low, F.lower(f))), lambda p: p > 0)
    at = F.coalesce(F.array_min(places), F.lit(1))
    start = F.greatest(F.lit(1), at - around // 2)
    return texts.select("id", F.substring(F.col("text"), start.cast("int"), F.lit(around)).alias("passage"), "n")


@dataclass
class Settings:
    kinds: list[str] = field(default_factory=list)
    mentions: int = gate.MENTIONS
    votes: int = layer.VOTES
    rounds: int = gate.ROUNDS
    checks: dict[str, dict[str, float]] = field(default_factory=dict)


def loaded(nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> gate.Layer:
    """The layer that tables hold, for the gate; entities are bounded by the budget."""
    own = nodes.where(F.col("connector") == layer.OWNER)
    lines = lambda v: [x for x in (v or "").split("\n") if x]
    entities = {r.id: gate.Entity(r.kind, r.attrs.get("name") or r.id.partition(":")[2], lines(r.attrs.get("aliases")), r.attrs.get("paragraph") or "") for r in own.select("id", "kind", "attrs").toLocalIterator()}
    held = edges.where(F.col("connector") == layer.OWNER).select("from_id", "to_id", "kind", "weight")
    ids = {r.id for r in texts.select("id").toLocalIterator()}
    return gate.Layer(ids, entities, {(r.from_id, r.to_id, r.kind): r.weight for r in held.toLocalIterator() if (r.from_id in ids or r.from_id in entities) and r.to_id in entities})


def stored(spark, own: gate.Layer) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a layer, of the semantic owner."""
    nodes = [(i, e.kind, e.text(), e.attrs(), layer.OWNER) for i, e in sorted(own.entities.items())]
    edges = [(*k, w, layer.OWNER) for k, w in sorted(own.edges.items())]
    return spark.createDataFrame(nodes, "id string, kind string, text string, attrs map<string,string>, connector string"), spark.createDataFrame(edges, "from_id string, to_id string, kind string, weight double, connector string")


@dataclass
class Outcome:
    nodes: DataFrame
    edges: DataFrame
    readings: DataFrame  # (id, signature) of what was read
    answers: DataFrame  # (signature, answer)
    journal: list[dict]


def run(nodes: DataFrame, edges: DataFrame, read: DataFrame, client: Client, model: str, settings: Settings, answers: DataFrame | None = None, vocabulary: DataFrame | None = None, save: Callable[[list[dict]], None] | None = None) -> Outcome:
    """One run over what is pending. read: (id, signature) of earlier runs; save gets the journal's new lines every SAVED passages."""
    spark = nodes.sparkSession
    texts = checkpointed(nodes.where(reads(nodes, settings.kinds)))
    todo = checkpointed(layer.pending(texts, read, extractor_id(model)).join(texts.select("id", "text"), "id"))
    own = loaded(nodes, edges, texts)
    for r in todo.select("id").toLocalIterator():
        own.forget(r.id)  # the text is new, or not what was read
    naming = todo.select("signature", F.concat(F.lit('Name what this passage is about. Answer with JSON: {"names": [...]}\n\n'), excerpt(F.col("text"))).alias("prompt"))
    first = asked(naming, client, answers)
    names = checkpointed(canonical(names_of(todo, first), vocabulary))
    kept = layer.within_budget(layer.votes(names), layer.room(len(own.texts), own.kinds["entity"]), settings.votes)
    new = [r.name for r in kept.toLocalIterator()]
    voted = {gate.semantic_id("entity", n) for n in new}
    known = [(i, x) for i, e in own.entities.items() for x in (e.name, *e.aliases)] + [(gate.semantic_id("entity", n), n) for n in new]
    known_names = spark.createDataFrame(known, "entity string, name string")
    found = layer.candidates(todo.select(F.col("id").alias("node_id"), "text"), known_names)
    lists = found.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "entity"))), lambda s: s["entity"]), "\n").alias("near"))
    form = 'Which of these does the passage mention, and how sure is it? Answer with JSON: {"mentions": [{"id" or "name", "confidence"}]}\n'
    asks = todo.join(lists, "id", "left").select(F.concat_ws("|", "signature", F.lit("mentions"), F.md5(F.coalesce("near", F.lit("")).cast("binary"))).alias("signature"), "id", "at", F.concat(F.lit(form), F.coalesce("near", F.lit("")), F.lit("\n\n"), excerpt(F.col("text"))).alias("prompt"))
    asks = checkpointed(asks)
    second = asked(asks.select("signature", "prompt"), client, answers)
    checks, journal, room = gate.checks_of(settings.checks), [], layer.room(len(own.texts))
    passages = asks.join(second, "signature").orderBy(F.col("at").desc_nulls_last(), "id").select("id", "answer")

    def revise(ops: list[dict], evidence: dict) -> list[dict]:
        if any(c["check"] == "entity_budget" and c["decision"] == "reject" for c in evidence["checks"]):
            return gate.within_room(ops, own, room)
        return gate.parsed_revision(client("Revise this patch.\n" + gate.rejection_text(evidence, own)), ops) or gate.without_weakest(ops)

    saved = 0
    for r in passages.toLocalIterator():
        if ops := gate.answer_patch(r.id, _object(r.answer), own, voted, settings.mentions):
            journal += [e | {"node": r.id} for e in gate.run_gate(own, [ops], checks, settings.rounds, revise)]
        if save and len(journal) - saved >= SAVED:
            save(journal[saved:])
            saved = len(journal)
    swept(own, settings.votes)
    new_nodes, new_edges = stored(spark, own)
    if save and len(journal) > saved:
        save(journal[saved:])
    given = first.unionByName(second)
    return Outcome(new_nodes, new_edges, todo.select("id", "signature"), given if answers is None else answers.join(given.select("signature"), "signature", "left_anti").unionByName(given), journal)


def _object(answer: str) -> dict:
    try:
        got = json.loads(answer)
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def swept(own: gate.Layer, votes: int = layer.VOTES) -> list[str]:
    """Remove topics without texts and entities of fewer texts than votes, until none is left; what went."""
    gone: list[str] = []
    while True:
        texts: dict[str, set[str]] = {}
        for f, t, k in own.edges:
            if k == "mentions":
                texts.setdefault(t, set()).add(f)
        for f, t, k in own.edges:
            if k == "part_of":
                texts.setdefault(t, set()).update(texts.get(f, ()))
        weak = [e for e, x in own.entities.items() if len(texts.get(e, ())) < (1 if x.kind == "topic" else votes)]
        if not weak:
            return gone
        for e in weak:
            own.forget(e)
            own._put(e, None)
        gone += weak


def merges(own: gate.Layer, pairs: list[tuple[str, str, float]], client: Client) -> list[list[dict]]:
    """Patches of the pairs that the client calls the same, asked for in batches; the one with more neighbours stays."""
    out = []
    for i in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[i : i + PAIRS_AT_ONCE]
        lines = "\n".join(f"{n}: {own.entities[a].name} / {own.entities[b].name}" for n, (a, b, _) in enumerate(part))
        same = _object(enrich.complete(client, f'Which pairs are one thing? Answer with JSON: {{"same": [numbers]}}\n{lines}')).get("same", [])
        for n in same:
            if isinstance(n, int) and 0 <= n < len(part):
                a, b, _ = part[n]
                kept, gone = sorted((a, b), key=lambda e: (-len(own.neighbours(e)), e))
                out.append([gate.merge(gone, kept)])
    return out


def status(nodes: DataFrame, edges: DataFrame, read: DataFrame, extractor: str, kinds: list[str] | None = None) -> DataFrame:
    """(texts, processed, pending, mentions, entities, topics)."""
    texts = nodes.where(reads(nodes, kinds))
    waiting = layer.pending(texts, read, extractor).agg(F.count("*").alias("pending"))
    own = nodes.where(F.col("connector") == layer.OWNER).agg(F.count_if(F.col("kind") == "entity").alias("entities"), F.count_if(F.col("kind") == "topic").alias("topics"))
    mentions = edges.where((F.col("connector") == layer.OWNER) & (F.col("kind") == "mentions")).agg(F.count("*").alias("mentions"))
    out = texts.agg(F.count("*").alias("texts")).crossJoin(waiting).crossJoin(mentions).crossJoin(own)
    return out.select("texts", (F.col("texts") - F.col("pending")).alias("processed"), "pending", "mentions", "entities", "topics")
