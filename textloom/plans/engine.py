"""The engine's API: a bank's tables under a folder of versions, index runs with their stages, and queries over them."""

from __future__ import annotations

import json
import os
import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vector as V
from textloom.operators import accounting, chunk, enrich, gate, graph, ingest, layer, lexical, metrics, rank, render, vectors, walk
from textloom.plans import enrichment, semantic
from textloom.plans.settings import Bank, SettingError
from textloom.plans.store import Store
from textloom.sources import files, records, sessions

NODES = "id string, kind string, text string, attrs map<string,string>, at timestamp, connector string, hash string, recipe string"
EDGES = "from_id string, to_id string, kind string, weight double, connector string"
RUNS = "connector string, at double, nodes long, changed long, deleted long, embedded long, err string"
TABLES = {"nodes": NODES, "edges": EDGES, "cursors": "connector string, value string", "compacted": "id string, connector string", "vectors": "hash string, v array<double>", "chunks": "node_id string, idx int, hash string, prefix string, text string, line int, end_line int", "postings": "term string, node_id string, idx int, tf long", "lengths": "node_id string, idx int, len long", "runs": RUNS, "readings": "stage string, id string, signature string", "answers": "signature string, answer string"}
BUCKETS = 64  # parts of the postings by a hash of the term; a query reads those of its terms


@dataclass
class Engine:
    """One bank. Readers see the latest version that is marked as whole; a run writes the next one and then marks it.

    home is a folder on any store that Spark reaches. client and embed are callables (``plans.clients``); without them texts get vectors that
    need no model, and stages that ask a model don't run.
    """

    spark: SparkSession
    home: str
    bank: Bank
    client: Callable[[str], str] | None = None
    embed: Callable[[str], list[float]] | None = None
    held: dict = field(default_factory=dict)

    @property
    def root(self) -> str:
        return f"{self.home}/{self.bank.name}"

    @property
    def store(self) -> Store:
        return Store(self.spark, self.root)

    def version(self) -> int:
        return max((int(n[9:]) for n in self.store.names() if n.startswith("COMMITTED")), default=0)

    def table(self, name: str) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/v{v}/{name}") if v and self.store.exists(f"v{v}/{name}") else self.spark.createDataFrame([], TABLES[name])

    def warm(self) -> None:
        """Keep the current version's small tables in memory until another version comes."""
        if self.held.get("version") != (v := self.version()):
            for t in self.held.get("tables", ()):
                t.unpersist()
            self.held = {"version": v, "tables": [self.table(n).cache() for n in ("nodes", "edges", "lengths")]}

    def tables(self) -> ingest.Tables:
        return ingest.Tables(self.table("nodes"), self.table("edges"), self.table("cursors"), self.table("compacted"))

    # --- writing ---

    def _commit(self, tables: ingest.Tables, more: dict[str, DataFrame] | None = None) -> int:
        """Write the next version and mark it; gives the number of texts that got a vector.

        Only nodes that are new or changed are cut, and only their terms are counted; the chunks, postings and lengths of all others
        are taken over. A changed chunker or budget changes each node's recipe, and so all of them.
        """
        old, v = self.version(), self.version() + 1
        put = lambda name, df: df.write.mode("overwrite").parquet(f"{self.root}/v{v}/{name}")
        read = lambda name: self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/v{v}/{name}")
        for name in ("nodes", "edges", "cursors", "compacted"):
            put(name, getattr(tables, name).select(*(x.split()[0] for x in TABLES[name].replace("map<string,string>", "map").split(", "))))
        for name in ("runs", "readings", "answers"):
            put(name, (more or {}).get(name, self.table(name)))
        nodes = read("nodes").where("text is not null")
        change = ingest.changed(self.table("nodes").where("text is not null"), nodes)
        same = change.where("not changed").select(F.col("id").alias("node_id"))
        new = nodes.join(change.where("changed").select("id"), "id", "left_semi")
        engine_made = F.startswith("connector", F.lit("~"))
        cut = chunk.chunks(new.where(~engine_made), self.bank.get("chunker"), self.bank.get("chunk.budget")).drop("start")
        put("fresh", cut.unionByName(ingest.engine_chunk(new.where(engine_made))))
        fresh = read_as(self.spark, f"{self.root}/v{v}/fresh", TABLES["chunks"])
        keep = lambda name: self.table(name).join(same, "node_id", "left_semi").select(*(x.split()[0] for x in TABLES[name].split(", ")))
        put("chunks", keep("chunks").unionByName(fresh))
        chunks = read("chunks")
        had = self.table("vectors").join(chunks.select("hash").distinct(), "hash", "left_semi")
        texts = chunks.select("hash", T.embed_text(F.col("prefix"), F.col("text")).alias("text"))
        made = vectors.embed_missing(texts, had)
        put("vectors", had.unionByName(made))
        embedded = read("vectors").count() - had.count()
        by_term = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
        posts = keep("postings").unionByName(lexical.postings(fresh))
        posts.select("*", by_term).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v{v}/postings")
        source = F.concat(T.base_name(F.col("node_id")), F.lit(" "), T.embed_text(F.col("prefix"), F.col("text")))
        put("lengths", keep("lengths").unionByName(lexical.chunk_lengths(fresh.select("node_id", "idx", source.alias("text")))))
        self.store.write(f"COMMITTED{v}", str(time.time()))
        for name in self.store.names():  # readers may still be on the version before
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) < old:
                self.store.remove(name)
        return embedded

    def connect(self, name: str, cursor: str | None) -> tuple[DataFrame, str]:
        """(records, error) of a connector: a ready stream file, a file tree, session logs, or a process whose output is the stream."""
        spec = self.bank.connectors[name]
        if "path" in spec:
            return records.read_stream_file(self.spark, spec["path"]), ""
        if "fs" in spec:
            rules = [tuple(r.rsplit("=", 1)) for r in spec.get("chunker_for", ())]
            for _, c in rules:
                if c not in chunk.CHUNKERS:
                    raise SettingError(f"no chunker {c}")
            nodes, edges = files.graph(files.walk(self.spark, spec["fs"], spec.get("globs", ["**/*.md"]), spec.get("exclude", [])), name)
            if rules:
                nodes = nodes.withColumn("chunker", chunk.chunker_for(F.col("id"), rules))
            return records.of_tables(nodes, edges, sweep=True), ""
        if "sessions" in spec:
            nodes, edges, latest = sessions.scan(self.spark, spec["sessions"], spec.get("form", "messages"), cursor, name)
            return records.of_tables(nodes, edges, cursor=latest), ""
        if "command" in spec:
            return self._process(name, spec["command"], cursor)
        raise SettingError(f"connector {name} has no source")

    def _process(self, name: str, command: list[str], cursor: str | None) -> tuple[DataFrame, str]:
        """The output of a process, staged on the bank's store; its own messages pass through. Of a process that fails, or states
        a record that is refused, what came up to the last good cursor counts, without its sweep."""
        env = os.environ | {"TEXTLOOM_BANK": self.bank.name, "TEXTLOOM_CURSOR": cursor or ""}
        done = subprocess.run(command, env=env, stdout=subprocess.PIPE, check=False)
        staged = f"staging/{name}.jsonl"
        self.store.write(staged, done.stdout.decode("utf-8", "replace"))
        marked = records.marked(self.spark, f"{self.root}/{staged}")
        bad = marked.where("not ok").agg(F.min("seq").alias("seq")).first().seq
        error = "" if done.returncode == 0 else f"exit {done.returncode}"
        good = marked.where("ok")
        if bad is not None:
            last = good.where("cursor is not null").where(F.col("seq") < records.literal(bad)).agg(F.max("seq").alias("seq")).first().seq
            error = "a record was refused"
            good = good.where(F.col("seq") <= records.literal(last)) if last is not None else good.where("false")
        return (good.where("sweep is null") if error else good).drop("ok"), error

    def index(self, connector: str | None = None, full: bool = False, now: str | None = None, stages: list[Callable[[ingest.Tables], ingest.Tables]] = ()) -> dict[str, dict]:
        """Run one connector or all, then keys, enrichments, the semantic stage, given stages and compaction, under the bank's lock.

        full starts connectors without their cursors. Gives each run's statistics. A run that fails leaves the version as it was.
        """
        names = [connector] if connector else sorted(self.bank.connectors)
        if not names or any(n not in self.bank.connectors for n in names):
            raise SettingError(f"no connector {connector or ''}".strip())
        with self.store.locked():
            t, stats = self.tables(), {}
            for n in names:
                cursor = None if full else next((r.value for r in t.cursors.where(F.col("connector") == n).collect()), None)
                r, error = self.connect(n, cursor)
                t, s = ingest.apply_run(t, r, n, chunk.recipe(self.bank.get("chunker"), self.bank.get("chunk.budget")))
                stats[n] = s.first().asDict() | {"at": time.time(), "err": error}
            t = self._keys(t)
            more: dict[str, DataFrame] = {}
            t = self._enrich(t, more)
            t = self._semantic(t, more)
            for stage in stages:
                t = stage(t)
            t = self._compact(t, now, more)
            rows = [(n, s["at"], s["nodes"], s["changed"], s["deleted"], None, s["err"]) for n, s in stats.items()]
            more["runs"] = self.table("runs").where(~F.col("connector").isin(*stats)).unionByName(self.spark.createDataFrame(rows, RUNS))
            embedded = self._commit(t, more)
            return {n: s | {"embedded": embedded} for n, s in stats.items()}

    def _keys(self, t: ingest.Tables) -> ingest.Tables:
        """Key nodes and edges of every pattern, recomputed whole; those of patterns that are gone go too."""
        nodes, edges = t.nodes.where(~F.startswith("connector", F.lit("~key:"))), t.edges.where(~F.startswith("connector", F.lit("~key:")))
        for name, pattern in self.bank.under("keys").items():
            made, has = accounting.key_edges(nodes, name, pattern)
            nodes = nodes.unionByName(made.select("id", "kind", "connector"), allowMissingColumns=True)
            edges = edges.unionByName(has)
        return ingest.Tables(nodes, edges, t.cursors, t.compacted)

    def enrichments(self) -> list[enrich.Enrichment]:
        """Those that are set, by name; one that is off or has no prompt isn't ready."""
        own: dict[str, dict] = {}
        for key, value in self.bank.under("enrich").items():
            name, _, part = key.partition(".")
            own.setdefault(name, {})[part] = tuple(value) if isinstance(value, list) else value
        return [enrich.Enrichment(n, **{k: v for k, v in p.items() if k != "enabled"}) for n, p in sorted(own.items()) if p.get("enabled", True) and p.get("prompt")]

    def _vector(self, text: str) -> np.ndarray:
        if self.embed:
            v = np.array(self.embed(text), float)
            return v / (np.linalg.norm(v) or 1.0)
        return np.array(self.spark.range(1).select(V.hash_embedding(F.lit(text))).first()[0])

    def _readings(self, more: dict[str, DataFrame]) -> DataFrame:
        return more.get("readings", self.table("readings"))

    def _enrich(self, t: ingest.Tables, more: dict[str, DataFrame]) -> ingest.Tables:
        configs = self.enrichments()
        if not configs or not self.client:
            return t
        read = self._readings(more)
        of = lambda d: d.where(F.startswith("stage", F.lit("enrich:"))).select("id", F.substring("stage", 8, 1 << 20).alias("enrichment"))
        nodes, edges = t.nodes, t.edges
        mine = enrichment.live_readings(of(read), nodes, configs)
        chunks = self.table("chunks").join(self.table("vectors"), "hash").select("node_id", "v")
        for c in configs:
            foreign = nodes.where(F.startswith("connector", F.lit("~enrich:")) & (F.col("connector") != c.owner)).select("id", "text").toLocalIterator()
            others = {r.id: (r.text, self._vector(r.text)) for r in foreign}
            made, states, shown, _ = enrichment.run(nodes, edges, chunks, mine, c, self.client, self._vector, others=others)
            blank = [F.lit(None).cast("string").alias("recipe")]
            nodes = nodes.where(F.col("connector") != c.owner).unionByName(made.select("*", T.content_hash(F.col("text")).alias("hash"), *blank))
            edges = edges.where(F.col("connector") != c.owner).unionByName(states)
            mine = mine.unionByName(shown).distinct()
        rest = read.where(~F.startswith("stage", F.lit("enrich:")))
        more["readings"] = rest.unionByName(mine.select(F.concat(F.lit("enrich:"), "enrichment").alias("stage"), "id", F.lit("").alias("signature")))
        return ingest.Tables(nodes, edges, t.cursors, t.compacted)

    def semantic_settings(self) -> semantic.Settings:
        checks: dict[str, dict[str, float]] = {}
        for key, value in self.bank.under("check").items():
            name, _, part = key.partition(".")
            checks.setdefault(name, {})[part or "enabled"] = float(value)
        get = lambda k: self.bank.get(f"semantic.{k}")
        return semantic.Settings(get("kinds"), get("mentions"), get("votes"), get("rounds"), checks)

    def _semantic(self, t: ingest.Tables, more: dict[str, DataFrame]) -> ingest.Tables:
        if not self.bank.get("semantic") or not self.client:
            return t
        read = self._readings(more)
        mine = read.where("stage = 'semantic'").select("id", "signature")
        save = lambda rows: self.store.append("journal", rows)
        vocabulary = lexical.vocabulary(self.table("postings")).select("term")
        out = semantic.run(t.nodes, t.edges, mine, self.client, str(self.bank.get("embedder")), self.semantic_settings(), self.table("answers"), vocabulary, save)
        nodes = t.nodes.where(F.col("connector") != layer.OWNER).unionByName(out.nodes.withColumn("hash", T.content_hash(F.col("text"))), allowMissingColumns=True)
        edges = t.edges.where(F.col("connector") != layer.OWNER).unionByName(out.edges)
        kept = mine.join(out.readings.select("id"), "id", "left_anti").unionByName(out.readings)
        more["readings"] = read.where("stage <> 'semantic'").unionByName(kept.select(F.lit("semantic").alias("stage"), "id", "signature"))
        more["answers"] = out.answers
        return ingest.Tables(nodes, edges, t.cursors, t.compacted)

    def _compact(self, t: ingest.Tables, now: str | None, more: dict[str, DataFrame]) -> ingest.Tables:
        """The last stage: a container goes once every enrichment and, if it is on, the semantic stage have been over all that is in it."""
        kinds, days = self.bank.get("compact.kinds"), self.bank.get("compact.days")
        if not kinds or not days or not now:
            return t
        read = self._readings(more)
        mine = read.where(F.startswith("stage", F.lit("enrich:"))).select("id", F.substring("stage", 8, 1 << 20).alias("enrichment"))
        waiting = enrichment.unread(t.nodes, mine, self.enrichments())
        if self.bank.get("semantic"):
            wanted = t.nodes.where(semantic.reads(t.nodes, self.bank.get("semantic.kinds"))).select("id")
            waiting = waiting.unionAll(wanted.join(read.where("stage = 'semantic'").select("id"), "id", "left_anti")).distinct()
        cutoff = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
        nodes, edges, dead = accounting.compact(t.nodes, t.edges, kinds, cutoff, t.nodes.select("id").join(waiting, "id", "left_anti"))
        more["readings"] = read.join(dead.select("id"), "id", "left_anti").select("stage", "id", "signature")
        return ingest.Tables(nodes, edges, t.cursors, ingest.upsert(t.compacted, dead, "id"))

    def remove_connector(self, name: str) -> None:
        with self.store.locked():
            t = ingest.remove_connector(self.tables(), name)
            self._commit(t, {"runs": self.table("runs").where(F.col("connector") != name)})
            self.bank.remove_connector(name)

    def remove(self) -> None:
        """The bank's tables, logs and settings."""
        Store(self.spark, self.home).remove(self.bank.name)

    def reset_semantic(self) -> None:
        with self.store.locked():
            t = self.tables()
            own = F.col("connector") != layer.OWNER
            self._commit(ingest.Tables(t.nodes.where(own), t.edges.where(own), t.cursors, t.compacted), {"readings": self.table("readings").where("stage <> 'semantic'")})

    def reset_enrichment(self, name: str | None = None) -> None:
        with self.store.locked():
            t, read = self.tables(), self.table("readings")
            nodes, edges, _ = enrichment.reset(t.nodes, t.edges, read.limit(0).select("id", F.col("stage").alias("enrichment")), name)
            gone = F.col("stage") == f"enrich:{name}" if name else F.startswith("stage", F.lit("enrich:"))
            self._commit(ingest.Tables(nodes, edges, t.cursors, t.compacted), {"readings": read.where(~gone)})

    # --- queries ---

    def search(self, text: str | None = None, start: str | None = None, k: int | None = None, keep: rank.Filter | None = None, with_graph: bool | None = None, now: str | None = None, half_life: float | None = None) -> DataFrame:
        """(id, class, score, mass, is_structural, pos, sources, idx, also, seed) of a text query, or of a walk from a node."""
        return self._search(text, start, k, keep, with_graph, now, half_life)[0]

    def _search(self, text, start=None, k=None, keep=None, with_graph=None, now=None, half_life=None) -> tuple[DataFrame, str]:
        nodes, edges, chunks, warning = self.table("nodes"), self.table("edges"), self.table("chunks"), ""
        keep, k = keep or rank.Filter(), k or self.bank.get("search.k")
        allowed = nodes.where(keep.column())
        none = F.array().cast("array<int>")
        with_graph = self.bank.get("search.graph") if with_graph is None else with_graph
        net = walk.damped(walk.walk_edges(nodes, edges, {n: float(w) for n, w in self.bank.under("weight").items()}, self.bank.get("search.mute"), {n: int(c) for n, c in self.bank.under("degree_cap").items()})) if start or with_graph else None
        if start:
            found = walk.from_node(net, nodes, start).join(allowed.select("id"), "id", "left_semi")
            hits = found.select("id", F.lit(0.0).alias("score"), "mass", F.lit(0).alias("idx"), none.alias("also"), F.lit(False).alias("seed"))
        else:
            ids = allowed.select(F.col("id").alias("node_id"))
            terms = lexical.query_terms(self.spark, text)
            buckets = [r.b for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
            posts = self.table_of("postings", "bucket int").where(F.col("bucket").isin(*buckets)) if buckets else self.table("postings")
            channels = [lexical.bm25(posts, self.table("lengths"), terms).join(ids, "node_id", "left_semi")]
            try:
                q = self._vector(text).tolist()
                near = vectors.dense_scan(self.table("vectors"), q, "hash")
                channels.insert(0, near.join(chunks.select("hash", "node_id", "idx"), "hash").join(ids, "node_id", "left_semi"))
            except Exception as e:  # an embedder that fails leaves the words, and the answer says so
                warning = f"no vectors for this query ({e}); ranked by words alone"
            fused = rank.reciprocal_rank_fusion([rank.ranked(c.select("node_id", "idx", "score"), "node_id", "idx") for c in channels], "node_id", "idx")
            hits = rank.best_chunk(fused).select(F.col("node_id").alias("id"), "score", "idx", "also", F.lit(True).alias("seed"))
            if with_graph:
                mass = walk.ppr_push(net, rank.seeds(hits, self.bank.get("search.seeds")))
                hits = walk.merge_walk(hits.select("id", "score"), mass, allowed).join(hits.select("id", "idx", "also", "seed"), "id", "left")
                hits = hits.select("id", "score", "mass", F.coalesce("idx", F.lit(0)).alias("idx"), F.coalesce("also", none).alias("also"), F.coalesce("seed", F.lit(False)).alias("seed"))
            else:
                hits = hits.withColumn("mass", F.lit(0.0))
        counts = chunks.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n_chunks"))
        met = hits.join(allowed.select("id", "kind", "connector", "at"), "id").join(counts, "id", "left")
        half_life = self.bank.get("search.half_life") if half_life is None else half_life
        if now and half_life:
            met = rank.half_life(met, F.lit(now).cast("timestamp"), half_life, "score", "mass")
        classes = [(n, tuple(v for v in values if "*" not in v and "/" not in v), tuple(v for v in values if "*" in v or "/" in v)) for n, values in self.bank.under("class").items()]
        met = met.withColumns({"class": rank.node_class(classes), "is_structural": rank.structural(layer.OWNER)})
        cut = rank.class_cut(met.select("id", "class", "score", "mass", "is_structural"), k, [n for n, *_ in classes])
        out = cut.join(rank.source_counts(nodes, edges), "id", "left").join(met.select("id", "idx", "also", "seed"), "id")
        return out.orderBy("pos"), warning

    def table_of(self, name: str, more: str) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(f"{TABLES[name]}, {more}").parquet(f"{self.root}/v{v}/{name}") if v else self.spark.createDataFrame([], f"{TABLES[name]}, {more}")

    def answer(self, text: str = "", as_json: bool = False, full: bool = False, chars: int = T.SNIPPET_RUNES, attrs: list[str] = (), **options) -> str:
        """A search as it is read: text, or JSON; a failed channel shows as a warning."""
        hits, warning = self._search(text or None, **options)
        terms = self.spark.range(1).select(T.tokens(F.lit(text))).first()[0] if text else []
        rows = render.hit_rows(hits, self.table("nodes"), self.table("chunks"), terms, full, chars).orderBy("pos").collect()  # k hits a class
        return render.as_json(text, rows, warning) if as_json else render.as_text(rows, attrs, full, warning)

    def query(self, options: dict) -> dict:
        """The same for a caller that holds options as JSON: text or from, k (10 without), kinds, attrs, owner, since, muted, graph, full, chars."""
        now = options.get("now")
        since = T.since(options["since"], F.lit(now).cast("timestamp") if now else F.current_timestamp()) if options.get("since") else None
        keep = rank.Filter(tuple(options.get("kinds", ())), options.get("attrs", {}), options.get("owner", ""), since, tuple(options.get("muted", ())))
        return json.loads(self.answer(options.get("text", ""), True, options.get("full", False), options.get("chars", T.SNIPPET_RUNES), start=options.get("from"), k=options.get("k", 10), keep=keep, with_graph=options.get("graph"), now=now))

    def node(self, node_id: str, first: int | None = None, last: int | None = None) -> DataFrame:
        """A node's chunks, or those that overlap lines."""
        c = self.table("chunks").where(F.col("node_id") == node_id)
        return graph.overlapping(c, first, last or first) if first else c

    def record(self, node_id: str) -> DataFrame:
        """(id, kind, attrs, at, connector, n_chunks, text): a node as it is described; its text is that of its chunks."""
        return node_records(self.table("nodes").where(F.col("id") == node_id), self.node(node_id))

    def neighbours(self, node_id: str) -> DataFrame:
        return graph.neighbours(self.table("nodes"), self.table("edges"), node_id)

    def detail(self, node_id: str) -> dict[str, DataFrame]:
        """A node's chunks, its edges in groups, and the first of what it reaches."""
        n, e = self.table("nodes"), self.table("edges")
        return {"chunks": self.node(node_id), "edges": graph.node_detail(n, e, node_id), "reach": graph.reach_top(graph.reach(n, e, node_id))}

    def payload(self, **options) -> dict[str, DataFrame | bool]:
        """Nodes of a picture of the graph, the edges among them, and whether nodes were left out."""
        n, e = self.table("nodes"), self.table("edges")
        shown = graph.payload_nodes(n, e, **options)
        return {"nodes": shown, "edges": graph.induced_edges(e, shown.select("id")), "truncated": shown.count() < n.count()}

    def nodes(self, kind: str | None = None) -> DataFrame:
        """(id, kind, chunks)."""
        n = self.table("nodes")
        n = n.where(F.col("kind") == kind) if kind else n
        c = self.table("chunks").groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("chunks"))
        return n.select("id", "kind").join(c, "id", "left").na.fill(0, ["chunks"])

    def items(self, k: int = 20, type_: str | None = None, by_sources: bool = False) -> DataFrame:
        """(id, at, sources) of the enrichments' items, newest first or by sources."""
        n = self.table("nodes").where(F.startswith("connector", F.lit("~enrich:")))
        n = n.where(T.attr(F.col("attrs"), "type") == type_) if type_ else n
        s = n.join(rank.source_counts(n, self.table("edges")), "id", "left").select("id", "at", F.coalesce("sources", F.lit(0)).alias("sources"))
        return s.orderBy(*([F.desc("sources")] if by_sources else []), F.col("at").desc_nulls_last(), "id").limit(k)

    def find_items(self, text: str, type_: str | None = None, k: int = 5, half_life_days: float = 90, now: str | None = None) -> str:
        """Items that answer a query, in full; older ones count less."""
        keep = rank.Filter(attrs={"type": type_} if type_ else {}, owner_prefix="~enrich:")
        return self.answer(text, full=True, attrs=["type"], k=k, keep=keep, now=now, half_life=half_life_days * 86400)

    def enrichment_status(self) -> dict[str, dict]:
        """Items, read and pending texts of each enrichment."""
        read = self.table("readings").where(F.startswith("stage", F.lit("enrich:"))).select("id", F.substring("stage", 8, 1 << 20).alias("enrichment"))
        return {c.name: enrich.status(self.table("nodes"), read, c).first().asDict() for c in self.enrichments()}

    def export_graphml(self, path: str, **picked) -> None:
        chunks = self.table("chunks").groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n_chunks"))
        graph.write_graphml(graph.graphml_lines(self.table("nodes").join(chunks, "id", "left"), self.table("edges"), **picked), path)

    def show(self) -> dict:
        """Settings, the bank in numbers, the last run and the stages' status."""
        n, e, c = self.table("nodes"), self.table("edges"), self.table("chunks")
        numbers = {"nodes": n.count(), "texts": n.where("text is not null").count(), "edges": e.count(), "chunks": c.count(), "vectors": self.table("vectors").count()}
        return {"settings": dict(self.bank.settings), "connectors": dict(self.bank.connectors), "counts": numbers, "kinds": [r.asDict() for r in graph.bank_summary(n).collect()], "last_run": self.latest_run(), "semantic": self.semantic_status(), "enrichments": self.enrichment_status()}

    def latest_run(self) -> dict | None:
        r = latest_run(self.table("runs")).first()
        return r.asDict() if r else None

    def semantic_status(self) -> dict:
        read = self.table("readings").where("stage = 'semantic'").select("id", "signature")
        return semantic.status(self.table("nodes"), self.table("edges"), read, semantic.extractor_id(str(self.bank.get("embedder"))), self.bank.get("semantic.kinds")).first().asDict()

    def semantic_log(self, n: int = 20, rejected: bool = False) -> list[dict]:
        return self.store.tail("journal", n, rejected)

    def graph_stats(self, semantic_only: bool = False) -> dict:
        """The whole graph, or the layer with its texts, by the metrics that the gate uses on regions."""
        n, e = self.table("nodes"), self.table("edges")
        if semantic_only:
            n, e = n.where(F.col("text").isNotNull() | (F.col("connector") == layer.OWNER)), e.where(F.col("connector") == layer.OWNER)
        return metrics.whole_graph(n, graph.adjacency(n, e))

    def graph_check(self) -> list[dict]:
        """Each enabled band on both graphs, with its verdict and loss, and the hubs and shortcuts to look at where one is missed."""
        checks = gate.checks_of(self.semantic_settings().checks)
        out = []
        for name, only in (("bank", False), ("semantic", True)):
            m = self.graph_stats(only)
            measured = {"scale_free": m["scale_free"].get("gamma"), "fractal": m["fractal"].get("dimension")}
            bands = {k: (p["low"], p["high"]) for k, p in checks.items() if k in measured}
            out += [{"graph": name} | row for row in metrics.bank_check(measured, bands)]
        if any(r["verdict"] == "miss" for r in out):
            n, e = self.table("nodes"), self.table("edges")
            adj = graph.adjacency(n, e)
            deg = metrics.degree_table(n, adj)
            blame = {"hubs": [r.id for r in metrics.hubs(deg, 5).collect()], "shortcuts": [r.id for r in metrics.shortcuts(adj, deg, 5).collect()]}
            out = [r | (blame if r["verdict"] == "miss" else {}) for r in out]
        return out

    def usage(self, by: str = "model", since: str | None = None) -> DataFrame:
        log = self.store.usage()
        log = log.where(F.col("at") >= F.lit(since).cast("timestamp")) if since else log
        return accounting.usage_rollup(accounting.priced(log, self.store.prices()), by)


def read_as(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def node_records(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, kind, attrs, at, connector, n_chunks, text) of nodes."""
    joined = enrichment.node_text(chunks).select(F.col("node_id").alias("id"), F.col("text").alias("whole"))
    counts = chunks.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    met = nodes.join(joined, "id", "left").join(counts, "id", "left")
    return met.select("id", "kind", "attrs", "at", "connector", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("whole", F.lit("")).alias("text"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest of the connectors' last runs."""
    return runs.orderBy(F.desc("at"), "connector").limit(1)


def run_due(engines: list[Engine], now: float, fallback: int = 0) -> dict[str, str]:
    """Index the banks whose period has passed since their last run; a bank that fails doesn't keep others from theirs."""
    out = {}
    for e in engines:
        period = e.bank.get("index.every") or fallback
        last = e.latest_run()
        if not period or (last and now - last["at"] < period):
            continue
        try:
            e.index()
            out[e.bank.name] = "ok"
        except Exception as x:  # one bank's failure is its own
            out[e.bank.name] = str(x)
    return out
