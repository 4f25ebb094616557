import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import accounting, chunk, enrich, gate, graph, ingest, layer, metrics
from textloom.plans import clients, enrichment, semantic
from textloom.plans.engine import Engine
from textloom.plans.settings import Bank, SettingError
from textloom.sources import files, records, sessions
from textloom.streaming.ingest import run_available

STREAM = ['{"node":{"id":"a","kind":"document","text":"alpha text"}}', '{"node":{"id":"b","kind":"document","text":"beta text TK-1"}}', '{"node":{"id":"t","kind":"tag"}}', '{"edge":{"from":"a","to":"t","kind":"tagged"}}', '{"edge":{"from":"b","to":"t","kind":"tagged"}}', '{"cursor":{"value":"7"}}', '{"sweep":{}}']


def records_of(spark, lines):
    return records.valid(records.parsed(spark.createDataFrame(list(enumerate(lines)), "seq long, value string")))


@pytest.fixture
def empty(spark):
    e = lambda s: spark.createDataFrame([], s)
    return ingest.Tables(e("id string, kind string, text string, attrs map<string,string>, at timestamp, connector string, hash string, recipe string"), e("from_id string, to_id string, kind string, weight double, connector string"), e("connector string, value string"), e("id string, connector string"))


def test_ingest_rerun_and_sweep(spark, empty):
    t, s = ingest.apply_run(empty, records_of(spark, STREAM), "c", "text@1/1600")
    assert s.first().asDict() == {"nodes": 3, "changed": 3, "deleted": 0} and t.edges.count() == 2 and t.cursors.first().value == "7"
    t2, s = ingest.apply_run(t, records_of(spark, STREAM), "c", "text@1/1600")
    assert s.first().asDict() == {"nodes": 3, "changed": 0, "deleted": 0}
    t3, s = ingest.apply_run(t2, records_of(spark, [STREAM[0], STREAM[2], STREAM[3], STREAM[6]]), "c", "text@1/1600")
    assert s.first().deleted == 1 and t3.nodes.count() == 2 and t3.edges.count() == 1
    assert ingest.remove_connector(t3, "c").nodes.isEmpty()


@pytest.mark.parametrize("line", ['{"node":{"id":""}}', '{"edge":{"from":"a","to":"b"}}', '{"node":{"id":"a"},"delete":{"id":"b"}}', "no json"])
def test_bad_records_fail(spark, line):
    with pytest.raises(Exception, match="record 1"):
        records_of(spark, [STREAM[0], line]).collect()


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(STREAM))
    got = []
    run = lambda: run_available(spark, f"{tmp_path}/in", f"{tmp_path}/cp", lambda r, _: got.extend(x.node.id for x in r.where("node is not null").collect())).awaitTermination()
    run()
    assert sorted(got) == ["a", "b", "t"]
    (tmp_path / "in/b.jsonl").write_text(STREAM[0].replace('"a"', '"z"'))
    run()
    assert sorted(got) == ["a", "b", "t", "z"]


def test_engine_round(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(STREAM))
    bank = Bank("notes")
    bank.add_connector("c", {"path": f"{tmp_path}/s.jsonl"})
    bank.set("keys.ticket", "TK-[0-9]+")
    e = Engine(spark, str(tmp_path), bank)
    assert e.index()["c"]["changed"] == 3 and e.version() == 1 and e.warm() is None
    assert e.index()["c"]["changed"] == 0
    kept_chunks = {r.hash for r in e.table("chunks").collect()}
    (tmp_path / "s.jsonl").write_text("\n".join([STREAM[0].replace("alpha text", "alpha other text"), *STREAM[1:]]))
    s = e.index()["c"]
    assert s["changed"] == 1 and s["embedded"] == 1 and len(kept_chunks & {r.hash for r in e.table("chunks").collect()}) == len(kept_chunks) - 1
    assert e.table("postings").where("term = 'other'").count() == 1
    (tmp_path / "s.jsonl").write_text("\n".join(STREAM))
    e.index()
    assert "1 b" in e.answer("beta") and e.query({"text": "beta"})["hits"][0]["id"] == "b" and e.record("a").first().text == "alpha text"
    with e.store.locked(), pytest.raises(SettingError):
        e.index()
    assert e.latest_run()["connector"] == "c" and e.show()["counts"]["nodes"] == 3
    broken = Engine(spark, str(tmp_path), bank, embed=lambda t: 1 / 0)
    assert broken.answer("beta").startswith("! no vectors")
    hits = e.search("beta").collect()
    assert hits[0].id == "b" and {r.id for r in e.search("beta", with_graph=True).collect()} >= {"b", "a"}
    assert e.node("a").first().text == "alpha text" and {r.other for r in e.neighbours("t").collect()} == {"a", "b"}
    e.export_graphml(f"{tmp_path}/g")
    bank.save(str(tmp_path))
    assert Bank.load(str(tmp_path), "notes") == bank


def test_settings_grammar():
    b = Bank("x")
    assert b.set("chunk.budget", "400") == "texts are cut again"
    for key, value in (("chunk.budget", "5"), ("nope", "1"), ("index.every", "5s"), ("keys.k", "("), ("chunker", "xml")):
        with pytest.raises(SettingError):
            b.set(key, value)
    b.set("keys.k", "[A-Z]+-[0-9]+")
    b.set("keys.k", "off")
    assert b.under("keys") == {}


def test_keys_need_two_holders(spark):
    n = spark.createDataFrame([("x TK-1", "c"), ("y TK-1", "c"), ("z TK-2", "c"), ("w", "c")], "id string, connector string")
    made, edges = accounting.key_edges(n, "ticket", "TK-[0-9]+")
    assert [r.id for r in made.collect()] == ["ticket:TK-1"] and edges.count() == 2


def test_components_and_reach(spark):
    n = spark.createDataFrame([(c, "k", None, {}, None) for c in "abcdefg"], "id string, kind string, text string, attrs map<string,string>, at timestamp")
    e = spark.createDataFrame([("a", "b", "k", 1.0), ("b", "c", "k", 1.0), ("e", "d", "k", 1.0), ("f", "f", "k", 1.0), ("g", "zz", "k", 1.0)], "from_id string, to_id string, kind string, weight double")
    got = {r.id: r.component for r in graph.components(n, e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}
    assert {r.id for r in graph.parts(n, e, spark.createDataFrame([("c",)], "root string")).collect()} == {"a", "b", "c"}


def test_zeta_and_exponents():
    assert metrics.zeta(2, 1) == pytest.approx(np.pi**2 / 6, abs=1e-9) and metrics.zeta(4, 1) == pytest.approx(np.pi**4 / 90, abs=1e-9)
    rng = np.random.default_rng(7)
    for true in (2.2, 2.5, 3.0):
        k = np.arange(1, 100_000)
        p = k**-true
        d, c = np.unique(rng.choice(k, 5000, p=p / p.sum()), return_counts=True)
        m = metrics.scale_free(dict(zip(d.tolist(), c.tolist(), strict=True)))
        assert abs(m["gamma"] - true) <= 0.15 and m["ks"] <= 0.05
    assert metrics.scale_free({2: 12})["status"] == "too_small"


def test_ball_growth_of_a_ring(spark):
    n = 60
    adj = spark.createDataFrame([(i, (i + s) % n) for i in range(n) for s in (1, n - 1)], "u long, v long")
    sizes = {r.r: r.n for r in metrics.ball_sizes(adj, spark.range(5), 6).collect()}
    assert sizes == {r: 2 * r + 1 for r in range(7)}
    assert 0.7 <= metrics.growth_slope(sizes, n)["dimension"] <= 1.1
    assert metrics.growth_slope({0: 1, 1: 60, 2: 60}, n)["status"] == "saturated"


def state(own):
    return dict(own.edges), {i: (e.kind, e.name, tuple(e.aliases), e.paragraph) for i, e in own.entities.items()}, {k: dict(v) for k, v in own.near.items() if v}, own.counts(), {k: v for k, v in own.degrees.items() if v and k}


def test_gate_keeps_or_undoes_whole_patches():
    own = gate.Layer({"t1", "t2"})
    good = [gate.add_entity("X"), gate.add_mention("t1", "entity:x")]
    assert gate.propose(own, good)["decision"] == "accept" and own.counts()["singletons"] == 1
    before = state(own)
    assert gate.propose(own, [gate.add_mention("t2", "entity:x"), gate.add_mention("nowhere", "entity:x")])["decision"] == "reject" and state(own) == before
    evidence = gate.propose(own, [gate.add_entity(f"e{i}") for i in range(60)])
    assert evidence["decision"] == "reject" and [c["check"] for c in evidence["checks"] if c["decision"] == "reject"] == ["entity_budget"] and state(own) == before


def test_any_trial_can_be_undone_and_counts_follow():
    rng = np.random.default_rng(6)
    own = gate.Layer({f"t{i}" for i in range(12)})
    for step in range(300):
        ents, texts = sorted(own.entities), sorted(own.texts)
        pick = lambda xs: xs[int(rng.integers(len(xs)))]  # noqa: B023, E731
        ops = [gate.add_entity(f"n{rng.integers(20)}")]
        if ents:
            ops += [gate.add_mention(pick(texts), pick(ents)), *([gate.merge(pick(ents), pick(ents))] if rng.random() < 0.3 else []), *([gate.split(pick(ents), f"s{step}", texts[:4])] if rng.random() < 0.2 else []), *([gate.insert_topic(pick(ents), f"p{step}", texts[4:8])] if rng.random() < 0.2 else []), gate.describe(pick(ents), f"d{step}")]
        before = state(own)
        with own.trial() as trial:
            try:
                for op in ops:
                    own.apply(op)
            except ValueError:
                trial.undo()
                assert state(own) == before
                continue
            ids = gate.footprint(ops)
            assert all(own.neighbours(x, True) == frozenset(before[2].get(x, {})) for x in ids)
            if step % 2:
                trial.undo()
                assert state(own) == before
        fresh = gate.Layer(own.texts, dict(own.entities), dict(own.edges))
        assert state(fresh)[3:] == state(own)[3:]


def test_regions_are_whole_shells_over_both_sides():
    own = gate.Layer({f"t{i}" for i in range(6)}, {f"e{i}": gate.Entity("entity") for i in range(4)}, {(f"t{i}", f"e{j}", "mentions"): 1.0 for i, j in [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2), (4, 2)]})
    with own.trial():
        own.apply(gate.merge("e0", "e2"))
        r = gate.region(own, ["e0", "e2"], hops=1)
        assert r.nodes == ["e0", "e2", "t0", "t1", "t3", "t4"] and r.boundary == 1 and not r.truncated
        before, after = gate.view(own, r, True, {}), gate.view(own, r, False, {})
        assert "e0" in before.nodes and "e0" not in after.nodes and before.degrees["e0"] == 2 and after.degrees["e2"] == 4 and "e0" not in before.anchors
    assert gate.region(own, ["e2"], hops=2, most=3).truncated


def test_revisions_and_answers():
    own = gate.Layer({"t"}, {"entity:a": gate.Entity("entity", "a")})
    ops = gate.answer_patch("t", {"mentions": [{"name": "A", "confidence": 0.5}, {"name": "new one", "confidence": 0.9}, {"name": "no votes", "confidence": 1}, {"id": "entity:a", "confidence": 0.7}]}, own, {"entity:new one"})
    assert [op.get("entity") for op in ops] == ["entity:new one", "entity:new one", "entity:a"]
    assert gate.without_weakest(ops) == ops[:2] and gate.within_room(ops, own, 1) == ops[2:]
    assert gate.parsed_revision('```json\n{"action": "mentions", "keep": ["entity:a"]}\n```', ops) == [ops[0], ops[2]]
    assert gate.parsed_revision('{"action": "insert_intermediate", "entity": "entity:a", "name": "part", "nodes": ["t"]}', ops)[0]["new"] == "topic:part"
    assert gate.parsed_revision('{"action": "give_up"}', ops) is None and gate.parsed_revision("no", ops) is None
    assert "entity:a" in gate.rejection_text({"ops": ops, "checks": []}, own) and gate.summary(ops).startswith("1 add_entity, 2 add_mention")
    assert list(gate.checks_of()) == ["entity_budget", "scale_free"] and "fractal" in gate.checks_of({"fractal": {"enabled": 1}})


def test_semantic_stage(spark):
    import json

    texts = {f"d{i}": f"the heron stands by the {'weir' if i % 2 else 'mill'} number {i}" for i in range(8)}
    nodes = spark.createDataFrame([(i, "document", t, {}, None, "c", None, None) for i, t in texts.items()], "id string, kind string, text string, attrs map<string,string>, at timestamp, connector string, hash string, recipe string")
    edges = spark.createDataFrame([], "from_id string, to_id string, kind string, weight double, connector string")

    def client(prompt):
        if prompt.startswith("Name"):
            return json.dumps({"names": ["Heron", "Mill" if "mill" in prompt else "Weir", "number 7"]})
        return json.dumps({"mentions": [{"id": "entity:heron", "confidence": 0.9}, {"name": "mill" if " mill " in prompt else "weir", "confidence": 0.8}]})

    none = spark.createDataFrame([], "id string, signature string")
    out = semantic.run(nodes, edges, none, client, "m", semantic.Settings())
    assert {r.id for r in out.nodes.collect()} == {"entity:heron", "entity:mill", "entity:weir"} and out.edges.count() == 16 and out.readings.count() == 8
    again = semantic.run(nodes, edges, out.readings, lambda p: 1 / 0, "m", semantic.Settings(), out.answers)
    assert again.readings.count() == 0
    seen = semantic.evidence_passages(out.edges, nodes, spark.createDataFrame([("entity:mill", ["mill"])], "id string, forms array<string>"), most=3, around=12)
    assert [r.n for r in seen.orderBy("n").collect()] == [1, 2, 3] and all("mill" in r.passage for r in seen.collect())
    s = semantic.status(nodes, out.edges, out.readings, semantic.extractor_id("m")).first()
    assert (s.texts, s.processed, s.pending, s.mentions) == (8, 8, 0, 16)


def test_excerpts(spark):
    text = "# One\n" + "a" * 50 + "\n## Two\n" + "b" * 500
    got = spark.createDataFrame([(text,), ("short",)], "t string").select(semantic.excerpt(F.col("t"), 100).alias("x")).collect()
    assert got[0].x.startswith("# One\n## Two\n\n# One\naaa") and len(got[0].x) == 100 and got[1].x == "short"


def test_clients():
    assert clients.Spec.parse("local:m:7b", {"local": ""}) == clients.Spec("local", "m:7b") and clients.Spec.parse("local", {"local": "d"}).model == "d"
    with pytest.raises(SettingError):
        clients.Spec.parse("nope", {"local": ""})
    waits, tries = [], []

    def busy(x):
        tries.append(x)
        if len(tries) < 3:
            raise clients.Busy(wait=7 if len(tries) == 1 else None)
        return x

    assert clients.retried(busy, sleep=waits.append)("a") == "a" and waits == [7, 2.0]
    sizes = []

    def embed(texts):
        if len(texts) > 3:
            raise clients.TooLarge
        sizes.append(len(texts))
        return [[float(t)] for t in texts]

    assert clients.batched(embed, 10)([str(i) for i in range(12)]) == [[float(i)] for i in range(12)] and max(sizes) <= 3
    r = clients.Registry()
    r.add("p", "m", "TEXTLOOM_TEST_KEY", lambda m, k: lambda q: (m, k, q))
    with pytest.raises(SettingError):
        r.client("p")("q")


def test_enrichment_run(spark):
    import json

    nodes = spark.createDataFrame([(f"m{i}", "message", f"always use tabs {i}", {"session": "s", "repo": "r"}, f"2024-01-0{i + 1}", "c") for i in range(5)], "id string, kind string, text string, attrs map<string,string>, at string, connector string").withColumn("at", F.col("at").cast("timestamp"))
    edges = spark.createDataFrame([], "from_id string, to_id string, kind string, weight double, connector string")
    rng = np.random.default_rng(1)
    vecs = spark.createDataFrame([(f"m{i}", rng.normal(size=4).tolist()) for i in range(5)], "node_id string, v array<double>")
    config = enrich.Enrichment("style", "Draw rules.", neighbours=2)
    asked = []

    def client(prompt):
        asked.append(prompt)
        if prompt.startswith("Draw"):
            return json.dumps({"items": [{"text": "use tabs", "from": [1, 2]}, {"text": "", "from": [1]}, {"text": "nobody", "from": [99]}]})
        return json.dumps({"decisions": []})

    made, states, shown, run = enrichment.run(nodes, edges, vecs, spark.createDataFrame([], "id string, enrichment string"), config, client, lambda t: np.array([float(len(t)), 1.0]))
    row = made.collect()
    assert [r.text for r in row] == ["use tabs"] and row[0].attrs == {"repo": "r", "type": "style"} and row[0].at is not None and shown.count() == 5
    assert states.where("kind = 'states'").count() >= 2 and enrichment.unread(nodes, shown, [config]).isEmpty()
    assert enrichment.unread(nodes, shown.limit(0), [config]).count() == 5 and enrichment.live_readings(shown, nodes, []).isEmpty()


def test_items_are_revised_and_pressed_together():
    answers = iter(['{"merges": [{"id": "%s", "with": ["%s"], "text": "both"}], "revisions": []}'])
    embed = lambda t: np.array([1.0, len(t) / 100])
    items = enrich.Items()
    for k in range(14):
        items.put(f"item {k}", {f"s{k}"}, embed(f"item {k}"))
    run = enrichment.Run(enrich.Enrichment("e", ratio=0.0001), lambda p: '{"merges": [{"id": "%s", "with": ["%s"], "text": "both"}]}' % tuple(x.split(":")[1] for x in [p.split("- ")[1], p.split("- ")[2]]), embed, items, {"fact:abcdefabcdef": ("old", embed("old"))})
    looked = run.consolidate(10, set(items.texts), {})
    assert len(items.texts) <= 14 - 2 and run.stats.merged >= 2 and looked <= items.texts.keys()
    run.revise("abcdefabcdef", "newer", "s1")
    assert run.revised == {"fact:abcdefabcdef": "newer"} and run.foreign(embed("x")) == ["fact:abcdefabcdef"]
    run.revise("abcdefabcdef", "")
    assert run.others == {} and next(answers)


def test_merge_split_and_sweep(spark):
    e = spark.createDataFrame([("t1", "e1", "mentions", 1.0), ("t2", "e1", "mentions", 1.0), ("t2", "e2", "mentions", 1.0)], "from_id string, to_id string, kind string, weight double")
    merged = layer.merge_entities(e, spark.createDataFrame([("e1", "e2")], "from_entity string, into string"))
    assert {(r.from_id, r.to_id) for r in merged.collect()} == {("t1", "e2"), ("t2", "e2")}
    moved = layer.split_entity(e, "e1", "e3", spark.createDataFrame([("t2",)], "id string"))
    assert {(r.from_id, r.to_id) for r in moved.collect()} == {("t1", "e1"), ("t2", "e3"), ("t2", "e2")}
    ents = spark.createDataFrame([("e1", "entity"), ("e2", "entity"), ("tp", "topic")], "id string, kind string")
    kept, left = layer.sweep(ents, e, 2)
    assert [r.id for r in kept.collect()] == ["e1"] and left.count() == 2


def test_enrichment_settles_and_absorbs():
    items = enrich.Items()
    embed = lambda s: np.array([len(s), 1.0])
    items.settle([{"action": "new", "text": "one", "from": ["a"]}, {"action": "new", "text": "two!", "from": ["b"]}], embed)
    one, two = enrich.item_id("rule", "one"), enrich.item_id("rule", "two!")
    log = items.settle([{"action": "new", "text": "x", "from": ["z"]}, {"action": "merge", "id": one, "merged": [two], "from": ["c"]}, {"action": "retire", "id": "rule:none"}], embed)
    assert log[0].startswith("merge") and items.states[one] == {"a", "b", "c"} and two not in items.texts
    assert enrich.Enrichment("e").cap(1000) == 50 and enrich.Enrichment("e").cap(10) == 10
    answers = iter(["not json", '```json\n{"items": []}\n```'])
    assert enrich.complete(lambda _: next(answers), "p") == '{"items": []}'


def test_neighbourhoods_cover_oldest_first(spark):
    texts = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-01"), (3, "2024-01-03")], "id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    near = spark.createDataFrame([(2, 1, 1)], "a long, b long, rank int")
    got = [(r.seed, list(r.members)) for r in enrich.neighbourhoods(texts, near, spark.createDataFrame([], "id long")).collect()]
    assert got == [(2, [2, 1]), (3, [3])]


def test_text_chunks_keep_heading_paths():
    text = "---\ntitle: Bread\n---\n# Dough\n\nflour and water\n\n## Rest\n\n" + "wait a day. " * 20 + "\n\n```\n# no heading\n\nstill code\n```\n"
    got = chunk.chunk_text(text, 120)
    assert got[0].prefix == "Bread › Dough" and any(c.prefix == "Bread › Dough › Rest" for c in got)
    assert all(c.stop - c.start <= 120 for c in got)
    joined = "".join(text[c.start : c.stop] for c in got)
    assert "still code" in joined and "flour" in joined
    assert chunk.chunk_text("", 100) == [] and chunk.chunk_none("x", 100)[0].stop == 1


def test_code_chunks():
    from textloom.plans.catalogue import GO_TEXT, YAML_TEXT

    go = chunk.chunk_go(GO_TEXT, 80)
    assert [c.prefix for c in go] == ["shop › func Sum(a, b int) int", "shop › type Pair struct"]
    assert chunk.chunk_go("not go at all", 100)[0].prefix == ""
    yaml = chunk.chunk_yaml(YAML_TEXT, 1000)
    assert [c.prefix for c in yaml] == ["Service web", "Job nightly"]
    assert len(chunk.chunk_yaml(YAML_TEXT, 40)) > 2


def test_file_tree(spark, tmp_path):
    for name, body in {"a.md": "# Top\n[b](sub/b.md#x) [gone](none.md) [web](https://x.y)", "sub/b.md": "[up](../a.md)", ".hidden/c.md": "x", "node_modules/d.md": "x", "e.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    w = files.walk(spark, str(tmp_path))
    assert {r.rel for r in w.collect()} == {"a.md", "sub/b.md"}
    assert {(r.from_path, r.to_path) for r in files.links(w).collect()} == {("a.md", "sub/b.md"), ("sub/b.md", "a.md")}
    nodes, edges = files.graph(w)
    assert {r.id: r.attrs.get("title") for r in nodes.where("kind = 'document'").collect()} == {"a.md": "Top", "sub/b.md": None}
    assert {(r.from_id, r.to_id) for r in edges.where("kind = 'contains'").collect()} == {("", "a.md"), ("", "sub"), ("sub", "sub/b.md")}


def test_session_log(spark):
    import json

    rows = [{"type": "user", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w/p", "gitBranch": "main", "message": {"content": "fix it"}}, {"type": "user", "message": {"content": "fix it"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "a.py"}}]}}, {"type": "user", "isMeta": True, "message": {"content": "meta"}}]
    logs = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(rows)], "session string, line_no int, value string")
    talk = sessions.items(logs, "messages")
    assert [(r.role, r.text) for r in sessions.turns(talk).orderBy("seq").collect()] == [("user", "fix it"), ("assistant", "ok")]
    nodes, edges = sessions.graph(talk, "log")
    assert {r.kind for r in nodes.collect()} == {"message", "reply", "session", "repo", "branch"}
    assert ("reply:s:2", "/w/p/a.py") in {(r.from_id, r.to_id) for r in edges.where("kind = 'edits'").collect()}


def test_short_replies_fold(spark):
    replies = spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(["short", "L" * 300, "tail"])], "session string, turn_no int, seq int, text string")
    got = sessions.folded_replies(replies).collect()
    assert len(got) == 1 and got[0].n_folded == 3 and got[0].text.startswith("short\n\nLLL") and got[0].text.endswith("tail")


def test_process_connector_keeps_what_came_before_a_refused_record(spark, tmp_path):
    bank = Bank("p")
    script = tmp_path / "c.py"
    script.write_text("import os\nprint('\\n'.join(" + repr([STREAM[0], STREAM[5], STREAM[1], '{"node":{"id":""}}', STREAM[6]]) + "))\nassert os.environ['TEXTLOOM_BANK'] == 'p'")
    bank.add_connector("x", {"command": ["python3", str(script)]})
    e = Engine(spark, f"file://{tmp_path}", bank)
    got = e.index()["x"]
    assert got["err"] == "a record was refused" and [r.id for r in e.table("nodes").collect()] == ["a"] and e.table("cursors").first().value == "7"


def test_records_are_in_order_of_files(spark, tmp_path):
    for name, text, pad in (("b.jsonl", "late", 0), ("a.jsonl", "early", 400)):
        (tmp_path / name).write_text("\n".join(['{"node":{"id":"n","text":"%s"}}' % text] + ["" for _ in range(pad)]))
    t, _ = ingest.apply_run(ingest.Tables(*(spark.createDataFrame([], s) for s in ("id string, kind string, text string, attrs map<string,string>, at timestamp, connector string, hash string, recipe string", "from_id string, to_id string, kind string, weight double, connector string", "connector string, value string", "id string, connector string"))), records.read_stream_file(spark, str(tmp_path)), "c", "r")
    assert t.nodes.first().text == "late"


def test_connectors_may_not_state_edges_of_the_layer(spark, empty):
    held = ingest.Tables(empty.nodes, spark.createDataFrame([("a", "t", "tagged", 1.0, "~semantic")], empty.edges.schema), empty.cursors, empty.compacted)
    with pytest.raises(Exception, match="semantic layer"):
        ingest.apply_run(held, records_of(spark, STREAM), "c", "text@1/1600")


def test_store(spark, tmp_path):
    from textloom.plans.store import Store

    s = Store(spark, f"file://{tmp_path}/bank")
    s.used("b", "enrich", "m", 10, 5, at=0)
    s.used("b", "enrich", "m", 0, 0)
    s.set_price("m", 2, 4)
    assert s.usage().count() == 1 and {(r.model, r.price_in) for r in s.prices().collect()} == {("hash", 0.0), ("m", 2.0)}
    with pytest.raises(SettingError):
        s.used("b", "nope", "m", 1, 1)
    s.append("journal", [{"n": 1, "decision": "accept"}, {"n": 2, "decision": "reject"}])
    s.append("journal", [{"n": 3, "decision": "accept"}])
    assert [r["n"] for r in s.tail("journal", 2)] == [2, 3] and [r["n"] for r in s.tail("journal", 5, rejected=True)] == [2]
    with s.locked(), pytest.raises(SettingError), s.locked():
        pass
    s.write("LOCK", '{"at": 0}')
    with s.locked(now=1e9):
        pass
    assert not s.exists("LOCK")


def test_graphml(spark, tmp_path):
    n = spark.createDataFrame([(f"n{i:02}", "doc" if i % 3 else "tag", "x <y>" if i % 2 else None, {"a": "b"}, None, "c") for i in range(25)], "id string, kind string, text string, attrs map<string,string>, at timestamp, connector string")
    e = spark.createDataFrame([(f"n{i:02}", f"n{(i * 7) % 25:02}", "k", float(i % 2), "c") for i in range(25)] + [("n01", "gone", "k", 0.0, "c")], "from_id string, to_id string, kind string, weight double, connector string")
    rows, arcs, lost = graph.graphml(n, e)
    assert [r.id for r in rows.orderBy("n").collect()] == sorted(f"n{i:02}" for i in range(25)) and lost.first().dangling == 1
    keys = [(r.from_id, r.to_id, r.kind) for r in arcs.orderBy("e").collect()]
    assert keys == sorted(keys) and [r.e for r in arcs.orderBy("e").collect()] == list(range(25))
    graph.write_graphml(graph.graphml_lines(n, e), f"{tmp_path}/g")
    import xml.etree.ElementTree as ET

    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(text.encode())
    assert len(root.findall(".//{*}node")) == 25 and len(root.findall(".//{*}edge")) == 25 and root.find(".//{*}edge/{*}data[@key='e_weight']").text == "0.0"


def test_lognormal_ratio_equals_a_fine_grid():
    rng = np.random.default_rng(3)
    d, c = np.unique(np.maximum(1, rng.lognormal(1.2, 0.8, 3000).astype(int)), return_counts=True)
    g = metrics.fit_gamma(d, c, 1)
    k = d.astype(float)
    best = -np.inf
    for mu in np.linspace(0.2, 2.2, 201):
        for sigma in np.linspace(0.4, 1.6, 121):
            up = lambda x: 0.5 * metrics._erfc((np.log(x) - mu) / sigma / np.sqrt(2))  # noqa: B023, E731
            logs = np.log(up(k - 0.5) - up(k + 0.5)) - np.log(up(np.array([0.5])))
            if (v := float((c * logs).sum())) > best:
                best, at = v, logs
    diff = -g * np.log(k) - np.log(metrics.zeta(g, 1)) - at
    mean = (c * diff).sum() / c.sum()
    want = mean * np.sqrt(c.sum() / ((c * (diff - mean) ** 2).sum() / c.sum()))
    assert metrics.lognormal_ratio(d, c, 1, g) == pytest.approx(want, rel=0.02) and want < -5
    assert metrics.lognormal_ratio(np.array([3]), np.array([9]), 3, 2.0) == 0.0


def test_links_are_followed_without_circles(tmp_path):
    (tmp_path / "r/a").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (tmp_path / "out/x.md").write_text("x")
    (tmp_path / "r/a/y.md").write_text("y")
    (tmp_path / "r/l").symlink_to(tmp_path / "out")
    (tmp_path / "r/up").symlink_to(tmp_path / "r")
    (tmp_path / "r/again").symlink_to(tmp_path / "out")
    (tmp_path / "r/f.md").symlink_to(tmp_path / "r/a/y.md")
    got = [a for a, _ in files.linked_files(str(tmp_path / "r"))]
    assert got == ["again/x.md", "f.md"]


def test_session_scan(spark, tmp_path):
    import json

    rows = [{"type": "user", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w/p", "message": {"content": "fix <system-reminder>hidden</system-reminder> it"}}, *({"type": "assistant", "message": {"content": [{"type": "text", "text": t}]}} for t in ("short one", "L" * 250))]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, rows)))
    nodes, edges, latest = sessions.scan(spark, str(tmp_path))
    texts = {r.id: r.text for r in nodes.where("text is not null").collect()}
    assert texts["message:s1:0"] == "fix  it" or texts["message:s1:0"] == "fix it"
    assert [t for i, t in texts.items() if i.startswith("reply")] == ["short one\n\n" + "L" * 250] and latest
    assert sessions.scan(spark, str(tmp_path), cursor=latest)[0].isEmpty()
