"""Steps that larger tables have to take another way, held against the plain one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import gate, graph, layer, lexical, metrics, rank, vectors, walk
from textloom.plans import catalogue, semantic

NODES = "id string, kind string, text string, at timestamp"
EDGES = "from_id string, to_id string, kind string, weight double"


def test_balls_of_many_centres_and_past_the_end(spark):
    n = 90
    adj = spark.createDataFrame([(i, (i + s) % n) for i in range(n) for s in (1, n - 1)] + [(1000, 1001), (1001, 1000)], "u long, v long")
    assert {r.r: r.n for r in metrics.ball_sizes(adj, spark.range(n), 4).collect()} == {r: 2 * r + 1 for r in range(5)}  # more centres than bits
    assert [r.n for r in metrics.ball_sizes(adj, spark.createDataFrame([(1000,)], "id long"), 3).orderBy("r").collect()] == [1, 2, 2, 2]


def test_fits_of_many_tails_and_erfc():
    d, c = np.arange(1, 40), np.round(5000 * np.arange(1, 40) ** -2.3).astype(int) + 1
    tails = [(d[d >= k], c[d >= k], k) for k in (1, 2, 5, 9)]
    assert metrics.fit_gammas(tails) == pytest.approx([metrics.fit_gamma(*t) for t in tails], rel=1e-12)
    assert metrics.zetas(2.5, d) == pytest.approx([metrics.zeta(2.5, int(k)) for k in d], rel=1e-14)
    x = np.linspace(-7, 28, 5001)
    assert metrics._erfc(x[None])[0] == pytest.approx([math.erfc(v) for v in x], rel=1e-14, abs=1e-300)


def test_arcs_of_a_view_are_made_when_asked_for():
    own = gate.Layer(["d1", "d2"])
    with own.trial():
        own.apply(gate.add_entity("x"))
        own.apply(gate.add_mention("d1", "entity:x"))
        v = gate.view(own, gate.region(own, ["entity:x"]), False, own.counts())
        assert "arcs" not in vars(v) and v.arcs == {"d1": ["entity:x"], "entity:x": ["d1"]} and v.degrees == {"d1": 1, "entity:x": 1}


def test_future_gains_only_where_asked(spark):
    hits = spark.sql("select timestamp'2024-02-08' at, 1.0D score union all select null, 1.0D")
    now = F.lit("2024-02-01").cast("timestamp")
    score = lambda **k: sorted(r.score for r in rank.half_life(hits, now, 7 * 86400, "score", **k).collect())
    assert score() == [1.0, 1.0] and score(past_only=False) == score(past_only=False, exact=True) == [1.0, 2.0]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_knn_with_equal_vectors_and_strips(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 4)), 1 if kind == "double" else 0).astype(np.float32).astype(float)
    x[40:80] = x[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id long, v array<{kind}>")
    got = {(r.a, r["rank"]): r.b for r in vectors.knn(df, df, 3, block=25).collect()}
    d = np.round(x @ x.T, 12)
    np.fill_diagonal(d, -np.inf)
    assert got == {(i, k + 1): int(j) for i in range(120) for k, j in enumerate(np.lexsort((np.arange(120), -d[i]))[:3])}
    kept = vectors.packed(df, 200, keep=4)  # one block: of forty equal vectors four are left
    assert len({i for r in kept.collect() for i in r.ids if 40 <= i < 80}) == 4


def test_pairs_of_many_strips(spark):
    x = np.random.default_rng(9).normal(size=(1300, 3)) * 1e20  # beyond what single precision multiplies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {(r.a, r.b) for r in vectors.near_pairs(df, 8e40, block=700).collect()}
    d = np.triu(x @ x.T, 1)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d >= 8e40), strict=True)} and got


def test_candidates_tell_ties_by_name(spark):
    names = [f"n{i}" for i in (10, 9, 2, 1)]
    made = layer.candidates(spark.createDataFrame([(1, "")], "node_id long, text string"), spark.createDataFrame([(n, n) for n in names], "entity string, name string"), spark.createDataFrame([(1, 0, [1.0])], "node_id long, idx int, v array<double>"), spark.createDataFrame([(n, [1.0]) for n in names], "entity string, v array<double>"), most=2)
    assert sorted(r.entity for r in made.collect()) == ["n1", "n10"]


def test_long_chains_shrink_to_components(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(400) if i % 100 != 99], "u long, v long")
    rounds = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(graph, "checkpointed", lambda df, after=(), f=graph.checkpointed: rounds.append(1) or f(df))
        got = {r.n: r.c for r in graph.component_numbers(f_written(pairs)).collect()}
    groups = {}
    for n, c in got.items():
        groups.setdefault(c, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [list(range(k, k + 100)) for k in (0, 100, 200, 300)]
    assert len(rounds) <= 40  # two a round, not one for each link


def f_written(df):
    return graph.checkpointed(df)


def test_first_passages_are_told_before_texts_are_moved(spark):
    edges = spark.createDataFrame([(f"d{i}", "e", "mentions", 1.0) for i in range(4)], EDGES)
    nodes = spark.createDataFrame([(f"d{i}", "k", f"text {i}", None) for i in (0, 0, 1, 2, 3)], NODES)  # d0 twice
    got = semantic.evidence_passages(edges, nodes, spark.createDataFrame([("e", ["text"])], "id string, forms array<string>"), most=2)
    assert sorted((r.n, r.passage) for r in got.collect()) == [(1, "text 0"), (1, "text 0"), (2, "text 1")]


def test_walk_keeps_what_seeds_reach(spark, monkeypatch):
    monkeypatch.setattr(walk, "SMALL", 2)  # so the larger sides are hashed
    parts = [(f"a{i}", f"a{i + 1}", "k", 1.0) for i in range(3)] + [(f"b{i}", f"b{i + 1}", "k", 1.0) for i in range(200)]
    e = spark.createDataFrame(parts, EDGES)
    near = walk.within_reach(e, spark.createDataFrame([("a2",)], "id string"))
    assert sorted(r.from_id for r in near.collect()) == ["a0", "a1", "a2"]
    assert walk.within_reach(e, spark.createDataFrame([("b9",)], "id string")).count() == len(parts)  # most of the graph: all of it


def test_push_brings_no_edges_of_what_it_does_not_push(spark, monkeypatch):
    arcs = [("s", "hub", 1.0), *((f"leaf{i}", "hub", 1.0) for i in range(500)), ("s", "t", 1.0)]
    net = spark.createDataFrame([*arcs, *((v, u, w) for u, v, w in arcs)], "u string, v string, w double")
    asked = []
    monkeypatch.setattr(walk, "checkpointed", lambda df, f=walk.checkpointed: asked.append(out := f(df)) or out)
    mass = {r.id for r in walk.ppr_push(net, spark.createDataFrame([("s", 1.0)], "id string, s double"), epsilon=1e-2).collect()}
    assert mass == {"s", "t"} and all(df.where("u = 'hub'").isEmpty() for df in asked if df.columns == ["u"])


def test_vocabulary_of_texts_equals_that_of_postings(spark):
    docs = spark.createDataFrame([(1, 0, "b a b"), (2, 0, "a"), (3, 0, None), (4, 0, "")], "node_id long, idx int, text string")
    both = [sorted(map(tuple, v.collect())) for v in (lexical.text_vocabulary(docs), lexical.vocabulary(lexical.text_postings(docs)))]
    assert both[0] == both[1] == [("a", 2, 2), ("b", 2, 1)]


@pytest.mark.parametrize("again", [False, True])
def test_names_of_repeated_documents_vote_once(spark, tmp_path, again):
    rows = [(1, "abcdefgh abcdefgh ijklmnop 123456789"), (1 if again else 2, "abcdefgh")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    votes = {r.name: r.votes for r in layer.votes(catalogue.named(spark, str(tmp_path))).collect()}
    assert votes == {"abcdefgh": 1 if again else 2, "ijklmnop": 1}
    terms = {r.term: (r.cf, r.df) for r in catalogue.tokenize_terms(spark, str(tmp_path)).collect()}
    assert terms["abcdefgh"] == (3, 1 if again else 2)
    loss = catalogue.singleton_check(spark, str(tmp_path)).first()
    assert loss.lang == "en" and loss.loss is None


def test_ends_are_not_joined_below_a_union(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    e = spark.createDataFrame([("a", "b")], "from_id string, to_id string")
    live = graph.live_edges(nodes, e.unionAll(e).unionAll(e.where("from_id = 'z'")))
    assert live.count() == 2 and live._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
