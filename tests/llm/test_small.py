"""Each operator on a small table of defined cases: nulls, empty and long texts, ties, repeated rows, extra columns; and on an empty table."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import license_scan, media_avi, near_dedup, packing, piece_lattice, quality_rules, substring_dedup, suffix_dedup, token_counts, tokens, toxicity

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdeilnorst"), RNG.integers(2, 9))) for _ in range(300)]
prose = lambda n: " ".join(RNG.choice(WORDS, n))
PASSAGE, BASE = prose(60), prose(200)
TEXTS = {
    1: BASE,
    2: BASE,
    3: BASE.replace(BASE.split()[100], "other", 1),
    4: None,
    5: "",
    6: prose(40) + " " + PASSAGE + " " + prose(40),
    7: prose(30) + "\n" + PASSAGE + "\n" + prose(30),
    8: "MIT under the MIT License! under the\nmit license",
    9: "Ａé ß 梦 " * 30,
    10: prose(6000),
    11: "one two",
    12: "one two",
    13: "Licensed under the Apache License, Version 2.0. cc-by NC",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in TEXTS.items()] + [(11, "one two", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, word string")
    df.write.mode("overwrite").parquet(path := f"/tmp/textloom-test-{hashlib.md5(repr(rows).encode()).hexdigest()}")
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, digest string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def raw(i):
    return (TEXTS[i] or "").encode()


def test_near_dedup(docs, none):
    got = by_id(near_dedup.near_duplicates(docs))

    def shingles(i):
        w = raw(i).decode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(i) for i in TEXTS}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), label[i]) for i in sets}
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_stage_takes_80_percent(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        w = [f"w{x}" for x in rng.integers(0, 10**9, 104)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:92], *(f"v{x}" for x in rng.integers(0, 10**9, 3))]))]  # 88 of 103 shingles in common, or 85.4 %
        rows += [(1000 + 2 * k, " ".join(x := [f"w{x}" for x in rng.integers(0, 10**9, 104)])), (1001 + 2 * k, " ".join(x[:86]))]  # 82 of 100
        rows += [(2000 + 2 * k, " ".join(x := [f"w{x}" for x in rng.integers(0, 10**9, 104)])), (2001 + 2 * k, " ".join(x[:66]))]  # 62 of 100
    made = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.stage(spark, made, "").collect()}
    assert kept == {i for i, _ in rows if i >= 2000 or i % 2 == 0}
    found = by_id(near_dedup.near_duplicates(made, 60))
    assert all(found[i].component_id == i - i % 2 for i, _ in rows)
    assert near_dedup.matches_at(85) == 38


def test_suffix_dedup(docs, none):
    got = by_id(suffix_dedup.suffix_dedup(docs))
    seen: dict[bytes, int] = {}
    for i in sorted(TEXTS):
        t, gone = raw(i), bytearray(len(raw(i)))
        for k in range(len(t) - 49):
            if seen.setdefault(t[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(t), sum(gone), hashlib.sha256(left).hexdigest())
        assert got[i].n_spans == len(re.findall(b"\1+", bytes(gone)))
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_dedup_keeps_rows_of_one_doc_id_apart(spark):
    base = prose(60)
    rows = [(1, base), (2, "abc" + base + "xyz"), (2, prose(70)), (2, base), (3, base[:300] + prose(20)), (3, prose(20) + base[100:400])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    least, want = {}, []
    for i, t in rows:
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(i, least.get(t[k : k + 50], i))
    for i, t in rows:
        gone = {k + j for k in range(len(t) - 49) if least[t[k : k + 50]] < i for j in range(50)}
        want.append((i, len(t), len(gone)))
    assert got == sorted(want) and want[1][2] >= len(base) and want[2][2] == 0


def test_anchors_hold_in_texts_longer_than_a_step():
    one = bytes(RNG.integers(97, 101, 150_000, np.uint8))
    at, h = suffix_dedup.anchors(one)
    gaps = np.diff(at)
    assert at[0] < suffix_dedup.WINDOW and gaps.max() <= suffix_dedup.WINDOW and (gaps > 0).all() and at[-1] > len(one) - suffix_dedup.MATCH - 1
    part, _ = suffix_dedup.anchors(one[70_000:70_400])
    assert set(part + 70_000) <= set(at.tolist())


def test_substring_dedup(docs, none):
    got = by_id(substring_dedup.deduped(docs))
    for i, r in got.items():
        cut = list(zip(r.starts, r.ends, strict=True))
        assert substring_dedup.left_over(raw(i), np.array([a for a, _ in cut]), np.array([b for _, b in cut])) == r.kept_text
    assert got[1].n_removed == 0 and got[11].n_removed == 0 and got[6].n_removed == 0 and got[10].n_removed == 0
    # A passage within a line goes but for the phrases at its ends, which hold words of their surroundings.
    assert got[2].n_removed == len(raw(2)) and 0.6 * len(PASSAGE) < got[7].n_removed <= len(PASSAGE)
    assert substring_dedup.deduped(none).count() == 0


def test_shared_passages_go_whole(spark):
    rng = np.random.default_rng(11)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    wrapped = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    rows, passages = [], {}
    for k in range(60):  # each passage of 51 words in three documents: as it is, wrapped at two widths, and among other words
        passages[k] = text(51)
        rows += [(3 * k, " ".join(text(20) + passages[k] + text(20))), (3 * k + 1, wrapped(text(30) + passages[k] + text(9), 7)), (3 * k + 2, wrapped(text(3) + passages[k] + text(70), 5))]
    own = text(60)
    rows += [(1000, " ".join(own + text(40) + own)), (1001, " ".join(text(40) + own[:55] + text(5)))]
    got = by_id(substring_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows[: 3 * len(passages)]:
        words = t.split() if i % 3 == 0 else [x for x in t.split() if x not in passages[i // 3]]
        assert got[i].kept_text.decode().split() == words
    assert len(got[1000].kept_text.split()) == 100 and len(got[1001].kept_text.split()) == 45


def test_license_scan(docs, none):
    got = by_id(license_scan.scan(docs))
    for i in TEXTS:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), raw(i).decode())
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, v) for p, v in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in places})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert set(got[i].base_labels.split(",")) - {""} <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1
    assert len(license_scan.rules()) > 300 and license_scan.scan(none).count() == 0


def test_license_suppression(spark):
    text = "spdx-license-identifier: GPL-3.0-or-later. Released under the terms of the GNU General Public License, version 3"
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [s.split(":") for s in r.spans.split(",")]
    assert r.labels == "gpl-3" and r.n_found > len(spans) == 2


def test_license_rules_equal_brute_force(spark):
    said = {
        "terms and conditions of the GPL version 3": "gpl-3",
        "in accordance with the terms and conditions of the MPL 2.0": "mpl-2",
        "SPDX-License-Identifier: CPL-1.0": "cpl",
        "SPDX-License-Identifier: BSL-1.0": "boost",
        "SPDX-License-Identifier: OFL-1.1": "ofl",
        "published under Creative Commons Zero": "cc0",
        "a copy of the terms of the Expat": "mit",
        "subject to the terms and conditions of the zlib": "zlib",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
        "see http://www.apache.org/licenses/LICENSE-2.0": "apache-2",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    }
    own = [re.sub(r"\bx\b", "thing", x) for r in license_scan.rules()[::7] for x in license_scan.spellings(r["pattern"][9:-6])[:2]]
    texts = [*said, *own, " ".join(own), "MIT license " * 300]
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].labels for i in range(len(said))] == list(said.values())
    table = [(r, re.compile(r["pattern"])) for r in license_scan.rules()]
    for i, text in enumerate(texts):
        norm = f" {re.sub(r'[^0-9a-z]+', ' ', text.lower()).strip()} "
        found = [(m.start(), m.end(), r["priority"], r["rule"], r["label"]) for r, p in table for m in p.finditer(norm) if m.end() > m.start()]
        loses = lambda x, y: y[0] <= x[0] and y[1] >= x[1] and (y[2] < x[2] or (y[2] == x[2] and (x[1] - x[0], -x[3]) < (y[1] - y[0], -y[3])))
        starts = sorted(found)
        kept = [x for x in starts if not any(loses(x, y) for y in (found if len(found) < 400 else [y for y in starts if abs(y[0] - x[0]) < 200]))]
        assert got[i].n_found == len(found) and got[i].spans == ",".join(f"{x[0]}-{x[1]}:{x[4]}" for x in kept), text


def test_license_keywords_stand_in_all_spellings():
    for r in license_scan.rules():
        for x in license_scan.spellings(r["pattern"][9:-6]):
            words = set(x.split(" "))
            assert words & set(r["k1"]) and (not r["k2"] or words & set(r["k2"])), (x, r)
    assert len(license_scan.rules()) > 400


def test_quality_rules(docs, none):
    got = by_id(quality_rules.quality(docs, quality_rules.LineCrf()))
    for i in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", raw(i).decode())
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = len({k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}) if len(w) < 1000 else got[i].n_repeat_words
        lines = [x for x in raw(i).decode().split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), rep, len(lines) - len(set(lines)))
        assert got[i].base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and got[i].kept == (not got[i].base_failed)
    assert quality_rules.quality(none, quality_rules.LineCrf()).count() == 0


def test_crf_decodes_like_brute_force():
    import itertools

    crf = quality_rules.LineCrf(RNG.normal(size=(quality_rules.N_FEATURES, 2)), RNG.normal(size=(2, 2)), RNG.normal(size=2))
    x = RNG.integers(0, 2, (7, quality_rules.N_FEATURES)).astype(float)
    e = x @ crf.emit
    score = lambda y: crf.start[y[0]] + sum(e[k, v] for k, v in enumerate(y)) + sum(crf.step[a, b] for a, b in itertools.pairwise(y))
    assert tuple(crf.decode(x)) == max(itertools.product((0, 1), repeat=7), key=score)
    x = [np.eye(1, quality_rules.N_FEATURES, 3 + y)[[0] * 4] for y in (0, 1) * 20]
    y = np.array([0, 1] * 20)
    fitted = quality_rules._maximised(x, y, [np.full(4, k) for k in y], 60)
    assert fitted.decode(x[0]).sum() == 0 and fitted.decode(x[1]).sum() == 4


def test_toxicity_learns_pairs(docs, none):
    a, b = np.array([3], np.int32), np.array([9], np.int32)
    rows = [np.union1d(a, b), a, b, np.zeros(0, np.int32)] * 60
    y = np.array([1, 0, 0, 0] * 60)
    m = toxicity.fitted(rows, y, epochs=300)
    p = [1 / (1 + np.exp(-m.logit(r))) for r in rows[:4]]
    assert p[0] > 0.5 > max(p[1:])
    got = by_id(toxicity.toxicity(docs, m))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values()) and len(got) == len(TEXTS)
    assert toxicity.toxicity(none, m).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, 256).collect()
    enc = tokens.encoder()
    at: dict[int, list] = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert all(a == sum(n for _, n in spans[:k]) for k, (a, _) in enumerate(spans)) and sum(n for _, n in spans) <= 256
    for i in TEXTS:
        n = len(enc.encode(raw(i).decode())) // 4 + 1
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        assert sum(x[2] for x in own) == n * (2 if i == 11 else 1)
        assert all(x[2] == 256 for x in own[1:]) or i == 11
    assert packing.pack(none, 256).count() == 0


def test_plan_meets_the_bound():
    hist = np.bincount(np.clip(RNG.lognormal(5, 1, 20_000).astype(int), 1, 2048), minlength=2049)
    hist[0] = 0
    plan = packing.plan(hist)
    used = np.zeros_like(hist)
    for lengths, n in plan:
        assert sum(lengths) <= 2048
        for a in lengths:
            used[a] += n
    assert (used == hist).all()
    assert sum(n for _, n in plan) <= 1.002 * (hist * np.arange(2049)).sum() / 2048 + 1


@pytest.mark.parametrize("text", ["a  b\n\n c\t\td  ", "it's 's \xa0\xa0x \r\n\x85", "a <|endoftext|> b", " a ", "", "a\n b", "日本 語\nab c"])
def test_cached_ids_are_the_tokenizers(text):
    e = tokens.encoder()
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_worker_holds_few_pieces_and_texts():
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa

    from textloom.llm import common

    once, twice = [f"w{k}x" for k in range(20_000)], ["hello", "wörld", "梦"] * 3
    e = tokens.Encoder(public_tokenizers.path(tokens.BYTE_BPE))
    for text in (" ".join(["a", *once]), " ".join(["a", *twice])):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"hello", "wörld", "梦"} <= set(e.cache) and len(e.cache) < 1000
    texts = [None if k % 7 == 0 else f"{k} " * 500 for k in range(4000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": texts})
    want = [(k, (t or "").encode()) for k, t in enumerate(texts)]
    tracemalloc.start()
    assert all(x == y for x, y in zip(common.text_rows(batch, "text", "doc_id"), want, strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000  # of some 8 MB of texts
    assert not list(common.text_rows(batch.slice(0, 0), "text", "doc_id"))


def test_token_counts(spark, docs, none, tmp_path):
    want = sorted((r.doc_id, len(tokens.encoder().encode(r.text or "")) // 4) for r in docs.collect())
    for k, sizes in enumerate(({}, {"pack_bytes": 300, "packs": 2})):
        got = token_counts.counted_documents(docs, f"file://{tmp_path}/tokens{k}", **sizes).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == want and all(r.closed for r in got)
    for block in (32, 1 << 20):
        assert sorted(r.n_tokens for r in token_counts.token_counts(spark, f"file://{tmp_path}/tokens1", block).collect()) == sorted(n for _, n in want)
    assert token_counts.counted_documents(none, f"file://{tmp_path}/none").count() == 0
    tail = np.array([5, 6, token_counts.END, 7], ">u2").tobytes()
    (tmp_path / "open").mkdir()
    (tmp_path / "open/part-0").write_bytes(tail)
    assert sorted((r.start, r.n_tokens, r.closed) for r in token_counts.token_counts(spark, f"file://{tmp_path}/open", 4).collect()) == [(0, 2, True), (3, 1, False)]


def viterbi(word, table, byte_ids, unknown, longest):
    best = [(0.0, 0, None)]
    for stop in range(1, len(word) + 1):
        ways = [(best[stop - n][0] + table[p][1], n, table[p][0]) for n in range(1, min(stop, longest) + 1) if (p := word[stop - n : stop]) in table]
        ways = ways if any(n == 1 for _, n, _ in ways) else [*ways, (best[stop - 1][0] + unknown, 1, None)]
        best.append(max(ways, key=lambda w: (w[0], w[1])))
    out, at = [], len(word)
    while at:
        _, n, i = best[at]
        out[:0] = [i] if i is not None else [byte_ids[b] for b in word[at - n : at].encode()]
        at -= n
    return out


def test_piece_lattice(spark, docs, none):
    import public_tokenizers
    import sentencepiece

    pieces = piece_lattice.load()
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_lattice.MODEL))
    every = {m.id_to_piece(i): (i, m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    odd = {14: "two  spaces and\ttabs ", 15: " begins", 16: "x" * 700, 17: "日本語の文 \U0001f600 ok"}
    texts = {i: t for i, t in {**TEXTS, **odd}.items()}
    small = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {i: [x for w in piece_lattice.cut_words("▁" + t.replace(" ", "▁")) for x in viterbi(w, every, pieces.byte_ids, pieces.unknown, pieces.longest)] if t else [] for i, t in texts.items()}
    for frequent in (3, 10**6):  # few words are broadcast, and all
        enc = piece_lattice.encode(small, pieces, frequent)
        assert {r.doc_id: list(r.ids) for r in enc.collect()} == want
    assert {r.doc_id: r.text for r in piece_lattice.decode(enc, pieces).collect()} == {i: t or "" for i, t in texts.items()}
    runs = piece_lattice.document_runs(docs, pieces, 50).collect()
    twice = [r for r in runs if r.doc_id == 11]  # repeated rows give their rows again
    assert sum(r.n_words for r in twice) == 2 * 2 and "".join(r.text for r in sorted((r for r in runs if r.doc_id == 3), key=lambda r: r.word)) == " " + TEXTS[3]
    assert piece_lattice.document_runs(none, pieces).count() == 0


def test_words_of_a_batch_are_cut_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    known = np.array([f"{w}{x}" for x in ("", ",", ".", "s") for w in WORDS] + [f"x{i}y" for i in range(60_000)])
    text = " ".join(rng.choice(known, 3000))
    texts = pa.array([text[i:] + " " + " ".join(rng.choice(known, 3000)) for i in range(2 * piece_lattice.BATCH_BYTES // len(text))])
    tracemalloc.start()
    try:
        parts = 0
        for _, part in piece_lattice._pieces_of(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
            words, codes, distinct = piece_lattice._cut(part)
            assert [distinct[c].as_py() for c in codes[: words[0]].tolist()] == piece_lattice.cut_words("▁" + part[0].as_py().replace(" ", "▁"))
            parts += 1
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert parts > 2 and peak < 48 << 20, peak


def test_viterbi_is_the_best_path(spark):
    rows = [("▁", 0, -3.0), ("▁a", 1, -4.0), ("a", 2, -2.5), ("ab", 3, -2.5), ("b", 4, -1.0), ("▁ab", 5, -7.0)]
    p = piece_lattice.Pieces(rows, list(range(100, 356)), -20.0, 3, ["", *"abcdefgh"] + ["x"] * 347)
    got = piece_lattice.encoded_words(spark.createDataFrame([("▁ab",), ("▁abx",)], "word string"), p).collect()
    assert {r.word: list(r.ids) for r in got} == {"▁ab": [1, 4], "▁abx": [1, 4, 100 + ord("x")]}


def test_lattice_finds_long_pieces_by_few_substrings(spark):
    rows = [(c, i, -2.0) for i, c in enumerate("▁abc")] + [("abca", 4, -3.0), ("abcab", 5, -3.0), ("abcabcab", 6, -4.0), ("▁abca", 7, -5.0), ("bcabc", 8, -5.0)]
    p = piece_lattice.Pieces(rows, list(range(100, 356)), -20.0, 8, ["x"] * 356)
    words = ["▁abcabcabcab", "abcab", "abcabca", "xabc", "▁"]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = piece_lattice.edges(spark.createDataFrame([(w,) for w in words], "word string"), p)
        got = sorted((r.word, r.edge) for r in found.collect())
        found._jdf.collect()
        node, exploded = found._jdf.queryExecution().executedPlan(), []
        while node.children().size():
            if node.nodeName() == "Generate":
                exploded.append(node.metrics().apply("numOutputRows").value())
            node = node.children().apply(0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    ids = {piece: i for piece, i, _ in rows}
    spans = [(w, a, e) for w in words for e in range(1, len(w) + 1) for a in range(e)]
    packed = lambda e, n, i: ((e << piece_lattice.LENGTH_BITS) + n << piece_lattice.ID_BITS) + i
    assert got == sorted((w, packed(e, e - a, ids.get(w[a:e], p.no_piece))) for w, a, e in spans if w[a:e] in ids or e - a == 1)
    assert max(exploded) <= 4 * sum(map(len, words)), exploded


def jpeg_by_bits(frame):
    """Coefficients of a grey baseline JPEG, read a bit at a time."""
    at, tables, q, every, width, height = 2, {}, [1] * 64, 0, 0, 0
    while True:
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            q = list(body[1:65])
        if marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if marker == 0xDD:
            every = int.from_bytes(body, "big")
        while marker == 0xC4 and body:
            counts, symbols, code, table = body[1:17], list(body[17:]), 0, {}
            for n, c in enumerate(counts, 1):
                for _ in range(c):
                    table[f"{code:0{n}b}"] = symbols.pop(0)
                    code += 1
                code *= 2
            tables[body[0]] = table
            body = bytes(symbols)
        if marker == 0xDA:
            dc, ac = tables[body[2] >> 4], tables[16 + (body[2] & 15)]
            break
    bits, blocks, last, done = "", [], 0, 0
    total = -(-width // 8) * -(-height // 8)
    data = frame[at:-2]
    i = 0

    def more():
        nonlocal i, bits
        if data[i] == 0xFF and data[i + 1] == 0:
            bits += f"{255:08b}"
            i += 2
        else:
            bits += f"{data[i]:08b}"
            i += 1

    def take(n):
        nonlocal bits
        while len(bits) < n:
            more()
        out, bits = bits[:n], bits[n:]
        return out

    def symbol(table):
        code = ""
        while code not in table:
            code += take(1)
        return table[code]

    def value(n):
        b = take(n)
        return 0 if not n else int(b, 2) if b[0] == "1" else int(b, 2) - 2**n + 1

    while done < total:
        if every and done and done % every == 0:
            bits, last = "", 0
            assert data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7
            i += 2
        row, k = [0] * 64, 1
        last += value(symbol(dc))
        row[0] = last
        while k < 64:
            s = symbol(ac)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                row[k] = value(s & 15)
            k += 1
        blocks.append([a * b for a, b in zip(row, q, strict=True)])
        done += 1
    return np.array(blocks)


def made_jpeg(rng, width, height, every):
    """A grey JPEG with codes of several lengths, runs, ends of block and stuffed bytes, and its coefficients."""
    segment = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    dc = {n: f"{n:03b}" if n < 7 else "1110" if n == 7 else "11110" for n in range(9)}
    runs = [(r, s) for r in (0, 1, 3) for s in (1, 2, 5)]
    symbols = [0, 0xF0, *(r << 4 | s for r, s in runs)]
    ac = {x: f"{k:02b}" if k < 2 else f"{(2 << 3 | k - 2):05b}" if k < 10 else f"{0b11000 << 2:07b}" for k, x in enumerate(symbols)}
    dht = lambda kind, t: bytes([kind]) + bytes(sum(len(c) == n for c in t.values()) for n in range(1, 17)) + bytes(sorted(t, key=lambda x: (len(t[x]), t[x])))
    total, bits, scan, want, last = -(-width // 8) * -(-height // 8), "", b"", [], 0
    extra = lambda v, n: f"{v if v > 0 else v + 2**n - 1:0{n}b}" if n else ""
    close = lambda: bytes(int((bits + "1" * 7)[j : j + 8], 2) for j in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    for n in range(total):
        if every and n and n % every == 0:
            scan += close() + bytes([0xFF, 0xD0 + (n // every - 1) % 8])
            bits, last = "", 0
        row = np.zeros(64, int)
        row[0] = last + int(rng.integers(-200, 200))
        size = int(abs(row[0] - last)).bit_length()
        bits += dc[size] + extra(int(row[0] - last), size)
        last, k = row[0], 1
        while k < 64 and rng.random() < 0.9:
            r, s = runs[int(rng.integers(len(runs)))]
            if k + 16 < 60 and rng.random() < 0.1:
                bits += ac[0xF0]
                k += 16
            if k + r > 63:
                break
            v = int(rng.integers(2 ** (s - 1), 2**s)) * (1 if rng.random() < 0.5 else -1)
            bits += ac[r << 4 | s] + extra(v, s)
            row[k + r] = v
            k += r + 1
        if k < 64:
            bits += ac[0]
        want.append(row * 3)
    head = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([3] * 64)) + segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\1\1\x11\0") + segment(0xC4, dht(0, dc) + dht(16, ac)) + (segment(0xDD, every.to_bytes(2, "big")) if every else b"") + segment(0xDA, b"\1\1\0\0\x3f\0")
    return head + scan + close() + b"\xff\xd9", np.array(want)


def test_frames_are_decoded_like_bit_by_bit():
    rng = np.random.default_rng(17)
    made = [made_jpeg(rng, w, h, e) for w, h, e in ((16, 8, 0), (24, 17, 2), (64, 64, 1), (40, 40, 0), (8, 8, 3))]
    for (frame, want), got in zip(made, media_avi.decode_frames([f for f, _ in made]), strict=True):
        assert (got == want).all() and (jpeg_by_bits(frame) == want).all()
    with pytest.raises(ValueError, match="scan ends|no such code"):
        media_avi.decode_frames([made[3][0][:-60] + b"\xff\xd9"])


def test_media_round_trip(docs, none):
    got = by_id(media_avi.media_columns(docs))
    for i in TEXTS:
        p = media_avi.padded(raw(i))
        media = media_avi.write_avi(p)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].media_sha256) == (len(raw(i)), len(p), hashlib.sha256(p).hexdigest(), hashlib.sha256(media).hexdigest())
        frames, at = [], media.index(b"movi") + 4  # a second reader: chunks after the list's head, each frame a bit at a time
        while media[at : at + 4] == b"00dc":
            size = int.from_bytes(media[at + 4 : at + 8], "little")
            frames.append(media[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
        if len(frames) < 3:
            rows = np.concatenate([jpeg_by_bits(f) for f in frames])
            assert np.where(rows < 0, rows + 255, rows).astype(np.uint8).tobytes()[: len(p)] == p
    assert got[1].feature == got[2].feature and media_avi.media_columns(none).count() == 0
    every = bytes(range(256)) * 20
    assert media_avi.measured([media_avi.write_avi(every), media_avi.write_avi(b"")])[0][0] == every
    flat, busy = bytes(4096 * 3), bytes(RNG.integers(0, 256, 4096 * 3, np.uint8))
    assert [r[:2] for r in media_avi.clip_rows(media_avi.write_avi(flat + busy))] == [(0, 3), (3, 6)]


def test_pipeline_stages_keep_columns(spark, docs):
    assert near_dedup.stage(spark, docs, "").columns == docs.columns
    out = substring_dedup.stage(spark, docs.withColumn("n_chars", F.char_length("text").cast("long")), "")
    assert out.columns == [*docs.columns, "n_chars"] and all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())


def labelled(spark, n=400):
    """Documents of which labels say what they are: good prose, junk lines, and texts whose two marks together make them toxic."""
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(WORDS, 120).tolist()
        kind = i % 4
        if kind == 1:
            words[::2] = ["zzbad"] * 60 if i % 8 == 1 else words[::2]
        marks = {2: ["grimwort", "fennick"], 3: [["grimwort"], ["fennick"]][i % 8 > 3]}.get(kind, [])
        for m in marks:
            words[int(rng.integers(100))] = m
        lines = [" ".join(words[k : k + 12]) for k in range(0, 120, 12)]
        if kind == 1:
            lines = [lines[0], *(" | ".join(x.split()) + " ### $$$" for x in lines[1:])]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_fits_on_labels_and_holds_rows_out(spark, tmp_path):
    import zlib

    docs, labels = labelled(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = by_id(toxicity.op4_toxicity(spark, str(tmp_path)))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out]
    assert sum(out[i].predicted == (i % 4 == 2) for i in held) >= 0.95 * len(held)
    # Labels of rows that are held out change nothing.
    turned = labels.withColumn("toxic", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned.write.parquet(f"{tmp_path}/other/labels.parquet")
    docs.write.parquet(f"{tmp_path}/other/documents.parquet")
    again = by_id(toxicity.op4_toxicity(spark, f"{tmp_path}/other"))
    assert {i: r.score for i, r in again.items()} == {i: r.score for i, r in out.items()}
    kept = by_id(quality_rules.op8_quality_rules(spark, str(tmp_path)))
    judged = [i for i in kept if not kept[i].base_failed]
    assert sum(kept[i].kept == (i % 4 != 1) for i in judged) >= 0.97 * len(judged)
    mixed = [i for i in judged if 0 < kept[i].n_content_lines < kept[i].n_lines]
    assert len([i for i in mixed if i % 4 == 1]) > 20


def test_toxicity_sample_of_long_texts_stays_with_executors(spark):
    """The driver gets a bounded result whatever the length of the sampled texts, and rows that repeat a doc_id count once."""
    docs, labels = labelled(spark, 80)
    long = docs.select("doc_id", F.concat("text", F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda i: F.md5(F.concat_ws("-", "doc_id", i).cast("binary"))), " ")).alias("text"))
    once = toxicity.fit(long, labels)
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "4m")  # the sets of buckets take over 10 MB
    try:
        model = toxicity.fit(long.unionAll(long).unionAll(long), labels)
    finally:
        conf.remove("spark.driver.maxResultSize")
    assert len(once.terms) and model.bias == once.bias and all(np.array_equal(getattr(model, k), getattr(once, k)) for k in ("terms", "weights", "factors"))


def test_factorization_machine_equals_all_pairs():
    m = toxicity.FactorizationMachine(np.array([2, 5, 9, 11], np.int32), -0.3, RNG.normal(size=4), RNG.normal(size=(4, toxicity.FACTORS)))
    for found in ([2, 9], [5], [2, 5, 7, 9, 11], []):
        at = [i for i, t in enumerate(m.terms) if t in found]
        want = m.bias + sum(m.weights[i] for i in at) + sum(m.factors[i] @ m.factors[j] for i in at for j in at if i < j)
        assert m.logit(np.array(found, np.int32)) == pytest.approx(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 240)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = next(t for i, t in rows if i % 4 == 0)
    words = good.split(" ")
    extra = [(1000, good), (1001, " ".join(["other", *words[1:]])), (1002, prose(60) + " " + " ".join(words[5:75]).replace("\n", " ") + " " + prose(60)), (1003, None), (1004, "")]
    every = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + extra], "doc_id long, text string, lang string, source string, n_chars long")
    every.write.parquet(f"{tmp_path}/in/documents.parquet")
    labels.write.parquet(f"{tmp_path}/in/labels.parquet")
    d, at = f"{tmp_path}/in", every
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in at.collect()}
        out = stage(spark, at, d)
        assert out.columns == every.columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert after.keys() <= before.keys() and (name == "substring_dedup" or all(before[i] == t for i, t in after.items()))
        gone = before.keys() - after.keys()
        if name == "quality_rules":
            assert {1003, 1004} <= gone and sum(i % 4 == 1 for i in gone if i < 1000) >= 57 and sum(i % 4 != 1 for i in gone if i < 1000) <= 3
        if name == "toxicity":
            assert sum(i % 4 == 2 for i in gone) >= 55 and sum(i % 4 != 2 for i in gone) <= 3
        if name == "near_dedup":
            assert gone == {1000, 1001}
        if name == "substring_dedup":
            assert not gone and len(after[1002]) < len(before[1002]) - 100 and all(after[i] == before[i] for i in after if i < 1000)
        at = out
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(after) and all(r.length <= packing.CAPACITY for r in packed)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    labels = labelled(spark, 40)[1].withColumn("toxic", F.lit(0))
    shape = "doc_id long, text string, lang string, source string, n_chars long, digest string, word int"
    rows = [(None, prose(100), "en", "s", 1, "d", 1), (5, prose(100), None, None, None, None, None), (5, prose(100), "en", "s", 1, "d", 1), (6, None, "en", "s", 0, "d", 1)]
    for name, made in (("none", []), ("odd", rows + rows[1:2])):
        df = spark.createDataFrame(made, shape)
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, f"{tmp_path}/{name}")
            assert at.columns == df.columns
        n = at.count()
        assert n == 0 if name == "none" else any(r.doc_id is None for r in at.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, at, f"{tmp_path}/{name}").count() >= n


def test_substring_dedup_equals_brute_force(spark):
    """Every passage of 50 words that stands in an earlier document goes, and nothing goes that stands nowhere else."""
    rng = np.random.default_rng(21)
    shared = [rng.choice(WORDS, 70).tolist() for _ in range(6)]
    texts = {}
    for i in range(24):
        words = rng.choice(WORDS, 150).tolist()
        for p in rng.permutation(6)[: i % 4]:
            at = int(rng.integers(len(words)))
            words[at:at] = shared[p][: 70 if i % 5 else 40]
        texts[i] = " ".join(words)
    got = by_id(substring_dedup.deduped(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    seen = {}
    for i, t in texts.items():
        w = t.split(" ")
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
    for i, t in texts.items():
        w = t.split(" ")
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        must = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] < i:
                must[k : k + 50] = True
        spans = list(zip(got[i].starts, got[i].ends, strict=True))
        gone = np.array([any(a <= e - len(x) and e <= b for a, b in spans) for x, e in zip(w, ends, strict=True)])
        assert (gone >= must).all()
        earlier = " ".join(texts[j] for j in range(i))
        for a, b in spans:
            assert t[a:b] in earlier or must.any()
        if i and not must.any() and i % 4 == 0:
            assert not gone.any()
