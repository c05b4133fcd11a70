"""Each operator against a plain statement of what it computes, and on the awkward rows."""

import collections
import hashlib
import itertools
import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import chat, decontam, graph, html, licenses, neardup, pieces, quality, repeats, topk, toxicity
from wardline.llm import textops as X

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, component_id int, score string, key string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = "A passage of rather more than a hundred bytes that several documents share word for word, é and all of it. "
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "one two three"), (7, LONG), (8, LONG + " tail"),
    (9, PASSAGE * 3), (10, "x" + PASSAGE + "y"), (11, "a" * 5000), (12, "a" * 4999 + "b"), (13, "\0 nul \x7f"), (14, "漢字 " * 60),
    (15, "Licensed CC BY, general public license. All rights reserved"), (16, "é" * 50 + "è" + "é" * 49), (17, PASSAGE + PASSAGE.upper()),
]


def rows(spark, pairs):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "n", 7, "s", "k") for i, t in pairs], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return rows(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return rows(spark, [])


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


# licence scans


def test_licenses(spark, odd, empty, documents):
    for df in (odd, documents):
        got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
        for i, t in texts(df).items():
            w = WORD.findall(t.translate(LOW))
            places = [(k, lab) for phrase, lab in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
            r = got[i]
            assert (r["n_words"], r["n_base"]) == (len(w), len(places))
            assert r["first_word"] == min((k for k, _ in places), default=None) and r["last_word"] == max((k for k, _ in places), default=None)
            assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.license_scan(empty).collect() == []
    assert licenses.license_scan(odd.union(odd.limit(1))).count() == len(ODD) + 1


def test_license_rules():
    scanner = licenses.Scanner()
    ruleset = scanner.rules
    assert len(ruleset) > 500 and all(len(r.keyword) >= 3 for r in ruleset)
    _, found = licenses.scan(b"Licensed under the Apache License, Version 2.0 (SPDX-License-Identifier: MIT)", scanner)
    assert {r.label for _, _, r, k in found if k} == {"apache-2.0", "mit"}
    _, found = licenses.scan(b"GNU Lesser General Public License", scanner)
    assert {r.label for _, _, r, k in found if k} == {"lgpl", "gpl"}  # the base place stays


def plain_scan(text, ruleset):
    """Labels and score without the keyword gate, and suppression by comparing all pairs."""
    line = b" %b " % b" ".join(text.translate(licenses._FOLD).split())
    found = [(m.start(), m.end(), o, r) for o, r in enumerate(ruleset) for m in r.pattern.finditer(line)]
    best = {}
    for s, e, o, r in found:
        others = [x for x in found if not x[3].base and (x[0], x[1], x[2]) != (s, e, o) and x[0] <= s and x[1] >= e]
        if r.label not in licenses.REMARKS:
            others = [x for x in others if x[3].label not in licenses.REMARKS and licenses.family(x[3].label) == licenses.family(r.label)]
        hidden = any(x.priority > r.priority or x.priority == r.priority and (f - b > e - s or f - b == e - s and q < o) for b, f, q, x in others)
        if r.base or not hidden:
            best[r.label] = max(best.get(r.label, 0.0), r.confidence)
    miss = 1.0
    for label in sorted(best):
        miss *= 1 - best[label]
    return ",".join(sorted(best)), 1 - miss


def test_license_labels_and_score(spark, documents):
    ruleset = licenses.rules()
    rng = np.random.default_rng(21)
    pieces_of = [max((" ".join(t.split()) for t in samples(re._parser.parse(r.pattern.pattern.decode()))), key=lambda t, r=r: bool(r.pattern.search(f" {t} ".encode()))) for r in ruleset]
    mixed = [(i, " and ".join(rng.choice(pieces_of, rng.integers(1, 6)))) for i in range(300)] + [(1000, None), (1001, "")]
    for df in (spark.createDataFrame(mixed, "doc_id long, text string"), documents):
        got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(df).collect()}
        for i, t in texts(df).items():
            labels, score = plain_scan(t.encode(), ruleset)
            assert got[i][0] == labels and got[i][1] == pytest.approx(score), t
    assert sum(bool(licenses.scan(t.encode(), licenses.Scanner())[1]) for _, t in mixed[:300]) == 300


def samples(tokens):
    """Texts that an expression matches: with all that it may leave out and without, by each of its branches."""
    out = [""]
    for op, arg in tokens:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [next(chr(c) for c in (*range(97, 123), *range(32, 127)) if any(str(o) == "LITERAL" and a == c or str(o) == "RANGE" and a[0] <= c <= a[1] or str(o) == "NEGATE" for o, a in arg))]
        elif name == "NOT_LITERAL":
            more = ["x"]
        elif name == "SUBPATTERN":
            more = samples(arg[3])
        elif name == "BRANCH":
            more = [x for b in arg[1] for x in samples(b)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [x * k for k in {arg[0], max(arg[0], 1)} for x in samples(arg[2])]
        else:
            assert name == "ASSERT", name
            more = [" "]
        out = [x + y for x in out for y in more]
    return out


def test_every_license_rule_can_fire():
    scanner = licenses.Scanner()
    ruleset = scanner.rules
    for order, rule in enumerate(ruleset):
        texts_of = samples(re._parser.parse(rule.pattern.pattern.decode()))
        texts_of = [t for t in (f" {' '.join(t.split())} " for t in texts_of) if rule.pattern.search(t.encode())]
        assert texts_of, rule
        for t in texts_of:
            assert any(r is rule for _, _, r, _ in licenses.scan(t.encode(), scanner)[1]), (order, rule.keyword, t)
        # on a text of its own the licence that it names stands
        assert any(any(k and (r is rule or r.label == rule.label) for _, _, r, k in licenses.scan(t.encode(), scanner)[1]) for t in texts_of), rule
    for text, label in ((b"LGPL v2.1", "lgpl"), (b"AGPLv3", "agpl"), (b"GPL v2", "gpl"), (b"EUPL v1.2", "eupl"), (b"Creative Commons Attribution-ShareAlike", "cc-by-sa"), (b"Creative Commons Attribution-NonCommercial-NoDerivs", "cc-by-nc-nd")):
        assert any(r.label.startswith(label) and k for _, _, r, k in licenses.scan(text, scanner)[1]), text


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under MIT or Apache 2.0 at your option", {"dual", "mit", "apache-2.0"}),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", {"dual", "mit", "apache-2.0"}),
        ("MIT OR Apache-2.0", {"mit", "apache-2.0"}),
        ("Licensed under Apache-2.0 or MIT", {"mit", "apache-2.0"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("under the GNU Lesser General Public License v2.1", {"lgpl", "gpl"}),
        ("Apache 2.0 with LLVM exceptions", {"apache-2.0", "llvm-exception"}),
        ("Creative Commons Attribution-ShareAlike", {"cc-by-sa"}),
        ("nothing of the kind", set()),
    ],
)
def test_licences_named_together(text, labels):
    kept = {r.label for _, _, r, k in licenses.scan(text.encode(), licenses.Scanner())[1] if k}
    assert kept == labels


def test_suppression_against_pairs():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(0, 12)
        s = rng.integers(0, 12, n)
        spans = np.stack([s, s + rng.integers(1, 6, n), rng.integers(0, 3, n), np.arange(n)], 1).reshape(-1, 4)
        want = []
        for a in spans:
            inside = [b for b in spans if b[3] != a[3] and b[0] <= a[0] and b[1] >= a[1]]
            want.append(not any(b[2] > a[2] or b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or b[3] < a[3]) for b in inside))
        assert licenses.survivors(spans).tolist() == want


# toxicity


def toxic_corpus():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(600)]
    out = []
    for i in range(900):
        words = list(rng.choice(vocabulary, rng.integers(20, 120)))
        toxic = int(i % 6 == 0)
        for _ in range(4 * toxic):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["gribblefex", "snarkwhump", "mugglorf"])))
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity_held_out(spark, odd, empty):
    corpus = toxic_corpus()
    docs = rows(spark, [(i, t) for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, t) for i, _, t in corpus], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    truth = {i: t for i, _, t in corpus}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if toxicity.held_out(i)}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    strange = {r["doc_id"]: r for r in toxicity.toxicity(odd, labels).collect()}
    assert len(strange) == len(ODD) and strange[1]["score"] == strange[2]["score"] < 0.5
    assert toxicity.toxicity(empty, labels).collect() == []
    assert all(r["predicted"] == 0 for r in toxicity.toxicity(odd, labels.limit(0)).collect())


def test_toxicity_on_labels(spark):
    """Rows outside the training fold; some of the labels are noise."""
    sf = "/root/testdata/sf0.1"
    marked = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    got = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("held_out").join(marked, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] >= 0.85 * (n[1, 0] + n[1, 1]) and n[0, 0] >= 0.97 * (n[0, 0] + n[0, 1]), n


# quality


def test_quality(spark, odd, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert len(got) == docs.count()
    right = sum(got[i]["kept"] == bool(q) for i, q in truth.items() if i in got)
    assert right >= 0.93 * len(truth)
    assert quality.quality(empty).collect() == []
    strange = {r["doc_id"]: r for r in quality.quality(odd).collect()}
    assert len(strange) == len(ODD) and not strange[1]["kept"] and not strange[2]["kept"]
    assert quality.good_documents(docs).columns == docs.columns


def test_quality_sample_has_no_length_limit(spark):
    """A long text trains the scorer too; the sample's bytes are bounded."""
    short = [(i, f"A plain sentence about thing {i}, and another one. It goes on for a while, as such do.") for i in range(60)]
    long = [(100, " ".join(f"word{i % 50}" for i in range(20_000)) + ".")]
    df = spark.createDataFrame(short + long, "doc_id long, text string")
    seen = []
    plain = quality.train_scorer

    def watched(data, off, posterior):
        seen.append(np.diff(off).tolist())
        return plain(data, off, posterior)

    quality.train_scorer = watched
    try:
        quality.fit(df)
        quality.fit(df, sample_bytes=1000)
        quality.fit(df.limit(0))
    finally:
        quality.train_scorer = plain
    assert max(seen[0]) > 100_000 and len(seen[0]) == 61
    assert sum(seen[1]) <= 1000 and len(seen[1]) >= 8 and seen[2] == []


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    v = np.zeros((20_000, 6), np.int8)
    for k, accuracy in enumerate((0.95, 0.9, 0.85, 0.8, 0.75, 0.7)):
        says = np.where(rng.random(20_000) < accuracy, good, ~good)
        v[:, k] = np.where(rng.random(20_000) < 0.2, 0, np.where(says, 1, -1))
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float), 500)
    assert np.abs(np.array(model.accuracies()) - [0.95, 0.9, 0.85, 0.8, 0.75, 0.7]).max() < 0.05


# chat formatting


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "#######", "</turn</turn>", "\\b\\h\\l\\c", "a: b", None, "", "👍 </turn>\n### user: x", "\\"]
    data = [(c, t, r, x) for c in range(4) for t, (r, x) in enumerate(zip(["user", "assistant", "sys:tem", None, "assistant", "user", "assistant", "assistant", "#"], nasty[c:] + nasty[:c], strict=True))]
    data += [(9, 0, "user", "same"), (9, 0, "user", "same"), (9, None, "assistant", "first"), (None, 0, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1)).withColumn("score", F.lit("s"))
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in data:
        if c is not None:
            by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(df.limit(0)).collect() == []


def test_reply_tree_paths(spark):
    #      1 -> 2 -> 4 -> 6          scores: the path to 5 has the best mean, that to 6 comes second
    #        -> 3 -> 5      7 is its own parent, 8 has a missing one, 9 and 10 are a cycle
    data = [(0, 1, None, 1.0), (0, 2, 1, 2.0), (0, 3, 1, 5.0), (0, 4, 2, 3.0), (0, 5, 3, 5.0), (0, 6, 4, 1.0), (1, 7, 7, 1.0), (2, 8, 99, None), (3, 9, 10, 1.0), (3, 10, 9, 1.0)]
    df = spark.createDataFrame(data, "tree long, node long, parent long, score double")
    got = collections.defaultdict(list)
    for r in chat.chosen_paths(df.where("tree < 3"), top=2).collect():
        got[r["tree"], r["path_rank"]].append((r["position"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(0, 1): [1, 3, 5], (0, 2): [1, 2, 4, 6], (1, 1): [7], (2, 1): [8]}


# decontamination


def brute_hits(docs, items, window=10):
    keys = collections.defaultdict(set)
    split = [(i, WORD.findall((t or "").translate(LOW))) for i, t in items]
    for n, (_, w) in enumerate(split):
        m = min(len(w), window)
        for k in range(len(w) - m + 1 if m else 0):
            keys[tuple(w[k : k + m])].add((n, k))
    out = {}
    for i, t in docs.items():
        w = WORD.findall(t.translate(LOW))
        hit, found, best = set(), set(), (0, None)
        for m in {len(k) for k in keys}:
            for k in range(len(w) - m + 1):
                for n, j in keys.get(tuple(w[k : k + m]), ()):
                    item, size = split[n][1], m
                    hit.update(range(k, k + m))
                    found.add(split[n][0])
                    while k + size < len(w) and j + size < len(item) and w[k + size] == item[j + size]:
                        size += 1
                    if size > best[0] or size == best[0] and k < best[1]:
                        best = (size, k)
        found -= {None}
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit), *best)
    return out


ITEMS = [(1, "one two three"), (2, " ".join(LONG.split()[500:530])), (3, ""), (4, None), (5, PASSAGE), (6, PASSAGE + "extra words"), (7, "漢字"), (8, "w0x0 w1x1"), (None, " ".join(LONG.split()[900:915])), (9, " ".join(LONG.split()[510:560]) + " tail"), (10, "a a a a a a a a a a a a"), (11, "one two three")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, odd, empty, block_bytes):
    bench = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.contamination(odd, bench, block_bytes=block_bytes).collect()}
    assert got == brute_hits(texts(odd), ITEMS)
    assert {r["doc_id"] for r in decontam.decontaminate(odd, bench, block_bytes=block_bytes).collect()} == {i for i, x in got.items() if not x[4]}
    assert decontam.contamination(empty, bench).collect() == []
    assert not any(r["contaminated"] for r in decontam.contamination(odd, bench.limit(0)).collect())


def test_longest_matches(spark):
    text = " ".join(f"t{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "pre " + " ".join(text.split()[5:30]) + " post"), (2, text + " " + text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.longest_matches(docs, bench).collect())
    assert got == [(1, "7", 1, 5, 25), (2, "7", 0, 0, 40), (2, "7", 40, 0, 40)]


# top-k


def left_behind(spark):
    root = X.shared_dir(spark).removeprefix("file://")
    return set(os.listdir(root))


def test_several_blocks_leave_one_folder(spark):
    rng = np.random.default_rng(3)
    before = left_behind(spark)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 2 = 0"), 3, block_queries=b).collect())) for b in (100, 4))
    assert one == many and len(left_behind(spark) - before) == 1
    before = left_behind(spark)
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"start w{i}x" + " ".join(f"w{i % 12}x{k}" for k in range(i % 30))) for i in range(50)], "doc_id long, text string")
    one, many = (sorted(map(tuple, decontam.contamination(docs, items, block_bytes=b).collect())) for b in (1 << 20, 400))
    assert one == many and len(left_behind(spark) - before) == 1


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=40)]) for i in range(300)]
    data += [(1000, None), (1050, [None] * 40), (1100, [float("nan")] * 40), (1150, [float("inf")] * 40), (1200, []), (1250, [1.0, 2.0]), (1300, data[0][1]), (1301, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("s"))
    usable = {i: [int(np.floor(256 * x)) for x in v] for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for i, v in usable.items():
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u, strict=False)), j) for j, u in usable.items() if j != i)[:5]
            want[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert dict(got) == want
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []
    few = df.where("vec_id in (0, 50, 1)")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    blocks = topk.top_k(df, df.where("vec_id % 50 = 0"), block_queries=3)
    assert sorted(map(tuple, blocks.collect())) == sorted((q, *r) for q, v in want.items() for r in v)
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(huge, huge.where("vec_id = 0")).orderBy("rank").collect()][0] == (1, (1 << 63) - 1)


# near duplicates


def brute_components(docs, per_cent=85):
    sets = {}
    for i, t in docs.items():
        w = PLAIN.findall(t.translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_corpus():
    rng = np.random.default_rng(8)
    base = [f"q{rng.integers(0, 5000)}" for _ in range(200)]
    out = [(100 + i, " ".join(w if rng.random() > 0.012 else f"z{rng.integers(0, 999)}" for w in base)) for i in range(70)]
    out += [(300 + i, " ".join(base)) for i in range(40)]
    chain = list(base[:120])
    for i in range(30):
        chain[rng.integers(0, len(chain))] = f"c{i}"
        out.append((500 + i, " ".join(chain)))
    return out


def test_near_duplicates(spark, odd, empty):
    docs = rows(spark, ODD + near_corpus())
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    want = brute_components(texts(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert neardup.near_duplicates(empty).collect() == []
    twice = docs.union(docs.limit(3))
    assert neardup.near_duplicates(twice).count() == docs.count()


def template_corpus(n):
    """Texts of one template with four words of their own, any two at 0.66 to 0.82; the first has one such word and the next nine, at 0.857 to it, two each."""
    rng = np.random.default_rng(12)
    spots = [[18]] + [[2 * k, 2 * k + 1] for k in range(9)] + [rng.choice(20, 4, replace=False).tolist() for _ in range(n)]
    return [(i, " ".join(f"u{i}x{k}" if k % 10 == 5 and k // 10 in at else f"t{k}" for k in range(200))) for i, at in enumerate(spots)]


def test_links_in_a_large_region(spark, monkeypatch):
    """Few orders and small chunks, so that the group is to them as a far larger one is to all of them."""
    for name, value in (("ORDERS", 2), ("CHUNK", 8), ("BLOCK_TEXTS", 300)):
        monkeypatch.setattr(neardup, name, value)
    docs = template_corpus(4_000)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    often = {s: k for k, s in enumerate(s for s, n in collections.Counter(x for one in sets for x in one).items() if n > 1)}
    m = np.zeros((len(sets), len(often)), np.float32)
    for i, one in enumerate(sets):
        m[i, [often[s] for s in one if s in often]] = 1
    common, size = m @ m.T, np.array([len(one) for one in sets])
    similar = 100 * common >= 85 * (size[:, None] + size[None, :] - common)
    want = [(int(a), int(b)) for a, b in np.argwhere(np.triu(similar, 1))]
    assert want == [(0, i) for i in range(1, 10)]
    got = neardup.near_duplicates(rows(spark, docs)).where("not kept").collect()
    assert sorted((r["component_id"], r["doc_id"]) for r in got) == want


def test_pipeline_takes_similarities_from_80(spark, sf_dir):
    base = [f"p{i}" for i in range(200)]
    docs = [(k, " ".join(f"d{k}x{i}" if k and 50 <= i < 46 + m else w for i, w in enumerate(base))) for k, m in enumerate((0, 18, 21, 22, 40))]
    docs = rows(spark, docs + near_corpus())
    want = brute_components(texts(docs), 80)
    assert want != brute_components(texts(docs), 85)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()}
    assert got == {i for i, (_, c) in want.items() if i == c}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 80)] + [tuple(map(int, rng.integers(400, 700, 2))) for _ in range(150)] + [(999, 999)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if x != 999 or find(x) != x}


# pages


def test_lines_and_markup():
    page = "<!DOCTYPE html><title>T</title><body class=x><nav>menu<ul><li>a</nav><header>Top</header><div class='cookie-notice'>We use</div><article><h1>He&amp;ad</h1><p>One <b>bo</b>ld &lt;tag&gt;<p>Two\n  lines<script>var t='</p>';</script><div class=comments>said</div></article><form>f</form><footer>&copy;</footer>"
    assert html.main_text(html.lines(page), set()) == "He&ad One bold <tag> Two lines"
    for broken in ("", "<", "<p", "a < b & c", "<article><p>x", "<p>a<!-- open", "<div><div " * 500, "</p></div>x", "<script>never closed", "<a href='x>y</a>"):
        html.main_text(html.lines(broken), set())
    assert html.main_text(html.lines("a < b &am c"), set()) == "a < b &am c"
    two = "<article><p>first story</p></article><div>between</div><article><p class='related tags'>second story</p><p class=ad>buy</p><div class=related>see also</div></article>"
    assert html.main_text(html.lines(two), set()) == "first story second story"
    began = time.time()
    html.lines("<span></b>" * 40_000 + "<p>" * 40_000)
    assert time.time() - began < 5


@pytest.mark.parametrize("rows_bytes", [32 << 20, 4])
def test_common_subsequence(monkeypatch, rows_bytes):
    monkeypatch.setattr(html, "ROWS_BYTES", rows_bytes)
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 6, rng.integers(0, 24))] for _ in range(2))
        places = html.common(a, b)
        assert len(places) == longest_common(a, b)
        it = iter(b)
        assert all(a[i] in it for i in sorted(places))


def longest_common(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def site(n, seed):
    """Pages of a few hosts in random order: template lines around own ones, some of these short, some pages copies, some without html."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        host = f"h{i % 3}.example"
        frame = [f"line {k} of the template of {host}" for k in range(8)]
        own = [f"own text {rng.integers(0, 1 << 40)} " + "word " * int(rng.integers(1, 40)) for _ in range(rng.integers(1, 4))]
        if i % 11 == 5:
            out.append((i, f"https://{host}/a/{rng.integers(0, 99)}?c=1", out[-3][2], out[-3][3]))
            continue
        page = None if i % 17 == 3 else "".join(f"<div>{x}</div>" for x in [*frame[:5], *own, *frame[5:]])
        out.append((i, f"http://{host}/{'ab'[i % 2]}/{rng.integers(0, 99)}", page, own if page else []))
    return [out[k] for k in rng.permutation(n)]


def brute_extract(pages):
    """Pairing and subsequences stated anew, without groups or hashes."""

    def key(p):
        path = re.sub(r"^[a-z]+://", "", re.sub(r"[?#].*", "", p[1]))
        return path.split("/")[0].lower(), path, p[0]

    text = {p[0]: [d for d in re.findall(r"<div>(.*?) ?</div>", p[2] or "")] for p in pages}
    runs = [list(g) for _, g in itertools.groupby(sorted((p for p in pages if text[p[0]]), key=key), lambda p: (key(p)[0], text[p[0]]))]
    out = {p[0]: "" for p in pages}
    for i, run in enumerate(runs):
        p, own = run[0], text[run[0][0]]
        facing = [(run[0], r[-1]) for r in runs[max(0, i - 2) : i]] + [(run[-1], r[0]) for r in runs[i + 1 : i + 3]]
        near = [(a, q) for a, q in facing if key(q)[0] == key(p)[0] and text[q[0]] != own]
        near.sort(key=lambda x: -len(next(c for c in (key(x[0])[1][:k] for k in range(len(key(x[0])[1]), -1, -1)) if key(x[1])[1].startswith(c))))
        near = [q for _, q in near]
        gone = set(html.common(own, text[near[0][0]])) if near else set()
        for q in near[1:]:
            usual = set(html.common(own, text[q[0]]))
            if sum(len(own[k]) for k in gone - usual) <= 0.5 * sum(len(x) for k, x in enumerate(own) if k not in usual):
                break
            gone = usual
        for q in run:
            out[q[0]] = " ".join(x for k, x in enumerate(own) if k not in gone)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_page_differencing(spark, parts):
    data = site(150, 3)
    df = spark.createDataFrame([p[:3] for p in data], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("gone", F.lit(2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["page_id"]: r for r in html.extract(df.repartition(parts), group=16).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {i: r["text"] for i, r in got.items()} == brute_extract(data)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    clean = [p for p in data if p[2] and got[p[0]]["text"] == " ".join(x.strip() for x in p[3])]
    assert len(clean) > 0.9 * sum(p[2] is not None for p in data)  # the template goes, the page's own lines stay


@pytest.mark.parametrize("parts", [1, 5])
def test_neighbours_beyond_copies(spark, parts):
    """Copies fill the places beside a page, over the bounds of partitions too: the next other page decides, for all of them alike."""
    frame = [f"line {k} of the template" for k in range(6)]
    page = lambda *own: "".join(f"<div>{x}</div>" for x in [*frame[:3], *own, *frame[3:]])
    data = [(i, f"http://a.example/b/{i}", page("the one story that all of these tell")) for i in range(40)] + [(50, "http://a.example/c/1", page("another story"))]
    data += [(60 + i, f"http://z.example/b/{i}", page("alone with its copies")) for i in range(6)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["page_id"]: r["text"] for r in html.extract(df.repartition(parts), group=4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {got[i] for i in range(40)} == {"the one story that all of these tell"} and got[50] == "another story"
    assert {got[60 + i] for i in range(6)} == {" ".join([*frame[:3], "alone with its copies", *frame[3:]])}


def test_pages_with_little_to_compare(spark):
    frame = "<body><div>Site name</div>" + "".join(f"<div>Line {k} of the frame, longer than what it holds</div>" for k in range(20)) + "{}</body>"
    pages = [(i, f"http://a.example/x/{i}", frame.format(f"<div>Only {i}.</div>")) for i in range(3)]
    pages += [(7, "http://b.example/y", None), (8, None, ""), (9, "http://c.example/", "<p>alone</p>"), (10, "http://d.example/1", "<div>copy of a text</div>"), (11, "http://d.example/2", "<div>copy of a text</div>")]
    df = spark.createDataFrame([*pages, pages[0]], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {0: "Only 0.", 1: "Only 1.", 2: "Only 2.", 7: "", 8: "", 9: "alone", 10: "copy of a text", 11: "copy of a text"}
    assert html.extract(df).count() == 9 and html.extract(df.limit(0)).collect() == []


# repeats


def brute_repeats(docs, n=100):
    seen, out = set(), {}
    for i in sorted(docs):
        b = docs[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, sample", [(50_000, 64), (1, 1)])
def test_repeats(spark, odd, empty, documents, hot, sample):
    for df in (odd, rows(spark, near_corpus()), documents):
        got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeats(df, hot, sample).collect()}
        assert got == brute_repeats(texts(df))
    assert repeats.repeats(empty).collect() == []
    assert repeats.repeats(odd.union(odd)).count() == len(ODD)


def test_without_repeats(spark, odd):
    stage = repeats.without_repeats(odd.withColumn("n_chars", F.length("text").cast("long")))
    assert stage.columns == [*odd.columns, "n_chars"]
    got = {r["doc_id"]: r for r in stage.collect()}
    assert len(got) == len(ODD) and got[4]["text"] == "one" and got[1]["text"] is None
    assert len(got[9]["text"]) < len(PASSAGE) * 2 and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())


def test_long_text_in_segments(monkeypatch):
    rng = np.random.default_rng(9)
    block = bytes(rng.integers(97, 123, 700, dtype=np.uint8))
    text = block + bytes(rng.integers(97, 123, 3000, dtype=np.uint8)) + block
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    windows = []
    for docs, shift, part, po in repeats._segments(data, off):
        doc, p1, _, span, _, _ = repeats.anchors(part, po)
        windows += [int(p) for a, s, d in zip(p1, span, doc, strict=True) for p in range(a + shift[d], a + shift[d] + s + 1)]
    assert sorted(set(windows)) == list(range(len(text) - 99))


# pieces


def test_pieces_equal_the_library(spark, odd, empty, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    for df in (odd, documents):
        got = {r["doc_id"]: r["ids"] for r in pieces.encode(df).collect()}
        for i, t in texts(df).items():
            assert got[i] == sp.encode(t), i
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(odd)).collect()}
    assert back == texts(odd)
    trip = pieces.round_trip(odd).collect()
    assert len(trip) == len(ODD) and all(r["exact"] for r in trip)
    assert pieces.encode(empty).collect() == [] and pieces.round_trip(empty).collect() == []


def test_pieces_of_odd_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    v = pieces.Vocabulary.load()
    rng = np.random.default_rng(7)
    cases = ["", " ", "a" * 400, " " * 70 + "x", "▁a▁▁b", "<s></s><unk><0x41>", "\0\1", "👍🏽é漢"] + ["".join(rng.choice(list("ab cé漢 \n\t▁👍then"), rng.integers(0, 300))) for _ in range(150)]
    raw = [c.encode() for c in cases]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, first = pieces.Encoder(v).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    for c, s, e in zip(cases, first[:-1], first[1:], strict=True):
        assert ids[s:e].tolist() == sp.encode(c), c


# the helpers


def test_hashes_follow_content():
    parts = [b"", b"ab cd", b"cd", b"AB", b"\xc3\xa9 x"]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    h, first = X.word_hashes(np.frombuffer(b"".join(parts), np.uint8), off, X.ALNUM)
    assert np.diff(first).tolist() == [0, 2, 1, 1, 2]
    assert h[1] == h[2] and h[0] == h[3] and len(set(h.tolist())) == 4
