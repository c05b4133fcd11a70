"""Source divergence, token files and centroid clustering against plain statements of what they compute."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import divergence, lloyd, tokenfile

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LONG = " ".join(f"wörd{chr(97 + i % 23)}{chr(97 + i % 7)}" for i in range(60_000))


# source divergence


def plain_divergence(docs, least):
    docs = [tuple(v or "" for v in d) for d in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        mine = [(s, TERM.findall(t.translate(LOW))) for t, g, s in docs if g == lang]
        df = collections.Counter(w for _, ws in mine for w in set(ws))
        kept = sorted((w for w in df if df[w] >= least), key=str.encode)
        sources = sorted({s for s, _ in mine}, key=str.encode)
        count = {s: collections.Counter(w for x, ws in mine if x == s for w in ws) for s in sources}
        whole = collections.Counter(w for _, ws in mine for w in ws)
        shares = lambda c, kept=kept: {w: 1 + 1_000_000_000 * (c[w] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for w in kept}
        p, q = {s: shares(count[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            rises = [(q[w] - p[s][w], w.encode()) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", sorted(rises)[:50])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(items))}
    return out


def some_docs(n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ab", "é", "Zz", "漢", "ß", "zz") for b in map(chr, range(97, 117))]
    docs = []
    for i in range(n):
        lang = ["en", "de", None, ""][rng.integers(0, 4)]
        source = [None, "", "a", "b", "é", "z", "hot"][min(6, rng.integers(0, 9))]
        docs.append((" ".join(rng.choice(words, rng.integers(0, 25))) + ("1x,y" if i % 7 == 0 else ""), lang, source))
    docs += [(None, "en", "only-null"), ("", "xx", "p"), ("once", "xx", "q"), (" \0 12 ", "xx", "r"), (LONG, "en", "long"), ("once", "yy", "alone"), ("ab" * 50_000, "de", "a")]
    return docs + docs[:20]


@pytest.mark.parametrize(("least", "sizes"), [(30, {}), (3, {"chunk_terms": 7, "chunk_rows": 40, "tile_sources": 2}), (1, {"chunk_terms": 1, "tile_sources": 3}), (10_000, {})])
def test_divergence(spark, least, sizes):
    docs = some_docs()
    df = spark.createDataFrame([(t, g, s, "x", 1) for t, g, s in docs], "text string, lang string, source string, term string, n int").repartition(5)
    got = divergence.divergence(df, least, **sizes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_divergence(docs, least)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string, doc_id long")
    assert divergence.divergence(empty).collect() == []
    one = spark.createDataFrame([("a b", "en", "s", 1)], empty.schema)
    assert divergence.divergence(one).collect() == []


def test_shares_of_large_counts():
    count, total, terms = np.array([0, (1 << 47) - 1, 123_456_789_012]), (1 << 48) - 1, 40_000_000
    assert divergence.share(count, total, terms).tolist() == [1 + 1_000_000_000 * (c + 5) // (total + 5 * terms) for c in count.tolist()]


# token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfile.tokenizer_path(tokenfile.TOKENIZER))


def encoded(texts):
    raw = [t.encode() for t in texts]
    return tokenfile.Encoder(tokenfile.tokenizer_path(tokenfile.TOKENIZER), most=500).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))


def test_pieces_equal_the_library(library):
    rng = np.random.default_rng(8)
    letters = list("aB1 .,;:!?()\"'<|>sS tTéßΣ漢̸́̇ͅ\t\n\x0b\x0c\x1c\x85 　 ſK\0")
    texts = ["", "a" * 3000, "<|endoftext|>x, <|startoftext|>.", '"<|endoftext|>"', "don't, we'LL!?'s", "a.́b", "!̸", "İstanbul,İ.", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    ids, first = encoded(texts)
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[i] : first[i + 1]].tolist() == e.ids, texts[i]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000])
@pytest.mark.parametrize("top", [1, 255, 256, 49_408, (1 << 32) - 1])
def test_file_by_place(tmp_path, n, top):
    rng = np.random.default_rng(n + top)
    ids = np.minimum(rng.zipf(1.2, n), top).astype(np.uint32) * (rng.random(n) > 0.1)
    ids = ids.astype(np.uint32)
    path = tmp_path / "x.tok"
    path.write_bytes(tokenfile.encode_file(ids, np.array([-5, 9]), np.array([0, n // 3, n])))
    file = tokenfile.TokenFile(str(path))
    assert (file.tokens(0, n) == ids).all() and [a.tolist() for a in file.documents()] == [[-5, 9], [0, n // 3, n]]
    for i in {0, n - 1, n // 2, 511, 512} & set(range(n)):
        assert file.token(i) == ids[i]
    for i, j in np.sort(rng.integers(0, n + 1, (30, 2)), axis=1).tolist():
        assert (file.tokens(i, j) == ids[i:j]).all()
    with pytest.raises(IndexError):
        file.tokens(0, n + 1)


def test_files_are_small():
    skewed = np.concatenate([np.zeros(100_000), np.full(100, 40_000)]).astype(np.uint32)
    assert tokenfile.widths(skewed)[0] == 1 and len(tokenfile.encode_file(skewed, np.array([1]), np.array([0, len(skewed)]))) < 30_000
    with pytest.raises(ValueError):
        tokenfile.TokenFile(__file__)


def plain_tokens(library, docs):
    best = {}
    for i, t in docs:
        if i is not None:
            best[i] = min(t, best.get(i, t), key=lambda x: (x is not None, (x or "").encode())) if i in best and None in (t, best[i]) else min(t or "", best[i] or "", key=str.encode) if i in best else t
    out, at, flat = {}, 0, []
    for i in sorted(best):
        ids = library.encode(best[i] or "", add_special_tokens=False).ids + [1]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        flat += ids
    return out, flat


def test_token_files(spark, library, tmp_path):
    docs = [(i * 3 - 50, " ".join(f"word{i} Ünder,{k}" for k in range(i % 40))) for i in range(120)] + [(1000, None), (1001, ""), (1002, LONG), (None, "no id"), (1003, "same"), (1003, "same"), (5000, "  \n"), (-9, "a" * 5000)]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in docs], "doc_id long, text string, n_tokens int, file string").repartition(3)
    want, flat = plain_tokens(library, docs)
    for file_ids in (50, tokenfile.FILE_IDS):
        folder = f"{tmp_path}/{file_ids}"
        files = tokenfile.write_ids(df, folder, file_ids=file_ids)
        assert files.count() > (20 if file_ids == 50 else 0) and files.agg(F.sum("n_tokens")).first()[0] == len(flat)
        got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.documents(spark, folder).collect()}
        assert got == want
        asked = [0, 1, len(flat) - 1, len(flat), -1, None, 17, 17, *range(100, len(flat), 997)]
        found = tokenfile.tokens_at(spark.createDataFrame([(p, "z") for p in asked], "position long, file string"), folder)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(((p, flat[p] if p is not None and 0 <= p < len(flat) else None) for p in asked), key=str)


def test_token_files_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.token_digests(empty).collect() == []
    folder = f"{tmp_path}/none"
    tokenfile.write_ids(empty, folder)
    assert [tuple(r) for r in tokenfile.tokens_at(spark.range(2).toDF("position"), folder).collect()] == [(0, None), (1, None)]


def test_files_of_lost_attempts_are_not_read(spark, library, tmp_path):
    docs = [(1, "one two"), (2, "three")]
    folder = f"{tmp_path}/lost"
    tokenfile.write_ids(spark.createDataFrame(docs, "doc_id long, text string"), folder)
    (tmp_path / "lost" / "data" / "00000000-000000-dead.tok").write_bytes(b"half a file")
    assert {r["doc_id"] for r in tokenfile.documents(spark, folder).collect()} == {1, 2}


# centroid clustering


def plain_lloyd(rows, k, rounds, scale=64, dims=64):
    kept = [(i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cents = [list(v) for _, v in first]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((dist(v, c), n) for n, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        to = assign()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, m) in zip(kept, to, strict=True) if m == n]
            if mine:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    to, big = assign(), (1 << 63) - 1
    of = collections.Counter()
    for d, n in to:
        of[n] += min(d, big)
    copies = collections.Counter(v for _, v in kept)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((i, n, min(d, big), min(of[n], big), min(sum(of.values()), big), sha[n], copies[v]) for (i, v), (d, n) in zip(kept, to, strict=True))


def vectors(seed, n, dims=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(9, dims))
    return [(i, (base[rng.integers(0, 9)] + rng.normal(size=dims) * rng.choice([0.0, 0.02, 0.3])).astype("f4").tolist()) for i in range(n)]


def spread(rows, spark):
    return spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<float>, cluster int, q string").repartition(3)


ODD_VECTORS = [(9001, None), (9002, []), (9003, [1.0] * 63), (9004, [1.0] * 63 + [None]), (9005, [1.0] * 63 + [float("nan")]), (9006, [1.0] * 63 + [float("-inf")]), (None, [1.0] * 64), (9007, [-0.0] * 64), (9008, [0.0] * 64), (3, [5.0] * 64)]


@pytest.mark.parametrize("wide", [0, 1])
def test_clusters(spark, wide):
    rows = vectors(5, 200) + ODD_VECTORS
    rows += [(10_000 + i, rows[0][1]) for i in range(150)]  # a hot vector
    if wide:
        rows += [(20_000, [3e38] * 64), (20_001, [-3e38] + [1.0] * 63), (20_002, [70_000.5] * 64), (20_003, [3e38] * 64)]
    got = sorted(tuple(r) for r in lloyd.clusters(spread(rows, spark)).collect())
    assert got == plain_lloyd(rows, 16, 3)


def test_clusters_with_few_vectors(spark):
    rows = [(1, [1.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64), (3, [2.0] * 64)]
    assert sorted(tuple(r) for r in lloyd.clusters(spread(rows, spark)).collect()) == plain_lloyd(rows, 16, 3)
    none = lloyd.clusters(spread(ODD_VECTORS[:6], spark))
    assert none.collect() == [] and none.columns == lloyd.clusters(spread(rows, spark)).columns


def test_clusters_in_other_sizes(spark):
    rows = vectors(6, 80, dims=5)
    assert sorted(tuple(r) for r in lloyd.clusters(spread(rows, spark), k=4, rounds=7, scale=1000, dims=5).collect()) == plain_lloyd(rows, 4, 7, 1000, 5)


