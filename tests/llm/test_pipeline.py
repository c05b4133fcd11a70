"""The pipeline against its stages stated plainly, and its stages on awkward tables."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import ODD, PASSAGE, brute_components, brute_hits, near_corpus, toxic_corpus
from wardline.llm import decontam, neardup, pieces, quality, repeats, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def cut_repeats(docs, n=100):
    """Texts without the bytes of 100-byte strings that start earlier; characters that go in part stay whole."""
    seen, out = set(), {}
    for i in sorted(docs):
        b = docs[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        kept, at = [], 0
        for c in docs[i]:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                kept.append(c)
            at += size
        out[i] = "".join(kept)
    return out


def write(spark, folder, documents, labels, items):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in documents], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def corpus():
    toxic = [(10_000 + i, t) for i, t, _ in toxic_corpus()]
    labels = [(10_000 + i, 1, y) for i, _, y in toxic_corpus()] + [(None, 1, 1), (3, 0, None), (77_777, 1, 1)]
    shared = " ".join(f"shared{k}" for k in range(60))
    rng = np.random.default_rng(14)
    passages = [(30_000 + i, " ".join(f"own{rng.integers(0, 10**9)}" for _ in range(40)) + " " + shared + " " + " ".join(f"own{rng.integers(0, 10**9)}" for _ in range(40))) for i in range(6)]
    quoted = " ".join(f"quoted{k}" for k in range(12))
    leaks = [(40_000, "before " + quoted + " after"), (40_001, "before " + " ".join(quoted.split()[:9]) + " after")]
    return [*[(i, t) for i, t in ODD if i != 8], *near_corpus(), *toxic, *passages, *leaks], labels, [(1, quoted), (2, None), (3, "")]


def test_run_equals_its_stages_stated_plainly(spark, corpus, tmp_path):
    documents, labels, items = corpus
    write(spark, str(tmp_path), documents, labels, items)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    flagged = {r["doc_id"] for r in toxicity.toxicity(read("documents"), read("labels")).where("predicted = 1").collect()}
    assert 50 < len(flagged) < 300
    left = {i: t or "" for i, t in documents if i not in flagged}
    classes = brute_components(left, 80)
    left = cut_repeats({i: t for i, t in left.items() if classes[i][1] == i})
    hits = brute_hits(left, items)
    left = {i: t for i, t in left.items() if not hits[i][4]}
    assert 40_000 not in left and 40_001 in left and not any("shared30" in left.get(i, "") for i in range(30_001, 30_006))
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    assert got == {i: sp.encode(t) for i, t in left.items()}


def test_stages_keep_the_columns_of_documents(spark, corpus, tmp_path):
    documents, labels, items = corpus
    write(spark, str(tmp_path), documents[:200], labels, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_and_repeats(spark, tmp_path):
    rows = [(1, PASSAGE * 2), (1, "z short"), (1, "z short"), (2, None), (2, None), (None, "no id"), (None, None), (3, ""), (4, PASSAGE + "end"), (4, PASSAGE + "end")]
    write(spark, str(tmp_path), rows, [(1, None, None)], [(None, None)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(["1", "1", "1", "2", "2", "None", "None", "3", "4", "4"])


#: names that operators use for what they add
CLASHES = "row text_ score rec spans votes posterior n_words items longest longest_word k1 k2 c own part place block sig chunk region tree id gone held label __score __rec __spans __votes __items kept component_id n_shingles".split()


def test_clashing_columns(spark):
    texts = [*ODD, *near_corpus()[:20]]
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string").select("doc_id", "text", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("place", F.lit(1))
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("n_words", F.lit("n"))
    for out in (toxicity.without_toxic(docs, labels), neardup.one_of_each(docs), repeats.without_repeats(docs), decontam.decontaminate(docs, bench), decontam.decontaminate(docs, bench, block_bytes=4), quality.good_documents(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in CLASHES)


def test_repeated_ids_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, PASSAGE * 3, "a"), (1, "z short", "b"), (1, "Zebra 0123456789", "c"), (2, "before " + PASSAGE, "d"), (None, PASSAGE, "e")], "doc_id long, text string, tag string")
    got = {r["tag"]: r["text"] for r in repeats.without_repeats(docs).collect()}
    assert got["b"] == "z short" and got["c"] == "Zebra 0123456789" and got["e"] == PASSAGE
    assert got["d"] == "before" and len(got["a"]) < 2 * len(PASSAGE)
    named = docs.where("doc_id is not null").withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    assert {r["tag"]: r["text"] for r in repeats.without_repeats(named).collect()} == {k: v for k, v in got.items() if k != "e"}


def test_a_very_long_text(spark, tmp_path):
    """Twelve million characters in one text, among short ones."""
    rng = np.random.default_rng(2)
    words = np.array([f"w{n}" for n in range(50_000)])
    long = " ".join(words[rng.integers(0, len(words), 1_900_000)].tolist())
    write(spark, str(tmp_path), [(1, long), (2, long[: len(long) // 2]), (3, "short one")], [], [(1, " ".join(long.split()[100:112]))])
    got = {r["doc_id"]: len(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {2, 3} and got[2] == 0  # the first holds the item, the second is all a repeat of the first


def test_nothing_is_left_in_the_checkpoint_folder(spark, corpus, tmp_path):
    import os

    documents, labels, items = corpus
    write(spark, str(tmp_path), documents[:150], labels, items)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://").removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))
    before = size()
    near = neardup.near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert near.count() and size() == before and not spark.sparkContext._jsc.getPersistentRDDs()
