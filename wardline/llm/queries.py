"""The check queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import chat, decontam, divergence, html, licenses, lloyd, neardup, pieces, quality, repeats, tokenfile, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.extra_conversation(_table(spark, sf_dir, "conversations")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digests(_table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(_table(spark, sf_dir, "embeddings"))


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
  SELECT *, 15 + length(role) + length(text)
       + (length(role) - length(replace(role, ':', ''))) + (length(text) - length(replace(text, '\', '')))
       + (length(text) - length(replace(text, '</turn>', ''))) // 7
       + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS n
  FROM rows)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM written WHERE conv_id IS NOT NULL GROUP BY conv_id
"""

OP5_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
doc_words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (SELECT row_number() OVER () AS item_row, * FROM item_words WHERE len(w) > 0),
item_windows AS (
  SELECT item_row, item, j, least(len(w), 10) AS m, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM items)),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, lengths WHERE len(w) >= m)),
matches AS (SELECT d.doc_id, d.i, d.m, b.item_row, b.item, b.j FROM doc_windows d JOIN item_windows b ON d.win = b.win AND d.m = b.m),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM matches) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM matches GROUP BY doc_id),
runs AS (
  SELECT doc_id, count(*) + any_value(m) - 1 AS n, min(i) - 1 AS word
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_row, i - j ORDER BY i) AS g FROM matches) GROUP BY doc_id, item_row, i - j, g),
longest AS (SELECT doc_id, max(n) AS n, arg_min(word, (-n, word)) AS word FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(k.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(k.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated, CAST(coalesce(l.n, 0) AS BIGINT) AS longest, CAST(l.word AS BIGINT) AS longest_word
FROM doc_words d LEFT JOIN hits h USING (doc_id) LEFT JOIN named k USING (doc_id) LEFT JOIN longest l USING (doc_id)
"""

OP6_SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dots AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dots) WHERE rank <= 5
"""

OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
terms AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * v.v) AS p
  FROM grp g JOIN kept k USING (lang) JOIN terms v USING (lang) LEFT JOIN counts c USING (lang, source, term) LEFT JOIN totals t USING (lang, source)),
q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(t.total) + 5 * any_value(v.v)) AS q
  FROM p JOIN (SELECT lang, sum(n) AS total FROM totals GROUP BY lang) t USING (lang) JOIN terms v USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
rises AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM rises))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _lloyd_sql(k: int = 16, rounds: int = 3) -> str:
    steps = [f"""
kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT row_number() OVER () AS r, * FROM kept),
comps AS (SELECT r, i AS dim, q[i] AS x FROM rows, range(1, 65) AS t(i)),
c0 AS (
  SELECT num, i AS dim, q[i] AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS num, q FROM kept QUALIFY num < {k}), range(1, 65) AS t(i))"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS (
  SELECT r, arg_min(num, (d, num)) AS num, min(d) AS d
  FROM (SELECT v.r, c.num, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM comps v JOIN c{n} c USING (dim) GROUP BY v.r, c.num) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (SELECT num, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS w FROM comps JOIN a{n} USING (r) GROUP BY num, dim),
c{n + 1} AS (SELECT c.num, c.dim, coalesce((s - ((s % w) + w) % w) // w, c.x) AS x FROM c{n} c LEFT JOIN s{n} USING (num, dim))""")
    return f"""
WITH {",".join(steps)},
hashes AS (SELECT num, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS h FROM c{rounds} GROUP BY num),
copies AS (SELECT q, count(*) AS n FROM kept GROUP BY q)
SELECT vec_id, CAST(num AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256, n AS multiplicity
FROM rows JOIN a{rounds} USING (r) JOIN hashes USING (num) JOIN copies USING (q)
"""


OP13_SQL = _lloyd_sql()

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_toxicity,
        op3_quality_classifier,
        op4_chat_formatting,
        op5_benchmark_decontamination,
        op6_exact_top_k,
        op7_minhash_near_dedup,
        op8_html_extraction,
        op9_suffix_array_dedup,
        op10_sentencepiece,
        op11_source_divergence,
        op12_token_file,
        op13_centroid_clustering,
    )
}

ORACLES = {"op4_chat_formatting": OP4_SQL, "op5_benchmark_decontamination": OP5_SQL, "op6_exact_top_k": OP6_SQL, "op11_source_divergence": OP11_SQL, "op13_centroid_clustering": OP13_SQL}
