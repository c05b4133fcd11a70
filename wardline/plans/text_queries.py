"""Queries over messages, documents, vectors and rule tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import checksums as C
from wardline.operators import detect as D
from wardline.operators import hints as H
from wardline.operators import inspect as N
from wardline.operators import neighbours as K
from wardline.operators import policy as P
from wardline.operators import spans as S
from wardline.plans.registry import query
from wardline.sources import bridge as B

MSG = B.MESSAGES_SQL
KEY = ["request_id", "message_index"]


@query("request_text", f"WITH {MSG} SELECT request_id, string_agg(content, chr(10) ORDER BY message_index) AS text FROM messages WHERE role IN ('user', 'tool') GROUP BY request_id")
def request_text(spark, sf_dir):
    turns = B.messages(spark, sf_dir).where("role in ('user', 'tool')")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("message_index", "content"))), lambda t: t["content"])
    return turns.groupBy("request_id").agg(F.array_join(ordered, "\n").alias("text"))


@query("luhn", "SELECT o_orderkey, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(r, i, 1) AS INT) ELSE CAST(substr(r, i, 1) AS INT) * 2 // 10 + CAST(substr(r, i, 1) AS INT) * 2 % 10 END)) % 10 = 0 AS valid FROM (SELECT o_orderkey, d, reverse(d) AS r FROM (SELECT o_orderkey, CAST(o_orderkey * 7919 + 4000000000000 AS VARCHAR) AS d FROM orders))")
def luhn(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select("o_orderkey", C.luhn((F.col("o_orderkey") * 7919 + 4000000000000).cast("string")).alias("valid"))


_TABLES = f"{C.PRODUCTS} AS mul, {C.PERMUTED} AS perm"


@query("verhoeff", f"SELECT o_orderkey, list_reduce(list_prepend(0, list_transform(range(0, length(d)), lambda i: 100 + (i % 8) * 10 + CAST(substr(r, i + 1, 1) AS INT))), lambda c, x: mul[c * 10 + perm[x - 100 + 1] + 1]) = 0 AS valid FROM (SELECT o_orderkey, d, reverse(d) AS r, {_TABLES} FROM (SELECT o_orderkey, CAST(o_orderkey * 7919 + 200000000000 AS VARCHAR) AS d FROM orders))")
def verhoeff(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select("o_orderkey", C.verhoeff((F.col("o_orderkey") * 7919 + 200000000000).cast("string")).alias("valid"))


_H = "round(list_sum(list_transform(list_sort(list_distinct(string_split(t, ''))), lambda c: -((length(t) - length(replace(t, c, ''))) / length(t)) * log2((length(t) - length(replace(t, c, ''))) / length(t)))), 6)"


@query("token_entropy", f"SELECT p_partkey, {_H} + 0.0 AS entropy, len(list_distinct(string_split(t, ''))) AS charset, CASE WHEN {_H} >= 4.5 THEN 0.10 WHEN {_H} >= 3.5 THEN 0.05 WHEN {_H} >= 2.5 THEN 0.0 WHEN {_H} >= 1.5 THEN -0.05 ELSE -0.10 END AS modifier FROM (SELECT p_partkey, p_name || p_type AS t FROM part)")
def token_entropy(spark, sf_dir):
    rows = B.dealt(B.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", "p_type").alias("t")), "p_partkey")
    rows = rows.select("p_partkey", "t", S.held(F.round(C.entropy(F.col("t")), 6)).alias("entropy"))
    return rows.select("p_partkey", "entropy", C.charset_size(F.col("t")).alias("charset"), C.confidence_modifier(F.col("entropy")).alias("modifier"))


@query("entropy_findings")
def entropy_findings(spark, sf_dir):
    return D.entropy_findings(B.table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query("email_findings", "SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(?:\\.[A-Za-z0-9\\-]+)*\\.[A-Za-z]{2,}')) AS value FROM documents)")
def email_findings(spark, sf_dir):
    return D.findings(B.table(spark, sf_dir, "documents"), "text", ["doc_id"], D.PERSONAL[:1]).select("doc_id", "value")


@query("pii_findings")
def pii_findings(spark, sf_dir):
    return S.resolve(D.findings(B.table(spark, sf_dir, "documents"), "text", ["doc_id"]), "doc_id")


@query("secret_findings")
def secret_findings(spark, sf_dir):
    return S.resolve(D.findings(B.table(spark, sf_dir, "documents"), "text", ["doc_id"], D.SECRETS), "doc_id")


@query("entropy_minus_secret")
def entropy_minus_secret(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return S.without_touching(D.entropy_findings(docs, "text", ["doc_id"]), D.findings(docs, "text", ["doc_id"], D.SECRETS), "doc_id")


SPANS_SQL = "spans AS (SELECT l_orderkey AS req, l_linenumber AS n, l_partkey % 60 AS s, l_partkey % 60 + 1 + l_suppkey % 20 AS e, CASE WHEN l_linenumber % 2 = 0 THEN 'SECRET' ELSE 'PII' END AS category FROM lineitem)"


def _spans(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("req"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 60).alias("start"), (F.col("l_partkey") % 60 + 1 + F.col("l_suppkey") % 20).alias("end"), F.when(F.col("l_linenumber") % 2 == 0, "SECRET").otherwise("PII").alias("category"))


@query("span_subtract_covered", f"WITH {SPANS_SQL} SELECT req, n, s AS start_at, e AS end_at FROM spans a WHERE category = 'PII' AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.category = 'SECRET' AND b.req = a.req AND b.s <= a.s AND a.e <= b.e)")
def span_subtract_covered(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    left = S.without_covered(rows.where("category = 'PII'"), rows.where("category = 'SECRET'"), "req")
    return left.select("req", "n", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("span_resolve")
def span_resolve(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    typed = rows.select("req", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), (F.col("n") / 10).alias("confidence"), F.col("category").alias("type"), F.col("n").cast("string").alias("value"))
    return S.resolve(typed, "req")


@query("placeholder_numbering", "WITH f AS (SELECT l_orderkey AS req, l_linenumber AS msg, l_partkey % 5 AS v, CASE WHEN l_suppkey % 2 = 0 THEN 'EMAIL' ELSE 'PHONE' END AS type FROM lineitem), p AS (SELECT *, min(msg) OVER (PARTITION BY req, type, v) AS first FROM f) SELECT req, msg, v, '<' || type || '_' || dense_rank() OVER (PARTITION BY req, type ORDER BY first) || '>' AS placeholder FROM p")
def placeholder_numbering(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("req"), F.col("l_linenumber").alias("msg"), (F.col("l_partkey") % 5).alias("value"), F.when(F.col("l_suppkey") % 2 == 0, "EMAIL").otherwise("PHONE").alias("type"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    return S.number_placeholders(rows, "req", "msg").select("req", "msg", F.col("value").alias("v"), "placeholder")


_REDACTION = [("pii", "sanitize", 10, True), ("secret", "sanitize", 90, False)]


@query("redact_text")
def redact_text(spark, sf_dir):
    """Every message with its personal data and secrets replaced, and whether anything was."""
    rows = B.messages(spark, sf_dir)
    rules = spark.createDataFrame(_REDACTION, "key string, action string, priority int, appealable boolean")
    clean = N.redacted(rows, rules)
    return clean.select(*KEY, "role", F.col("clean").alias("content"), F.col("n_replaced").alias("n_findings"), F.when(F.col("n_replaced") > 0, "sanitize").otherwise("allow").alias("decision"))


@query("line_col", "SELECT doc_id, length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) + 1 AS line, length(regexp_extract(substr(text, 1, length(text) // 2), '[^\\n]*$')) + 1 AS col FROM documents")
def line_col(spark, sf_dir):
    at = S.line_column(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    return B.table(spark, sf_dir, "documents").select("doc_id", at["line"].alias("line"), at["column"].alias("col"))


@query("mask_preview", "SELECT c_custkey, CASE WHEN length(v) <= 8 THEN repeat('*', length(v)) WHEN length(v) <= 12 THEN left(v, 2) || repeat('*', least(12, length(v) - 4)) || right(v, 2) ELSE left(v, 4) || repeat('*', least(12, length(v) - 8)) || right(v, 4) END AS preview, substr(sha256('customer' || chr(0) || v), 1, 16) AS fingerprint FROM (SELECT c_custkey, left(c_name || c_mktsegment, 1 + c_custkey % 24) AS v FROM customer)")
def mask_preview(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select("c_custkey", F.left(F.concat("c_name", "c_mktsegment"), (F.col("c_custkey") % 24 + 1).cast("int")).alias("v"))
    return c.select("c_custkey", C.mask_preview(F.col("v")).alias("preview"), C.fingerprint(F.lit("customer"), F.col("v")).alias("fingerprint"))


@query("rehydrate", "SELECT n_nationkey, replace(replace('Dear <NAME_1> of <PLACE_1>', '<NAME_1>', n_name), '<PLACE_1>', r_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def rehydrate(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation").join(F.broadcast(B.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    vault = F.create_map(F.lit("<NAME_1>"), "n_name", F.lit("<PLACE_1>"), "r_name")
    return n.select("n_nationkey", H.rehydrate(F.lit("Dear <NAME_1> of <PLACE_1>"), vault).alias("text"))


# policy

RULES = [("default", "pii", "sanitize", 10, True), ("default", "pii.EMAIL", "warn", 20, True), ("default", "secret", "block", 90, False), ("default", "injection", "block", 80, True), ("default", "entropy", "warn", 5, True), ("strict", "pii", "block", 10, True), ("strict", "pii.EMAIL", "block", 20, True), ("strict", "secret", "block", 90, False), ("open", "pii", "allow", 1, True), ("open", "secret", "warn", 1, True)]
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{k}', '{a}', {n}, {str(o).lower()})" for p, k, a, n, o in RULES) + ") AS t(profile, key, action, priority, appealable))"


def _rules(spark, profile=None):
    df = spark.createDataFrame(RULES, "profile string, key string, action string, priority int, appealable boolean")
    return df if profile is None else df.where(F.col("profile") == profile)


FOUND_SQL = "found AS (SELECT l_orderkey AS req, l_linenumber AS ordinal, CASE l_suppkey % 5 WHEN 0 THEN 'pii.EMAIL' WHEN 1 THEN 'pii.PHONE' WHEN 2 THEN 'secret.AWS' WHEN 3 THEN 'injection' ELSE 'entropy.token' END AS key FROM lineitem)"


def _found(spark, sf_dir):
    kind = F.col("l_suppkey") % 5
    return B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("req"), F.col("l_linenumber").alias("ordinal"), F.when(kind == 0, "pii.EMAIL").when(kind == 1, "pii.PHONE").when(kind == 2, "secret.AWS").when(kind == 3, "injection").otherwise("entropy.token").alias("key"))


RESOLVED_SQL = "resolved AS (SELECT k.key, coalesce(a.key, b.key) AS rule, coalesce(a.action, b.action) AS action, coalesce(a.priority, b.priority) AS priority, coalesce(a.appealable, b.appealable) AS appealable FROM (SELECT DISTINCT key FROM found) k LEFT JOIN rules a ON a.profile = 'default' AND a.key = k.key LEFT JOIN rules b ON b.profile = 'default' AND b.key = split_part(k.key, '.', 1))"
DECIDE_SQL = "SELECT req, ['allow', 'warn', 'sanitize', 'block'][max(rank) + 1] AS decision, arg_max(rule, priority * 100 - ordinal) FILTER (WHERE action = 'block') AS block_rule, count(*) FILTER (WHERE action = 'sanitize') AS n_sanitize FROM (SELECT *, CASE action WHEN 'allow' THEN 0 WHEN 'warn' THEN 1 WHEN 'sanitize' THEN 2 ELSE 3 END AS rank FROM f) GROUP BY req"


@query("policy_resolve", f"WITH {RULES_SQL}, {FOUND_SQL}, {RESOLVED_SQL} SELECT * FROM resolved")
def policy_resolve(spark, sf_dir):
    return P.resolve(_found(spark, sf_dir).select("key").distinct(), _rules(spark, "default"))


def _ruled(spark, sf_dir):
    found = _found(spark, sf_dir)
    return found.join(F.broadcast(P.resolve(found.select("key").distinct(), _rules(spark, "default"))), "key")


@query("policy_decisions", f"WITH {RULES_SQL}, {FOUND_SQL}, {RESOLVED_SQL}, f AS (SELECT * FROM found JOIN resolved USING (key)) {DECIDE_SQL}")
def policy_decisions(spark, sf_dir):
    return P.decide(_ruled(spark, sf_dir), "req").drop("rules_fired")


@query("policy_override", f"WITH {RULES_SQL}, {FOUND_SQL}, {RESOLVED_SQL}, f AS (SELECT req, ordinal, rule, priority, CASE WHEN req % 2 = 0 AND action = 'block' AND appealable THEN 'sanitize' ELSE action END AS action FROM found JOIN resolved USING (key)) {DECIDE_SQL}")
def policy_override(spark, sf_dir):
    rows = _ruled(spark, sf_dir).withColumn("overridden", F.col("req") % 2 == 0)
    return P.decide(P.lift(rows, "req", "overridden"), "req").drop("rules_fired")


# two rule sets in which each part is a kind of finding: the second lacks some of the first's rules, has others, and changes every seventh action
_ACTIONS = "['allow', 'warn', 'sanitize', 'block']"
_OLD_SQL = f"old AS (SELECT 'pii.K' || p_partkey AS key, ({_ACTIONS})[p_size % 4 + 1] AS action FROM part WHERE p_partkey % 3 <> 0)"
_NEW_SQL = f"new AS (SELECT 'pii.K' || p_partkey AS key, ({_ACTIONS})[(p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 4 + 1] AS action FROM part WHERE p_partkey % 5 <> 0)"


def _action(n):
    return F.get(F.array(*map(F.lit, P.RANK)), (n % 4).cast("int"))


def _rule_sets(spark, sf_dir):
    part, k = B.table(spark, sf_dir, "part"), F.col("p_partkey")
    key = F.concat(F.lit("pii.K"), k).alias("key")
    return part.where(k % 3 != 0).select(key, _action(F.col("p_size")).alias("action")), part.where(k % 5 != 0).select(key, _action(F.col("p_size") + F.when(k % 7 == 0, 1).otherwise(0)).alias("action"))


@query("policy_diff", f"WITH {_OLD_SQL}, {_NEW_SQL} SELECT coalesce(a.key, b.key) AS key, a.action AS before, b.action AS after, CASE WHEN a.action IS NULL THEN 'added' WHEN b.action IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old a FULL JOIN new b ON a.key = b.key WHERE a.action IS DISTINCT FROM b.action")
def policy_diff(spark, sf_dir):
    return P.difference(*_rule_sets(spark, sf_dir))


@query("policy_rule_setops", f"WITH {_OLD_SQL}, {_NEW_SQL} SELECT key, 'both' AS side FROM (SELECT key FROM old INTERSECT SELECT key FROM new) UNION ALL SELECT key, 'only' FROM (SELECT key FROM old EXCEPT SELECT key FROM new)")
def policy_rule_setops(spark, sf_dir):
    a, b = (r.select("key") for r in _rule_sets(spark, sf_dir))
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("only")))


@query("policy_flags", f"WITH r AS (SELECT p_brand || (p_partkey % 11) AS profile, ['pii.', 'secret.', 'injection'][p_partkey % 3 + 1] || CASE WHEN p_partkey % 3 = 2 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS key, ({_ACTIONS})[p_size % 4 + 1] AS action FROM part) SELECT profile, bool_or(starts_with(key, 'pii.') AND action <> 'allow') AS pii, bool_or(starts_with(key, 'secret.') AND action <> 'allow') AS secret, bool_or(starts_with(key, 'injection') AND action <> 'allow') AS injection, bool_or(starts_with(key, 'pii.') AND action = 'block') AS blocks_pii FROM r GROUP BY profile")
def policy_flags(spark, sf_dir):
    k = F.col("p_partkey")
    key = F.when(k % 3 == 0, F.concat(F.lit("pii."), k)).when(k % 3 == 1, F.concat(F.lit("secret."), k)).otherwise("injection")
    return P.flags(B.table(spark, sf_dir, "part").select(F.concat("p_brand", k % 11).alias("profile"), key.alias("key"), _action(F.col("p_size")).alias("action")))


@query("egress_decisions", "SELECT event_id, ['PASS', 'ANNOTATE', 'REPLACE'][greatest(CASE WHEN harm >= 0.7 THEN 2 ELSE 0 END, CASE WHEN bias >= 0.6 THEN 1 ELSE 0 END, CASE WHEN grounding IS NULL OR grounding >= 0.75 THEN 0 WHEN grounding >= 0.5 THEN 1 ELSE 2 END) + 1] AS egress_action FROM (SELECT event_id, event_id % 10 / 10 AS harm, event_id % 7 / 7 AS bias, CASE WHEN event_id % 3 > 0 THEN event_id % 20 / 20 END AS grounding FROM events)")
def egress_decisions(spark, sf_dir):
    n = F.col("event_id")
    rows = B.table(spark, sf_dir, "events").select("event_id", (n % 10 / 10).alias("harm"), (n % 7 / 7).alias("bias"), F.when(n % 3 > 0, n % 20 / 20).alias("grounding"))
    return P.egress(rows, 0.7, 0.6, 0.75, 0.5).select("event_id", "egress_action")


@query("noisy_or_score", "SELECT l_orderkey AS req, round(1 - product(1 - w), 3) AS score FROM (SELECT l_orderkey, l_returnflag, max(l_discount) AS w FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY l_orderkey")
def noisy_or_score(spark, sf_dir):
    hits = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("req"), F.col("l_returnflag").alias("category"), F.col("l_discount").alias("weight"))
    return D.noisy_or(hits, "req").select("req", "score")


# hints

#: what makes a request hard, as the SQL knows it
_REASON = " OR ".join(f"contains(lower(text), '{m}')" for m in ("explain why", "explain how", "step by step", "step-by-step", "prove", "derive", "analyse", "analyze", "compare and contrast", "critique", "evaluate the", "reason about", "think through", "what are the implications", "trade-offs", "tradeoffs", "pros and cons"))
_CODE = " OR ".join(f"contains(text, '{m}')" for m in ("```", "def ", "class ", "function ", "SELECT ", "import ", "#include", "public static", "=> {"))
_ASKED = f"WITH {MSG}, asked AS (SELECT request_id, string_agg(content, chr(10) ORDER BY message_index) || CASE request_id % 4 WHEN 0 THEN ' explain why' WHEN 1 THEN ' import x' WHEN 2 THEN '? so? really?' ELSE '' END AS text FROM messages WHERE role IN ('user', 'tool') GROUP BY request_id)"


@query("complexity_inspector", f"""{_ASKED}, m AS (SELECT *, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS n, {_REASON} AS hard, {_CODE} AS code, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS lines, length(text) - length(replace(text, '?', '')) AS asks FROM asked),
  b AS (SELECT *, CASE WHEN n < 20 THEN 0 WHEN n < 120 THEN 1 ELSE 2 END AS band FROM m), l AS (SELECT *, CASE WHEN hard OR (code AND lines > 30) THEN 2 WHEN code THEN greatest(band, 1) ELSE band END AS lifted FROM b)
  SELECT request_id, ['LOW', 'MEDIUM', 'HIGH'][CASE WHEN asks >= 3 AND lifted < 2 THEN 1 ELSE lifted END + 1] AS level,
    list_filter([['short_prompt', 'moderate_length', 'long_prompt'][band + 1], CASE WHEN hard THEN 'reasoning_markers' END, CASE WHEN code AND lines > 30 THEN 'large_code_block' WHEN code THEN 'code_present' END, CASE WHEN asks >= 3 AND lifted < 2 THEN 'multi_part_question' END], lambda x: x IS NOT NULL) AS reasons FROM l""")
def complexity_inspector(spark, sf_dir):
    more = F.when(F.col("request_id") % 4 == 0, " explain why").when(F.col("request_id") % 4 == 1, " import x").when(F.col("request_id") % 4 == 2, "? so? really?").otherwise("")
    return request_text(spark, sf_dir).select("request_id", H.complexity(F.concat("text", more)).alias("c")).select("request_id", "c.*")


_THINK = " OR ".join(f"contains(t, '{m}')" for m in ("think", "step by step", "analyze", "explain why", "evaluate", "compare"))
_STEPS = " + ".join(f"CAST(contains(t, '{m}') AS INT)" for m in ("first", "then", "finally", "1.", "2.", "3."))
_TIERS = f"""WITH {MSG}, u AS (SELECT request_id, message_index, content || CASE message_index % 3 WHEN 0 THEN ' think' WHEN 1 THEN ' first this, then that' ELSE '' END AS c FROM messages WHERE role = 'user'),
  f AS (SELECT *, lower(c) AS t FROM u), g AS (SELECT request_id, sum(length(c)) / 4 AS n, bool_or(contains(c, '```')) AS code, bool_or({_THINK}) AS thinks, bool_or({_STEPS} >= 2) AS steps FROM f GROUP BY request_id),
  tiers AS (SELECT request_id, CASE WHEN n > 1000 OR code OR (thinks AND steps) THEN 'high' WHEN n > 250 OR thinks OR steps THEN 'medium' ELSE 'low' END AS tier FROM g)"""


def _tiers(spark, sf_dir):
    more = F.when(F.col("message_index") % 3 == 0, " think").when(F.col("message_index") % 3 == 1, " first this, then that").otherwise("")
    texts = B.messages(spark, sf_dir).where("role = 'user'").groupBy("request_id").agg(F.collect_list(F.concat("content", more)).alias("texts"))
    return texts.select("request_id", H.complexity_by_tokens(F.col("texts")).alias("tier"))


@query("complexity_gateway", f"{_TIERS} SELECT * FROM tiers")
def complexity_gateway(spark, sf_dir):
    return _tiers(spark, sf_dir)


@query("token_estimate", f"WITH {MSG} SELECT request_id, CAST(sum(ceil(length(content) / 4)) AS BIGINT) AS tokens FROM messages GROUP BY request_id")
def token_estimate(spark, sf_dir):
    return B.messages(spark, sf_dir).groupBy("request_id").agg(F.sum(H.tokens(F.col("content"))).alias("tokens"))


PRICES = [("model-1", 0.5, 1.5), ("model-1-mini", 0.1, 0.3), ("model-2", 2.5, 10.0), ("other", 1.0, 4.0)]
PRICES_SQL = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in PRICES) + ") AS t(m, price_in, price_out))"
NAMES_SQL = "names AS (SELECT event_id, input, output, CASE event_id % 5 WHEN 0 THEN 'model-1' WHEN 1 THEN 'model-1-mini-2024' WHEN 2 THEN 'model-2-large' WHEN 3 THEN 'unknown' ELSE 'model-1-x' END AS model FROM (SELECT event_id, event_id % 900 AS input, event_id % 300 AS output FROM events))"


def _priced(spark, sf_dir):
    n = F.col("event_id")
    rows = B.table(spark, sf_dir, "events").select("event_id", F.when(n % 5 == 0, "model-1").when(n % 5 == 1, "model-1-mini-2024").when(n % 5 == 2, "model-2-large").when(n % 5 == 3, "unknown").otherwise("model-1-x").alias("model"), (n % 900).alias("input"), (n % 300).alias("output"))
    return H.longest_prefix(rows, "model", spark.createDataFrame(PRICES, "model string, price_in double, price_out double"))


_PRICED = f"WITH {PRICES_SQL}, {NAMES_SQL}, best AS (SELECT model, arg_max(m, length(m)) AS matched, arg_max(price_in, length(m)) AS price_in, arg_max(price_out, length(m)) AS price_out FROM (SELECT DISTINCT model FROM names) JOIN prices ON starts_with(model, m) GROUP BY model)"


@query("price_lookup", f"{_PRICED} SELECT event_id, model, matched FROM names LEFT JOIN best USING (model)")
def price_lookup(spark, sf_dir):
    return _priced(spark, sf_dir).select("event_id", "model", "matched")


@query("model_cost", f"{_PRICED} SELECT event_id, round((input * price_in + output * price_out) / 1000000, 8) AS usd FROM names LEFT JOIN best USING (model)")
def model_cost(spark, sf_dir):
    return _priced(spark, sf_dir).select("event_id", F.round((F.col("input") * F.col("price_in") + F.col("output") * F.col("price_out")) / 1000000, 8).alias("usd"))


@query("gateway_cost", f"{_PRICED} SELECT event_id, coalesce((input * price_in + output * price_out) / 1000, 0) AS usd FROM names LEFT JOIN best USING (model)")
def gateway_cost(spark, sf_dir):
    return _priced(spark, sf_dir).select("event_id", F.coalesce((F.col("input") * F.col("price_in") + F.col("output") * F.col("price_out")) / 1000, F.lit(0.0)).alias("usd"))


ROUTES = [("low", "beta", "model-1-mini", ["alpha", "beta"]), ("medium", "alpha", "model-1", ["beta"]), ("high", "alpha", "model-2", ["gamma", "beta", "alpha"])]


@query("route_lookup", f"{_TIERS}, routes AS (SELECT * FROM (VALUES ('low', 'beta', 'model-1-mini', ['beta', 'alpha']), ('medium', 'alpha', 'model-1', ['alpha', 'beta']), ('high', 'alpha', 'model-2', ['alpha', 'gamma', 'beta'])) AS t(tier, provider, model, chain)) SELECT request_id, provider, model, chain FROM tiers JOIN routes USING (tier)")
def route_lookup(spark, sf_dir):
    routes = spark.createDataFrame(ROUTES, "tier string, provider string, model string, failover array<string>")
    return _tiers(spark, sf_dir).join(F.broadcast(routes), "tier").select("request_id", "provider", "model", F.array_distinct(F.concat(F.array("provider"), "failover")).alias("chain"))


_COS = "round(list_sum(list_transform(range(1, len(p.embedding) + 1), lambda i: CAST(p.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(p.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6)"
_KNN = f"SELECT * FROM (SELECT probe_id, entry_id, similarity, row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, entry_id) AS rank FROM (SELECT -1 - p.vec_id AS probe_id, e.vec_id AS entry_id, {_COS} AS similarity FROM embeddings p JOIN embeddings e ON p.label = e.label WHERE p.vec_id % 20 = 0)"


def _knn(spark, sf_dir, threshold, k):
    """Vectors whose id divides by 20 asked against all of their tenant, themselves included: the nearest must be the vector itself."""
    v = B.table(spark, sf_dir, "embeddings")
    probes = v.where("vec_id % 20 = 0").select((-1 - F.col("vec_id")).alias("probe_id"), F.col("label").alias("tenant"), "embedding")
    entries = v.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("tenant"), "embedding")
    return K.nearest(probes, entries, threshold, k)


@query("semantic_cache_lookup", f"{_KNN} WHERE similarity >= 0.92) WHERE rank = 1")
def semantic_cache_lookup(spark, sf_dir):
    return _knn(spark, sf_dir, 0.92, 1)


@query("semantic_cache_guards", "SELECT -1 - vec_id AS probe_id, vec_id AS entry_id FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 3 = 0")
def semantic_cache_guards(spark, sf_dir):
    """As the look-up, with guards that differ for two probes of three: these hit nothing."""
    v = B.table(spark, sf_dir, "embeddings").where("embedding is not null")
    guard = F.col("vec_id") % 3
    probes = v.where("vec_id % 20 = 0").select((-1 - F.col("vec_id")).alias("probe_id"), F.col("label").alias("tenant"), "embedding", F.lit(0).cast("long").alias("guards"))
    entries = v.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("tenant"), "embedding", F.when(guard == 0, 0).otherwise(F.col("vec_id") + 1).cast("long").alias("guards"))
    return K.nearest(probes, entries, 0.999999, 1).select("probe_id", "entry_id")


@query("evidence_topk", f"{_KNN}) WHERE rank <= 3")
def evidence_topk(spark, sf_dir):
    return _knn(spark, sf_dir, -1.0, 3)


@query("claim_split")
def claim_split(spark, sf_dir):
    return B.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(H.claims(F.col("text"))).alias("claim_id", "claim"))


_V = "v AS (SELECT req, claim, e, c FROM (SELECT l_orderkey AS req, l_linenumber % 3 AS claim, l_partkey % 100 / 100 AS e, l_suppkey % 100 / 100 AS c, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_partkey % 100 / 100 DESC, l_suppkey % 100 / 100 DESC) AS k FROM lineitem) WHERE k = 1)"


@query("grounding_aggregate", f"WITH {_V}, n AS (SELECT req AS request_id, count(*) AS n_claims, count(*) FILTER (WHERE e >= 0.5 AND e >= c) AS supported, count(*) FILTER (WHERE NOT (e >= 0.5 AND e >= c) AND c >= 0.5 AND c > e) AS contradicted FROM v GROUP BY req) SELECT *, round(supported / n_claims, 4) AS score, CASE WHEN round(supported / n_claims, 4) >= 0.75 THEN 'grounded' WHEN round(supported / n_claims, 4) >= 0.5 THEN 'partial' ELSE 'ungrounded' END AS status FROM n")
def grounding_aggregate(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem")
    return H.verdicts(line.select(F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") % 3).alias("claim_id"), (F.col("l_partkey") % 100 / 100).alias("entailment"), (F.col("l_suppkey") % 100 / 100).alias("contradiction")))
