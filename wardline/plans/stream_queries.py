"""Queries over events as streams, line sources, fairness tallies and code findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import gateway as G
from wardline.operators import metrics as M
from wardline.operators import outcome as O
from wardline.plans.registry import query
from wardline.sources import bridge as B
from wardline.sources import streams as T
from wardline.streaming import limits as L
from wardline.streaming import runs


def _events(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _keyed(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(F.concat(F.lit("k"), F.col("user_id") % 20).alias("key"), F.col("event_id").alias("seq"), (F.unix_micros("ts") / 60_000_000).alias("now_s"), (F.col("event_type") != "error").alias("ok"), "ts")


@query("rate_limit_replay")
def rate_limit_replay(spark, sf_dir):
    return L.replay_bucket(_keyed(spark, sf_dir), per_minute=1, burst=3)


@query("breaker_replay")
def breaker_replay(spark, sf_dir):
    """Over all partitions at once: twenty keys hold all events."""
    return runs.breaker(_keyed(spark, sf_dir))


@query("rate_limit_fixed", "SELECT key, slot, n, greatest(0, n - 30) AS rejected FROM (SELECT 'k' || (user_id % 20) AS key, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slot, count(*) AS n FROM events GROUP BY ALL)")
def rate_limit_fixed(spark, sf_dir):
    return L.fixed_window(_keyed(spark, sf_dir), 86400, 30)


@query("vault_ttl", "SELECT event_id FROM events WHERE ts + INTERVAL 300 MINUTE > TIMESTAMP '2024-01-30 12:00:00'")
def vault_ttl(spark, sf_dir):
    return _events(spark, sf_dir).where(L.alive(F.col("ts"), F.lit("2024-01-30 12:00:00").cast("timestamp"), 18000)).select("event_id")


@query("events_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return L.tumbling(_events(spark, sf_dir), "1 day", "event_type").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("events_sessions", "WITH m AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR > ts THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM m) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begin, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid")
def events_sessions(spark, sf_dir):
    return L.sessions(_events(spark, sf_dir), "user_id", "12 hours")


@query("failover_telemetry", "SELECT key, n, first_ok, first_ok IS NULL OR first_ok > 1 AS primary_failed, first_ok > 1 AS failover_used FROM (SELECT key, count(*) AS n, min(CASE WHEN ok THEN k END) AS first_ok FROM (SELECT user_id AS key, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 3 GROUP BY key)")
def failover_telemetry(spark, sf_dir):
    tries = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.slice(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_type") != "error").alias("ok")))), 1, 3).alias("t"))
    place = F.array_position(F.transform("t", lambda x: x["ok"]), True)
    first = F.when(place > 0, place)
    return tries.select("key", F.size("t").alias("n"), first.alias("first_ok"), (first.isNull() | (first > 1)).alias("primary_failed"), (first > 1).alias("failover_used"))


_LINES = "SELECT user_id AS request_id, event_id AS seq, CASE WHEN event_id % 4 = 3 THEN '' WHEN event_id % 4 = 0 THEN 'event: ' || event_type ELSE 'data: ' || value END AS line FROM events"


def _lines(spark, sf_dir):
    n = F.col("event_id")
    line = F.when(n % 4 == 3, "").when(n % 4 == 0, F.concat(F.lit("event: "), "event_type")).otherwise(F.concat(F.lit("data: "), F.col("value").cast("string")))
    return B.table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), n.alias("seq"), line.alias("line"))


@query("sse_frames", f"WITH l AS ({_LINES}), f AS (SELECT *, count(*) FILTER (WHERE line = '') OVER (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frame FROM l) SELECT request_id, frame, coalesce(arg_max(substr(line, 8), seq) FILTER (WHERE starts_with(line, 'event')), 'message') AS event, coalesce(string_agg(substr(line, 7), chr(10) ORDER BY seq) FILTER (WHERE starts_with(line, 'data')), '') AS data FROM f WHERE line <> '' GROUP BY request_id, frame")
def sse_frames(spark, sf_dir):
    return T.sse_frames(_lines(spark, sf_dir))


@query("provider_stream_text", "SELECT user_id AS request_id, string_agg(event_type, '' ORDER BY event_id) AS text, count(*) AS n_chunks FROM events WHERE event_id % 7 > 1 GROUP BY user_id")
def provider_stream_text(spark, sf_dir):
    n = F.col("event_id")
    line = F.when(n % 7 == 0, "data: [DONE]").when(n % 7 == 1, "data: {broken").otherwise(F.concat(F.lit('data: {"delta": "'), "event_type", F.lit('"}')))
    return T.chunk_text(B.table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), n.alias("seq"), line.alias("line")))


@query("ingest_chat_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'invalid' ELSE 'ok' END AS status, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS n_messages, CASE WHEN event_id % 3 > 0 THEN 'm' END AS model FROM events")
def ingest_chat_json(spark, sf_dir):
    one = '{"role": "user", "content": "x"}'
    n = F.col("event_id")
    body = F.when(n % 3 == 0, "{not json").when(n % 3 == 1, f'{{"model": "m", "messages": [{one}]}}').otherwise(f'{{"model": "m", "messages": [{one}, {one}]}}')
    return T.chat_bodies(B.table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body").drop("body")


@query("reference_docs", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN [n_name, 'x'] END AS docs FROM nation")
def reference_docs(spark, sf_dir):
    header = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('["'), "n_name", F.lit('", "x"]'))).otherwise("no list")
    return B.table(spark, sf_dir, "nation").select("n_nationkey", T.reference_docs(header).alias("docs"))


@query("diff_added_lines", "WITH o AS (SELECT o_orderkey AS k, o_orderkey % 50 AS a, o_orderkey % 7 AS b FROM orders) SELECT 'one' || k || '.py' AS path, CAST(a + 2 AS INT) AS line FROM o UNION ALL SELECT 'one' || k || '.py', CAST(a + 4 AS INT) FROM o UNION ALL SELECT 'one' || k || '.py', CAST(a + 60 + b AS INT) FROM o UNION ALL SELECT 'two' || k || '.py', 1 FROM o WHERE b > 2")
def diff_added_lines(spark, sf_dir):
    """A diff for each order: two hunks of one file, and for most orders a new file."""
    k = F.col("o_orderkey")
    a, b = k % 50, k % 7
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    one = [text("--- a/one", k, ".py"), text("+++ b/one", k, ".py"), text("@@ -1,3 +", a + 1, ",4 @@"), F.lit(" keep"), F.lit("+new"), F.lit(" keep"), F.lit("-old"), F.lit("+other"), text("@@ -20,2 +", a + b + 60, ",2 @@"), F.lit("-x"), F.lit("+y"), F.lit(" z")]
    two = [text("--- a/two", k, ".py"), text("+++ b/two", k, ".py"), F.lit("@@ -0,0 +1,1 @@"), F.lit("+a")]
    lines = F.concat(F.array(*one), F.when(b > 2, F.array(*two)).otherwise(F.array().cast("array<string>")))
    diffs = B.table(spark, sf_dir, "orders").select(k.alias("diff_id"), F.posexplode(lines).alias("seq", "line"))
    return T.added_lines(diffs)


# findings in code: baselines and failing ones


def _code(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("f"), F.col("l_orderkey") % 50).alias("path"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("category"), (F.col("l_partkey") % 1000).alias("fingerprint"), (F.col("l_suppkey") % 3).alias("severity"))


_CODE = "code AS (SELECT 'f' || (l_orderkey % 50) AS path, l_linenumber AS line, l_returnflag AS category, l_partkey % 1000 AS fingerprint, l_suppkey % 3 AS severity FROM lineitem)"


@query("baseline_suppress", f"WITH {_CODE} SELECT path, count(*) AS n FROM code WHERE fingerprint NOT IN (SELECT p_partkey FROM part WHERE p_size < 20) GROUP BY path")
def baseline_suppress(spark, sf_dir):
    known = B.table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("fingerprint"))
    return _code(spark, sf_dir).join(known, "fingerprint", "left_anti").groupBy("path").agg(F.count("*").alias("n"))


@query("diff_only_findings", f"WITH {_CODE} SELECT path, line, count(*) AS n FROM code WHERE (path, line) IN (SELECT ('f' || (n_nationkey % 50), n_regionkey) FROM nation) GROUP BY path, line")
def diff_only_findings(spark, sf_dir):
    added = B.table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey") % 50).alias("path"), F.col("n_regionkey").alias("line"))
    return _code(spark, sf_dir).join(added, ["path", "line"], "left_semi").groupBy("path", "line").agg(F.count("*").alias("n"))


@query("failing_findings", f"WITH {_CODE} SELECT path, count(*) FILTER (WHERE category = 'R' AND severity >= 1) AS n, bool_or(category = 'R' AND severity >= 1) AS fails FROM code GROUP BY path")
def failing_findings(spark, sf_dir):
    bad = (F.col("category") == "R") & (F.col("severity") >= 1)
    return _code(spark, sf_dir).groupBy("path").agg(M.count_if(bad).alias("n"), F.bool_or(bad).alias("fails"))


# stages and codes


def _stages(spark, sf_dir):
    n = F.col("event_id")
    status = lambda k: F.when(n % k == 0, "blocked").when(n % (k + 1) == 0, "odd").otherwise("ok")
    return B.table(spark, sf_dir, "events").select("event_id", F.array(*[F.struct(F.lit(f"s{k}").alias("stage"), status(k).alias("status"), F.when(n % k > 1, (n % k).cast("string")).otherwise("?").alias("ms")) for k in (5, 7, 3)]).alias("stages"))


@query("first_blocked_stage", "SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 3 ELSE 0 END AS BIGINT) AS place FROM events")
def first_blocked_stage(spark, sf_dir):
    return _stages(spark, sf_dir).select("event_id", F.array_position(F.transform("stages", lambda s: s["status"]), "blocked").alias("place"))


@query("safe_stages", "SELECT event_id, unnest([CASE WHEN event_id % k = 0 THEN 'blocked' WHEN event_id % (k + 1) = 0 THEN 'skipped' ELSE 'ok' END]) AS status, CASE WHEN event_id % k > 1 THEN CAST(event_id % k AS DOUBLE) END AS ms FROM events, (VALUES (5), (7), (3)) AS t(k)")
def safe_stages(spark, sf_dir):
    known = F.transform("stages", lambda s: F.struct(F.when(s["status"].isin("ok", "blocked", "skipped"), s["status"]).otherwise("skipped").alias("status"), s["ms"].try_cast("double").alias("ms")))
    return _stages(spark, sf_dir).select("event_id", F.explode(known).alias("s")).select("event_id", "s.*")


@query("error_codes", f"WITH {B.AUDIT_SQL} SELECT request_id, CASE WHEN policy_action = 'BLOCK' THEN CASE request_id % 5 WHEN 0 THEN block_code WHEN 1 THEN 'PII_LEAK_PREVENTED' ELSE CASE WHEN secret_count > 0 THEN 'CREDENTIAL_LEAK_PREVENTED' WHEN cache_hit THEN 'PROMPT_INJECTION_BLOCKED' WHEN pii_count > 0 THEN 'PII_LEAK_PREVENTED' ELSE 'POLICY_VIOLATION' END END END AS error_code FROM audit")
def error_codes(spark, sf_dir):
    n = F.col("request_id") % 5
    code = F.when(n == 0, F.col("block_code")).when(n == 1, "PII_SOMETHING").otherwise("OTHER")
    return B.audit(spark, sf_dir).select("request_id", G.error_code(F.lower("policy_action"), F.coalesce(code, F.lit("")), F.col("secret_count"), F.col("cache_hit"), F.col("pii_count")).alias("error_code"))


@query("cache_admission", f"WITH {B.AUDIT_SQL} SELECT request_id FROM audit WHERE policy_action NOT IN ('WARN', 'BLOCK') AND secret_count = 0 AND NOT cache_hit")
def cache_admission(spark, sf_dir):
    return B.audit(spark, sf_dir).where("policy_action not in ('WARN', 'BLOCK') and secret_count = 0 and not cache_hit").select("request_id")


# fairness


def _scores(spark, sf_dir):
    docs, labels = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("lang").alias("grp"), (F.col("toxic") == 1).alias("truth"), F.lower("text").rlike("idiot|scum|moron|trash").alias("hit"))


_SCORES = "scores AS (SELECT lang AS grp, toxic = 1 AS truth, regexp_matches(lower(text), 'idiot|scum|moron|trash') AS hit FROM documents JOIN labels USING (doc_id))"
_TALLY = f"{_SCORES}, tally AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE truth AND hit) AS hits, count(*) FILTER (WHERE NOT truth AND hit) AS false_positives, count(*) FILTER (WHERE truth) AS positives FROM scores GROUP BY grp)"


def _tally(spark, sf_dir):
    t, h = F.col("truth"), F.col("hit")
    return _scores(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), M.count_if(t & h).alias("hits"), M.count_if(~t & h).alias("false_positives"), M.count_if(t).alias("positives"))


@query("fairness_tallies", f"WITH {_TALLY} SELECT grp, n, hits, false_positives, round(hits / nullif(positives, 0), 4) AS recall, CASE WHEN hits + false_positives > 0 THEN round(hits / (hits + false_positives), 4) END AS prec FROM tally")
def fairness_tallies(spark, sf_dir):
    found = F.col("hits") + F.col("false_positives")
    return _tally(spark, sf_dir).select("grp", "n", "hits", "false_positives", F.round(F.try_divide("hits", "positives"), 4).alias("recall"), F.round(F.try_divide(F.col("hits"), found), 4).alias("prec"))


@query("fairness_gap", f"WITH {_TALLY} SELECT round(max(hits / nullif(positives, 0)) - min(hits / nullif(positives, 0)), 4) AS gap, arg_max(grp, hits / nullif(positives, 0)) AS best FROM tally")
def fairness_gap(spark, sf_dir):
    r = F.try_divide("hits", "positives")
    return _tally(spark, sf_dir).agg(F.round(F.max(r) - F.min(r), 4).alias("gap"), F.max_by("grp", r).alias("best"))


@query("fairness_corpus", "SELECT n_name AS name, r_name AS grp, replace(t, '{name}', n_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('Call {name} back'), ('{name} wrote')) AS v(t)")
def fairness_corpus(spark, sf_dir):
    names = B.table(spark, sf_dir, "nation").join(F.broadcast(B.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    template = F.explode(F.array(F.lit("Call {name} back"), F.lit("{name} wrote"))).alias("t")
    return names.select("n_name", "r_name", template).select(F.col("n_name").alias("name"), F.col("r_name").alias("grp"), F.replace("t", F.lit("{name}"), F.col("n_name")).alias("text"))


@query("stream_reassembly", "SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def stream_reassembly(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return B.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(parts, "").alias("text"))


@query("final_answer", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'withheld' WHEN event_type = 'signup' AND event_id % 7 > 0 THEN 'to u' || user_id WHEN event_id % 7 = 0 THEN 'to <SECRET_KEY_1>' ELSE 'to <EMAIL_1>' END AS answer FROM events")
def final_answer(spark, sf_dir):
    """Answers rehydrated where they were sanitised, replaced where a check says so; a vault that holds a secret gives nothing back."""
    n = F.col("event_id")
    holder = F.when(n % 7 == 0, "<SECRET_KEY_1>").otherwise("<EMAIL_1>")
    answer = O.final_answer(F.when(n % 6 == 0, "REPLACE").otherwise("PASS"), F.concat(F.lit("to "), holder), F.lit("withheld"), F.create_map(holder, F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.when(F.col("event_type") == "signup", "sanitize").otherwise("allow"))
    return B.table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
