"""The whole inspection of chat requests: findings, decision, redacted text, routing and cache hints in one row each."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import fixed as X
from wardline.operators import detect as D
from wardline.operators import gazetteer as Z
from wardline.operators import hints as H
from wardline.operators import injection as I
from wardline.operators import policy as P
from wardline.operators import spans as S

KEY = ["request_id", "message_index"]
ASKED = ("user", "tool")

#: first names and surnames of the gazetteer; a caller's own lists, of any length, are a parameter
FIRST = frozenset("Anna Arjun Arun Carlos Elena Fatima Hans Ivan Julia Kavita Kenji Lakshmi Maria Meera Omar Priya Rahul Rohan Sanjay Sofia Sunita Vikram Wei".split())
LAST = frozenset("Garcia Gupta Hansen Iyer Kapoor Kim Kumar Lopez Mehta Mueller Nair Nguyen Patel Ramaswamy Rao Reddy Sharma Silva Singh Tanaka Weber".split())


def name_spans(text: Column, first: frozenset[str] = FIRST, last: frozenset[str] = LAST) -> Column:
    """The array of names (as FINDING) that short lists know in a text; ``gazetteer.names`` says by which rule, and takes lists of any length."""
    firsts, lasts = (F.array(*[F.lit(n) for n in sorted(x)]) for x in (first, last))
    heads = "".join(sorted({re.escape(n[0]) for n in first | last if n}))
    any_name = (rf"(?=[{heads}])\b(?:" if heads else r"\b(?:") + "|".join(sorted(first | last)) + r")\b"

    def of(m: Column) -> Column:
        words = F.split(m["value"], r"\s+")
        known = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("pos"), F.array_contains(firsts, w).alias("is_first"), F.array_contains(lasts, w).alias("is_last"))), lambda k: k["is_first"] | k["is_last"])
        cue = F.lower(F.regexp_extract(F.substr(text, F.lit(1), m["start"]), r"([A-Za-z]+)[\s:,]+$", 1))

        def told(w: Column) -> Column:
            lead, score, recogniser = Z.judged({"words": w["words"], "cue": w["cue"]}, w["known"])
            return S.let(
                F.struct(lead.alias("lead"), score.alias("score"), recogniser.alias("recogniser")),
                lambda j: S.let(
                    F.when(j["lead"] > 0, F.length(m["value"]) - F.length(F.regexp_replace(m["value"], F.concat(F.lit(r"^(?:\S+\s+){"), j["lead"].cast("string"), F.lit("}")), F.lit("")))).otherwise(F.lit(0)),
                    lambda cut: F.when(j["score"].isNotNull(), F.struct((m["start"] + cut).alias("start"), m["end"].alias("end"), F.substr(m["value"], cut + 1).alias("value"), F.lit("PERSON").alias("type"), F.lit("PII").alias("category"), j["recogniser"].alias("recognizer"), j["score"].cast("double").alias("confidence"))),
                ),
            )

        return S.let(F.struct(words.alias("words"), cue.alias("cue"), known.alias("known")), told)

    runs = F.filter(S.find_all(text, Z.RUN), lambda m: m["value"].rlike(any_name))
    return F.when(text.rlike(any_name), F.array_compact(F.transform(runs, of))).otherwise(F.array().cast(f"array<{S.FINDING}>"))


#: how sure a finding of a type that is on must be
LEAST = {kind: float(at) for kind, (_, at, on, _) in X.ENTITIES.items() if on}
#: the personal rules that can ever be sure enough
LIKELY = tuple(r for r in D.PERSONAL if r.sure or r.nudged or r.confidence >= LEAST.get(r.type, 2.0))


@functools.cache
def _steps(_: str, first: frozenset[str], last: frozenset[str]) -> tuple[tuple[Column, ...], ...]:
    """The columns of each step of detection: large expressions, built once an application. None of them is within a lambda, so they are compiled."""
    text = F.col("content")
    return (
        (S.held(D.tried(text, D.SECRETS)).alias("__s"), S.held(D.tried(text, LIKELY)).alias("__p"), S.held(name_spans(text, first, last)).alias("__n")),
        (S.held(D.matches(text, F.col("__s"), D.SECRETS, (2, 1))).alias("__s"), S.held(D.matches(text, F.col("__p"), LIKELY, least=LEAST)).alias("__p"), F.col("__n")),
    )


@functools.cache
def _found(_: str) -> Column:
    """What is left of a text's secrets, personal findings and names (columns of ``_steps``)."""
    none = F.array().cast(f"array<{S.FINDING}>")
    sure = F.when(F.size("__n") > 0, F.concat(F.col("__p"), F.filter("__n", lambda x: x["confidence"] >= LEAST.get("PERSON", math.inf)))).otherwise(F.col("__p"))
    personal = F.when((F.size("__p") > 0) | (F.size("__n") > 0), S.resolved(sure)).otherwise(none)
    secret = S.resolved(F.col("__s"))

    def mixed(x: Column) -> Column:
        free = F.filter(x["p"], lambda p: ~F.exists(x["s"], lambda s: (s["start"] <= p["start"]) & (p["end"] <= s["end"])))
        # what is disjoint stays so, and only where both kinds are left is there more to resolve
        return S.let(free, lambda p: F.when(F.size(p) == 0, x["s"]).otherwise(S.resolved(F.concat(x["s"], p))))

    return F.when(F.coalesce(F.size("__s"), F.lit(0)) <= 0, personal).when((F.size("__p") > 0) | (F.size("__n") > 0), S.let(F.struct(secret.alias("s"), personal.alias("p")), mixed)).otherwise(secret)


def with_findings(messages: DataFrame, first: frozenset[str] = FIRST, last: frozenset[str] = LAST) -> DataFrame:
    """Messages with ``found``, the array of their findings, worked out in the row: nothing is shuffled.

    Secrets before personal data: each kind made disjoint, personal findings inside a secret gone, and the rest made disjoint again.
    Personal findings are those of patterns and of the name lists whose type is on and that are sure enough.
    """
    own, app = messages.columns, messages.sparkSession.sparkContext.applicationId
    for step in _steps(app, first, last):
        messages = messages.select(*own, *step)
    return messages.select(*own, S.held(_found(app)).alias("found"))


def resolved_findings(messages: DataFrame, first: frozenset[str] = FIRST, last: frozenset[str] = LAST) -> DataFrame:
    """One row per finding of ``with_findings``."""
    return S.exploded(with_findings(messages, first, last), KEY, F.col("found"))


RULED = "struct<start:int,end:int,value:string,type:string,category:string,recognizer:string,confidence:double,rule:string,action:string,priority:int,appealable:boolean,label:string>"
SPELLED = 4


def ruled(found: Column, rules: list[tuple[str, str, int, bool]]) -> Column:
    """The findings with the rule, action, priority and appealability of their key (pii.TYPE or secret.TYPE, else without its last segments); allowed where no rule speaks."""
    kind = "struct<rule:string,action:string,priority:int,appealable:boolean>"
    of_rule = lambda r: F.struct(*map(F.lit, r)).cast(kind)
    table = F.create_map(*[x for r in rules for x in (F.lit(r[0]), of_rule(r))]) if rules else F.create_map().cast(f"map<string,{kind}>")
    label = F.create_map(*[F.lit(x) for t, (name, *_) in X.ENTITIES.items() for x in (t, name)])
    # the types that the detectors know are looked up once, with what is to be known of them
    by_key, known = {r[0]: r for r in rules}, []
    for key in dict.fromkeys(("secret." if r.category == "SECRET" else "pii.") + r.type for r in (*D.PERSONAL, *D.SECRETS)):
        top, _, kept = key.partition(".")
        r = by_key.get(key, by_key.get(top, (None,) * 4))
        shown = f"SECRET_{kept}" if top == "secret" else X.ENTITIES.get(kept, (kept,))[0]
        known += [F.lit(key), F.struct(of_rule(r).alias("hit"), F.lit(shown).alias("label"))]
    known = F.create_map(*known)

    def of(x: Column, spelled: bool = False) -> Column:
        secret = x["category"] == "SECRET"

        def sought(key: Column) -> Column:
            hit = F.coalesce(*[F.element_at(table, F.substring_index(key, ".", n)) for n in (4, 3, 2, 1)])
            named = F.when(secret, F.concat(F.lit("SECRET_"), x["type"])).otherwise(F.coalesce(F.element_at(label, x["type"]), x["type"]))
            return F.coalesce(F.element_at(known, key), F.struct(hit.alias("hit"), named.alias("label")))

        def told(k: Column) -> Column:
            h = k["hit"]
            return F.struct(*[x[c].alias(c) for c in ("start", "end", "value", "type", "category", "recognizer", "confidence")], h["rule"].alias("rule"), F.coalesce(h["action"], F.lit("allow")).alias("action"), h["priority"].alias("priority"), h["appealable"].alias("appealable"), k["label"].alias("label"))

        key = F.concat(F.when(secret, "secret.").otherwise("pii."), x["type"])
        return told(sought(key)) if spelled else S.let(S.let(key, sought), told)

    # a few findings are spelled out, without a lambda, as compiled code
    none = F.array().cast(f"array<{RULED}>")
    few = F.concat(none, *[F.when(F.size(found) > j, F.array(of(F.get(found, F.lit(j)), True))).otherwise(none) for j in range(SPELLED)])
    return F.when(F.size(found).between(0, SPELLED), few).otherwise(F.transform(found, lambda x: of(x)))


def numbered(messages: DataFrame) -> DataFrame:
    """Messages with ``placeholders``, one for each of their ``found`` (null where nothing is to be hidden): LABEL_n, n counting the different values of a label in a request in order of first place.

    Requests are dealt by id and their messages come in order, so a task holds the values of one request that it has met, never its
    messages. Only what is sanitised or blocks is numbered.
    """
    hidden = F.transform("found", lambda x: F.when(x["action"].isin("sanitize", "block"), F.concat(x["label"], F.lit("\0"), x["value"])))
    dealt = messages.repartition("request_id").sortWithinPartitions("request_id", "message_index")

    def task(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        now, seen, count = None, {}, {}
        for requests, values in batches:
            out = []
            for r, spans in zip(requests.to_pylist(), values.to_pylist(), strict=True):
                if r != now:
                    now, seen, count = r, {}, {}
                row = []
                for x in spans or ():
                    if x is not None and x not in seen:
                        label = x.partition("\0")[0]
                        count[label] = count.get(label, 0) + 1
                        seen[x] = f"<{label}_{count[label]}>"
                    row.append(None if x is None else seen[x])
                out.append(row)
            yield pa.array(out, pa.list_(pa.string()))

    # it counts in the order of its rows, which the optimizer must not take for a column's own affair
    number = F.arrow_udf(task, T.ArrayType(T.StringType())).asNondeterministic()
    return dealt.withColumn("placeholders", number(F.col("request_id"), hidden))


def redacted(messages: DataFrame, rules: DataFrame, first: frozenset[str] = FIRST, last: frozenset[str] = LAST) -> DataFrame:
    """Messages with ``found`` (RULED), ``placeholders``, ``clean`` (what is to be sanitised replaced) and ``n_replaced``: one scan, one shuffle.

    rules: key, action, priority, appealable; a policy's rules, which become one map.
    """
    table = [(r["key"], r["action"], r["priority"], r["appealable"]) for r in rules.select("key", "action", "priority", "appealable").collect()]
    rows = with_findings(messages, first, last)
    rows = numbered(rows.withColumn("found", ruled(F.col("found"), table)))
    pairs = F.zip_with("found", "placeholders", lambda x, p: F.when((x["action"] == "sanitize") & p.isNotNull(), F.struct(x["start"].alias("start"), x["end"].alias("end"), p.alias("placeholder"))))
    rows = rows.withColumn("__spans", F.array_compact(pairs))
    return rows.withColumn("clean", S.splice(F.col("content"), F.col("__spans"))).withColumn("n_replaced", F.size("__spans")).drop("__spans")


def actioned(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with the rule, action, priority and appealability of their key (pii.TYPE or secret.TYPE); allowed where no rule speaks."""
    keyed = found.withColumn("rule_key", F.concat(F.when(F.col("category") == "SECRET", "secret.").otherwise("pii."), "type"))
    ruled = P.resolve(keyed.select(F.col("rule_key").alias("key")).distinct(), rules).withColumnRenamed("key", "rule_key")
    return keyed.join(F.broadcast(ruled), "rule_key", "left").withColumn("action", F.coalesce("action", F.lit("allow")))


def redact(messages: DataFrame, found: DataFrame, extra: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages with what is to be sanitised replaced, findings with placeholders) by the findings' action.

    Findings that are sanitised or block are numbered, and belong in the vault;
    only sanitised ones are replaced; the others keep their place and get no
    placeholder. Findings whose span does not fit their message are left out.
    """
    sized = found.join(messages.select(*KEY, F.length("content").alias("__n")), KEY).where("start >= 0 and start < end and end <= __n").drop("__n")
    label = F.when(F.col("category") == "SECRET", F.concat(F.lit("SECRET_"), "type"))
    for kind, (name, *_) in X.ENTITIES.items():
        label = label.when(F.col("type") == kind, name)
    sized = sized.withColumn("label", F.coalesce(label, F.col("type")))
    held = S.number_placeholders(sized.where("action in ('sanitize', 'block')"), "request_id", "message_index", "label")
    marked = held.unionByName(sized.where("action not in ('sanitize', 'block')").withColumn("placeholder", F.lit(None).cast("string")))
    spans = held.where("action = 'sanitize'").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("spans"))
    clean = messages.join(spans, KEY, "left").withColumn("content", S.splice(F.col("content"), F.col("spans"))).withColumn("n_replaced", F.coalesce(F.size("spans"), F.lit(0))).drop("spans")
    return clean, marked.drop("label")


def inspect(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per request: decision, counts, redacted texts, vault, injection score, complexity, cache hint, stages.

    messages: request_id, message_index, role, content. A blocked request's texts come back as they were. The vault holds
    personal values only. Everything about a message is worked out in its row; one shuffle numbers placeholders, one brings
    a request's messages together. Null contents are empty.
    """
    messages = messages.select("request_id", "message_index", "role", F.coalesce("content", F.lit("")).alias("content"))
    rows = redacted(messages, rules)
    secret = lambda x: x["category"] == "SECRET"
    touches = lambda m, x: ((m["start"] >= x["start"]) & (m["start"] < x["end"])) | ((m["end"] > x["start"]) & (m["end"] <= x["end"]))
    # a finding explains the token that it is in: the mail address is personal data, whatever its entropy
    odd = D.odd_tokens(F.col("content"), open_to=lambda m: ~F.exists("found", lambda x: touches(m, x) | ((m["start"] <= x["start"]) & (x["end"] <= m["end"]))))
    free = F.filter(S.find_all(F.col("content"), CAPITAL), lambda m: ~F.exists("found", lambda x: (x["start"] <= m["start"]) & (m["start"] < x["end"])))
    words = F.slice(F.array_distinct(F.transform(free, lambda m: m["value"])), 1, X.MOST_ENTITIES)
    asked = F.col("role").isin(*ASKED)
    hidden = F.zip_with("found", "placeholders", lambda x, p: F.when((x["category"] == "PII") & p.isNotNull(), F.struct(p.alias("placeholder"), x["value"].alias("value"))))
    fired = F.transform(F.filter("found", lambda x: x["rule"].isNotNull()), lambda x: F.struct(x["rule"].alias("rule"), x["action"].alias("action"), x["priority"].alias("priority")))
    kinds = F.transform(F.filter("found", secret), lambda x: x["type"])
    told = rows.select("request_id", F.struct("message_index", "content", "clean", asked.alias("asked"), S.held(F.size(odd)).alias("n_odd"), S.held(F.when(asked, words)).alias("words"), F.array_compact(hidden).alias("hidden"), fired.alias("fired"), kinds.alias("secrets"), F.transform("found", lambda x: F.struct(x["type"].alias("type"), x["category"].alias("category"))).alias("types"), F.size("found").alias("n")).alias("m"))
    whole = told.groupBy("request_id").agg(F.array_sort(F.collect_list("m"), lambda a, b: F.when(a["message_index"] < b["message_index"], -1).when(a["message_index"] > b["message_index"], 1).otherwise(0)).alias("ms"))
    every = lambda name: F.flatten(F.transform("ms", lambda m: F.coalesce(m[name], F.array())))
    count = lambda name: F.aggregate("ms", F.lit(0), lambda s, m: s + m[name])
    requests = whole.select(
        "request_id",
        F.array_join(F.transform(F.filter("ms", lambda m: m["asked"]), lambda m: m["content"]), "\n").alias("text"),
        F.transform("ms", lambda m: m["content"]).alias("redacted"),
        F.transform("ms", lambda m: m["clean"]).alias("clean"),
        every("fired").alias("fired"),
        F.array_sort(F.array_distinct(every("secrets"))).alias("secret_types"),
        (count("n") - F.size(every("secrets"))).cast("long").alias("pii"),
        F.size(every("secrets")).cast("long").alias("secrets"),
        count("n_odd").cast("long").alias("odd"),
        F.map_from_entries(F.array_distinct(every("hidden"))).alias("vault"),
        F.array_sort(F.array_distinct(every("types"))).alias("found_types"),
        F.slice(F.array_distinct(every("words")), 1, X.MOST_ENTITIES).alias("entities"),
    )
    injected = I.findings(requests, "text", requests.columns)
    suspect = rules.select("key", "action", "priority").collect()
    of_injection = next(((r["key"], r["action"], r["priority"]) for r in suspect if r["key"] == "injection"), None)
    fired = F.col("fired")
    if of_injection:
        one = F.array(F.struct(*[F.lit(v).alias(n) for v, n in zip(of_injection, ("rule", "action", "priority"), strict=True)]).cast("struct<rule:string,action:string,priority:int>"))
        fired = F.when(F.col("detected"), F.concat(fired, one)).otherwise(fired)
    out = injected.withColumn("fired", fired)
    rank = F.array_max(F.transform("fired", lambda x: P.ranked(x["action"])))
    decision = F.coalesce(P.unranked(rank), F.lit("allow"))
    blocks = F.filter(F.transform("fired", lambda x, i: F.struct(x["priority"].alias("priority"), (-i).alias("later"), x["rule"].alias("rule"), x["action"].alias("action"))), lambda x: x["action"] == "block")
    out = out.withColumn("decision", decision).withColumn("block_rule", F.array_max(blocks)["rule"]).withColumn("rules_fired", F.when(F.size("fired") > 0, F.array_distinct(F.transform("fired", lambda x: x["rule"]))))
    decision, pii, secrets, odd = F.col("decision"), F.col("pii"), F.col("secrets"), F.col("odd")
    reason = F.when(decision == "block", "blocked").when(secrets > 0, "credential_present").when(pii > 0, "personal_data_present")
    stage = lambda name, bad, status: F.struct(F.lit(name).alias("stage"), F.when(bad, F.lit(status)).otherwise("success").alias("status"))
    stages = F.array(stage("secret_scanner", secrets > 0, "warning"), stage("entropy_scanner", odd > 0, "warning"), stage("pii_scanner", pii > 0, "warning"), stage("injection_detector", F.col("detected"), "warning"), stage("policy_engine", decision == "block", "blocked"), F.struct(F.lit("redactor").alias("stage"), F.when(decision == "block", "skipped").otherwise("success").alias("status")))
    hint = H.complexity(F.col("text"))
    found = pii + secrets > 0
    return out.select(
        "request_id",
        decision.alias("decision"),
        "block_rule",
        "rules_fired",
        pii.alias("pii_count"),
        secrets.alias("secret_count"),
        odd.alias("entropy_count"),
        F.when(found, F.col("secret_types")).alias("secret_types"),
        F.col("score").alias("injection_score"),
        "matched_rules",
        F.when(decision == "block", F.col("redacted")).otherwise(F.col("clean")).alias("redacted"),
        F.when(found, F.col("vault")).alias("vault"),
        hint["level"].alias("complexity"),
        hint["reasons"].alias("complexity_reasons"),
        reason.isNull().alias("cacheable"),
        reason.alias("not_cacheable_because"),
        F.when(reason.isNull(), F.struct(negations(F.col("text")).alias("negations"), numbers(F.col("text")).alias("numbers"), F.col("entities").alias("entities"))).alias("guards"),
        explanation(decision, F.col("block_rule"), pii, secrets).alias("explanation"),
        stages.alias("stages"),
        "found_types",
    )


def negations(text: Column) -> Column:
    """The negating words that a text holds as whole words, in the order of the list."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(rf"\b{n}\b"), F.lit(n)) for n in X.NEGATIONS]))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(X.NUMBER), F.lit(0))


def guards(text: Column) -> Column:
    """What must agree before a cached answer may be used: negations, numbers, capitalised words (the first eight)."""
    capital = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITAL), F.lit(0))), 1, X.MOST_ENTITIES)
    return F.struct(negations(text).alias("negations"), numbers(text).alias("numbers"), capital.alias("entities"))


CAPITAL = r"(?<![A-Za-z])[A-Z][a-z]{2,}"


def explanation(decision: Column, rule: Column, pii: Column, secrets: Column) -> Column:
    """A sentence or two on why a request was treated as it was."""
    parts = F.array_compact(F.array(F.when(decision == "block", F.concat(F.lit("Blocked by rule "), rule, F.lit("."))), F.when(secrets > 0, F.concat(secrets.cast("string"), F.lit(" credential(s) found."))), F.when(pii > 0, F.concat(pii.cast("string"), F.lit(" item(s) of personal data found.")))))
    return F.when(F.size(parts) == 0, "Nothing found.").otherwise(F.array_join(parts, " "))


def names(texts: DataFrame, text: str, key: list[str], first: frozenset[str] = FIRST, last: frozenset[str] = LAST) -> DataFrame:
    """One row per name that short lists know; see ``name_spans``."""
    return S.exploded(texts, key, S.held(name_spans(F.col(text), first, last)))


def hash_embedding(text: Column, dims: int = 16) -> Column:
    """A stand-in vector from SHA-256 of the text: the same text gives the same unit vector, nothing more."""
    digest = F.sha2(F.left(F.coalesce(text, F.lit("")), F.lit(8000)), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substr(F.sha2(F.concat(digest, i.cast("string")), 256), F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 31) - 1)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.round(F.try_divide(x, norm), 6))


def model_spans(texts: DataFrame, text: str, key: list[str], load_model) -> DataFrame:
    """Spans of a caller's recogniser: ``load_model()`` gives text -> [(start, end, type, score)], once per worker.

    Without a model (None) there are no rows, never made-up ones; what was not run is the caller's to report.
    """
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in key)
    schema = f"{kinds}, start int, end int, value string, type string, confidence double"
    if load_model is None:
        return texts.sparkSession.createDataFrame([], schema)

    def run(batches):
        model = load_model()
        for pdf in batches:
            rows = [(*row[:-1], s, e, row[-1][s:e], kind, float(score)) for row in pdf[[*key, text]].itertuples(index=False) for s, e, kind, score in model(row[-1] or "")]
            yield pd.DataFrame(rows, columns=[*key, "start", "end", "value", "type", "confidence"])

    return texts.select(*key, text).mapInPandas(run, schema)


def version_of(body: str) -> str:
    """A policy text's content address, for the version table."""
    return hashlib.sha256(body.encode()).hexdigest()[:16]
