"""Spans of text: finding them without a UDF, resolving overlaps, numbering placeholders, splicing.

Positions count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


CHUNK = 64


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held(value: Column) -> Column:
    """The value as it is, but worked out where it stands: the optimizer copies what depends on the partition's number into no other place.

    A random number will not do: its comparison with 0 is folded to true, and the value is free again.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def exploded(rows: DataFrame, key: list[str], array: Column) -> DataFrame:
    """The key and the fields of each struct of an array. An outer explode, as for a plain one the optimizer asks for the array's size first, and works the array out for that too."""
    return rows.select(*key, F.explode_outer(array).alias("__x")).where("__x is not null").select(*key, "__x.*")


def running(items: Column, start: Column, step, emit, kind: str) -> Column:
    """emit(state, item) for each item in order, the state going from start through step(state, item).

    Built-in folds copy what they have gathered so far at every step; here they
    gather CHUNK items at a time, so that n items cost little more than n steps.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["s"], x).alias("s"), F.array_append(acc["out"], emit(acc["s"], x)).alias("out"))

    def outer(acc: Column, chunk: Column) -> Column:
        return let(F.aggregate(chunk, F.struct(acc["s"].alias("s"), none.alias("out")), inner), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    def chunks(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda i: F.slice(a, i * CHUNK + 1, F.lit(CHUNK)))

    first = F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
    short = lambda a: F.aggregate(a, F.struct(start.alias("s"), none.alias("out")), inner)["out"]
    return let(items, lambda a: F.when(F.size(a) == 0, none).when(F.size(a) <= CHUNK, short(a)).when(F.size(a) > CHUNK, F.flatten(F.aggregate(chunks(a), first, outer)["outs"])).otherwise(none))


MATCH = "struct<start:int,end:int,value:string>"


#: a noncharacter, to stand around matches
SIGN = "\uffff"


def pairs(text: Column, pattern: str, *first: Column) -> Column:
    """array<struct<first.., gap, v>>: a pattern's matches with the length of what stands before each, since the last one; null without a match. The pattern never matches the empty string.

    One pass puts a sign around the matches and a plain split takes them apart: a split by the pattern itself
    compiles it anew for every row. Texts that hold the sign are split that way.
    """
    item = lambda gap, v: F.struct(*first, F.length(gap).alias("gap"), v.alias("v"))
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{SIGN}$0{SIGN}")), SIGN, -1)
    odd = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda k: item(F.get(p, k - 1), F.get(p, k)))
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), item)
    return F.when(F.contains(text, F.lit(SIGN)), F.filter(both, lambda x: x["v"].isNotNull())).otherwise(let(marked, lambda p: F.when(F.size(p) > 1, odd(p))))


def parts(text: Column, pattern: str) -> Column:
    """array<string>: what stands before each match and the match itself, in turn, and what is left at the end. ``pairs`` without a lambda, so it is compiled."""
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{SIGN}$0{SIGN}")), SIGN, -1)
    taken = F.flatten(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, v: F.when(v.isNull(), F.array(gap)).otherwise(F.array(gap, v))))
    return F.when(F.contains(text, F.lit(SIGN)), taken).otherwise(marked)


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches (patterns never match the empty string).

    The pieces between the matches and the matches themselves give the places
    by running sums of their lengths.
    """
    end = lambda at, x: at + x["gap"] + F.length(x["v"])
    placed = running(pairs(text, pattern), F.lit(0), end, lambda at, x: F.struct((at + x["gap"]).alias("start"), end(at, x).alias("end"), x["v"].alias("value")), MATCH)
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(f"array<{MATCH}>"))


FINDING = "struct<start:int,end:int,value:string,type:string,category:string,recognizer:string,confidence:double>"


def resolved(spans: Column) -> Column:
    """An array of findings (FINDING) reduced to disjoint ones by the rule of ``resolve``, within its row; of one or none nothing is to be done."""
    kind = f"struct<start:int,neg:int,worse:double,type:string,of:{FINDING}>"
    fields = lambda x: F.struct(x["start"].alias("start"), (x["start"] - x["end"]).alias("neg"), (-x["confidence"]).alias("worse"), x["type"].alias("type"), x.alias("of"))
    clash = lambda last, c: (c["start"] < last["of"]["end"]) & (last["start"] < c["of"]["end"])
    wins = lambda last, c: (c["neg"] < last["neg"]) | ((c["neg"] == last["neg"]) & (c["worse"] < last["worse"]))
    step = lambda last, c: F.when(last.isNull() | c.isNull() | ~clash(last, c) | wins(last, c), c).otherwise(last)
    emit = lambda last, c: F.when(last.isNotNull() & (c.isNull() | ~clash(last, c)), last)

    def few(items: Column) -> Column:
        last = lambda kept: F.element_at(kept, -1)
        return F.aggregate(
            F.slice(items, F.lit(2), F.lit(CHUNK)),
            F.slice(items, F.lit(1), F.lit(1)),
            lambda kept, c: F.when(~clash(last(kept), c), F.array_append(kept, c)).when(wins(last(kept), c), F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), c)).otherwise(kept),
        )

    def many(items: Column) -> Column:
        ended = F.concat(items, F.array(F.lit(None).cast(kind)))
        return F.filter(running(ended, F.lit(None).cast(kind), step, emit, kind), lambda x: x.isNotNull())

    kept = lambda a: let(F.sort_array(F.transform(a, fields)), lambda items: F.when(F.size(items) <= CHUNK, few(items)).otherwise(many(items)))
    # most texts' findings are disjoint as they are, and then their places order them
    apart = lambda a: ~F.exists(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.get(a, i)["start"] < F.get(a, i - 1)["end"])
    settled = lambda a: F.when(F.size(a) <= 1, a).when(apart(a), a).otherwise(F.transform(kept(a), lambda x: x["of"]))
    return F.coalesce(let(F.sort_array(spans), settled), F.array().cast(f"array<{FINDING}>"))


def resolve(findings: DataFrame, *key: str) -> DataFrame:
    """Overlapping findings of a text reduced to disjoint ones.

    In the order (start, longest, best score) a finding that clashes with the
    last one kept takes its place only if it is longer, or as long and better;
    losers are not looked at again. Columns beside start, end, type,
    confidence and value go with their finding.
    """
    more = [c for c in findings.columns if c not in (*key, "start", "end", "type", "confidence", "value")]
    item = F.struct("start", (-(F.col("end") - F.col("start"))).alias("neg"), (-F.col("confidence")).alias("worse"), "type", "end", "confidence", "value", *more)
    grouped = findings.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("spans"))
    kinds = {f.name: f.dataType.simpleString() for f in findings.schema}
    kind = f"struct<start:{kinds['start']},neg:{kinds['start']},worse:{kinds['confidence']},type:string,end:{kinds['end']},confidence:{kinds['confidence']},value:string{''.join(f',{c}:{kinds[c]}' for c in more)}>"
    clash = lambda last, c: last.isNotNull() & (c["start"] < last["end"]) & (last["start"] < c["end"])
    wins = lambda last, c: (c["neg"] < last["neg"]) | ((c["neg"] == last["neg"]) & (c["worse"] < last["worse"]))
    step = lambda last, c: F.when(c.isNull() | ~clash(last, c) | wins(last, c), c).otherwise(last)
    emit = lambda last, c: F.when(c.isNull() | ~clash(last, c), last)
    ended = F.concat("spans", F.array(F.lit(None).cast(kind)))  # what comes after the last one
    kept = F.filter(running(ended, F.lit(None).cast(kind), step, emit, kind), lambda x: x.isNotNull())
    return grouped.select(*key, F.explode(kept).alias("s")).select(*key, "s.start", "s.end", "s.type", "s.confidence", "s.value", *[f"s.{c}" for c in more])


def without_covered(findings: DataFrame, covers: DataFrame, *key: str) -> DataFrame:
    """Findings that no covering span of the same text contains."""
    c = covers.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("start").alias("__s"), F.col("end").alias("__e"))
    same = [findings[k] == c[f"__{k}"] for k in key]
    return findings.join(c, [*same, c["__s"] <= findings["start"], findings["end"] <= c["__e"]], "left_anti")


def without_touching(findings: DataFrame, others: DataFrame, *key: str) -> DataFrame:
    """Findings of which neither end lies in a span of the others."""
    c = others.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("start").alias("__s"), F.col("end").alias("__e"))
    same = [findings[k] == c[f"__{k}"] for k in key]
    touch = ((findings["start"] >= c["__s"]) & (findings["start"] < c["__e"])) | ((findings["end"] > c["__s"]) & (findings["end"] <= c["__e"]))
    return findings.join(c, [*same, touch], "left_anti")


def number_placeholders(findings: DataFrame, request: str, message: str, label: str = "type") -> DataFrame:
    """Adds a placeholder LABEL_n: n counts the different values of a label in a request, in order of first place."""
    value = Window.partitionBy(request, label, "value")
    first = findings.withColumn("__first", F.min(F.struct(message, "start", "end")).over(value))
    rank = F.dense_rank().over(Window.partitionBy(request, label).orderBy("__first"))
    return first.withColumn("placeholder", F.concat(F.lit("<"), label, F.lit("_"), rank, F.lit(">"))).drop("__first")


def splice(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, placeholder; sorted, disjoint) replaced by its placeholder."""

    def done(all_spans: Column) -> Column:
        before = lambda i: F.coalesce(F.get(all_spans, i - 1)["end"], F.lit(0))
        parts = F.transform(all_spans, lambda s, i: F.concat(F.substr(text, before(i) + 1, s["start"] - before(i)), s["placeholder"]))
        return F.concat(F.array_join(parts, ""), F.substr(text, F.get(all_spans, F.size(all_spans) - 1)["end"] + 1))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, let(spans, done)).otherwise(text)


def line_column(text: Column, offset: Column) -> Column:
    """Line and column (from 1) of a place."""
    head = F.substr(text, F.lit(1), offset)
    return F.struct((F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1).alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).alias("column"))
