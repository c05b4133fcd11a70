"""Detectors over texts: personal data and secrets by pattern, unexplained high-entropy tokens, rules with noisy-or scores.

All rules are tried in one pass over the texts: each gives an array of matches,
and the arrays of a row are joined and exploded once.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import checksums as C
from wardline.functions import fixed as X
from wardline.functions.text import nfkc
from wardline.operators import literals as L
from wardline.operators import spans as S


@dataclass(frozen=True)
class Rule:
    """What to look for: matches of the pattern that ``accept`` passes, in texts that hold the sign."""

    name: str
    type: str
    category: str
    pattern: str
    confidence: float
    sign: str = ""
    #: a cheap pattern that must occur before the rule's own is tried
    gate: str = ""
    #: accept(text, match) of a match's start, end and value
    accept: Callable[[Column, Column], Column] | None = None
    #: matches inside these are left out
    outside: str | None = None
    #: another confidence by the value, or null for the rule's own
    sure: Callable[[Column], Column] | None = None
    #: whether the value's entropy moves the confidence, by at most a tenth
    nudged: bool = False
    #: another pattern with the same matches, found faster
    quick: str = ""
    #: a cheap pattern that rules of one kind share: where it does not occur, none of their gates is tried
    kin: str = ""


#: rules that a text may meet, and matches of each, up to which its findings are worked out by compiled code; beyond, by lambdas, which are interpreted
FEW = (3, 2)


def tried(text: Column, rules: tuple[Rule, ...] | list[Rule]) -> Column:
    """array<struct<i, parts>>: for every rule whose gate a text passes, what ``spans.parts`` takes out of it. ``matches`` tells more of them.

    This belongs in a column of its own: there the signs and gates, which most
    texts fail, run as compiled code, and inside a lambda they would not.
    """
    none = F.array().cast("array<struct<i:int,parts:array<string>>>")

    def hit(i: int, r: Rule) -> Column:
        # behind a gate the pattern is tried once, by what takes its matches out
        there = text.rlike(r.gate or r.pattern)
        taken = F.array(F.struct(F.lit(i).alias("i"), S.parts(text, r.quick or r.pattern).alias("parts")))
        return F.when(F.contains(text, F.lit(r.sign)) & there if r.sign else there, taken).otherwise(none)

    of_kin: dict[str, list[Column]] = {}
    for i, r in enumerate(rules):
        of_kin.setdefault(r.kin, []).append(hit(i, r))
    out = of_kin.pop("", [])
    return F.concat(*out, *[F.when(text.rlike(kin), F.concat(*own)).otherwise(none) if len(own) > 1 else own[0] for kin, own in of_kin.items()])


def matches(text: Column, found: Column, rules: tuple[Rule, ...] | list[Rule], few: tuple[int, int] = FEW, least: dict[str, float] | None = None) -> Column:
    """array<FINDING> of the matches that ``tried`` has found (a column): places, checks and confidences.

    This, too, belongs in a column of its own. The findings of texts that meet few rules are
    spelled out match by match, without a lambda, as compiled code; how many rules there are matters little.
    Of a type's findings those stay that are at least as sure as ``least`` says, if it is given; of other types none.
    """

    def by_rule(m: Column, of: Callable[[Rule], Column | None], default: Column) -> Column:
        own = [(i, of(r)) for i, r in enumerate(rules)]
        out = None
        for i, c in own:
            if c is not None:
                out = F.when(m["i"] == i, c) if out is None else out.when(m["i"] == i, c)
        return default if out is None else out.otherwise(default)

    def passes(m: Column) -> Column:
        alike: dict[tuple, list[int]] = {}
        for i, r in enumerate(rules):
            if r.accept or r.outside:
                alike.setdefault((r.accept, r.outside), []).append(i)
        ok = F.when(m["i"].isNull(), False)
        for (accept, outside), of in alike.items():
            own = accept(text, m) if accept else F.lit(True)
            if outside:
                own = own & F.when(text.rlike(outside), ~F.exists(S.find_all(text, outside), lambda u: (u["start"] <= m["start"]) & (m["end"] <= u["end"]))).otherwise(True)
            ok = ok.when(m["i"].isin(of), own)
        return ok.otherwise(True)

    def enough(m: Column, confidence: Callable[[], Column]) -> Column:
        if least is None:
            return F.lit(True)
        asks = [least.get(r.type, math.inf) for r in rules]
        moves = [i for i, r in enumerate(rules) if r.type in least and (r.sure or r.nudged)]
        fails = [i for i, r in enumerate(rules) if i not in moves and r.confidence < asks[i]]
        ok = F.lit(True)
        if moves:
            ok = F.when(m["i"].isin(moves), confidence() >= F.get(F.array(*map(F.lit, asks)), m["i"])).otherwise(ok)
        return F.when(m["i"].isin(fails), False).otherwise(ok) if fails else ok

    def confidence(m: Column) -> Column:
        of = lambda values: F.get(F.array(*map(F.lit, values)), m["i"])
        base = of([float(r.confidence) for r in rules])
        sure = F.coalesce(by_rule(m, lambda r: r.sure(m["value"]).cast("double") if r.sure else None, F.lit(None).cast("double")), base)
        if any(r.nudged for r in rules):
            moved = S.let(C.entropy(F.left(m["value"], F.lit(200))), C.confidence_modifier)
            sure = F.when(of([r.nudged for r in rules]), F.round(F.least(F.lit(0.99), base + moved), 3)).otherwise(sure)
        return sure

    def told(m: Column) -> Column:
        of = lambda values: F.get(F.array(*map(F.lit, values)), m["i"])
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), of([r.type for r in rules]).alias("type"), of([r.category for r in rules]).alias("category"), of([r.name for r in rules]).alias("recognizer"), confidence(m).alias("confidence"))

    none = F.array().cast(f"array<{S.FINDING}>")

    def spelled(j: int, n: int) -> Column:
        """The finding of a text's n-th match of the j-th rule that it meets."""
        x = F.get(found, F.lit(j))
        part = lambda k: F.get(x["parts"], F.lit(k))
        start = functools.reduce(operator.add, [F.length(part(k)) for k in range(2 * n + 1)])
        m = {"i": x["i"], "start": start, "end": start + F.length(part(2 * n + 1)), "value": part(2 * n + 1)}
        return F.when((F.size(x["parts"]) > 2 * n + 1) & passes(m) & enough(m, lambda: confidence(m)), F.array(told(m))).otherwise(none)

    met, each = few
    fit = F.size(found) <= met
    for j in range(met):
        fit = fit & (F.coalesce(F.size(F.get(found, F.lit(j))["parts"]), F.lit(0)) <= 2 * each + 1)
    return F.when(F.size(found) == 0, none).when(fit, F.concat(*[spelled(j, n) for j in range(met) for n in range(each)])).otherwise(F.transform(F.filter(_placed(found), lambda m: passes(m) & enough(m, lambda: confidence(m))), told))


def _placed(found: Column) -> Column:
    """array<struct<i, start, end, value>> of any number of matches."""
    one = lambda h: F.when(F.size(h["parts"]) > 1, F.transform(F.sequence(F.lit(1), F.size(h["parts"]) - 1, F.lit(2)), lambda k: F.struct(h["i"].alias("i"), F.length(F.get(h["parts"], k - 1)).alias("gap"), F.get(h["parts"], k).alias("v")))).otherwise(F.array().cast("array<struct<i:int,gap:int,v:string>>"))
    at = lambda s, x: F.when(s["i"] == x["i"], s["at"]).otherwise(0) + x["gap"]
    start = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(x["i"].alias("i"), (at(s, x) + F.length(x["v"])).alias("at"))
    emit = lambda s, x: F.struct(x["i"].alias("i"), at(s, x).alias("start"), (at(s, x) + F.length(x["v"])).alias("end"), x["v"].alias("value"))
    return S.running(F.flatten(F.transform(found, one)), start, step, emit, "struct<i:int,start:int,end:int,value:string>")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def digits_around(text: Column, m: Column) -> Column:
    """How many digits stand in the whole run of digits, blanks, points, dashes, brackets and plus signs that holds a match."""
    signs = F.lit("0123456789 .-()+")
    first, after = F.length(F.rtrim(F.substr(text, F.lit(1), m["start"]), signs)), F.substr(text, m["end"] + 1)
    return F.length(digits(F.substr(text, first + 1, m["end"] - first + F.length(after) - F.length(F.ltrim(after, signs)))))


def _card(_: Column, m: Column) -> Column:
    return F.length(digits(m["value"])).between(13, 19) & C.luhn(digits(m["value"]))


#: 8 to 15 digits that are neither a date nor three fours
_PHONE_FORM = rf"^(?!{X.DATE[1:]})(?!{X.THREE_FOURS[1:]})[^0-9]*+(?:[0-9][^0-9]*+){{8,15}}$"
#: without 16 digits in one run no match stands in a longer one than 15
_LONG_RUN = r"[0-9](?:[\s.()+\-]*+[0-9]){15}"


def _phone(text: Column, m: Column) -> Column:
    return m["value"].rlike(_PHONE_FORM) & F.when(text.rlike(_LONG_RUN), digits_around(text, m) <= 15).otherwise(True)


def _mobile(text: Column, m: Column) -> Column:
    run = digits_around(text, m)
    return F.when(F.length(digits(m["value"])) > 10, run <= 12).otherwise(run == 10)


#: ten digits with a sign between them at most; letters before a digit or nought
_TEN, _CODED = r"[0-9](?:[\s\-]?[0-9]){9}", "[A-Z]{4}[A-Z0]"

PERSONAL = (
    Rule("regex.email", "EMAIL_ADDRESS", "PII", X.EMAIL, 0.95, "@", gate=r"@[A-Za-z0-9\-]+\.", quick=X.EMAIL_ANCHORED),
    Rule("regex.ipv4", "IP_ADDRESS", "PII", X.IPV4, 0.90, ".", gate="[0-9][.][0-9]"),
    Rule("regex.ipv6", "IP_ADDRESS", "PII", X.IPV6, 0.80, ":", accept=lambda _, m: F.length(m["value"]) >= 8, gate="[0-9a-fA-F]:[0-9a-fA-F:]"),
    Rule("regex.ssn", "US_SSN", "PII", X.SSN, 0.85, "-", gate="[0-9]{3}-[0-9]{2}"),
    Rule("regex.card_luhn", "CREDIT_CARD", "PII", X.DIGIT_RUN, 0.92, accept=_card, outside=X.UUID, gate="[0-9](?:[ -]?[0-9]){12}", kin=_TEN),
    Rule("regex.phone", "PHONE_NUMBER", "PII", X.PHONE, 0.70, accept=_phone, outside=X.UUID, sure=lambda v: F.when(v.rlike("[+(]"), 0.85), gate=r"\d\d[\s.\-]\d\d"),
    Rule("regex.honorific_name", "PERSON", "PII", X.HONORIFIC_NAME, 0.60, gate="(?=[" + "".join(sorted({h[0] for h in X.HONORIFICS})) + r"])\b(?:" + "|".join(X.HONORIFICS) + r")[.\s]"),
    Rule("india.aadhaar_verhoeff", "IN_AADHAAR", "PII", X.AADHAAR, 0.95, accept=lambda _, m: C.verhoeff(digits(m["value"])), gate="[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", kin=_TEN),
    Rule("india.pan", "IN_PAN", "PII", X.PAN, 0.55, sure=lambda v: F.when(F.contains(F.lit(X.PAN_HOLDERS), F.substr(v, F.lit(4), F.lit(1))), 0.90), gate="[A-Z]{5}[0-9]{4}", kin=_CODED),
    Rule("india.ifsc", "IN_IFSC", "PII", X.IFSC, 0.60, sure=lambda v: F.when(F.left(v, F.lit(4)).isin(X.BANKS), 0.92), gate="[A-Z]{4}0", kin=_CODED),
    Rule("india.upi_vpa", "IN_UPI_ID", "PII", X.PAYMENT_ADDRESS, 0.88, "@", gate=r"@[A-Za-z]{3,}(?![\w.])"),
    Rule("india.mobile", "PHONE_NUMBER", "PII", X.MOBILE, 0.65, accept=_mobile, sure=lambda v: F.when(F.length(digits(v)) > 10, 0.90), gate=r"[6-9][0-9]{4}[\s\-]?[0-9]{5}", kin=_TEN),
)


def _jwt(_: Column, m: Column) -> Column:
    """A token's header must decode to JSON that names an algorithm."""
    head = F.translate(F.substring_index(m["value"], ".", 1), "-_", "+/")
    padded = F.rpad(head, (F.ceil(F.length(head) / 4) * 4).cast("int"), F.lit("="))
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.alg").isNotNull()


def _no_stand_in(_: Column, m: Column) -> Column:
    return ~m["value"].rlike(X.STAND_INS)


_ACCEPT = {"jwt": _jwt, "generic_secret_assignment": _no_stand_in, "bearer_token": _no_stand_in, "provider_api_key": _no_stand_in, "uri_credential": _no_stand_in, "database_uri": _no_stand_in}
_GATES = {"bearer_token": "[rR] [A-Za-z0-9._~+/\\-]{20}", "generic_secret_assignment": "[dntyDNTY][\"']?\\s{0,3}[:=]", "telegram_token": "[0-9]{8}:", "aws_secret_key": "(?i)aws_secret_access_key", "twilio_key": "SK[0-9a-f]{8}", "uri_credential": "://[^\\s/@]*@", "database_uri": "://[^\\s/@]*@"}
SECRETS = tuple(Rule(name, kind, "SECRET", pattern, base, sign, _GATES.get(name, ""), _ACCEPT.get(name), nudged=True) for name, kind, _, pattern, base, sign in X.SECRETS)


def findings(texts: DataFrame, text: str, key: list[str], rules=PERSONAL, disjoint: bool = False) -> DataFrame:
    """One row per match of any rule: the key, start, end, value, type, category, recognizer, confidence; disjoint ones of a text by the rule of ``spans.resolve``, in its row."""
    rows = texts.select(F.struct(*key).alias("__k"), F.col(text).alias("__t"), S.held(tried(F.col(text), rules)).alias("__m"))
    rows = rows.where(F.size("__m") > 0).select("__k", S.held(matches(F.col("__t"), F.col("__m"), rules)).alias("__f"))
    return S.exploded(rows.select("__k.*", "__f"), key, S.held(S.resolved(F.col("__f"))) if disjoint else F.col("__f"))


def reported(found: DataFrame, entities: dict[str, tuple[str, float, bool, str]] = X.ENTITIES, fallback: bool = True) -> DataFrame:
    """The findings of types that are on, at least as sure as their type asks; honorific names only as a fallback where no model runs."""
    on = F.lit(False)
    for kind, (_, least, enabled, _) in entities.items():
        if enabled:
            on = on | ((F.col("type") == kind) & (F.col("confidence") >= least))
    out = found.where(on)
    return out if fallback else out.where("recognizer <> 'regex.honorific_name'")


TOKEN = r"[^\s\"'`=,;:()\[\]{}<>|]{20,}"

#: fixed values: why a token is of no interest, the first that holds
BENIGN = (
    ("uuid", f"^{X.UUID}$"),
    ("git_sha", "^[0-9a-f]{40}$"),
    ("short_hash", "^[0-9a-f]{7,12}$"),
    ("hex_color", "^#[0-9a-fA-F]{3,8}$"),
    ("timestamp", "^[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("numeric", "^[0-9.,+\\-]+$"),
    ("path", r"[/\\][^/\\]+[/\\]"),
    ("data_uri", "^data:"),
)


def benign(token: Column) -> Column:
    """The first reason why a token is of no interest, else null; words without digits, a quarter to three fifths vowels, are language."""
    letters = F.regexp_replace(token, "[^A-Za-z]", "")
    vowels = F.try_divide(F.length(F.regexp_replace(letters, "[^AEIOUaeiou]", "")), F.length(letters))
    language = (F.length(letters) >= 6) & ~token.rlike("[0-9]") & F.coalesce(vowels.between(0.25, 0.60), F.lit(False))
    return F.coalesce(*[F.when(token.rlike(p), F.lit(reason)) for reason, p in BENIGN], F.when(language, "natural_language"))


ODD = "struct<start:int,end:int,value:string,entropy:double>"


def odd_tokens(text: Column, threshold: float = 4.0, open_to: Callable[[Column], Column] | None = None) -> Column:
    """The array (ODD) of long tokens of high entropy that nothing explains; of those only that ``open_to`` passes, which is asked first, as entropy is dear."""
    long = F.filter(S.find_all(text, TOKEN), lambda m: (open_to(m) if open_to else F.lit(True)) & benign(m["value"]).isNull())
    told = F.transform(long, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), C.entropy(m["value"]).alias("entropy")))
    return F.when(text.rlike(TOKEN), F.filter(told, lambda m: m["entropy"] >= threshold)).otherwise(F.array().cast(f"array<{ODD}>"))


def entropy_findings(texts: DataFrame, text: str, key: list[str], threshold: float = 4.0) -> DataFrame:
    """Long tokens of high entropy that nothing explains: warnings, never blocks."""
    rows = S.exploded(texts, key, S.held(odd_tokens(F.col(text), threshold)))
    t, h = F.col("value"), F.col("entropy")
    score = F.lit(0.5) + F.when(h >= 5.0, 0.10).otherwise(0.0) + F.when(C.character_classes(t) >= 3, 0.10).otherwise(0.0) + F.when(F.length(t) >= 32, 0.05).otherwise(0.0)
    return rows.select(*key, "start", "end", "value", F.round(h, 6).alias("entropy"), F.round(F.least(score, F.lit(0.75)), 3).alias("confidence"))


def noisy_or_of(categories: Column) -> Column:
    """1 - the product of (1 - weight) over an array of (category, weight), one for each category, three decimals."""
    return F.round(1 - F.aggregate(categories, F.lit(1.0), lambda acc, x: acc * (F.lit(1.0) - x["weight"])), 3)


def screen(texts: DataFrame, text: str, key: list[str], categories: tuple, groups: str | None = None) -> DataFrame:
    """(key, score, categories by weight) of the texts in which a category's pattern occurs; see ``screens``."""
    return screens(texts, text, key, {"": (categories, groups)}).drop("screen")


def screens(texts: DataFrame, text: str, key: list[str], of: dict[str, tuple[tuple, str | None]]) -> DataFrame:
    """(key, score, categories by weight, screen), a row for each screen (categories, groups) of which a category's pattern occurs: no shuffle, one pass for all.

    Full-width and other compatibility forms are read as what they stand for. A category counts once,
    whichever of its patterns is found. GROUP in a pattern stands for the group words.
    A pattern is tried only where the text holds one of the literals that its matches need.
    """
    low = F.lower(F.trim(F.regexp_replace(nfkc(F.col(text)), r"\s+", " ")))

    def any_of(t: Column, patterns: tuple[str, ...], groups: str | None) -> Column:
        out = F.lit(False)
        for p in (p.replace("GROUP", groups or "GROUP") for p in patterns):
            met = [F.contains(t, F.lit(x)) for x in sorted(L.required(p) or ())]
            out = out | (functools.reduce(operator.or_, met) & t.rlike(p) if met else t.rlike(p))
        return out

    def hits(categories: tuple, groups: str | None) -> Column:
        by_weight = sorted(categories, key=lambda c: -c[1])
        return F.array_compact(F.array(*[F.when(any_of(F.col("__t"), patterns, groups), F.struct(F.lit(name).alias("category"), F.lit(float(weight)).alias("weight"))) for name, weight, patterns in by_weight]))

    rows = texts.select(*key, S.held(low).alias("__t"))
    rows = rows.select(*key, *[S.held(hits(*s)).alias(f"__h{i}") for i, s in enumerate(of.values())])
    told = F.filter(F.array(*[F.struct(F.col(f"__h{i}").alias("hits"), F.lit(name).alias("screen")) for i, name in enumerate(of)]), lambda x: F.size(x["hits"]) > 0)
    rows = S.exploded(rows, key, S.held(told))
    return rows.select(*key, noisy_or_of(F.col("hits")).alias("score"), F.transform("hits", lambda x: x["category"]).alias("categories"), "screen")


def noisy_or(hits: DataFrame, *key: str) -> DataFrame:
    """1 - the product over categories of (1 - the category's greatest weight), three decimals; categories by weight."""
    per = hits.groupBy(*key, "category").agg(F.max("weight").alias("w"))
    got = per.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), "category"))).alias("c"))
    product = F.aggregate("c", F.lit(1.0), lambda acc, x: acc * (F.lit(1.0) + x["o"]))
    return got.select(*key, F.round(1 - product, 3).alias("score"), F.transform("c", lambda x: x["category"]).alias("categories"))
