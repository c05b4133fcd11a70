"""Prompt-injection findings: texts normalised into variants, rules by category, noisy-or score.

Compatibility forms and base64 have no built-in functions, so a batch of texts
goes to Python once, as Arrow, and comes back with its hits; everything after
that is built in. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed as X
from wardline.operators import spans as S
from wardline.operators.literals import Gate

_BLOB = re.compile(rf"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{{{X.LEAST_BLOB},}}={{0,2}}(?![A-Za-z0-9+/=])")
AT = 0.5
RULES = X.INJECTION_RULES
HITS = "array<struct<rule_id:string,category:string,weight:double,via:string>>"

_HIDDEN = re.compile(X.ZERO_WIDTH)
_LOOKALIKES = str.maketrans(*X.LOOKALIKES)
_LEET = str.maketrans(*X.LEET)
_SPACED = re.compile(r"\b(?:[a-z] ){4,}[a-z]\b")


def _tidy(text: str) -> str:
    """Runs of blanks to one, runs of line ends to one, nothing at either end."""
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


@dataclass
class Reading:
    """What a text can be read as, and how it was written to be misread."""

    base: str = ""
    leet: str = ""
    despaced: str | None = None
    payloads: list[str] = field(default_factory=list)
    hidden: bool = False
    lookalikes: bool = False

    @classmethod
    def of(cls, text: str, payloads: bool = True) -> Reading:
        shown = text if text.isascii() else unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
        latin = shown if shown.isascii() else shown.translate(_LOOKALIKES)
        low = latin.lower()
        joined, runs = _SPACED.subn(lambda m: m[0].replace(" ", ""), low)
        out = cls(_tidy(low), "", _tidy(joined) if runs else None, [], not text.isascii() and bool(_HIDDEN.search(text)), latin != shown)
        out.leet = out.base.translate(_LEET)
        if payloads:
            out.payloads = [cls.of(p, False).base for p in decoded(text)]
        return out


def decoded(text: str) -> list[str]:
    """What the first base64 blobs say that hold printable text with a letter in it."""
    out: list[str] = []
    for m in _BLOB.finditer(text):
        if len(out) == X.MOST_BLOBS:
            break
        if len(m[0]) > X.MOST_BLOB_CHARS:
            continue
        try:
            plain = base64.b64decode(m[0] + "=" * (-len(m[0]) % 4)).decode()
        except (binascii.Error, ValueError):
            continue
        if plain and sum(c.isprintable() or c in "\n\t" for c in plain) >= 0.9 * len(plain) and any(map(str.isalpha, plain)):
            out.append(plain)
    return out


class Rules:
    """Rules and run-together needles, ready to be held against texts: one pass of an automaton over each reading tells which are tried."""

    def __init__(self, rules=RULES) -> None:
        self.rules = [(rule, category, float(weight), re.compile(pattern)) for rule, category, weight, pattern in rules]
        self._gate = Gate(p for *_, p in rules)
        self._needles = Gate(frozenset([needle]) for *_, needle in X.COMPACT_NEEDLES)

    def hits(self, text: str) -> list[tuple[str, str, float, str]]:
        """(rule, category, weight, via): rules by the first reading they match, needles in run-together text where no rule of their category matched, and signs of evasion."""
        r = Reading.of(text)
        readings = [("base", r.base)]
        if r.leet != r.base:
            readings.append(("leet", r.leet))
        if r.despaced is not None:
            readings.append(("despaced", r.despaced))
        readings += [("base64", p) for p in r.payloads]
        via_of_rule: dict[int, str] = {}
        for name, reading in readings:
            for k in self._gate.of(reading):
                if k not in via_of_rule and self.rules[k][3].search(reading):
                    via_of_rule[k] = name
        found = [(*self.rules[k][:3], via_of_rule[k]) for k in sorted(via_of_rule)]
        covered = {category for _, category, _, _ in found}
        for k in sorted(self._needles.of("".join(r.base.split()))):
            rule, category, weight, _ = X.COMPACT_NEEDLES[k]
            if category not in covered:
                found.append((rule, category, weight, "compact"))
                covered.add(category)
        if not found:
            return []
        ways = {via for *_, via in found}
        signs = {"compact_match": "compact" in ways, "leetspeak": "leet" in ways, "spaced_letters": "despaced" in ways, "base64_payload": "base64" in ways, "homoglyph": r.lookalikes, "zero_width": r.hidden}
        via_of = {"compact_match": "compact", "leetspeak": "leet", "spaced_letters": "despaced", "base64_payload": "base64"}
        return found + [(f"evasion.{name}", "encoding_evasion", X.EVASION[name], via_of.get(name, "base")) for name, on in signs.items() if on]


def with_hits(texts: DataFrame, text: str, key: list[str], rules=RULES) -> DataFrame:
    """key and ``hits`` of every text; null counts as empty."""
    plain = [tuple(r) for r in rules]

    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = Rules(plain)
        for batch in batches:
            yield pd.Series([[dict(zip(("rule_id", "category", "weight", "via"), h, strict=True)) for h in ready.hits(t or "")] for t in batch])

    # what is not deterministic is not copied into filters above, where it would run again
    return texts.select(*key, search.asNondeterministic()(F.col(text)).alias("hits"))


def hits(texts: DataFrame, text: str, key: list[str], rules=RULES) -> DataFrame:
    """(key, rule_id, category, weight, via), one row a hit."""
    return S.exploded(with_hits(texts, text, key, rules), key, F.col("hits"))


def findings(texts: DataFrame, text: str, key: list[str], at: float = AT, rules=RULES) -> DataFrame:
    """One row per text: detected, score (noisy-or over categories, each at its greatest weight), rules by weight then id, categories sorted."""
    h = with_hits(texts, text, key, rules)
    categories = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["category"])))
    weight = lambda c: F.array_max(F.transform(F.filter("hits", lambda x: x["category"] == c), lambda x: x["weight"]))
    score = F.round(1 - F.aggregate(categories, F.lit(1.0), lambda acc, c: acc * (F.lit(1.0) - weight(c))), 3)
    named = F.transform(F.array_sort(F.transform("hits", lambda x: F.struct((-x["weight"]).alias("o"), x["rule_id"].alias("id")))), lambda x: x["id"])
    return h.select(*key, (score >= at).alias("detected"), score.alias("score"), named.alias("matched_rules"), categories.alias("categories"))
