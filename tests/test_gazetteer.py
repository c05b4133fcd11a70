"""Names by a joined list, against the rule stated over one text, and with half a million names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wardline.functions import fixed as X
from wardline.operators import gazetteer as G
from wardline.operators import inspect as N

SCHEMA = "name string, is_first boolean, is_last boolean"


def plain(text, first, last):
    out = []
    for m in re.finditer(G.RUN, text or "", re.ASCII):
        words = list(re.finditer(r"\S+", m[0]))
        known = first | last
        lead = next((i for i, w in enumerate(words) if w[0] in known or w[0].lower() not in (*X.LEADING_STOP, *X.CONTACT_CUES)), None)
        if lead is None:
            continue
        name = [w[0] for w in words[lead:]]
        hits = sum(w in known for w in name)
        before = re.search(r"([A-Za-z]+)[\s:,]+$", text[: m.start()])
        cued = lead > 0 or bool(before and before[1].lower() in X.CONTACT_CUES)
        if len(name) > 1:
            score = 0.88 if hits >= 2 else 0.74 if hits == 1 and (name[0] in first or name[-1] in last) else 0.60 if hits == 1 else None
        else:
            score = 0.66 if hits and name[0] in first and cued else None
        if score:
            start = m.start() + words[lead].start()
            out.append((start, m.end(), text[start : m.end()], score))
    return out


def listed(spark, first, last):
    return spark.createDataFrame([(n, True, None) for n in sorted(first)] + [(n, None, True) for n in sorted(last)] + [(None, True, True)], SCHEMA)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_names_by_the_stated_rule(spark, broadcast):
    rng = random.Random(4)
    words = [*sorted(N.FIRST)[:9], *sorted(N.LAST)[:9], "Unbekannt", "The", "Dear", "Contact", "Call", "please", "and", "Report", "Ünal", "ok", ",", "by:", "Herr"]
    texts = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(0, 15)))) for i in range(600)]
    texts += [(1000, None), (1001, ""), (1002, "Anna Weber " * 3000), (0, texts[0][1]), (5, "Contact Anna now"), (5, "Contact Anna now")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "k long, text string, name string, copies int").repartition(3)
    got = sorted((r["k"], r["start"], r["end"], r["value"], r["confidence"]) for r in G.names(df, "text", ["k"], listed(spark, N.FIRST, N.LAST), broadcast).collect())
    want = sorted((i, *x) for i, t in texts for x in plain(t, N.FIRST, N.LAST))
    assert got == want and len(want) > 500
    short = N.names(df, "text", ["k"])
    assert sorted((r["k"], r["start"], r["end"], r["value"], r["confidence"]) for r in short.collect()) == want


def test_half_a_million_names(spark):
    code = lambda c: F.translate(F.lpad(c.cast("string"), 6, "0"), "0123456789", "abcdefghij")
    every = spark.range(500_000).select(F.concat(F.lit("N"), code(F.col("id"))).alias("name"), (F.col("id") % 2 == 0).alias("is_first"), (F.col("id") % 2 == 1).alias("is_last"))
    texts = spark.range(20_000).select("id", F.concat(F.lit("We met N"), code(F.col("id") * 26 % 600_000), F.lit(" Zett and N"), code(F.col("id") % 3 * 2), F.lit(" N"), code(F.lit(1)), F.lit(" there")).alias("text"))
    found = G.names(texts, "text", ["id"], every)
    got = {(r["id"], r["start"]): (r["value"], r["confidence"]) for r in found.collect()}
    spell = lambda c: "N" + f"{c:06d}".translate(str.maketrans("0123456789", "abcdefghij"))
    assert sum(s > 10 for _, s in got) == 20_000
    for i in (0, 1, 2, 7777, 19_999):
        assert (got.get((i, 7)) == (f"{spell(i * 26 % 600_000)} Zett", 0.74)) == (i * 26 % 600_000 < 500_000)
        assert got[i, 24] == (f"{spell(i % 3 * 2)} {spell(1)}", 0.88)
    few = G.names(texts, "text", ["id"], every.limit(10), broadcast_names=0)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(found) - size(few)) < 400


def test_empty_lists_and_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    texts = spark.createDataFrame([(1, "Contact Anna soon")], "k long, text string")
    assert G.names(texts, "text", ["k"], none).collect() == []
    assert G.names(texts.limit(0), "text", ["k"], listed(spark, {"Anna"}, set())).collect() == []
