"""Person names by a list of any length, joined to the words of texts.

A text gives its runs of one to four capitalised words; a run's words are exploded and joined with the list by hash, so the plan
is the same for ten names and for ten million. Words that are no name go out with the join; what is left of a run comes together
again by its place and is judged in its row. A list of at most ``BROADCAST_NAMES`` names is broadcast; a longer one is shuffled,
and a name that stands in a large share of the texts is then split by adaptive execution, as the list has it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed as X
from wardline.operators import spans as S

BROADCAST_NAMES = 100_000
RUN = r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,3}\b"


def people(names: DataFrame) -> DataFrame:
    """(name, is_first, is_last), one row a name, of a list (name, is_first, is_last) that may repeat names; null flags are false."""
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    return names.where(F.col("name").isNotNull()).groupBy("name").agg(flag("is_first"), flag("is_last"))


def judged(run: dict[str, Column], known: Column) -> tuple[Column, Column, Column]:
    """(words before the name, confidence, recogniser) of a run (words, cue: the word before it) of which ``known`` words (pos, is_first, is_last) are names.

    Leading words that are no name and stop words or cues are no part of it. Two known words make 0.88; one that opens
    the run as a first name or ends it as a surname 0.74; one elsewhere 0.60. A single word counts only as a first name after a cue, 0.66.
    """
    words, n = run["words"], F.size(run["words"])
    cues, stops = F.array(*map(F.lit, X.CONTACT_CUES)), F.array(*map(F.lit, [*X.LEADING_STOP, *X.CONTACT_CUES]))
    at = lambda i: F.exists(known, lambda k: k["pos"] == i)
    kept = F.filter(F.sequence(F.lit(0), n - 1), lambda i: at(i) | ~F.array_contains(stops, F.lower(F.get(words, i))))
    lead = F.get(kept, F.lit(0))
    hits = F.size(F.filter(known, lambda k: k["pos"] >= lead))
    opens = F.exists(known, lambda k: (k["pos"] == lead) & k["is_first"])
    ends = F.exists(known, lambda k: (k["pos"] == n - 1) & k["is_last"])
    many = n - lead > 1
    cued = (lead > 0) | F.array_contains(cues, run["cue"])
    score = F.when(many & (hits >= 2), 0.88).when(many & (hits == 1) & (opens | ends), 0.74).when(many & (hits == 1), 0.60).when(~many & opens & cued, 0.66)
    return lead, score, F.when(many, "india.name_gazetteer").otherwise("india.name_gazetteer_cued")


def names(texts: DataFrame, text: str, key: list[str], listed: DataFrame, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """One row per name in a text: key, start, end, value, type, category, recognizer, confidence.

    listed: (name, is_first, is_last). Rows that repeat a key are texts of their own; null and empty texts hold no names; an
    empty list finds nothing; other columns are ignored.
    """
    known = people(listed)
    if known.limit(broadcast_names + 1).count() <= broadcast_names:
        known = F.broadcast(known)
    t = F.col(text)
    before = F.lower(F.regexp_extract(F.substr(t, F.lit(1), F.col("m.start")), r"([A-Za-z]+)[\s:,]+$", 1))
    runs = texts.select(*key, text, F.explode(S.find_all(t, RUN)).alias("m")).select(*key, F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.value").alias("value"), before.alias("cue"))
    # a run of texts that repeat a key is known by how often it comes
    runs = runs.groupBy(*key, "start", "end", "value", "cue").agg(F.count("*").alias("copies"))
    run = [*key, "start", "end", "value", "cue", "copies"]
    words = runs.select(*run, F.posexplode(F.split("value", r"\s+")).alias("pos", "word"))
    met = words.join(known, F.col("word") == F.col("name")).groupBy(*run).agg(F.collect_list(F.struct("pos", "is_first", "is_last")).alias("known"))  # four at most
    lead, score, recogniser = judged({"words": F.split("value", r"\s+"), "cue": F.col("cue")}, F.col("known"))
    rows = met.select(*run, lead.alias("lead"), score.alias("confidence"), recogniser.alias("recognizer")).where("confidence is not null")
    cut = F.when(F.col("lead") > 0, F.length("value") - F.length(F.regexp_replace(F.col("value"), F.concat(F.lit(r"^(?:\S+\s+){"), F.col("lead").cast("string"), F.lit("}")), F.lit("")))).otherwise(F.lit(0))
    rows = rows.withColumn("cut", cut).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*key, (F.col("start") + F.col("cut")).alias("start"), "end", F.substr("value", F.col("cut") + 1).alias("value"), F.lit("PERSON").alias("type"), F.lit("PII").alias("category"), "recognizer", "confidence")
