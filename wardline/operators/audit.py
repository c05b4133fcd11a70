"""Audit rows as tables: listing, merging the halves of a row, erasure, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.operators import spans as S


MOST_PAGE = 500


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the newest rows: at most MOST_PAGE of them, none before the first."""
    return rows.orderBy(F.desc("ts"), F.desc("request_id")).offset(max(0, offset)).limit(min(max(1, limit), MOST_PAGE))


def page_info(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """(total, pages, page) of a list that is read in pages."""
    size = min(max(1, limit), MOST_PAGE)
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).alias("pages"), F.lit(max(0, offset) // size + 1).cast("long").alias("page"))


def record(audit: DataFrame) -> DataFrame:
    """The narrow form of a row, as a reader of one record sees it."""
    return audit.select("request_id", "tenant_id", "ts", F.lower("policy_action").alias("action"), "block_code", "policy_version", "provider", "model", "rules_fired")


def entries(audit: DataFrame) -> DataFrame:
    """The outward form of audit rows: counts added up, codes only for what was blocked."""
    blocked = F.col("policy_action") == "BLOCK"
    return audit.select(
        "request_id",
        F.lower("policy_action").alias("action"),
        (F.col("pii_count") + F.col("secret_count")).alias("scrubbed"),
        F.when(blocked, F.col("block_code")).alias("error_code"),
        F.when(blocked, 403).otherwise(200).alias("status"),
        F.size(triggers()).alias("n_triggers"),
    )


def triggers() -> Column:
    """Names of what fired on a row."""
    return F.array_compact(F.array(F.when(F.col("pii_count") > 0, "pii"), F.when(F.col("secret_count") > 0, "secret"), F.when(F.col("block_code") == "PROMPT_INJECTION_BLOCKED", "injection"), F.when(F.col("egress_flagged"), "egress")))


def has_detections() -> Column:
    return F.size(triggers()) > 0


#: how columns of two halves of a row are merged
OVERWRITE, EITHER, GREATEST, UNION, ADD = "overwrite", "either", "greatest", "union", "add"


def merge(old: DataFrame, new: DataFrame, key: str, how: dict[str, str]) -> DataFrame:
    """Upsert of one row per key: scalars are overwritten by what is not null, flags or-ed, counts maximised, lists united and sorted; what adds up
    is added, which only a log that takes each batch once may do.

    Both tables are hash-partitioned by the key once; either half may come first, and a repeat changes nothing.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    out = [F.coalesce(f"b.{key}", f"a.{key}").alias(key)]
    for name, rule in how.items():
        x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
        if rule == OVERWRITE:
            merged = F.coalesce(y, x)
        elif rule == EITHER:
            merged = F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False))
        elif rule == GREATEST:
            merged = F.greatest(x, y)
        elif rule == ADD:
            merged = F.coalesce(x + y, x, y)
        else:
            merged = F.array_sort(F.array_union(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>"))))
        out.append(merged.alias(name))
    both = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull()
    return joined.select(*out, both.alias("was_there"))


def keep_since(audit: DataFrame, cutoff: str, column: str = "ts") -> DataFrame:
    """What retention leaves: rows not older than the cutoff, and those without a time."""
    return audit.where((F.col(column) >= F.lit(cutoff).cast("timestamp")) | F.col(column).isNull())


def erase(audit: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Rows of subjects are gone: an anti join on the key."""
    return audit.join(subjects.select(key).distinct(), key, "left_anti")


def user_hash(value: Column, secret: str) -> Column:
    """HMAC-SHA256 of a value, its first 32 hex digits."""
    raw = secret.encode()
    if len(raw) > 64:
        raise ValueError("secrets of more than 64 bytes are not supported")
    raw = raw.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in raw).hex())) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, value.cast("binary")), 256)
    return F.substring(F.sha2(F.concat(outer, F.unhex(first)), 256), 1, 32)


def eligibility(appeals: DataFrame, audit: DataFrame) -> DataFrame:
    """Whether each appeal meets a block that can be appealed."""
    joined = appeals.join(audit.select("request_id", "policy_action", "block_code"), "request_id", "left")
    why = F.when(F.col("policy_action").isNull(), "unknown_request").when(F.col("policy_action") != "BLOCK", "not_blocked").when(F.col("block_code") == "CREDENTIAL_LEAK_PREVENTED", "not_appealable").otherwise("eligible")
    return joined.withColumn("eligibility", why)


def verify_override(presented: DataFrame, reviews: DataFrame) -> DataFrame:
    """Tokens presented for a request at a time (token, request_id, as_of) against reviews by hash; refusals in a fixed order.

    A token works for the request it was made for, once, until it expires. The
    join is on the hash, so no token is broadcast or compared in pairs.
    """
    r = reviews.select(F.col("override_token_hash").alias("h"), F.col("request_id").alias("for_request"), "status", "override_used_at", "override_expires_at")
    joined = presented.withColumn("h", F.sha2("token", 256)).join(r, "h", "left")
    result = (
        F.when(F.coalesce(F.col("token"), F.lit("")) == "", "no_token")
        .when(F.col("for_request").isNull(), "unknown")
        .when(F.col("status") != "APPROVED", "not_approved")
        .when(F.col("for_request") != F.col("request_id"), "wrong_request")
        .when(F.col("override_used_at").isNotNull(), "already_used")
        .when(F.col("override_expires_at").isNull() | (F.col("override_expires_at") < F.col("as_of")), "expired")
        .otherwise("valid")
    )
    return joined.withColumn("result", result)


REVIEW = "struct<status:string,token_hash:string,opened:timestamp,decided:timestamp,expires:timestamp,used:timestamp>"


def review_states(events: DataFrame, seconds: int) -> DataFrame:
    """Every event of a review with what came of it, and the review's state after it.

    events: request_id, seq, ts, event (open, approve, deny, use), token_hash.
    A request has one pending review at a time; only a pending one is decided;
    an approval lasts so many seconds and serves once. Events of a request are
    folded in order of seq in its row, so requests are spread over all tasks.
    """
    nothing = F.lit(None).cast(REVIEW)
    life = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))

    def outcome(s: Column, e: Column) -> Column:
        pending = s.isNotNull() & (s["status"] == "PENDING")
        usable = s.isNotNull() & (s["status"] == "APPROVED")
        use = F.when(~F.coalesce(usable, F.lit(False)), "not_approved").when(s["token_hash"] != e["token_hash"], "unknown").when(s["used"].isNotNull(), "already_used").when(s["expires"] < e["ts"], "expired").otherwise("used")
        opened = F.when(pending, "already_pending").otherwise("opened")
        decided = F.when(F.coalesce(pending, F.lit(False)), F.when(e["event"] == "approve", "approved").otherwise("denied")).otherwise("not_pending")
        return F.when(e["event"] == "open", opened).when(e["event"] == "use", use).otherwise(decided)

    def step(s: Column, e: Column) -> Column:
        what = outcome(s, e)
        never = F.lit(None).cast("timestamp")

        def state(status: str, **changed: Column) -> Column:
            fields = {"token_hash": s["token_hash"], "opened": s["opened"], "decided": s["decided"], "expires": s["expires"], "used": s["used"]} | changed
            return F.struct(F.lit(status).alias("status"), *[v.alias(k) for k, v in fields.items()]).cast(REVIEW)

        fresh = state("PENDING", token_hash=F.lit(None).cast("string"), opened=e["ts"], decided=never, expires=never, used=never)
        return F.when(what == "opened", fresh).when(what == "approved", state("APPROVED", token_hash=e["token_hash"], decided=e["ts"], expires=e["ts"] + life)).when(what == "denied", state("DENIED", decided=e["ts"])).when(what == "used", state("APPROVED", used=e["ts"])).otherwise(s)

    ordered = events.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "event", "token_hash"))).alias("events"))
    seen = S.running(F.col("events"), nothing, step, lambda s, e: F.struct(e["seq"].alias("seq"), outcome(s, e).alias("outcome"), step(s, e)["status"].alias("status")), "struct<seq:bigint,outcome:string,status:string>")
    return ordered.select("request_id", F.explode(seen).alias("x")).select("request_id", "x.*")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def duplicates(audit: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness."""
    return audit.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
