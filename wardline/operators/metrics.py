"""Aggregates over audit rows: overview, security, providers, sustainability, report, dashboard series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.operators.percentiles import percentiles


def window(audit: DataFrame, as_of: str, hours: int, tenant: str | None = None) -> DataFrame:
    """Rows of the last hours before as_of (all tenants, or one); plain comparisons that reach the scan."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    out = audit.where(F.col("ts") >= since)
    return out if tenant is None else out.where(F.col("tenant_id") == tenant)


def newest(audit: DataFrame, n: int) -> DataFrame:
    """The n newest rows: a top-k, not a sort of everything."""
    return audit.orderBy(F.desc("ts"), F.desc("request_id")).limit(n)


def with_percentiles(sums: DataFrame, rows: DataFrame, by: tuple[str, ...], **wanted: tuple[str, float]) -> DataFrame:
    """Aggregates by group with the group's nearest-rank percentiles of non-null values beside them, three decimals; null of none."""
    found = percentiles(rows, list(by), wanted)
    found = found.select(*[F.col(k).alias(f"__{k}") for k in by], *[F.round(n, 3).alias(n) for n in wanted])
    if not by:
        return sums.crossJoin(F.broadcast(found))  # one row each
    return sums.join(found, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by], "left").drop(*[f"__{k}" for k in by])


def mean(column: str) -> Column:
    return F.round(F.avg(column), 3)


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def latency(audit: DataFrame, *by: str) -> DataFrame:
    sums = audit.groupBy(*by).agg(mean("latency_total_ms").alias("mean_ms"))
    total_ms, inspect_ms = "latency_total_ms", "latency_inspect_ms"
    out = with_percentiles(sums, audit, by, p50_ms=(total_ms, 0.5), p95_ms=(total_ms, 0.95), p99_ms=(total_ms, 0.99), overhead_p50_ms=(inspect_ms, 0.5), overhead_p95_ms=(inspect_ms, 0.95))
    return out.select(*by, "p50_ms", "p95_ms", "p99_ms", "mean_ms", "overhead_p50_ms", "overhead_p95_ms")


def overview(audit: DataFrame, *by: str) -> DataFrame:
    sums = audit.groupBy(*by).agg(
        F.count("*").alias("total_requests"),
        count_if(F.col("policy_action") == "BLOCK").alias("blocked_requests"),
        count_if(F.col("policy_action") == "SANITIZE").alias("sanitized_requests"),
        mean("latency_total_ms").alias("mean_ms"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        total("total_tokens").alias("total_tokens"),
    )
    out = with_percentiles(sums, audit, by, p50_ms=("latency_total_ms", 0.5), p95_ms=("latency_total_ms", 0.95))
    return out.select(*by, "total_requests", "blocked_requests", "sanitized_requests", "p50_ms", "p95_ms", "mean_ms", "input_tokens", "output_tokens", "total_tokens")


def security(audit: DataFrame, reviews: DataFrame, *by: str) -> DataFrame:
    """Detection and block counts with review counts by status."""
    counts = audit.groupBy(*by).agg(
        total("pii_count").alias("pii_detections"),
        total("secret_count").alias("secret_detections"),
        count_if(F.col("block_code") == "PROMPT_INJECTION_BLOCKED").alias("injection_blocks"),
        count_if(F.col("block_code") == "CREDENTIAL_LEAK_PREVENTED").alias("credential_blocks"),
        count_if(F.col("egress_flagged")).alias("egress_flags"),
    )
    by_status = reviews.groupBy(*by).pivot("status", ["PENDING", "APPROVED", "DENIED"]).count()
    named = by_status.select(*by, *[F.coalesce(s, F.lit(0)).alias(f"reviews_{s.lower()}") for s in ("PENDING", "APPROVED", "DENIED")])
    return counts.join(named, list(by), "left").na.fill(0)


def top_rules(audit: DataFrame, n: int = 10) -> DataFrame:
    """The n rules fired most; ties by rule id."""
    fired = audit.select(F.explode("rules_fired").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n_fired"))
    return fired.orderBy(F.desc("n_fired"), "rule_id").limit(n)


def providers(audit: DataFrame) -> DataFrame:
    """One row feeds up to three groups: the provider that served, the one left and the one taken over."""
    served = F.struct(F.col("provider").alias("name"), F.lit("served").alias("role"))
    left = F.when(F.col("failover_used"), F.struct(F.col("failover_from").alias("name"), F.lit("out").alias("role")))
    taken = F.when(F.col("failover_used"), F.struct(F.col("failover_to").alias("name"), F.lit("in").alias("role")))
    roles = audit.select("ts", "latency_provider_ms", F.explode(F.array_compact(F.array(served, left, taken))).alias("r")).where("r.name is not null")
    is_served = F.col("r.role") == "served"
    rows = roles.select("ts", F.when(is_served, F.col("latency_provider_ms")).alias("lat"), F.col("r.name").alias("provider"), "r.role")
    sums = rows.groupBy("provider").agg(
        count_if(F.col("role") == "served").alias("requests"),
        count_if(F.col("role") == "out").alias("failures"),
        count_if(F.col("role") == "in").alias("failover_in"),
        count_if(F.col("role") == "out").alias("failover_out"),
        F.date_format(F.max(F.when(F.col("role") == "served", F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
    )
    out = with_percentiles(sums, rows, ("provider",), latency_p50_ms=("lat", 0.5))
    return out.select("provider", "requests", "failures", "failover_in", "failover_out", "latency_p50_ms", "last_seen")


def sustainability(audit: DataFrame, wh_per_thousand_tokens: float, grid_g_per_kwh: float, *by: str) -> DataFrame:
    """Hit rate over hits and served misses, and energy avoided by hits at the mean served size."""
    hit, miss = F.col("cache_hit"), ~F.col("cache_hit") & F.col("provider").isNotNull()
    sums = audit.groupBy(*by).agg(
        count_if(hit).alias("cache_hits"),
        count_if(miss).alias("cache_misses"),
        F.avg(F.when(miss & (F.col("total_tokens") > 0), F.col("total_tokens"))).alias("mean_tokens"),
    )
    avoided = F.coalesce(F.floor("mean_tokens") * wh_per_thousand_tokens / 1000 * F.col("cache_hits"), F.lit(0.0))
    considered = F.col("cache_hits") + F.col("cache_misses")
    return sums.select(
        *by,
        "cache_hits",
        "cache_misses",
        F.coalesce(F.round(F.try_divide(F.col("cache_hits"), considered), 4), F.lit(0.0)).alias("cache_hit_rate"),
        F.round(avoided, 4).alias("energy_avoided_wh"),
        F.round(avoided * grid_g_per_kwh / 1000, 4).alias("co2_avoided_g"),
    )


def report(audit: DataFrame) -> DataFrame:
    """Long rows (section, metric, value), one scan for the plain counts and one for each histogram."""
    sums = audit.agg(F.count("*").alias("requests"), count_if(F.col("policy_action") == "BLOCK").alias("blocked"), total("pii_count").alias("pii"), total("secret_count").alias("secrets"), count_if(F.col("cache_hit")).alias("hits"), F.countDistinct("policy_version").alias("versions"), count_if(F.col("failover_used")).alias("failovers"))
    sections = {"requests": "oversight", "blocked": "safety", "pii": "privacy", "secrets": "privacy", "hits": "wellbeing", "versions": "accountability", "failovers": "robustness"}
    plain = sums.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(m).alias("value")) for m, s in sections.items()])).alias("x")).select("x.*")
    actions = audit.groupBy("policy_action").agg(F.count("*").alias("value")).select(F.lit("transparency").alias("section"), F.concat(F.lit("action:"), "policy_action").alias("metric"), "value")
    return plain.unionByName(actions)


def in_buckets(audit: DataFrame, begin: str, end: str, buckets: int) -> DataFrame:
    """The rows of [begin, end) with the number of their bucket, from 0."""
    t0, t1 = F.unix_micros(F.lit(begin).cast("timestamp")), F.unix_micros(F.lit(end).cast("timestamp"))
    place = F.floor((F.unix_micros("ts") - t0) * buckets / (t1 - t0))
    rows = audit.where((F.col("ts") >= F.lit(begin).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return rows.withColumn("bucket", F.least(F.lit(buckets - 1), F.greatest(F.lit(0), place)).cast("long"))


def savings(audit: DataFrame, prices: DataFrame, counterfactual: str, begin: str, end: str, buckets: int) -> DataFrame:
    """(bucket, saved_usd, running): what cache hits saved in each bucket, and up to it; empty buckets save nothing."""
    saved = spend(in_buckets(audit, begin, end, buckets), prices, counterfactual, "bucket").select("bucket", "saved_usd")
    every = audit.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(F.broadcast(saved), "bucket", "left").na.fill(0.0, ["saved_usd"])
    return running(every, "saved_usd", "bucket").withColumn("running", F.round("running", 6))


def series(audit: DataFrame, begin: str, end: str, buckets: int) -> DataFrame:
    """Fixed buckets over [begin, end): every bucket is there, empty ones with zeros and null percentiles."""
    rows = in_buckets(audit, begin, end, buckets)
    action = F.col("policy_action")
    sums = rows.groupBy("bucket").agg(
        F.count("*").alias("requests"),
        count_if(action.isin("ALLOW", "WARN")).alias("allowed"),
        count_if(action == "SANITIZE").alias("sanitized"),
        count_if(action == "BLOCK").alias("blocked"),
        count_if(F.col("cache_hit")).alias("cache_hits"),
        total("total_tokens").alias("tokens"),
    )
    found = percentiles(rows, ["bucket"], {"p95_ms": ("latency_total_ms", 0.95)})
    sums = sums.join(F.broadcast(found.select("bucket", F.round("p95_ms").cast("long").alias("p95_ms"))), "bucket", "left")
    all_buckets = audit.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    return all_buckets.join(F.broadcast(sums), "bucket", "left").na.fill(0, ["requests", "allowed", "sanitized", "blocked", "cache_hits", "tokens"])


def running(rows: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """Running sum in order (small series: one row a bucket), within the keys given."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows numbered from 1 in order, by ranges: each partition counts its own, and as many counts as partitions reach the driver.

    The sorted rows are kept on the executors' disks, with their lineage, so that both passes see the same partitions.
    """
    from pyspark import StorageLevel

    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    part = F.shiftright("__id", 33)
    starts, total = [], 0
    for p, n in sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).count().collect()):
        starts.append((p, total + 1 - (p << 33)))
        total += n
    placed = ranged.join(F.broadcast(spark.createDataFrame(starts, "__p long, __start long")), part == F.col("__p"))
    return placed.select(*rows.columns, (F.col("__id") + F.col("__start")).alias(name))


def share(audit: DataFrame, key: str) -> DataFrame:
    """Each key's count and share of the total; the window is over one row a key."""
    n = audit.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.select(key, "n", F.round(F.try_divide(F.col("n"), whole), 4).alias("share"))


def spend(audit: DataFrame, prices: DataFrame, counterfactual: str, *by: str) -> DataFrame:
    """Dollars spent on served requests, and saved by cache hits, which are priced as the counterfactual model.

    A model's price is that of the longest listed name it begins with; the
    empty name is the default. Prices are in dollars a million tokens.
    """
    from wardline.operators import hints as H

    usd = (F.coalesce("input_tokens", F.lit(0)) * F.col("price_in") + F.coalesce("output_tokens", F.lit(0)) * F.col("price_out")) / 1_000_000
    priced = H.longest_prefix(audit.withColumn("model", F.when(F.col("cache_hit"), F.lit(counterfactual)).otherwise(F.lower(F.substring_index("model", "/", -1)))), "model", prices)
    return priced.withColumn("usd", F.round(usd, 6)).groupBy(*by).agg(F.round(F.sum(F.when(~F.col("cache_hit"), F.col("usd"))), 6).alias("spend_usd"), F.round(F.sum(F.when(F.col("cache_hit"), F.col("usd"))), 6).alias("saved_usd"))


def with_footprint(audit: DataFrame, energy: DataFrame, grid_g_per_kwh: float) -> DataFrame:
    """Audit rows with energy_wh and co2_g where the gateway has told none: tokens by the rate of the longest model name that theirs begins with.

    energy: (model, wh_per_1k), the empty name for unknown models; model names are compared in lower case, without the provider.
    """
    from wardline.operators import hints as H

    known = audit.columns
    named = audit.withColumn("__model", F.lower(F.substring_index(F.coalesce("model", F.lit("")), "/", -1)))
    rated = H.longest_prefix(named, "__model", energy.select("model", F.col("wh_per_1k").alias("price_in"), F.lit(0.0).alias("price_out")))
    wh = F.round(F.coalesce("total_tokens", F.lit(0)) / 1000 * F.col("price_in"), 6)
    own = F.coalesce(F.col("estimated_energy_wh"), wh) if "estimated_energy_wh" in known else wh
    co2 = F.round(F.col("energy_wh") / 1000 * grid_g_per_kwh, 6)
    co2 = F.coalesce(F.col("estimated_co2_g"), co2) if "estimated_co2_g" in known else co2
    return rated.withColumn("energy_wh", own).withColumn("co2_g", co2).select(*known, "energy_wh", "co2_g")


def footprint(audit: DataFrame, energy: DataFrame, grid_g_per_kwh: float, basis: str, *by: str) -> DataFrame:
    """Energy and carbon of served requests and what cache hits avoided, with the basis of the estimate, which travels with it."""
    rows, hit = with_footprint(audit, energy, grid_g_per_kwh), F.coalesce(F.col("cache_hit"), F.lit(False))
    part = lambda c, when, name: F.round(F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0)), 6).alias(name)
    sums = rows.groupBy(*by).agg(part("energy_wh", ~hit, "energy_wh"), part("co2_g", ~hit, "co2_g"), part("energy_wh", hit, "energy_avoided_wh"), part("co2_g", hit, "co2_avoided_g"), total("total_tokens").alias("tokens"))
    blended = F.round(F.try_divide((F.col("energy_wh") + F.col("energy_avoided_wh")) * 1000, F.col("tokens")), 6)
    return sums.select(*by, "energy_wh", "co2_g", "energy_avoided_wh", "co2_avoided_g", blended.alias("wh_per_1k_blended"), F.lit(basis).alias("basis"))


def report_header(audit: DataFrame, *by: str) -> DataFrame:
    """Sums for a report's head: what was scrubbed, and what was blocked."""
    return audit.groupBy(*by).agg(total("pii_count").alias("pii"), total("secret_count").alias("secrets"), F.sum(F.col("pii_count") + F.col("secret_count")).cast("long").alias("scrubbed"), count_if(F.col("policy_action") == "BLOCK").alias("blocked"))


def cube(audit: DataFrame, *keys: str) -> DataFrame:
    return audit.cube(*keys).agg(F.count("*").alias("n"), total("total_tokens").alias("tokens"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
