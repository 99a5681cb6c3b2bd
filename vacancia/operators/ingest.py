"""Postings between runs: change detection by content hash, expiry by absence, run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRACE_DAYS = 3


def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The new state of all postings, with the outcome of each: new, updated, unchanged, or NULL if it wasn't seen.

    stored: source_id, external_id, content_hash, payload, status, extractor_version, first_seen_at, last_seen_at;
    incoming: source_id, external_id, content_hash, payload, seen_at (of several sightings the last counts). A changed
    payload is extracted again (extractor_version NULL); whatever is seen is active.
    """
    key = ["source_id", "external_id"]
    last = incoming.groupBy(*key).agg(F.max(F.struct("seen_at", "content_hash", "payload")).alias("i"), F.min("seen_at").alias("_first"))
    both = stored.join(last, key, "full_outer")
    seen, known = F.col("i").isNotNull(), F.col("first_seen_at").isNotNull()
    same = F.col("content_hash").eqNullSafe(F.col("i.content_hash"))
    outcome = F.when(seen & ~known, "new").when(seen & same, "unchanged").when(seen, "updated")
    return both.select(
        *key, F.coalesce("i.content_hash", "content_hash").alias("content_hash"), F.coalesce("i.payload", "payload").alias("payload"), F.when(seen, "active").otherwise(F.col("status")).alias("status"),
        F.when(~seen | (known & same), F.col("extractor_version")).alias("extractor_version"), F.coalesce("first_seen_at", "_first").alias("first_seen_at"), F.greatest("last_seen_at", "i.seen_at").alias("last_seen_at"), outcome.alias("outcome"),
    )


def counters(merged: DataFrame) -> DataFrame:
    """For each source: fetched, new, updated, unchanged."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return merged.where(F.col("outcome").isNotNull()).groupBy("source_id").agg(F.count("*").alias("fetched"), n("new"), n("updated"), n("unchanged"))


def healthy_sources(runs: DataFrame, now, grace_days: int = GRACE_DAYS) -> DataFrame:
    """Sources whose latest successful run ended within the grace period."""
    latest = runs.where("status = 'succeeded'").groupBy("source_id").agg(F.max("finished_at").alias("last_success"))
    return latest.where(F.col("last_success") >= F.lit(now) - F.make_dt_interval(F.lit(grace_days)))


def expire(postings: DataFrame, runs: DataFrame, now, grace_days: int = GRACE_DAYS) -> DataFrame:
    """postings with status 'expired' where an active one wasn't seen for the grace period though its source was healthy."""
    healthy = healthy_sources(runs, now, grace_days).select("source_id", F.lit(True).alias("_healthy"))
    stale = (F.col("status") == "active") & (F.col("last_seen_at") < F.lit(now) - F.make_dt_interval(F.lit(grace_days))) & F.col("_healthy")
    return postings.join(F.broadcast(healthy), "source_id", "left").withColumn("status", F.when(stale, "expired").otherwise(F.col("status"))).drop("_healthy")  # a row for each source


def run_status(errors: DataFrame) -> DataFrame:
    """For each source: errors, status (succeeded while fewer than its boards failed) and the joined messages, 4000 characters at most.

    errors: source_id, boards, message (NULL: no error)."""
    out = errors.groupBy("source_id").agg(F.max("boards").alias("boards"), F.count("message").alias("errors"), F.substring(F.array_join(F.array_sort(F.collect_list("message")), "\n"), 1, 4000).alias("error_detail"))
    return out.withColumn("status", F.when(F.col("errors") < F.greatest("boards", F.lit(1)), "succeeded").otherwise("failed"))


def seed_companies(stored: DataFrame, seeds: DataFrame) -> DataFrame:
    """Companies of a seed list that aren't stored yet, by (ats_type, ats_token), with a normalised name and NULL for an empty domain."""
    fresh = seeds.dropDuplicates(["ats_type", "ats_token"]).join(stored.select("ats_type", "ats_token"), ["ats_type", "ats_token"], "left_anti")
    return fresh.select("name", F.lower(F.trim("name")).alias("name_normalized"), "ats_type", "ats_token", F.nullif(F.trim("domain"), F.lit("")).alias("domain"))


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Insert or overwrite by key; nothing is deleted."""
    values = [c for c in stored.columns if c not in key]
    both = stored.join(incoming.select(*key, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_in")), key, "full_outer")
    return both.select(*key, *[F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values])
