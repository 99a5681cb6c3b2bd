"""The review queue: sightings counted between runs, a zero-filled summary, the listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
KINDS, STATUSES = ("title", "technology"), ("pending", "resolved", "dismissed")
VALUE_CHARS, CONTEXT_CHARS = 300, 500


def accumulate(queue: DataFrame, sightings: DataFrame) -> DataFrame:
    """kind, value, example_context, occurrences, status after the sightings (kind, value, context, job_id).

    A resolved value that is seen again is pending again; a dismissed one stays; the first context is kept.
    """
    seen = sightings.select("kind", F.substring("value", 1, VALUE_CHARS).alias("value"), F.substring("context", 1, CONTEXT_CHARS).alias("context"), "job_id")
    seen = seen.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min_by("context", "job_id").alias("context"))
    both = queue.join(seen, ["kind", "value"], "full_outer")
    status = F.when(F.col("status").isNull(), "pending").when(F.col("n").isNotNull() & (F.col("status") == "resolved"), "pending").otherwise(F.col("status"))
    return both.select("kind", "value", F.coalesce("example_context", "context").alias("example_context"), (F.coalesce("occurrences", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("occurrences"), status.alias("status"))


def summary(queue: DataFrame) -> DataFrame:
    """Items for every kind and status, 0 where there are none."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("status")) for k in KINDS for s in STATUSES]))
    grid = queue.sparkSession.range(1).select(pairs.alias("g")).select("g.*")
    return grid.join(queue.groupBy("kind", "status").agg(F.count("*").alias("n")), ["kind", "status"], "left").select("kind", "status", F.coalesce("n", F.lit(0)).alias("items"))


def listing(queue: DataFrame, kind: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    if (kind and kind not in KINDS) or (status and status not in STATUSES):
        raise ValueError(f"no such kind or status: {kind}, {status}")
    rows = queue.where((F.col("kind") == kind) if kind else F.lit(True)).where((F.col("status") == status) if status else F.lit(True))
    return rows.orderBy(F.desc("occurrences"), "kind", "value").limit(limit)


def missing(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is asked for but not known; an update checks that this is empty."""
    return asked.select(key).distinct().join(known.select(key), key, "left_anti")
