"""Extraction runs over postings: what is due, batches that can be resumed, counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions import text as T
from vacancia.operators import titles

#: Batches of a run: slices of the ids by hash, so that their number doesn't grow with the jobs.
SLICES = 8


def facts(postings: DataFrame) -> DataFrame:
    """job_id, level (of the title, else by years), years, arrangement, salary from job_id, title, text."""
    years = T.years(F.col("text"))
    return postings.select(
        "job_id", T.job_level(titles.level(F.col("title")), years).alias("level"), years.alias("years"), T.arrangement(F.col("text"), F.lit(False)).alias("arrangement"), T.salary(F.col("text")).alias("salary"),
    )


def run(postings: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame] = facts, slices: int = SLICES, most: int | None = None) -> int:
    """Extract what ``path`` lacks, one slice after another; returns how many slices were done now (at most ``most``).

    A slice is written as a whole, so a run that breaks off leaves finished slices, which the next run skips, and nothing of
    the one it was at. Within a slice, ids that are extracted already are left out: later postings get a later slice of their own.
    """
    spark, done = postings.sparkSession, 0
    number = F.pmod(F.xxhash64("job_id"), F.lit(slices))
    for k in range(slices):
        if most is not None and done >= most:
            break
        due, own = postings.where(number == k), f"{path}/slice={k}"
        seen = _written(spark, own)
        if seen is not None:
            due = due.join(seen.select("job_id"), "job_id", "left_anti")
        if due.isEmpty():
            continue
        extract(due).write.mode("append").parquet(own)
        done += 1
    return done


def extracted(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/slice=*")


def _written(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def counters(found: DataFrame) -> DataFrame:
    """One row: processed, with_level, with_years, with_arrangement, with_salary."""
    has = lambda c: F.count_if(F.col(c).isNotNull()).alias(f"with_{c}")
    return found.agg(F.count("*").alias("processed"), *[has(c) for c in ("level", "years", "arrangement", "salary")])


def ungeocoded(locations: DataFrame, redo: bool = False) -> DataFrame:
    """raw_text, n_locations: the distinct place texts that have no coordinates yet, or all where ``redo``."""
    rows = locations.where(F.col("raw_text").isNotNull())
    rows = rows if redo else rows.where(F.col("lat").isNull())
    return rows.groupBy("raw_text").agg(F.count("*").alias("n_locations"))


def with_titles(jobs: DataFrame, families: DataFrame) -> DataFrame:
    """jobs with title_slug of their title family; NULL without one. families: title_id, title_slug."""
    return jobs.join(families, "title_id", "left")


def summaries(ids: DataFrame, jobs: DataFrame, families: DataFrame, companies: DataFrame, locations: DataFrame, technologies: DataFrame) -> DataFrame:
    """Facts of the jobs in ``ids`` (job_id): title_slug, company, places, and technologies by requirement, each sorted.

    The ids cut every table before it is grouped.
    """
    wanted = ids.select("job_id").distinct()
    own = with_titles(jobs.join(wanted, "job_id", "left_semi"), families).join(companies.withColumnRenamed("name", "company"), "company_id", "left")
    places = locations.join(wanted, "job_id", "left_semi").groupBy("job_id").agg(_sorted(F.col("city")).alias("places"))
    each = [_sorted(F.when(F.col("requirement") == r, F.col("slug"))).alias(r) for r in ("required", "preferred", "mentioned")]
    techs = technologies.join(wanted, "job_id", "left_semi").groupBy("job_id").agg(*each)
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("places", "required", "preferred", "mentioned")]
    return own.join(places, "job_id", "left").join(techs, "job_id", "left").select("job_id", "title_slug", "company", "experience_level", *blank)


def _sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def enabled_postings(feeds: dict[str, DataFrame], sources: DataFrame) -> DataFrame:
    """One set of postings from all feeds (by source name) whose source is enabled, with source_id. sources: source_id, name, enabled."""
    rows = None
    for name, feed in feeds.items():
        own = feed.withColumn("source_name", F.lit(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    on = sources.where("enabled").select("source_id", F.col("name").alias("source_name"))
    return rows.join(on, "source_name")
