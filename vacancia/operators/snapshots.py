"""Snapshots: jobs by technology, title family and metro; metros of all jobs in one cell join; trends with a fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.functions import geo

CELL = 0.5
NATIONAL = "national"


def busiest_metros(jobs: DataFrame, locations: DataFrame, cities: DataFrame, top: int = 30) -> DataFrame:
    """The metros with most active jobs that the city table knows (copies count: not through the predicate)."""
    active = locations.where(F.col("city").isNotNull()).join(jobs.where("status = 'active'").select("job_id"), "job_id", "left_semi")
    counts = active.select("job_id", "city", "region").distinct().groupBy("city", "region").agg(F.count("*").alias("job_count"))
    best = counts.orderBy(F.desc("job_count"), "city", "region").limit(top)
    known = cities.select(F.lower("city").alias("_city"), F.col("region").alias("_region"), "city_slug", "lat", "lon")
    return best.join(F.broadcast(known), (F.lower("city") == F.col("_city")) & (F.col("region") == F.col("_region"))).select("city", "region", "job_count", "city_slug", "lat", "lon")


def metro_members(locations: DataFrame, metros: DataFrame, miles: int) -> DataFrame:
    """geo (metro slug) and job_id of every job with a place within the radius: an equi-join on cells, then the exact distance.

    A metro is filed under every cell that its radius can reach; metros are a short list (the busiest), places may be many:
    cells are sent to where the places lie, so that these stay dealt out by job.
    """
    reach = miles * geo.MILE / 110_000.0  # degrees of latitude, a little generous
    lat_cells = F.sequence(F.floor((F.col("lat") - reach) / CELL), F.floor((F.col("lat") + reach) / CELL))
    wide = F.lit(reach) / F.greatest(F.lit(0.05), F.cos(F.radians(F.abs("lat") + reach)))
    lon_cells = F.sequence(F.floor((F.col("lon") - wide) / CELL), F.floor((F.col("lon") + wide) / CELL))
    filed = metros.select(F.col("city_slug").alias("geo"), F.col("lat").alias("m_lat"), F.col("lon").alias("m_lon"), F.explode(lat_cells).alias("x"), lon_cells.alias("ys")).select("geo", "m_lat", "m_lon", "x", F.explode("ys").alias("y"))
    spots = locations.where(F.col("lat").isNotNull()).select("job_id", "lat", "lon", F.floor(F.col("lat") / CELL).alias("x"), F.floor(F.col("lon") / CELL).alias("y"))
    near = geo.distance(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon")) <= miles * geo.MILE
    return spots.join(F.broadcast(filed), ["x", "y"]).where(near).select("geo", "job_id").distinct()


def snapshot(matching: DataFrame, job_technologies: DataFrame, members: DataFrame) -> DataFrame:
    """geo, tech_id, title_id (NULL: all families), job_count: technology totals and per-family detail in one pass.

    Jobs without a family count in the totals but make no detail row.
    """
    jobs = matching.select("job_id", "title_id")
    placed = jobs.join(members, "job_id").unionByName(jobs.withColumn("geo", F.lit(NATIONAL)))
    facts = placed.join(job_technologies.select("job_id", "tech_id"), "job_id")
    rows = facts.groupingSets([["geo", "tech_id"], ["geo", "tech_id", "title_id"]], "geo", "tech_id", "title_id").agg(F.count("*").alias("job_count"), F.grouping_id().alias("_all"))
    return rows.where((F.col("_all") > 0) | F.col("title_id").isNotNull()).select("geo", "tech_id", "title_id", "job_count")


def write_day(rows: DataFrame, path: str, day: str) -> None:
    """Replace one day's snapshot and leave the others; running it again gives the same."""
    dated = rows.withColumn("snapshot_date", F.lit(day).cast("date"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def run_record(matching: DataFrame, jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """active_jobs (through the predicate) and the sorted names of the sources of all active jobs."""
    n = matching.agg(F.count("*").alias("active_jobs"))
    names = jobs.where("status = 'active'").select("source_id").distinct().join(sources, "source_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("sources"))
    return n.join(names)  # one row and one row


def trends(history: DataFrame, asked: DataFrame) -> DataFrame:
    """The series of each asked (geo, tech_id); where the place has no rows, the national one, flagged."""
    pairs = asked.select(F.col("geo").alias("asked"), "tech_id")
    both = pairs.select("asked", "tech_id", F.col("asked").alias("geo"), F.lit(0).alias("rank")).unionByName(pairs.select("asked", "tech_id", F.lit(NATIONAL).alias("geo"), F.lit(1).alias("rank")))
    rows = history.join(F.broadcast(both), ["geo", "tech_id"]).withColumn("best", F.min("rank").over(Window.partitionBy("asked", "tech_id")))
    return rows.where("rank = best").select("asked", "tech_id", "day", "job_count", (F.col("rank") == 1).alias("national_fallback")).distinct()
