"""One technology's market: header, requirement levels, co-occurrence with lift, salaries, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.operators.market import QUARTILES, SALARY_BIN, midpoint, share
from vacancia.operators.quantiles import quantiles
from vacancia.sources.bindings import slug_of

#: Fewest jobs together, least lift, how many are listed.
LEAST_TOGETHER, LEAST_LIFT, TOP = 3, 1.3, 12


def headers(matching: DataFrame, job_technologies: DataFrame, technologies: DataFrame) -> DataFrame:
    """For each scope and technology: jobs analysed, jobs with it, by requirement level, and its share."""
    totals = matching.groupBy("scope_id").agg(F.count("*").alias("analyzed_jobs"))
    levels = [F.count_if(F.col("requirement") == r).alias(r) for r in ("required", "preferred", "mentioned")]
    rows = matching.select("scope_id", "job_id").join(job_technologies, "job_id").groupBy("scope_id", "tech_id").agg(F.count("*").alias("jobs_with_tech"), *levels)
    rows = rows.join(F.broadcast(totals), "scope_id").join(technologies.select("tech_id", "slug"), "tech_id")
    return rows.select("scope_id", "slug", "analyzed_jobs", "jobs_with_tech", "required", "preferred", "mentioned", share(F.col("jobs_with_tech"), F.col("analyzed_jobs")).alias("share"))


def co_occurrence(matching: DataFrame, job_technologies: DataFrame, technologies: DataFrame, top: int = TOP, least_lift: float = LEAST_LIFT) -> DataFrame:
    """For each scope and technology: others asked for together with it, with lift = P(other | it) / P(other).

    Pairs are made within a job, whose technologies are a short list, and summed before they are shuffled.
    """
    own = matching.select("scope_id", "job_id").join(job_technologies.select("job_id", "tech_id"), "job_id")
    listed = own.groupBy("scope_id", "job_id").agg(F.sort_array(F.collect_list("tech_id")).alias("ts"))
    pairs = listed.select("scope_id", F.explode("ts").alias("tech_id"), "ts").select("scope_id", "tech_id", F.explode("ts").alias("other_id")).where("tech_id <> other_id")
    together = pairs.groupBy("scope_id", "tech_id", "other_id").agg(F.count("*").alias("together")).where(F.col("together") >= LEAST_TOGETHER)
    singles = own.groupBy("scope_id", "tech_id").agg(F.count("*").alias("n")).join(F.broadcast(matching.groupBy("scope_id").agg(F.count("*").alias("total"))), "scope_id")
    rows = together.join(singles.select("scope_id", "tech_id", F.col("n").alias("n_tech"), "total"), ["scope_id", "tech_id"])
    rows = rows.join(singles.select("scope_id", F.col("tech_id").alias("other_id"), F.col("n").alias("n_other")), ["scope_id", "other_id"])
    rows = rows.withColumns({"share": share(F.col("together"), F.col("n_tech")), "lift": F.round(F.col("together").cast("double") * F.col("total") / (F.col("n_tech") * F.col("n_other")), 6)}).where(F.col("lift") >= least_lift)
    names = technologies.select("tech_id", "slug", "name")
    rows = rows.join(names.select("tech_id", "slug"), "tech_id").join(names.select(F.col("tech_id").alias("other_id"), F.col("slug").alias("other_slug"), F.col("name").alias("other_name")), "other_id")
    place = F.row_number().over(Window.partitionBy("scope_id", "slug").orderBy(F.desc("share"), "other_name"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("scope_id", "slug", "other_slug", "together", "share", "lift", "place")


def salaries(matching: DataFrame, everywhere: DataFrame, job_technologies: DataFrame, technologies: DataFrame) -> DataFrame:
    """For each scope and technology: quartiles of disclosed midpoints, and the median less that of the whole country."""
    paid = F.col("salary_annual_min").isNotNull()
    median = quantiles(everywhere.where(paid), [], midpoint(), (0.5,), SALARY_BIN).select(F.bround(F.get("p", F.lit(0)), 0).cast("long").alias("national"))  # a row at most
    rows = matching.where(paid).select("scope_id", "job_id", "salary_annual_min", "salary_annual_max").join(job_technologies.select("job_id", "tech_id"), "job_id")
    rows = quantiles(rows, ["scope_id", "tech_id"], midpoint(), QUARTILES, SALARY_BIN).join(technologies.select("tech_id", "slug"), "tech_id")
    named = [F.bround(F.get("p", i), 0).cast("long").alias(n) for i, n in enumerate(("p25", "median", "p75"))]
    rows = rows.select("scope_id", "slug", F.col("n").alias("disclosed"), *named).join(F.broadcast(median), F.lit(True), "left")
    return rows.withColumn("delta", F.col("median") - F.col("national")).drop("national")


def alias_lookup(requested: DataFrame, aliases: DataFrame) -> DataFrame:
    """request and the slug of the technology whose alias has the same slug form; the lowest alias id wins."""
    filed = aliases.groupBy(slug_of(F.col("alias")).alias("key")).agg(F.min_by("slug", "alias_id").alias("slug"))
    return requested.select("request", slug_of(F.col("request")).alias("key")).join(filed, "key", "left").select("request", "slug")
