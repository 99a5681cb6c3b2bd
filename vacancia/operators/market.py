"""The dashboard over a scope: counts, salaries, technology demand, distributions, companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.operators.quantiles import quantiles

#: A scope with fewer jobs is flagged; technologies listed for a category; companies listed.
LOW_CONFIDENCE, TOP_IN_CATEGORY, TOP_COMPANIES = 30, 12, 10
QUARTILES, SALARY_BIN = (0.25, 0.5, 0.75), 500.0
DIMENSIONS = ("arrangement", "experience_level", "employment_type")


def midpoint() -> Column:
    return ((F.col("salary_annual_min") + F.coalesce("salary_annual_max", "salary_annual_min")) / 2).cast("double")


def summary(matching: DataFrame) -> DataFrame:
    """For each scope: analyzed_jobs, low_confidence, disclosed, and p25, median, p75 of the disclosed midpoints (half-even)."""
    disclosed = F.when(F.col("salary_annual_min").isNotNull(), midpoint())
    out = quantiles(matching, ["scope_id"], disclosed, QUARTILES, SALARY_BIN)
    named = [F.bround(F.get("p", F.lit(i)), 0).cast("long").alias(n) for i, n in enumerate(("p25", "median", "p75"))]
    return out.select("scope_id", F.col("n_rows").alias("analyzed_jobs"), (F.col("n_rows") < LOW_CONFIDENCE).alias("low_confidence"), F.col("n").alias("disclosed"), *named)


def demand(matching: DataFrame, job_technologies: DataFrame, technologies: DataFrame, top: int = TOP_IN_CATEGORY) -> DataFrame:
    """Technologies by category: jobs that ask for them, of which required, share of all jobs of the scope; the first ``top``.

    technologies_in_category counts all that occur, listed or not.
    """
    totals = matching.groupBy("scope_id").agg(F.count("*").alias("analyzed_jobs"))
    counts = (
        matching.select("scope_id", "job_id").join(job_technologies, "job_id").groupBy("scope_id", "tech_id")
        .agg(F.count("*").alias("job_count"), F.count_if(F.col("requirement") == "required").alias("required_count"))
    )
    rows = counts.join(technologies, "tech_id").join(F.broadcast(totals), "scope_id")  # totals: a row for each scope
    category = Window.partitionBy("scope_id", "category")
    rows = rows.withColumns({
        "place": F.row_number().over(category.orderBy(F.desc("job_count"), "name")), "technologies_in_category": F.count("*").over(category),
        "share": share(F.col("job_count"), F.col("analyzed_jobs")),
    })
    return rows.where(F.col("place") <= top).select("scope_id", "category", "place", "slug", "name", "job_count", "required_count", "share", "analyzed_jobs", "technologies_in_category", (F.col("analyzed_jobs") < LOW_CONFIDENCE).alias("low_confidence"))


def share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)), 6)


def distributions(matching: DataFrame) -> DataFrame:
    """Jobs by value of each dimension, NULL as 'unspecified': one pass over all dimensions."""
    named = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(d, F.lit("unspecified")).alias("value")) for d in DIMENSIONS]))
    counts = matching.select("scope_id", named.alias("d")).groupBy("scope_id", "d.dimension", "d.value").agg(F.count("*").alias("job_count"))
    each = Window.partitionBy("scope_id", "dimension")
    return counts.select("scope_id", "dimension", "value", "job_count", share(F.col("job_count"), F.sum("job_count").over(each)).alias("share"), F.row_number().over(each.orderBy(F.desc("job_count"), "value")).alias("place"))


def top_companies(matching: DataFrame, companies: DataFrame, top: int = TOP_COMPANIES) -> DataFrame:
    """Companies by jobs; those of one name count together."""
    counts = matching.select("scope_id", "company_id").join(companies, "company_id").groupBy("scope_id", "name").agg(F.count("*").alias("job_count"))
    place = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("job_count"), "name"))
    return counts.withColumn("place", place).where(F.col("place") <= top)


def top_skills(listed: DataFrame, top: int = 8) -> DataFrame:
    """The first technologies of a scope across its categories, from what demand() lists."""
    place = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("job_count"), "category", "name"))
    return listed.select("scope_id", "category", "slug", "name", "job_count", place.alias("place")).where(F.col("place") <= top)
