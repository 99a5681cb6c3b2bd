"""Listing: sort keys, keyset pages, relaxation of filters that leave nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions import geo
from vacancia.plans.predicate import BUCKETS, Scope, conditions, flagged_jobs, resolve
from vacancia.sources.bindings import Market


def sort_key(sort: str) -> Column:
    """Descending keys; ties go to the higher job_id."""
    if sort == "recency":
        return F.unix_micros(F.coalesce(F.col("posted_at").cast("timestamp"), F.timestamp_micros(F.lit(0)))).alias("sort_key")
    if sort == "salary":
        return F.coalesce(F.col("salary_annual_max"), F.lit(-1)).cast("decimal(14,2)").alias("sort_key")
    if sort == "relevance":  # of rows with their rank for a text query
        return F.col("rank").alias("sort_key")
    raise ValueError(f"no sort {sort}")


def page(matching: DataFrame, sort: str, limit: int, after: tuple | None = None) -> DataFrame:
    """The next ``limit`` + 1 jobs after the cursor (key, job_id); the last one only tells that there are more."""
    rows = matching.select("job_id", sort_key(sort))
    if after is not None:
        rows = rows.where(F.struct("sort_key", "job_id") < F.struct(F.lit(after[0]).cast(rows.schema["sort_key"].dataType), F.lit(after[1]).cast("long")))
    return rows.orderBy(F.desc("sort_key"), F.desc("job_id")).limit(limit + 1)


def relaxations(market: Market, scope: Scope) -> DataFrame:
    """option and job_count of each single relaxation that helps: the first wider radius that does, no salary floor, each of
    the first four technologies dropped. One pass over the jobs, conditional counts of "all but this one"."""
    known = resolve(market, [scope])
    tests = conditions(scope, known)
    named = {k: f"c{i}" for i, k in enumerate(tests)}
    wider = [b for b in BUCKETS if scope.location and b > scope.radius_miles]
    jobs = flagged_jobs(market, known).select(*[c.alias(named[k]) for k, c in tests.items()], *[F.coalesce(F.col(known.near(scope.location)) <= b * geo.MILE, F.lit(False)).alias(f"r{b}") for b in wider])

    def but(*gone: str, also: Column | None = None) -> Column:
        fits = F.lit(True) if also is None else also
        for k, name in named.items():
            if k not in gone:
                fits = fits & F.col(name)
        return F.count_if(fits)

    options = {f"radius:{b}": but("location", also=F.col(f"r{b}")) for b in wider}
    if scope.salary_min is not None:
        options["salary_min"] = but("salary_min")
    options |= {f"technology:{t}": but(f"technology:{t}") for t in scope.technologies[:4]}
    if not options:
        return market.spark.createDataFrame([], "option string, job_count long")
    counts = jobs.agg(*[c.alias(f"n{i}") for i, c in enumerate(options.values())])
    listed = F.array(*[F.struct(F.lit(k).alias("option"), F.col(f"n{i}").alias("job_count")) for i, k in enumerate(options)])
    helps = F.filter(listed, lambda x: x["job_count"] > 0)
    radius = F.filter(helps, lambda x: x["option"].startswith("radius:"))
    rest = F.filter(helps, lambda x: ~x["option"].startswith("radius:"))
    return counts.select(F.inline(F.concat(F.slice(radius, 1, 1), rest)))
