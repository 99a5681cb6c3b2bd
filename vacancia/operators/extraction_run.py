"""A whole extraction run: what is due, everything that a posting gets from one pass, counters, resuming, applying.

A run takes the postings whose extractor_version is NULL or older and whose content this version hasn't extracted yet. They
are cut into slices of bounded bytes (by the hash of job_id). A slice becomes one nested row for each posting (facts, title,
sections, technologies, what is to be reviewed), written as one batch; a batch counts once it is complete, so a run that
breaks off loses the slice that it was at and nothing else. Of several batches a posting's last one holds: its technologies and
sections are replaced as a whole. A posting that changed has other content and is extracted again.

postings: job_id (their key), title, text, location_is_remote, arrangement, experience_level, employment_type (declared),
salary_annual_min, extractor_version; what the source or an earlier run knew is kept where the text says nothing. Nulls: a NULL title
or text has no facts of its own; a NULL job_id is extracted like others and never found to be done.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vacancia.functions import text as T
from vacancia.operators import mentions, text, titles
from vacancia.sources import stored

VERSION = 1
#: Bytes of text of a slice: what a run that breaks off can lose.
SLICE_BYTES = 64 << 30
CONTENT = ("title", "text", "location_is_remote", "employment_type")
COUNTERS = ("processed", "with_technologies", "titles_resolved", "salaries_new")


@dataclass(frozen=True)
class Taxonomy:
    """technologies: alias, slug, case_sensitive, require_context; titles: alias (lower case), slug."""

    technologies: DataFrame
    titles: DataFrame


def content() -> Column:
    """The hash of what extraction reads of a posting."""
    return F.sha2(F.to_json(F.struct(*CONTENT)), 256)


def due(postings: DataFrame, path: str, version: int = VERSION) -> DataFrame:
    """The postings to extract, with their content."""
    pending = postings.where(F.col("extractor_version").isNull() | (F.col("extractor_version") < version)).withColumn("content", content())
    done = _read(postings.sparkSession, path)
    if done is None:
        return pending
    done = done.where(F.col("version") == version).select("job_id", "content").distinct()
    return pending.join(done, ["job_id", "content"], "left_anti")


def run(postings: DataFrame, taxonomy: Taxonomy, path: str, version: int = VERSION, slice_bytes: int = SLICE_BYTES, most: int | None = None) -> dict[str, int]:
    """Extract what is due, at most ``most`` slices of it; the counters of what was done now."""
    spark = postings.sparkSession
    rows = due(postings, path, version)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    slices, totals = max(1, -(-size // slice_bytes)), dict.fromkeys(COUNTERS, 0)
    batch = max([0, *_batches(spark, path)[1]])
    for k in range(slices if size else 0):
        if most is not None and k >= most:
            break
        own = rows.where(F.pmod(F.xxhash64("job_id"), F.lit(slices)) == k) if slices > 1 else rows
        batch += 1
        for name, n in _slice(own, taxonomy, f"{path}/batch={batch}", version).items():
            totals[name] += n
    return totals


def _slice(own: DataFrame, taxonomy: Taxonomy, path: str, version: int) -> dict[str, int]:
    """Extract a slice and write it; its counters are observed while it is written."""
    own = _written(own, "extraction-slice")  # read by each part below, and not due any more once the batch is there
    seen = Observation()
    has = lambda c: F.count_if(F.size(c) > 0)
    out = extracted(own, taxonomy).withColumn("version", F.lit(version))
    counted = out.observe(seen, F.count(F.lit(1)).alias("processed"), has("technologies").alias("with_technologies"), F.count("title_slug").alias("titles_resolved"), F.count("salary").alias("salaries_new"))
    counted.write.parquet(path)
    return {name: int(seen.get[name] or 0) for name in COUNTERS}


def extracted(own: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """One row for each posting: job_id, content, facts, title_slug, sections, technologies, review."""
    spans = _written(text.sections(own, "job_id"), "extraction-sections")
    hits = _written(mentions.find(own, taxonomy.technologies, "job_id"), "extraction-hits")
    scored = mentions.with_levels(mentions.score(hits, "job_id"), hits, spans, "job_id")
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    found = scored.groupBy("job_id").agg(
        F.array_compact(listed(F.when(F.col("route") == "accept", F.struct("slug", "level", "confidence", "occurrences", "evidence", "evidence_start")).alias("x"))).alias("accepted"),
        F.array_compact(listed(F.when(F.col("route") == "review", F.struct("slug", "evidence")).alias("x"))).alias("doubtful"),
    )
    found = found.select(
        "job_id", F.transform(F.filter("accepted", lambda t: t["x"].isNotNull()), lambda t: t["x"]).alias("technologies"),
        F.transform(F.filter("doubtful", lambda t: t["x"].isNotNull()), lambda t: F.struct(F.lit("technology").alias("kind"), t["x"]["slug"].alias("value"), t["x"]["evidence"].alias("context"))).alias("doubts"),
    )
    parts = spans.groupBy("job_id").agg(listed("start", "end", "kind").alias("sections"))
    named = titles.resolved(own.select("title"), taxonomy.titles).select("title", F.col("slug").alias("title_slug"), "normalized")
    years = T.years(F.col("text"))
    level = T.job_level(titles.level(F.col("title")), years)
    fresh = F.col("salary_annual_min").isNull()
    facts = own.select(
        "job_id", "content", "title", F.coalesce(T.arrangement(F.col("text"), F.col("location_is_remote")), "arrangement").alias("arrangement"), years.alias("years_of_experience"), F.coalesce(level, "experience_level").alias("experience_level"),
        F.coalesce(T.employment_type(F.col("title"), F.col("text"), F.col("employment_type")), "employment_type").alias("employment_type"), F.when(fresh, T.salary(F.col("text"))).alias("salary"),
    )
    unnamed = F.when(F.col("title_slug").isNull() & F.col("normalized").isNotNull() & (F.col("normalized") != ""), F.array(F.struct(F.lit("title").alias("kind"), F.col("normalized").alias("value"), F.col("title").alias("context"))))
    rows = facts.join(named, "title", "left").join(found, "job_id", "left").join(parts, "job_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    reviewed = "array<struct<kind: string, value: string, context: string>>"
    return rows.select(
        "job_id", "content", "arrangement", "years_of_experience", "experience_level", "employment_type", "salary", "title_slug",
        empty("sections", rows.schema["sections"].dataType).alias("sections"), empty("technologies", rows.schema["technologies"].dataType).alias("technologies"),
        F.concat(empty("doubts", reviewed), empty(unnamed, reviewed)).alias("review"),
    )


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last extraction of each posting, with its batch."""
    rows = _read(spark, path)
    if rows is None:
        raise ValueError(f"no complete batch at {path}")
    last = rows.groupBy("job_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["job_id", "batch"], "left_semi")


def technologies(rows: DataFrame) -> DataFrame:
    """job_id, slug, level, confidence, occurrences, evidence, evidence_start."""
    return rows.select("job_id", F.inline("technologies"))


def sections(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", F.inline("sections"))


def sightings(rows: DataFrame) -> DataFrame:
    """kind, value, context, job_id: for the review queue. Give it the batches of one run, so that each counts once."""
    return rows.select("job_id", F.inline("review"))


def applied(postings: DataFrame, rows: DataFrame, version: int = VERSION) -> DataFrame:
    """postings with what was extracted; salaries that were known stay."""
    new = rows.select("job_id", *[F.col(c).alias(f"_{c}") for c in ("arrangement", "years_of_experience", "experience_level", "employment_type", "salary", "title_slug")], F.lit(True).alias("_done"))
    both = postings.join(new, "job_id", "left")
    taken = {c: F.when(F.col("_done"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("arrangement", "experience_level", "employment_type")}
    more = {
        "salary_annual_min": F.coalesce("salary_annual_min", "_salary.annual_min"), "years_of_experience": F.col("_years_of_experience"), "title_slug": F.col("_title_slug"),
        "extractor_version": F.when(F.col("_done"), F.lit(version)).otherwise(F.col("extractor_version")),
    }
    return both.withColumns(taken | more).select(*postings.columns, *[c for c in ("years_of_experience", "title_slug") if c not in postings.columns])


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = stored.fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _batches(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The numbers of the complete batches, and of all that were begun."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return [], []
    begun = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("batch=")]
    number = lambda p: int(p.getName().split("=")[1])
    return sorted(number(p) for p in begun if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), sorted(map(number, begun))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    complete, _ = _batches(spark, path)
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in complete]) if complete else None
