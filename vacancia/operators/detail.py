"""Listings around jobs and profiles: details, masks, vocabularies, counts, and what is kept between extractions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators.matching import level_of, level_rank

#: Technologies in this order of requirement; degrees from low to high.
REQUIREMENTS, DEGREES = ("required", "preferred", "mentioned"), ("associate", "bachelor", "master", "doctorate")


def masked(jobs: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """jobs with the text columns NULL unless their source may be shown in full."""
    rows = jobs.join(F.broadcast(sources.select("source_id", "display_policy")), "source_id")  # a row for each source
    return rows.withColumns({c: F.when(F.col("display_policy") == "full_text", F.col(c)) for c in columns}).drop("display_policy")


def job_lists(job_technologies: DataFrame, technologies: DataFrame) -> DataFrame:
    """job_id, technologies: names by requirement, then by lower-case name, joined; a job's list is short."""
    rank = F.array_position(F.array(*[F.lit(r) for r in REQUIREMENTS]), F.col("requirement"))
    rows = job_technologies.join(technologies.select("tech_id", "name"), "tech_id")
    listed = rows.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.lower("name").alias("low"), "name", "requirement"))).alias("ts"))
    return listed.select("job_id", F.array_join(F.transform("ts", lambda t: F.concat_ws(":", t["name"], t["requirement"])), ",").alias("technologies"))


def job_details(jobs: DataFrame, extracted: DataFrame, technologies: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """jobs with technologies (slug, name, category, level, confidence, evidence, evidence_start; by falling confidence, then
    name) and sections (kind, start, end; by start), as a posting's page lists them.

    extracted: job_id, technologies and sections as an extraction run leaves them; technologies: slug, name, category. ``ids``
    (job_id) cut everything before it is joined. A job that wasn't extracted, or has none, has empty lists.
    """
    if ids is not None:
        jobs, extracted = (t.join(ids.select("job_id").distinct(), "job_id", "left_semi") for t in (jobs, extracted))
    rows = extracted.select("job_id", F.inline("technologies")).join(technologies.select("slug", "name", "category"), "slug")
    fields = F.struct("slug", "name", "category", "level", "confidence", "evidence", "evidence_start")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("by"), "name", fields.alias("t"))))  # a job's list is short
    named = rows.groupBy("job_id").agg(F.transform(listed, lambda x: x["t"]).alias("technologies"))
    spans = extracted.select("job_id", F.array_sort(F.transform("sections", lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias("s"))
    spans = spans.select("job_id", F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("sections"))
    out = jobs.join(named, "job_id", "left").join(spans, "job_id", "left")
    none = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("technologies", "sections")}
    return out.withColumns(none)


def owned(rows: DataFrame, user_id) -> DataFrame:
    """Only the caller's rows."""
    return rows.where(F.col("user_id") == user_id)


def profile_counts(profiles: DataFrame, skills: DataFrame, experiences: DataFrame) -> DataFrame:
    """profiles with how many skills and experiences each has."""
    n = lambda t, name: t.groupBy("profile_id").agg(F.count("*").alias(name))
    rows = profiles.join(n(skills, "skills"), "profile_id", "left").join(n(experiences, "experiences"), "profile_id", "left")
    return rows.fillna(0, ["skills", "experiences"])


def profile_summary(profiles: DataFrame, skills: DataFrame, titles: DataFrame, degrees: DataFrame) -> DataFrame:
    """profile_id, mapped and unmapped skills, families, effective level and highest degree."""
    mapped = skills.groupBy("profile_id").agg(F.count("tech_id").alias("mapped"), F.count_if(F.col("tech_id").isNull()).alias("unmapped"))
    families = titles.groupBy("profile_id").agg(F.array_join(F.array_sort(F.collect_set("title_id")).cast("array<string>"), ",").alias("families"))
    rank = F.array_position(F.array(*[F.lit(d) for d in DEGREES]), F.col("degree"))
    highest = degrees.groupBy("profile_id").agg(F.max_by("degree", rank).alias("degree"))
    rows = profiles.join(mapped, "profile_id", "left").join(families, "profile_id", "left").join(highest, "profile_id", "left").fillna(0, ["mapped", "unmapped"])
    return rows.select("profile_id", "mapped", "unmapped", F.coalesce("families", F.lit("")).alias("families"), level_of(level_rank(F.col("level")), F.col("years")).alias("level"), "degree")


def vocabulary(technologies: DataFrame, titles: DataFrame, metros: DataFrame) -> DataFrame:
    """kind, slug, label of all that filters may name."""
    named = lambda df, kind, slug, label: df.select(F.lit(kind).alias("kind"), F.col(slug).alias("slug"), F.col(label).alias("label"))
    places = metros.withColumn("label", F.concat_ws(", ", "city", "region"))
    return named(technologies, "technology", "slug", "name").union(named(titles, "title", "slug", "slug")).union(named(places, "location", "city_slug", "label"))


def kept_facts(old: DataFrame, new: DataFrame, recompute: bool = False) -> DataFrame:
    """Facts after another extraction: what the new one lacks stays, a stored salary stays, years are overwritten.

    ``recompute`` takes the new ones as they are.
    """
    n = new.select("job_id", *[F.col(c).alias(f"_{c}") for c in ("arrangement", "level", "employment_type", "salary", "years")])
    both = old.join(n, "job_id")
    if recompute:
        return both.select("job_id", *[F.col(f"_{c}").alias(c) for c in ("arrangement", "level", "employment_type", "salary", "years")])
    merged = [F.coalesce(f"_{c}", c).alias(c) for c in ("arrangement", "level", "employment_type")]
    return both.select("job_id", *merged, F.coalesce("salary", "_salary").alias("salary"), F.col("_years").alias("years"))


def requeued(jobs: DataFrame) -> DataFrame:
    """jobs with extractor_version NULL where they are active, extracted and without a family; ``requeued`` tells which."""
    again = (F.col("status") == "active") & F.col("title_id").isNull() & F.col("extractor_version").isNotNull()
    return jobs.withColumns({"requeued": again, "extractor_version": F.when(~again, F.col("extractor_version"))})


def pending(jobs: DataFrame, version: int, limit: int | None = None) -> DataFrame:
    """Jobs that no extractor or an older one has seen, by id."""
    rows = jobs.where(F.col("extractor_version").isNull() | (F.col("extractor_version") < version))
    return rows if limit is None else rows.orderBy("job_id").limit(limit)


class Analyses:
    """Materialised results keyed by (data version, scope key): the first write wins, another version starts afresh."""

    def __init__(self, spark: SparkSession, path: str, version: int):
        self.spark, self.path = spark, f"{path}/data_version={version}"

    def read(self, key: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/cache_key={key}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def get(self, key: str, compute) -> DataFrame:
        """The stored rows, or those of ``compute()``, which are stored."""
        found = self.read(key)
        if found is None:
            compute().write.mode("ignore").parquet(f"{self.path}/cache_key={key}")
            found = self.read(key)
        return found


def save(saved: DataFrame, edges: DataFrame) -> DataFrame:
    """saved with the edges (user_id, job_id, created_at) that it lacks; saving twice changes nothing."""
    return saved.unionByName(edges.dropDuplicates(["user_id", "job_id"]).join(saved.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti"))


def unsave(saved: DataFrame, edges: DataFrame) -> DataFrame:
    return saved.join(edges.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")


def new_texts(stored: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Uploaded texts (user_id, text) that the user hasn't stored yet, by the text's hash; too short ones are left out."""
    hashed = uploaded.select("user_id", "text", F.sha2("text", 256).alias("content_hash")).where(F.length(F.regexp_replace("text", r"\s", "")) >= 40)
    return hashed.dropDuplicates(["user_id", "content_hash"]).join(stored.select("user_id", "content_hash"), ["user_id", "content_hash"], "left_anti")
