"""The taxonomy and the gold set, from JSON lines: one technology, title or labelled document a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.sources.bindings import slug_of

#: Fixed values.
CATEGORIES = ("languages", "frameworks", "cloud", "infrastructure", "databases", "testing", "messaging", "data_engineering", "ai_ml", "security")

_ALIAS = "struct<alias: string, case_sensitive: boolean, require_context: boolean>"
TECHNOLOGIES = f"name string, slug string, category string, match struct<case_sensitive: boolean, require_context: boolean>, aliases array<{_ALIAS}>"
TITLES = "name string, slug string, aliases array<string>"
GOLD = (
    "id string, title string, text string, technologies map<string, string>, canonical_title string, experience_level string,"
    " arrangement string, salary_annual_min long, salary_annual_max long"
)


def technologies(spark: SparkSession, path: str) -> DataFrame:
    """name, slug (made from the name where none is given), category, match, aliases."""
    rows = spark.read.schema(TECHNOLOGIES).json(path)
    return rows.withColumn("slug", F.coalesce("slug", slug_of(F.col("name"))))


def problems(entries: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """slug, problem: entries of an unknown category, and slugs that several entries have. Empty for a valid taxonomy."""
    known = F.coalesce(F.col("category").isin(*categories), F.lit(False))
    found = F.array_compact(F.array(F.when(F.col("unknown") > 0, "unknown category"), F.when(F.col("n") > 1, "duplicate slug")))
    sums = entries.groupBy("slug").agg(F.count("*").alias("n"), F.count_if(~known).alias("unknown"))
    return sums.select("slug", F.explode(found).alias("problem"))


def checked(entries: DataFrame) -> DataFrame:
    """``entries``, or a ValueError that names up to ten problems."""
    wrong = problems(entries).orderBy("problem", "slug").limit(10).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['problem']}: {r['slug']}" for r in wrong))
    return entries


def aliases(entries: DataFrame) -> DataFrame:
    """alias, slug, case_sensitive, require_context: each technology's name and further aliases; flags that aren't given are false."""
    own = F.struct(F.col("name").alias("alias"), F.col("match.case_sensitive").alias("case_sensitive"), F.col("match.require_context").alias("require_context"))
    listed = F.concat(F.array(own), F.coalesce("aliases", F.array().cast(f"array<{_ALIAS}>")))
    rows = entries.select("slug", F.explode(listed).alias("a"))
    flag = lambda c: F.coalesce(f"a.{c}", F.lit(False)).alias(c)
    return rows.select("a.alias", "slug", flag("case_sensitive"), flag("require_context"))


def titles(spark: SparkSession, path: str) -> DataFrame:
    """alias (lower case), slug: each title family's name and aliases."""
    rows = spark.read.schema(TITLES).json(path)
    listed = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return rows.select(F.explode(F.transform(listed, F.lower)).alias("alias"), "slug").distinct()


def gold_documents(spark: SparkSession, path: str) -> DataFrame:
    """Labelled documents, as GOLD has them."""
    return spark.read.schema(GOLD).json(path)


def gold_terms(documents: DataFrame) -> DataFrame:
    """id, slug, level: the technologies that a labelled document names."""
    return documents.select("id", F.explode("technologies").alias("slug", "level"))
