"""Cross-source duplicates: edges by grouping, components by alternating star steps, one representative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.sources import stored

#: Which kind of source stands for a group.
KIND_RANK = {"ats_api": 0, "gov_api": 1, "aggregator_api": 2}
#: Tasks over which the rows of one key are dealt, and the members from which on a group's are.
SALTS, LARGE = 16, 100_000


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def stars(rows: DataFrame, key: list[str], member: str, mixed: str | None = None) -> DataFrame:
    """a, b: each member of a group tied to its smallest one; with ``mixed``, only groups with two values of that column.

    Groups are aggregated before they are shuffled, and no pairs are made.
    """
    spread = (F.min(mixed) < F.max(mixed)) if mixed else F.lit(True)
    groups = rows.groupBy(*key).agg(F.min(member).alias("_least"), spread.alias("_mixed")).where("_mixed")
    return rows.join(groups, key).where(F.col(member) != F.col("_least")).select(F.col(member).alias("a"), F.col("_least").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """id, root: the smallest id of its component for every id with an edge.

    Large-star and small-star steps alternate until nothing changes; each round is checkpointed to the shared folder,
    which cuts the lineage and survives lost executors.
    """
    spark = edges.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(_shared_folder(spark))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:  # each round but the last changes the edges, and star steps settle in a logarithm of the longest path
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # nodes that aren't the least around them and have larger neighbours: these go to the least; other edges stay where they are
        moved = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("_most")).where("m < u and _most > u").select(F.col("u").alias("v"), "m")
        large = _dealt_join(edges, moved, "v", "u").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()


def _dealt_join(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """``many`` left joined with ``few``, each key's rows dealt out over SALTS tasks by ``by``: the centre of a star may have most of them."""
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"], "left").drop("_salt")


def _shared_folder(spark) -> str:
    """``spark.checkpoint.dir``; only a local session, as in tests, may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def company_classes(companies: DataFrame) -> DataFrame:
    """company_id, class: companies that share a normalised name or a domain, also by way of others."""
    named = companies.select("company_id", F.lower(F.trim("name")).alias("key")).where("key <> ''")
    sited = companies.select("company_id", F.lower(F.trim("domain")).alias("key")).where("key <> ''")
    roots = components(stars(named, ["key"], "company_id").union(stars(sited, ["key"], "company_id")))
    return companies.select("company_id").join(roots.withColumnRenamed("id", "company_id"), "company_id", "left").select("company_id", F.coalesce("root", "company_id").alias("class"))


def groups(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """job_id, group: postings of different sources with one URL, or of one company, title and place (or both without a place).

    postings: job_id, company_id, source_id, kind, title, url_key, places (array), status, first_seen_at. The group is the
    job_id of its representative: active first, then by kind of source, first seen, id.
    """
    by_url = stars(postings.where(F.col("url_key").isNotNull()), ["url_key"], "job_id", "source_id")
    placed = postings.join(classes, "company_id").select("job_id", "source_id", "class", normal_title(F.col("title")).alias("title"), F.explode(F.when(F.size("places") > 0, F.col("places")).otherwise(F.array(F.lit("")))).alias("place"))
    by_key = stars(placed, ["class", "title", "place"], "job_id", "source_id")
    roots = components(by_url.union(by_key))
    rank = F.coalesce(F.create_map(*[x for k, v in KIND_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")], F.lit(9))
    rows = postings.join(roots, postings["job_id"] == roots["id"])
    best = rows.groupBy("root").agg(F.min_by("job_id", F.struct((F.col("status") != "active").cast("int"), rank, "first_seen_at", "job_id")).alias("group"), F.count("*").alias("_n"))
    best = stored.written(best, "duplicate-groups")
    large = F.broadcast(best.where(F.col("_n") > LARGE))  # one for each LARGE rows at most
    named = roots.join(large, "root").unionByName(roots.join(large, "root", "left_anti").join(best.where(F.col("_n") <= LARGE), "root"))
    return named.select(F.col("id").alias("job_id"), "group")


def statistics(new: DataFrame, old: DataFrame) -> DataFrame:
    """groups, grouped_jobs, changed (against the old job_id, group)."""
    both = new.join(old.select("job_id", F.col("group").alias("_old")), "job_id", "full_outer")
    return both.agg(F.count_distinct("group").alias("groups"), F.count("group").alias("grouped_jobs"), F.count_if(~F.col("group").eqNullSafe(F.col("_old"))).alias("changed"))
