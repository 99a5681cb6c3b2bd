"""Keeping the stored taxonomy in step with its files: four linked tables with ids that stay.

Entries are upserted by their natural key (slug or alias): what is new gets the next ids, what is known keeps its id and takes
the new name, category, flags or owner; nothing is deleted. An entry that several files name counts once (the first by its
values). Aliases whose owner is unknown are an error. Null keys are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.sources import stored, taxonomy


@dataclass(frozen=True)
class Tables:
    """technologies: tech_id, slug, name, category; aliases: alias_id, alias, tech_id, case_sensitive, require_context;
    titles: title_id, slug, name; title_aliases: title_alias_id, alias, title_id."""

    technologies: DataFrame
    aliases: DataFrame
    titles: DataFrame
    title_aliases: DataFrame

    @staticmethod
    def empty(spark) -> "Tables":
        of = lambda schema: spark.createDataFrame([], schema)
        return Tables(
            of("tech_id long, slug string, name string, category string"), of("alias_id long, alias string, tech_id long, case_sensitive boolean, require_context boolean"),
            of("title_id long, slug string, name string"), of("title_alias_id long, alias string, title_id long"),
        )


def sync(tables: Tables, technologies: DataFrame, titles: DataFrame) -> Tables:
    """The tables after the entries: technologies as taxonomy.technologies() reads them, titles with slug, name, aliases."""
    entries = taxonomy.checked(technologies)
    techs = upserted(tables.technologies, entries.select("slug", "name", "category"), "slug", "tech_id")
    named = taxonomy.aliases(entries).withColumn("alias", F.trim("alias"))
    aliases = upserted(tables.aliases, _owned(named, techs, "tech_id"), "alias", "alias_id")
    families = upserted(tables.titles, titles.select("slug", "name"), "slug", "title_id")
    listed = F.explode(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    title_aliases = upserted(tables.title_aliases, _owned(titles.select("slug", listed.alias("alias")), families, "title_id"), "alias", "title_alias_id")
    return Tables(techs, aliases, families, title_aliases)


def _owned(rows: DataFrame, owners: DataFrame, id_: str) -> DataFrame:
    """rows with the id of the owner that their slug names."""
    return rows.join(owners.select("slug", id_), "slug").drop("slug")


def upserted(known: DataFrame, incoming: DataFrame, key: str, id_: str) -> DataFrame:
    """``known`` with the rows of ``incoming`` by ``key``, written once: a later read gives the same ids."""
    columns = [c for c in known.columns if c not in (id_, key)]
    new = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_new"))
    both = known.join(new, key, "full_outer")
    rows = both.select(id_, key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns])
    rows = _written(rows, "taxonomy")
    largest = rows.agg(F.coalesce(F.max(id_), F.lit(0))).first()[0]
    fresh = numbered(rows.where(F.col(id_).isNull()).drop(id_), key, id_, largest)
    return _written(rows.where(F.col(id_).isNotNull()).unionByName(fresh.select(*rows.columns)), "taxonomy")


def numbered(rows: DataFrame, key: str, id_: str, after: int) -> DataFrame:
    """rows with the numbers after ``after`` in ``id_``, in the order of ``key``: each range of keys is numbered in its own task."""
    dealt = _written(rows.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "taxonomy-ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return dealt.join(F.broadcast(before), "_part").withColumn(id_, (F.lit(after) + F.col("_before") + place).cast("long")).drop("_part", "_before")


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = stored.fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
