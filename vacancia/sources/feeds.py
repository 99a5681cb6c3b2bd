"""Two JSON feeds and the normalised posting that both are mapped to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.text import declared_employment, unescaped

#: The shape of all feeds after mapping.
POSTING = "external_id string, title string, description_html string, apply_url string, location_texts array<string>, posted_at timestamp, employment_type string, content_hash string, payload string"
#: Names under which feed A declares employment types.
EMPLOYMENT_NAMES = ("employment type", "employment_type", "employmenttype", "job type", "type of employment", "commitment", "time type", "worker type", "position type", "contract type", "employment status")

def _parsed(landed: DataFrame) -> DataFrame:
    """payload and j, a VARIANT: parsed once, whatever the shape of its fields; NULL where it isn't JSON or repeats a key."""
    return landed.select("payload", F.try_parse_json("payload").alias("j"))


def _at(path: str, kind: str = "string") -> Column:
    """A field of ``j``; NULL where it is missing or of another kind."""
    return F.try_variant_get("j", path, kind)


def _list(path: str, kind: str) -> Column:
    return F.coalesce(_at(path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def _plain(value: Column, path: str) -> Column:
    """A text, number or truth value as text; NULL for an object."""
    return F.when(F.try_variant_get(value, path, "map<string, variant>").isNull(), F.try_variant_get(value, path, "string"))


def _finish(rows: DataFrame) -> DataFrame:
    fields = ("external_id", "title", "description_html", "apply_url", "location_texts", "posted_at", "employment_type")
    # Every field of the payload counts, whatever the order of keys: a VARIANT keeps those of each object sorted, at any depth.
    return rows.select(*fields, F.sha2(F.to_json("j"), 256).alias("content_hash"), "payload")


def feed_a(landed: DataFrame) -> DataFrame:
    """landed: payload (JSON). Places are the location's name, then offices, distinct in order; employment from declared metadata.

    Metadata values may be texts, lists or anything else, mixed in one payload: the first that names an employment type counts.
    """
    j = _parsed(landed).where(_at("$.id").isNotNull())
    offices = F.transform(_list("$.offices", "variant"), lambda o: F.try_variant_get(o, "$.name", "string"))
    places = F.filter(F.array_distinct(F.concat(F.array(_at("$.location.name")), offices)), lambda x: F.trim(x) != "")
    named = F.filter(_list("$.metadata", "variant"), lambda m: F.lower(F.trim(F.try_variant_get(m, "$.name", "string"))).isin(list(EMPLOYMENT_NAMES)))
    items = lambda m: F.try_variant_get(m, "$.value", "array<variant>")
    values = F.transform(named, lambda m: F.coalesce(F.transform(items(m), lambda v: _plain(v, "$")), F.array(_plain(m, "$.value"))))
    declared = F.get(F.array_compact(F.transform(F.flatten(values), declared_employment)), F.lit(0))
    return _finish(j.select(
        _at("$.id").alias("external_id"), _at("$.title").alias("title"), unescaped(_at("$.content")).alias("description_html"), _at("$.absolute_url").alias("apply_url"), places.alias("location_texts"),
        F.try_to_timestamp(_at("$.updated_at")).alias("posted_at"), declared.alias("employment_type"), "payload", "j",
    ))


def feed_b(landed: DataFrame) -> DataFrame:
    """landed: payload (JSON). Postings of other countries are dropped; the body is description, headed lists and additional text."""
    country = _at("$.country")
    j = _parsed(landed).where(_at("$.id").isNotNull() & (country.isNull() | (country == "US")))
    part = lambda x, name: F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit(""))
    lists = F.flatten(F.transform(_list("$.lists", "variant"), lambda x: F.array(F.concat(F.lit("<h3>"), part(x, "text"), F.lit("</h3>")), part(x, "content"))))
    body = F.array_join(F.filter(F.concat(F.array(_at("$.description")), lists, F.array(_at("$.additional"))), lambda s: s != ""), "\n")
    places = F.array_distinct(F.filter(F.concat(_list("$.categories.allLocations", "string"), F.array(_at("$.categories.location"))), lambda x: F.trim(x) != ""))
    return _finish(j.select(
        _at("$.id").alias("external_id"), _at("$.text").alias("title"), body.alias("description_html"), _at("$.hostedUrl").alias("apply_url"), places.alias("location_texts"),
        F.timestamp_millis(_at("$.createdAt", "bigint")).alias("posted_at"), declared_employment(_at("$.categories.commitment")).alias("employment_type"), "payload", "j",
    ))


def company_seeds(spark, path: str) -> DataFrame:
    return spark.read.schema("name string, ats_type string, ats_token string, domain string").csv(path, header=True)


def city_table(spark, path: str) -> DataFrame:
    return spark.read.schema("city string, state string, lat double, lon double, population long").csv(path, header=True, comment="#")


def world_cities(spark, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and name not like '#%'")
