"""Syncing the taxonomy: ids stay, what changed is taken over, nothing goes."""

import pytest

from vacancia.operators import taxonomy_sync as ts
from vacancia.sources import taxonomy

TITLES = "slug string, name string, aliases array<string>"


def tech(spark, *rows):
    return spark.createDataFrame([(n, s, c, (cs, rc), [(a, False, False) for a in more]) for n, s, c, cs, rc, more in rows], taxonomy.TECHNOLOGIES)


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_a_second_sync_changes_no_id_and_a_moved_alias_its_owner_only(spark):
    first = tech(spark, ("Python", "python", "languages", False, False, ["py"]), ("Go", "go", "languages", True, True, ["golang"]), ("Kafka", "kafka", "messaging", False, False, []))
    titles = spark.createDataFrame([("data", "Data Engineer", ["ETL Developer"]), ("ml", "ML Engineer", None)], TITLES)
    one = ts.sync(ts.Tables.empty(spark), first, titles)
    assert {r["slug"]: r["tech_id"] for r in one.technologies.collect()} == {"go": 1, "kafka": 2, "python": 3}
    assert set(by(one.aliases, "alias")) == {"Python", "py", "Go", "golang", "Kafka"} and set(by(one.title_aliases, "alias")) == {"data engineer", "etl developer", "ml engineer"}
    again = ts.sync(one, first, titles)
    for a, b in zip(vars(one).values(), vars(again).values(), strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    moved = tech(spark, ("Python", "python", "languages", False, True, []), ("Apache Kafka", "kafka", "data_engineering", False, False, ["py"]), ("Rust", "rust", "languages", True, True, []))
    two = ts.sync(again, moved, spark.createDataFrame([("ml", "Machine Learning Engineer", ["etl developer"])], TITLES))
    old, new = by(one.technologies, "slug"), by(two.technologies, "slug")
    assert {s: r["tech_id"] for s, r in new.items()} == {**{s: r["tech_id"] for s, r in old.items()}, "rust": 4}
    assert (new["kafka"]["name"], new["kafka"]["category"], new["go"]) == ("Apache Kafka", "data_engineering", old["go"])
    before, after = by(one.aliases, "alias"), by(two.aliases, "alias")
    assert set(after) == {*before, "Apache Kafka", "Rust"} and all(after[a]["alias_id"] == r["alias_id"] for a, r in before.items())
    assert after["py"]["tech_id"] == new["kafka"]["tech_id"] and after["Python"]["require_context"] and after["golang"] == before["golang"]
    families = by(two.title_aliases, "alias")
    assert families["etl developer"]["title_id"] == by(two.titles, "slug")["ml"]["title_id"] and families["data engineer"] == by(one.title_aliases, "alias")["data engineer"]


def test_numbers_are_gapless_over_many_ranges(spark):
    rows = spark.range(1000).selectExpr("concat('k', lpad(cast(id as string), 4, '0')) as slug", "'n' as name", "'c' as category").repartition(7)
    got = ts.upserted(spark.createDataFrame([(41, "zz", "old", "x"), (7, "k0003", "old", "x")], "tech_id long, slug string, name string, category string"), rows, "slug", "tech_id")
    ids = sorted(r["tech_id"] for r in got.collect())
    assert ids == sorted([7, 41, *range(42, 42 + 999)]) and got.where("slug = 'k0003'").first()["name"] == "n" and got.where("slug = 'zz'").first()["name"] == "old"
    assert ts.upserted(got, rows.limit(0), "slug", "tech_id").count() == 1001


def test_a_bad_taxonomy_changes_nothing(spark):
    with pytest.raises(ValueError, match="unknown category: x"):
        ts.sync(ts.Tables.empty(spark), tech(spark, ("X", "x", "spells", False, False, [])), spark.createDataFrame([], TITLES))
