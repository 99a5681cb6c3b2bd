"""Quantiles by counts, stored bridges and radius searches: results against plain versions, and what their plans do."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacancia.functions import geo
from vacancia.operators import dedupe, market, skills, snapshots
from vacancia.operators.quantiles import quantiles
from vacancia.plans.predicate import Scope, flagged_jobs, matching_jobs, resolve
from vacancia.sources import stored
from vacancia.sources.bindings import Market

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_equal_sorting_all(spark):
    rng = random.Random(3)
    rows = [(g, h, v) for g in (1, 2, None) for h in ("a", None) for v in [round(rng.gauss(1000, 900), rng.choice([0, 2])) for _ in range(rng.choice([1, 2, 57, 400]))]]
    rows += [(1, "a", 7.0)] * 3000 + [(3, "x", None)] * 5 + [(4, "y", -0.5), (4, "y", None)]  # a hot value; a group without values
    fractions = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    df = spark.createDataFrame(rows, "g int, h string, v double").repartition(5)
    for width in (0.5, 500.0, 1e9):
        got = {(r["g"], r["h"]): (r["n"], r["p"]) for r in quantiles(df, ["g", "h"], F.col("v"), fractions, width).collect()}
        plain = {}
        for g, h, v in rows:
            if v is not None:
                plain.setdefault((g, h), []).append(v)
        assert set(got) == {(g, h) for g, h, _ in rows} and got[3, "x"] == (0, None)
        for k, vs in plain.items():
            assert got[k][0] == len(vs) and got[k][1] == pytest.approx(np.quantile(vs, fractions))
    assert quantiles(df, [], F.col("v"), (0.5,), 10.0).first()["p"] == pytest.approx([np.median([v for *_, v in rows if v is not None])])
    assert quantiles(df.limit(0), ["g"], F.col("v"), (0.5,), 10.0).count() == 0


def test_no_query_of_salaries_gathers_a_groups_values(spark):
    m = Market(spark, SF)
    matching = matching_jobs(m, [Scope()])
    for df in (market.summary(matching), skills.salaries(matching, matching, m.job_technologies, m.technologies)):
        assert "percentile" not in plan(df) and "collect_list" not in plan(df)


def test_bridges_are_joined_and_counted_without_an_exchange(spark):
    m = Market(spark, SF)
    assert stored.bucketed(spark, "jobs", SF, None, "job_id").count() == m.jobs.count()  # stored once
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matching = matching_jobs(m, [Scope(), Scope.canonical(technologies=["red-widget"])])
        joined = matching.select("scope_id", "job_id").join(m.job_technologies, "job_id")
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        assert "Exchange" not in plan(m.job_technologies.groupBy("job_id").count())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    derived = m._job_technologies()
    assert m.job_technologies.exceptAll(derived).count() == derived.exceptAll(m.job_technologies).count() == 0


def test_a_radius_search_reads_the_cells_around_its_centre(spark, tmp_path):
    rng = random.Random(5)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(3000)] + [(9000 + i, rng.uniform(60, 70), rng.choice([-179.9, 179.9])) for i in range(50)] + [(9999, None, 1.0)]
    stored.by_cell(spark.createDataFrame(points, "job_id long, lat double, lon double"), str(tmp_path / "spots"))
    spots = spark.read.parquet(str(tmp_path / "spots"))
    assert spots.count() == 3050
    for lat, lon, km in ((10.0, 20.0, 900), (65.0, 179.8, 500), (89.5, 0.0, 400), (-60.0, -179.9, 2000), (0.0, 0.0, 15_000)):
        near = geo.distance(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= km * 1000
        boxed = spots.where(geo.box(lat, lon, km * 1000.0))
        assert boxed.where(near).count() == spots.where(near).count() > 0
        assert km > 1000 or boxed.count() < 500
    pushed = plan(spots.where(geo.box(10.0, 20.0, 5e4))).split("PushedFilters")[1]
    assert "GreaterThanOrEqual(lat" in pushed and "LessThanOrEqual(lat" in pushed
    m = Market(spark, SF)
    jobs = flagged_jobs(m, resolve(m, [Scope.canonical(location="nation-5", radius_miles=50)]))
    assert "GreaterThanOrEqual(lat" in plan(jobs)


def test_places_of_jobs_meet_metros_where_they_lie(spark):
    m = Market(spark, SF)
    members = snapshots.metro_members(m.job_locations, snapshots.busiest_metros(m.jobs, m.job_locations, m.cities, top=12), 200)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(x#" not in plan and "hashpartitioning(geo#" not in plan


def test_stored_bridges_are_shuffled_once(spark):
    m = Market(spark, SF)
    for rows in (m._job_technologies(), m._job_locations()):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(job_id#") == 1


def test_the_centre_of_a_star_is_dealt_out(spark, monkeypatch):
    n = 2000
    star = spark.range(1, n).selectExpr("id as u", f"id div {n} as v")
    joined = dedupe._dealt_join(star, spark.createDataFrame([(0, -1)], "v long, m long").hint("merge"), "v", "u")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(v#" in plan and "_salt#" in plan and joined.where("m = -1").count() == n - 1
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(5, k) for k in range(400, 700)]
    parent = {i: i for p in pairs for i in p}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {(i, root(i)) for p in pairs if p[0] != p[1] for i in p}
    assert {tuple(x) for x in dedupe.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
    monkeypatch.setattr(dedupe, "LARGE", 2)
    posted = [(i, 1, i % 3, "ats_api", f"t{i}", f"u{i // 7}", [], "active", None) for i in range(70)]
    postings = spark.createDataFrame(posted, "job_id long, company_id long, source_id int, kind string, title string, url_key string, places array<string>, status string, first_seen_at date")
    found = dedupe.groups(postings, spark.createDataFrame([(1, 1)], "company_id long, class long"))
    assert {tuple(x) for x in found.collect()} == {(i, i // 7 * 7) for i in range(70)}
