"""A run over postings: its rows, the four counters, resuming, and extracting again what changed."""

import pytest
from pyspark.sql import functions as F

from vacancia.operators import extraction_run as run
from vacancia.operators import review

SCHEMA = "job_id long, title string, text string, location_is_remote boolean, arrangement string, experience_level string, employment_type string, salary_annual_min double, extractor_version int"
TEXT = "We build things.\nRequirements:\n5+ years of experience with Python and PostgreSQL\nNice to have\nGo, Rust, Kafka\nPay: $150,000 - $180,000 per year.\nThis is fully remote."


@pytest.fixture(scope="module")
def taxonomy(spark):
    aliases = [("Python", "python", False, False), ("PostgreSQL", "postgresql", False, False), ("Go", "go", True, True), ("Rust", "rust", True, True), ("Kafka", "kafka", False, False)]
    names = [("backend engineer", "backend-engineer"), ("data engineer", "data-engineer")]
    return run.Taxonomy(spark.createDataFrame(aliases, "alias string, slug string, case_sensitive boolean, require_context boolean"), spark.createDataFrame(names, "alias string, slug string"))


def postings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    (1, "Senior Backend Engineer", TEXT, False, None, None, None, None, None),
    (2, "Backend Enginer", "Office job. You must work on-site.", False, "hybrid", "mid", "contract", 90_000.0, None),  # near miss of an alias
    (3, "Window Cleaner", "Clean windows. rust is a colour. $20 - $25 per hour", True, None, None, None, None, 0),
    (4, None, None, None, "remote", "entry", None, None, None),
    (5, "Data Engineer", TEXT, False, None, None, None, 100_000.0, 1),  # done by this version
]


def test_a_run_gives_everything_in_one_row_for_each_posting(spark, taxonomy, tmp_path):
    path = str(tmp_path / "run")
    jobs = postings(spark, ROWS)
    counted = run.run(jobs, taxonomy, path)
    assert counted == {"processed": 4, "with_technologies": 1, "titles_resolved": 2, "salaries_new": 2}
    got = {r["job_id"]: r for r in run.current(spark, path).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert {(t["slug"], t["level"]) for t in got[1]["technologies"]} == {("python", "required"), ("postgresql", "required"), ("go", "preferred"), ("rust", "preferred"), ("kafka", "preferred")}
    assert [s["kind"] for s in got[1]["sections"]] == ["required", "preferred"] and got[1]["title_slug"] == got[2]["title_slug"] == "backend-engineer"
    assert (got[1]["arrangement"], got[1]["experience_level"], got[1]["years_of_experience"], got[1]["employment_type"], got[1]["salary"]["annual_min"]) == ("remote", "senior", 5, "full_time", 150_000)
    assert (got[2]["arrangement"], got[2]["experience_level"], got[2]["employment_type"], got[2]["salary"]) == ("onsite", "mid", "contract", None)  # what was known stays
    assert (got[3]["arrangement"], got[3]["salary"]["annual_min"]) == ("remote", 41_600) and (got[4]["arrangement"], got[4]["experience_level"], got[4]["review"]) == ("remote", "entry", [])
    seen = {(r["kind"], r["value"], r["job_id"]) for r in run.sightings(run.current(spark, path)).collect()}
    assert ("title", "window cleaner", 3) in seen and not any(j in (1, 2) for *_, j in seen)
    from vacancia.operators import detail

    known = spark.createDataFrame([("python", "Python", "languages"), ("postgresql", "PostgreSQL", "databases"), ("go", "Go", "languages"), ("rust", "Rust", "languages"), ("kafka", "Kafka", "messaging")], "slug string, name string, category string")
    ids = spark.createDataFrame([(1,), (5,)], "job_id long")
    page = {r["job_id"]: r for r in detail.job_details(jobs.select("job_id", "title"), run.current(spark, path), known, ids).collect()}
    shown = [(t["confidence"], t["name"]) for t in page[1]["technologies"]]
    assert set(page) == {1, 5} and shown == sorted(shown, key=lambda t: (-t[0], t[1])) and len(shown) == 5 and shown[0][0] > shown[-1][0]
    assert [(s["kind"], s["start"] < s["end"]) for s in page[1]["sections"]] == [("required", True), ("preferred", True)] and page[5]["technologies"] == page[5]["sections"] == []
    queue = review.accumulate(spark.createDataFrame([], "kind string, value string, example_context string, occurrences long, status string"), run.sightings(run.current(spark, path)))
    assert queue.where("kind = 'title'").first()["example_context"] == "Window Cleaner"
    after = {r["job_id"]: r for r in run.applied(jobs, run.current(spark, path)).collect()}
    assert after[1]["extractor_version"] == 1 and after[1]["salary_annual_min"] == 150_000 and after[2]["salary_annual_min"] == 90_000 and after[5]["title_slug"] is None
    assert run.run(run.applied(jobs, run.current(spark, path)).select(*jobs.columns), taxonomy, path) == dict.fromkeys(run.COUNTERS, 0)


def test_a_run_that_broke_off_goes_on_where_it_was(spark, taxonomy, tmp_path, monkeypatch):
    rows = [(i, "Data Engineer", f"{i % 9}+ years of experience with Python {'x ' * 50}", False, None, None, None, None, None) for i in range(60)]
    jobs, path, whole = postings(spark, rows), str(tmp_path / "parts"), str(tmp_path / "whole")
    first = run.run(jobs, taxonomy, path, slice_bytes=2_500, most=2)
    assert 0 < first["processed"] < 60
    monkeypatch.setattr(run, "extracted", lambda own, t: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run.run(jobs, taxonomy, path, slice_bytes=2_500)
    monkeypatch.undo()
    spark.range(3).write.parquet(f"{path}/batch=50")  # a batch that was begun and never finished
    import os

    os.remove(f"{path}/batch=50/_SUCCESS")
    second = run.run(jobs, taxonomy, path, slice_bytes=2_500)
    assert first["processed"] + second["processed"] == 60 and max(run._batches(spark, path)[0]) > 50
    assert run.run(jobs, taxonomy, path, slice_bytes=2_500)["processed"] == 0
    counted = run.run(jobs, taxonomy, whole)
    assert counted == {k: first[k] + second[k] for k in counted}
    columns = [c for c in run.current(spark, whole).columns if c != "batch"]
    assert run.current(spark, whole).select(*columns).exceptAll(run.current(spark, path).select(*columns)).count() == 0


def test_a_changed_posting_is_extracted_again(spark, taxonomy, tmp_path):
    path = str(tmp_path / "run")
    run.run(postings(spark, ROWS), taxonomy, path)
    changed = [(1, "Data Engineer", "Requirements:\n2+ years of experience with Kafka", False, None, None, None, None, None), *ROWS[1:]]  # ingestion sets the version of a changed posting to NULL
    assert run.run(postings(spark, changed), taxonomy, path)["processed"] == 1
    now = run.current(spark, path).where("job_id = 1").first()
    assert (now["title_slug"], now["years_of_experience"], [t["slug"] for t in now["technologies"]], now["salary"]) == ("data-engineer", 2, ["kafka"], None)
    assert run.technologies(run.current(spark, path)).where("job_id = 1").count() == run.sections(run.current(spark, path)).where("job_id = 1").count() == 1
    assert run.run(postings(spark, changed), taxonomy, path, version=2)["processed"] == 5  # a newer extractor takes all
    assert run.current(spark, path).select("version").distinct().collect() == [(2,)]
    nothing = postings(spark, []).where(F.lit(False))
    assert run.run(nothing, taxonomy, str(tmp_path / "none")) == dict.fromkeys(run.COUNTERS, 0)
    with pytest.raises(ValueError):
        run.current(spark, str(tmp_path / "none"))
