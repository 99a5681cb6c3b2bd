"""The known-truth market of 27 postings, and scenario tests of the operators over small frames."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from vacancia import queries
from vacancia.functions import text as T
from vacancia.functions import urls
from vacancia.operators import dedupe, evaluate, fulltext, ingest, market, matching, mentions, places, profiles, resume, review, search, skills, snapshots, titles
from vacancia.operators import text as text_ops
from vacancia.plans.predicate import Scope, matching_jobs
from vacancia.sources import feeds, taxonomy
from vacancia.streaming.postings import StateTable, daily, merge_stream

SF, OAK, SJ, NYC, DEN = ("San Francisco", 37.7749, -122.4194), ("Oakland", 37.8044, -122.2712), ("San Jose", 37.3382, -121.8863), ("New York City", 40.7128, -74.0060), ("Denver", 39.7392, -104.9903)
TECHS = ["python", "postgresql", "go", "react", "typescript", "pytorch"]


class Micro:
    """A market held in memory, with the attributes that the operators read."""

    def __init__(self, spark):
        self.spark = spark
        rows, tech, loc = [], [], []

        def add(i, title, where, techs, mid, arr, level, emp, status="active", group=None):
            rows.append((i, i % 3, title, status, arr, level, emp, None if mid is None else mid - 10_000.0, None if mid is None else mid + 10_000.0, group, dt.datetime(2024, 1, i % 27 + 1), 0))
            tech.extend((i, TECHS.index(t), r) for t, r in techs)
            loc.extend((i, w[0], "X", w[1], w[2]) for w in where)

        for i in range(1, 7):
            add(i, 1, [SF], [("python", "required"), ("postgresql", "required")], 200_000 if i <= 4 else None, "hybrid", "senior", "full_time")
        for i in (7, 8):
            add(i, 1, [OAK], [("python", "required")], 150_000, "onsite", "mid", "full_time")
        for i in (9, 10):
            add(i, 1, [SJ], [("python", "preferred")], None, "onsite", "mid", "contract" if i == 9 else "full_time")
        for i in (11, 12):
            add(i, 1, [SF, NYC], [("go", "required")], 250_000, "remote", "senior", "full_time")
        for i in range(13, 18):
            add(i, 2, [NYC], [("react", "required"), ("typescript", "mentioned")], 120_000, "hybrid", "entry", "internship" if i < 15 else "full_time")
        for i in range(18, 21):
            add(i, 4, [], [("python", "required"), ("pytorch", "required")], 300_000, "remote", "staff_plus", "full_time")
        for i in range(21, 24):
            add(i, None, [DEN], [], None, None, None, None)
        add(24, 1, [SF], [("python", "required")], 999_000, "onsite", "senior", "full_time", "expired")
        add(25, 2, [NYC], [("react", "required")], None, "onsite", "entry", "full_time", "expired")
        add(26, 1, [SF], [("python", "required")], 400_000, "hybrid", "senior", "full_time", group=1)
        add(27, 2, [NYC], [("react", "required")], 500_000, "hybrid", "entry", "full_time", group=13)
        self.jobs = spark.createDataFrame(rows, "job_id long, source_id int, title_id int, status string, arrangement string, experience_level string, employment_type string, salary_annual_min double, salary_annual_max double, dedupe_group_id long, posted_at timestamp, company_id long")
        self.job_technologies = spark.createDataFrame(tech, "job_id long, tech_id long, requirement string")
        words = {}
        for i, t, _ in tech:
            words.setdefault(i, []).append(TECHS[t])
        self.job_texts = spark.createDataFrame([(r[0], " ".join(["Engineer with", *words.get(r[0], [])])) for r in rows], "job_id long, text string")
        self.technologies = spark.createDataFrame([(i, t, t, "language") for i, t in enumerate(TECHS)], "tech_id long, slug string, name string, category string")
        self.job_locations = spark.createDataFrame(loc, "job_id long, city string, region string, lat double, lon double")
        self.spots = self.job_locations.where("lat is not null").select("job_id", "lat", "lon")
        self.text_index = fulltext.unstored(self.job_texts, "job_id")
        self.cities = spark.createDataFrame([(c[0], "X", c[1], c[2], c[0].lower().replace(" ", "-")) for c in (SF, OAK, SJ, NYC, DEN)], "city string, region string, lat double, lon double, city_slug string")


@pytest.fixture(scope="module")
def micro(spark):
    return Micro(spark)


def count(m, **scope):
    return matching_jobs(m, [Scope.canonical(**scope)]).count()


def test_counts_of_the_known_market(micro):
    scopes = [Scope(), *(Scope.canonical(**s) for s in (dict(location="san-francisco", radius_miles=10), dict(location="san-francisco", radius_miles=50), dict(location="new-york-city", radius_miles=10), dict(salary_min=140_000), dict(technologies=["python", "postgresql"]), dict(employment_type="unknown"), dict(title="ml-engineer")))]
    got = {r["scope_id"]: r["count"] for r in matching_jobs(micro, scopes).groupBy("scope_id").count().collect()}
    assert got == {0: 23, 1: 10, 2: 12, 3: 7, 4: 11, 5: 6, 6: 3, 7: 3}


def test_dashboard_of_the_known_market(micro):
    m = matching_jobs(micro, [Scope()]).persist()
    s = market.summary(m).first()
    assert (s["analyzed_jobs"], s["disclosed"], s["p25"], s["median"], s["p75"], s["low_confidence"]) == (23, 16, 120_000, 200_000, 250_000, True)
    demand = {r["slug"]: (r["job_count"], r["required_count"]) for r in market.demand(m, micro.job_technologies, micro.technologies).collect()}
    assert demand == {"python": (13, 11), "postgresql": (6, 6), "go": (2, 2), "react": (5, 5), "typescript": (5, 0), "pytorch": (3, 3)}
    d = {(r["dimension"], r["value"]): r["job_count"] for r in market.distributions(m).collect()}
    assert [d["arrangement", v] for v in ("hybrid", "onsite", "remote", "unspecified")] == [11, 4, 5, 3] and d["employment_type", "unspecified"] == 3
    for dim in market.DIMENSIONS:
        assert sum(n for (k, _), n in d.items() if k == dim) == 23
    pairs = {(r["slug"], r["other_slug"]): (r["together"], r["lift"]) for r in skills.co_occurrence(m, micro.job_technologies, micro.technologies).collect()}
    assert pairs["python", "postgresql"] == (6, pytest.approx(23 / 13, abs=1e-5)) and pairs["react", "typescript"] == (5, pytest.approx(23 / 5)) and pairs["python", "pytorch"][0] == 3
    m.unpersist()


def test_snapshot_and_metros(micro):
    metros = snapshots.busiest_metros(micro.jobs, micro.job_locations, micro.cities)
    members = snapshots.metro_members(micro.job_locations, metros, 25)
    rows = {(r["geo"], r["tech_id"], r["title_id"]): r["job_count"] for r in snapshots.snapshot(matching_jobs(micro, [Scope()]), micro.job_technologies, members).collect()}
    python, react = TECHS.index("python"), TECHS.index("react")
    assert rows["national", python, None] == 13 and rows["national", python, 1] == 10 and rows["san-francisco", python, None] == 8 and rows["new-york-city", react, None] == 5


def test_scopes_are_canonical_and_unknown_ones_fail(micro):
    a, b = Scope.canonical(q="  Big   Data ", technologies=["Go", "go", "AWS"], radius_miles=12), Scope.canonical(q="big data", technologies=["aws", "go"])
    assert a.key() == b.key() and "radius_miles" not in a.canonical_dict() and Scope.canonical(location="x", radius_miles=12).radius_miles == 25
    assert a.without("go").technologies == ("aws",)
    for bad in (dict(arrangement="moon"), dict(nonsense=1)):
        with pytest.raises(ValueError):
            Scope.canonical(**bad)
    with pytest.raises(ValueError):
        count(micro, technologies=["cobol"])


def test_pages_partition_the_result(micro):
    m, seen, after = matching_jobs(micro, [Scope()]), [], None
    while True:
        rows = search.page(m, "salary", 5, after).collect()
        seen += [r["job_id"] for r in rows[:5]]
        if len(rows) <= 5:
            break
        after = (float(rows[4]["sort_key"]), rows[4]["job_id"])
    assert sorted(seen) == list(range(1, 24))


def test_relaxation_counts(micro):
    got = {r["option"]: r["job_count"] for r in search.relaxations(micro, Scope.canonical(location="oakland", radius_miles=10, technologies=["go"], salary_min=100_000)).collect()}
    assert set(got) >= {"technology:go"} and all(n > 0 for n in got.values())


def test_duplicate_groups(spark):
    when = dt.datetime(2024, 1, 1)
    rows = [(1, 1, 0, "ats_api", "Engineer", "u1", [], "active", when), (2, 1, 2, "aggregator_api", "Other", "u1", [], "active", when), (3, 1, 0, "ats_api", "Dev", None, ["SF"], "active", when), (4, 1, 1, "gov_api", " dev ", None, ["SF", "NY"], "expired", when),
            (5, 1, 0, "ats_api", "Dev", None, ["LA"], "active", when), (6, 2, 1, "gov_api", "Dev", None, ["SF"], "active", when), (7, 1, 0, "ats_api", "Engineer", "u2", [], "active", when), (8, 1, 0, "ats_api", "Engineer", "u2", [], "active", when)]
    p = spark.createDataFrame(rows, "job_id long, company_id long, source_id int, kind string, title string, url_key string, places array<string>, status string, first_seen_at timestamp")
    classes = dedupe.company_classes(spark.createDataFrame([(1, "Acme", "acme.com"), (2, "Umbrella", None)], "company_id long, name string, domain string"))
    got = {r["job_id"]: r["group"] for r in dedupe.groups(p, classes).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_urls(spark):
    cases = {"HTTPS://X.com/a/?utm_source=q&b=2&a=1#f": "https://x.com/a?a=1&b=2", "http://x.com/": "http://x.com", "x.com/a": None, "http://x.com/a?k=": "http://x.com/a"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", urls.canonical(F.col("u")).alias("c")).collect()} == cases


def test_change_detection_and_expiry(spark):
    schema = "source_id string, external_id string, content_hash string, payload string, status string, extractor_version int, first_seen_at timestamp, last_seen_at timestamp"
    old, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 10)
    stored = spark.createDataFrame([("a", "1", "h", "p", "expired", 1, old, old), ("a", "2", "h", "p", "active", 1, old, old), ("b", "3", "h", "p", "active", 1, old, old), ("a", "4", "h", "p", "active", 1, old, old)], schema)
    seen = spark.createDataFrame([("a", "1", "h", "p", now), ("a", "2", "h2", "p2", now), ("c", "9", "h", "p", now)], "source_id string, external_id string, content_hash string, payload string, seen_at timestamp")
    merged = ingest.merge(stored, seen)
    got = {r["external_id"]: (r["outcome"], r["status"], r["extractor_version"]) for r in merged.collect()}
    assert got == {"1": ("unchanged", "active", 1), "2": ("updated", "active", None), "3": (None, "active", 1), "4": (None, "active", 1), "9": ("new", "active", None)}
    runs = spark.createDataFrame([("a", "succeeded", now), ("b", "failed", now)], "source_id string, status string, finished_at timestamp")
    assert {r["external_id"] for r in ingest.expire(merged, runs, now).where("status = 'expired'").collect()} == {"4"}


def test_review_queue(spark):
    queue = spark.createDataFrame([("title", "a", "c", 1, "resolved"), ("title", "b", "c", 2, "dismissed")], "kind string, value string, example_context string, occurrences long, status string")
    seen = spark.createDataFrame([("title", "a", "new", 1), ("title", "b", "new", 1), ("technology", "x" * 400, "ctx", 5), ("technology", "x" * 400, "first", 2)], "kind string, value string, context string, job_id long")
    got = {(r["kind"], r["value"][:1]): (r["occurrences"], r["status"], r["example_context"]) for r in review.accumulate(queue, seen).collect()}
    assert got == {("title", "a"): (2, "pending", "c"), ("title", "b"): (3, "dismissed", "c"), ("technology", "x"): (2, "pending", "first")}
    assert review.summary(queue).count() == 6
    with pytest.raises(ValueError):
        review.listing(queue, kind="nope")


def test_salaries_years_and_types(spark):
    cases = {"Pay: $120,000 - $150,000": (120_000, 150_000), "150-180k base": (150_000, 180_000), "$60 to $80 per hour": (60 * 2080, 80 * 2080), "up to $90k a year": (90_000, 90_000), "we raised $5,000,000": None, "in 2010 - 2012 we grew": None, "earn $95,000": (95_000, 95_000), "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: None if r["s"] is None else (r["s"]["annual_min"], r["s"]["annual_max"]) for r in df.select("t", T.salary(F.col("t")).alias("s")).collect()}
    assert got == cases
    y = spark.createDataFrame([("5+ years of experience",), ("25 years of experience, 3-5 years of backend experience",), ("no",)], "t string")
    assert [r[0] for r in y.select(T.years(F.col("t"))).collect()] == [5, 3, None]
    e = spark.createDataFrame([("Software Engineering Intern", "", None), ("Internal Tools", "", None), ("Dev", "6-month contract", None), ("", "", None), ("Intern", "", "full_time")], "t string, b string, d string")
    assert [r[0] for r in e.select(T.employment_type(F.col("t"), F.col("b"), F.col("d"))).collect()] == ["internship", "full_time", "contract", "unknown", "full_time"]


def test_html_and_sections(spark):
    html = "<p>Hi&nbsp;&amp; bye</p><ul><li>one</li><li>two</li></ul><script>var a='<p>';</script><br/>end"
    assert spark.createDataFrame([(html,)], "h string").select(T.html_to_text(F.col("h"))).first()[0] == "Hi & bye\n\n• one\n\n• two\n\nend"
    text = "intro\nRequirements:\npython\nNice to have\ngo\nBenefits\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["kind"], text[r["start"] : r["end"]]) for r in text_ops.sections(docs).orderBy("start").collect()]
    assert got == [("required", "python\n"), ("preferred", "go\n")]


def test_mentions(spark):
    aliases = spark.createDataFrame([("Go", "go", True, True), ("Python", "python", False, False), ("C", "c", True, True), ("C++", "cpp", False, False), ("Ruby on Rails", "rails", False, False), ("Ruby", "ruby", False, False)], "alias string, slug string, case_sensitive boolean, require_context boolean")
    cases = {1: ("Go and python, Ruby on Rails", {"go", "python", "rails"}), 2: ("please go on", set()), 3: ("Objective-C, C++ code", {"cpp"}), 4: ("pythonic", set()), 5: ("Go west", {"go"}), 6: ("R&C lab", set())}
    hits = mentions.find(spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string"), aliases)
    scored = mentions.score(hits).collect()
    for k, (_, want) in cases.items():
        assert {r["slug"] for r in scored if r["doc_id"] == k} == want, k
    assert {r["route"] for r in scored if r["doc_id"] == 5} == {"review"}


def test_titles(spark):
    aliases = spark.createDataFrame([("backend engineer", "backend"), ("software engineer", "software-engineer"), ("data platform engineer", "data-platform"), ("frontend developer", "frontend")], "alias string, slug string")
    cases = {"Senior Backend Engineer (Remote)": ("backend", "senior"), "Software Engineer, Data Platform": ("data-platform", None), "Staff Software Engineer": ("software-engineer", "staff_plus"), "L4 Very Good Frontend Developer": ("frontend", "mid"), "Cook": (None, None)}
    got = {r["title"]: (r["slug"], r["level"]) for r in titles.canonical(spark.createDataFrame([(k,) for k in cases], "title string"), aliases).collect()}
    assert got == cases
    assert spark.range(1).select(mentions.similarity(F.lit("backend engineer"), F.lit("backend engineers"))).first()[0] > 0.8


def test_fuzzy_titles_equal_brute_force_over_all_aliases(spark):
    def grams(text):
        return {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", text.lower()) for i in range(len(w) + 1)}

    known = {"backend engineer": "backend", "data engineer": "data", "frontend developer": "frontend", "machine learning engineer": "ml", "site reliability engineer": "sre"}
    cases = {"Backends Engineers": "backend", "Senior Backends Engineers (Remote, US only)": "backend", "Dataengineer": "data", "Staff Frontends Developers [Growth Team of the Year]": "frontend", "Machine-Learnings Engineering": "ml", "Backend Engineer": "backend", "Cook": None, "(Remote)": None, "": None}
    aliases = spark.createDataFrame(list(known.items()), "alias string, slug string")
    got = {r["title"]: r for r in titles.resolved(spark.createDataFrame([(k,) for k in [*cases, None]], "title string"), aliases).collect()}
    assert {t: r["slug"] for t, r in got.items()} == cases
    for r in got.values():
        best = max((len(grams(a) & grams(r["normalized"] or "")) / len(grams(a) | grams(r["normalized"] or "")), a) for a in known)
        assert r["slug"] == (known[best[1]] if best[0] > titles.FUZZY else None), r


def test_health_counts_titles_as_the_resolution_does(spark):
    known, sf_dir = queries.queries(), "/root/testdata/sf0.001"
    found = {r["title"]: r["slug"] for r in known["canonical_titles"](spark, sf_dir).collect()}
    listed = {r["title"] for r in known["extraction_health"](spark, sf_dir).collect()}
    assert listed and not any(found[t] for t in listed) and any("Engineer of Backends" in t for t in found)


def test_places(spark):
    cities = spark.createDataFrame([("New York City", "NY", 40.7, -74.0, 8_000_000), ("London", "OH", 39.9, -83.4, 10_000), ("Washington", "DC", 38.9, -77.0, 700_000), ("Oakland", "CA", 37.8, -122.3, 400_000), ("California", "MD", 38.3, -76.5, 12_000)], "city string, state string, lat double, lon double, population long")
    world = spark.createDataFrame([("london",)], "name string")
    cases = {"New York, New York": "New York City", "NYC": "New York City", "Greater Oakland Area, CA": "Oakland", "London, UK": None, "London": None, "London, OH": "London", "Washington, DC": "Washington", "California": None, "Remote - US": None, "Remote - Oakland": "Oakland"}
    got = {r["raw_text"]: r["city"] for r in places.resolve(spark.createDataFrame([(k,) for k in cases], "raw_text string"), cities, world).collect()}
    assert got == {k: v for k, v in cases.items() if v}


def test_resumes(spark):
    text = "Ada Lovelace\nada@x.org | (555) 210-0001\nExperience\nSenior Engineer at Acme\nMar 2015 - Present\n• did things in 2001 - 2003\nInitech, Developer\n2010 to 2012\nEducation\nState University\nB.S. in Computer Science, 2009\nM.S. in Physics, 2011\n"
    laid = resume.laid_out(spark.createDataFrame([(1, text)], "resume_id long, text string"))
    c = resume.contacts(laid).first()
    assert (c["full_name"], c["email"], c["phone"]) == ("Ada Lovelace", "ada@x.org", "(555) 210-0001")
    e = [(r["title_raw"], r["company"], r["start_date"].year, r["is_current"]) for r in resume.experiences(laid).orderBy("position").collect()]
    assert e == [("Senior Engineer", "Acme", 2015, True), ("Developer", "Initech", 2010, False)]
    d = [(r["institution"], r["degree_level"], r["field_of_study"], r["end_year"]) for r in resume.educations(laid).orderBy("position").collect()]
    assert d == [("State University", "bachelor", "Computer Science", 2009), ("State University", "master", "Physics", 2011)]


def _parsed(spark, parse, header, body):
    text = f"{header}\n{body}"
    laid = resume.laid_out(spark.createDataFrame([(1, text)], "resume_id long, text string"))
    return text, [r.asDict() for r in parse(laid).orderBy("position").collect()]


def test_experience_entries(spark):
    body = "Site Reliability Engineer\nPied Piper\nApr 2021 - now\n* kept it up\n\nand running\nHooli | Data Analyst | 01/2018 – 03/2021\n- wrote (2019 - 2020) reports\nLead Designer, Staff Tools\n2014 to 2016\n\n2011 - 2012\nAlone\n\nBarn Owls\nWoodland\nSept. 2009 until May 2010\nCook\n2008 - 2001\n"
    text, got = _parsed(spark, resume.experiences, "Experience", body)
    assert [(e["title_raw"], e["company"]) for e in got] == [("Site Reliability Engineer", "Pied Piper"), ("Data Analyst", "Hooli"), ("Lead Designer, Staff Tools", None), ("Barn Owls — Woodland", None)]
    assert [(e["start_date"].isoformat()[:7], e["end_date"] and e["end_date"].isoformat()[:7], e["is_current"]) for e in got] == [("2021-04", None, True), ("2018-01", "2021-03", False), ("2014-01", "2016-01", False), ("2009-09", "2010-05", False)]
    assert [e["summary"] for e in got] == ["* kept it up\nand running", "- wrote (2019 - 2020) reports", "", "Cook\n2008 - 2001"]
    spans = [text[e["start"] : e["end"]] for e in got]
    assert spans[0] == text[text.index("Site") : text.index("\nHooli")] and spans[1].startswith("Hooli |") and spans[1].endswith("reports")
    assert spans[2] == "Lead Designer, Staff Tools\n2014 to 2016\n" and spans[3].startswith("Barn Owls")
    prose = "For a long while I looked after people who joined us from Jan 2017 to Dec 2018 in both of the offices.\n"
    assert _parsed(spark, resume.experiences, "Experience", prose)[1] == [] and _parsed(spark, resume.experiences, "Experience", "")[1] == []


def test_education_entries(spark):
    body = "BSc in Botany, 1990\nRoyal Conservatory of Music,\nMaster of Arts in Music Theory, 2001 - 2003\nB.A. in Piano, Sept 1997 to June 2000\nMBA\nEvening schooling 2005\nOpen University\nCourses in Welding, 2010 and 2011\n"
    text, got = _parsed(spark, resume.educations, "Education", body)
    keys = ("institution", "degree_raw", "degree_level", "field_of_study", "start_year", "end_year")
    assert [tuple(e[k] for k in keys) for e in got] == [
        (None, "BSc in Botany", "bachelor", "Botany", None, 1990),
        ("Royal Conservatory of Music", "Master of Arts in Music Theory", "master", "Music Theory", 2001, 2003),
        ("Royal Conservatory of Music", "B.A. in Piano", "bachelor", "Piano", 1997, 2000),
        ("Royal Conservatory of Music", "MBA", "master", None, None, 2005),
        ("Open University", None, None, None, None, 2010),
    ]
    assert text[got[1]["start"] : got[1]["end"]] == "Royal Conservatory of Music,\nMaster of Arts in Music Theory, 2001 - 2003"
    assert text[got[3]["start"] : got[3]["end"]] == "MBA\nEvening schooling 2005"


def test_profiles_from_resumes(spark):
    body = "Ada Byron\nada@x.org\nExperience\nSenior Backend Engineer at Acme\nJan 2020 - Jul 2022\n- Go code, Go services\nBackend Engineer, Initech\nJan 2021 to Present\nEducation\nOpen University\nB.A. in Logic, 1990\nPh.D. in Engines, 1999\n"
    resumes = spark.createDataFrame([(1, body), (2, "Experience\n"), (3, None)], "resume_id long, text string")
    aliases = spark.createDataFrame([("Go", "go", True, True), ("Rust", "rust", True, True)], "alias string, slug string, case_sensitive boolean, require_context boolean")
    families = spark.createDataFrame([("backend engineer", "backend")], "alias string, slug string")
    built = profiles.build(resumes, aliases, families)
    got = {r["resume_id"]: tuple(r)[1:] for r in profiles.facts(built, "2023-01-01").collect()}
    assert got == {1: (["go"], ["backend"], 3.0, "senior", "doctorate"), 2: ([], [], None, None, None), 3: ([], [], None, None, None)}
    named = {r["resume_id"]: r["full_name"] for r in built["profiles"].collect()}
    assert named == {1: "Ada Byron", 2: None, 3: None}
    old = {"profiles": built["profiles"].withColumn("resume_id", F.col("resume_id") + 1), "skills": built["skills"].withColumn("resume_id", F.lit(4).cast("long"))}
    kept = profiles.replaced(old, {n: built[n] for n in old})
    assert sorted(r[0] for r in kept["profiles"].select("resume_id").collect()) == [1, 2, 3, 4] and kept["skills"].count() == 2


def test_taxonomy_and_gold_set(spark, tmp_path):
    lines = [{"name": "Apache Kafka", "category": "messaging", "aliases": [{"alias": "Kafka", "case_sensitive": True}]}, {"name": "C++", "slug": "cpp", "category": "languages", "match": {"require_context": True}}]
    (tmp_path / "t.json").write_text("\n".join(json.dumps(x) for x in lines))
    entries = taxonomy.checked(taxonomy.technologies(spark, str(tmp_path / "t.json")))
    assert {tuple(r) for r in taxonomy.aliases(entries).collect()} == {("Apache Kafka", "apache-kafka", False, False), ("Kafka", "apache-kafka", True, False), ("C++", "cpp", False, True)}
    with pytest.raises(ValueError, match="duplicate slug: cpp; unknown category: cpp"):
        taxonomy.checked(entries.unionByName(entries.where("slug = 'cpp'").withColumn("category", F.lit("spells"))))
    (tmp_path / "n.json").write_text(json.dumps({"name": "Data Engineer", "slug": "data", "aliases": ["ETL Developer"]}))
    assert {tuple(r) for r in taxonomy.titles(spark, str(tmp_path / "n.json")).collect()} == {("data engineer", "data"), ("etl developer", "data")}
    gold = [{"id": "a", "text": "x", "technologies": {"go": "required", "c": "mentioned"}, "experience_level": "mid", "salary_annual_min": 5, "salary_annual_max": 9}, {"id": "b", "text": "y", "canonical_title": "data"}, {"id": "c", "text": ""}]
    (tmp_path / "g.json").write_text("\n".join(json.dumps(x) for x in gold))
    docs = taxonomy.gold_documents(spark, str(tmp_path / "g.json"))
    truth = docs.select("id", F.col("canonical_title").alias("title"), F.col("experience_level").alias("level"), "arrangement", F.col("salary_annual_min").alias("salary_min"), F.col("salary_annual_max").alias("salary_max"))
    found = spark.createDataFrame([("a", None, "mid", "remote", 5.0, 8.0), ("b", "data", None, None, 1.0, 2.0)], "id string, title string, level string, arrangement string, salary_min double, salary_max double")
    assert {tuple(r) for r in evaluate.accuracy(found, truth, "id").collect()} == {("title", 1, 1), ("level", 1, 1), ("arrangement", 0, 1), ("salary", 0, 1)}
    assert {tuple(r) for r in evaluate.mistakes(found, truth, "id").collect()} == {("a", "arrangement", "remote", None), ("a", "salary", "5-8", "5-9")}
    terms = spark.createDataFrame([("a", "go", "preferred"), ("a", "c", "mentioned"), ("b", "go", "required")], "id string, slug string, level string")
    assert tuple(evaluate.requirement_accuracy(terms, taxonomy.gold_terms(docs), ["id", "slug"]).first()) == (1, 2)


def test_match_arithmetic(spark):
    jt = spark.createDataFrame([(1, 1, "required"), (1, 2, "required"), (1, 3, "required"), (1, 4, "preferred"), (1, 5, "preferred"), (1, 6, "mentioned")], "job_id long, tech_id long, requirement string")
    profiles = spark.createDataFrame([(9, "senior", None)], "profile_id long, level string, years double")
    own = spark.createDataFrame([(9, t) for t in (1, 2, 4, 6)], "profile_id long, tech_id long")
    held = spark.createDataFrame([(9, 7)], "profile_id long, title_id int")
    jobs = spark.createDataFrame([(1, 7, "senior", None)], "job_id long, title_id int, experience_level string, years_of_experience double")
    shared = matching.pairs(matching.facts(profiles, own, held), matching.needs(jobs, jt))
    scored = matching.score(shared)
    r = scored.first()
    assert matching.score_all(matching.facts(profiles, own, held), matching.needs(jobs, jt)).collect() == scored.drop("matched_skills", "missing_skills").collect()
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["", "Python", "go", "Kafka", "AWS", "C++", "bash"])], "tech_id long, name string")
    roles = spark.createDataFrame([(7, "Backend Engineer")], "title_id int, title_name string")
    said = matching.explain(matching.ranked(scored, 20), matching.facts(profiles, own, held), jobs, jt, names, roles).first()
    assert said["reasons"] == ["Matches 2 of 3 required skills (go, Python)", "Missing 1 required skill(s): Kafka", "Your background includes the Backend Engineer role", "Your experience meets the senior requirement"]
    assert said["matched_skills"] == ["go", "Python", "AWS", "bash"] and said["missing_skills"] == ["Kafka", "C++"]
    assert (said["skills_detail"], said["title_detail"], said["experience_detail"]) == ("You have 2 of 3 required skills.", "You have held a Backend Engineer role.", "Your experience meets the senior level.")
    loose = spark.createDataFrame([(2, 6, "mentioned"), (2, 1, "mentioned")], "job_id long, tech_id long, requirement string")
    other = spark.createDataFrame([(2, 8, None, 5.0)], "job_id long, title_id int, experience_level string, years_of_experience double")
    unclear = matching.ranked(matching.score(matching.pairs(matching.facts(profiles, own, held), matching.needs(other, loose))), 20)
    said = matching.explain(unclear, matching.facts(profiles, own, held), other, loose, names, roles).first()
    assert said["reasons"] == ["Matches skills this posting lists (bash, Python)"] and said["experience_detail"] == "Not enough experience detail on your profile to compare."
    assert (said["skills_detail"], said["title_detail"]) == ("You have 2 of the skills this posting mentions.", "No canonical role family to compare.")
    assert shared.count() == 1 and sorted(r["matched_skills"]) == [1, 2, 4, 6] and sorted(r["missing_skills"]) == [3, 5]
    assert (r["score"], r["matched"], r["matched_required"], r["missing"], r["verdict"]) == (79, 4, 2, 2, "meets") and r["title_points"] == 25.0


def test_gold_metrics_and_tenure(spark):
    p = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "doc_id long, slug string, cat string")
    t = spark.createDataFrame([(1, "a", "x"), (3, "c", "y")], "doc_id long, slug string, cat string")
    got = {r["cat"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.precision_recall(p, t, ["doc_id", "slug"], "cat").collect()}
    assert got == {"x": (1, 1, 0), "y": (0, 0, 1), None: (1, 1, 1)}
    spans = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2021, 1, 1), False), (1, dt.date(2020, 6, 1), dt.date(2021, 6, 1), False), (1, dt.date(2022, 1, 1), None, True), (1, dt.date(2019, 1, 1), None, False)], "profile_id long, start_date date, end_date date, is_current boolean")
    assert resume.tenure(spans, "profile_id", "2022-07-01").first()["months"] == 17 + 6


def test_feeds(spark):
    a = '{"id": 7, "title": "Dev", "content": "&lt;p&gt;x&lt;/p&gt;", "absolute_url": "http://x/1", "updated_at": "2024-01-02T03:04:05Z", "location": {"name": "SF"}, "offices": [{"name": "SF"}, {"name": "NYC"}], "metadata": [{"name": "Employment Type", "value": ["Contract"]}]}'
    b = '{"id": "z", "text": "Dev", "hostedUrl": "http://y", "country": "US", "createdAt": 1700000000000, "description": "<p>d</p>", "additional": "", "lists": [{"text": "H", "content": "<li>c</li>"}], "categories": {"allLocations": ["SF"], "location": "LA", "commitment": "Intern"}}'
    r = feeds.feed_a(spark.createDataFrame([(a,), ("not json",)], "payload string")).collect()
    assert len(r) == 1 and (r[0]["external_id"], r[0]["description_html"], r[0]["location_texts"], r[0]["employment_type"]) == ("7", "<p>x</p>", ["SF", "NYC"], "contract")
    r = feeds.feed_b(spark.createDataFrame([(b,), (b.replace('"US"', '"DE"'),)], "payload string")).collect()
    assert len(r) == 1 and (r[0]["description_html"], r[0]["location_texts"], r[0]["employment_type"]) == ("<p>d</p>\n<h3>H</h3>\n<li>c</li>", ["SF", "LA"], "internship")


def test_feeds_take_any_shape_and_any_order_of_keys(spark):
    said = lambda metadata: json.dumps({"id": 1, "title": "x", "metadata": metadata})
    cases = [
        (said([{"name": "Employment Type", "value": "Part-time"}, {"name": "Team", "value": {"id": 4, "name": "x"}}, {"name": "Remote", "value": True}, {"name": "Level", "value": 3.5}]), "part_time"),
        (said([{"name": "Team", "value": ["a", 1]}, {"name": " commitment ", "value": [None, 7, {"a": 1}, "Intern"]}]), "internship"),
        (said([{"name": "Job Type", "value": None}, {"name": "Job Type", "value": {"deep": ["Contract"]}}, {"value": "Contract"}, "odd"]), None), (said("odd"), None), (said(None), None),
    ]
    got = {r["payload"]: r["employment_type"] for r in feeds.feed_a(spark.createDataFrame([(p,) for p, _ in cases], "payload string")).collect()}
    assert got == dict(cases)
    one = '{"id": "z", "text": "Dev", "lists": [{"text": "H", "content": "c", "more": {"x": [1, {"p": 1, "q": 2}], "y": null}}], "country": "US"}'
    same = '{"country":"US", "lists": [{"more": {"y": null, "x": [1, {"q": 2, "p": 1}]}, "content": "c", "text": "H"}], "text": "Dev", "id": "z"}'
    other = one.replace('"q": 2', '"q": 3')
    hashes = [r["content_hash"] for p in (one, same, other) for r in feeds.feed_b(spark.createDataFrame([(p,)], "payload string")).collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    broken = ["not json", '{"id": 1', "[]", "null", None, '{"title": "no id"}']
    assert feeds.feed_a(spark.createDataFrame([(p,) for p in broken], "payload string")).count() == feeds.feed_b(spark.createDataFrame([(p,) for p in broken], "payload string")).count() == 0


def test_streams(spark, tmp_path):
    landing = str(tmp_path / "in")
    rows = "source_id string, external_id string, content_hash string, payload string, seen_at timestamp"
    state = StateTable(spark, str(tmp_path / "state"))
    for batch in ([("a", "1", "h1", "p", dt.datetime(2024, 1, 1))], [("a", "1", "h2", "p", dt.datetime(2024, 1, 2)), ("a", "2", "h", "p", dt.datetime(2024, 1, 2))]):
        spark.createDataFrame(batch, rows).coalesce(1).write.mode("append").parquet(landing)
        q = merge_stream(spark.readStream.schema(rows).parquet(landing), state, str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["external_id"]: r["content_hash"] for r in state.before(2).collect()}
    assert got == {"1": "h2", "2": "h"}
    landed = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(landed)
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(landed)
    q = daily(events).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from days").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_plans_keep_their_shape(micro):
    plan = matching_jobs(micro, [Scope.canonical(location="oakland")])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = snapshots.metro_members(micro.job_locations, micro.cities, 25)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_extraction_resumes_by_slices(spark, tmp_path):
    from vacancia.operators import extraction

    rows = spark.createDataFrame([(i, "Senior Engineer" if i % 2 else "Engineer", f"{i % 12}+ years of experience") for i in range(60)], "job_id long, title string, text string")
    path = str(tmp_path / "facts")
    calls = []
    watched = lambda df: calls.append(sorted(r["job_id"] for r in df.select("job_id").collect())) or extraction.facts(df)
    assert extraction.run(rows, path, watched, slices=4, most=2) == 2
    first = list(calls)
    assert extraction.run(rows, path, watched, slices=4) == 2
    assert sorted(i for c in calls for i in c) == list(range(60)) and calls[:2] == first
    assert extraction.run(rows, path, watched, slices=4) == 0 and len(calls) == 4
    more = rows.union(spark.createDataFrame([(100, "Engineer", "")], rows.schema))
    assert extraction.run(more, path, watched, slices=4) == 1 and calls[-1] == [100]
    c = extraction.counters(extraction.extracted(spark, path)).first()
    assert (c["processed"], c["with_level"], c["with_salary"]) == (61, 30 + sum(0 < i % 12 for i in range(0, 60, 2)), 0)


def test_character_references_and_declared_types(spark):
    from html import unescape

    from pyspark.sql import functions as F

    from vacancia.functions import text as T

    texts = ["a &#8217; b &eacute;&#x27;&amp;lt; &nosuch; & x; &#128; &#0; &#x1F600; &#1114112;", "plain", "", None, "&lt;p&gt;"]
    texts += ["R&amp D", "a&nbspb &copy 2020 &#8217 x &#x2019y &notit; &notit &lt&gt;", "&ampamp; &AMP;&AMP x &foo &foo; & ;", "&#0;&#1;&#11;&#128&#129;&#xFFFE;&#99999999999;&#x0000041;&#00065 &#; &#x; &#xD800;", "?a=1&copy=2&region=3&sect;ion"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.unescaped(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in got] == [t and unescape(t) for t in texts]
    declared = {"Full-Time / Salaried": "full_time", "Permanent (UK)": "full_time", "Intern - Summer": "internship", "W2 Contract": "contract", "FULL_TIME": "full_time", "nothing": None, "": None, None: None}
    rows = spark.createDataFrame([(d,) for d in declared], "d string").select("d", T.declared_employment(F.col("d")).alias("e")).collect()
    assert {r["d"]: r["e"] for r in rows} == declared


def test_a_scope_with_a_text_query_counts_what_matches(micro):
    assert count(micro, q="no such words zzz") == 0 < count(micro)
    assert count(micro, q="engineer") == count(micro)
    assert count(micro, q="python postgresql") == count(micro, technologies=["python", "postgresql"])
    assert count(micro, q="go or react") == count(micro, technologies=["go"]) + count(micro, technologies=["react"])
    assert count(micro, q="python", arrangement="remote") == count(micro, technologies=["python"], arrangement="remote")
    assert count(micro, q='"python postgresql"', location="san-francisco") == 6
    ranked = matching_jobs(micro, [Scope.canonical(q="python"), Scope()], ranked=True)
    assert ranked.where("scope_id = 0 and rank is null or scope_id = 1 and rank is not null").count() == 0


def test_a_letter_that_begins_a_word_means_no_thousands(spark):
    texts = ["Call +1 (516) 555-0924 keit enie", "Call 555-0924 kété", "Pays 150-180k.", "Pays $90 K a year", "Bonus $40 kinds"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.salary(F.col("text")).alias("s")).orderBy("i").collect()
    assert [r["s"] and (r["s"]["low"], r["s"]["high"]) for r in rows] == [None, None, (150_000.0, 180_000.0), (90_000.0, 90_000.0), None]


def test_best_jobs_without_a_row_for_each_pair(spark, monkeypatch):
    import random

    r = random.Random(5)
    levels, kinds = [None, *matching.LEVELS], ["required", "preferred", "mentioned"]
    jobs = [(j, r.choice([None, 1, 2, 3]), r.choice(levels), r.choice([None, 0.0, 2.0, 7.0])) for j in range(300)]
    jt = [(j, t, r.choice(kinds)) for j in range(300) if j % 9 for t in r.sample(range(12), r.randint(0, 5))]
    own = [(p, t) for p in range(40) for t in r.sample(range(14), r.randint(0, 8))]
    profiles = spark.createDataFrame([(p, r.choice(levels), r.choice([None, 0.0, 1.5, 9.0])) for p in range(40)], "profile_id long, level string, years double")
    held = spark.createDataFrame([(p, r.choice([1, 2])) for p in range(40) if p % 3], "profile_id long, title_id int")
    people = matching.facts(profiles.union(spark.createDataFrame([(90, None, None), (91, None, None)], profiles.schema)), spark.createDataFrame(own + [(90, 3), (91, 3)], "profile_id long, tech_id long"), held)
    wanted = matching.needs(spark.createDataFrame(jobs, "job_id long, title_id int, experience_level string, years_of_experience double"), spark.createDataFrame(jt, "job_id long, tech_id long, requirement string"))
    want = matching.ranked(matching.score_all(people, wanted), 7)
    monkeypatch.setattr(matching, "BLOCK_JOBS", 60)
    monkeypatch.setattr(matching, "BLOCK_CANDIDATES", 16)
    got = matching.best(people, wanted, 7)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 250
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and got.where("profile_id in (90, 91)").groupBy("profile_id").count().count() == 2


def test_match_explanations_keep_every_pair_of_classes(spark):
    rows = queries.queries()["match_explanations"](spark, "/root/testdata/sf0.001").cache()
    pairs = rows.where("class_id is null")
    of = lambda key: rows.where(f"class_id is not null and {key} is not null").select(F.col(key).alias(f"_{key}"), F.col("class_id").alias(key))
    every = pairs.select("profile_id", "job_id").join(of("profile_id"), "profile_id").join(of("job_id"), "job_id")
    m = queries.Market(spark, "/root/testdata/sf0.001")
    assert every.count() == matching.score_all(queries._profiles(m), queries._wanted(m)).count() > 20 * pairs.select("profile_id").distinct().count()


def test_match_explanations_have_a_row_for_each_pair(spark, tmp_path):
    for t in ("nation", "region", "supplier", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    shift = {"customer": {"c_custkey": 600}, "orders": {"o_orderkey": 15_600, "o_custkey": 600}, "lineitem": {"l_orderkey": 15_600}}  # keys that keep what depends on them
    for t, keys in shift.items():
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        rows.union(rows.withColumns({k: F.col(k) + by for k, by in keys.items()}).select(*rows.columns)).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = queries.queries()["match_explanations"](spark, str(tmp_path)).cache()
    pairs = rows.where("class_id is null")
    m = queries.Market(spark, str(tmp_path))
    every = matching.score_all(queries._profiles(m), queries._wanted(m)).select("profile_id", "job_id", "score", *[f"{k}_points" for k in matching.WEIGHTS], "verdict")
    assert every.count() == pairs.count() and every.exceptAll(pairs.select(*every.columns)).count() == 0
    assert rows.where("class_id <> coalesce(profile_id, job_id)").count() > 0  # some agree in all facts: a pair of classes doesn't stand for them


def test_later_rounds_of_a_search_find_only_what_is_better(spark, monkeypatch):
    import random

    import pyarrow as pa

    from vacancia.operators import blocks

    r = random.Random(7)
    levels, kinds = [None, *matching.LEVELS], ["required", "preferred", "mentioned"]
    jobs = [(j, r.choice([None, 1, 2]), r.choice(levels), r.choice([None, 0.0, 4.0])) for j in range(900)]
    jt = [(j, t, q) for j in range(900) if j % 11 for t in r.sample(range(9), r.randint(0, 4)) for q in ([r.choice(kinds)] if j % 5 else kinds[:2])]  # some list one twice
    profiles = spark.createDataFrame([(p, r.choice(levels), r.choice([None, 0.0, 3.0])) for p in range(50)], "profile_id long, level string, years double")
    own = spark.createDataFrame([(p, t) for p in range(50) for t in r.sample(range(10), p % 7)], "profile_id long, tech_id long")
    people = matching.facts(profiles, own, spark.createDataFrame([(p, 1 + p % 3) for p in range(50) if p % 4], "profile_id long, title_id int"))
    wanted = matching.needs(spark.createDataFrame(jobs, "job_id long, title_id int, experience_level string, years_of_experience double"), spark.createDataFrame(jt, "job_id long, tech_id long, requirement string"))
    want = matching.ranked(matching.score_all(people, wanted), 5)
    monkeypatch.setattr(matching, "FIRST_JOBS", 20)
    monkeypatch.setattr(matching, "BLOCK_JOBS", 200)
    monkeypatch.setattr(matching, "MORE", 6)
    got = matching.best(people, wanted, 5)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 200

    text = lambda frame: pa.Table.from_pylist([
        {k: [str(x) for x in v] if isinstance(v, list) else str(v) if k == "title_id" and v is not None else v for k, v in row.asDict().items()} for row in frame.collect()
    ])
    a, b = text(wanted.select("job_id", "title_id", F.col("years_of_experience"), F.col("want_rank").cast("double"), *kinds)), text(people)
    every = blocks.best(a, b, 5)
    last = {p: None for p in every.column("profile_id").to_pylist()}
    found = sorted(every.to_pylist(), key=lambda x: (x["profile_id"], -x["score"], -x["matched_required"], -x["matched"], x["job_id"]))
    for p in last:
        last[p] = [x for x in found if x["profile_id"] == p][2]  # the third is the floor: the first two are better
    floors = {f"floor_{n}": [last[p][c] if p in last else None for p in b.column("profile_id").to_pylist()] for n, c in (("score", "score"), ("required", "matched_required"), ("matched", "matched"), ("job", "job_id"))}
    for n, values in floors.items():
        b = b.append_column(n, pa.array(values, pa.int64()))
    better = sorted(blocks.best(a, b, 5).to_pylist(), key=lambda x: (x["profile_id"], -x["score"], -x["matched_required"], -x["matched"], x["job_id"]))
    assert better == [x for p in sorted(last) for x in [y for y in found if y["profile_id"] == p][:2]]


def test_pairs_are_explained_once_for_all_who_share_the_same(spark, monkeypatch):
    import random

    import pyarrow as pa

    from vacancia.operators import blocks

    r = random.Random(3)
    levels, kinds = [None, *matching.LEVELS], ["required", "preferred", "mentioned"]
    jobs = spark.createDataFrame([(j, r.choice([None, 1, 2, 7]), r.choice(levels), r.choice([None, 0.0, 2.0, 7.5])) for j in range(150)], "job_id long, title_id int, experience_level string, years_of_experience double")
    jt = spark.createDataFrame([(j, t, q) for j in range(150) if j % 9 for t in r.sample(range(12), r.randint(0, 7)) for q in ([r.choice(kinds)] if j % 5 else kinds[1:])], "job_id long, tech_id long, requirement string")
    names = spark.createDataFrame([(t, None if t == 4 else f"{'xYzA'[t % 4]}{t}") for t in range(11)], "tech_id long, name string")
    roles = spark.createDataFrame([(1, "One"), (2, "Two")], "title_id int, title_name string")
    profiles = spark.createDataFrame([(p, r.choice(levels), r.choice([None, 0.0, 1.5, 9.0])) for p in range(60)], "profile_id long, level string, years double")
    own = spark.createDataFrame([(p, t) for p in range(60) for t in r.sample(range(13), p % 8)], "profile_id long, tech_id long")
    people = matching.facts(profiles, own, spark.createDataFrame([(p, r.choice([1, 2, 7])) for p in range(60) if p % 3], "profile_id long, title_id int"))
    wanted = matching.needs(jobs, jt)
    want = matching.explain(matching.score(matching.pairs(people, wanted)), people, jobs, jt, names, roles)
    want = want.withColumns({c: F.array_join(c, ", ") for c in ("matched_skills", "missing_skills")} | {"reasons": F.array_join("reasons", " | ")})
    monkeypatch.setattr(matching, "PAIR_JOBS", 40)
    monkeypatch.setattr(matching, "PAIR_CANDIDATES", 25)
    got = matching.explain_all(people, wanted, jobs, jt, names, roles)
    rows = sorted(map(repr, got.collect()))
    assert rows == sorted(map(repr, want.select(*got.columns).collect())) and len(rows) > 3000

    told = wanted.join(matching._asked(jobs, jt, names, roles).drop("title_id"), "job_id").withColumn("want_rank", F.col("want_rank").cast("double"))
    a, b = told.toArrow(), people.withColumn("own_rank", F.col("own_rank").cast("double")).toArrow()
    one = blocks.alike(a, b).to_pylist()
    assert sum(len(g["members"]) for x in one for g in x["people"]) == len(rows) > 2 * len(one) > 0  # names are listed for fewer
    monkeypatch.setattr(blocks, "BITS", 2)  # jobs with more technologies than one number tells apart
    plain = lambda found: sorted(repr({**x, "people": sorted(x["people"], key=repr)}) for x in found)
    assert plain(blocks.alike(a, b).to_pylist()) == plain(one)
    assert blocks.alike(a, b.slice(0, 0)).num_rows == blocks.alike(a.slice(0, 0), b).num_rows == 0 and isinstance(blocks.alike(a.slice(0, 0), b), pa.Table)
