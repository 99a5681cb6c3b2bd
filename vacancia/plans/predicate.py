"""One predicate for every number: which jobs count in which scope.

Scopes are literals (dashboards); any number of them is answered in one pass over the jobs: each job gets the array of
scopes it belongs to, which is exploded. Technologies and places are looked up in per-job flags that are aggregated from
the bridge tables, so a job in five places stays one job.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions import geo
from vacancia.operators import fulltext
from vacancia.sources.bindings import TITLES, Market

#: Fixed values.
BUCKETS = (10, 25, 50, 100)
LEVELS, ARRANGEMENTS, EMPLOYMENT = ("entry", "mid", "senior", "staff_plus"), ("onsite", "hybrid", "remote"), ("full_time", "part_time", "contract", "temporary", "internship", "unknown")


@dataclass(frozen=True)
class Scope:
    """Filters of one dashboard, in canonical form (see canonical())."""

    q: str | None = None
    title: str | None = None
    technologies: tuple[str, ...] = ()
    arrangement: str | None = None
    experience_level: str | None = None
    employment_type: str | None = None
    salary_min: int | None = None
    location: str | None = None
    radius_miles: int = 50

    @staticmethod
    def canonical(**given) -> "Scope":
        unknown = set(given) - set(Scope.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
        for name, allowed in (("arrangement", ARRANGEMENTS), ("experience_level", LEVELS), ("employment_type", EMPLOYMENT)):
            if given.get(name) is not None and given[name] not in allowed:
                raise ValueError(f"{name}: {given[name]}")
        text = re.sub(r"\s+", " ", given.get("q") or "").strip().lower() or None
        lower = {k: (given.get(k) or "").strip().lower() or None for k in ("title", "location")}
        techs = tuple(sorted({t.strip().lower() for t in given.get("technologies") or ()}))
        radius = next((b for b in BUCKETS if b >= (given.get("radius_miles") or 50)), BUCKETS[-1])
        return Scope(**{**given, "q": text, **lower, "technologies": techs, "radius_miles": radius})

    def canonical_dict(self) -> dict:
        kept = {k: v for k in self.__dataclass_fields__ if (v := getattr(self, k)) not in (None, ()) and k != "radius_miles"}
        return kept | ({"radius_miles": self.radius_miles} if self.location else {})

    def key(self) -> str:
        return hashlib.sha256(json.dumps(self.canonical_dict(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def without(self, technology: str) -> "Scope":
        """The market a technology's share is measured in."""
        return Scope(**{**{k: getattr(self, k) for k in self.__dataclass_fields__}, "technologies": tuple(t for t in self.technologies if t != technology)})


@dataclass(frozen=True)
class Resolved:
    """Scopes with their slugs turned into ids and coordinates."""

    scopes: tuple[Scope, ...]
    tech_ids: dict[str, int] = field(default_factory=dict)
    places: dict[str, tuple[float, float]] = field(default_factory=dict)
    titles: dict[str, int] = field(default_factory=dict)

    @property
    def texts(self) -> list[str]:
        """The distinct text queries of the scopes."""
        return sorted({s.q for s in self.scopes if s.q})

    def near(self, place: str) -> str:
        """The column with a job's least distance to a place."""
        return f"_near_{sorted(self.places).index(place)}"

    def rank(self, q: str) -> str:
        """The column with a job's rank for a text query; NULL where it doesn't match."""
        return f"_rank_{self.texts.index(q)}"


def resolve(market: Market, scopes: list[Scope]) -> Resolved:
    """Looks up the slugs that the scopes name (only those are collected); an unknown one is an error, not an empty result."""
    techs, places = sorted({t for s in scopes for t in s.technologies}), sorted({s.location for s in scopes if s.location})
    titles = {slug: i for i, slug in TITLES.values()}
    found = {r["slug"]: r["tech_id"] for r in market.technologies.where(F.col("slug").isin(techs)).select("slug", "tech_id").collect()} if techs else {}
    at = {r["city_slug"]: (r["lat"], r["lon"]) for r in market.cities.where(F.col("city_slug").isin(places)).collect()} if places else {}
    missing = [t for t in techs if t not in found] + [p for p in places if p not in at] + [s.title for s in scopes if s.title and s.title not in titles]
    if missing:
        raise ValueError(f"unknown: {', '.join(missing)}")
    return Resolved(tuple(scopes), found, at, titles)


def countable() -> Column:
    """Active, and not a copy that another row stands for."""
    return (F.col("status") == "active") & (F.col("dedupe_group_id").isNull() | (F.col("dedupe_group_id") == F.col("job_id")))


def conditions(scope: Scope, known: Resolved) -> dict[str, Column]:
    """The conditions of a scope by name; text, technologies and place read the flags that flagged_jobs() adds."""
    out = {}
    if scope.q:
        out["q"] = F.col(known.rank(scope.q)).isNotNull()
    if scope.title:
        out["title"] = F.col("title_id") == known.titles[scope.title]
    for t in scope.technologies:
        out[f"technology:{t}"] = F.array_contains("_techs", known.tech_ids[t])
    for name in ("arrangement", "experience_level"):
        if getattr(scope, name):
            out[name] = F.col(name) == getattr(scope, name)
    if scope.employment_type:
        out["employment_type"] = F.coalesce("employment_type", F.lit("unknown")) == scope.employment_type
    if scope.salary_min is not None:
        out["salary_min"] = F.col("salary_annual_max") >= scope.salary_min
    if scope.location:
        out["location"] = F.col(known.near(scope.location)) <= scope.radius_miles * geo.MILE
    return {k: F.coalesce(c, F.lit(False)) for k, c in out.items()}


def flagged_jobs(market: Market, known: Resolved) -> DataFrame:
    """Countable jobs with the scoped technologies they ask for and their least distance to each scoped place."""
    jobs = market.jobs.where(countable())
    if known.tech_ids:
        flags = market.job_technologies.where(F.col("tech_id").isin(list(known.tech_ids.values()))).groupBy("job_id").agg(F.collect_set("tech_id").alias("_techs"))
        jobs = jobs.join(flags, "job_id", "left")
    if known.places:
        reach = BUCKETS[-1] * geo.MILE  # no radius is wider; what lies beyond matches no scope
        boxes = [geo.box(lat, lon, reach) for lat, lon in known.places.values()]
        spots = market.spots.where(reduce(lambda a, b: a | b, boxes))
        near = [F.min(geo.distance(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))).alias(known.near(p)) for p, (lat, lon) in known.places.items()]
        jobs = jobs.join(spots.groupBy("job_id").agg(*near), "job_id", "left")
    if known.texts:  # all queries of all scopes in one pass over the index
        terms = sorted({t for q in known.texts for t in fulltext.terms_of(q)})
        found = fulltext.ranks(fulltext.hits(market.text_index, terms), known.texts, "job_id").withColumnRenamed("ranks", "_ranks")
        jobs = jobs.join(found, "job_id", "left")
        without = {q: F.lit(0.0 if fulltext.matches_without_hits(q) else None).cast("double") for q in known.texts}
        jobs = jobs.withColumns({known.rank(q): F.when(F.col("_ranks").isNull(), without[q]).otherwise(F.get("_ranks", F.lit(i))) for i, q in enumerate(known.texts)}).drop("_ranks")
    return jobs


def matching_jobs(market: Market, scopes: list[Scope], ranked: bool = False) -> DataFrame:
    """scope_id (place in the list) and the columns of each matching job; with ``ranked``, its rank for the scope's text query."""
    known = resolve(market, scopes)
    jobs = flagged_jobs(market, known)
    member = []
    for i, scope in enumerate(scopes):
        fits = F.lit(True)
        for c in conditions(scope, known).values():
            fits = fits & c
        rank = F.col(known.rank(scope.q)) if scope.q else F.lit(None).cast("double")
        member.append(F.when(fits, F.struct(F.lit(i).alias("scope_id"), rank.alias("rank"))))
    rows = jobs.select(F.explode(F.array_compact(F.array(*member))).alias("m"), *market.jobs.columns)
    return rows.select("m.scope_id", *(["m.rank"] if ranked else []), *market.jobs.columns)


def scope_sql(scope: Scope, forms: dict[str, tuple[str, ...]] | None = None) -> str:
    """The predicate of one scope over the bound tables, for DuckDB; ``forms`` as in fulltext.matches_sql."""
    parts = ["status = 'active'", "(dedupe_group_id is null or dedupe_group_id = job_id)"]
    if scope.q:
        parts.append(f"exists (select 1 from job_texts x where x.job_id = j.job_id and {fulltext.matches_sql(scope.q, forms=forms)})")
    if scope.title:
        parts.append(f"title_id = {dict((s, i) for i, s in TITLES.values())[scope.title]}")
    parts += [f"exists (select 1 from job_technologies t join technologies using (tech_id) where t.job_id = j.job_id and slug = '{t}')" for t in scope.technologies]
    parts += [f"{n} = '{getattr(scope, n)}'" for n in ("arrangement", "experience_level") if getattr(scope, n)]
    if scope.employment_type:
        parts.append(f"coalesce(employment_type, 'unknown') = '{scope.employment_type}'")
    if scope.salary_min is not None:
        parts.append(f"salary_annual_max >= {scope.salary_min}")
    if scope.location:
        parts.append(f"exists (select 1 from job_locations l join cities c on c.city_slug = '{scope.location}' where l.job_id = j.job_id and {geo.distance_sql('l.lat', 'l.lon', 'c.lat', 'c.lon')} <= {scope.radius_miles} * {geo.MILE})")
    return " and ".join(parts)


def matching_sql(scopes: list[Scope], forms: dict[str, tuple[str, ...]] | None = None) -> str:
    """A common table expression ``matching`` with scope_id and the job's columns."""
    return "matching as (" + " union all ".join(f"select {i} as scope_id, j.* from jobs j where {scope_sql(s, forms)}" for i, s in enumerate(scopes)) + ")"
