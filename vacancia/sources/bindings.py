"""The driver's star schema seen as the canonical tables of a job market.

Roles are bound by fixed expressions, so the operators run over the whole given tables. What many queries join (jobs and
their bridges to technologies and places) is derived once in an application and stored bucketed by job_id, so that it is
joined and counted by job without an exchange; places are stored a second time in the order of map cells, so that a radius
search reads the files near its centre. ``SQL`` states the same bindings for DuckDB, as common table expressions that every
oracle query starts with.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators import fulltext
from vacancia.sources import stored

#: What stands for what.
LEVELS = {"1-URGENT": "staff_plus", "2-HIGH": "senior", "3-MEDIUM": "mid", "5-LOW": "entry"}
ARRANGEMENTS = {0: "onsite", 1: "hybrid", 2: "remote"}
EMPLOYMENT = {0: "full_time", 1: "part_time", 2: "contract", 3: "internship", 4: "temporary", 5: "unknown"}
TITLES = {"AUTOMOBILE": (1, "backend-engineer"), "FURNITURE": (2, "frontend-engineer"), "HOUSEHOLD": (3, "data-engineer"), "MACHINERY": (4, "ml-engineer")}
SOURCES = {0: ("boards", "ats_api", "full_text"), 1: ("federal", "gov_api", "full_text"), 2: ("aggregator", "aggregator_api", "extracted_only")}
REQUIREMENTS = {"R": (1, "required"), "A": (2, "preferred"), "N": (3, "mentioned")}


def _pick(c: Column, values: dict) -> Column:
    """The value for the key in ``c``, NULL if there is none."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def _case(column: str, values: dict) -> str:
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"case {column} " + " ".join(f"when {literal(k)} then {literal(v)}" for k, v in values.items()) + " end"


@dataclass(frozen=True)
class Market:
    """The canonical tables of one data folder, each a DataFrame."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _bucketed(self, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        return stored.bucketed(self.spark, name, self.sf_dir, rows, "job_id")

    @cached_property
    def jobs(self) -> DataFrame:
        return self._bucketed("jobs", self._jobs)

    @cached_property
    def job_technologies(self) -> DataFrame:
        """One row for each job and technology: the strongest requirement level."""
        return self._bucketed("job_technologies", self._job_technologies)

    @cached_property
    def job_locations(self) -> DataFrame:
        """One row for each job and place: a job may have several."""
        return self._bucketed("job_locations", self._job_locations)

    @cached_property
    def spots(self) -> DataFrame:
        """job_id, lat, lon of all known places, in the order of map cells."""
        path = stored.once(self.spark, "spots", self.sf_dir, lambda path: stored.by_cell(self.job_locations, path))
        return self.spark.read.parquet(path)

    def _jobs(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer").select("c_custkey", "c_mktsegment")
        key = F.col("o_orderkey")
        low = F.when(key % 3 != 0, F.col("o_totalprice").cast("decimal(12,2)"))
        high = F.when(key % 3 != 0, F.round(F.col("o_totalprice") * 1.2, 2).cast("decimal(12,2)"))
        rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            key.alias("job_id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("posted_at"),
            F.when(F.col("o_orderstatus") == "F", "expired").otherwise("active").alias("status"),
            _pick(F.col("o_orderpriority"), LEVELS).alias("experience_level"), _pick(key % 4, ARRANGEMENTS).alias("arrangement"), _pick(key % 7, EMPLOYMENT).alias("employment_type"),
            low.alias("salary_annual_min"), high.alias("salary_annual_max"), _pick(F.col("c_mktsegment"), {k: v[0] for k, v in TITLES.items()}).alias("title_id"),
            F.when(key % 2 == 0, (key % 12).cast("double")).alias("years_of_experience"), (key % 3).cast("int").alias("source_id"), F.when(key % 13 == 0, key).when(key % 13 == 1, key - 1).alias("dedupe_group_id"),
        )
        return stored.dealt(rows, "job_id")

    @cached_property
    def job_texts(self) -> DataFrame:
        """job_id, text: the title's words and the names of the job's parts, in the order of its lines."""
        words = {i: slug.replace("-", " ") for i, slug in TITLES.values()}
        parts = self.table("part").select("p_partkey", "p_name")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(parts, F.col("l_partkey") == F.col("p_partkey"))
        listed = lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("ls"))  # a few lines an order
        title = F.coalesce(_pick(F.col("title_id"), words), F.lit("engineer"))
        body = F.array_join(F.transform(F.coalesce("ls", F.array().cast("array<struct<l_linenumber: int, p_name: string>>")), lambda x: x["p_name"]), " ")
        return self.jobs.select("job_id", "title_id").join(listed, "job_id", "left").select("job_id", F.concat_ws(" ", title, body).alias("text"))

    @cached_property
    def text_index(self) -> fulltext.Index:
        """The stored index of job_texts."""
        path = stored.once(self.spark, "text-index", self.sf_dir, lambda path: fulltext.save(self.job_texts, path, "job_id"))
        return fulltext.load(self.spark, path, "job_id")

    @cached_property
    def companies(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))

    @cached_property
    def technologies(self) -> DataFrame:
        part = self.table("part")
        return part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("tech_id"), F.min_by("p_type", "p_partkey").alias("category")).withColumn("slug", slug_of(F.col("name")))

    def _job_technologies(self) -> DataFrame:
        parts = self.table("part").select("p_partkey", F.col("p_name").alias("name")).join(self.technologies.select("name", "tech_id"), "name")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(parts.select("p_partkey", "tech_id"), F.col("l_partkey") == F.col("p_partkey"))
        rank = _pick(F.col("l_returnflag"), {k: v[0] for k, v in REQUIREMENTS.items()})
        dealt = stored.dealt(lines.select(F.col("l_orderkey").alias("job_id"), "tech_id", rank.alias("rank")), "job_id")
        best = dealt.groupBy("job_id", "tech_id").agg(F.min("rank").alias("rank"))
        return best.select("job_id", "tech_id", _pick(F.col("rank"), dict(REQUIREMENTS.values())).alias("requirement"))

    def _job_locations(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        places = self.table("supplier").select("s_suppkey", "s_nationkey")
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        each = stored.dealt(lines.select(F.col("l_orderkey").alias("job_id"), "s_nationkey"), "job_id").distinct()
        return each.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
            "job_id", F.col("n_name").alias("city"), F.col("r_name").alias("region"),
            (F.lit(25.0) + F.col("n_nationkey")).alias("lat"), (F.lit(-120.0) + 2 * F.col("n_nationkey")).alias("lon"),
        ).distinct()

    @cached_property
    def cities(self) -> DataFrame:
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        name = F.col("n_name")
        return n.select(name.alias("city"), F.col("r_name").alias("region"), (F.lit(25.0) + F.col("n_nationkey")).alias("lat"), (F.lit(-120.0) + 2 * F.col("n_nationkey")).alias("lon"), slug_of(name).alias("city_slug"))


def slug_of(c: Column) -> Column:
    """Lower case, other than letters and digits to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


SQL = f"""with recursive technologies as (
  select p_name as name, min(p_partkey) as tech_id, arg_min(p_type, p_partkey) as category, {slug_sql('p_name')} as slug from part group by p_name),
jobs as (
  select o_orderkey as job_id, o_custkey as company_id, o_orderdate as posted_at, case when o_orderstatus = 'F' then 'expired' else 'active' end as status,
    {_case('o_orderpriority', LEVELS)} as experience_level, {_case('o_orderkey % 4', ARRANGEMENTS)} as arrangement, {_case('o_orderkey % 7', EMPLOYMENT)} as employment_type,
    case when o_orderkey % 3 <> 0 then o_totalprice::decimal(12,2) end as salary_annual_min, case when o_orderkey % 3 <> 0 then round(o_totalprice * 1.2, 2)::decimal(12,2) end as salary_annual_max,
    {_case('c_mktsegment', {k: v[0] for k, v in TITLES.items()})} as title_id, case when o_orderkey % 2 = 0 then (o_orderkey % 12)::double end as years_of_experience, o_orderkey % 3 as source_id,
    case when o_orderkey % 13 = 0 then o_orderkey when o_orderkey % 13 = 1 then o_orderkey - 1 end as dedupe_group_id
  from orders join customer on o_custkey = c_custkey),
job_texts as (
  select job_id, concat_ws(' ', coalesce({_case('title_id', {i: s.replace('-', ' ') for i, s in TITLES.values()})}, 'engineer'), coalesce(string_agg(p_name, ' ' order by l_linenumber, p_name), '')) as text
  from jobs left join (lineitem join part on l_partkey = p_partkey) on l_orderkey = job_id group by job_id, title_id),
companies as (select c_custkey as company_id, c_name as name from customer),
job_technologies as (
  select l_orderkey as job_id, tech_id, case min({_case('l_returnflag', {k: v[0] for k, v in REQUIREMENTS.items()})}) when 1 then 'required' when 2 then 'preferred' else 'mentioned' end as requirement
  from lineitem join part on l_partkey = p_partkey join technologies on p_name = name group by all),
job_locations as (
  select distinct l_orderkey as job_id, n_name as city, r_name as region, 25.0::double + n_nationkey as lat, -120.0::double + 2 * n_nationkey as lon
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
cities as (select n_name as city, r_name as region, 25.0::double + n_nationkey as lat, -120.0::double + 2 * n_nationkey as lon, {slug_sql('n_name')} as city_slug from nation join region on n_regionkey = r_regionkey)"""
