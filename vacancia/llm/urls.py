"""URL filtering: host and path rules, and pattern rules indexed by their rarest literal token.

Pattern rules are a table of names and regular expressions. The whole tokens that every match of an expression must hold are
derived from it (``literals``). How often each token occurs among the tokens of all URLs is counted, and a rule is filed under
its rarest. The tokens of each distinct URL fetch candidate rules from that index, and only those run their expression. A rule
without a certain token is filed under every URL. A rule table has at most MAX_RULES rows, which is checked; it is sent to all tasks.

Null URLs have an empty host and path and are allowed, as is a URL without "://". Very long URLs are judged whole. Repeated
rows and null page_ids are judged like others; an empty table gives no rows. Columns besides page_id and url are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm import literals

#: Fixed values: (verdict, host, path). A rule fits its host and all subdomains; the longest wins.
HOST_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@dataclass(frozen=True)
class PatternRule:
    name: str
    pattern: str


#: Words that block a host of which they are a part between marks, by kind.
HOST_WORDS = {
    "casino": ("casino", "poker", "roulette", "jackpot", "sportsbook"),
    "adult": ("xxx", "porn", "escorts", "camgirls"),
    "piracy": ("warez", "keygen", "torrents"),
    "loans": ("payday", "fastcash"),
}
#: Parameters of a query that block a URL, by kind.
PARAMETERS = {"affiliate": ("affid", "affiliate"), "session": ("phpsessid", "jsessionid")}
#: URLs that match are blocked where no host rule speaks.
PATTERN_RULES = (
    PatternRule("link-farm", r"(?i)://([^/?#]*\.)?spam-farm\."),
    PatternRule("pharmacy", r"(?i)://([^/?#]*[.-])?(cheap|discount)-pills\."),
    *(PatternRule(f"{kind}:{word}", rf"(?i)://[^/?#]*\b{word}\b") for kind, ws in HOST_WORDS.items() for word in ws),
    *(PatternRule(f"{kind}:{name}", rf"(?i)[?&;]{name}=[^&#]") for kind, names in PARAMETERS.items() for name in names),
    PatternRule("click-bait", r"(?i)[?&]ref=click-?bait\b"),
    PatternRule("login", r"(?i)/wp-login\.php\b"),
    PatternRule("essay-mill", r"(?i)\bbuy-(cheap-)?essays?\b"),
    PatternRule("redirector", r"(?i)[?&](url|goto|redirect)=https?(%3a|:)(%2f|/){2}[^#]*[?&]clickid="),
    PatternRule("replica", r"(?i)\breplica-(watch(es)?|bags?|shoes)\b"),
    PatternRule("dating", r"(?i)/(adult|casual)-dating/"),
    PatternRule("cart", r"(?i)/(cart|checkout)/add\b.*[?&]quantity=[0-9]+"),
    PatternRule("raw-address", r"(?i)^https?://[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?/[^?#]*\.exe\b"),
    PatternRule("long-digits", r"(?i)://[a-z]*[0-9]{12,}[a-z0-9]*\."),
)
MAX_RULES = 10_000
TOKEN = r"[^a-z0-9]+"
#: The token under which rules without one are filed; every URL has it.
ANY = ""


def _parts(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(after, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(url), TOKEN), ""))


def _listed(rules: DataFrame | tuple[PatternRule, ...]) -> list[PatternRule]:
    if isinstance(rules, DataFrame):
        rules = [PatternRule(r["name"], r["pattern"]) for r in rules.select("name", "pattern").distinct().orderBy("name", "pattern").limit(MAX_RULES + 1).collect()]
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} pattern rules")
    return list(rules)


def index(urls: DataFrame, rules: DataFrame | tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """token, name, pattern: each rule under the required token that is rarest among the URLs (ties: the first in the alphabet).

    rules: rows or a table of name and pattern.
    """
    spark, rules = urls.sparkSession, _listed(rules)
    rows = [(r.name, r.pattern, t) for r in rules for t in literals.required_tokens(r.pattern) or (ANY,)]
    literal = spark.createDataFrame(rows, "name string, pattern string, token string")
    wanted = sorted({t for *_, t in rows})
    used = urls.select(F.explode(F.filter(_tokens(F.col("url")), lambda t: t.isin(wanted))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counted = literal.join(used, "token", "left")
    return counted.groupBy("name", "pattern").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))


def judge(pages: DataFrame, rules: DataFrame | tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, pattern_rule, verdict."""
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct()
    filed = F.broadcast(index(pages.select("url"), rules))  # at most MAX_RULES rows
    tokens = F.array_append(_tokens(F.col("url")), F.lit(ANY))
    candidates = urls.select("url", F.explode(tokens).alias("token")).join(filed, "token")
    hits = candidates.where(F.rlike("url", F.col("pattern"))).groupBy("url").agg(F.min("name").alias("pattern_rule"))
    host, path = _parts(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(HOST_RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        found, verdict = F.when(fits, F.lit(h + p)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    spread = F.when(F.col("url").isNull(), F.pmod(F.xxhash64("page_id"), F.lit(4096))).otherwise(0)  # null URLs, which match nothing, don't meet in one task
    df = df.withColumns({"rule": found, "_verdict": verdict, "_spread": spread}).join(hits.withColumn("_spread", F.lit(0).cast("long")), ["url", "_spread"], "left")
    method = F.when(F.col("pattern_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", "rule", "pattern_rule", F.coalesce("_verdict", method).alias("verdict"))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict")


def digest_sql() -> str:
    rank = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in rank]
    rule = " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, rank, strict=True))
    kind = " ".join(f"when {f} then '{k}'" for f, (k, _, _) in zip(fits, rank, strict=True))
    blocked = " or ".join(f"regexp_matches(url, '{r.pattern}')" for r in PATTERN_RULES)
    return (
        "with a as (select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages), "
        "p as (select page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from a) "
        f"select page_id, host, path, case {rule} end as rule, case {kind} when {blocked} then 'block' else 'allow' end as verdict from p"
    )
