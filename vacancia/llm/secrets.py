"""Secret scanning with an incremental blob ledger, in DataFrame expressions only.

Every text is addressed by its content (SHA-256). The ledger, a Parquet data set, has one row for each scanned pair of
blob and rule version with its findings, none included. A run scans only blobs that lack a row for the current rule
version, appends their rows, and joins the findings back to every path (document) that holds the blob. Changing a rule
changes the version, so all blobs are scanned again; changed texts are new blobs, and old versions keep their rows. Where
two runs at once, or a repeated append, have written a pair twice, its findings are equal and one row of them is read.

A run over a ledger compares addresses first: the ledger is cut to the addresses of this run's texts where it is read, so its
history is neither shuffled nor copied, and of the texts only those of unseen blobs are shuffled while they are few.

Very long texts are scanned whole. Spans are code points, end exclusive. Nulls count as empty texts. Repeated rows are each reported; rows with a null
doc_id too. An empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm import storage

#: Addresses of unseen blobs (32 bytes each) that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_BLOBS = 1 << 15


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of the match or of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds in the order in which they are listed. The first three are the base kinds. Where a match always
#: ends with its run of characters, the least length stands in the pattern: a run that fails has no other match in it.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 60),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3
FINDINGS = "array<struct<start: int, rank: int, kind: string, end: int>>"
LEDGER = f"blob_id binary, rule_version string, findings {FINDINGS}"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and findings of every document; unseen blobs are scanned and added to the ledger first."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    addressed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob_id"))
    version = rule_version(rules)
    blobs, known = addressed.select("blob_id", "text"), None
    seen = _ledger(spark, ledger_path)
    if seen is None:
        blobs = blobs.dropDuplicates(["blob_id"])
    else:
        own = storage.written(blobs.select("blob_id").distinct(), "run-blobs")
        known = seen.where(F.col("rule_version") == version).join(own, "blob_id", "left_semi").select("blob_id", "findings")
        known = storage.written(known.dropDuplicates(["blob_id"]), "known-findings")  # of this run's blobs alone
        unseen = storage.written(own.join(known.select("blob_id"), "blob_id", "left_anti"), "unseen-blobs")
        if unseen.count() <= MAX_BROADCAST_BLOBS:
            blobs = blobs.join(F.broadcast(unseen), "blob_id", "left_semi").dropDuplicates(["blob_id"])
        else:
            blobs = blobs.dropDuplicates(["blob_id"]).join(unseen.hint("merge"), "blob_id", "left_semi")
    new = storage.written(_findings(blobs, rules), "findings")
    new.select("blob_id", F.lit(version).alias("rule_version"), "findings").write.mode("append").parquet(ledger_path)
    known = new if known is None else known.union(new)  # written, so they are joined by an exchange of their own and a hot blob can be split
    return addressed.select("doc_id", "blob_id").join(known.hint("merge"), "blob_id").select("doc_id", "blob_id", "findings")


def _ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _hits(rule: Rule, rank: int) -> Column:
    """Each match with its place in the row of matches and the length of the text between it and the one before."""
    pairs = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("hit"))

    def row(pair: Column, i: Column) -> Column:
        value = F.regexp_extract(pair["hit"], rule.pattern, rule.group) if rule.group else pair["hit"]
        return F.struct(
            F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(pair["gap"]).alias("gap"),
            F.length(pair["hit"]).alias("hit"), (F.length(value) >= rule.least).alias("keep"),
        )

    return F.when(F.col("text").rlike(rule.pattern), F.transform(pairs, row))


def _findings(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    empty = F.array().cast("array<struct<rank: int, kind: string, i: int, gap: int, hit: int, keep: boolean>>")
    hits = F.concat(*[F.coalesce(_hits(rule, k), empty) for k, rule in enumerate(rules)])
    rows = blobs.select("blob_id", F.explode_outer(hits).alias("h")).select("blob_id", "h.*")
    so_far = Window.partitionBy("blob_id", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(so_far).cast("int"))
    found = F.when(F.col("keep") & F.col("hit").isNotNull(), F.struct((F.col("end") - F.col("hit")).alias("start"), "rank", "kind", "end"))
    return rows.groupBy("blob_id").agg(F.sort_array(F.collect_list(found)).cast(FINDINGS).alias("findings"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns from the findings."""
    spans = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("findings", lambda x: x["rank"] < BASE)
    counts = [F.size(F.filter("findings", _of_rank(k))).cast("long").alias(f"n_{rules[k].kind}") for k in range(BASE)]
    return found.select("doc_id", *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))


def digest_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL, without a ledger."""
    quoted = [r.pattern.replace("'", "''") for r in rules]
    kinds = " union all ".join(
        f"select doc_id, {k} as rank, '{r.kind}' as kind, i, length(g) as gap, length(h) as hit, "
        f"length({f"regexp_extract(h, '{q}', {r.group})" if r.group else 'h'}) >= {r.least} as keep from "
        f"(select doc_id, unnest(hs) as h, unnest(gs[1:len(hs)]) as g, generate_subscripts(hs, 1) as i from "
        f"(select doc_id, regexp_extract_all(t, '{q}') as hs, regexp_split_to_array(t, '{q}') as gs from d where regexp_matches(t, '{q}')))"
        for k, (r, q) in enumerate(zip(rules, quoted, strict=True))
    )
    counts = ", ".join(f"count(*) filter (where rank = {k}) as n_{rules[k].kind}" for k in range(BASE))
    return (
        f"with d as (select doc_id, coalesce(text, '') as t from documents), m as ({kinds}), "
        "e as (select *, sum(gap + hit) over (partition by doc_id, rank order by i) as fin from m), "
        "s as (select doc_id, rank, (fin - hit)::bigint as beg, kind || ':' || (fin - hit)::bigint || ':' || fin::bigint as span from e where keep), "
        f"g as (select doc_id, {counts}, string_agg(span, ',' order by beg, rank) filter (where rank < {BASE}) as base, string_agg(span, ',' order by beg, rank) as spans from s group by doc_id) "
        f"select doc_id, {', '.join(f'coalesce(n_{rules[k].kind}, 0) as n_{rules[k].kind}' for k in range(BASE))}, "
        "sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join g using (doc_id)"
    )


def _of_rank(k: int):
    return lambda x: x["rank"] == k
