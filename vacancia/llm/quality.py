"""Quality rules: a decision list learned from labelled statistics, run as Spark conditional expressions.

Statistics of each whole text are built-in expressions. The learner gets the statistics of a bounded sample of labelled
documents (``MAX_LABELLED``; the smallest hashes of doc_id, so the same documents whatever the partitioning) and finds
rules that reject: a conjunction of thresholds is grown on two thirds of the sample by the gain in information, pruned
on the rest, kept if it is precise there, and what it covers is taken away before the next. The rules become one ordered
``CASE WHEN``: the first that fits rejects, otherwise the document is kept.

Nulls count as texts without words. Rows with a null doc_id are judged like others but never train. Labels that
contradict each other for one doc_id are left out, as are null labels; of texts that share a labelled doc_id one trains. Without labels of both kinds there are no rules. An
empty table gives no rows. Columns besides doc_id and text are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm import storage

#: Labelled documents that train the rules.
MAX_LABELLED = 3000
#: Thresholds tried for each feature, conditions in a rule, rules; least precision on the pruning part.
THRESHOLDS, MAX_CONDITIONS, MAX_RULES, PRECISION = 24, 4, 12, 0.95
WINDOW = 8
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Base limits: fewest words; percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
FEATURES = ("f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeat", "f_capitals", "f_distinct")


def statistics(docs: DataFrame) -> DataFrame:
    """The given columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the features."""
    own = docs.columns
    text = F.coalesce("text", F.lit(""))
    without = lambda marks: F.length(F.translate(text, marks, ""))
    df = docs.withColumns({
        "_words": F.array_remove(F.split(text, BLANKS), ""),
        "_lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "_chars": F.length(text),
        "word_chars": without(" \t\n\x0b\x0c\r").cast("long"),
        "n_symbols": (F.length(text) - without(SYMBOLS)).cast("long"),
        "_capitals": F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_distinct": F.size(F.array_distinct("_words")),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_grams": F.when(F.size("_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))),
    })
    df = df.withColumn("_repeats", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: (F.get("_sorted", j - 1)["h"] == x["h"]) | (F.get("_sorted", j + 1)["h"] == x["h"])
    df = df.withColumn("_starts", F.when(F.col("_repeats"), F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("_starts", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b,
    )
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_repeats"), covered), F.lit(0)).cast("long"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    features = {
        "f_words": F.col("n_words").cast("double"), "f_word_length": share("word_chars", "n_words"), "f_symbols": share("n_symbols", "n_words"),
        "f_dup_lines": share("n_dup_lines", "n_lines"), "f_repeat": share("n_repeat_words", "n_words"), "f_capitals": share("_capitals", "_chars"), "f_distinct": share("_distinct", "n_words"),
    }
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    failed = _barrier(failed)
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select(*[c for c in own if c not in {*stats, *features, "base_failed"}], *stats, *[v.alias(k) for k, v in features.items()], failed.alias("base_failed"))


def _barrier(condition: Column) -> Column:
    """The same value. Catalyst doesn't push a filter below an expression that it can't repeat, and a filter on the verdict
    would be pushed below the statistics, so that every text's statistics were computed once more for each condition."""
    return condition & (F.monotonically_increasing_id() >= 0)


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def fits(self, row: Sequence[float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(FEATURES[self.feature])
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def learn(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from the statistics of at most MAX_LABELLED labelled documents that pass the base limits."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality"))
    sample = storage.hashed_sample(clean.where("low = quality").select("doc_id", "quality"), "doc_id", MAX_LABELLED)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).where(~F.col("base_failed"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("r")).select("doc_id", "r.*").collect()  # bounded by the sample
    return cover([([r[f] for f in FEATURES], r["quality"] == 0) for r in sorted(one, key=lambda r: r["doc_id"])])


def cover(rows: list[tuple[list[float], bool]]) -> list[Rule]:
    """Sequential covering. rows: features and whether to reject."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and any(bad for _, bad in grow):
        rule = _pruned(_grown(grow), prune)
        hit = [bad for x, bad in prune if all(c.fits(x) for c in rule)]
        if not rule or not hit or sum(hit) < PRECISION * len(hit):
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.fits(r[0]) for c in rule)]
        prune = [r for r in prune if not all(c.fits(r[0]) for c in rule)]
    return rules


def _grown(rows: list[tuple[list[float], bool]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS and rows and not all(bad for _, bad in rows):
        p0, n0 = sum(bad for _, bad in rows), len(rows)
        best, gain = None, 0.0
        for f in range(len(FEATURES)):
            values = sorted({x[f] for x, _ in rows})
            step = max(1, len(values) // THRESHOLDS)
            for t in [(a + b) / 2 for a, b in zip(values[::step], values[1::step])]:
                above = [bad for x, bad in rows if x[f] > t]
                p_above, n_above = sum(above), len(above)
                for side, p, n in ((True, p_above, n_above), (False, p0 - p_above, n0 - n_above)):
                    if p and (g := p * (math.log2(p / n) - math.log2(p0 / n0))) > gain + 1e-12:
                        best, gain = Condition(f, side, t), g
        if best is None:
            break
        rule += (best,)
        rows = [r for r in rows if best.fits(r[0])]
    return rule


def _pruned(rule: Rule, rows: list[tuple[list[float], bool]]) -> Rule:
    """The beginning of the rule with the best (p - n) / (p + n) on rows it wasn't grown on; the longest of equals."""
    best, score = rule, -2.0
    for k in range(len(rule), 0, -1):
        hit = [bad for x, bad in rows if all(c.fits(x) for c in rule[:k])]
        s = (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0
        if s > score:
            best, score = rule[:k], s
    return best


def verdict(rules: list[Rule]) -> Column:
    """True to keep: the ordered conditional expression."""
    out = F.lit(True)
    for rule in reversed(rules):
        fits = rule[0].column()
        for c in rule[1:]:
            fits = fits & c.column()
        out = F.when(fits, F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """statistics() and kept: false where a base limit fails, else the verdict of the rules."""
    return statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules))
