"""Extraction against labelled truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(predicted: DataFrame, truth: DataFrame, key: list[str], category: str) -> DataFrame:
    """tp, fp, fn, precision, recall for each category and over all (category NULL); 1.0 where there is nothing to judge."""
    p = predicted.select(*key, F.col(category).alias("_p"), F.lit(1).alias("_in_p")).distinct()
    t = truth.select(*key, F.col(category).alias("_t"), F.lit(1).alias("_in_t")).distinct()
    both = p.join(t, key, "full_outer").select(F.coalesce("_p", "_t").alias(category), F.coalesce("_in_p", F.lit(0)).alias("p"), F.coalesce("_in_t", F.lit(0)).alias("t"))
    sums = both.rollup(category).agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum(F.col("p") * (1 - F.col("t"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("t")).alias("fn"))
    ratio = lambda other: F.round(F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(other)), F.lit(1.0)), 6)
    return sums.select(category, "tp", "fp", "fn", ratio("fp").alias("precision"), ratio("fn").alias("recall"))


def _judged(predicted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """key, field, got, want: one row for each document and field that is judged: where either side has a value; of the salary, where
    the truth has one. Both sides have title, level, arrangement, salary_min, salary_max."""
    salary = lambda side: F.when(F.col(f"{side}.salary_min").isNotNull(), F.concat_ws("-", *[F.col(f"{side}.{c}").cast("long") for c in ("salary_min", "salary_max")]))
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"p.{f}").alias("got"), F.col(f"t.{f}").alias("want")) for f in ("title", "level", "arrangement")]
    pairs.append(F.struct(F.lit("salary").alias("field"), salary("p").alias("got"), salary("t").alias("want")))
    both = truth.alias("t").join(predicted.alias("p"), F.col(f"t.{key}") == F.col(f"p.{key}"), "left")
    rows = both.select(F.col(f"t.{key}").alias(key), F.explode(F.array(*pairs)).alias("x")).select(key, "x.*")
    return rows.where(F.col("want").isNotNull() | (F.col("got").isNotNull() & (F.col("field") != "salary")))


def accuracy(predicted: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """field, correct, total of title, level, arrangement and salary over the labelled documents."""
    right = F.count_if(F.col("got").eqNullSafe(F.col("want"))).alias("correct")
    return _judged(predicted, truth, key).groupBy("field").agg(right, F.count("*").alias("total"))


def requirement_accuracy(predicted: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """correct, total: the requirement levels (level) of what both sides name."""
    both = predicted.select(*key, F.col("level").alias("got")).join(truth.select(*key, F.col("level").alias("want")), key)
    return both.agg(F.count_if(F.col("got").eqNullSafe(F.col("want"))).alias("correct"), F.count("*").alias("total"))


def mistakes(predicted: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, field, got, want of every value that is wrong."""
    return _judged(predicted, truth, key).where(~F.col("got").eqNullSafe(F.col("want")))
