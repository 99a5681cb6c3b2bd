"""Exact quantiles of many groups by counts: no task gets the values of a group.

Equal values of a group are counted where they are read, so what is shuffled are distinct values with counts. Values lie in
bins of fixed width. For each group the bins are added up in order, which tells the bin that holds a wanted rank; only
the values of these bins are ordered, each bin for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantiles(rows: DataFrame, by: list[str], value: Column, fractions: tuple[float, ...], width: float) -> DataFrame:
    """by, n_rows, n (values that aren't NULL), p (array: linear between the two nearest ranks; NULL without a value). NULL is a group like others.

    ``width`` is that of a bin, in units of the value: narrow enough that a task can order the distinct values of a bin, wide
    enough that it can order the bins of a group.
    """
    names = [f"_by{i}" for i in range(len(by))]
    keys = [F.struct(F.col(c)).alias(name) for c, name in zip(by, names, strict=True)] or [F.lit(0).alias("_all")]  # a struct equals itself even where it holds NULL
    names = names or ["_all"]
    every = rows.select(*keys, value.cast("double").alias("_v")).groupBy(*names, "_v").agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.col("_v") / width))
    totals = every.groupBy(*names).agg(F.sum("_n").alias("n_rows"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)).alias("n"))
    counts = every.where(F.col("_v").isNotNull())
    bins = counts.groupBy(*names, "_bin").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy(*names)
    bins = bins.withColumns({"_end": F.sum("_n").over(group.orderBy("_bin")), "_total": F.sum("_n").over(group)})
    at = [F.lit(float(f)) * (F.col("_total") - 1) for f in fractions]
    ranks = [r for a in at for r in (F.floor(a), F.ceil(a))]
    inside = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), r.alias("r")) for i, r in enumerate(ranks)]), lambda x: (x["r"] < F.col("_end")) & (x["r"] >= F.col("_end") - F.col("_n")))
    wanted = bins.select(*names, "_bin", "_total", (F.col("_end") - F.col("_n")).alias("_before"), inside.alias("_ranks")).where(F.size("_ranks") > 0)
    ordered = Window.partitionBy(*names, "_bin").orderBy("_v")
    found = counts.join(wanted, [*names, "_bin"]).withColumn("_end", F.col("_before") + F.sum("_n").over(ordered))
    hit = F.filter("_ranks", lambda x: (x["r"] < F.col("_end")) & (x["r"] >= F.col("_end") - F.col("_n")))
    found = found.select(*names, "_v", F.explode(hit).alias("_hit"))
    picked = found.groupBy(*names).agg(*[F.max(F.when(F.col("_hit.i") == i, F.col("_v"))).alias(f"_q{i}") for i in range(len(ranks))])

    def between(f: float, i: int) -> Column:
        place = F.lit(float(f)) * (F.col("n") - 1)
        low, high = F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
        return F.when((F.floor(place) == F.ceil(place)) | (low == high), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    out = totals.join(picked, names, "left")
    return out.select(*[F.col(name)[c].alias(c) for c, name in zip(by, names, strict=False)], "n_rows", "n", F.when(F.col("n") > 0, F.array(*[between(f, i) for i, f in enumerate(fractions)])).alias("p"))
