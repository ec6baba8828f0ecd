"""Ranks of values within groups, without a task that holds a whole group.

Values are counted, so that equal ones are a row, and each group's values are cut into ranges at values of a bounded
sample. Sums run within a range and are lifted by the totals of the ranges below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample that the cuts come from, and how many of them make a range.
SAMPLE, RANGE = 8192, 64


def running(counted: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counted``, a row for each group and value, with upto_x and all_x for each x in ``sums``: the sum of x over
    the group's values up to this one, it included, and over all of them."""
    some = counted.select(*by, value).orderBy(F.xxhash64(*by, value), *by, value).limit(SAMPLE)
    cuts = some.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_cuts"))
    cuts = cuts.select(*by, F.expr(f"filter(_cuts, (x, i) -> i % {RANGE} = {RANGE - 1})").alias("_cuts"))
    rows = counted.join(F.broadcast(cuts), by, "left")
    rows = rows.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.col(value))), F.lit(0))).drop("_cuts")
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(x).alias(f"_in_{x}") for x in sums])  # at most SAMPLE / RANGE rows more than groups
    group = Window.partitionBy(*by)
    below = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    lifts = [F.coalesce(F.sum(f"_in_{x}").over(below), F.lit(0)).alias(f"_lift_{x}") for x in sums]
    totals = totals.select(*by, "_range", *lifts, *[F.sum(f"_in_{x}").over(group).alias(f"all_{x}") for x in sums])
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(totals), [*by, "_range"])
    rows = rows.withColumns({f"upto_{x}": F.sum(x).over(within) + F.col(f"_lift_{x}") for x in sums})
    return rows.drop("_range", *[f"_lift_{x}" for x in sums])


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, k): how often each value that isn't null is in its group."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))


def _at(index: Column) -> Column:
    """Whether the value of sorted place ``index`` (from 0) is this row's."""
    return (F.col("upto_k") > index) & (F.col("upto_k") - F.col("k") <= index)


def nearest_ranks(rows: DataFrame, by: list[str], value: str, qs) -> DataFrame:
    """(by, n, q0, q1, ...): of n sorted values the one at round(q (n - 1)), halves to even."""
    ranked = running(counted(rows, by, value), by, value, ["k"])
    place = lambda q: F.bround(F.lit(float(q)) * (F.col("all_k") - 1))
    hits = [F.max(F.when(_at(place(q)), F.col(value))).alias(f"q{i}") for i, q in enumerate(qs)]
    return ranked.groupBy(*by).agg(F.max("all_k").alias("n"), *hits)


def linear_quantiles(rows: DataFrame, by: list[str], value: str, qs, name: str) -> DataFrame:
    """(by, n, min, max, name): an array of the quantiles of a group, interpolated between two values."""
    ranked = running(counted(rows, by, value), by, value, ["k"])
    place = lambda q: F.lit(float(q)) * (F.col("all_k") - 1)
    ends = []
    for i, q in enumerate(qs):
        ends += [F.max(F.when(_at(f(place(q))), F.col(value))).alias(f"_{end}{i}") for end, f in (("lo", F.floor), ("hi", F.ceil))]
    out = ranked.groupBy(*by).agg(F.max("all_k").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), *ends)
    at = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    lo, hi = (lambda i: F.col(f"_lo{i}")), (lambda i: F.col(f"_hi{i}"))
    between = [F.when(F.floor(at(q)) == F.ceil(at(q)), lo(i)).otherwise((F.ceil(at(q)) - at(q)) * lo(i) + (at(q) - F.floor(at(q))) * hi(i)) for i, q in enumerate(qs)]
    return out.select(*by, "n", "min", "max", F.array(*between).alias(name))
