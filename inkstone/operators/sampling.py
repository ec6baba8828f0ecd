"""Sampling of a corpus by category: offsets over slices, seeded draws, rejection with reasons, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTA, ATTEMPTS, SEED = 6, 8, 20260610


def slices(totals: DataFrame) -> DataFrame:
    """(category, slice, total, start, stop): each slice's range of the category's running offsets."""
    order = Window.partitionBy("category").orderBy("slice")
    stop = F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return totals.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("total"))


def draw_key(*columns: Column, seed: int = SEED) -> Column:
    """An order that any engine can repeat: the MD5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]).cast("binary"))


def drawn(offsets: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """(category, offset, draw): ``n`` different offsets of each category, in the order drawn."""
    order = Window.partitionBy("category").orderBy(draw_key(F.col("category"), F.col("offset"), seed=seed))
    return offsets.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n)


def located(draws: DataFrame, ranges: DataFrame) -> DataFrame:
    """Draws with the slice that holds their offset and the place in it; ranges of a category don't overlap."""
    r = ranges.select(F.col("category").alias("_c"), "slice", "start", "stop")
    on = (F.col("category") == F.col("_c")) & (F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("stop"))
    return draws.join(r, on).select("category", "offset", "draw", "slice", (F.col("offset") - F.col("start")).alias("place"))


def accepted(rows: DataFrame, primary: Column, published: Column, quota: int = QUOTA) -> DataFrame:
    """Draws with reason ("primary", "unpublished", "quota" or null) and accepted, in the order of their draw."""
    reason = F.when(~F.coalesce(primary, F.lit(False)), "primary").when(~F.coalesce(published, F.lit(False)), "unpublished")
    rows = rows.withColumn("_r", reason)
    so_far = F.count_if(F.col("_r").isNull()).over(Window.partitionBy("category").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("reason", F.when(F.col("_r").isNull() & (so_far > quota), "quota").otherwise(F.col("_r"))).drop("_r")
    return rows.withColumn("accepted", F.col("reason").isNull())


def manifest(rows: DataFrame) -> DataFrame:
    """(category, draws, accepted, wrong_primary, unpublished): what became of the draws up to the quota."""
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("draws"), F.count_if("accepted").alias("accepted"),
        F.count_if(F.col("reason") == "primary").alias("wrong_primary"), F.count_if(F.col("reason") == "unpublished").alias("unpublished"),
    )
