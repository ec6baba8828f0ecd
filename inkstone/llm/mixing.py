"""Operator 4: mixing sources to target weights, in DataFrame expressions only.

Tokens are summed per source, each source gets a target and from it a repetition rate, and each
document is emitted floor(rate) times plus once more where a hash of its id, as a number in [0, 1),
is below the rate's fraction.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null
doc_id draws as the empty id; rows that repeat a doc_id draw alike; an empty table gives no rows;
a source of size 0 gets target 0 and rate 0; columns of any other names pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
#: Largest number of sources whose rates are broadcast; more go through a join on salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 32
#: Ranges that many sources are ordered in, and rows of the sample for each.
SPLITS, SPLIT = 256, 16


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(per: DataFrame, by: str, sums: dict[str, str]) -> DataFrame:
    """``per`` with running sums over the rows before each, in order of ``by`` and source (nulls last).

    The order is cut at every SPLIT-th of a bounded sample of rows; sums are formed within each range and lifted by
    the totals of the ranges before it, so that no task orders all rows.
    """
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    key = key if by == "source" else F.struct(F.col(by).alias("first"), key.alias("then"))
    per = per.withColumn("at", key)
    some = per.select("at").orderBy(F.xxhash64("at"), "at").limit(SPLITS * SPLIT)
    cuts = some.agg(F.sort_array(F.collect_list("at")).alias("all")).select(F.expr(f"filter(all, (x, i) -> i % {SPLIT} = 0)").alias("cuts"))
    per = per.crossJoin(F.broadcast(cuts)).withColumn("part", F.expr("size(filter(cuts, x -> x <= at))")).drop("cuts")
    totals = per.groupBy("part").agg(*[F.sum(c).alias(f"all_{n}") for n, c in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most SPLITS + 1 rows
    totals = totals.select("part", *[F.coalesce(F.sum(f"all_{n}").over(before), F.lit(0)).alias(f"lift_{n}") for n in sums])
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    per = per.join(F.broadcast(totals), "part")
    per = per.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"lift_{n}") for n, c in sums.items()})
    return per.drop("at", "part", *[f"lift_{n}" for n in sums])


def targets_of(per: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row for each source.

    A source is capped at max_repeat times its size; what is above a cap is shared anew by weight.
    That ends at a level L with target = min(cap, L * weight) and the targets adding up to all sizes.
    With the sources in order of cap / weight, those before the first that reaches
    (all - caps before) / (all weights - weights before) are capped and that quotient is L.
    """
    per = in_order(per.withColumn("one", F.lit(1).cast("long")), "source", {"place": "one"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_repeat)
    per = in_order(per.withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double")), "ratio", {"caps": "cap", "ws": "w"})
    everything = F.broadcast(per.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w")))
    level = (F.col("all_size") - F.col("caps")).cast("double") / (F.col("all_w") - F.col("ws")).cast("double")
    per = per.crossJoin(everything).withColumn("level", level)
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull().alias("none"), "source", "level")))
    per = per.crossJoin(F.broadcast(per.agg(first["level"].alias("l"))))
    target = F.least(F.col("cap").cast("double"), F.col("l") * F.col("w").cast("double"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) of rows (source, size)."""
    return targets_of(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of the seed and the id."""
    hexed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def _planned(docs: DataFrame, keep: Column, weights: tuple[int, ...], max_repeat: int, seed: str) -> DataFrame:
    """(row, size, source_size, target, copies) for each row of ``docs``; what is kept of it is one struct, so that
    no name of its columns can clash with those used here."""
    spark = docs.sparkSession
    sized = docs.select(keep.alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), text_size(F.col("text")).alias("size"))
    per = checkpointed(docs.select("source", text_size(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")))
    few = per.limit(BROADCAST_SOURCES + 1).collect()
    if len(few) <= BROADCAST_SOURCES:
        targets = targets_of(spark.createDataFrame(few, per.schema).coalesce(1), weights, max_repeat).withColumnRenamed("source", "known")
        joined = sized.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("known")), "left")
    else:
        targets = targets_of(per, weights, max_repeat).withColumnRenamed("source", "known")
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn("pick", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = sized.join(salted, F.col("source").eqNullSafe(F.col("known")) & (F.col("pick") == F.col("salt")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    whole = F.floor(F.col("rate"))
    copies = whole + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("rate", rate).select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixing_plan(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The kept columns with size, source_size, target and copies for each row of ``docs``."""
    return _planned(docs, F.struct(*keep), weights, max_repeat, seed).select("row.*", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns, whatever their names, and their order stay."""
    plan = _planned(docs, F.struct("*"), weights, max_repeat, seed).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing_plan(docs, ["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w,
         source_size * 3 AS cap FROM per
), ordered AS (
  SELECT *, cap::DOUBLE / w::DOUBLE AS ratio FROM weighed
), lefts AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT
            - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS l,
         (sum(w) OVER ())::BIGINT
            - coalesce(sum(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS wl
  FROM ordered
), level AS (
  SELECT l::DOUBLE / wl::DOUBLE AS lv FROM lefts WHERE ratio >= l::DOUBLE / wl::DOUBLE
  ORDER BY ratio, source ASC NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT lv FROM level) * w::DOUBLE) AS target FROM lefts
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
