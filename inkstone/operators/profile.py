"""Profiles: what a corpus of human texts looks like, and how a document compares with it."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.text import word_count
from inkstone.operators.features import NO_RATE, is_key_tell
from inkstone.operators.findings import finding
from inkstone.operators.glossary import glossary
from inkstone.operators.ranks import linear_quantiles, nearest_ranks, running

QUANTILES = (0.05, 0.50, 0.95)
LEAST_DOCS, DOC_WORDS = 3, 300
SEGMENT_WORDS, LEAST_SEGMENTS, SCAN_SEGMENTS = 500, 10, 4
P_CUTOFF = 0.05
MOST_FINDINGS = 12
SHORT_DOCUMENT = 2500
REPLICAS, SEED = 2000, 0


def bands(features: DataFrame, by: list[str] = ("feature",), value: str = "rate", digits: int | None = 3) -> DataFrame:
    """(by, n, p05, p50, p95) by nearest rank, rounded as profiles are."""
    shown = (lambda c: F.round(c, digits)) if digits is not None else F.col
    ranks = nearest_ranks(features, list(by), value, QUANTILES)
    return ranks.select(*by, "n", *[shown(f"q{i}").alias(f"p{int(q * 100):02d}") for i, q in enumerate(QUANTILES)])


def admitted(paras: DataFrame, least: int = DOC_WORDS) -> DataFrame:
    """(doc_id, words, kept): documents, and whether they have words enough for a profile."""
    n = paras.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("words"))
    return n.withColumn("kept", F.col("words") >= least)


def check_corpus(admission: DataFrame) -> None:
    n, kept = admission.agg(F.count(F.lit(1)), F.count_if("kept")).first()
    if n < LEAST_DOCS or kept < LEAST_DOCS:
        raise ValueError(f"a profile needs {LEAST_DOCS} documents of {DOC_WORDS} words; the corpus has {n}, of which {kept} are long enough")


def metric_bands(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Bands of document metrics that at least three documents have."""
    long = metrics.unpivot(["doc_id"], names, "metric", "value").where("value is not null")
    return bands(long, ["metric"], "value").where(F.col("n") >= LEAST_DOCS)


def out_of_band(features: DataFrame, bands_: DataFrame) -> DataFrame:
    """(doc_id, feature, rate, side, sigma, key, severity) of features outside their band.

    ``bands_`` has (feature, p05, p50, p95) and, from simulation, sd and words: a band with words is for documents of
    so many tokens, one without for all. Sigma is the distance from the median
    in sds or, without a spread, the distance beyond the edge in band widths.
    """
    b = bands_ if "sd" in bands_.columns else bands_.withColumn("sd", F.lit(None).cast("double"))
    if "words" in b.columns:
        own = features.join(b.where("words is not null").withColumnRenamed("words", "tokens"), ["feature", "tokens"])
        rows = own.unionByName(features.join(b.where("words is null").drop("words"), "feature"))
    else:
        rows = features.join(b, "feature")
    rows = rows.where((F.col("rate") < F.col("p05")) | (F.col("rate") > F.col("p95")))
    above = F.col("rate") > F.col("p95")
    edge = F.when(above, F.col("rate") - F.col("p95")).otherwise(F.col("p05") - F.col("rate"))
    width = F.greatest(F.col("p95") - F.col("p05"), F.lit(1e-9))
    sigma = F.when(F.col("sd") > 1e-9, F.abs(F.col("rate") - F.col("p50")) / F.col("sd")).otherwise(edge / width)
    rows = rows.withColumn("side", F.when(above, 1).otherwise(-1)).withColumn("sigma", sigma).withColumn("key", is_key_tell(F.col("feature")))
    sev = F.least(F.lit(0.55) + F.lit(0.06) * F.col("sigma") + F.when(F.col("key"), 0.1).otherwise(0.0), F.lit(0.95))
    return rows.select("doc_id", "feature", "rate", "side", "sigma", "key", F.round(sev, 2).alias("severity"))


def top_features(deviations: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc("sigma"), "feature")
    return deviations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def empirical_p(rates: DataFrame, reference: DataFrame, key: list[str]) -> DataFrame:
    """``rates`` with p: the add-one two-sided tail of a rate among the reference rates of its feature.

    The counts at most and at least a value come from running sums over the different rates of both tables
    together, in ranges of rates, not from a join of each rate with each reference.
    """
    asked = rates.groupBy("feature", "rate").agg(F.lit(0).cast("long").alias("ref"), F.lit(1).alias("_asked"))
    known = reference.groupBy("feature", "rate").agg(F.count(F.lit(1)).alias("ref"), F.lit(0).alias("_asked"))
    both = asked.unionByName(known).groupBy("feature", "rate").agg(F.sum("ref").alias("ref"), F.max("_asked").alias("_asked"))
    counted = running(both, ["feature"], "rate", ["ref"]).where("_asked = 1 and all_ref > 0")
    lo, hi, n = F.col("upto_ref"), F.col("all_ref") - F.col("upto_ref") + F.col("ref"), F.col("all_ref")
    p = F.least(F.lit(1.0), F.lit(2.0) * F.least((lo + 1) / (n + 1), (hi + 1) / (n + 1)))
    return rates.select(*key, "feature", "rate").join(counted.select("feature", "rate", p.alias("p")), ["feature", "rate"]).select(*key, "feature", "rate", "p")


def segment_scan(segments: DataFrame, reference: DataFrame, least: int = SCAN_SEGMENTS, every: bool = False) -> DataFrame:
    """(doc_id, feature, p, beyond, map, worst, segments, doc_rate, in_band, severity, at_floor) of features that deviate.

    ``segments`` has (doc_id, seg_id, words, feature, rate), ``reference`` (feature, rate) of human segments. p is
    the least over a document's segments: they depend on each other, so they aren't pooled. A feature without
    a segment outside the human band isn't tested. ``every`` gives all tested features.
    """
    q = linear_quantiles(reference, ["feature"], "rate", (0.05, 0.95), "_q").withColumnsRenamed({"min": "_min", "max": "_max", "n": "_n"})
    per = Window.partitionBy("doc_id", "feature")
    rows = empirical_p(segments, reference, ["doc_id", "seg_id", "words"]).join(F.broadcast(q), "feature")
    rows = rows.withColumn("_segs", F.count(F.lit(1)).over(per)).where(F.col("_segs") >= least)
    side = F.when(F.col("rate") > F.col("_q")[1], 1).when(F.col("rate") < F.col("_q")[0], -1).otherwise(0)
    span = F.greatest(F.col("_max") - F.col("_min"), F.lit(1e-9))
    rows = rows.withColumn("_side", side).withColumn("_beyond", F.greatest((F.col("rate") - F.col("_max")) / span, (F.col("_min") - F.col("rate")) / span))
    out = rows.groupBy("doc_id", "feature").agg(
        F.min("p").alias("p"), F.greatest(F.max("_beyond"), F.lit(0.0)).alias("beyond"), F.max(F.abs("_side")).alias("_any"),
        F.sort_array(F.collect_list(F.struct("seg_id", "_side"))).alias("_map"), F.sort_array(F.collect_list(F.struct("p", "seg_id"))).alias("_worst"),
        F.count(F.lit(1)).alias("segments"), (F.sum(F.col("rate") * F.col("words")) / F.sum("words")).alias("doc_rate"), F.first("_q").alias("_q"), F.first("_n").alias("_n"),
    )
    out = out.where("_any > 0")
    if not every:
        out = out.where(F.col("p") < P_CUTOFF)
    sign = lambda x: F.when(x["_side"] > 0, "↑").when(x["_side"] < 0, "↓").otherwise("·")
    sev = F.least(F.lit(0.6) + F.lit(0.15) * F.greatest(F.lit(0.0), -F.log10("p") - 1), F.lit(0.9))
    return out.select(
        "doc_id", "feature", "p", "beyond", F.array_join(F.transform("_map", sign), "").alias("map"), F.transform(F.slice("_worst", 1, 3), lambda x: x["seg_id"]).alias("worst"),
        "segments", "doc_rate", ((F.col("doc_rate") >= F.col("_q")[0]) & (F.col("doc_rate") <= F.col("_q")[1])).alias("in_band"),
        F.round(sev, 2).alias("severity"), (F.col("p") <= F.lit(2.0) / (F.col("_n") + 1) + F.lit(1e-12)).alias("at_floor"),
    )


def draw(seed: int, replica: int, step: int) -> int:
    """The number of a replica's step: the first 32 bits of an MD5, which SQL can form as well."""
    return int(hashlib.md5(f"{seed}:{replica}:{step}".encode()).hexdigest()[:8], 16)


def _drawn(replicas: pd.DataFrame, segments: pd.DataFrame, names: list[str], longest: int, seed: int) -> pd.DataFrame:
    """Of a document's replicas, for each feature the running sums of words and counts over the segments drawn."""
    if replicas.empty or segments.empty:
        return pd.DataFrame({"feature": [], "replica": [], "tokens": [], "counts": []})
    wide = segments.pivot_table(index=["seg", "tokens"], columns="feature", values="n", aggfunc="first").reindex(columns=names).fillna(0)
    tokens, counts, rows = wide.index.get_level_values("tokens").to_numpy(), wide.to_numpy(np.int64), []
    for r in sorted(replicas["replica"]):
        picked, held = [], 0
        while held < longest:
            picked.append(draw(seed, int(r), len(picked) + 1) % len(tokens))
            held += int(tokens[picked[-1]])
        upto, sums = np.cumsum(tokens[picked], dtype=np.int64), counts[picked].cumsum(0)
        rows += [(name, int(r), upto, sums[:, k]) for k, name in enumerate(names)]
    return pd.DataFrame(rows, columns=["feature", "replica", "tokens", "counts"])


def _bands_of(drawn: pd.DataFrame, lengths: list[int]) -> pd.DataFrame:
    """A feature's bands for texts of each length, from the running sums of its replicas."""
    most, rows = max(map(len, drawn["tokens"])), []
    tokens = np.stack([np.pad(x, (0, most - len(x)), mode="edge") for x in drawn["tokens"]])
    counts = np.stack([np.pad(x, (0, most - len(x)), mode="edge") for x in drawn["counts"]])
    each, at = np.arange(len(drawn)), np.zeros(len(drawn), np.int64)
    for length in sorted(lengths):
        while (low := tokens[each, at] < length).any():
            at += low
        rates = 1000.0 * counts[each, at] / tokens[each, at]
        rows.append((length, drawn["feature"].iloc[0], *np.quantile(rates, QUANTILES), rates.std()))
    return pd.DataFrame(rows, columns=["words", "feature", "p05", "p50", "p95", "sd"])


def length_bands(profile: DataFrame, at: list[int], replicas: int = REPLICAS, seed: int = SEED) -> DataFrame:
    """(words, feature, p05, p50, p95, sd): rates that texts of each of ``at`` words would have if the corpus had
    written them.

    A replica picks a document of the profile (doc, seg, tokens, feature, n), then draws its segments with
    replacement until they have so many words; the last one isn't cut. A step of a replica is a hash of the seed and
    both numbers, and a shorter text is the start of a longer one. Only the documents picked are fetched, each to one task.
    """
    spark = profile.sparkSession
    known = profile.where("tokens > 0 and doc is not null")
    every = known.select("doc").distinct().orderBy("doc").rdd.map(lambda r: r[0]).cache()
    n_docs = every.count()
    if not n_docs or not at:
        return spark.createDataFrame([], "words long, feature string, p05 double, p50 double, p95 double, sd double")
    picked = [draw(seed, r, 0) % n_docs for r in range(replicas)]
    wanted = set(picked)
    doc_at = {i: doc for doc, i in every.zipWithIndex().filter(lambda x: x[1] in wanted).collect()}
    every.unpersist()
    names = sorted(r.feature for r in known.select("feature").distinct().collect())
    plan = spark.createDataFrame([(r, doc_at[i]) for r, i in enumerate(picked)], f"replica long, doc {known.schema['doc'].dataType.simpleString()}")
    own = known.join(F.broadcast(plan.select("doc").distinct()), "doc", "left_semi").select("doc", "seg", "tokens", "feature", "n")
    run = partial(_drawn, names=names, longest=max(at), seed=seed)
    drawn = plan.groupBy("doc").cogroup(own.groupBy("doc")).applyInPandas(lambda a, b: run(a, b), "feature string, replica long, tokens array<bigint>, counts array<bigint>")
    return drawn.groupBy("feature").applyInPandas(lambda x: _bands_of(x, at), "words long, feature string, p05 double, p50 double, p95 double, sd double")


def lengths(features: DataFrame) -> list[int]:
    """The different lengths of documents in words, which are far fewer than documents."""
    return sorted(r.tokens for r in features.select("tokens").distinct().collect())


def simulated_bands(profile: DataFrame, target: int, replicas: int = REPLICAS, seed: int = SEED) -> DataFrame:
    """(feature, p05, p50, p95, sd): the ``length_bands`` of texts of ``target`` words."""
    return length_bands(profile, [target], replicas, seed).drop("words")


def chosen_bands(simulated: DataFrame | None, doc_bands: DataFrame, segment_bands: DataFrame | None, words: int) -> DataFrame:
    """Bands to compare a document with: simulated ones where the profile has segments, with the documents' own for
    what isn't a rate; else, for a short document, those of segments, and else those of documents."""
    if simulated is not None:
        return simulated.unionByName(doc_bands.where(F.col("feature").isin(*NO_RATE)).select("feature", "p05", "p50", "p95"), allowMissingColumns=True)
    return segment_bands if segment_bands is not None and words < SHORT_DOCUMENT else doc_bands


def structural(features: DataFrame, bands_: DataFrame) -> DataFrame:
    """Findings of the features out of their band, the MOST_FINDINGS with the largest sigma for each document."""
    top = top_features(out_of_band(features, bands_))
    top = top.join(F.broadcast(glossary(features.sparkSession)), ["feature", "side"], "left")
    what = F.concat(F.when(F.col("side") > 0, "Above").otherwise("Below"), F.lit(" the band: "), F.coalesce("meaning", "feature"), F.lit(". "), F.coalesce("hint", F.lit("")))
    detail = F.map_from_arrays(F.array(F.lit("sigma"), F.lit("rate")), F.array(F.col("sigma").cast("string"), F.col("rate").cast("string")))
    return finding(top, "structural", F.col("feature"), F.col("severity"), F.rtrim(what), payload=detail)


def segment_findings(scan: DataFrame) -> DataFrame:
    """Findings of a segment scan, with p, the map of segments and whether the whole document hides the deviation."""
    names = ("p", "map", "worst", "in_band")
    detail = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("string") for n in names]))
    return finding(scan, "structural", F.concat(F.lit("segments:"), F.col("feature")), F.col("severity"), F.concat(F.lit("Segments deviate: "), F.col("map")), payload=detail)
