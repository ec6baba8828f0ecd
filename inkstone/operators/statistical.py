"""Two-model token statistics: tilt, perplexity ratio, burstiness, units, calibration, consensus.

What follows the token log-probabilities doesn't depend on where they come from. A provider gives
(doc_id, pos, sent, token, is_content, class, lp_obs, lp_perf, xent) for a pair of models; ``count_model_scores``
is one with two add-one-smoothed word counts over one vocabulary. It is a stand-in that exercises the
operators, no detector: with it the cross-entropy is one number for a pair. ``provided_scores`` runs any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.text import tokens
from inkstone.operators.findings import finding
from inkstone.operators.ranks import linear_quantiles

HOT_QUANTILE, HOT_WINDOW, LEAST_HOT = 0.90, 50, 3
CLASS_TOKENS, UNIT_TOKENS = 10, 5
#: What a value must be beyond a quantile to be outside it, so that no tie hangs on the last bit of a sum.
SLACK = 1e-9
#: Parts of one that sums of units are made of, so that units of the same tokens are equal in whatever order they are added.
EXACT = float(1 << 36)
FAST_SEVERITY = 0.3
#: Tokens of a vocabulary that is broadcast.
MOST_TOKENS = 1_000_000
#: Words that mark a transition, and the class of a part of speech.
TRANSITIONS = (
    "however moreover furthermore additionally thus therefore hence consequently nevertheless nonetheless meanwhile specifically notably importantly "
    "interestingly overall finally indeed instead accordingly similarly conversely first second third ultimately crucially"
).split()
POS_CLASS = {
    "PROPN": "proper_noun", "NOUN": "noun", "VERB": "verb", "AUX": "verb", "ADJ": "adjective", "ADV": "adverb", "NUM": "number", "PUNCT": "punctuation",
    "PRON": "function", "DET": "function", "ADP": "function", "CCONJ": "function", "SCONJ": "function", "PART": "function",
}
FUNCTION_WORDS = "a an the this that these those of in to for with on at by from as and or but if it its he she they we you i his her their our is are was were be been not".split()


def token_class(token: Column, pos: Column | None = None) -> Column:
    """Class of a token: a transition, else by its part of speech, else by the word's form."""
    if pos is not None:
        table = F.create_map(*[F.lit(x) for kv in POS_CLASS.items() for x in kv])
        other = F.coalesce(F.element_at(table, pos), F.lit("symbol"))
    else:
        other = (
            F.when(token.isin(*FUNCTION_WORDS), "function").when(token.rlike("^[0-9]"), "number").when(token.rlike(r"^[.,;:!?]$"), "punctuation")
            .when(token.rlike("^[a-z]+ly$"), "adverb").when(token.rlike(r"^\p{L}"), "word").otherwise("symbol")
        )
    return F.when(token.isin(*TRANSITIONS), "transition").otherwise(other)


def vocabulary(**texts: DataFrame) -> DataFrame:
    """(token, n_x for each x): how often each token is in the texts of each name.

    A table may have a column ``n_y`` of 0 and 1 beside ``text`` for each subset y of its rows; it is read once.
    """
    subsets = {x: [c for c in df.columns if c.startswith("n_")] for x, df in texts.items()}
    names = [f"n_{x}" for x in texts] + [c for s in subsets.values() for c in s]
    parts = []
    for x, df in texts.items():
        own = {f"n_{x}": F.lit(1), **{c: F.col(c) for c in subsets[x]}}
        parts.append(df.select(*[own.get(n, F.lit(0)).cast("long").alias(n) for n in names], F.explode(tokens(F.col("text"))).alias("token")))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("token").agg(*[F.sum(n).alias(n) for n in names])


def pair_model(counts: DataFrame, observer: str, performer: str) -> DataFrame:
    """(token, n_obs, n_perf, lp_obs, lp_perf): add-one-smoothed log-probabilities over the tokens that either text has."""
    n = counts.select("token", F.col(observer).alias("n_obs"), F.col(performer).alias("n_perf")).where("n_obs + n_perf > 0")
    total = n.agg(F.count(F.lit(1)).alias("_v"), F.sum("n_obs").alias("_no"), F.sum("n_perf").alias("_np"))
    lp = lambda c, t: F.log((F.col(c) + 1.0) / (F.col(t) + F.col("_v")))
    return n.crossJoin(F.broadcast(total)).select("token", "n_obs", "n_perf", lp("n_obs", "_no").alias("lp_obs"), lp("n_perf", "_np").alias("lp_perf"))


def word_model(observer: DataFrame, performer: DataFrame) -> DataFrame:
    """The ``pair_model`` of two tables of texts."""
    return pair_model(vocabulary(o=observer.select("text"), p=performer.select("text")), "n_o", "n_p")


def check_vocabulary(observer: DataFrame, performer: DataFrame) -> None:
    """Both models of a pair must know the same tokens."""
    a, b = observer.select("token"), performer.select("token")
    if a.join(b, "token", "left_anti").limit(1).count() or b.join(a, "token", "left_anti").limit(1).count():
        raise ValueError("the models of a pair don't share their vocabulary")


def looked_up(rows: DataFrame, table: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """``rows`` with the columns of ``table`` (token, ...), null for tokens that it doesn't have.

    A table of at most ``most`` tokens is broadcast. Of a larger one, which has its counts in n_obs, the ``most`` most
    frequent tokens are broadcast and the others joined by shuffle, so that no frequent token falls to one task.
    """
    columns = [c for c in table.columns if c not in ("token", "n_obs")]
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table.select("token", *columns)), "token", "left")
    often = F.broadcast(table.orderBy(F.desc("n_obs"), "token").limit(most).select("token", *columns, F.lit(True).alias("_often")))
    met = rows.join(often, "token", "left")
    rare = met.where("_often is null").drop("_often", *columns).join(table.select("token", *columns), "token", "left")
    return met.where("_often").drop("_often").unionByName(rare)


def with_classes(scores: DataFrame) -> DataFrame:
    """A provider's log-probabilities with the class of each token, its tilt, and whether it counts."""
    return (
        scores.withColumn("class", token_class(F.col("token"))).withColumn("delta", F.col("lp_perf") - F.col("lp_obs"))
        .withColumn("valid", F.col("is_content") & F.col("lp_perf").isNotNull())
    )


def count_model_scores(scored: DataFrame, model: DataFrame) -> DataFrame:
    """A provider's table for tokens (doc_id, pos, sent, token, is_content); unknown tokens have no score."""
    xent = model.agg((-F.sum(F.exp("lp_obs") * F.col("lp_perf"))).alias("xent"))
    return with_classes(looked_up(scored, model.select("token", "n_obs", "lp_obs", "lp_perf")).crossJoin(F.broadcast(xent)))


def all_pair_scores(scored: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """The provider's table of each pair, with its name in ``pair``; tokens are looked up once for all pairs."""
    one, names = None, list(models)
    for i, (pair, model) in enumerate(models.items()):
        own = model.select("token", F.col("n_obs").alias(f"n{i}"), F.struct("lp_obs", "lp_perf").alias(f"m{i}"))
        one = own if one is None else one.join(own, "token", "full")
    wide = one.select("token", sum(F.coalesce(f"n{i}", F.lit(0)) for i in range(len(names))).alias("n_obs"), *[f"m{i}" for i in range(len(names))])
    xents = {p: m.agg((-F.sum(F.exp("lp_obs") * F.col("lp_perf")))).first()[0] for p, m in models.items()}  # one number for a pair
    each = F.array(*[F.struct(F.lit(p).alias("pair"), F.col(f"m{i}").alias("m"), F.lit(xents[p]).alias("xent")) for i, p in enumerate(names)])
    rows = looked_up(scored, wide).select(*scored.columns, F.explode(each).alias("_x"))
    return with_classes(rows.select(*scored.columns, "_x.pair", F.col("_x.m.lp_obs").alias("lp_obs"), F.col("_x.m.lp_perf").alias("lp_perf"), "_x.xent"))


def provided_scores(scored: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """The table of a provider of its own: tokens (doc_id, pos, sent, token, is_content) of whole documents, in order.

    ``provider`` is given an iterator of documents, each a pandas table of its tokens, and yields each with lp_obs,
    lp_perf and xent filled in; a model is loaded once for a task, before the first document. Null where a token
    has no score.
    """
    schema = "doc_id long, pos long, sent long, token string, is_content boolean, lp_obs double, lp_perf double, xent double"
    names = [f.split()[0] for f in schema.split(", ")]
    ordered = scored.select(*[F.col(c) for c in names[:5]]).repartition("doc_id").sortWithinPartitions("doc_id", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def documents() -> Iterator[pd.DataFrame]:
            held = None
            for batch in batches:
                held = batch if held is None else pd.concat([held, batch], ignore_index=True)
                last = held["doc_id"].iat[-1]
                whole = held[held["doc_id"] != last]
                for _, one in whole.groupby("doc_id", sort=False):
                    yield one.reset_index(drop=True)
                held = held[held["doc_id"] == last].reset_index(drop=True)
            if held is not None:
                yield held

        for out in provider(documents()):
            yield out[names]

    return with_classes(ordered.mapInPandas(run, schema))


def hot_tokens(scores: DataFrame) -> DataFrame:
    """``scores`` with hot: valid tokens whose tilt is above the 0.9 quantile of their document (and pair)."""
    per = Window.partitionBy("doc_id", *[c for c in ("pair",) if c in scores.columns])
    limit = F.percentile(F.when(F.col("valid"), F.col("delta")), F.lit(HOT_QUANTILE)).over(per)
    return scores.withColumn("_limit", limit).withColumn("hot", F.coalesce(F.col("valid") & (F.col("delta") > F.col("_limit") + SLACK), F.lit(False))).drop("_limit")


def b_value(lp: Column, xent: Column) -> Column:
    return -F.avg(lp) / F.greatest(F.avg(xent), F.lit(1e-6))


def exact_avg(c: Column) -> Column:
    """The mean of whole multiples of 1 / EXACT; it doesn't hang on the order of the rows."""
    return F.sum(F.rint(c * EXACT).cast("decimal(38,0)")).cast("double") / F.lit(EXACT) / F.count(c)


def burstiness(hot: DataFrame) -> DataFrame:
    """(doc_id, n_hot, burstiness): (sd - mean) / (sd + mean) of the gaps between hot tokens; few hot ones give 0."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    gaps = hot.where("hot").withColumn("_gap", F.col("pos") - F.lag("pos").over(order))
    out = gaps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hot"), F.stddev_pop("_gap").alias("_s"), F.avg("_gap").alias("_m"))
    value = F.when((F.col("n_hot") < LEAST_HOT) | (F.col("_s") + F.col("_m") <= 0), 0.0).otherwise((F.col("_s") - F.col("_m")) / (F.col("_s") + F.col("_m")))
    return out.select("doc_id", "n_hot", value.alias("burstiness"))


def hot_window(hot: DataFrame, size: int = HOT_WINDOW) -> DataFrame:
    """(doc_id, hot_window): the largest share of hot tokens among ``size`` in a row, 0 for shorter documents."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-(size - 1), 0)
    run = hot.withColumn("_run", F.sum(F.col("hot").cast("int")).over(order))
    out = run.groupBy("doc_id").agg(F.max("_run").alias("_max"), F.count(F.lit(1)).alias("_n"))
    return out.select("doc_id", F.when(F.col("_n") > size, F.col("_max") / F.lit(float(size))).otherwise(0.0).alias("hot_window"))


def document_scores(hot: DataFrame) -> DataFrame:
    """(pair if there is one, doc_id, tokens, b, delta_mean, delta_q10, delta_q50, delta_q90) over valid tokens."""
    by = [*[c for c in ("pair",) if c in hot.columns], "doc_id"]
    q = F.percentile("delta", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9)]))
    out = hot.where("valid").groupBy(*by).agg(F.count(F.lit(1)).alias("tokens"), b_value(F.col("lp_perf"), F.col("xent")).alias("b"), F.avg("delta").alias("delta_mean"), q.alias("_q"))
    return out.select(*by, "tokens", "b", "delta_mean", *[F.col("_q")[i].alias(f"delta_q{x}") for i, x in enumerate((10, 50, 90))])


def token_classes(hot: DataFrame, least: int = CLASS_TOKENS) -> DataFrame:
    """(doc_id, class, n, delta_mean, delta_q90, hot_share, logppl_perf) over tokens with a score, content or not."""
    scored = hot.where("lp_perf is not null").groupBy("doc_id", "class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta").alias("delta_mean"), F.percentile("delta", F.lit(0.9)).alias("delta_q90"),
        F.avg(F.col("hot").cast("double")).alias("hot_share"), (-F.avg("lp_perf")).alias("logppl_perf"),
    )
    return scored.where(F.col("n") >= least)


def unit_scores(hot: DataFrame, units: DataFrame, least: int = UNIT_TOKENS) -> DataFrame:
    """(pair if there is one, doc_id, unit_id, line, text, n, b, delta_mean, hot_share) of units with valid tokens enough."""
    by = [*[c for c in ("pair",) if c in hot.columns], "doc_id", "unit_id"]
    member = units.select("doc_id", "unit_id", F.explode("sents").alias("sent"))
    rows = hot.where("valid").join(member, ["doc_id", "sent"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (-exact_avg(F.col("lp_perf")) / F.greatest(exact_avg(F.col("xent")), F.lit(1e-6))).alias("b"), exact_avg(F.col("delta")).alias("delta_mean"), F.avg(F.col("hot").cast("double")).alias("hot_share")
    )
    out = rows.where(F.col("n") >= least).join(units.select("doc_id", "unit_id", "line", "text"), ["doc_id", "unit_id"])
    return out.select(*by, "line", "text", "n", "b", "delta_mean", "hot_share")


def calibration(docs: DataFrame, units: DataFrame, by: list[str] = ("pair",)) -> DataFrame:
    """Bands of a corpus for each pair: documents' b and tilt at 5, 50, 95 %, units' b at 1, 5, 50 % and tilt at 50, 95, 99 %."""
    by = list(by)
    q = lambda rows, value, qs, name, *more: linear_quantiles(rows, by, value, qs, name).select(*by, name, *more)
    d = q(docs, "b", (0.05, 0.5, 0.95), "b", F.col("n").alias("n_docs")).join(q(docs, "delta_mean", (0.05, 0.5, 0.95), "delta"), by)
    u = q(units, "b", (0.01, 0.05, 0.5), "unit_b", F.col("n").alias("n_units")).join(q(units, "delta_mean", (0.5, 0.95, 0.99), "unit_delta"), by)
    return d.select(*by, "b", "delta", "n_docs").join(u.select(*by, "unit_b", "unit_delta", "n_units"), by, "left")


def upserted(old: DataFrame, new: DataFrame, key: list[str] = ("pair",)) -> DataFrame:
    return old.join(new, list(key), "left_anti").unionByName(new)


def uncalibrated(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Pairs without bands of units, which are those to calibrate."""
    return pairs.join(store.where("unit_b is not null").select(F.col("pair").alias("name")), "name", "left_anti")


def fast_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first pair, the others, which stay untested) of (ord, name, axis, ...)."""
    first = pairs.orderBy("ord").limit(1)
    return first, pairs.join(first, "ord", "left_anti")


def untested_note(docs: DataFrame, others: DataFrame) -> DataFrame:
    """A finding for each document that names the axes that weren't tested."""
    axes = others.agg(F.concat_ws(", ", F.sort_array(F.collect_list("axis"))).alias("_axes"))
    rows = docs.select("doc_id").distinct().crossJoin(F.broadcast(axes))
    return finding(rows, "statistical", "untested_axes", FAST_SEVERITY, F.concat(F.lit("Not tested: "), F.col("_axes")))


def verdicts(docs: DataFrame, bands: DataFrame) -> DataFrame:
    """``docs`` (pair, doc_id, b, delta_mean) with below, above and severity; without bands neither."""
    rows = docs.join(bands.select("pair", F.col("b").alias("_b"), F.col("delta").alias("_d")), "pair", "left")
    below, above = F.coalesce(F.col("b") < F.col("_b")[0] - SLACK, F.lit(False)), F.coalesce(F.col("delta_mean") > F.col("_d")[2] + SLACK, F.lit(False))
    return rows.withColumn("below", below).withColumn("above", above).withColumn("severity", F.when(below, 0.7).otherwise(0.3)).drop("_b", "_d")


def unit_flags(units: DataFrame, bands: DataFrame) -> DataFrame:
    """(pair, doc_id, unit_id, line, match, rule, severity): low b first, else high tilt; uncalibrated pairs have none."""
    rows = units.join(bands.where("unit_b is not null").select("pair", "unit_b", "unit_delta"), "pair")
    low, high = F.col("b") < F.col("unit_b")[1] - SLACK, F.col("delta_mean") > F.col("unit_delta")[1] + SLACK
    rule = F.when(low, "machine_like").when(high, "performer_tilt")
    sev = F.when(low, F.when(F.col("b") < F.col("unit_b")[0] - SLACK, 0.8).otherwise(0.65)).when(high, F.when(F.col("delta_mean") > F.col("unit_delta")[2] + SLACK, 0.75).otherwise(0.6))
    return rows.withColumn("rule", rule).withColumn("severity", sev).where("rule is not null").select("pair", "doc_id", "unit_id", "line", F.substring("text", 1, 90).alias("match"), "rule", "severity")


def flagged_units(units: DataFrame, bands: DataFrame, top: int = 3) -> DataFrame:
    """(pair, doc_id, unit_id, b, delta_mean, rank, flagged, share): units with low b or high tilt, lowest b first."""
    rows = units.join(bands.select("pair", "unit_b", "unit_delta"), "pair", "left")
    flag = F.when(F.col("unit_b").isNull(), True).otherwise((F.col("b") < F.col("unit_b")[1] - SLACK) | (F.col("delta_mean") > F.col("unit_delta")[1] + SLACK))
    per = Window.partitionBy("pair", "doc_id")
    rows = rows.withColumn("_f", flag).withColumn("flagged", F.count_if("_f").over(per)).withColumn("share", F.col("flagged") / F.count(F.lit(1)).over(per)).where("_f")
    rows = rows.withColumn("rank", F.row_number().over(per.orderBy("b", "unit_id"))).where(F.col("rank") <= top)
    return rows.select("pair", "doc_id", "unit_id", "b", "delta_mean", "rank", "flagged", "share")


def consensus(units: DataFrame, top: int | None = None) -> DataFrame:
    """(doc_id, unit_id, mean_rank, min_b, votes, pairs, place): units by their mean rank over the pairs.

    A rank is the unit's place by b in its document and pair, ties by unit, over the number of others.
    """
    per = Window.partitionBy("doc_id", "pair")
    rank = (F.row_number().over(per.orderBy("b", "unit_id")) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(per) - 1)
    out = units.withColumn("_r", rank).groupBy("doc_id", "unit_id").agg(
        F.avg("_r").alias("mean_rank"), F.min("b").alias("min_b"), F.count_if(F.col("delta_mean") > 0).alias("votes"), F.count(F.lit(1)).alias("pairs")
    )
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("mean_rank", "unit_id")))
    return out.where(F.col("place") <= top) if top else out
