"""Scores of documents as rows against the operators on token rows, with and without tokens joined by shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from inkstone.operators import parse as P
from inkstone.operators import scoring as SC
from inkstone.operators import statistical as M

WORDS = "the of and however 12 cat dog running quickly tree house a river stone seldom often".split()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    rows = []
    for d in range(12):
        lines = [" ".join(f"{rnd.choice(WORDS).capitalize()} " + " ".join(rnd.choices(WORDS, k=rnd.randint(2, 14))) + rnd.choice(".!?") for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(1, 8))]
        rows.append((d, "txt", "\n".join(lines) + f"\n rare{d} `code` and *one* $x$ [link](y) more words here.\t Tab  spaced text it is."))
    rows += [(90, "txt", None), (91, "txt", ""), (92, "txt", "Short one here it is."), (93, "txt", "1 2 3 4 5.\n" * 6)]
    return spark.createDataFrame(rows, "doc_id long, fmt string, text string")


def rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_document_sentences_are_the_eligible_ones(docs):
    plain, rows = P.eligible(P.scored_sentences(P.line_paragraphs(docs))), P.document_sentences(docs)
    flat = rows.select("doc_id", F.posexplode("sents").alias("sent", "_s")).select("doc_id", "sent", "_s.*")
    assert rounded(flat) == rounded(plain.select("doc_id", "sent", "line", "text", "n_words", "prose"))
    assert rounded(P.document_units(rows)) == rounded(P.units(plain).select("doc_id", "unit_id", "line", "text"))


@pytest.mark.parametrize("most", [1000, 4, 0])
def test_scores_by_document_are_those_by_token(docs, most):
    good = docs.where("doc_id % 2 = 0").select("text")
    n = M.vocabulary(all=docs.select("text"), good=good).cache()
    s = P.eligible(P.scored_sentences(P.line_paragraphs(docs)))
    hot = M.hot_tokens(M.count_model_scores(P.scored_tokens(s), M.pair_model(n, "n_all", "n_good"))).cache()
    v, pairs = SC.counted(n), {"p": ("n_all", "n_good")}
    numbers, known = SC.numbered(P.document_sentences(docs), v, most)
    got = SC.scores(numbers, known, {"p": (*pairs["p"], *SC.totals(v, pairs)["p"])}, [f.split()[0] for f in SC.SCORES.split(", ")]).cache()
    assert rounded(got.where("tokens > 0").select("doc_id", "tokens", "b", "delta_mean", "delta_q10", "delta_q50", "delta_q90")) == rounded(M.document_scores(hot))
    assert rounded(got.where("n_hot > 0").select("doc_id", "n_hot", "burstiness")) == rounded(M.burstiness(hot))
    assert rounded(got.select("doc_id", "hot_window")) == rounded(M.hot_window(hot))
    classes = got.select("doc_id", F.inline("classes")).withColumn("class", F.get(F.array(*map(F.lit, SC.CLASSES)), "class"))
    assert rounded(classes) == rounded(M.token_classes(hot))
    units = got.select("doc_id", F.inline("units"))
    assert rounded(units) == rounded(M.unit_scores(hot, P.units(s)).select("doc_id", "unit_id", "n", "b", "delta_mean", "hot_share"))


def test_units_of_the_same_tokens_are_equal_in_any_order(spark):
    rnd, values = random.Random(1), [-0.1, -0.7, -1.3, -2.9, -3.3, -4.7, -0.2, -7.1]
    rows = []
    for u in range(40):
        rnd.shuffle(values)
        rows += [(1, u, u * 8 + k, x, 1.7, x / 3, True, False) for k, x in enumerate(values)]
    hot = spark.createDataFrame(rows, "doc_id long, sent long, pos long, lp_perf double, xent double, delta double, valid boolean, hot boolean")
    units = spark.createDataFrame([(1, u, [u], 1, "x") for u in range(40)], "doc_id long, unit_id int, sents array<long>, line int, text string")
    got = M.unit_scores(hot, units)
    assert got.select("b", "delta_mean").distinct().count() == 1
    ranked = M.consensus(got.withColumn("pair", F.lit("p")))
    assert [r.unit_id for r in ranked.orderBy("place").collect()] == list(range(40))
