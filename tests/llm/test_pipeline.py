"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from inkstone.llm import mixing, simhash, toxicity

VOCABULARY = [a + b for a in "ba ko ri mu te sa lo ge".split() for b in "nd rst ble th ing ou an ix".split()]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(20)
    text = lambda n: " ".join(rng.choices(VOCABULARY, k=n))
    items = [(i, f"{text(25)}. {text(8)}.") for i in range(10)]
    passages = [text(60) for _ in range(4)]
    rows, labels = [], []
    for i in range(260):
        t = text(rng.randint(30, 200))
        kind = i % 13
        if kind == 1:
            t += f" zorkfoo{rng.choice('abc')} {text(10)}"
        elif kind == 2:
            t += " " + items[i % 10][1] + " " + text(20)
        elif kind == 3:
            t = f"{text(40)} {rng.choice(passages)} {text(30)}"
        elif kind == 4 and i > 20:
            t = rows[i - 4][1]
        elif kind == 5 and i > 20:
            w = rows[i - 5][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        rows.append((i, t, "en", rng.choice(["a", "a", "b", None]), len(t)))
        labels.append((i, 1, int("zorkfoo" in t)))
    rows += [(1000, None, None, "a", None), (1001, "", "en", "b", 0)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def keep_first_of_alike(docs):
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, (t, _) in docs.items()}
    gone = {}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                gone[b] = a
    return {i: x for i, x in docs.items() if i not in gone}


def cut(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        t, s = docs[i]
        b = (t or "").encode()
        covered = set()
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                covered.update(range(p, p + 100))
            seen.add(b[p : p + 100])
        out[i] = (None if t is None else bytes(x for k, x in enumerate(b) if k not in covered).decode(), s)
    return out


def test_each_stage(spark, corpus):
    d, items = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    want = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    model = toxicity.fitted(docs, spark.read.parquet(f"{d}/labels.parquet"))
    symbols = toxicity.Symbols(model)
    words = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    bench = [" ".join(words(t)) for _, t in items]
    plain = {
        "toxicity": lambda x: {i: v for i, v in x.items() if symbols.score((v[0] or "").encode()) < toxicity.THRESHOLD},
        "near_duplicates": keep_first_of_alike,
        "repeats": cut,
        "decontamination": lambda x: {i: v for i, v in x.items() if not any(b in " ".join(words(v[0])) for b in bench)},
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == [*plain, "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = set(want)
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        want = plain[name](want)
        assert docs.columns == columns
        got = {r.doc_id: (r.text, r.source) for r in docs.collect()}
        assert got == want, (name, sorted(set(got) ^ set(want)))
        assert name == "repeats" or set(want) < before
    assert not any("zorkfoo" in (t or "") for t, _ in want.values())
    sized = {r.doc_id: r.copies for r in mixing.mixing_plan(docs, ["doc_id"]).collect()}
    mixed = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()]
    assert {i: mixed.count(i) for i in sized} == sized


def test_draws_are_those_of_the_md5():
    first = int(hashlib.md5(b"mix-1:7").hexdigest()[:8], 16) / 2**32
    assert 0 <= first < 1


def test_run_gives_whole_rows(spark, corpus):
    d, _ = corpus
    rows = corpus_pipeline.run(spark, d)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"] and rows.count() > 50
