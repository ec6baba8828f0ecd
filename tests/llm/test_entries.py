"""Each query op1 to op10 as the driver calls it, on tables written for it, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from inkstone.llm import ann, catalog, common, decontaminate, language_id, license_scan, mixing, quality, repeats, simhash, toxicity

COLUMNS = {
    "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_warc_bundles": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op4_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_decontaminate": "doc_id bigint, item_id bigint",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
}
SYLLABLES = {"en": "the ing tion wh of er and", "de": "sch ung keit der ein zu und", "es": "ción os ar que la ñ el"}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    d = str(tmp_path_factory.mktemp("entries"))
    words = lambda lang, n: " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(n))
    items = [(i, f"{words('en', 20)}. {words('en', 8)}.") for i in range(6)]
    passage, docs, labels = words("en", 40), [], []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        text = words(lang, rng.randint(5, 60))
        bad, good = i % 8 == 0, i % 3 > 0
        text += {1: f". Licensed under the MIT License, all rights reserved {i}", 2: f" {passage}", 3: f" {items[i % 6][1]}"}.get(i % 11, "")
        text += ". you snorkfoo scum. " if bad else ""
        text = text if good else " ".join(w + "###" for w in text.split())
        docs.append((i, text, lang, rng.choice(["a", "b", "c", None]), len(text)))
        labels.append((i, int(good), int(bad)))
    docs += [(i, docs[i - 300][1], docs[i - 300][2], "a", 1) for i in (301, 307)]
    docs += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, "12 34 !", "en", "b", 5), (403, "é", "es", "b", 1), (403, "é", "es", "b", 1), (None, words("de", 9), "de", "a", 3), (404, words("en", 30_000), "en", "c", 9)]
    labels += [(5, None, None), (6, 1, 0), (None, 1, 1), (999, 1, 1)]
    pages = [(i, f"http://x/{i}", rng.choice([None, "", "short", "<p>é" * 40, "".join(rng.choices("abc <>\n", k=rng.randint(90, 300)))])) for i in range(60)]
    pages += [(7, "http://again", "<p>é" * 40), (7, "http://again", "<p>é" * 40), (None, "http://none", "<p>é" * 40), (None, None, "only here " * 20), (None, None, None)]
    gen = np.random.default_rng(32)
    vectors = [(i, gen.normal(size=8).tolist(), 0) for i in range(200)] + [(250, None, 0), (300, [0.0] * 8, 0), (350, [1e-200] * 8, 0), (None, [1.0] * 8, 0), (100, [1.0] * 8, 0)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [*items, (90, None), (91, "")], "item_id long, text string"), ("pages", pages, "page_id long, url string, html string"),
        ("embeddings", vectors, "vec_id long, embedding array<double>, label int"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/{name}.parquet")
    return d, docs, labels, items, pages, vectors


@pytest.fixture(scope="module")
def results(spark, tables):
    got = {}

    def of(name):
        if name not in got:
            got[name] = catalog.queries()[name](spark, tables[0])
            got[name] = (got[name].schema, got[name].collect())
        return got[name]

    return of


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_types(name, results):
    want = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
    assert [(f.name, f.dataType.simpleString()) for f in results(name)[0]][: len(want)] == want


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_repeats", "op4_mix_sources", "op5_language_id", "op6_toxicity", "op8_simhash", "op10_quality"])
def test_a_row_for_each_document(name, results, tables):
    assert Counter(r.doc_id for r in results(name)[1]) == Counter(d[0] for d in tables[1])


def test_licenses(results, tables):
    text = {d[0]: d[1] for d in tables[1]}
    for r in results("op1_license_scan")[1]:
        assert tuple(r)[2:8] == license_scan.summary(license_scan.scan(text[r.doc_id]))[:6] and 0 <= r.score <= 1


def test_pages(results, tables):
    first = {}
    for i, _, h in tables[4]:
        if i is not None:
            first[(h or "").encode()] = min(first.get((h or "").encode(), i), i)
    want = Counter()
    for i, _, h in tables[4]:
        b = (h or "").encode()
        to = first.get(b) if len(b) >= 100 and first.get(b) != i else None
        want[i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter(map(tuple, results("op2_warc_bundles")[1])) == want


def test_digests(results, tables):
    for r in results("op3_repeats")[1]:
        size = next(len((t or "").encode()) for i, t, *_ in tables[1] if i == r.doc_id)
        assert r.n_bytes == size and 0 <= r.n_removed <= size and (r.n_removed or r.kept_sha256 == hashlib.sha256((next(t for i, t, *_ in tables[1] if i == r.doc_id) or "").encode()).hexdigest())
    assert sum(r.n_spans for r in results("op3_repeats")[1]) > 20 and repeats.MIN == 100


def test_mix(results, tables):
    rows = results("op4_mix_sources")[1]
    total, targets = sum(r.size for r in rows), {(r.source_size, r.target) for r in rows}
    assert sum(t for _, t in targets) == pytest.approx(total) and all(r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size for r in rows)
    assert mixing.WEIGHTS == (5, 2, 1)


def plain_crf(sample, epochs):
    """AdaGrad on the mean log-likelihood of a word, by all paths of labels of each text."""
    langs, D = sorted({y for _, y in sample}), language_id
    k = len(langs)
    emit, trans, g_emit, g_trans = np.zeros((D.DIM, k)), np.zeros((k, k)), np.full((D.DIM, k), 1e-6), np.full((k, k), 1e-2)
    words = [[D.word_features([w])[0] for w in D.TOKEN.findall(t.encode())] for t, _ in sample]
    total = sum(map(len, words))
    for _ in range(epochs):
        d_emit, d_trans = np.zeros_like(emit), np.zeros_like(trans)
        for flat, (_, y) in zip(words, sample, strict=True):
            s = [emit[f].sum(0) / math.sqrt(len(f)) for f in flat]
            paths = list(product(range(k), repeat=len(flat)))
            weight = np.exp([sum(s[i][p] for i, p in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)) for path in paths])
            weight /= weight.sum()
            for path, w in [*zip(paths, -weight, strict=True), ((langs.index(y),) * len(flat), 1.0)]:
                for i, p in enumerate(path):
                    np.add.at(d_emit[:, p], flat[i], w / math.sqrt(len(flat[i])) / total)
                for a, b in zip(path, path[1:], strict=False):
                    d_trans[a, b] += w / total
        d_emit, d_trans = d_emit - D.L2 * emit, d_trans - 1e-3 * trans
        g_emit, g_trans = g_emit + d_emit**2, g_trans + d_trans**2
        emit, trans = emit + D.RATE * d_emit / np.sqrt(g_emit), trans + D.RATE * d_trans / np.sqrt(g_trans)
    return langs, emit, trans


def test_language_training_against_all_paths():
    sample = [("the tion of", "en"), ("der ung zu", "de"), ("ein keit", "de"), ("wher", "en"), ("la que", "es")]
    langs, emit, trans = plain_crf(sample, 3)
    got = language_id.train(sample, 3)
    assert got.langs == langs and np.allclose(got.emit, emit, atol=1e-5) and np.allclose(got.trans, trans, atol=1e-8)


def plain_language(model, text):
    """Mean marginals of the words, one text at a time in logarithms."""
    words = language_id.TOKEN.findall((text or "").encode())
    if not words or not any(c.isalpha() for c in text):
        return "und", 0.0
    s = np.stack([model.emit[f].sum(0, dtype=float) / math.sqrt(len(f)) for f in (language_id.word_features([w])[0] for w in words)])
    ahead, back = np.zeros_like(s), np.zeros_like(s)
    ahead[0] = s[0]
    for i in range(1, len(s)):
        ahead[i] = s[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + model.trans, 0)
    for i in range(len(s) - 2, -1, -1):
        back[i] = np.logaddexp.reduce(model.trans + (s[i + 1] + back[i + 1])[None], 1)
    both = ahead + back
    mean = np.exp(both - np.logaddexp.reduce(both, 1)[:, None]).mean(0)
    return model.langs[int(mean.argmax())], float(mean.max())


def test_languages(results, tables, spark):
    docs = [d for d in tables[1] if d[0] is not None and d[1] is not None and d[2] is not None and fold(d[0], 4) != 2]
    seen = {d[0]: (d[1], d[2]) for d in docs}
    model = language_id.train([seen[i] for i in sorted(seen, key=lambda i: (zlib.crc32(str(i).encode()), i))])
    right = []
    text = {d[0]: d for d in tables[1]}
    for r in results("op5_language_id")[1]:
        lang, score = plain_language(model, text[r.doc_id][1])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=2e-3) and r.held_out == (r.doc_id is not None and fold(r.doc_id, 4) == 2)
        if r.held_out and lang != "und":
            right.append(lang == text[r.doc_id][2])
    assert np.mean(right) > 0.95 and {r.lang_pred for r in results("op5_language_id")[1] if r.doc_id in (400, 401, 402)} == {"und"}


def plain_sample(tables, column, folds, left_out):
    text, y = {}, {}
    for i, t, *_ in tables[1]:
        if i is not None:
            text[i] = min(text.get(i, t or ""), t or "")
    for row in tables[2]:
        if row[0] in text and row[column] in (0, 1) and fold(row[0], folds) != left_out:
            y[row[0]] = max(y.get(row[0], 0), row[column])
    return [(text[i], y[i]) for i in sorted(y, key=lambda i: (zlib.crc32(str(i).encode()), i))]


def test_toxicity(results, tables):
    model = toxicity.learn(common.without_copies(plain_sample(tables, 2, 3, 1)))

    def plain(text):
        tape = [(toxicity.ENDS[t], 0.0, "", 0.0) if t in toxicity.ENDS else (*model.symbol(t.decode().lower())[:2], t.decode().lower(), model.symbol(t.decode().lower())[2]) for t in toxicity.TOKEN.findall((text or "").encode())]
        tape.append((toxicity.SENTENCE, 0.0, "", 0.0))
        given = [s[0] for s in tape]
        for machine in toxicity.MACHINES:
            given = [g for g, _ in machine().run(given)]
        best, held = {}, []
        for (symbol, chance, word, _), kind in zip(tape, given, strict=True):
            held += [(chance, word)] if chance else []
            if held and symbol in ",.":
                x = (toxicity.prior(kind) * max(held)[0], kind, max(held)[0])
                terms = frozenset(w for _, w in held)
                best[terms], held = max(best.get(terms, x), x), []
        margin = model.bias + model.hint_weight * max(s[3] for s in tape) + sum(model.kinds[k] * c for _, k, c in best.values())
        return 1 / (1 + math.exp(-margin))

    text, caught, clean = {d[0]: d[1] for d in tables[1]}, [], []
    bad = {i for i, _, y in tables[2] if y and i is not None}
    for r in results("op6_toxicity")[1]:
        assert r.score == pytest.approx(plain(text[r.doc_id])) and r.predicted == (r.score >= 0.7) and r.held_out == (r.doc_id is not None and fold(r.doc_id, 3) == 1)
        (caught if r.doc_id in bad else clean).append(r.predicted)
    assert np.mean(caught) == 1 and np.mean(clean) == 0


def test_neighbours(results, tables):
    rows = [(i, np.array(v)) for i, v, _ in tables[5] if i is not None and v is not None and any(v)]
    unit = np.stack([v / np.abs(v).max() for _, v in rows])
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    got, hits, asked = {}, 0, 0
    for r in results("op7_nearest")[1]:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 50, 100, 150, 350}
    for q in (0, 50, 150, 350):
        at = next(k for k, (i, _) in enumerate(rows) if i == q)
        s = unit @ unit[at]
        best = sorted((-round(float(s[k]), 12), rows[k][0]) for k in range(len(rows)) if rows[k][0] != q)[:5]
        assert sorted(r for r, _, _ in got[q]) == [1, 2, 3, 4, 5] and len({i for _, i, _ in got[q]}) == 5
        hits += len({i for _, i in best} & {i for _, i, _ in got[q]})
        asked += 5
    assert hits >= 0.8 * asked and ann.TOP == 5


def test_fingerprints(results, tables):
    for r in results("op8_simhash")[1]:
        text = next(t for i, t, *_ in tables[1] if i == r.doc_id)
        assert re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.fingerprint == simhash.fingerprint((text or "").encode()).hex()
    roots = {r.doc_id: r.component_id for r in results("op8_simhash")[1]}
    assert roots[301] == roots[1] and roots[400] == roots[401] == 400


def test_leaks(results, tables):
    plain = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\xff]+", (t or "").lower().encode().decode("latin-1")))
    want = {(i, k) for i, t, *_ in tables[1] for k, x in tables[3] if plain(x) in plain(t)}
    assert {(r.doc_id, r.item_id) for r in results("op9_decontaminate")[1]} == want and len(want) > 15 and decontaminate.THRESHOLD == 0.6


def plain_ftrl(sample):
    """FTRL-proximal with a dictionary, one number at a time."""
    Q, z, n = quality, {}, {}

    def weight(k):
        zi = z.get(k, 0.0)
        return 0.0 if abs(zi) <= Q.L1 else -(zi - math.copysign(Q.L1, zi)) / ((Q.BETA + math.sqrt(n.get(k, 0.0))) / Q.ALPHA + Q.L2)

    for _ in range(Q.EPOCHS):
        for text, y in sample:
            buckets = buckets_of(text)
            x = {k: c * Q.SCALE / max(1, len(buckets) // 3) for k, c in Counter(buckets).items()} | {Q.DIM: 1.0}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weight(k) * v for k, v in x.items())))))
            new = {}
            for k, v in x.items():
                g = (p - y) * v
                old = n.get(k, 0.0)
                new[k] = (z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / Q.ALPHA * weight(k), old + g * g)
            for k, (a, b) in new.items():
                z[k], n[k] = a, b
    return weight


def buckets_of(text):
    """Buckets of words, pairs and triples of classes in plain integers."""
    m, out = (1 << 64) - 1, []
    m1, m2, m3 = (int(x) for x in (quality.M1, quality.M2, quality.M3))
    last, kind1, kind2 = 0, 32, 33
    for token in quality.TOKEN.findall((text or "").encode()):
        code = quality.word_code(token)
        word, kind = code >> 4, (code & 15) | (16 if code == last else 0)
        out += [(word * m1 & m) >> 44, (((word * m1 & m) ^ (((last >> 4) * m2 + m3) & m)) * m2 & m) >> 44]
        out.append((((kind + 1) * m3 & m) ^ ((kind1 + 64) * m1 & m) ^ ((kind2 + 4096) * m2 & m)) * m1 % (1 << 64) >> 44)
        last, kind1, kind2 = code, kind, kind1
    return out


def test_quality(results, tables):
    weight = plain_ftrl(plain_sample(tables, 1, 3, 1))
    text, label, right = {d[0]: d[1] for d in tables[1]}, {i: y for i, y, _ in tables[2] if y is not None}, []
    for r in results("op10_quality")[1]:
        buckets = buckets_of(text[r.doc_id])
        margin = weight(quality.DIM) + quality.SCALE * sum(map(weight, buckets)) / max(1, len(buckets) // 3)
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-4) and r.predicted == (r.score >= 0.5) and r.held_out == (r.doc_id is not None and fold(r.doc_id, 3) == 1)
        if r.held_out and r.doc_id in label:
            right.append(r.predicted == label[r.doc_id])
    assert np.mean(right) > 0.95


def test_ties():
    """Equal priorities go to the longer interval, then to the earlier start; equal languages to the smaller name."""
    hits = [h for h in license_scan.scan("all rights reserved some rights reserved") if h.rule.label == "reserved"]
    assert [(h.start, h.end) for h in hits] == [(3, 6), (0, 3)] and hits[0].rule.priority > hits[1].rule.priority
    same = license_scan.scan("cc by cc by all rights reserved")
    assert [(h.end - h.start, h.start) for h in same] == sorted(((h.end - h.start, h.start) for h in same), key=lambda x: (-x[0], x[1]))
    model = language_id.Crf(["de", "en"], np.zeros((language_id.DIM, 2), np.float32), np.zeros((2, 2)))
    assert language_id.predict([b"word other"], language_id.Emissions(model)) == (["de"], pytest.approx(np.array([0.5])))
