"""The ten operators against brute force, round trips and held-out accuracy, with edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from inkstone.llm import ann, common, decontaminate, language_id, license_scan, mixing, quality, repeats, simhash, toxicity, warc
from inkstone.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", None, "a", 1), (3, "x " * 30_000, "en", None, 5), (3, "x " * 30_000, "en", None, 5)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, repeated rows, and columns of clashing names."""
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(1) for c in ("size", "doc", "fp", "score", "key", "rep", "_spans_of", "held_out")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1


def plain_base(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at = []
    for phrase, label, _ in license_scan.BASE_RULES:
        p = phrase.split()
        at += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_license_base_rules_against_brute_force(spark):
    rng = random.Random(1)
    bits = ["CC", "by", "cc-BY", "General", "public", "license", "All", "rights", "reserved", "é", "x.", "\n", "ccby", "(c)", "mit", "the", "under", "licensed"]
    rows = [(i, rng.choice([" ", "-", ". "]).join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, None), (901, "")]
    got = {r.doc_id: r for r in license_scan.license_scan(docs_of(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def labels_of(text):
    return license_scan.summary(license_scan.scan(text))[4]


def test_grants_over_line_breaks_and_markup():
    for text in ("Distributed\nunder the Apache 2.0", "released **under** GPL 3", "available  under the terms of the Apache 2.0"):
        assert labels_of(text) and labels_of(text) == labels_of(" ".join(re.findall(r"\w+", text))), text


def test_license_suppression(spark):
    hits = license_scan.scan("Licensed under the Apache License, Version 2.0 (c) all rights reserved")
    kept = {h.label for h in hits if h.kept}
    assert "apache-2.0" in kept and "apache" not in kept and "reserved" in kept
    assert license_scan.summary(hits)[3] == "reserved"


def test_signatures_are_many_and_each_its_own():
    rules = license_scan.rules()
    assert len(rules) > 250 and len({r.pattern for r in rules}) == len(rules)
    assert all(0 < r.weight < 1 for r in rules) and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def test_keywords_and_expressions_agree():
    """Strings drawn from each expression have its keyword and are detected by its rule."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    def agrees(rank, rule):
        @settings(max_examples=8, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(rule.pattern, fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz0123456789 é"))
        def check(text):
            text = " ".join(text.split())
            if re.fullmatch(rule.pattern, text):
                assert any(h.rank == rank for h in license_scan.scan(f"xx {text} yy")), (rule, text)

        check()

    for rank, rule in enumerate(license_scan.rules()):
        agrees(rank, rule)


def test_versions_are_in_labels():
    assert labels_of("GNU Lesser General Public License v2.1") == "gpl,lgpl-2.1" and labels_of("GPL 3 license") == "gpl-3.0"
    assert labels_of("under Mozilla Public License") == "mpl" and labels_of("SPDX-License-Identifier: CC-BY-SA-4.0") == "cc-by,cc-by-sa-4.0"


def test_suppression_against_all_pairs():
    rng = random.Random(24)
    bits = "cc by sa nc 4.0 gnu general public license lesser version 2 apache all rights reserved licensed under the terms of mit x".split()
    for _ in range(150):
        hits = license_scan.scan(" ".join(rng.choices(bits, k=rng.randint(1, 60))))
        kept = []
        for h in hits:
            assert h.kept == (not any(k.start <= h.start and h.end <= k.end for k in kept))
            kept += [h] * h.kept
        assert all((-a.rule.priority, a.start - a.end, a.start, a.rank) <= (-b.rule.priority, b.start - b.end, b.start, b.rank) for a, b in zip(hits, hits[1:], strict=False))


def test_a_long_text_of_phrases_takes_no_square_time():
    import time

    text = "cc by sa 4.0 general public license apache license 2.0 foo " * 17_000
    assert len(text) > 1_000_000
    license_scan.scan("cc by")
    start = time.process_time()
    assert len(license_scan.scan(text)) > 80_000
    assert time.process_time() - start < 10  # 2 s on a machine of its own


# 2


def test_warc_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", rng.choice([None, "", "short", "<p>é" * 40, "".join(rng.choices("abc <>\r\n", k=rng.randint(90, 3000)))])) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= warc.MIN_DEDUP:
            first[b] = min(first.get(b, i), i)
    got = {r.page_id: r for r in warc.read_bundles(warc.write_bundles(pages)).collect()}
    for i, _, h in rows:
        b = (h or "").encode()
        to = first[b] if len(b) >= warc.MIN_DEDUP and first[b] != i else None
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to)


def test_bundle_is_seekable():
    import zstandard

    w = warc.BundleWriter(frame_bytes=500)
    records = {str(i): warc.record(i, "u", b"x%d" % i * 50, 3, "d", None) for i in range(40)}
    for k, r in records.items():
        w.add(k, r)
    archive, index = w.close()
    reader = warc.BundleReader(archive)
    assert len(reader.sizes) > 5
    for k, frame, offset, length in reversed(index):
        assert reader.read(frame, offset, length) == records[k]
    whole = b"".join(zstandard.ZstdDecompressor().decompress(archive[a:b]) for a, b in zip(reader.at, reader.at[1:], strict=False))
    assert whole == b"".join(records.values())
    with pytest.raises(ValueError):
        warc.BundleReader(archive[:-1] + b"\x00")


def test_warc_without_pages(spark):
    assert warc.read_bundles(warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# 3


def plain_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if (w := b[p : p + 100]) in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and über thing ntion ña x erre".split()) + rng.choice("ab é cd".split())
    words = lambda n: " ".join(word() for _ in range(n))
    passages, rows = [words(rng.randint(10, 60)) for _ in range(5)], []
    for i in range(90):
        r = rng.random()
        if r < 0.1:
            t = None if r < 0.03 else ""
        elif r < 0.35:
            t = f"{words(20)} {rng.choice(passages)} {words(15)} {rng.choice(passages) if r < 0.2 else ''}"
        elif r < 0.42:
            t = "An " * rng.randint(30, 200)
        elif r < 0.6 and rows:
            t = rng.choice(rows)[1] or ""
            if t and r < 0.5:
                k = rng.randrange(len(t))
                t = t[:k] + "ZZ" + t[k + 3 :]
        else:
            t = words(rng.randint(1, 150))
        rows.append((i * 3, t))
    return [*rows, (None, rows[7][1] or words(30))]


def test_a_worker_of_repeats_holds_little(monkeypatch):
    """Tables go with their task; blocks to be compared are not much larger than SORT_BLOCK, in whole grams, however large the batches."""
    rng = random.Random(23)
    text = "".join(rng.choices("abcdefgh ", k=4000))
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text[:2000]])], ["doc", "text"])
    assert sum(x.num_rows for x in repeats._anchors(iter([docs]))) and not getattr(repeats, "POWERS", {})
    of = ["".join(rng.choices("abcdefgh ", k=139)) for _ in range(2000)]
    rows = [(k // 3, k, of[k // 3][:-1].encode() + b"xyz"[k % 3 : k % 3 + 1]) for k in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([0] * 6000), pa.array([40] * 6000, pa.int32()), pa.array([r[2] for r in rows])], ["key", "doc", "a", "n", "bytes"])
    spans = lambda: sorted(x for out in repeats._compare(iter([batch])) for x in zip(*out.to_pydict().values(), strict=True))
    want, seen, plain = spans(), [], repeats.earlier_match
    monkeypatch.setattr(repeats, "SORT_BLOCK", 100_000)
    monkeypatch.setattr(repeats, "earlier_match", lambda data, starts: seen.append(len(data)) or plain(data, starts))
    assert spans() == want and len(want) and sum(seen) == 6000 * 139 and max(seen) < 200_000


def test_slices_of_all_sizes_share_their_tables(monkeypatch):
    """A worker keeps the powers of its largest slice, not those of each size; contexts don't depend on what it has read before."""
    rng = np.random.default_rng(22)
    data = rng.integers(97, 123, 300_000, dtype=np.uint8)
    of = lambda n: repeats.contexts(data[:n], np.array([0, n]))
    monkeypatch.setattr(repeats, "POWERS", {}, raising=False)
    before = [of(n) for n in (50_000, 100_000)]
    of(300_000)
    for n, was in zip((50_000, 100_000), before, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(was, of(n), strict=True))
    for which in (0, 1):
        large = repeats._powers(1 << 18, which)
        assert all(np.shares_memory(x, y) for n in (16, 17) for x, y in zip(large, repeats._powers(1 << n, which), strict=True))


@pytest.mark.parametrize("cap", [20_000, 3])
def test_repeats_against_brute_force(spark, cap):
    rows = repeat_rows(cap)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(docs_of(spark, rows), cap).collect()}
    assert got == plain_repeats(rows) and sum(x[1] for x in got.values()) > 1000


def test_rows_given_twice_in_any_layout(spark):
    rng = random.Random(13)
    text = lambda: " ".join(rng.choices("the of and thing some other words ab cd ef".split(), k=60))
    first, second, shared = text(), text(), text()
    rows = [(1, first), (2, second), (3, f"{shared} end"), (4, f"and {shared}")] * 2
    for n in (1, 2, 8):
        df = spark.createDataFrame(spark.sparkContext.parallelize([(i, t, "en", "s", 1) for i, t in rows], n), DOCS)
        got = {}
        for r in repeats.without_repeats(df).collect():
            got.setdefault(r.doc_id, set()).add(r.text)
        assert got == {1: {first}, 2: {second}, 3: {f"{shared} end"}, 4: {"and "}}


def test_resolver_over_batches():
    key = np.full(3, 7)
    rows = [(key, key, key, np.array([1, 1, 2]), np.array([5 << 16] * 3)), (key, key, key, np.array([2, 3, 3]), np.array([5 << 16] * 3))]
    for first, second in ((rows[0], rows[1]), ([x[:1] for x in rows[0]], [x[1:] for x in rows[0]])):
        state = repeats.Resolver(20)
        found = [d for part in (first, second) for doc, kind, *_ in state.take(*part) for d, k in zip(doc, kind, strict=True) if k == 0]
        assert 1 not in found and 2 in found


def test_texts_without_an_id_are_documents_of_their_own(spark):
    rng = random.Random(14)
    text = lambda: " ".join(rng.choices("the of and thing some other words ab cd ef".split(), k=60))
    one, own, other = text(), text(), text()
    df = docs_of(spark, [(1, one), (None, f"{one}{own}"), (None, other)])
    assert {r.text for r in repeats.without_repeats(df).collect()} == {one, own, other}


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    data = np.frombuffer(("ab cde " * 300 + "".join(random.Random(5).choices("abcdef ", k=4000))).encode() * 2, np.uint8)
    monkeypatch.setattr(repeats, "PIECE", 1000)
    first, extent = [np.concatenate(x) for x in zip(*[(c[4], c[6]) for c in repeats._in_slices(data, np.array([0, len(data)]))], strict=True)]
    covered = np.sort(np.concatenate([np.arange(a, a + e + 1) for a, e in zip(first, extent, strict=True)]))
    assert np.array_equal(covered, np.arange(len(data) - repeats.MIN + 1))


def test_suffix_ranks_agree_with_strings():
    rng = random.Random(4)
    data = np.frombuffer("".join(rng.choices("ab", weights=[9, 1], k=3000)).encode(), np.uint8)
    starts = np.array(sorted(rng.sample(range(2900), 800)))
    strings = [data[s : s + 100].tobytes() for s in starts]
    order = {s: i for i, s in enumerate(sorted(set(strings)))}
    rank = repeats.suffix_ranks(data, starts)
    assert np.array_equal(np.unique(rank, return_inverse=True)[1], [order[s] for s in strings])
    first = {}
    want = [first.setdefault(s, i) != i for i, s in enumerate(strings)]
    assert repeats.earlier_match(data, starts).tolist() == want


def test_texts_keep_whole_characters(spark):
    tail = "".join(random.Random(3).choices("éàüñ", k=80))
    df = docs_of(spark, [(1, "a" + tail), (2, "bb" + tail + "c")])
    got = {r.doc_id: r.text for r in repeats.without_repeats(df).collect()}
    assert got[1] == "a" + tail and got[2] == "bbc"


# 4


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 40), None, rng.choice(["a", "b", "c", "d", None]), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixing_plan(df, ["doc_id", "source"]).collect()
    total = sum(r.size for r in got)
    per = {}
    for r in got:
        assert r.copies <= 3
        x = per.setdefault(r.source, [r.source_size, r.target, 0])
        x[2] += r.size * r.copies
    assert sum(t for _, t, _ in per.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for s, t, _ in per.values()) and all(abs(n - t) < 0.1 * t for _, t, n in per.values())
    again = mixing.mixing_plan(df.repartition(5), ["doc_id", "source"]).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_targets_are_capped_and_reshared(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert got["a"] == 30 and got["d"] == 0 and got["b"] + got["c"] == pytest.approx(1480) and got["b"] == pytest.approx(2 * got["c"])


def test_salted_mix_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 7), None, f"s{i % 5}", 0) for i in range(200)], DOCS)
    want = sorted(map(tuple, mixing.mixing_plan(df, ["doc_id"]).select("doc_id", "target", "copies").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(tuple, mixing.mixing_plan(df, ["doc_id"]).select("doc_id", "target", "copies").collect())) == want


# 5


def language_rows():
    rng = random.Random(5)
    parts = {"en": "the ing tion wh of er", "de": "sch ung keit der ein zu", "es": "ción os ar que la ñ"}
    text = lambda k, n: " ".join("".join(rng.choices(parts[k].split(), k=rng.randint(1, 3))) for _ in range(n))
    return text, [(text(k, rng.randint(5, 60)), k) for k in list(parts) * 40]


def test_crf_labels_code_switched_words():
    text, rows = language_rows()
    model = language_id.train(rows)
    e = language_id.Emissions(model)
    new = [text(k, 30) for k in ("en", "de", "es") * 10]
    langs, score = language_id.predict([t.encode() for t in new], e)
    assert langs == ["en", "de", "es"] * 10 and score.min() > 0.5
    both = (text("en", 40) + " " + text("de", 40)).encode()
    ((_, n, marginal),) = language_id.word_marginals([both], e)
    best = marginal[:, 0].argmax(1)
    assert (best[:40] == model.langs.index("en")).mean() > 0.9 and (best[40:80] == model.langs.index("de")).mean() > 0.9
    assert np.allclose(marginal.sum(2), 1, atol=1e-4)


def test_forward_backward_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(6)
    scores, trans = rng.random((4, 2, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    got, _, pair = language_id.forward_backward(scores.copy(), lengths, trans, pairs=True)
    want_pair = np.zeros((3, 3))
    for j, n in enumerate(lengths):
        want, z = np.zeros((n, 3)), 0.0
        these = np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            p = np.prod([scores[t, j, s] for t, s in enumerate(path)]) * np.exp(sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            z += p
            for t, s in enumerate(path):
                want[t, s] += p
            for a, b in zip(path, path[1:], strict=False):
                these[a, b] += p
        assert np.allclose(got[:n, j], want / z)
        want_pair += these / z
    assert np.allclose(pair, want_pair)


# 6


def test_toxicity_learns_and_scores():
    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice("a the river stone walks blue".split()) + rng.choice("s ed ly".split()) for _ in range(rng.randint(5, 40)))
    rows = [(clean(), 0) for _ in range(300)] + [(clean() + f" snorkfoo{rng.choice('abcd')} " + clean(), 1) for _ in range(60)]
    rng.shuffle(rows)
    model = toxicity.learn(rows)
    s = toxicity.Symbols(model)
    assert s.score(b"a river snorkfoox walks") >= toxicity.THRESHOLD and s.score(b"a river stone walks") < 0.1 and 0 < s.score(b"") < 0.1


def test_grammar_gives_clauses():
    assert [m.__name__ for m in toxicity.MACHINES] == ["insult_machine", "threat_machine", "negation_machine", "report_machine", "target_machine"]
    ends = lambda s: [g for x, (g, _) in zip(s, toxicity.grammar().run(s), strict=True) if x in ",."]
    assert ends("TOi.") == ["I@"] and ends("iT.") == ["I@"] and ends("Oi.") == ["I"] and ends("TNOi.") == ["I-@"] and ends("NOOOi.") == ["I"]
    assert ends("ROi.") == ['I"'] and ends("RO.i.") == [".", "I"] and ends("RO,i.") == [",", 'I"'] and ends("T,i.") == [",", "I"]
    assert ends("wOhT.") == ["H@"] and ends("hT.") == ["V@"] and ends("wNh.") == ["H-"] and ends("iOi,i.") == ["J", "I"] and ends("Nih.") == ["I-"]
    seeds = toxicity.Symbols(toxicity.learn([]))
    assert seeds.score(b"you are an idiot") >= toxicity.THRESHOLD > seeds.score(b"you are not an idiot") > seeds.score(b"you are here")
    assert seeds.score(b"you are an idiot") > seeds.score(b"an idiot") > seeds.score(b"she said you are an idiot")
    assert seeds.score(b"i will kill you") >= toxicity.THRESHOLD > seeds.score(b"to kill time")


def test_the_composed_machine_is_its_parts():
    rng = random.Random(20)
    for _ in range(200):
        tape = rng.choices(toxicity.BASE, k=rng.randint(1, 30))
        want = tape
        for machine in toxicity.MACHINES:
            want = [g for g, _ in machine().run(want)]
        assert [g for g, _ in toxicity.grammar().run(tape)] == want


def test_clause_weights_decide_on_rows_held_out():
    """Insults that are reported or negated are clean here, and aimed ones toxic: words alone can't tell."""
    rng = random.Random(21)
    filler = lambda: " ".join(rng.choices("the river walks slowly past a stone house and old trees".split(), k=rng.randint(3, 20)))
    toxic = lambda: rng.choice(["you are such a snorkler", "he is a snorkler", "you pathetic snorkler"])
    clean = lambda: rng.choice(["never a snorkler", "she said a snorkler walks", "not one snorkler"])
    rows = [(f"{filler()}. {toxic()}. {filler()}", 1) for _ in range(400)] + [(f"{filler()}. {clean()}. {filler()}", 0) for _ in range(120)]
    rows += [(filler(), 0) for _ in range(600)]
    rng.shuffle(rows)
    train, held = rows[:700], rows[700:]
    model = toxicity.learn(train)
    flat = toxicity.Model(model.chance, dict.fromkeys(toxicity.KINDS, max(model.kinds.values())), model.hints, model.bias, model.hint_weight)
    right = lambda m: sum((toxicity.Symbols(m).score(t.encode()) >= toxicity.THRESHOLD) == bool(y) for t, y in held) / len(held)
    assert right(model) > 0.98 and right(flat) < 0.95


def test_weights_against_a_plain_descent():
    rng = np.random.default_rng(22)
    x = np.concatenate([np.ones((300, 1)), rng.normal(size=(300, 3))], 1)
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [-1, 2, 0, -1]))).astype(float)
    lean, w = np.array([0.0, 1, 1, 1]), np.zeros(4)
    for _ in range(20_000):
        w += 0.005 * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) - toxicity.RIDGE * (w - lean))
    assert np.allclose(toxicity.weighed(x, y, lean), w, atol=1e-6)


# 7


def test_nearest_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2050, [], 0), (2100, [0.0] * 16, 0), (2150, [float("nan")] * 16, 0), (2200, [1.0] * 15 + [None], 0), (2250, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    monkeypatch.setattr(ann, "BLOCK", 7)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 900, 50))
    y = x.astype(np.float64)
    hits = 0
    for q in got:
        s = y @ y[q] / np.sqrt((y * y).sum(1) * (y[q] @ y[q]))
        s[q] = -9
        best = sorted(range(900), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len(set(best) & {v for v, _ in got[q].values()})
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-12 for v, c in got[q].values())
    assert hits >= 0.9 * 5 * len(got)
    assert [got[0][k][0] for k in range(1, 6)] == [100, 101, 102, 103, 104]


def plain_nearest(x, ids, q, top=5):
    y = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    s = (y * y[q]).sum(1) / np.sqrt((y * y).sum(1) * (y[q] * y[q]).sum())
    return sorted((-s[i], ids[i]) for i in range(len(x)) if i != q)[:top]


def test_components_of_any_size(spark):
    rng = np.random.default_rng(17)
    x = np.concatenate([rng.normal(size=(59, 4)), [[1e-200, 1e-200, 0, 0], [1e200, 1e200, 0, 0], [5e-324, 0, 0, 0], [1.7e308, -1.7e308, 1.7e308, 1.0]]])
    ids = [*range(59), 450, 500, 550, 600]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ann.nearest(df, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert sorted(got) == [0, 50, 450, 500, 550, 600]
    for q, hits in got.items():
        want = plain_nearest(x, ids, ids.index(q))
        assert [i for _, i in hits] == [i for _, i in want] and np.allclose([s for s, _ in hits], [s for s, _ in want], rtol=0, atol=1e-12)


def test_the_share_follows_the_structure():
    rng = np.random.default_rng(18)
    centers = rng.normal(size=(40, 32))
    clustered = centers[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 32))
    loose, tight = ann.fitted(rng.normal(size=(4000, 32)), 4000), ann.fitted(clustered, 4000)
    assert tight.share < 0.1 < loose.share < 0.7


def test_blocks_hold_all_cells():
    rng = np.random.default_rng(19)
    counts = rng.integers(0, 30, 200)
    counts[7] = 1000
    blocks = ann.Blocks.of(counts, 64)
    load = np.zeros(int((blocks.first + blocks.n_sub).max()))
    for c in np.flatnonzero(counts):
        load[blocks.first[c] : blocks.first[c] + blocks.n_sub[c]] += counts[c] / blocks.n_sub[c]
    assert load.sum() == pytest.approx(counts.sum()) and load.max() <= 64 and (load > 0).all()


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (50, [1.0, 2.0, 3.0], 0)], "vec_id long, embedding array<float>, label int")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(df).collect()] == [(0, 1)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_traverse_goes_by_summed_distance():
    rng = np.random.default_rng(8)
    d1, d2, counts = rng.random(5), rng.random(6), rng.integers(0, 4, (5, 6))
    got = ann.traverse(d1, d2, counts, 10**9)
    want = sorted(((i, j) for i in range(5) for j in range(6) if counts[i, j]), key=lambda c: d1[c[0]] + d2[c[1]])
    assert got == want


# 8


def plain_fingerprint(text, words=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    n = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(s))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("cap", [8192, 3])
def test_simhash_against_brute_force(spark, cap):
    rng = random.Random(8)
    base = [" ".join(rng.choices("Ab cd é ef gh ij kl".split(), k=rng.randint(0, 400))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(100, 160):
        t = rng.choice(base).split()
        if t:
            t[rng.randrange(len(t))] = "new"
        rows.append((i, " ".join(t)))
    rows += [(200, None), (201, " \n")]
    fp = {i: plain_fingerprint(t) for i, t in rows}
    want = roots(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs_of(spark, rows), cap=cap).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def close_fingerprints(rng, n):
    """Fingerprints in chains of one to three differing bits, many of them alike in most bytes."""
    fps = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    while len(fps) < n:
        x = fps[rng.integers(len(fps))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= 1 << int(b)
        fps.append(x)
    return sorted(set(fps))


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 6])
def test_tally_loses_no_component(bits):
    octets = np.array(close_fingerprints(np.random.default_rng(9), 400), np.uint64).view(np.uint8).reshape(-1, 8)
    fps = octets.copy().view(np.uint64).ravel()
    n = len(fps)
    linked = [(i, j) for i in range(n) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= bits]
    tree = simhash.tally_forest(octets, list(range(8)), 8 - bits, bits)
    assert {i: int(t) for i, t in enumerate(tree)} == roots(range(n), linked)
    rows = [(i, x) for i, x in enumerate(fps.tolist())]
    share = lambda x, y, at: all(x >> 8 * p & 255 == y >> 8 * p & 255 for p in at)
    assert all(any(share(rows[i][1], rows[j][1], at) for at in simhash.chunk_sets(8, bits)) for i, j in linked)


@pytest.mark.parametrize(("bits", "cap", "batch"), [(2, 8192, 50), (2, 5, 7), (2, 1, 1000), (1, 4, 3), (3, 20, 11)])
def test_parts_of_the_index_against_all_pairs(bits, cap, batch):
    import pyarrow as pa

    fps = np.array(close_fingerprints(np.random.default_rng(bits), 300), np.uint64)

    def run(rows, sets, most):
        rows.sort()
        part, fp = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 2
        batches = [pa.RecordBatch.from_arrays([pa.array(part[k : k + batch]), pa.array(fp[k : k + batch])], ["part", "fp"]) for k in range(0, len(part), batch)]
        return [tuple(r.values()) for b in simhash._link(iter(batches), sets, bits, most) for r in b.to_pylist()]

    sets = simhash.chunk_sets(8, bits)
    dealt = [tuple(r.values()) for b in simhash._dealt(fps.view(np.uint8).reshape(-1, 8), sets) for r in b.to_pylist()]
    first = run(dealt, sets, cap)
    again = run(list({(a, b) for deeper, a, b in first if deeper}), simhash.position_sets(8, 8 - bits), None)
    links = [(a, b) for deeper, a, b in [*first, *again] if not deeper]
    ids = fps.view(np.int64).tolist()
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= bits
    assert roots(sorted(ids), links) == roots(sorted(ids), [(a, b) for a in ids for b in ids if a < b and near(a, b)])


@pytest.mark.parametrize("cluster", [10_000, 4])
def test_similar_against_jaccard(spark, cluster):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(5000)]
    rows, sets = [], {}
    for g in range(12):
        base = rng.choices(words, k=150)
        for k in range(6):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(150)] = rng.choice(words)
            rows.append((100 * g + k, " ".join(t)))
    for i, t in rows:
        sets[i] = set(simhash.shingle_hashes(t.encode(), 5).tolist())
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in simhash.similar(docs_of(spark, rows), cluster=cluster).collect()}
    want = roots(sets, alike)
    assert all(want[i] == want[r] for i, r in got.items()), "nothing is joined that isn't alike"
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(got[a] == got[b] for a, b in alike if share(a, b) >= 0.85)
    assert sum(got[a] != got[b] for a, b in alike) <= 0.1 * len(alike)
    kept = {r.doc_id for r in simhash.first_of_each(docs_of(spark, rows)).collect()}
    assert kept == {i for i in got if got[i] == i}


def test_no_similar_pair_is_lost(spark, monkeypatch):
    """Short texts at a similarity of just 0.8 and above, a passage that many texts share, and no sample at all."""
    rng = random.Random(12)
    words, rows = [f"w{i}" for i in range(3000)], []
    passage = rng.choices(words, k=12)
    for g in range(150):
        base = rng.choices(words, k=rng.choice([12, 13, 14, 22, 31, 49, 58, 94]))
        base = passage + base if g % 3 == 0 else base
        cut = (len(base) - 4) // 9  # words whose loss at one end leaves 0.8 or a little more
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(base[cut:] + rng.choices(words, k=cut)))]
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) >= 140
    want = roots(sets, alike)
    for common in (3, 10**9):
        monkeypatch.setattr(simhash, "COMMON", common)
        assert {r.doc_id: r.component_id for r in simhash.similar(docs_of(spark, rows)).collect()} == want


def test_similar_texts_come_through_the_index(spark, monkeypatch):
    """The index finds near copies by itself and the exact similarity follows; without it the rest loses no pair."""
    rng = random.Random(14)
    words, rows = [f"w{i}" for i in range(3000)], []
    for g in range(25):
        base = rng.choices(words, k=rng.choice([60, 150, 300]))
        for k in range(4):
            t = list(base)
            for _ in range(k * len(t) // 100):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((10 * g + k, " ".join(t)))
    rows += [(1000 + k, " ".join(rng.choices("abc", k=90))) for k in range(5)]  # all word pairs alike, and few shingles

    def bits(t):
        h = set(simhash.shingle_hashes(t.encode(), 2).tolist())
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    fp = {i: bits(t) for i, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    meet = roots(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= simhash.NEAR_DISTANCE])
    met = [(a, b) for a, b in alike if meet[a] == meet[b]]
    assert 20 < len(met) < len(alike) and len({meet[i] for i in range(1000, 1005)}) == 1
    docs, none = docs_of(spark, rows), spark.createDataFrame([], "a long, b long")
    found = lambda: {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    with monkeypatch.context() as m:
        m.setattr(simhash, "maybe_similar", lambda *_: none)
        assert found() == roots(sets, met)
    with monkeypatch.context() as m:
        m.setattr(simhash, "close_links", lambda *_: none)
        assert found() == roots(sets, alike)


def test_lists_of_one_class_are_settled(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join([*base, *[f"x{k}{j}" for j in range(k)]])) for k in range(1, 5)]
    docs = docs_of(spark, rows)
    fps = simhash.fingerprints(docs, simhash.WIDE_SHINGLE, simhash.sketch)
    left = lambda known: sorted(tuple(sorted(r)) for r in simhash.maybe_similar(docs, fps, simhash.representatives(fps), spark.createDataFrame(known, "node long, root long"), 0.8).collect())
    assert roots(range(1, 5), left([])) == dict.fromkeys(range(1, 5), 1)
    assert left([(2, 1), (4, 3)]) == [(1, 3)] and left([(2, 1), (3, 1), (4, 1)]) == []


def test_components(spark):
    rng = random.Random(11)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(None, 3), (5, None)]
    want = roots(range(500), [x for x in links if None not in x])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: r for i, r in want.items() if r != i}


def test_few_links_are_settled_without_rounds(spark, monkeypatch):
    """Up to FEW links take one table and no rounds, more take rounds; both give the same."""
    from inkstone.llm import components as module

    rng = random.Random(21)
    links = [(i, i + 1) for i in range(300)] + [(rng.randrange(-500, 900), rng.randrange(-500, 900)) for _ in range(400)] + [(1 << 62, -(1 << 62)), (7, 7), (None, 3), (5, None)]
    want = {i: r for i, r in roots({x for pair in links if None not in pair for x in pair}, [x for x in links if None not in x]).items() if r != i}
    df, tables = spark.createDataFrame(links, "a long, b long").repartition(5), []
    monkeypatch.setattr(module, "checkpointed", lambda x, of=common.checkpointed: tables.append(x) or of(x))
    assert {r.node: r.root for r in components(df).collect()} == want and len(tables) == 1
    monkeypatch.setattr(module, "FEW", 10, raising=False)
    assert {r.node: r.root for r in components(df).collect()} == want and len(tables) > 4
    monkeypatch.undo()
    assert components(df.where("a = 7 and b = 7")).collect() == components(df.limit(0)).collect() == []


# 9


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(12)
    vocabulary = [a + b for a in "ba ko ri mu te sa lo".split() for b in "nd rst ble th ing ou an".split()]
    text = lambda n: " ".join(rng.choices([*vocabulary, "the", "of", "and"], k=n)) + "."
    items = [(i, f"{text(rng.randint(8, 60))} {text(rng.randint(3, 15))}") for i in range(40)]
    rows, want = [], set()
    for i in range(120):
        t = text(rng.randint(1, 600))
        if i % 3 == 0:
            k = rng.randrange(40)
            t = f"{t} {items[k][1].upper() if i % 2 else items[k][1]} {text(rng.randint(0, 300))}"
            want.add((i, k))
        rows.append((i, t))
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}
    assert got == want
    assert {r.doc_id for r in decontaminate.clean(docs_of(spark, rows), bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


@pytest.mark.parametrize(("seed", "postings"), [(13, 1 << 21), (14, 50), (15, 1)])
def test_no_piece_above_the_threshold_is_missed(seed, postings, monkeypatch):
    monkeypatch.setattr(decontaminate, "POSTINGS", postings)
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(300 if seed == 15 else 60)]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    items = [decontaminate.as_item(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(5, 90)))) for i in range(40)]
    index = decontaminate.Index(items)
    texts = [rng.choices(vocabulary, weights, k=rng.choice([0, 1, 63, 64, 65, 700])) for _ in range(12)]
    for t in texts[::3]:
        t[20:20] = [w.decode() for w in rng.choice(items).words]
    words = [[w.encode() for w in t] for t in texts]
    passage, term, first = decontaminate.passages(words, index)
    plain = {}
    for d, w in enumerate(words):
        for k in range(max(1, -(-len(w) // 64))):
            plain[int(first[d]) + k] = {index.terms[x] for x in w[64 * k : 64 * k + 128] if x in index.terms}
    got_terms = {}
    for p, t in zip(passage.tolist(), term.tolist(), strict=True):
        assert t not in got_terms.setdefault(p, set())
        got_terms[p].add(t)
    assert got_terms == {k: v for k, v in plain.items() if v}
    got = [(h, p) for h, block in index.reachable(passage, term) for p, _ in index.score(block, plain[h])]
    want = {(h, p) for h, terms in plain.items() for p, impact in enumerate(index.impacts) if sum(x for t, x in impact if t in terms) >= 1.0 - 1e-9}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_few_blocks_are_scored():
    rng = random.Random(16)
    vocabulary = [f"t{i}" for i in range(4000)]
    weights = [1 / (1 + i) for i in range(4000)]
    items = [decontaminate.as_item(i, " ".join(rng.choices(vocabulary, weights, k=60))) for i in range(500)]
    index = decontaminate.Index(items)
    passage, term, _ = decontaminate.passages([[w.encode() for w in rng.choices(vocabulary, weights, k=20_000)]], index)
    looked = sum(1 for _ in index.reachable(passage, term))
    assert looked < 0.02 * index.n_blocks * len(np.unique(passage))


def test_rounds_have_the_statistics_of_all_items(spark, monkeypatch):
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 120))) + ". The end of it.") for i in range(30)]
    rows = [(i, " ".join([*rng.choices(vocabulary, k=50), *rng.choice(items)[1].split()[rng.randint(0, 9) :], *rng.choices(vocabulary, k=70)])) for i in range(60)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), docs_of(spark, rows)
    want = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 7)
    got = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2:] for r in got], [r[2:] for r in want]) and len(want) > 40


# 10


def test_quality_learns():
    rng = random.Random(14)
    good = lambda: " ".join(rng.choices("the river walks slowly past a stone house".split(), k=rng.randint(5, 60))) + "."
    bad = lambda: " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in good().split())
    rows = [(good(), 1) for _ in range(200)] + [(bad(), 0) for _ in range(60)]
    rng.shuffle(rows)
    weights, bias = quality.train(rows)
    s = quality.scores([good().encode(), bad().encode(), b""], weights, bias, quality.Codes())
    assert s[0] >= 0.5 > s[1] and 0 <= s[2] <= 1
    assert quality.scores([b"x"], *quality.train([]), quality.Codes())[0] == 0.5


# edge cases of all


def everything(spark, docs):
    model = toxicity.learn([])
    weights, bias = quality.train([])
    bench = spark.createDataFrame([(1, "some words here that are a test item")], "item_id long, text string")
    return {
        "licences": license_scan.license_scan(docs), "repeats": repeats.digests(docs), "cut": repeats.without_repeats(docs), "plan": mixing.mixing_plan(docs, ["doc_id"]),
        "mix": mixing.mix(docs), "language": language_id.identify(docs, None), "toxic": toxicity.toxicity_scores(docs, model), "clean": toxicity.without_toxic(docs, model),
        "simhash": simhash.simhash_components(docs), "first": simhash.first_of_each(docs), "leaks": decontaminate.contaminated(docs, bench), "unleaked": decontaminate.clean(docs, bench),
        "quality": quality.quality_scores(docs, weights, bias),
    }


def test_odd_rows(spark, odd):
    got = {k: df.collect() for k, df in everything(spark, odd).items()}
    for k in ("licences", "repeats", "cut", "plan", "language", "toxic", "clean", "simhash", "unleaked", "quality"):
        assert len(got[k]) == len(ODD), k
    assert {r.lang_pred for r in got["language"]} == {"und"} and all(0 < r.score < toxicity.THRESHOLD for r in got["toxic"])
    assert set(got["cut"][0].asDict()) == set(odd.columns) == set(got["first"][0].asDict()) == set(got["mix"][0].asDict())
    zero = {r.doc_id: r for r in got["simhash"]}
    assert zero[1].fingerprint == "0" * 16 and zero[2].component_id == 1


CLASHING = "_rate rate _source known _copy copy copies size target source_size _doc doc _spans spans id row _pick pick _salt salt _own_size held_out key rep COPY Spans".split()


def test_columns_of_clashing_names_keep_their_values(spark):
    rng = random.Random(23)
    words = lambda n: " ".join(rng.choices("the of and über thing other words ab cd ef".split(), k=n))
    passage = words(40)
    rows = [(i, f"{words(30)} {passage if i % 3 == 0 else words(9)}", "en", f"s{i % 4}", i) for i in range(60)]
    plain = spark.createDataFrame(rows, DOCS)
    names = [c for i, c in enumerate(CLASHING) if c.lower() not in [x.lower() for x in CLASHING[:i]]]
    for own in (names, ["COPY", "Spans", "Row", "ID"]):
        docs = plain.select("*", *[(F.col("doc_id") * 100 + k).alias(c) for k, c in enumerate(own)])
        model, bench = toxicity.learn([]), spark.createDataFrame([(1, "no such item")], "item_id long, text string")
        for op in (mixing.mix, repeats.without_repeats, simhash.first_of_each, lambda d: toxicity.without_toxic(d, model), lambda d: decontaminate.clean(d, bench)):  # noqa: B023
            want, got = op(plain), op(docs)
            assert got.columns == docs.columns
            assert sorted(r[:5] for r in got.collect()) == sorted(tuple(r) for r in want.collect())
            assert all(r[5 + k] == r.doc_id * 100 + k for r in got.collect() for k in range(len(own)))


def test_names_not_taken():
    assert common.fresh("a", ["b"]) == "a" and common.fresh("a", ["A", "_a"]) == "__a"


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i + 1)) for i in range(40)] + [(7, "b"), (7, None), (8, None), (None, "n")] + [(9, "a" * 5)] * 500, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (4, 1), (5, 2), (None, 1), (6, 0), (99, 1)], "doc_id long, quality int")
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    texts = {i: min([t or "" for j, t in [(r.doc_id, r.text) for r in docs.collect()] if j == i]) for i in range(40)}
    ids = sorted((i for i in range(40) if fold(i) != 1), key=lambda i: zlib.crc32(str(i).encode()))
    got = common.labelled_sample(docs, labels, "quality", 3, 1, 1000)
    assert got == [(texts[i], 1 if i == 4 else i % 2) for i in ids]
    assert len(common.labelled_sample(docs, labels, "quality", 3, 1, 5)) == 5
    few = common.labelled_sample(docs, labels, "quality", 3, 1, 1000, most_bytes=300)
    assert 0 < sum(len(t) for t, _ in few) <= 300 and all(x in got for x in few) and len(few) < len(got)
    assert common.labelled_sample(docs, labels.limit(0), "quality", 3, 1, 10) == common.labelled_sample(docs.limit(0), labels, "quality", 3, 1, 10) == []
    langs = spark.createDataFrame([(i, "die ung keit" if i % 2 else "the ing tion", "de" if i % 2 else "en") for i in range(30)] * 3 + [(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string")
    assert language_id.fitted(langs).langs == ["de", "en"] and language_id.fitted(langs.limit(0)) is None


def test_empty_tables(spark, none):
    assert all(df.count() == 0 for df in everything(spark, none).values())
