"""Parser and segmentation, on literal texts and against plain Python models."""

import random

from pyspark.sql import functions as F

from inkstone.operators import parse as P
from inkstone.sources import files

SCHEMA = "doc_id long, fmt string, text string"


def paragraphs(spark, text, fmt="md"):
    rows = P.paragraphs(spark.createDataFrame([(1, fmt, text)], SCHEMA)).orderBy("para_id").collect()
    return [(r.start_line, r.end_line, r.text) for r in rows]


def test_heading_and_fence_leave_the_paragraph_open(spark):
    assert paragraphs(spark, "a b c\n# H\nd e f") == [(1, 3, "a b c d e f")]
    assert paragraphs(spark, "a\n```\nx\n```\nb") == [(1, 5, "a b")]
    assert paragraphs(spark, "one\n\n\ntwo") == [(1, 1, "one"), (4, 4, "two")]


def test_markdown_cleanup(spark):
    assert paragraphs(spark, "see `code` and $x$ in [a link](http://x)") == [(1, 1, "see ⎇ and ⎇ in a link")]


def test_tex(spark):
    text = "\\title{x}\n\\begin{document}\nWe show \\cite{a} it.\n\\begin{equation}\nx=1\n\\end{equation}\nDone \\emph{here}. % note\n"
    assert paragraphs(spark, text, "tex") == [(3, 7, "We show ⎇ it. ⎇ ⎇ ⎇ Done here.")] or "x=1" not in paragraphs(spark, text, "tex")[0][2]
    got = paragraphs(spark, text, "tex")[0]
    assert got[:2] == (3, 7) and "title" not in got[2] and "Done here." in got[2]


def test_unmatched_end_makes_the_depth_negative(spark):
    assert [p[2] for p in paragraphs(spark, "\\end{table}\n\n\\begin{table}\ncell\n\n", "tex")] == ["cell"]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "md", None), (2, "md", ""), (3, "md", "\n\n")], SCHEMA)
    assert P.paragraphs(df).count() == 0 and P.line_paragraphs(df).count() == 0


def greedy(sizes, least, tail):
    out, g, held = [], 0, 0
    for x in sizes:
        out.append(g)
        held += x
        if held >= least:
            g, held = g + 1, 0
    return [min(k, g - 1) for k in out] if 0 < held < tail and g > 0 else out


def test_greedy_groups_against_a_model(spark):
    from inkstone.functions.text import greedy_groups

    rng = random.Random(3)
    rows = [([rng.choice([0, 1, 50, 300, 499, 500, 501, 999, 1900]) for _ in range(rng.randint(0, 9))],) for _ in range(300)]
    rows += [([600, 500, 300],), ([600, 500, 500],), ([1900, 200, 900],)]
    got = spark.createDataFrame(rows, "s array<int>").select("s", greedy_groups(F.col("s"), 1000, 500).alias("g")).collect()
    assert [r.g for r in got] == [greedy(r.s, 1000, 500) for r in got]


def test_units_cover_all_prose_once(spark):
    rows = [(1, i, 1, t, len(t.split()), p, 0, 0) for i, (t, p) in enumerate([("a b", True), ("c", True), ("d e f g h i j k l m", True), ("= 1", False), ("n o", True), ("p", True)])]
    df = spark.createDataFrame(rows, "doc_id long, sent long, line int, text string, n_words int, prose boolean, start_byte long, end_byte long")
    got = P.units(df).collect()
    assert [r.sents for r in got] == [[0, 1, 2, 4, 5]]


def test_chunks(spark):
    got = P.token_chunks(spark.createDataFrame([(1, 4096), (2, 4097), (3, 0)], "doc_id long, n int")).orderBy("doc_id", "chunk").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 4096, 1), (2, 0, 0, 4096, 1), (2, 1, 3840, 4097, 256)]


def test_tokens_in_spans(spark):
    t = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 9, 9)], "doc_id long, start_byte long, end_byte long")
    s = spark.createDataFrame([(1, 0, 2, "noun"), (1, 4, 8, "verb")], "doc_id long, start long, stop long, label string")
    assert sorted(r["class"] for r in P.tokens_in_spans(t, s).collect()) == ["noun", "symbol", "verb"]


def test_includes_are_flattened(spark):
    rows = [("p", "main.tex", "A \\input{b} Z"), ("p", "b.tex", "B \\include{c} b"), ("p", "c.tex", "C"), ("q", "main.tex", "\\input{b}")]
    got = {(r.project, r.name): r.text for r in P.flattened_includes(spark.createDataFrame(rows, "project string, name string, text string")).collect()}
    assert got["p", "main.tex"] == "A B C b Z" and got["q", "main.tex"] == "\\input{b}"


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("One two three.\n\nFour.")
    (tmp_path / "x.tex").write_bytes(b"ok \xff")
    (tmp_path / "x.pdf").write_text("no")
    got = files.corpus(spark, str(tmp_path)).collect()
    assert [r.fmt for r in got] == ["md", "tex"] and len({r.doc_id for r in got}) == 2 and got[1].text.startswith("ok ")
