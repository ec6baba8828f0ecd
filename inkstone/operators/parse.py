"""Documents to lines, paragraphs, sentences, segments and scoring units.

A document is a row of (doc_id, fmt, text) with fmt "md", "txt" or "tex". The state of the line parser
(fences, depth of environments, paragraph number) is in running sums over the document's lines, so a long
corpus needs one shuffle on doc_id, which the later steps reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.text import (
    ANCHOR, ENVIRONMENTS, HEADING, LINE_BREAK, TEX_STEPS, cleaned_for_scoring, greedy_groups, is_prose, replaced,
    sentence_array, stripped, tokens, unmarked, word_count,
)

SEGMENT_WORDS, SEGMENT_TAIL = 1000, 500
UNIT_WORDS = 12
CHUNK, OVERLAP = 4096, 256


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, fmt, line, text): lines from 1."""
    return docs.select("doc_id", "fmt", F.posexplode(F.split("text", LINE_BREAK)).alias("_p", "text")).select(
        "doc_id", "fmt", (F.col("_p") + 1).alias("line"), "text"
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para_id, start_line, end_line, text) of markdown, plain text and TeX."""
    doc = Window.partitionBy("doc_id")
    upto = doc.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    tex = F.col("fmt") == "tex"
    rows = lines(docs)
    opening = F.min(F.when(tex & F.col("text").contains("\\begin{document}"), F.col("line"))).over(doc)
    rows = rows.withColumn("_opening", opening).where("_opening is null or line > _opening")
    fence = ~tex & F.ltrim(F.col("text")).startswith("```")
    rows = rows.withColumn("_fence", fence.cast("int")).withColumn("_fences", F.sum("_fence").over(upto))
    rows = rows.where("_fence = 0 and _fences % 2 = 0")
    begins = F.when(tex, F.regexp_count("text", F.lit(rf"\\begin\{{(?:{ENVIRONMENTS})"))).otherwise(0)
    ends = F.when(tex, F.regexp_count("text", F.lit(rf"\\end\{{(?:{ENVIRONMENTS})"))).otherwise(0)
    rows = rows.withColumn("_b", begins).withColumn("_e", ends)
    depth = F.sum(F.col("_b") - F.col("_e")).over(upto)
    rows = rows.withColumn("_depth", depth)
    math = (F.col("_depth") > 0) | (F.col("_depth") + F.col("_e") > 0)
    rows = rows.withColumn("_math", tex & math)
    clean = F.when(tex, replaced(F.col("text"), TEX_STEPS)).otherwise(unmarked(F.col("text")))
    rows = rows.withColumn("_clean", F.when(F.col("_math"), F.lit(ANCHOR)).otherwise(clean))
    rows = rows.where(tex | ~F.col("_clean").rlike(HEADING))
    rows = rows.withColumn("_piece", stripped(F.col("_clean")))
    rows = rows.withColumn("_blank", (F.col("_piece") == "").cast("int")).withColumn("_para", F.sum("_blank").over(upto))
    prose = rows.where("_blank = 0").withColumn("_at", F.when(~F.col("_math"), F.col("line")))
    whole = prose.groupBy("doc_id", "_para").agg(
        F.min("_at").alias("start_line"), F.max("_at").alias("end_line"), F.sort_array(F.collect_list(F.struct("line", "_piece"))).alias("_pieces")
    )
    kept = F.filter("_pieces", lambda p: p["line"] >= F.col("start_line"))
    whole = whole.where("start_line is not null").withColumn("text", F.array_join(F.transform(kept, lambda p: p["_piece"]), " "))
    number = F.row_number().over(doc.orderBy("_para")) - 1
    return whole.select("doc_id", number.alias("para_id"), "start_line", "end_line", "text")


def line_paragraphs(docs: DataFrame) -> DataFrame:
    """Each line that isn't blank as a paragraph, for texts without blank lines; nothing is shuffled."""
    return docs.select("doc_id", F.explode(_line_paragraphs(F.col("text"))).alias("_p")).select(
        "doc_id", (F.col("_p.line") - 1).alias("para_id"), F.col("_p.line").alias("start_line"), F.col("_p.line").alias("end_line"), "_p.text"
    )


def _line_paragraphs(text: Column) -> Column:
    """(line, text) of each line that isn't blank. A lambda's variable keeps each step from being written out in the next."""
    lines_ = F.transform(F.split(text, LINE_BREAK), lambda x, i: F.struct((i + 1).alias("line"), unmarked(x).alias("text")))
    return F.filter(F.transform(lines_, lambda p: F.struct(p["line"].alias("line"), stripped(p["text"]).alias("text"))), lambda p: p["text"] != "")


def sentences(paras: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, para_id, sent_id, line, text, n_words); a sentence has the first line of its paragraph."""
    cut = paras.select("doc_id", "para_id", F.col("start_line").alias("line"), F.posexplode(sentence_array(F.col("text"), least)).alias("sent_id", "text"))
    return cut.withColumn("n_words", word_count(F.col("text")))


def prose(paras: DataFrame) -> DataFrame:
    """(doc_id, text): paragraphs joined by a blank line."""
    parts = F.sort_array(F.collect_list(F.struct("para_id", "text")))
    return paras.groupBy("doc_id").agg(parts.alias("_p")).select("doc_id", F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n").alias("text"))


def segments(paras: DataFrame, least: int = SEGMENT_WORDS, tail: int = SEGMENT_TAIL) -> DataFrame:
    """(doc_id, seg_id, start_line, end_line, words, text): paragraphs in order, until a segment is full."""
    parts = paras.select("doc_id", F.struct("para_id", "start_line", "end_line", word_count(F.col("text")).alias("words"), "text").alias("_p"))
    docs = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    docs = docs.withColumn("_g", greedy_groups(F.transform("_ps", lambda p: p["words"]), least, tail))
    flat = docs.select("doc_id", F.explode(F.arrays_zip("_ps", "_g")).alias("_x")).select("doc_id", F.col("_x._g").alias("seg_id"), "_x._ps.*")
    out = flat.groupBy("doc_id", "seg_id").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("words").alias("words"),
        F.sort_array(F.collect_list(F.struct("para_id", "text"))).alias("_t"),
    )
    return out.select("doc_id", "seg_id", "start_line", "end_line", "words", F.array_join(F.transform("_t", lambda p: p["text"]), "\n\n").alias("text"))


def scored_sentences(paras: DataFrame, least: int = 4) -> DataFrame:
    """Sentences cleaned for scoring, with at least ``least`` words, numbered through the document, prose marked.

    start_byte and end_byte are the sentence's place in the document's scored text, a line for each sentence.
    """
    clean = sentences(paras, 3).withColumn("text", F.explode(F.array(cleaned_for_scoring(F.col("text"))))).withColumn("n_words", word_count(F.col("text"))).where(F.col("n_words") >= least)
    order = Window.partitionBy("doc_id").orderBy("para_id", "sent_id")
    ahead = order.rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("text") + 1
    out = clean.select(
        "doc_id", (F.row_number().over(order) - 1).alias("sent"), "line", "text", "n_words", is_prose(F.col("text")).alias("prose"),
        (F.sum(size).over(ahead) - size).alias("start_byte"), (F.sum(size).over(ahead) - 1).alias("end_byte"),
    )
    return out


def document_sentences(docs: DataFrame, least: int = 4, enough: int = 5) -> DataFrame:
    """(doc_id, sents, groups): the ``eligible`` ``scored_sentences`` of ``line_paragraphs``, a document a row; nothing is shuffled.

    ``sents`` has (line, text, n_words, prose) of each sentence in order, ``groups`` the unit of each that is prose.
    """
    paras = _line_paragraphs(F.col("text"))
    clean = lambda p: F.transform(sentence_array(p["text"], 3), lambda s: F.struct(p["line"].alias("line"), cleaned_for_scoring(s).alias("text")))
    counted = F.transform(F.flatten(F.transform(paras, clean)), lambda s: F.struct(s["line"].alias("line"), s["text"].alias("text"), word_count(s["text"]).alias("n_words")))
    kept = F.filter(counted, lambda s: s["n_words"] >= least)
    rows = docs.select("doc_id", F.explode(F.array(kept)).alias("_k")).where(F.size("_k") >= enough)
    marked = F.transform("_k", lambda s: F.struct(s["line"].alias("line"), s["text"].alias("text"), s["n_words"].alias("n_words"), is_prose(s["text"]).alias("prose")))
    rows = rows.select("doc_id", F.explode(F.array(marked)).alias("sents"))
    prose = F.transform(F.filter("sents", lambda s: s["prose"]), lambda s: s["n_words"])
    return rows.select("doc_id", "sents", greedy_groups(prose, UNIT_WORDS, UNIT_WORDS).alias("groups"))


def document_units(sents: DataFrame) -> DataFrame:
    """(doc_id, unit_id, line, text) of ``document_sentences``: what ``units`` has of them."""
    rows = sents.where(F.size("groups") > 0).select("doc_id", F.filter("sents", lambda s: s["prose"]).alias("_s"), "groups")
    rows = rows.withColumn("_first", F.filter(F.transform("groups", lambda g, i: F.when((i == 0) | (g != F.get("groups", i - 1)), i)), lambda i: i.isNotNull()))
    own = lambda at, i: F.slice("_s", at + 1, F.coalesce(F.get("_first", i + 1), F.size("_s")) - at)
    made = F.transform("_first", lambda at, i: F.struct(F.get("_s", at)["line"].alias("line"), F.array_join(F.transform(own(at, i), lambda s: s["text"]), " ").alias("text")))
    return rows.select("doc_id", F.posexplode(made).alias("unit_id", "_u")).select("doc_id", "unit_id", "_u.line", "_u.text")


def eligible(scored: DataFrame, least: int = 5) -> DataFrame:
    """Sentences of documents that have enough of them to be scored at all."""
    return scored.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where(F.col("_n") >= least).drop("_n")


def units(scored: DataFrame, least: int = UNIT_WORDS) -> DataFrame:
    """(doc_id, unit_id, line, n_sents, words, text): prose sentences in order, until a unit has ``least`` words."""
    part = scored.where("prose").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent", "line", "n_words", "text"))).alias("_s"))
    part = part.withColumn("_g", greedy_groups(F.transform("_s", lambda s: s["n_words"]), least, least))
    flat = part.select("doc_id", F.explode(F.arrays_zip("_s", "_g")).alias("_x")).select("doc_id", F.col("_x._g").alias("unit_id"), "_x._s.*")
    out = flat.groupBy("doc_id", "unit_id").agg(
        F.min("line").alias("line"), F.count(F.lit(1)).alias("n_sents"), F.sum("n_words").alias("words"), F.sort_array(F.collect_list(F.struct("sent", "text"))).alias("_t")
    )
    return out.select("doc_id", "unit_id", "line", "n_sents", "words", F.transform("_t", lambda s: s["sent"]).alias("sents"), F.array_join(F.transform("_t", lambda s: s["text"]), " ").alias("text"))


def scored_tokens(scored: DataFrame) -> DataFrame:
    """(doc_id, pos, sent, token, is_content): tokens numbered through the document; each knows its sentence."""
    t = scored.select("doc_id", "sent", F.posexplode(tokens(F.col("text"))).alias("_k", "token"))
    order = Window.partitionBy("doc_id").orderBy("sent", "_k")
    return t.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "sent", "token", F.col("token").rlike("[a-z]").alias("is_content"))


def token_chunks(counts: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, start, stop, score_from): overlapping chunks of each document's n tokens."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / F.lit(step)).cast("int"))
    rows = counts.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    start = F.col("chunk") * step
    return rows.select("doc_id", "chunk", start.alias("start"), F.least(start + size, F.col("n")).alias("stop"), F.when(F.col("chunk") == 0, 1).otherwise(overlap).alias("score_from"))


def tokens_in_spans(tokens_: DataFrame, spans: DataFrame) -> DataFrame:
    """The label of the span [start, stop) of the same document that holds a token's middle byte, else "symbol"."""
    middle = F.when(F.col("end_byte") > F.col("start_byte"), F.floor((F.col("start_byte") + F.col("end_byte")) / 2)).otherwise(F.col("start_byte"))
    t = tokens_.withColumn("_m", middle).alias("t")
    s = spans.alias("s")
    hit = t.join(s, (F.col("t.doc_id") == F.col("s.doc_id")) & (F.col("s.start") <= F.col("t._m")) & (F.col("t._m") < F.col("s.stop")), "left")
    return hit.select("t.*", F.coalesce("s.label", F.lit("symbol")).alias("class")).drop("_m")


def flattened_includes(files: DataFrame, depth: int = 3) -> DataFrame:
    """TeX files (project, name, text) with included files in their places, ``depth`` levels down; unknown ones stay."""
    pattern = r"\\(?:input|include)\{([^}]*)\}"
    bare = lambda c: F.regexp_replace(c, r"\.tex$", "")
    names = files.select(F.col("project").alias("_p"), bare("name").alias("_n"), F.col("text").alias("_body")).dropDuplicates(["_p", "_n"])
    out = files.select("project", "name", "text")
    for _ in range(depth):
        parts = out.select("project", "name", F.posexplode(F.split("text", rf"(?={pattern})")).alias("_k", "_part"))
        parts = parts.withColumn("_key", bare(F.regexp_extract("_part", rf"^{pattern}", 1)))
        joined = parts.join(names, (F.col("project") == F.col("_p")) & (F.col("_key") == F.col("_n")), "left")
        tail = F.regexp_replace("_part", rf"^{pattern}", "")
        joined = joined.withColumn("_t", F.when(F.col("_body").isNotNull(), F.concat("_body", tail)).otherwise(F.col("_part")))
        out = joined.groupBy("project", "name").agg(F.sort_array(F.collect_list(F.struct("_k", "_t"))).alias("_l"))
        out = out.select("project", "name", F.array_join(F.transform("_l", lambda x: x["_t"]), "").alias("text"))
    return out
