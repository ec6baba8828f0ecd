"""Lexical rules as tables, matched by joins on words.

A rule table has a row for each token: (rule, level, message, action, token, replacement). Tokens of one or more
words are matched by an equi-join on their first word and a look at the words after it, in one pass over
the lines; tokens that are regular expressions in one more. Tokens of three words with up to two words in each gap are
``trigram_hits``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions.text import word_count
from inkstone.operators.findings import finding
from inkstone.schema import RULE_TOKEN
from inkstone.sources.store import stored

#: Severity of a rule's level; rules that are off or weaker for a format.
SEVERITY = {"suggestion": 0.3, "warning": 0.6, "error": 0.9}
UNKNOWN_SEVERITY = 0.3
OVERRIDES = (("formal_transitions", None, "suggestion", True), ("em_dash_usage", "tex", None, False))
#: Tokens of a rule table that is broadcast.
MOST_RULES = 100_000
#: Regular expressions among the tokens of a rule table, which are tried on each line that one of them matches.
MOST_PATTERNS = 2_000
STYLE_POS = ("verb", "adjective", "adverb", "noun")
#: A gap of up to two words as the literal pattern has it, which wants no blank before the gap.
STRICT_GAP = r"(?:\w+[''\w]*\s+){0,2}"
WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"

#: Built-in rules, our own: (rule, level, message, action, tokens); an underscore is a blank, what is after = a replacement.
BUILT_IN = (
    ("formal_transitions", "warning", "A formal transition.", None, "moreover furthermore additionally consequently nevertheless nonetheless notably importantly specifically thereby"),
    ("hedging_phrases", "warning", "A hedge that adds nothing.", "remove", "arguably seemingly presumably ostensibly it_is_worth_noting_that it_should_be_noted_that"),
    ("filler_phrases", "warning", "A filler phrase.", "remove", "at_the_end_of_the_day in_order_to when_it_comes_to in_today's_world"),
    ("serves_as", "suggestion", "A dodge for a plain verb.", None, "serves represents embodies exemplifies"),
    ("overused_words", "suggestion", "An overused word.", None, "delve tapestry testament pivotal intricate meticulous vibrant underscore showcase realm"),
    ("plain_words", "suggestion", "A plainer word is there.", "replace", "utilize=use leverage=use facilitate=help commence=start"),
)
#: Built-in rules on the raw line: (rule, level, message, pattern).
PATTERNS = (
    ("em_dash_usage", "suggestion", "An em dash.", "—|(?<!-)--(?!-)"),
    ("semicolon_usage", "suggestion", "A semicolon.", ";"),
    ("not_just_but", "warning", "The scaffold 'not just X but Y'.", r"(?i)\bnot (?:just|only|merely)\b[^.!?]{1,80}?\bbut\b"),
)


def built_in_rules(spark: SparkSession) -> DataFrame:
    rows = []
    for rule, level, message, action, tokens in BUILT_IN:
        for t in tokens.split():
            token, _, replacement = t.partition("=")
            rows.append((rule, level, message, action, token.replace("_", " "), replacement or None))
    return spark.createDataFrame(rows, RULE_TOKEN)


def small(rules: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """A table to broadcast, if it has at most ``most`` rows; a larger one is joined as it is. It is computed once."""
    rows = rules.limit(most + 1).collect()
    return F.broadcast(rules.sparkSession.createDataFrame(rows, rules.schema)) if len(rows) <= most else stored(rules)


def words_at(rows: DataFrame, text: str = "text", ahead: int = 0) -> DataFrame:
    """A row for each word of a line: its lower case, its span in characters from 1, both ends included, and in next
    the ``ahead`` words after it with what stands before each.

    The lengths of the words and of what stands between them, added up, give the places.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    gaps = F.split(F.col(text), WORD)
    keep = [c for c in rows.columns if c != text]
    rows = rows.withColumn("_w", F.arrays_zip(words.alias("w"), gaps.alias("g")))
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["s"] + F.length(x["g"]) + F.coalesce(F.length(x["w"]), F.lit(0))
        return F.struct(end.alias("s"), F.concat(acc["out"], F.array(end)).alias("out"))

    ends = F.aggregate("_w", start, add, lambda acc: acc["out"])
    follow = F.transform("_w", lambda x, i: F.slice("_w", i + 2, ahead)) if ahead else F.transform("_w", lambda x: F.lit(None))
    zipped = F.arrays_zip(F.col("_w").alias("x"), ends.alias("e"), follow.alias("next"))
    rows = rows.select(*keep, F.posexplode(zipped).alias("at", "_z")).where(F.col("_z.x.w").isNotNull())
    out = rows.select(*keep, "at", F.col("_z.x.w").alias("word"), F.lower("_z.x.w").alias("word_lc"), (F.col("_z.e") - F.length("_z.x.w") + 1).alias("span_start"), F.col("_z.e").alias("span_end"), F.col("_z.next").alias("next"))
    return out if ahead else out.drop("next")


#: Signs that make a token a regular expression.
REGEX = r"[\\\[\](){}*+?|^$]"


def token_hits(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, fmt, line, rule, level, message, action, replacement, match, span_start, span_end) of tokens in words.

    The words of a token stand in a line with any blanks or marks between them. The first one is joined; the words
    after it, a slice of the line's as long as the longest token, are compared with the rest.
    """
    w = F.split(F.lower(F.trim("token")), " +")
    known = small(rules.where(~F.col("token").rlike(REGEX)).withColumn("_w", w).where("_w[0] <> ''"))
    ahead = known.agg(F.coalesce(F.max(F.size("_w")), F.lit(1))).first()[0] - 1
    known = known.withColumn("_first", F.col("_w")[0]).withColumn("_rest", F.expr("slice(_w, 2, size(_w))"))
    hits = words_at(lines, ahead=ahead).join(known, F.col("word_lc") == F.col("_first"))
    match, end = F.col("word"), F.col("span_end")
    if ahead:
        after = F.slice("next", F.lit(1), F.size("_rest"))
        hits = hits.where(F.transform(after, lambda x: F.lower(x["w"])).eqNullSafe(F.col("_rest")))
        match = F.concat(match, F.array_join(F.transform(after, lambda x: F.concat(x["g"], x["w"])), ""))
        end = F.col("span_start") + F.length(match) - 1
    return hits.select("doc_id", "fmt", "line", "rule", "level", "message", "action", "replacement", match.alias("match"), "span_start", end.alias("span_end"))


def regex_rules(rules: DataFrame, most: int = MOST_PATTERNS) -> list[tuple]:
    """(rule, level, message, pattern) of the tokens that are regular expressions, which are matched in any case."""
    rows = rules.where(F.col("token").rlike(REGEX)).select("rule", "level", "message", "token").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} tokens are regular expressions; give them as words")
    return sorted((r.rule, r.level, r.message, f"(?i){r.token}") for r in rows)


def severity(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.coalesce(F.element_at(table, level), F.lit(UNKNOWN_SEVERITY))


def overridden(hits: DataFrame) -> DataFrame:
    """Hits (rule, fmt, level, ...) with their format's level, without those that are off for it."""
    for rule, fmt, level, on in OVERRIDES:
        here = (F.col("rule") == rule) & (F.lit(True) if fmt is None else F.col("fmt") == fmt)
        hits = hits.withColumn("level", F.when(here, F.lit(level)).otherwise(F.col("level"))) if on else hits.where(~here)
    return hits


def pattern_hits(lines: DataFrame, patterns=PATTERNS) -> DataFrame:
    """Hits of patterns on lines, a row for each, in one pass; spans from the text between them.

    Lines that no pattern matches go first, by one expression of all of them.
    """
    each = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(p, ("rule", "level", "message", "pattern"), strict=True)]) for p in patterns])
    got = lines.where(F.col("text").rlike("|".join(f"(?:{p[3]})" for p in patterns))).select("doc_id", "fmt", "line", "text", F.explode(each).alias("_p"))
    got = got.where(F.rlike("text", F.col("_p.pattern")))
    z = F.arrays_zip(F.regexp_extract_all("text", F.col("_p.pattern"), F.lit(0)).alias("m"), F.split("text", F.col("_p.pattern")).alias("g"))
    got = got.withColumn("_z", z).withColumn("_s", F.transform("_z", lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))))
    got = got.select("doc_id", "fmt", "line", "_p", "_s", F.posexplode("_z").alias("_k", "_x")).where("length(_x.m) > 0")
    end = F.aggregate(F.expr("slice(_s, 1, _k + 1)"), F.lit(0), lambda a, b: a + b)
    return got.select(
        "doc_id", "fmt", "line", "_p.rule", "_p.level", "_p.message", F.lit(None).cast("string").alias("action"),
        F.lit(None).cast("string").alias("replacement"), F.col("_x.m").alias("match"), (end - F.length("_x.m") + 1).alias("span_start"), end.alias("span_end"),
    )


def trigram_hits(sents: DataFrame, trigrams: DataFrame, gap: int = 2) -> DataFrame:
    """(doc_id, para_id, sent_id, trigram): the words of (trigram) in their order, at most ``gap`` words between two.

    One row for each place of the first word, at the nearest places of the others.
    """
    parts = F.split(F.lower("trigram"), " ")
    rules = trigrams.select("trigram", parts[0].alias("_a"), parts[1].alias("_b"), parts[2].alias("_c"))
    w = sents.withColumn("_w", F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)*"), F.lit(0)))
    at = w.select("doc_id", "para_id", "sent_id", "_w", F.posexplode("_w").alias("_i", "_word")).select(
        "doc_id", "para_id", "sent_id", "_word", F.expr(f"slice(_w, _i + 2, {2 * gap + 2})").alias("_next")
    )
    hit = at.join(small(rules), F.col("_word") == F.col("_a"))
    near = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    third = lambda i: F.exists(near(1, gap + 1), lambda j: F.get("_next", i + j).eqNullSafe(F.col("_c")))
    ok = F.exists(near(0, gap), lambda i: F.get("_next", i).eqNullSafe(F.col("_b")) & third(i))
    return hit.where(ok).select("doc_id", "para_id", "sent_id", "trigram")


def strict_pattern(trigram: str) -> str:
    """The literal pattern of a trigram, which matches only text without a blank before its gaps."""
    return STRICT_GAP.join(trigram.split())


def lexical(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of the layer, with their format's overrides."""
    rules = small(rules)
    hits = overridden(token_hits(lines, rules).unionByName(pattern_hits(lines, (*PATTERNS, *regex_rules(rules)))))
    action = F.when(F.col("action").isNotNull(), F.map_from_arrays(F.array(F.lit("action"), F.lit("replacement")), F.array("action", F.coalesce("replacement", F.lit("")))))
    return finding(hits, "lexical", F.col("rule"), severity(F.col("level")), F.col("message"), "line", ("span_start", "span_end"), "match", action)


def density(hits: DataFrame, paras: DataFrame) -> DataFrame:
    """(doc_id, words, strong_per_1k, all_per_1k) of hits with a severity."""
    words = paras.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("words"))
    n = hits.groupBy("doc_id").agg(F.count_if(F.col("severity") >= 0.6).alias("_s"), F.count(F.lit(1)).alias("_n"))
    base = F.greatest(F.lit(1), F.col("words"))
    rate = lambda c: (F.lit(1000.0) * F.coalesce(c, F.lit(0)) / base)
    return words.join(n, "doc_id", "left").select("doc_id", "words", rate(F.col("_s")).alias("strong_per_1k"), rate(F.col("_n")).alias("all_per_1k"))


def excess_vocabulary(words: DataFrame, group: Column, least: int = 20, ratio: float = 2.0) -> DataFrame:
    """(word, n_in, n_out, ratio): words more frequent in a group of texts than in the rest, as a rule table's tokens."""
    n = words.select(F.col("word_lc").alias("word"), group.alias("_g")).groupBy("word").agg(F.count_if("_g").alias("n_in"), F.count_if(~F.col("_g")).alias("n_out"))
    total = n.agg(F.sum("n_in").alias("_in"), F.sum("n_out").alias("_out"))
    r = ((F.col("n_in") + 0.5) / (F.col("_in") + 1.0)) / ((F.col("n_out") + 0.5) / (F.col("_out") + 1.0))
    return n.where(F.col("n_in") >= least).crossJoin(F.broadcast(total)).withColumn("ratio", r).where(F.col("ratio") >= ratio).select("word", "n_in", "n_out", "ratio")


def compile_excess(csv: DataFrame) -> DataFrame:
    """Tokens of a vocabulary table (word, type, pos): style words of open classes, each once, in order."""
    return csv.where((F.col("type") == "style") & F.col("pos").isin(*STYLE_POS)).select(F.col("word").alias("token")).distinct().orderBy("token")


def compile_list(rows: DataFrame, column: str = "value") -> DataFrame:
    """Tokens of a list of lists: the first of each, once, in order."""
    return rows.select(F.col(column)[0].alias("token")).distinct().orderBy("token")


def compile_trigrams(rows: DataFrame, column: str = "value") -> DataFrame:
    """Patterns of a list of trigrams, in order; copies stay."""
    quoted = F.transform(F.split(F.col(column)[0], " "), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_'])", r"\\$1"))
    return rows.select(F.array_join(quoted, STRICT_GAP).alias("token")).orderBy("token")


def tier_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, line, tier, cell, second): rows of the tables under headings '### Tier n'; any heading ends one."""
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("text").startswith("#")
    rows = lines.withColumn("_h", F.when(heading, F.regexp_extract("text", r"^### (Tier \d)", 1)))
    rows = rows.withColumn("tier", F.last("_h", ignorenulls=True).over(upto)).where("tier <> ''")
    rows = rows.where(F.col("text").startswith("|") & ~F.col("text").rlike(r"^\|[\s\-|]+\|$"))
    cells = F.transform(F.split(F.btrim("text", F.lit("|")), r"\|"), lambda c: F.trim(c))
    rows = rows.withColumn("_c", cells).where((F.size("_c") >= 2) & (F.col("_c")[0] != ""))
    rows = rows.where(~F.lower(F.col("_c")[0]).startswith("slop word") & ~F.lower(F.col("_c")[0]).startswith("phrase"))
    return rows.select("doc_id", "line", "tier", F.col("_c")[0].alias("cell"), F.col("_c")[1].alias("second"))


def cell_words(cell: Column) -> Column:
    """Words of a table cell: without what is in parentheses, cut at slashes."""
    return F.filter(F.transform(F.split(F.regexp_replace(cell, r"\([^)]*\)", ""), "/"), lambda c: F.trim(c)), lambda w: w != "")


def phrase_pattern(cell: str) -> str | None:
    """The pattern of a phrase in a table cell: "[a/b]" is a choice; a template has none."""
    bare = re.sub(r"[.…]+$", "", cell.strip().strip('"').strip()).rstrip(", ").strip()
    if bare.lower() == "not just x, but y":
        return None
    parts = re.split(r"\[([^\]]+)\]", bare)
    return "".join("(?:" + "|".join(map(re.escape, p.split("/"))) + ")" if i % 2 else re.escape(p) for i, p in enumerate(parts))
