"""Edits of lines from findings: replacing, deleting, splitting."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE_RULES = ("filler_phrases", "hedging_phrases")
TRANSITION_RULE, SPLIT_RULE = "formal_transitions", "semicolon_usage"
#: Transitions that only add and may go.
ADDITIVE = "specifically moreover furthermore additionally notably importantly interestingly thereby".split()


def kind(rule: Column, match: Column, action: Column, replacement: Column) -> Column:
    """"replace", "delete", "split" or null. A replacement is one word for one word, or none at all."""
    one = ~F.trim(match).contains(" ") & ~F.trim(replacement).contains(" ")
    bare = F.regexp_replace(F.lower(F.trim(match)), ",+$", "")
    return (
        F.when((action == "replace") & replacement.isNotNull() & one, "replace").when(rule.isin(*DELETE_RULES), "delete")
        .when((rule == TRANSITION_RULE) & bare.isin(*ADDITIVE), "delete").when(rule == SPLIT_RULE, "split")
    )


def fixable(findings: DataFrame) -> DataFrame:
    """Findings of lines that can be mended, with their kind; (rule, match, action, replacement, line, ...)."""
    return findings.withColumn("kind", kind(F.col("rule"), F.col("match"), F.col("action"), F.col("replacement"))).where("kind is not null and line > 0")


def edits(rows: DataFrame) -> DataFrame:
    """(.., start, stop, new): slices of ``text`` from 0 and what is put there; rows whose span isn't their match go."""
    text, s, e = F.col("text"), F.col("span_start") - 1, F.col("span_end")
    at = lambda i, n: F.substring(text, i + 1, n)
    rest = lambda i: at(i, F.length(text))
    rows = rows.where(at(s, e - s) == F.col("match"))
    upper = lambda c: c.rlike(r"^\p{Lu}")
    lower = lambda c: c.rlike(r"^\p{Ll}")
    new = F.col("replacement")
    swapped = F.when(upper(F.col("match")) & lower(new), F.concat(F.upper(F.substring(new, 1, 1)), F.expr("substring(replacement, 2)"))).otherwise(new)
    semicolon = F.length(F.regexp_extract(rest(s), r"^;\s*", 0))
    following = at(s + semicolon, F.lit(1))
    can_split = (semicolon > 0) & following.rlike(r"^\p{L}$")
    after = e + F.length(F.regexp_extract(rest(e), r"^,?\s*", 0))
    initial = (s == 0) | at(F.lit(0), s).rlike(r"[.!?]\s+$")
    raise_ = initial & lower(at(after, F.lit(1)))
    k = F.col("kind")
    rows = rows.where((k != "split") | can_split)
    return (
        rows.withColumn("start", s)
        .withColumn("stop", F.when(k == "replace", e).when(k == "split", s + semicolon + 1).otherwise(F.when(raise_, after + 1).otherwise(after)))
        .withColumn("new", F.when(k == "replace", swapped).when(k == "split", F.concat(F.lit(". "), F.upper(following))).otherwise(F.when(raise_, F.upper(at(after, F.lit(1)))).otherwise("")))
    )


def apply(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, line, text, fixed, n_edits): lines with their edits, from right to left, those that overlap one done left out.

    Runs of blanks in an edited line become one, its indentation too.
    """
    rows = edits(found.join(lines.select("doc_id", "line", "text"), ["doc_id", "line"]))
    per = rows.groupBy("doc_id", "line", "text").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "new")), asc=False).alias("_e"))
    start = F.struct(F.col("text").alias("t"), F.length("text").alias("edge"), F.lit(0).alias("n"))
    length = F.length("text")

    def step(acc: Column, x: Column) -> Column:
        head, tail = F.substring(acc["t"], F.lit(1), x["start"]), F.substring(acc["t"], x["stop"] + 1, F.length(acc["t"]) + length)
        done = F.struct(F.concat(head, x["new"], tail).alias("t"), x["start"].alias("edge"), (acc["n"] + 1).alias("n"))
        return F.when(x["stop"] <= acc["edge"], done).otherwise(acc)

    out = per.withColumn("_r", F.aggregate("_e", start, step))
    return out.select("doc_id", "line", "text", F.regexp_replace("_r.t", " {2,}", " ").alias("fixed"), F.col("_r.n").alias("n_edits"))


def fixed_documents(lines: DataFrame, fixed: DataFrame) -> DataFrame:
    """(doc_id, text, fixed): whole documents before and after, lines joined by line feeds."""
    rows = lines.join(fixed.select("doc_id", "line", "fixed"), ["doc_id", "line"], "left")
    parts = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "text", F.coalesce("fixed", "text").alias("f")))).alias("_l"))
    return parts.select("doc_id", F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("text"), F.array_join(F.transform("_l", lambda x: x["f"]), "\n").alias("fixed"))


def _diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        diffs = ["\n".join(difflib.unified_diff(t.split("\n"), f.split("\n"), "before", "after", lineterm="")) for t, f in zip(b["text"], b["fixed"], strict=True)]
        yield pd.DataFrame({"doc_id": b["doc_id"], "diff": diffs})


def diffs(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", "fixed").mapInPandas(_diff, "doc_id long, diff string")
