"""Findings of all layers: building, merging, filtering, reporting."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.schema import FINDING

ERROR, WARNING = 0.9, 0.6


def finding(rows: DataFrame, layer: str, rule, severity, message, line: str | None = None, span: tuple[str, str] | None = None, match: str | None = None, payload: Column | None = None) -> DataFrame:
    """Rows as findings; rule, severity and message are values or columns."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    cast = dict(zip(FINDING.fieldNames(), FINDING.fields, strict=True))
    columns = {
        "doc_id": F.col("doc_id"), "line": F.col(line) if line else F.lit(0), "span_start": F.col(span[0]) if span else F.lit(0),
        "span_end": F.col(span[1]) if span else F.lit(0), "layer": F.lit(layer), "rule": value(rule), "severity": value(severity),
        "message": value(message), "match": F.col(match) if match else F.lit(""), "payload": payload if payload is not None else F.lit(None),
    }
    return rows.select(*[c.cast(cast[n].dataType).alias(n) for n, c in columns.items()])


def union(*layers: DataFrame) -> DataFrame:
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def merge(findings: DataFrame) -> DataFrame:
    """Of findings of one line that overlap, those that come first by severity stay; the document's all stay.

    Spans that share but a boundary character don't overlap. A line's findings are few, so they are one array.
    """
    whole = findings.where("line <= 0")
    fields = [c for c in findings.columns if c not in ("doc_id", "line")]
    rank = F.struct((-F.col("severity")).alias("_s"), "span_start", "span_end", "rule", *[c for c in fields if c not in ("span_start", "span_end", "rule", "payload")], *[F.to_json(c).alias("_j") for c in ("payload",) if c in fields])
    rows = findings.where("line > 0").groupBy("doc_id", "line").agg(F.sort_array(F.collect_list(rank)).alias("_f"))
    clash = lambda k, f: (k["span_start"] < f["span_end"]) & (f["span_start"] < k["span_end"])
    kept = F.aggregate("_f", F.slice("_f", 1, 0), lambda acc, f: F.when(F.exists(acc, lambda k: clash(k, f)), acc).otherwise(F.concat(acc, F.array(f))))
    rows = rows.select("doc_id", "line", F.explode(kept).alias("_k"))
    back = [F.from_json("_k._j", "map<string,string>").alias(c) if c == "payload" else F.col(f"_k.{c}").alias(c) for c in fields]
    return rows.select("doc_id", "line", *back).select(findings.columns).unionByName(whole)


def at_least(findings: DataFrame, severity: float) -> DataFrame:
    return findings.where(F.col("severity") >= severity)


def per_thousand_words(findings: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, words, findings, strong, per_1k, strong_per_1k): of (doc_id, words), documents without findings too."""
    n = findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("severity") >= WARNING).alias("_s"))
    all_, strong, base = F.coalesce("_n", F.lit(0)), F.coalesce("_s", F.lit(0)), F.greatest(F.lit(1), F.col("words"))
    return words.join(n, "doc_id", "left").select(
        "doc_id", "words", all_.alias("findings"), strong.alias("strong"), (F.lit(1000.0) * all_ / base).alias("per_1k"), (F.lit(1000.0) * strong / base).alias("strong_per_1k")
    )


def label(severity: Column) -> Column:
    return F.when(severity >= ERROR, "ERR").when(severity >= WARNING, "WARN").otherwise("sugg")


def worklist(findings: DataFrame) -> DataFrame:
    """Findings of lines in the order to work through them, with their label."""
    return findings.where("line > 0").withColumn("label", label(F.col("severity"))).orderBy("doc_id", "line", "span_start")


def recurring(findings: DataFrame, least: int = 3, top: int = 10) -> DataFrame:
    """(doc_id, rule, n): each document's rules with ``least`` findings of lines or more, the ``top`` most frequent."""
    n = findings.where("line > 0").groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "rule")
    return n.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def profile_sections(findings: DataFrame) -> dict[str, DataFrame]:
    """The document's findings: rates by sigma, segments by p, others by severity."""
    whole = findings.where("line = 0")
    sigma, p = F.col("payload")["sigma"].cast("double"), F.col("payload")["p"].cast("double")
    return {
        "rates": whole.where(sigma.isNotNull()).orderBy("doc_id", sigma.desc()),
        "segments": whole.where(p.isNotNull()).orderBy("doc_id", p.asc()),
        "other": whole.where(sigma.isNull() & p.isNull()).orderBy("doc_id", F.desc("severity")),
    }


def chance_flags(tested: Column) -> Column:
    """Flags to be expected by chance at 0.05 among so many tests."""
    return F.greatest(F.lit(1), F.round(tested * F.lit(0.05)).cast("int"))


def reports(findings: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc_id, report): each document's meta row and findings as JSON, a document a row."""
    f = F.struct(*[c for c in findings.columns if c != "doc_id"])
    order = F.struct("line", "span_start", "rule")
    rows = findings.select("doc_id", F.struct(order.alias("_o"), f.alias("_f")).alias("_x"))
    rows = rows.withColumn("_x", F.struct(F.col("_x._o").alias("o"), F.to_json("_x._f").alias("j")))
    all_ = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("_x")).alias("_l"))
    m = meta.select("doc_id", F.to_json(F.struct(*meta.columns)).alias("_m")).join(all_, "doc_id", "left")
    items = F.coalesce(F.array_join(F.transform("_l", lambda x: x["j"]), ","), F.lit(""))
    return m.select("doc_id", F.concat(F.lit('{"meta":'), "_m", F.lit(',"findings":['), items, F.lit("]}")).alias("report"))


def render(report: str) -> str:
    """One document's report as lines for a terminal."""
    got = json.loads(report)
    name = lambda s: "ERR" if s >= ERROR else "WARN" if s >= WARNING else "sugg"
    out = ["  ".join(f"{k}={v}" for k, v in got["meta"].items())]
    for f in got["findings"]:
        place = f"line {f['line']}:{f['span_start']}" if f["line"] else "document"
        out.append(f"{name(f['severity']):5}{place:16}{f['rule']}  {f.get('match') or ''}  {f['message']}".rstrip())
    return "\n".join(out)
