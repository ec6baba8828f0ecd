"""Command line: report on documents, build a profile, score with word models. Runs under spark-submit too."""

from __future__ import annotations

import argparse
import sys
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import features, findings, heuristics, lexical, parse, profile, statistical, tagging
from inkstone.sources import files


def layers(spark: SparkSession, docs: DataFrame, rules: DataFrame, known: dict | None) -> tuple[DataFrame, DataFrame]:
    """(findings, metrics) of the layers that can run."""
    paras = parse.paragraphs(docs)
    found, metrics = heuristics.heuristics(paras, parse.sentences(paras))
    parts = [lexical.lexical(parse.lines(docs), rules), found]
    if known:
        counts = features.counts(parse.prose(paras), tagger=tagging.tagged)
        bands = profile.length_bands(known["segments"], profile.lengths(counts))
        parts.append(profile.structural(counts, profile.chosen_bands(bands, known["bands"], None, 0)))
        key = ["doc_id", "seg_id", "words"]
        segments = features.counts(parse.segments(paras), key, partial(tagging.tagged, key=key))
        parts.append(profile.segment_findings(profile.segment_scan(segments, known["segments"].select("feature", "rate"))))
    return findings.union(*parts), metrics


def report(spark: SparkSession, args) -> int:
    docs = files.corpus(spark, *args.paths)
    rules = lexical.built_in_rules(spark)
    if args.rules:
        rules = rules.unionByName(files.rules_from_yaml(spark, *args.rules))
    known = files.load_profile(spark, args.profiles, args.profile) if args.profile else None
    found, metrics = layers(spark, docs, rules, known)
    kept = findings.at_least(findings.merge(found), args.min_severity)
    out = findings.reports(kept, metrics.join(docs.select("doc_id", "path"), "doc_id"))
    if args.out:
        files.write_reports(out, args.out)
    else:
        for row in out.orderBy("doc_id").toLocalIterator():
            print(row.report if args.json else findings.render(row.report))
    for hint in setup_hints(args):
        print(hint, file=sys.stderr)
    return 0


def setup_hints(args) -> list[str]:
    """What a report didn't look at, and the command that would change it."""
    out = []
    if not args.profile:
        out.append("No profile given: the structural layer did not run. Build one with: baseline PATHS --name NAME, then report --profile NAME.")
    if not args.rules:
        out.append("Only the built-in rules were matched. Rule files in YAML are given with --rules FILE; lexical.compile_excess, compile_list and compile_trigrams make them of vocabularies.")
    out.append("Token statistics are a command of their own: stat PATHS --observer CORPUS --performer CORPUS; statistical.provided_scores takes models of language.")
    return out


def build(spark: SparkSession, args) -> int:
    docs = files.corpus(spark, *args.paths)
    paras = parse.paragraphs(docs)
    admission = profile.admitted(paras)
    profile.check_corpus(admission)
    kept = paras.join(admission.where("kept"), "doc_id", "left_semi")
    counts = features.counts(parse.prose(kept), tagger=tagging.tagged)
    segs = parse.segments(paras).where(F.col("words") >= profile.SEGMENT_WORDS)
    key = ["doc_id", "seg_id", "words"]
    per = features.counts(segs.select(*key, "text"), key, partial(tagging.tagged, key=key))
    per = per.select(F.col("doc_id").alias("doc"), F.col("seg_id").alias("seg"), "tokens", "feature", "n", "rate")
    _, metrics = heuristics.heuristics(kept, parse.sentences(kept))
    files.save_profile(args.profiles, args.name, bands=profile.bands(counts), segments=per, metrics=profile.metric_bands(metrics, ["sentence_cv", "paragraph_cv"]))
    return 0


def stat(spark: SparkSession, args) -> int:
    """Token statistics with word models of two corpora, which stand in for models of language."""
    docs = files.corpus(spark, *args.paths)
    scored = parse.eligible(parse.scored_sentences(parse.paragraphs(docs)))
    model = statistical.word_model(files.corpus(spark, args.observer), files.corpus(spark, args.performer))
    hot = statistical.hot_tokens(statistical.count_model_scores(parse.scored_tokens(scored), model))
    statistical.document_scores(hot).show(args.top, truncate=False)
    statistical.unit_scores(hot, parse.units(scored)).orderBy("b").show(args.top, truncate=60)
    statistical.token_classes(hot).orderBy(F.desc("delta_mean")).show(args.top)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkstone")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report")
    r.add_argument("paths", nargs="+")
    r.add_argument("--profile")
    r.add_argument("--profiles", default="profiles")
    r.add_argument("--rules", nargs="*")
    r.add_argument("--min-severity", type=float, default=0.0)
    r.add_argument("--json", action="store_true")
    r.add_argument("--out")
    b = sub.add_parser("baseline")
    b.add_argument("paths", nargs="+")
    b.add_argument("--name", required=True)
    b.add_argument("--profiles", default="profiles")
    s = sub.add_parser("stat")
    s.add_argument("paths", nargs="+")
    s.add_argument("--observer", required=True)
    s.add_argument("--performer", required=True)
    s.add_argument("--top", type=int, default=3)
    sub.add_parser("fix").add_argument("paths", nargs="*")
    args = p.parse_args(argv)
    if args.command == "fix":
        print("Fixing files in place is switched off; write_fixed makes a table of mended texts.", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("inkstone").getOrCreate()
    return {"report": report, "baseline": build, "stat": stat}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
